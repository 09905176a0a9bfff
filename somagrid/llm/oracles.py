"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from somagrid.llm import backoff, licences, secrets


def op3() -> str:
    """Backoff scores of order 3 by grouped n-grams."""
    a, c = backoff.ALPHA, backoff.CUTOFF
    return f"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
t as (select r, unnest(w) as x, generate_subscripts(w, 1) as i from d),
g as (select r, i, x, lag(x) over p as y, lag(x, 2) over p as z from t window p as (partition by r order by i)),
n1 as (select x, count(*) as n from g group by x),
n2 as (select y, x, count(*) as n from g where y is not null group by y, x),
n3 as (select z, y, x, count(*) as n from g where z is not null group by z, y, x),
total as (select count(*) as n from g),
s as (
  select g.r, case
    when n3.n >= {c} then ln(n3.n / c2.n)
    when n2.n >= {c} then ln(n2.n / c1.n) + (least(g.i, 3) - 2) * ln({a})
    else ln(n1.n / (select n from total)) + (least(g.i, 3) - 1) * ln({a}) end as p
  from g join n1 on n1.x = g.x
  left join n2 on n2.y = g.y and n2.x = g.x
  left join n3 on n3.z = g.z and n3.y = g.y and n3.x = g.x
  left join n1 as c1 on c1.x = g.y
  left join n2 as c2 on c2.y = g.z and c2.x = g.y)
select d.doc_id, len(d.w)::bigint as n_words, round(coalesce(q.p, 0.0), 4) as log_score
from d left join (select r, sum(p) as p from s group by r) as q on q.r = d.r"""


OP4 = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint as score
  from v as a join v as b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0),
o as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from o where rank <= 20"""


def op5() -> str:
    """Dice coefficient of every line and text with every template."""
    rows = ", ".join(f"('{k}', '{' '.join(licences.normal_words(t))}')" for k, t in licences.TEMPLATES.items())
    return f"""
with t as (select licence, string_split(words, ' ') as w from (values {rows}) as v(licence, words)),
tg as (select licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from t),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
u as (select distinct r, unnest(list_append(string_split(text, chr(10)), text)) as u from d),
w as (select r, u, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') as w from u),
g as (select r, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) between 2 and 400),
s as (select g.r, g.u, tg.licence, 2.0 * len(list_intersect(g.g, tg.g))::double / (len(g.g) + len(tg.g)) as dice
      from g join tg on len(g.g) <= 1.5 * len(tg.g) + 1 and len(tg.g) <= 1.5 * len(g.g) + 1),
h as (select * from s where dice >= {licences.DICE}),
b as (select r, count(distinct u) as n_units from h group by r),
top as (select r, licence, dice from h qualify row_number() over (partition by r order by dice desc, licence) = 1)
select d.doc_id, top.licence, top.dice, coalesce(b.n_units, 0)::bigint as n_units from d left join top on top.r = d.r left join b on b.r = d.r"""


def op10() -> str:
    """Matches from the pieces between them, owners by grouped values."""
    kinds = [(k, p.removeprefix("(?i)"), g, n) for k, p, g, n in secrets.KINDS] + [("bare", secrets.BARE, 0, 20)]
    part = []
    for order, (kind, p, group, least) in enumerate(kinds):
        p, flags = p.replace("'", "''"), ", 'i'" if kind == "assign" else ""
        part.append(f"""
select r, src, '{kind}' as kind, {order} as ord, s, s + len(m) as e, v from (
  select r, src, unnest(ms) as m, unnest(vs) as v, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0)))::bigint as s from (
    select r, src, regexp_extract_all(text, '{p}', 0{flags}) as ms, regexp_extract_all(text, '{p}', {group}{flags}) as vs, string_split_regex(text, '{"(?i)" if flags else ""}{p}') as gs from d where regexp_matches(text, '{p}'{flags}))) where len(v) >= {least}"""
                    + (" and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')" if kind == "bare" else ""))
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, '') as src from documents),
x as ({" union all ".join(part)}),
o as (select lower(v) as h, count(distinct src) as owners from x group by 1),
y as (select x.*, case when owners <= {secrets.LIVE_OWNERS} then 'live' when owners >= {secrets.WIDE_OWNERS} then 'example' end as verdict from x join o on o.h = lower(x.v)),
a as (select r, kind, ord, s, e from x where ord < 3 union all select distinct r, verdict, 3, s, e from y where verdict is not null),
z as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, ord) filter (ord < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, ord, e, kind) as spans from a group by r)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join z on z.r = d.r"""


OP11 = """
with t as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (
  select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(u[1:a], '') as x, array_to_string(u[a + 1:b], '') as y, array_to_string(u[b + 1:], '') as z from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(x) end::bigint as prefix_chars,
  case when form <> 'plain' then length(y) end::bigint as middle_chars,
  sha256(case form when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y when 'spm' then '<S>' || z || '<P>' || x || '<M>' || y else text end) as output_sha256,
  sha256(text) as restored_sha256 from p"""


ORACLES = {"op3_lm_scores": op3(), "op4_topk": OP4, "op5_licences": op5(), "op10_secrets": op10(), "op11_fill_in_middle": OP11}
