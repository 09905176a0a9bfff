"""Nearest neighbours at the right scale for each place.

A pyramid holds the number of points in buckets of doubling edge.  The smallest
bucket around a query position that holds enough points bounds how far its
last neighbour can be, so every position knows from counts alone how far to
look, and points are joined once:

- positions of one scale meet the points of their block and its halo in a task,
  which starts with small buckets there and looks further only for positions
  not yet sure;
- where block and halo hold too many points for one task (a sparse place beside
  a crowd), the search goes down the pyramid instead: per position, buckets
  that cannot hold a neighbour by their own and the others' counts are passed
  over level by level, and only those left are joined with points.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from somagrid.operators.reshape import first_by
from somagrid.session import cut, spread

AXES = ["z", "y", "x"]
BUCKET = ["_bz", "_by", "_bx"]
#: Edge of a block in buckets of its scale, how many points and rows that look for them a task takes, pairs compared at a time.
BLOCK = 8
POINTS = 1 << 20
ROWS = 1 << 18
PAIRS = 1 << 21
#: How many buckets may take part in all levels at once.
BUCKETS = 1 << 17


def _all(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts)


def _rows_near(q: np.ndarray, p: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, starts, ends): nine ranges per query that hold all points of its 27 buckets."""
    low = np.minimum(q.min(axis=0), p.min(axis=0))
    bq, bp = (np.floor((v - low) / edge).astype(np.int64) + 1 for v in (q, p))
    wide = np.maximum(bq.max(axis=0), bp.max(axis=0)) + 2
    code = (bp[:, 0] * wide[1] + bp[:, 1]) * wide[2] + bp[:, 2]
    order = np.argsort(code, kind="stable")
    code = code[order]
    rows = [((bq[:, 0] + dz) * wide[1] + bq[:, 1] + dy) * wide[2] + bq[:, 2] for dz in (-1, 0, 1) for dy in (-1, 0, 1)]
    return order, np.stack([np.searchsorted(code, r - 1) for r in rows], axis=1), np.stack([np.searchsorted(code, r + 1, side="right") for r in rows], axis=1)


def _closest(q: np.ndarray, p: np.ndarray, rank: np.ndarray, need: int, edge: float, sure: bool, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance), the ``need`` nearest of each query in order of (distance, rank).

    Every query has its last neighbour within ``2 * edge``, unless ``sure`` says that all points are at hand anyway.
    With ``digits`` squared distances are rounded, so that those which differ by less are ties."""
    todo, found = np.arange(len(q)), []
    for e in (edge / 2, 0.75 * edge, edge, 2 * edge):
        last = e == 2 * edge
        order, start, end = _rows_near(q[todo], p, e * (1 + 1e-9))
        many = (end - start).sum(axis=1)
        bounds = np.r_[0, np.cumsum(many)]
        left, i = [], 0
        while i < len(todo):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PAIRS, side="right")) - 1)
            width = (end[i:j] - start[i:j]).ravel()
            at = np.arange(width.sum()) - np.repeat(np.r_[0, np.cumsum(width)[:-1]], width) + np.repeat(start[i:j].ravel(), width)
            a, b = np.repeat(todo[i:j], many[i:j]), order[at]
            d = q[a] - p[b]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            near = d2 <= e * e
            if digits is not None:
                d2 = np.round(d2, digits)
                near = near if last else d2 <= e * e  # ties are within reach together
            if not (last and sure):
                a, b, d2 = a[near], b[near], d2[near]
            o = np.lexsort((rank[b], d2, a))
            a, b, d2 = a[o], b[o], d2[o]
            first = np.searchsorted(a, todo[i:j])
            count = np.searchsorted(a, todo[i:j], side="right") - first
            done = (count >= need) | last
            place = np.arange(len(a)) - np.repeat(first, count)
            ok = (place < need) & np.repeat(done, count)
            found.append((a[ok], b[ok], d2[ok]))
            left.append(todo[i:j][~done])
            i = j
        todo = np.concatenate(left) if left else todo[:0]
        if not len(todo):
            break
    a, b, d2 = (np.concatenate([f[k] for f in found]) for k in range(3))
    o = np.argsort(a, kind="stable")
    return a[o], b[o], d2[o]


def _box(edge: Column, low: dict) -> tuple[Column, Column]:
    """Least and largest squared distance from a position to a bucket of the given edge."""
    near, far = [], []
    for a, b in zip(AXES, BUCKET):
        lo = F.col(b) * edge + low[a]
        hi = lo + edge
        n = F.greatest(F.lit(0.0), lo - F.col(a), F.col(a) - hi)
        f = F.greatest(F.abs(F.col(a) - lo), F.abs(hi - F.col(a)))
        near.append(n * n)
        far.append(f * f)
    return functools.reduce(operator.add, near), functools.reduce(operator.add, far)


def _descend(q: DataFrame, pyramid: DataFrame, pts: DataFrame, need: int, base: float, low: dict, by: list[str], keep: list[str]) -> DataFrame:
    """``by, z, y, x, cands`` of positions with a column ``_level``, by going down the pyramid from there."""
    at, place = [*by, *AXES], [F.floor((F.col(a) - low[a]) / base).alias(b) for a, b in zip(AXES, BUCKET)]
    top = q.agg(F.max("_level")).first()[0]
    front = None
    for level in range(top, -1, -1):
        here = pyramid.filter(F.col("_level") == level).drop("_level")
        edge = base * 2.0**level
        new = q.filter(F.col("_level") == level).select(*at, *place)
        ring = new
        for b in BUCKET:
            own = F.shiftright(F.col(b), level)
            ring = ring.withColumn(b, F.explode(F.sequence(own - 2, own + 2)))
        cand = spread(ring).join(here, [*by, *BUCKET]).select(*at, *BUCKET, "_n")
        if front is not None:
            kids = here.select("*", *[F.shiftright(F.col(b), 1).alias(f"_p{b}") for b in BUCKET])
            up = front.select(*at, *[F.col(b).alias(f"_p{b}") for b in BUCKET])
            cand = cand.union(spread(up).join(kids, [*by, *[f"_p{b}" for b in BUCKET]]).select(*at, *BUCKET, "_n"))
        near, far = _box(F.lit(edge), low)
        cand = cand.withColumn("_near", near).withColumn("_far", far)
        # the last neighbour is no further than the far corner of the bucket that brings the count up to what is needed
        upto = W.partitionBy(*at).orderBy("_far").rangeBetween(W.unboundedPreceding, 0)
        reach = F.min(F.when(F.col("_upto") >= need, F.col("_far"))).over(W.partitionBy(*at))
        cand = cand.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_reach", reach)
        front = cut(cand.filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") * (1 + 1e-9))).select(*at, *BUCKET))
    p = pts.select(*[F.col(c).alias(f"_q{c}") for c in AXES], *by, "_pid", *keep, *place)
    pairs = front.join(p, [*by, *BUCKET])
    d = [(F.col(a) - F.col(f"_q{a}")).cast("double") for a in AXES]
    pairs = pairs.select(*at, F.struct(functools.reduce(operator.add, [x * x for x in d]).alias("d2"), F.col("_pid").alias("pid"), *keep).alias("c"))
    return first_by(pairs, at, [F.col("c.d2"), F.col("c.pid")], need).groupBy(*at).agg(F.sort_array(F.collect_list("c")).alias("cands"))


def candidates(q: DataFrame, p: DataFrame, need: int, edge: float, by: list[str], keep: list[str], limit: int = POINTS, many: int = BUCKETS) -> DataFrame:
    """``by, _qid, cands`` for each row of ``q`` (``by, z, y, x, _qid``; without ids ``by, z, y, x, cands``): the ``need`` nearest rows of ``p`` (``_pid`` and ``keep``), ties to the smaller id.

    Rows go to the blocks with their ids, so what is found there is not moved again; a position is looked up once in a task, and
    blocks of more than ``ROWS`` rows are shared out.  More than ``many`` buckets are counted and looked up level by level, fewer
    on all levels at once."""
    at = [*by, *AXES]
    pts, ids = cut(first_by(p, at, ["_pid"], need)), [c for c in q.columns if c == "_qid"]
    base = 2.0 * edge
    ends = pts.select(*AXES).unionByName(q.select(*AXES)).agg(*[f(c).alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = {a: float(ends[f"lo{a}"] or 0) for a in AXES}
    span = max(float(ends[f"hi{a}"] or 0) - low[a] for a in AXES) + base
    top = max(0, math.ceil(math.log2(span / base))) + 1
    place = [F.floor((F.col(a) - low[a]) / base).alias(b) for a, b in zip(AXES, BUCKET)]

    fine = cut(pts.select(*by, *place).groupBy(*by, *BUCKET).agg(F.count(F.lit(1)).alias("_n")))
    # blocks of the highest level are looked up too; while a level has many buckets, it alone makes the next one
    raised = lambda df, level: spread(df.withColumn("_level", F.explode(F.sequence(F.lit(level), F.lit(top + 3))))).withColumns(
        {b: F.expr(f"shiftright({b}, _level - {level})") for b in BUCKET})
    parts, level = [], 0
    while level < top + 3 and fine.count() > many:
        parts.append(fine.withColumn("_level", F.lit(level)))
        level += 1
        fine = cut(fine.select(*by, *[F.shiftright(F.col(b), 1).alias(b) for b in BUCKET], "_n").groupBy(*by, *BUCKET).agg(F.sum("_n").alias("_n")))
    parts.append(cut(raised(fine, level).groupBy("_level", *by, *BUCKET).agg(F.sum("_n").alias("_n"))))
    pyramid = functools.reduce(DataFrame.unionByName, parts)
    spots = q.select(*at, *ids, *place)
    own = cut(spots.groupBy(*by, *BUCKET).agg(F.count(F.lit(1)).alias("_rows")))
    here, enough = [*by, *BUCKET], pyramid.filter(F.col("_n") >= need)
    first = lambda b: F.col(f"_o{b}").alias(b)
    rest, found, level = own.select(*here, *[F.col(b).alias(f"_o{b}") for b in BUCKET]), [], 0
    while level < top + 3 and rest.count() > many:
        held = enough.filter(F.col("_level") == level).select(*here, F.lit(True).alias("_held"))
        seen = cut(rest.join(held, here, "left"))
        found.append(seen.filter("_held").select(*by, *map(first, BUCKET), F.lit(level).alias("_level")))
        rest = seen.filter("_held IS NULL").select(*by, *[F.shiftright(F.col(b), 1).alias(b) for b in BUCKET], *[f"_o{b}" for b in BUCKET])
        level += 1
    last = raised(rest, level).join(enough, ["_level", *here]).groupBy(*by, *[f"_o{b}" for b in BUCKET]).agg(F.min("_level").alias("_level"))
    ready = functools.reduce(DataFrame.unionByName, [*found, last.select(*by, *map(first, BUCKET), "_level")])
    scaled = own.join(ready, [*by, *BUCKET], "left").withColumn("_level", F.least(F.coalesce("_level", F.lit(top)), F.lit(top)))

    # blocks of BLOCK buckets, and the points that they and their halo may hold
    deep = int(math.log2(BLOCK))
    block = [F.expr(f"shiftright({b}, _level + {deep})").alias(f"_k{b[2]}") for b in BUCKET]
    keys = ["_level", *by, *[f"_k{b[2]}" for b in BUCKET]]
    blocks = scaled.select("_level", *by, *block, "_rows").groupBy(*keys).agg(F.ceil(F.sum("_rows") / ROWS).alias("_parts"))
    around = blocks
    for b in BUCKET:
        around = around.withColumn(b, F.explode(F.sequence(F.col(f"_k{b[2]}") - 1, F.col(f"_k{b[2]}") + 1)))
    coarse = pyramid.select((F.col("_level") - deep).alias("_level"), *by, *BUCKET, "_n")
    held = cut(spread(around).join(coarse, ["_level", *by, *BUCKET]).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.first("_parts").alias("_parts")))
    placed = spots.join(scaled, [*by, *BUCKET]).select(*at, *ids, "_level", *block).join(held, keys)

    used = sorted(r[0] for r in held.select("_level").distinct().collect())  # at most one per doubling of the extent
    wide = F.lit(base * BLOCK) * F.pow(F.lit(2.0), F.col("_level"))
    halo = F.lit(2.0 * base) * F.pow(F.lit(2.0), F.col("_level"))
    dealt = pts.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in used]))) if used else pts.withColumn("_level", F.lit(0))
    for a in AXES:
        p0 = F.col(a) - low[a]
        dealt = dealt.withColumn(f"_k{a}", F.explode(F.sequence(F.floor((p0 - halo) / wide), F.floor((p0 + halo) / wide))))
    # only the list of blocks can be sent to all tasks here, if it is short; copies of points are shuffled once they are known to be wanted
    dealt = dealt.join(held.filter(F.col("_n") <= limit).select(*keys), keys, "left_semi")
    tasks, rows = keys, placed.filter(F.col("_n") <= limit)
    crowd = held.filter((F.col("_n") <= limit) & (F.col("_parts") > 1)).select(*keys, "_parts")
    if not crowd.isEmpty():
        tasks, rows = [*keys, "_part"], rows.withColumn("_part", F.pmod(F.xxhash64(*AXES, *ids), F.col("_parts")))
        each = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1)
        dealt = spread(dealt.join(crowd, keys, "left").withColumn("_part", F.explode(each)))

    kind = {f.name: f.dataType.simpleString() for f in pts.schema.fields}
    struct = ", ".join(f"{c}:{kind[k]}" for c, k in [("pid", "_pid"), *[(c, c) for c in keep]])
    front = [*by, *(ids or AXES)]
    schema = ", ".join(f"{a} {dict(q.dtypes)[a]}" for a in front) + f", cands array<struct<d2:double, {struct}>>"
    none = to_arrow_schema(T._parse_datatype_string(schema)).empty_table()  # a part of a block may be left without rows

    def run(key, queries: pa.Table, points: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return none
        queries = queries.combine_chunks()
        level = key[0].as_py()
        xyz = lambda t: np.stack([t.column(c).to_numpy().astype(float) for c in AXES], axis=1)
        every = xyz(queries)
        order = np.lexsort(every.T)
        new = np.r_[True, (every[order][1:] != every[order][:-1]).any(axis=1)]
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        spot = every[order][new]
        a, b, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if points.num_rows:
            rank = np.empty(points.num_rows, np.int64)
            rank[pc.sort_indices(points.column("_pid")).to_numpy()] = np.arange(points.num_rows)
            a, b, d2 = _closest(spot, xyz(points), rank, need, base * 2.0**level, level == top)
        parts = [pa.array(d2), *[points.column(c).take(pa.array(b)).combine_chunks() for c in ("_pid", *keep)]]
        parts = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in parts]
        offsets = np.searchsorted(a, np.arange(len(spot) + 1)).astype(np.int32)
        cands = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["d2", "pid", *keep]))
        return pa.table({**{c: queries.column(c) for c in front}, "cands": cands.take(pa.array(place))})

    light = rows.select(*tasks, *AXES, *ids).groupBy(*tasks).cogroup(dealt.select(*tasks, *AXES, "_pid", *keep).groupBy(*tasks)).applyInArrow(run, schema)
    if held.filter(F.col("_n") > limit).isEmpty():
        return light
    heavy = cut(placed.filter(F.col("_n") > limit).select(*at, *ids, "_level"))
    deeper = _descend(cut(heavy.select(*at, "_level").distinct()), pyramid, pts, need, base, low, by, keep)
    return light.unionByName(heavy.join(deeper, at).select(light.columns))


def knn(q: DataFrame, p: DataFrame, k: int, qid: str, pid: str, edge: float = 2.0, keep: list[str] = (), by: list[str] = (), limit: int = POINTS) -> DataFrame:
    """The ``k`` nearest points of each query point, itself left out by id.

    Gives ``qid, rank, pid, distance`` and the ``keep`` columns of the point; ties go to the smaller id.  With ``by`` (a
    brain, say) only points of the same values are neighbours, and these columns are given too.  Each position keeps its
    first ``k + 1`` ids, which is exact.  ``edge`` is where bucket edges start, ``limit`` how many points one task takes;
    neither changes the result.  Rows without a position or a ``by`` value have no neighbours."""
    by, keep = list(by), list(keep)
    given = _all([F.col(c).isNotNull() for c in [*by, *AXES]])
    pts = p.filter(given).select(*by, *AXES, F.col(pid).alias("_pid"), *keep)
    spots = q.filter(given).select(*by, *AXES, F.col(qid).alias("_qid"))
    cands = candidates(spots, pts, k + 1, edge, by, keep, limit)
    j = cands.select(F.col("_qid").alias(qid), *by, F.slice(F.filter("cands", lambda c: c["pid"] != F.col("_qid")), 1, k).alias("_c"))
    return j.select(qid, *by, F.posexplode("_c").alias("rank", "_n")).select(
        qid, *by, (F.col("rank") + 1).alias("rank"), F.col("_n.pid").alias(pid if pid != qid else f"{pid}_near"),
        F.sqrt("_n.d2").alias("distance"), *[F.col(f"_n.{c}").alias(c) for c in keep],
    )
