"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Spans come from patterns (kinds, in their listed order: assign, access, hex).
Each match's value is hashed and counted over the corpus by distinct
repositories and owners: a value that many owners hold is an example that was
copied around, one of a single owner looks live.  The method adds spans of
three kinds: ``live``, a value of one holder, looked up among bare tokens of all
texts as well, so the same credential without its keyword is found; ``shared``,
a value of more holders that is not widely copied; and ``example`` for widely
copied values of such tokens.  The holders of a value are the smaller of its two
counts, so many owners in one repository or many repositories of one owner make
no example.  :func:`report` lists ``live`` and ``example`` only, as its SQL twin
does; :func:`redact` replaces ``shared`` values like ``live`` ones.

Positions count code points, ends are exclusive.  Null text counts as empty.
Rows are told apart by a row key, so repeated rows and ids keep their own
results.  Null repositories or owners count as one unknown owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns of the three base kinds (kind, pattern, group of the value, least length of it).
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: A cheap test that every text with a kept match passes.
HINTS = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: A bare token that may be a credential on its own.
BARE = r"[A-Za-z0-9+/_=-]{20,}"
LIVE_OWNERS = 1
WIDE_OWNERS = 3


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, hint: str) -> Column:
    """Array of (kind, start, end, value) of a pattern's kept matches.

    What lies between the matches comes from ``split``, so positions are running sums of lengths."""
    found = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    value = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    step = F.zip_with(F.zip_with(between, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), value,
                      lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), v.alias("v")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    walked = F.aggregate(
        F.filter(step, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["m"])).alias("end"), x["v"].alias("value")))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(found.isNotNull() & (F.size(found) > 0), walked).otherwise(empty)


def candidates(docs: DataFrame, text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """All columns a later step needs per row with a hint of a secret: ``_row``, spans by kind, bare tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = docs.select("_row", text.alias("_t"), own(repo_col).alias("_repo"), own(owner_col).alias("_owner")).filter(F.col("_t").rlike(BARE) | F.col("_t").rlike(HINTS["assign"]))
    base = base.select("*", *[_spans(F.col("_t"), k, p, g, n, HINTS[k]).alias(f"_{k}") for k, p, g, n in KINDS])
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return base.withColumn("_bare", F.filter(_spans(F.col("_t"), "bare", BARE, 0, 20, BARE), lambda x: mixed(x["value"]))).drop("_t")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners): in how many distinct repositories and owners each candidate value occurs.

    Distinct (value, repository, owner) rows are formed before they meet, so a value in a third of all texts is a few rows."""
    values = F.array_distinct(F.transform(F.concat("_assign", "_access", "_hex", "_bare"), lambda x: F.xxhash64(F.lower(x["value"]))))
    rows = found.select("_repo", "_owner", F.explode(values).alias("hash")).distinct()
    repos = rows.select("hash", "_repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    owners = rows.select("hash", "_owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    return repos.join(owners, "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """(_row, id, base, added) of every row of ``docs``; the arrays hold (kind, start, end, value), ordered by start.

    ``docs`` needs a column ``_row`` that names each row (see :func:`with_rows`)."""
    found = candidates(docs, text_col, repo_col, owner_col)
    own = ownership(found)
    spans = found.select("_row", F.explode(F.concat(
        F.transform("_assign", lambda x: F.struct(x.alias("s"), F.lit(0).alias("order"))), F.transform("_access", lambda x: F.struct(x.alias("s"), F.lit(1).alias("order"))),
        F.transform("_hex", lambda x: F.struct(x.alias("s"), F.lit(2).alias("order"))), F.transform("_bare", lambda x: F.struct(x.alias("s"), F.lit(3).alias("order"))))).alias("x"))
    spans = spans.select("_row", "x.s.*", "x.order", F.xxhash64(F.lower("x.s.value")).alias("hash")).join(own, "hash", "left")
    holders = F.least("owners", "repositories")
    # a bare token becomes a live, a shared or an example span; a keyword's or a pattern's own span is repeated under the verdict of its value
    verdict = F.when(holders <= LIVE_OWNERS, "live").when(holders >= WIDE_OWNERS, "example").otherwise("shared")
    item = lambda kind, order: F.struct(F.col("start"), order.alias("order"), F.col("end"), kind.alias("kind"), F.col("value"), holders.alias("holders"))
    per_row = spans.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(F.col("order") < 3, item(F.col("kind"), F.col("order"))))).alias("base"),
        F.sort_array(F.array_distinct(F.collect_list(item(verdict, F.lit(3))))).alias("added"))
    none = "array<struct<start:int,order:int,end:int,kind:string,value:string,holders:bigint>>"
    return docs.select("_row", F.col(id_col).alias("id")).join(per_row, "_row", "left").select(
        "_row", "id", F.coalesce("base", F.array().cast(none)).alias("base"), F.coalesce("added", F.array().cast(none)).alias("added"))


def with_rows(docs: DataFrame) -> DataFrame:
    """Add ``_row``: the place of a row in its file, the same whenever the file is read."""
    return docs.withColumn("_row", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans but the shared ones as text."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.sort_array(F.concat("base", F.filter("added", lambda x: x["kind"] != "shared")))
    return scanned.select(
        "id", *[count(k) for k, *_ in KINDS], F.sha2(F.array_join(F.transform("base", name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, name), ",").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """``docs`` with every value that is not a widely copied example replaced by ``mark``; needs ``_row``.

    Only texts with a hint of a secret meet the verdicts; the others pass as they are."""
    owned = scan(docs, id_col, text_col, repo_col, owner_col).select(
        "_row", F.array_distinct(F.transform(F.filter(F.concat("base", "added"), lambda x: x["holders"] < WIDE_OWNERS), lambda x: x["value"])).alias("_v"))
    longest = F.array_sort("_v", lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(longest, F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mark)))
    hinted = F.coalesce(F.col(text_col).rlike(BARE) | F.col(text_col).rlike(HINTS["assign"]), F.lit(False))
    cleaned = docs.filter(hinted).join(owned.filter(F.size("_v") > 0), "_row", "left").withColumn(
        text_col, F.when(F.col("_v").isNotNull(), clean).otherwise(F.col(text_col))).select(*docs.columns)
    return docs.filter(~hinted).union(cleaned)
