"""Ordered work inside groups that may be very large.

A plain window puts a whole group into one task.  The helpers here split a
group along its order column first:

* integer order columns that are unique per group (frames, slices, positions)
  are cut into fixed-width bins, so a bin holds at most ``width`` rows;
* value columns are reduced to ``(group, value, n)`` first; that table is cut
  into sorted ranges, whose number follows its size, and small per-range totals
  carry the running counts over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from somagrid.session import cut, release

RANGE_ROWS = 1_000_000
FRAME_WIDTH = 262_144
ALL = "_all"


def _same(a: str, b: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def value_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, Column] | None = None,
    limit: int = RANGE_ROWS,
) -> DataFrame:
    """Distinct values per group with counts and running counts.

    Gives ``keys, value, n, before`` (rows with a smaller value), ``_bin`` and,
    for each entry of ``sums``, a further total per distinct value.  NULL values
    are left out, NULL keys are a group.  ``_bin`` rises with the value: it is the
    range partition of ``(keys, value)``, about ``limit`` rows long at most, and
    is written down so that no later evaluation can draw other bounds.
    """
    one = not keys
    if one:
        df, keys = df.withColumn(ALL, F.lit(0)), [ALL]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(e).alias(k) for k, e in (sums or {}).items()]
    tab = cut(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs))
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tab.count() // limit))
    binned = cut(tab.repartitionByRange(ranges, *keys, value).withColumn("_bin", F.spark_partition_id()))
    release(tab)
    w = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = binned.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
    wb = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    )
    out = (
        inside.alias("i").join(starts.alias("s"), _same("i", "s", [*keys, "_bin"]))
        .select("i.*", (F.col("_in") + F.col("_start")).alias("before")).drop("_in")
    )
    return out.drop(ALL) if one else out


def join_ranks(df: DataFrame, ranks: DataFrame, keys: list[str], value: str, out: list[str]) -> DataFrame:
    """Rows of ``df`` with the columns ``out`` of their ``(keys, value)``; NULL keys match."""
    on = _same("d", "r", keys) & (F.col(f"d.{value}") == F.col(f"r.{value}"))
    return df.alias("d").join(ranks.alias("r"), on).select("d.*", *[f"r.{c}" for c in out])


def suffix_min(ranked: DataFrame, keys: list[str], value: str, col: str, out: str) -> DataFrame:
    """Smallest ``col`` at this or any larger ``value`` of a :func:`value_ranks` table."""
    w = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(0, W.unboundedFollowing)
    inside = ranked.withColumn("_m", F.min(col).over(w))
    bins = ranked.groupBy(*keys, "_bin").agg(F.min(col).alias("_b"))
    if keys:
        wb = W.partitionBy(*keys).orderBy("_bin").rowsBetween(1, W.unboundedFollowing)
    else:  # one row per range
        wb = W.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(1, W.unboundedFollowing)
    later = bins.withColumn("_later", F.min("_b").over(wb)).drop("_b")
    return (
        inside.alias("i").join(later.alias("l"), _same("i", "l", [*keys, "_bin"]))
        .select("i.*", F.least(F.col("_m"), F.coalesce("_later", "_m")).alias(out)).drop("_m")
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank", limit: int = RANGE_ROWS) -> DataFrame:
    """Rows of ``df`` with the average rank of ``value`` in the group (ties share)."""
    r = value_ranks(df, keys, value, limit=limit)
    r = r.select(*keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return join_ranks(df, r, keys, value, [out])


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", limit: int = RANGE_ROWS) -> DataFrame:
    """Exact median per group by running counts."""
    r = value_ranks(df, keys, value, limit=limit)
    total = r.groupBy(*keys).agg(F.sum("n").alias("_t"))
    j = r.alias("r").join(total.alias("t"), _same("r", "t", keys)).select("r.*", "_t")
    lo, hi = F.expr("(_t - 1) div 2"), F.expr("_t div 2")
    inside = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
    weight = inside(lo).cast("int") + inside(hi).cast("int")
    return (
        j.withColumn("_w", weight).filter("_w > 0").groupBy(*keys)
        .agg((F.sum(F.col(value) * F.col("_w")) / 2.0).alias(out))
    )


def neighbour_row(
    df: DataFrame, keys: list[str], order: str, cols: list[str], step: int = 1, width: int = FRAME_WIDTH, prefix: str = "next_"
) -> DataFrame:
    """Add the columns of the next (``step=1``) or previous (``step=-1``) row of
    the group by an integer order column that is unique in it."""
    d = df.withColumn("_bin", F.floor(F.col(order) / width))
    row = F.struct(*[F.col(c) for c in cols], F.lit(True).alias("_here"))
    w = W.partitionBy(*keys, "_bin").orderBy(order)
    inside = F.lead(row).over(w) if step > 0 else F.lag(row).over(w)
    d = d.withColumn("_near", inside)
    edge = F.min_by(row, F.col(order)) if step > 0 else F.max_by(row, F.col(order))
    bins = df.withColumn("_bin", F.floor(F.col(order) / width)).groupBy(*keys, "_bin").agg(edge.alias("_edge"))
    wb = W.partitionBy(*keys).orderBy("_bin")
    over = F.lead("_edge").over(wb) if step > 0 else F.lag("_edge").over(wb)
    bins = bins.withColumn("_far", over).drop("_edge")
    j = d.alias("d").join(bins.alias("b"), _same("d", "b", [*keys, "_bin"]))
    near = F.coalesce(F.col("d._near"), F.col("b._far"))
    return j.select(*[f"d.{c}" for c in df.columns], *[near[c].alias(prefix + c) for c in cols])


def known_around(df: DataFrame, keys: list[str], order: str, value: str, limit: int = RANGE_ROWS) -> DataFrame:
    """Add the row number ``_i`` in the group and the nearest rows with a known ``value`` at or before (``_b``) and at or
    after (``_a``) each row, as structs of row number ``i`` and value ``v``; NULL where there is none.

    Rows are cut into sorted ranges of ``(keys, order, value)``, at most about ``limit`` rows each, numbered and carried inside
    the range; the count and the first and last known row of every range then carry over to the others.  Rows with the same
    order follow their value, missing ones first.  NULL keys are a group.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // limit))
    binned = cut(df.repartitionByRange(ranges, *keys, order, value).withColumn("_bin", F.spark_partition_id()))
    w = W.partitionBy(*keys, "_bin").orderBy(order, value)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    inside = binned.withColumn("_i", F.row_number().over(w).cast("long")).withColumn("_k", known)
    bins = inside.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    wb = W.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_bin")
    past, coming = wb.rowsBetween(W.unboundedPreceding, -1), wb.rowsBetween(1, W.unboundedFollowing)
    bins = bins.withColumn("_start", F.coalesce(F.sum("_n").over(past), F.lit(0).cast("long")))
    moved = lambda c, by: F.when(c.isNotNull(), F.struct((c["i"] + by).alias("i"), c["v"].alias("v")))
    for c in ("_first", "_last"):
        bins = bins.withColumn(c, moved(F.col(c), F.col("_start")))
    bins = bins.select(*keys, "_bin", "_start", F.last("_last", ignorenulls=True).over(past).alias("_past"),
                       F.first("_first", ignorenulls=True).over(coming).alias("_coming"))
    inside = inside.withColumn("_b", F.last("_k", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "_a", F.first("_k", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    j = inside.alias("d").join(bins.alias("b"), _same("d", "b", [*keys, "_bin"]))
    here = lambda c: moved(F.col(f"d.{c}"), F.col("b._start"))
    return j.select(*[f"d.{c}" for c in df.columns], (F.col("d._i") + F.col("b._start")).alias("_i"),
                    F.coalesce(here("_b"), F.col("b._past")).alias("_b"), F.coalesce(here("_a"), F.col("b._coming")).alias("_a"))
