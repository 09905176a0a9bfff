"""Block and tile grids over a volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from somagrid.session import spread

AXES = ["z", "y", "x"]


def block_grid(spark: SparkSession, shape: dict, size: dict) -> DataFrame:
    """Blocks of a fixed size, cut at the far edge; numbered in z, y, x order."""
    counts = {a: -(-shape[a] // size[a]) for a in AXES}
    d = spark.range(counts["z"] * counts["y"] * counts["x"]).withColumnRenamed("id", "block")
    index = {
        "z": F.expr(f"block div {counts['y'] * counts['x']}"), "y": F.expr(f"(block div {counts['x']}) % {counts['y']}"),
        "x": F.col("block") % counts["x"],
    }
    for a in AXES:
        d = d.withColumn(f"{a}0", index[a] * size[a]).withColumn(f"{a}1", F.least(F.col(f"{a}0") + size[a], F.lit(shape[a])))
    return d


def block_of(shape: dict, size: dict) -> Column:
    """Number of the block that holds a voxel."""
    n = {a: -(-shape[a] // size[a]) for a in AXES}
    i = {a: F.floor(F.col(a) / size[a]) for a in AXES}
    return (i["z"] * n["y"] + i["y"]) * n["x"] + i["x"]


def tile_starts(dim: int, size: int, overlap: int) -> Column:
    """Starts along one axis: a step of size minus overlap, the last tile pulled
    back to the edge, repeats removed."""
    step = size - overlap
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint"), F.lit(step).cast("bigint"))
    return F.array_distinct(F.transform(every, lambda s: F.greatest(F.lit(0), F.least(s, F.lit(dim - size)))))


def tile_grid(spark: SparkSession, shape: dict, size: dict, overlap: dict) -> DataFrame:
    """Overlapping tiles over a volume."""
    d = spark.range(1)
    for a in AXES:
        d = d.withColumn(f"{a}0", F.explode(tile_starts(shape[a], size[a], overlap[a])))
        d = d.withColumn(f"{a}1", F.least(F.col(f"{a}0") + size[a], F.lit(shape[a])))
    return d.drop("id")


def assign_tiles(df: DataFrame, shape: dict, size: dict, overlap: dict) -> DataFrame:
    """One row per voxel and tile that holds it, by arithmetic on the position: no
    range join and no tile list."""
    for a in AXES:
        n, s, step = shape[a], size[a], size[a] - overlap[a]
        last, back = (n - 1) // step, max(n - s, 0)
        lo = F.expr(f"greatest(0L, floor(({a} - {s}) / {step}) + 1)")
        hi = F.when(F.col(a) >= back, F.lit(last)).otherwise(F.floor(F.col(a) / step)).cast("bigint")
        starts = F.array_distinct(_starts(lo, hi, step, back))
        df = df.withColumn(f"{a}0", F.explode(_holding(starts, a, s)))
    return spread(df)


def _starts(lo: Column, hi: Column, step: int, back: int) -> Column:
    return F.transform(F.sequence(F.least(lo, hi), hi), lambda i: F.least(i * step, F.lit(back)))


def _holding(starts: Column, axis: str, size: int) -> Column:
    return F.filter(starts, lambda t: (t <= F.col(axis)) & (F.col(axis) < t + size))


def drop_blank(voxels: DataFrame, tile: list[str], value: str = "value", threshold: float = 300, need: int = 10_000) -> DataFrame:
    """Voxels of tiles with at least ``need`` values over the threshold."""
    n = voxels.groupBy(*tile).agg(F.count_if(F.col(value) > threshold).alias("_n")).filter(F.col("_n") >= need).drop("_n")
    return voxels.join(n, tile, "left_semi")
