"""Cells to regions: lookup, counts, volumes, densities, metadata joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from somagrid.session import spread

VOXEL = ["z", "y", "x"]
#: Length of the pieces that lines of voxels are cut into.
SPAN = 32


def label_cells(cells: DataFrame, atlas: DataFrame, cols=("label", "hemisphere"), by=()) -> DataFrame:
    """Region label of each cell by voxel; cells outside get NULL.

    With ``by`` (``["dataset"]``) the atlas holds one volume per brain, each in
    its own space, and a cell meets only that of its brain.  Both sides are keyed by voxel; an atlas under the broadcast threshold is
    broadcast by Spark itself, a larger one is hash-partitioned (or bucketed
    by the caller).  Many volumes are packed to runs of equal voxels before they move.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not by or any(dict(t.dtypes)[a] not in whole for t in (cells, atlas) for a in VOXEL):
        return cells.join(atlas.select(*by, *VOXEL, *cols), [*by, *VOXEL], "left")
    runs = packed(atlas, cols, by)
    keys = [*by, "z", "y", "_span"]
    c, r = cells.withColumn("_span", F.floor(F.col("x") / SPAN)).alias("c"), runs.alias("r")
    on = [F.col(f"c.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("c.x").between(F.col("r._from"), F.col("r._to"))]
    rest = [n for n in cells.columns if n not in (*by, *VOXEL)]
    return c.join(r, on, "left").select(*[F.col(f"c.`{n}`") for n in (*by, *VOXEL, *rest)], *[F.col(f"r.`{n}`") for n in cols])


def packed(atlas: DataFrame, cols=("label", "hemisphere"), by=()) -> DataFrame:
    """Voxels as runs along x: ``by, z, y, _span, _from, _to`` and ``cols``.

    Voxels that follow each other in a line of one volume with equal values are one row, within a batch of rows and a
    ``_span`` of ``SPAN`` voxels; a voxel that has no such neighbour at hand is a run of its own, so any order of the rows
    is right, and a line of a span holds at most one run per voxel.
    """
    by, cols = list(by), list(cols)
    voxels = atlas.select(*by, *VOXEL, *cols).dropna(subset=[*by, *VOXEL]).select(*by, "z", "y", F.floor(F.col("x") / SPAN).alias("_span"), F.col("x").alias("_from"), *cols)
    same = [*by, "z", "y", "_span", *cols]
    order = [(c, "ascending") for c in (*by, "z", "y", "_from")]

    def starts(t: pa.Table) -> np.ndarray:
        """Which rows begin a run."""
        new = np.ones(t.num_rows, bool)
        x = t.column("_from").to_numpy()
        new[1:] = x[1:] != x[:-1] + 1
        for c in same:
            codes = t.column(c).combine_chunks()
            if not pa.types.is_integer(codes.type) or codes.null_count:
                codes = codes.dictionary_encode(null_encoding="encode").indices
            codes = codes.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def pack(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            new = starts(t)
            if 2 * new.sum() > t.num_rows:  # not in order of position
                t = t.sort_by(order)
                new = starts(t)
            first = np.nonzero(new)[0]
            last = np.r_[first[1:], t.num_rows] - 1
            runs = t.take(pa.array(first)).append_column("_to", t.column("_from").take(pa.array(last)))
            yield from runs.combine_chunks().to_batches()

    kind = dict(voxels.dtypes)
    return spread(voxels.mapInArrow(pack, ", ".join(f"{c} {kind[c]}" for c in voxels.columns) + f", _to {kind['_from']}"))


def region_counts(labelled: DataFrame, onto: DataFrame, brains: DataFrame, min_size: int = 30, large: int = 500) -> DataFrame:
    """Cells per brain, region and side, zero where there are none."""
    big = F.col("vols") > large
    left, right = F.col("hemisphere") == 1, F.col("hemisphere") == 2
    c = lambda cond: F.count_if(cond)
    n = (
        labelled.filter((F.col("vols") > min_size) & (F.col("label") > 0)).groupBy("dataset", F.col("label").alias("ids"))
        .agg(
            c(left).alias("num_l"), c(right).alias("num_r"), F.count(F.lit(1)).alias("num_w"),
            c(left & big).alias("large_l"), c(right & big).alias("large_r"), c(big).alias("large_w"),
        )
    )
    # every region of the tree for every brain of the metadata list
    names = brains.agg(F.sort_array(F.collect_set("dataset"))).scalar()
    grid = onto.withColumn("dataset", F.explode(names))
    counts = [x for x in n.columns if x not in ("dataset", "ids")]
    return grid.join(n, ["dataset", "ids"], "left").fillna(0, subset=counts)


def region_volume(atlas: DataFrame, res: float = 20.0, counted: bool = False, by=()) -> DataFrame:
    """mm3 per label at ``res`` micrometres: the whole, and half of it for each side;
    per brain with ``by``.

    With ``counted`` the sides are the voxels of each hemisphere instead, NULL
    where a side has none.
    """
    mm3 = F.lit(res**3)
    n = atlas.filter("label > 0").groupBy(*by, F.col("label").alias("ids")).agg(
        F.count(F.lit(1)).alias("_w"), *[F.count_if(F.col("hemisphere") == i).alias(f"_{s}") for i, s in ((1, "l"), (2, "r"))])
    whole = F.col("_w") * mm3 * 1e-9
    side = lambda s: F.nullif(F.col(f"_{s}"), F.lit(0)) * mm3 * 1e-9 if counted else whole / 2
    return n.select(*by, "ids", whole.alias("vol_w"), side("l").alias("vol_l"), side("r").alias("vol_r"))


def region_density(df: DataFrame, side: Column | None = None) -> DataFrame:
    """Cells per mm3 by side; a brain with a fixed ``side`` takes the whole from it."""
    d = lambda n, v: F.try_divide(F.col(n).cast("double"), F.col(v))
    out = (
        df.withColumn("density_l", d("num_l", "vol_l")).withColumn("density_r", d("num_r", "vol_r"))
        .withColumn("density_w", d("num_w", "vol_w")).withColumn("density_large_w", d("large_w", "vol_w"))
    )
    if side is None:
        return out
    pick = lambda kind: (
        F.when(side == "L", d(f"{kind}_l", "vol_l")).when(side == "R", d(f"{kind}_r", "vol_r")).otherwise(d(f"{kind}_w", "vol_w"))
    )
    return out.withColumn("density_w", pick("num")).withColumn("density_large_w", pick("large"))


def with_brain(df: DataFrame, brains: DataFrame, cols=("exp", "sex", "age")) -> DataFrame:
    return df.join(brains.select("dataset", *cols), "dataset")


def select_brains(brains: DataFrame, nums: list) -> DataFrame:
    """Brains by number in list order; the first record of a number wins."""
    from somagrid.operators.reshape import first_by

    want = brains.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(n).cast(brains.schema["num"].dataType) for n in nums])).alias("pos", "num"))
    return first_by(brains, ["num"], ["dataset"]).join(want, "num").orderBy("pos")


def merge_stats(onto: DataFrame, stats: DataFrame, on: str = "ids") -> DataFrame:
    return onto.join(stats, on, "left")


def tag_location(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """GM where the masked atlas has a label at the cell, WM elsewhere."""
    hit = mask.filter("label > 0").select(*VOXEL, F.lit(True).alias("_gm")).dropDuplicates(VOXEL)
    return cells.join(hit, VOXEL, "left").withColumn("location", F.when(F.col("_gm"), "GM").otherwise("WM")).drop("_gm")


def overlay_atlas(base: DataFrame, alt: DataFrame, ids: DataFrame) -> DataFrame:
    """Labels of the listed ids come from ``alt``, every other voxel from ``base``.

    Voxels of ``base`` inside the list are cleared first, as the second atlas
    replaces them.
    """
    listed = ids.select(F.col("ids").alias("label")).distinct()
    keep = base.join(listed, "label", "left_anti").select(*VOXEL, F.col("label").alias("_b"))
    new = alt.join(listed, "label", "left_semi").select(*VOXEL, F.col("label").alias("_a"))
    return keep.join(new, VOXEL, "full_outer").select(*VOXEL, F.coalesce("_a", "_b").alias("label"))


def overlay_field(field: DataFrame, alt_field: DataFrame, alt: DataFrame, ids: DataFrame, cols=("d0", "d1", "d2")) -> DataFrame:
    """Deformation field of a composite atlas: where :func:`overlay_atlas` takes its
    labels from ``alt``, the values come from that atlas' field, elsewhere they stay.

    A value the second field does not have leaves the first one's."""
    listed = ids.select(F.col("ids").alias("label")).distinct()
    spots = spread(alt.join(listed, "label", "left_semi").select(*VOXEL).distinct())  # an atlas is larger than Spark's estimate of it
    new = alt_field.join(spots, VOXEL, "left_semi").select(*VOXEL, *[F.col(c).alias(f"_{c}") for c in cols])
    return field.select(*VOXEL, *cols).join(new, VOXEL, "full_outer").select(*VOXEL, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def label_stats(voxels: DataFrame, atlas: DataFrame, value: str = "value", floor: float | None = None) -> DataFrame:
    """Null-aware mean and sum of intensity per label, label 0 left out."""
    v = F.col(value) if floor is None else F.when(F.col(value) >= floor, F.col(value))
    return (
        voxels.join(atlas.filter("label > 0").select(*VOXEL, "label"), VOXEL)
        .groupBy("label").agg(F.avg(v).alias("mean"), F.sum(v).alias("total"), F.count(v).alias("n"))
    )


def paint_density(cells: DataFrame, atlas: DataFrame, voxel_mm3: float = 8e-6) -> DataFrame:
    """Each labelled voxel gets the cell density of its region."""
    lab = atlas.filter("label > 0").select(*VOXEL, "label")
    n = cells.join(lab, VOXEL).groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    size = lab.groupBy("label").agg(F.count(F.lit(1)).alias("_v"))
    dens = size.join(n, "label", "left").select(
        "label", (F.coalesce("_n", F.lit(0)) / (F.col("_v") * F.lit(voxel_mm3))).alias("density")
    )
    return lab.join(dens, "label").select(*VOXEL, "label", "density")
