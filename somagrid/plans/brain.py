"""Detections of many brains to one table of region counts and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from somagrid.operators.regions import label_cells, region_counts, region_volume

COUNTS = ["num_l", "num_r", "num_w", "large_l", "large_r", "large_w"]
VOLUMES = ["vol_l", "vol_r", "vol_w"]


def brain_tables(cells: DataFrame, atlas: DataFrame, onto: DataFrame, brains: DataFrame, min_size: int = 30, large: int = 500,
                 res: float = 20.0, by=()) -> DataFrame:
    """(dataset, region) table, with one atlas for all brains or, by ``["dataset"]``, one for each: the size filter reaches the scan, one voxel join,
    one aggregate, then only region-sized tables."""
    small = cells.select("dataset", "z", "y", "x", "vols").filter(f"vols > {min_size}")
    counts = region_counts(label_cells(small, atlas, by=by), onto, brains, min_size, large)
    return counts.join(region_volume(atlas, res, by=by), [*by, "ids"], "left")
