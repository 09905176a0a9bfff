"""Region tables of all brains to one pooled table for group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from somagrid.operators.regions import region_density, with_brain
from somagrid.operators.tree import apply_exclusions, in_subtree, rollup_tree
from somagrid.plans.brain import COUNTS, VOLUMES


def pooled_regions(regions: DataFrame, onto: DataFrame, brains: DataFrame, extra=(), drop: list[str] = (), levels=None) -> DataFrame:
    """Exclusions, always-dropped subtrees, roll-up, densities, brain columns."""
    d = apply_exclusions(regions, onto, brains, list(extra))
    if drop:
        d = in_subtree(d, onto, list(drop), "drop")
    if levels is None:
        levels = sorted((r[0] for r in onto.select("st_level").distinct().collect()), reverse=True)
    d = rollup_tree(d, COUNTS + VOLUMES, levels=levels)
    return with_brain(region_density(d), brains)


def density_by_group(pooled: DataFrame, level: int, by: str = "exp") -> DataFrame:
    """Mean density per region and group at one level of the tree."""
    return pooled.filter(F.col("st_level") == level).groupBy("ids", "acronym", by).agg(
        F.avg("density_w").alias("density_w"), F.avg("density_large_w").alias("density_large_w"), F.count(F.lit(1)).alias("n_brains")
    )
