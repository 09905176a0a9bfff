"""Queries on block and tile grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from somagrid.operators import reshape as X, tiles as T
from somagrid.registry import derived as D
from somagrid.registry.base import query
from somagrid.registry.volumes import NZ

SIZE, OVERLAP = {"z": 16, "y": 12, "x": 12}, {"z": 4, "y": 4, "x": 4}


def _starts(dim: str, size: int, overlap: int) -> str:
    return f"(SELECT DISTINCT greatest(0, least(s, {dim} - {size})) AS s FROM (SELECT unnest(range(0, {dim}, {size - overlap})) AS s))"


@query("block_grid", f"""
  SELECT b.block, b.z0, b.y0, b.x0, b.z1, b.y1, b.x1, count(v.z) AS n_voxels FROM (
    SELECT (zi * 3 + yi) * 2 + xi AS block, zi * 16 AS z0, yi * 12 AS y0, xi * 20 AS x0, least(zi * 16 + 16, {NZ}) AS z1, least(yi * 12 + 12, 32) AS y1,
           least(xi * 20 + 20, 32) AS x1 FROM (SELECT unnest(range(0, ({NZ} + 15) // 16)) AS zi), (SELECT unnest(range(3)) AS yi), (SELECT unnest(range(2)) AS xi)) b
  LEFT JOIN voxels v ON v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1 GROUP BY ALL""", "voxels")
def block_grid(spark, d):
    shape, size = D.shape(spark, d), {"z": 16, "y": 12, "x": 20}
    n = D.voxels(spark, d).groupBy(T.block_of(shape, size).alias("block")).agg(F.count(F.lit(1)).alias("n_voxels"))
    return T.block_grid(spark, shape, size).join(n, "block", "left").fillna(0, subset=["n_voxels"])


TILES = f"""t AS MATERIALIZED (SELECT a.s AS z0, b.s AS y0, c.s AS x0 FROM {_starts(NZ, 16, 4)} a, {_starts('32', 12, 4)} b, {_starts('32', 12, 4)} c),
   v AS MATERIALIZED (SELECT t.*, v.z, v.y, v.x, v.value FROM t JOIN voxels v ON v.z BETWEEN z0 AND z0 + 15 AND v.y BETWEEN y0 AND y0 + 11 AND v.x BETWEEN x0 AND x0 + 11)"""


@query("tile_grid", f"WITH {TILES} SELECT t.z0, t.y0, t.x0, least(t.z0 + 16, {NZ}) AS z1, t.y0 + 12 AS y1, t.x0 + 12 AS x1, count(v.z) AS n_voxels FROM t LEFT JOIN v USING (z0, y0, x0) GROUP BY ALL", "voxels")
def tile_grid(spark, d):
    shape = D.shape(spark, d)
    n = T.assign_tiles(D.voxels(spark, d), shape, SIZE, OVERLAP).groupBy("z0", "y0", "x0").agg(F.count(F.lit(1)).alias("n_voxels"))
    return T.tile_grid(spark, shape, SIZE, OVERLAP).join(n, ["z0", "y0", "x0"], "left").fillna(0, subset=["n_voxels"])


@query("tiles_of_voxels", f"WITH {TILES} SELECT z, y, x, z0, y0, x0 FROM v", "voxels")
def tiles_of_voxels(spark, d):
    return T.assign_tiles(D.voxels(spark, d), D.shape(spark, d), SIZE, OVERLAP).select("z", "y", "x", "z0", "y0", "x0")


@query("blank_tiles_dropped", f"""
  WITH {TILES}, k AS (SELECT z0, y0, x0 FROM v GROUP BY ALL HAVING count(*) FILTER (value > 50) >= 30)
  SELECT z0, y0, x0, count(*) AS n, round(sum(value), 6) AS total FROM v SEMI JOIN k USING (z0, y0, x0) GROUP BY ALL""", "voxels")
def blank_tiles_dropped(spark, d):
    v = T.assign_tiles(D.voxels(spark, d), D.shape(spark, d), SIZE, OVERLAP)
    keep = T.drop_blank(v, ["z0", "y0", "x0"], threshold=50, need=30)
    return keep.groupBy("z0", "y0", "x0").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("holdout_split")
def holdout_split(spark, d):
    s = X.split(D.table(spark, d, "labels"), "doc_id", 10, 7)
    return s.groupBy("holdout", "quality").agg(F.count(F.lit(1)).alias("n"))
