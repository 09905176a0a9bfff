"""Queries on voxel maps: morphology, projections, thresholds, smoothing, masks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from somagrid.functions import scalars as S
from somagrid.operators import tree as G, voxels as V
from somagrid.registry import derived as D
from somagrid.registry.base import query

NZ = "(SELECT max(p_partkey) // 8 + 1 FROM part)"
CUBE1 = "(SELECT unnest([-1, 0, 1]) AS dz), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)"


def reach(r: int) -> str:
    """Cross product of steps -r..r on three axes."""
    return ", ".join(f"(SELECT unnest(range({-r}, {r + 1})) AS d{a})" for a in "zyx")


def bright(spark, d, low=40):
    return D.voxels(spark, d).filter(F.col("value") > low)


BRIGHT = "bright AS MATERIALIZED (SELECT z, y, x, value FROM voxels WHERE value > 40)"
BALL2 = f"(SELECT * FROM {reach(2)} WHERE dz * dz + dy * dy + dx * dx <= 4)"


@query("dilate_ball", f"WITH {BRIGHT} SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM bright, {BALL2}", "voxels")
def dilate_ball(spark, d):
    return V.dilate(bright(spark, d), "ball", 2)


@query("dilate_disk_values", f"""
  WITH {BRIGHT} SELECT z, y + dy AS y, x + dx AS x, round(max(value), 6) AS value FROM bright, (SELECT * FROM {reach(2)} WHERE dz = 0 AND dy * dy + dx * dx <= 4)
  WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31 GROUP BY ALL""", "voxels")
def dilate_disk_values(spark, d):
    return V.dilate(bright(spark, d), "disk", 2, "value", D.shape(spark, d)).select("z", "y", "x", "value")


@query("dilate_cube", f"WITH {BRIGHT} SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM bright, {reach(1)}", "voxels")
def dilate_cube(spark, d):
    return V.dilate(bright(spark, d), "cube", 1)


def _grown(spark, d):
    return V.dilate(bright(spark, d, 60), "cube", 1, bounds=D.shape(spark, d))


GROWN = f"""grown AS MATERIALIZED (SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM voxels, {reach(1)} WHERE value > 60
  AND z + dz BETWEEN 0 AND {NZ} - 1 AND y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31)"""


@query("erode_ball", f"""
  WITH {GROWN} SELECT z, y, x FROM grown g WHERE NOT EXISTS (SELECT 1 FROM {reach(1)} WHERE dz * dz + dy * dy + dx * dx <= 1
    AND (g.z + dz, g.y + dy, g.x + dx) NOT IN (SELECT (z, y, x) FROM grown))""", "voxels")
def erode_ball(spark, d):
    return V.erode(_grown(spark, d), "ball", 1)


@query("erode_inside_bounds", f"""
  WITH {GROWN}, need AS (SELECT g.z, g.y, g.x, g.z + dz AS nz, g.y + dy AS ny, g.x + dx AS nx FROM grown g, {reach(1)}
     WHERE g.z + dz BETWEEN 0 AND {NZ} - 1 AND g.y + dy BETWEEN 0 AND 31 AND g.x + dx BETWEEN 0 AND 31)
  SELECT n.z, n.y, n.x FROM need n LEFT JOIN grown g ON g.z = nz AND g.y = ny AND g.x = nx GROUP BY n.z, n.y, n.x HAVING count(*) = count(g.z)""", "voxels")
def erode_inside_bounds(spark, d):
    return V.erode(_grown(spark, d), "cube", 1, D.shape(spark, d))


@query("label_boundaries", """
  WITH n AS (SELECT a.z, a.y, a.x, a.label, b.label AS other FROM atlas a JOIN atlas b ON a.z = b.z AND abs(a.y - b.y) + abs(a.x - b.x) = 1
             AND b.y BETWEEN a.y - 1 AND a.y + 1)
  SELECT DISTINCT z, y, x FROM n WHERE label <> other""", "atlas")
def label_boundaries(spark, d):
    return V.boundaries(D.atlas(spark, d), bounds=D.shape(spark, d))


def _nearest(src: str, out: str, axis: str) -> str:
    """Least squared distance so far plus that along one more axis, over whole lines."""
    u, v = [a for a in "zyx" if a != axis]
    return f"""{out} AS MATERIALIZED (SELECT p.z, p.y, p.x, min(q.f + (p.{axis} - q.{axis}) * (p.{axis} - q.{axis})) AS f
      FROM atlas p JOIN (SELECT * FROM {src} WHERE f IS NOT NULL) q ON p.{u} = q.{u} AND p.{v} = q.{v} GROUP BY ALL)"""


@query("distance_to_background", f"""
  WITH {GROWN}, bg AS MATERIALIZED (SELECT z, y, x, 0 AS f FROM atlas ANTI JOIN grown USING (z, y, x)),
   {_nearest("bg", "f1", "x")}, {_nearest("f1", "f2", "y")}, {_nearest("f2", "f3", "z")}
  SELECT g.z, g.y, g.x, round(sqrt(f), 6) AS distance FROM grown g LEFT JOIN f3 USING (z, y, x)""", "voxels atlas")
def distance_to_background(spark, d):
    return V.distance_map(_grown(spark, d), bounds=D.shape(spark, d))


@query("local_maxima")
def local_maxima(spark, d):
    return V.local_maxima(D.voxels(spark, d), "value", 3)


@query("density_map", f"""
  WITH c AS (SELECT z, y, x, count(*) AS n FROM cells WHERE vols > 30 GROUP BY ALL),
   s AS (SELECT DISTINCT c.z AS cz, c.y AS cy, c.x AS cx, n, least(c.z + dz, {NZ} - 1) AS z, least(c.y + dy, 31) AS y, least(c.x + dx, 31) AS x
         FROM c, (SELECT * FROM {reach(5)} WHERE dz * dz + dy * dy + dx * dx <= 25)),
   m AS (SELECT z, y, x, sum(n) * (1.0::DOUBLE / pow(5 * 20 * 0.001 * 2, 3)) AS density FROM s GROUP BY ALL)
  SELECT z, y, x, round(density, 6) AS density FROM m WHERE EXISTS (SELECT 1 FROM atlas a WHERE a.z = m.z AND a.y = m.y AND a.x = m.x AND a.label > 0)""", "cells atlas")
def density_map(spark, d):
    return V.density_map(D.cells(spark, d).filter("vols > 30"), D.atlas(spark, d), 5, shape=D.shape(spark, d))


@query("mean_map", """
  WITH m AS (SELECT dataset, z, y, x, count(*) AS density FROM cells GROUP BY ALL),
       s AS (SELECT z, y, x, sum(density) / (SELECT count(DISTINCT dataset) FROM cells) AS density FROM m GROUP BY ALL)
  SELECT z, y, x, round(coalesce(density, 1.0), 6) AS density FROM (SELECT z, y, x FROM atlas WHERE label > 0) LEFT JOIN s USING (z, y, x)""", "cells atlas")
def mean_map(spark, d):
    c = D.cells(spark, d)
    maps = c.groupBy("dataset", "z", "y", "x").agg(F.count(F.lit(1)).alias("density"))
    return V.mean_map(maps, D.atlas(spark, d).filter("label > 0"), c.select("dataset").distinct().count())


@query("max_projection", "SELECT y, x, round(max(value), 6) AS value FROM voxels GROUP BY ALL", "voxels")
def max_projection(spark, d):
    return V.project(D.voxels(spark, d), "z", "max")


@query("mean_projection", "SELECT z, x, round(avg(value), 6) AS value FROM voxels GROUP BY ALL", "voxels")
def mean_projection(spark, d):
    return V.project(D.voxels(spark, d), "y", "mean")


REGION_IDS = "(SELECT descendant FROM closure JOIN ontology ON ids = ancestor WHERE acronym IN ('R1', 'R2'))"


@query("middle_slice", f"""
  WITH r AS (SELECT * FROM atlas WHERE label IN {REGION_IDS}), m AS (SELECT CAST(floor(avg(z)) AS BIGINT) AS s FROM r)
  SELECT max(z) AS slice, min(y) AS y_min, min(x) AS x_min, max(y) AS y_max, max(x) AS x_max FROM r WHERE z = (SELECT s FROM m)""", "atlas closure ontology")
def middle_slice(spark, d):
    return V.mid_slice(D.atlas(spark, d), G.subtree_ids(D.ontology(spark, d), ["R1", "R2"], "acronym"))


@query("region_mask", f"SELECT z, y, x FROM atlas WHERE label IN {REGION_IDS}", "atlas closure ontology")
def region_mask(spark, d):
    return V.region_mask(D.atlas(spark, d), G.subtree_ids(D.ontology(spark, d), ["R1", "R2"], "acronym")).select("z", "y", "x")


@query("outside_region_mask", f"SELECT z, y, x FROM atlas WHERE label > 0 AND label NOT IN {REGION_IDS}", "atlas closure ontology")
def outside_region_mask(spark, d):
    return V.region_mask(D.atlas(spark, d), G.subtree_ids(D.ontology(spark, d), ["R1", "R2"], "acronym"), "drop").select("z", "y", "x")


PARTS = """
  SELECT z // 16 AS block, label AS region, count(*) AS reg_voxels, count(b.z) AS cell_body_voxels,
         coalesce(sum(value) FILTER (value <> 0), 0) AS sum_int, count(value) FILTER (value <> 0) AS num_vals
  FROM (SELECT a.z, a.y, a.x, a.label, v.value FROM atlas a LEFT JOIN voxels v USING (z, y, x) WHERE label > 0) q
  LEFT JOIN (SELECT DISTINCT z, y, x FROM cells WHERE vols > 500) b USING (z, y, x) GROUP BY ALL"""


@query("block_sums", f"SELECT block, region, reg_voxels, cell_body_voxels, round(sum_int, 6) AS sum_int, num_vals FROM ({PARTS})", "atlas voxels cells")
def block_sums(spark, d):
    return V.block_parts(D.atlas(spark, d), D.voxels(spark, d), D.cells(spark, d).filter("vols > 500"))


@query("merge_blocks", f"""
  SELECT region, round(sum(sum_int) / nullif(sum(num_vals), 0), 6) AS mean_intensity,
         round(sum(sum_int) / nullif(sum(reg_voxels) - sum(cell_body_voxels), 0), 6) AS scaled_intden,
         round(sum(num_vals) / sum(reg_voxels), 6) AS mean_volume FROM ({PARTS}) GROUP BY region""", "atlas voxels cells")
def merge_blocks(spark, d):
    return V.merge_blocks(V.block_parts(D.atlas(spark, d), D.voxels(spark, d), D.cells(spark, d).filter("vols > 500")))


@query("dataset_moments", "SELECT round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS n FROM voxels", "voxels")
def dataset_moments(spark, d):
    return V.dataset_moments(D.voxels(spark, d))


HIST = """
  e AS (SELECT min(value) AS lo, max(value) AS hi FROM voxels),
  h AS MATERIALIZED (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 256)), 255) AS BIGINT) AS bin, count(*) AS n FROM voxels, e GROUP BY bin),
  f AS MATERIALIZED (SELECT b AS bin, lo + (b + 0.5) * ((hi - lo) / 256) AS centre, coalesce(h.n, 0) AS n FROM (SELECT unnest(range(256)) AS b) r
        CROSS JOIN e LEFT JOIN h ON h.bin = r.b)"""


@query("otsu_threshold", f"""
  WITH {HIST}, c AS (SELECT bin, centre, sum(n) OVER up AS w1, sum(n) OVER down AS w2, sum(n * centre) OVER up AS s1, sum(n * centre) OVER down AS s2 FROM f
    WINDOW up AS (ORDER BY bin ROWS UNBOUNDED PRECEDING), down AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT round(arg_min(centre, {{'b': -round(w1::DOUBLE * w2::DOUBLE * pow(s1 / w1 - s2 / w2, 2), 6), 'i': bin}}), 6) AS threshold
  FROM c WHERE w1 > 0 AND w2 > 0""", "voxels")
def otsu_threshold(spark, d):
    return V.hist_threshold(D.voxels(spark, d), "otsu")


@query("triangle_threshold", f"""
  WITH {HIST}, p AS (SELECT max(n) AS pn, (SELECT min(bin) FROM f WHERE n = (SELECT max(n) FROM f)) AS pb,
      (SELECT min(bin) FROM f WHERE n > 0) AS lo, (SELECT max(bin) FROM f WHERE n > 0) AS hi FROM f),
    q AS (SELECT *, CASE WHEN pb - lo < hi - pb THEN hi ELSE lo END AS far FROM p),
    l AS (SELECT f.centre, pn * abs(bin - far) / greatest(abs(far - pb), 1)::DOUBLE - n AS d, abs(bin - far) AS away FROM f, q
          WHERE bin BETWEEN least(far, pb) AND greatest(far, pb) AND (bin <> pb OR far = pb))
  SELECT round(arg_max(centre, {{'d': round(d, 6), 'b': -away}}), 6) AS threshold FROM l""", "voxels")
def triangle_threshold(spark, d):
    return V.hist_threshold(D.voxels(spark, d), "triangle")


SLAB = """
  WITH p AS (SELECT z // 33 AS slab, y, x, max(value) AS v FROM voxels GROUP BY ALL),
       e AS (SELECT slab, v, unnest([{what}]) AS w FROM p),
       a AS (SELECT slab, avg(w) FILTER (v > 100) AS signal, stddev_pop(w) FILTER (v < 100) AS noise FROM e GROUP BY slab)
  SELECT slab, round(signal, 6) AS signal, round(noise, 6) AS noise,
         round(CASE WHEN signal / nullif(noise, 0) > 0 THEN 10 * log10(signal / noise) END, 6) AS snr_db FROM a"""


@query("slab_snr_positions", SLAB.format(what="y::DOUBLE, x::DOUBLE"), "voxels")
def slab_snr_positions(spark, d):
    return V.slab_snr(D.voxels(spark, d), 33, threshold=100.0)


@query("slab_snr_intensities", SLAB.format(what="v"), "voxels")
def slab_snr_intensities(spark, d):
    return V.slab_snr(D.voxels(spark, d), 33, threshold=100.0, intensities=True)


def _gauss(sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    rows = ", ".join(f"({i - r}, {w / sum(raw)!r}::DOUBLE)" for i, w in enumerate(raw))
    return f"(VALUES {rows})"


def _pass(src: str, axis: str, n: str, out: str) -> str:
    others = [a for a in "zyx" if a != axis]
    o = ", ".join(others)
    return f"""{out} AS MATERIALIZED (SELECT {o}, p + k.o AS {axis}, sum(value * k.w) AS value
      FROM (SELECT {o}, value, unnest([{axis}, -1 - {axis}, 2 * {n} - 1 - {axis}]) AS p FROM {src}) s, {_gauss(1.0)} k(o, w)
      WHERE p + k.o BETWEEN 0 AND {n} - 1 GROUP BY ALL)"""


@query("smooth_map", f"""
  WITH {_pass('voxels', 'z', NZ, 'g1')}, {_pass('g1', 'y', '32', 'g2')}, {_pass('g2', 'x', '32', 'g3')}
  SELECT z, y, x, round(value, 6) AS value FROM g3""", "voxels")
def smooth_map(spark, d):
    return V.smooth(D.voxels(spark, d), 1.0, D.shape(spark, d))


@query("resize_labels", f"""
  WITH t AS (SELECT * FROM (SELECT unnest(range({NZ} * 2 // 3)) AS z), (SELECT unnest(range(48)) AS y), (SELECT unnest(range(20)) AS x))
  SELECT t.z, t.y, t.x, a.label FROM t JOIN atlas a ON a.z = (2 * t.z + 1) * {NZ} // (2 * ({NZ} * 2 // 3)) AND a.y = (2 * t.y + 1) * 32 // 96
    AND a.x = (2 * t.x + 1) * 32 // 40 WHERE a.label <> 0""", "atlas")
def resize_labels(spark, d):
    s = D.shape(spark, d)
    return V.resize_labels(D.atlas(spark, d).select("z", "y", "x", "label"), s, {"z": s["z"] * 2 // 3, "y": 48, "x": 20})


@query("pad_volume", f"""
  WITH n AS (SELECT * FROM (SELECT unnest(range({NZ} + 3)) AS z), (SELECT unnest(range(31)) AS y), (SELECT unnest(range(34)) AS x))
  SELECT n.z, n.y, n.x, round(CASE WHEN n.z BETWEEN 2 AND {NZ} + 1 AND n.y <= 30 AND n.x BETWEEN 1 AND 32 THEN v.value ELSE 0 END, 6) AS value FROM n
  LEFT JOIN (SELECT z + 2 AS z, y - 1 AS y, x + 1 AS x, value FROM voxels) v USING (z, y, x)
  WHERE v.value IS NOT NULL OR NOT (n.z BETWEEN 2 AND {NZ} + 1 AND n.y <= 30 AND n.x BETWEEN 1 AND 32)""", "voxels")
def pad_volume(spark, d):
    return V.pad_or_crop(D.voxels(spark, d).drop("red"), D.shape(spark, d), {"z": (2, 1), "y": (-1, 0), "x": (1, 1)}, 0.0)


@query("crop_volume", "SELECT z - 2 AS z, y - 3 AS y, x - 4 AS x, round(value, 6) AS value FROM voxels WHERE z >= 2 AND y BETWEEN 3 AND 29 AND x BETWEEN 4 AND 31", "voxels")
def crop_volume(spark, d):
    return V.pad_or_crop(D.voxels(spark, d).drop("red"), D.shape(spark, d), {"z": (-2, 0), "y": (-3, -2), "x": (-4, 0)})


@query("trimmed_edges", f"SELECT z, y, x FROM voxels WHERE z BETWEEN 2 AND {NZ} - 3 AND y BETWEEN 2 AND 29 AND x BETWEEN 2 AND 29", "voxels")
def trimmed_edges(spark, d):
    return V.trim_edges(D.voxels(spark, d), D.shape(spark, d), 2).select("z", "y", "x")


@query("ratio_corrected", "SELECT z, y, x, round(coalesce(value / nullif(greatest(coalesce(red / nullif(value, 0), 0.2), 0.2), 0), 0), 6) AS corrected FROM voxels", "voxels")
def ratio_corrected(spark, d):
    return S.ratio_correct(D.voxels(spark, d)).select("z", "y", "x", "corrected")


@query("scaled_16bit", "SELECT z, y, x, CAST(floor(value / (SELECT max(value) FROM voxels) * 65535.0) AS BIGINT) AS scaled FROM voxels", "voxels")
def scaled_16bit(spark, d):
    return S.to_16bit(D.voxels(spark, d)).select("z", "y", "x", "scaled")


@query("normalized_values", """
  SELECT z, y, x, round((value - (SELECT avg(value) FROM voxels)) / (SELECT stddev_pop(value) FROM voxels), 6) AS normalized FROM voxels""", "voxels")
def normalized_values(spark, d):
    return S.normalize(D.voxels(spark, d), "value").select("z", "y", "x", "normalized")
