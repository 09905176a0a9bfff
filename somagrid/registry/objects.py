"""Queries on objects: components, fragments, cores, boxes, detection scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from somagrid.functions import scalars as S
from somagrid.operators import boxes as B, components as C, grouped as U, voxels as V
from somagrid.registry import derived as D
from somagrid.registry.base import query
from somagrid.session import cut
from somagrid.registry.volumes import NZ, reach

ID = "z * 4398046511104 + y * 2097152 + x"


def cc_sql(src: str, conn: int, same: str = "", name: str = "cc") -> str:
    """Component ids of the voxels of ``src`` (smallest packed position)."""
    near = {6: 1, 26: 3}[conn]
    return f"""{name}_n AS MATERIALIZED (SELECT *, {ID} AS id FROM {src}),
   {name}_s AS (SELECT *, z + dz AS nz, y + dy AS ny, x + dx AS nx FROM {name}_n, {reach(1)} WHERE abs(dz) + abs(dy) + abs(dx) BETWEEN 1 AND {near}),
   {name}_e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM {name}_s a JOIN {name}_n b ON b.z = a.nz AND b.y = a.ny AND b.x = a.nx {same}),
   {name}(id, comp) USING KEY (id) AS (SELECT id, id FROM {name}_n UNION (SELECT e.dst, min({name}.comp) FROM {name} JOIN {name}_e e ON e.src = {name}.id
      JOIN recurring.{name} r ON r.id = e.dst WHERE {name}.comp < r.comp GROUP BY e.dst))"""


MASK = "mask AS (SELECT z, y, x FROM voxels WHERE value > 20)"


def _mask(spark, d):
    return D.voxels(spark, d).filter("value > 20").select("z", "y", "x")


@query("components_6", f"WITH RECURSIVE {MASK}, {cc_sql('mask', 6)} SELECT n.z, n.y, n.x, cc.comp AS component FROM cc_n n JOIN cc USING (id)", "voxels")
def components_6(spark, d):
    return C.label_components(_mask(spark, d), 6, block=8)


@query("components_26", f"WITH RECURSIVE {MASK}, {cc_sql('mask', 26)} SELECT n.z, n.y, n.x, cc.comp AS component FROM cc_n n JOIN cc USING (id)", "voxels")
def components_26(spark, d):
    return C.label_components(_mask(spark, d), 26)


@query("small_objects_removed", f"""
  WITH RECURSIVE {MASK}, {cc_sql('mask', 6)}, s AS (SELECT comp, count(*) AS n FROM cc GROUP BY comp)
  SELECT n.z, n.y, n.x FROM cc_n n JOIN cc USING (id) JOIN s USING (comp) WHERE s.n >= 4""", "voxels")
def small_objects_removed(spark, d):
    return V.remove_small(_mask(spark, d), 4)


@query("small_labels_removed", "SELECT z, y, x, label FROM object_voxels QUALIFY count(*) OVER (PARTITION BY label) >= 12", "object_voxels")
def small_labels_removed(spark, d):
    return V.remove_small(D.object_voxels(spark, d), 12, "label").select("z", "y", "x", "label")


@query("border_cleared", f"""
  WITH RECURSIVE {MASK}, {cc_sql('mask', 26)}, q AS (SELECT n.z, n.y, n.x, cc.comp AS component FROM cc_n n JOIN cc USING (id)),
   bad AS (SELECT component FROM q WHERE z >= {NZ} - 1 OR z <= 1 OR y <= 3 OR y >= 29 OR x <= 3 OR x >= 29)
  SELECT * FROM q WHERE component NOT IN (FROM bad)""", "voxels")
def border_cleared(spark, d):
    return V.clear_border(_mask(spark, d), D.shape(spark, d))


@query("thin_slices_dropped", "SELECT z, y, x, label FROM object_voxels QUALIFY count(*) OVER (PARTITION BY label, z) >= 4", "object_voxels")
def thin_slices_dropped(spark, d):
    return V.drop_thin(D.object_voxels(spark, d), 4).select("z", "y", "x", "label")


@query("objects_by_span", "SELECT label, max(z) - min(z) + 1 AS span FROM object_voxels GROUP BY label HAVING span >= 4", "object_voxels")
def objects_by_span(spark, d):
    return V.min_span(D.object_voxels(spark, d), 4)


@query("object_table", """
  SELECT label, count(*) AS volume, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, min(z) AS z0, min(y) AS y0, min(x) AS x0,
         max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM object_voxels GROUP BY label""", "object_voxels")
def object_table(spark, d):
    return V.object_props(D.object_voxels(spark, d))


@query("object_core_volume", """
  SELECT label, count(c.z) AS core_vols, count(*) AS volume FROM object_voxels o
  LEFT JOIN (SELECT DISTINCT z, y, x FROM cells WHERE vols > 500) c USING (z, y, x) GROUP BY label""", "object_voxels cells")
def object_core_volume(spark, d):
    return V.inner_volume(D.object_voxels(spark, d), D.cells(spark, d).filter("vols > 500"))


@query("object_intensity", "SELECT label, round(avg(v.red), 6) AS mean_intensity FROM object_voxels o JOIN voxels v USING (z, y, x) GROUP BY label", "object_voxels voxels")
def object_intensity(spark, d):
    return V.object_intensity(D.object_voxels(spark, d), D.voxels(spark, d), value="red")


@query("object_size_class", """
  SELECT label, CASE WHEN core <= 0 THEN 'none' WHEN core <= 3 THEN 'small' ELSE 'large' END AS size_class FROM (
    SELECT label, count(c.z) AS core FROM object_voxels o LEFT JOIN (SELECT DISTINCT z, y, x FROM cells WHERE vols > 500) c USING (z, y, x) GROUP BY label)""",
       "object_voxels cells")
def object_size_class(spark, d):
    o = V.inner_volume(D.object_voxels(spark, d), D.cells(spark, d).filter("vols > 500"))
    return o.select("label", S.bucket("core_vols", (0, 3)).alias("size_class"))


@query("elongated_objects")
def elongated_objects(spark, d):
    return V.elongation(D.object_voxels(spark, d), big=12, small=4, ratio=2.0)


LARGEST = f"""
  WITH RECURSIVE {cc_sql('object_voxels', 6, 'AND a.label = b.label')},
   q AS (SELECT n.z, n.y, n.x, n.label, cc.comp AS component FROM cc_n n JOIN cc USING (id)),
   s AS (SELECT label, component, count(*) AS n FROM q GROUP BY ALL),
   b AS (SELECT label, max({{'n': n, 'c': -component}}) AS b, count(*) AS pieces FROM s GROUP BY label)"""


@query("largest_component", f"""{LARGEST}
  SELECT z, y, x, q.label, component, component = -b.b.c AND (b.b.n > 5 OR pieces = 1) AS keep FROM q JOIN b USING (label)""", "object_voxels")
def largest_component(spark, d):
    return V.largest_component(D.object_voxels(spark, d), limit=5)


@query("stragglers_assigned", f"""{LARGEST},
   t AS MATERIALIZED (SELECT z, y, x, q.label, component, component = -b.b.c AND (b.b.n > 5 OR pieces = 1) AS keep FROM q JOIN b USING (label)),
   m AS (SELECT component AS frag, z + dz AS z, y + dy AS y, x + dx AS x FROM t, {reach(1)} WHERE NOT keep),
   h AS (SELECT frag, k.label, count(*) AS n FROM m JOIN t k USING (z, y, x) WHERE k.keep GROUP BY ALL),
   w AS (SELECT frag, max({{'n': n, 'l': -label}}) AS w FROM h GROUP BY frag)
  SELECT frag, -w.w.l AS label, w.w.n AS n FROM w""", "object_voxels")
def stragglers_assigned(spark, d):
    from somagrid.session import cut

    p = cut(V.largest_component(D.object_voxels(spark, d), limit=5))
    return V.assign_stragglers(p.filter("NOT keep").withColumnRenamed("component", "frag").drop("label"), p.filter("keep"))


@query("displacement_filter", """
  WITH c AS (SELECT label, z, CAST(floor(avg(y)) AS BIGINT) AS cy, CAST(floor(avg(x)) AS BIGINT) AS cx FROM object_voxels GROUP BY ALL),
   s AS (SELECT label, sqrt(pow(lead(z) OVER w - z, 2) + pow(lead(cy) OVER w - cy, 2) + pow(lead(cx) OVER w - cx, 2)) AS step FROM c WINDOW w AS (PARTITION BY label ORDER BY z))
  SELECT label, round(avg(step), 6) AS mean_step, round(max(step), 6) AS max_step, count(*) AS n, avg(step) < 1.5 OR max(step) < 1.5 AS keep
  FROM s GROUP BY label HAVING count(*) > 1""", "object_voxels")
def displacement_filter(spark, d):
    return V.displacement_filter(D.object_voxels(spark, d), mean_limit=1.5, max_limit=1.5)


@query("seeded_split")
def seeded_split(spark, d):
    v = D.voxels(spark, d)
    seeds = v.filter("value > 90").withColumn("label", C.voxel_id())
    return V.seeded_split(v.filter("value > 15"), seeds, leftover=20)


@query("watershed_split")
def watershed_split(spark, d):
    """Bright pieces parted at their waists: the inverted distance to the outside is flooded from its deepest places."""
    depth = cut(V.distance_map(D.voxels(spark, d).filter("value > 15"), bounds=D.shape(spark, d)))
    seeds = V.local_maxima(depth, "distance", 3).withColumn("label", C.voxel_id())
    return V.seeded_split(depth.withColumn("height", -F.col("distance")), seeds, leftover=20, height="height")


@query("core_halo_match", """
  SELECT z, y, x, h.label, CASE WHEN h.label IS NOT NULL AND c.z IS NOT NULL THEN 'core' WHEN h.label IS NULL THEN 'unmatched core' ELSE 'halo' END AS status
  FROM (SELECT z, y, x, label FROM object_voxels WHERE value > 30) h FULL JOIN (SELECT DISTINCT z, y, x FROM cells WHERE vols > 500) c USING (z, y, x)""", "object_voxels cells")
def core_halo_match(spark, d):
    return V.match_cores(D.object_voxels(spark, d).filter("value > 30"), D.cells(spark, d).filter("vols > 500"))


@query("skeleton_degree", f"""
  WITH v AS (SELECT DISTINCT z, y, x FROM cells), s AS (SELECT z, y, x, z + dz AS nz, y + dy AS ny, x + dx AS nx FROM v, {reach(1)} WHERE abs(dz) + abs(dy) + abs(dx) > 0),
   g AS (SELECT s.z, s.y, s.x, count(w.z) AS degree FROM s LEFT JOIN v w ON w.z = nz AND w.y = ny AND w.x = nx GROUP BY ALL)
  SELECT z, y, x, degree, CASE degree WHEN 0 THEN 'single' WHEN 1 THEN 'end' WHEN 2 THEN 'path' ELSE 'branch' END AS kind FROM g""", "cells")
def skeleton_degree(spark, d):
    return V.voxel_degree(D.cells(spark, d))


@query("divided_by_structure", f"""
  WITH RECURSIVE {MASK}, {cc_sql('mask', 6)}, s AS (SELECT comp, count(*) AS n FROM cc GROUP BY comp),
   b AS (SELECT n.z, n.y, n.x, v.value FROM cc_n n JOIN cc USING (id) JOIN s USING (comp) JOIN voxels v USING (z, y, x) WHERE s.n >= 4)
  SELECT v.z, v.y, v.x, CAST(floor(v.value / coalesce(b.value / (SELECT max(value) FROM b) + 2.0, 1.0)) AS BIGINT) AS divided FROM voxels v LEFT JOIN b USING (z, y, x)""", "voxels")
def divided_by_structure(spark, d):
    v = D.voxels(spark, d)
    return V.divide_by_structure(v, v, 20, 4)


@query("tissue_mask", f"""
  WITH RECURSIVE {MASK}, {cc_sql('mask', 26)}, s AS (SELECT comp, count(*) AS n FROM cc GROUP BY comp), b AS (SELECT max({{'n': n, 'c': -comp}}) AS b FROM s)
  SELECT n.z, n.y, n.x FROM cc_n n JOIN cc USING (id), b WHERE cc.comp = -b.b.c""", "voxels")
def tissue_mask(spark, d):
    return V.tissue_mask(D.voxels(spark, d), 20.0)


@query("tissue_mask_by_slice")
def tissue_mask_by_slice(spark, d):
    return V.tissue_mask(D.voxels(spark, d))


@query("corrected_labels")
def corrected_labels(spark, d):
    v = D.object_voxels(spark, d)
    codes = D.voxels(spark, d).filter("value > 10").select("z", "y", "x", (F.col("red") % 40).cast("int").alias("code")).filter("code BETWEEN 1 AND 7")
    return V.apply_corrections(v, codes, 4)


@query("dense_numbers", "SELECT label, dense_rank() OVER (PARTITION BY z // 16 ORDER BY label) AS number, z // 16 AS tile, z, y, x FROM object_voxels", "object_voxels")
def dense_numbers(spark, d):
    o = D.object_voxels(spark, d).select("z", "y", "x", "label", F.expr("z div 16").alias("tile"))
    return V.renumber(o, ["tile"])


@query("visit_level", """
  WITH n AS (SELECT z, y, x, count(*) AS visits FROM cells GROUP BY ALL)
  SELECT label, max(visits) AS level, max(visits) > 2 AS seen_often FROM object_voxels JOIN n USING (z, y, x) GROUP BY label""", "cells object_voxels")
def visit_level(spark, d):
    return V.visit_count(D.cells(spark, d), D.object_voxels(spark, d))[1]


@query("visit_count", "SELECT z, y, x, count(*) AS visits FROM cells GROUP BY ALL", "cells")
def visit_count(spark, d):
    return V.visit_count(D.cells(spark, d), D.object_voxels(spark, d))[0]


# ------------------------------------------------------------------ boxes
BOX_VOX = """bv AS MATERIALIZED (SELECT box, z, y, x FROM (SELECT *, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM (
    SELECT *, unnest(range(z0, z1)) AS z FROM boxes))))"""


@query("overlaps_split", f"""
  WITH {BOX_VOX}, n AS MATERIALIZED (SELECT z, y, x, count(*) AS n, max(box) AS box FROM bv GROUP BY ALL),
   c AS (SELECT box, CAST(round_even((z1 - z0) / 2.0::DOUBLE + z0, 0) AS BIGINT) AS cz, CAST(round_even((y1 - y0) / 2.0::DOUBLE + y0, 0) AS BIGINT) AS cy,
                CAST(round_even((x1 - x0) / 2.0::DOUBLE + x0, 0) AS BIGINT) AS cx FROM boxes),
   m AS (SELECT n.z, n.y, n.x, min({{'d': (z - cz) ** 2 + (y - cy) ** 2 + (x - cx) ** 2, 'b': c.box}}) AS m FROM n JOIN c ON cz BETWEEN z - 5 AND z + 5
         AND cy BETWEEN y - 5 AND y + 5 AND cx BETWEEN x - 5 AND x + 5 WHERE n.n > 1 GROUP BY ALL)
  SELECT z, y, x, box FROM n WHERE n = 1 UNION ALL SELECT z, y, x, m.m.b FROM m""", "boxes")
def overlaps_split(spark, d):
    return B.split_overlaps(D.boxes(spark, d))


PAIRS = """SELECT a.label AS a, b.label AS b, count(*) AS inter FROM truth_voxels a JOIN pred_voxels b USING (z, y, x) GROUP BY ALL"""
IOU = f"""SELECT p.a, p.b, inter, na.n AS na, nb.n AS nb, inter / (na.n + nb.n - inter) AS iou FROM ({PAIRS}) p
  JOIN (SELECT label, count(*) AS n FROM truth_voxels GROUP BY label) na ON na.label = p.a
  JOIN (SELECT label, count(*) AS n FROM pred_voxels GROUP BY label) nb ON nb.label = p.b"""


@query("object_iou", f"SELECT a, b, inter, na, nb, round(iou, 6) AS iou FROM ({IOU})", "truth_voxels pred_voxels")
def object_iou(spark, d):
    return B.iou_pairs(D.truth_voxels(spark, d), D.pred_voxels(spark, d))


def _scores(truth: str) -> str:
    return f"""
  WITH t AS MATERIALIZED ({truth}), na AS (SELECT label, count(*) AS n FROM t GROUP BY label), nb AS (SELECT label, count(*) AS n FROM pred_voxels GROUP BY label),
   p AS (SELECT a.label AS a, b.label AS b, count(*) AS inter FROM t a JOIN pred_voxels b USING (z, y, x) GROUP BY ALL),
   h AS (SELECT a, b FROM p JOIN na ON na.label = a JOIN nb ON nb.label = b WHERE inter / (na.n + nb.n - inter) > 0.3),
   k AS (SELECT count(DISTINCT b) AS tp, (SELECT count(*) FROM nb) - count(DISTINCT b) AS fp, (SELECT count(*) FROM na) - count(DISTINCT a) AS fn FROM h),
   v AS (SELECT (SELECT count(*) FROM (SELECT z, y, x FROM t INTERSECT SELECT z, y, x FROM pred_voxels)) AS b,
                (SELECT count(*) FROM (SELECT z, y, x FROM t UNION SELECT z, y, x FROM pred_voxels)) AS u)
  SELECT tp, fp, fn, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tp / nullif(tp + fp, 0), 6) AS precision, round(b / u, 6) AS jaccard FROM k, v"""


@query("detection_scores", _scores("SELECT * FROM truth_voxels"), "truth_voxels pred_voxels")
def detection_scores(spark, d):
    return B.detection_scores(D.truth_voxels(spark, d), D.pred_voxels(spark, d))


@query("detection_scores_large", _scores("SELECT * FROM truth_voxels QUALIFY count(*) OVER (PARTITION BY label) > 10"), "truth_voxels pred_voxels")
def detection_scores_large(spark, d):
    return B.detection_scores(D.truth_voxels(spark, d), D.pred_voxels(spark, d), min_size=10)


@query("objects_touching_mask", "SELECT DISTINCT label FROM truth_voxels JOIN (SELECT DISTINCT z, y, x FROM cells) c USING (z, y, x)", "truth_voxels cells")
def objects_touching_mask(spark, d):
    return B.overlap_objects(D.truth_voxels(spark, d), D.cells(spark, d))


BOX_PAIRS = """bp AS MATERIALIZED (SELECT a.box AS a, b.box AS b, i / ((a.z1 - a.z0) * (a.y1 - a.y0) * (a.x1 - a.x0) + (b.z1 - b.z0) * (b.y1 - b.y0) * (b.x1 - b.x0) - i) AS iou
   FROM boxes a JOIN boxes b ON a.box < b.box AND b.z0 BETWEEN a.z0 - 2 AND a.z0 + 2 AND b.y0 BETWEEN a.y0 - 4 AND a.y0 + 4 AND b.x0 BETWEEN a.x0 - 4 AND a.x0 + 4,
   LATERAL (SELECT greatest(least(a.z1, b.z1) - greatest(a.z0, b.z0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)
            * greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS i) WHERE i > 0)"""


@query("box_iou_pairs", f"WITH {BOX_PAIRS} SELECT a, b, round(iou, 6) AS iou FROM bp WHERE iou > 0.3", "boxes")
def box_iou_pairs(spark, d):
    return B.box_pairs(D.boxes(spark, d), 0.3)


@query("box_clusters", f"""
  WITH RECURSIVE {BOX_PAIRS}, e AS MATERIALIZED (SELECT a AS src, b AS dst FROM bp WHERE iou > 0.5 UNION ALL SELECT b, a FROM bp WHERE iou > 0.5),
   cc(id, comp) USING KEY (id) AS (SELECT box, box FROM boxes UNION (SELECT e.dst, min(cc.comp) FROM cc JOIN e ON e.src = cc.id
      JOIN recurring.cc r ON r.id = e.dst WHERE cc.comp < r.comp GROUP BY e.dst)),
   w AS (SELECT b.*, cc.comp, score * (z1 - z0) * (y1 - y0) * (x1 - x0) AS w FROM boxes b JOIN cc ON cc.id = b.box)
  SELECT comp AS cluster, count(*) AS n_boxes, round(sum(z0 * w) / nullif(sum(w), 0), 6) AS z0, round(sum(y0 * w) / nullif(sum(w), 0), 6) AS y0, round(sum(x0 * w) / nullif(sum(w), 0), 6) AS x0,
    round(sum(z1 * w) / nullif(sum(w), 0), 6) AS z1, round(sum(y1 * w) / nullif(sum(w), 0), 6) AS y1, round(sum(x1 * w) / nullif(sum(w), 0), 6) AS x1, round(sum(w * score) / nullif(sum(w), 0), 6) AS score
  FROM w GROUP BY comp""", "boxes")
def box_clusters(spark, d):
    return B.cluster_boxes(D.boxes(spark, d), 0.5)


CROPS = """SELECT c.cell_id, count(*) AS n, sum(v.value) AS total, sum((c.dz + 2) * v.value) AS moment FROM (
     SELECT cell_id, dz, z + dz AS z, y + dy AS y, x + dx AS x FROM cells, (SELECT unnest(range(-2, 2)) AS dz), (SELECT unnest(range(-3, 3)) AS dy),
     (SELECT unnest(range(-3, 3)) AS dx)) c JOIN voxels v USING (z, y, x) GROUP BY c.cell_id"""


@query("cell_crops", f"SELECT cell_id, n, round(total, 6) AS total, round(moment, 6) AS moment FROM ({CROPS})", "cells voxels")
def cell_crops(spark, d):
    c = B.extract_crops(D.cells(spark, d), D.voxels(spark, d), {"z": 2, "y": 3, "x": 3})
    add = lambda e: F.aggregate("voxels", F.lit(0.0), lambda a, v: a + e(v))
    return c.select("cell_id", F.size("voxels").alias("n"), add(lambda v: v["value"]).alias("total"), add(lambda v: v["z"] * v["value"]).alias("moment"))


def _score(pdf: pd.DataFrame) -> pd.DataFrame:
    mean = pdf["values"].map(np.mean)
    return pdf[["cell_id"]].assign(**{"class": (mean > 30).astype(int), "confidence": mean})


@query("scored_cells", f"""
  SELECT cell_id, CASE WHEN total / n > 30 THEN 1 ELSE 0 END::BIGINT AS class, round(total / n, 6) AS confidence FROM ({CROPS})""", "cells voxels")
def scored_cells(spark, d):
    crops = B.extract_crops(D.cells(spark, d), D.voxels(spark, d), {"z": 2, "y": 3, "x": 3})
    crops = crops.select("cell_id", F.transform("voxels", lambda v: v["value"]).alias("values"))
    return U.score_cells(crops, _score, "cell_id")
