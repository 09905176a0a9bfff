"""Queries on brains, regions and the region tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from somagrid.functions import scalars as S
from somagrid.operators import regions as R, reshape as X, tree as G
from somagrid.plans.compare import density_by_group
from somagrid.registry import derived as D
from somagrid.registry.base import query

R6 = "round({}, 6)".format


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("region_density_by_group", f"""
  SELECT ids, acronym, exp, round(avg(density_w), 6) AS density_w, round(avg(density_large_w), 6) AS density_large_w,
         count(*) AS n_brains FROM pooled WHERE st_level = 7 GROUP BY ALL""", "pooled")
def region_density_by_group(spark, d):
    return density_by_group(D.pooled(spark, d), 7)


@query("pooled_regions", f"""
  SELECT dataset, ids, acronym, CAST(st_level AS BIGINT) AS st_level,
         CAST(num_l AS BIGINT) AS num_l, CAST(num_r AS BIGINT) AS num_r, CAST(num_w AS BIGINT) AS num_w,
         {_r('density_l', 'density_r', 'density_w', 'density_large_w')},
         exp, sex, CAST(age AS BIGINT) AS age FROM pooled""", "pooled")
def pooled_regions(spark, d):
    return D.pooled(spark, d).select(
        "dataset", "ids", "acronym", "st_level", "num_l", "num_r", "num_w", "density_l", "density_r", "density_w",
        "density_large_w", "exp", "sex", "age",
    )


@query("cells_to_regions", "SELECT cell_id, label, CAST(hemisphere AS BIGINT) AS hemisphere FROM labelled", "labelled")
def cells_to_regions(spark, d):
    return R.label_cells(D.cells(spark, d).select("cell_id", "z", "y", "x"), D.atlas(spark, d)).select("cell_id", "label", "hemisphere")


@query("region_counts", "SELECT dataset, ids, num_l, num_r, num_w, large_l, large_r, large_w FROM region_counts_t", "region_counts_t")
def region_counts(spark, d):
    lab = R.label_cells(D.cells(spark, d).drop("cell_id"), D.atlas(spark, d))
    return R.region_counts(lab, D.ontology(spark, d), D.brains(spark, d)).select(
        "dataset", "ids", "num_l", "num_r", "num_w", "large_l", "large_r", "large_w"
    )


@query("region_volume", f"SELECT ids, {_r('vol_w', 'vol_l', 'vol_r')} FROM region_volume_t", "region_volume_t")
def region_volume(spark, d):
    return R.region_volume(D.atlas(spark, d), D.RES)


@query("region_volume_by_side", """
  SELECT label AS ids, count(*) * 15625.0::DOUBLE AS um3_w, nullif(count(*) FILTER (hemisphere = 1), 0) * 15625.0::DOUBLE AS um3_l,
         nullif(count(*) FILTER (hemisphere = 2), 0) * 15625.0::DOUBLE AS um3_r FROM atlas WHERE label > 0 GROUP BY label""", "atlas")
def region_volume_by_side(spark, d):
    v = R.region_volume(D.atlas(spark, d), D.RES, counted=True)
    return v.select("ids", *[F.round(F.col(f"vol_{s}") * 1e9, 3).alias(f"um3_{s}") for s in "wlr"])


@query("region_density", """
  SELECT r.dataset, r.ids, round(num_l / nullif(vol_l, 0), 6) AS density_l, round(num_r / nullif(vol_r, 0), 6) AS density_r,
         round(CASE WHEN b.sex = 'M' THEN num_l / nullif(vol_l, 0) ELSE num_w / nullif(vol_w, 0) END, 6) AS density_w,
         round(CASE WHEN b.sex = 'M' THEN large_l / nullif(vol_l, 0) ELSE large_w / nullif(vol_w, 0) END, 6) AS density_large_w
  FROM region_counts_t r JOIN brains b USING (dataset) LEFT JOIN region_volume_t v ON v.ids = r.ids""",
       "region_counts_t region_volume_t brains")
def region_density(spark, d):
    t = R.with_brain(D.region_table(spark, d), D.brains(spark, d))
    return R.region_density(t, F.when(F.col("sex") == "M", "L")).select(
        "dataset", "ids", "density_l", "density_r", "density_w", "density_large_w"
    )


@query("exclusions_applied", """
  SELECT dataset, ids, CAST(num_l AS BIGINT) AS num_l, CAST(num_r AS BIGINT) AS num_r, CAST(num_w AS BIGINT) AS num_w FROM kept""",
       "kept")
def exclusions_applied(spark, d):
    t = D.region_table(spark, d)
    return G.apply_exclusions(t, D.ontology(spark, d), D.brains(spark, d)).select("dataset", "ids", "num_l", "num_r", "num_w")


@query("rollup_tree", f"""
  SELECT dataset, ids, CAST(num_w AS BIGINT) AS num_w, CAST(large_w AS BIGINT) AS large_w, {_r('vol_w')} FROM rolled""", "rolled")
def rollup_tree(spark, d):
    return D.pooled(spark, d).select("dataset", "ids", "num_w", "large_w", "vol_w")


@query("tree_closure", "SELECT ancestor, descendant, CAST(depth AS BIGINT) AS depth FROM closure", "closure")
def tree_closure(spark, d):
    return G.closure(D.ontology(spark, d))


@query("subtree_keep", """
  SELECT c.cell_id FROM labelled c WHERE c.label IN (SELECT descendant FROM closure JOIN ontology ON ids = ancestor
    WHERE acronym IN ('R1', 'N7'))""", "labelled closure ontology")
def subtree_keep(spark, d):
    lab = R.label_cells(D.cells(spark, d), D.atlas(spark, d), ("label",))
    return G.in_subtree(lab, D.ontology(spark, d), ["R1", "N7"], by="acronym", on="label").select("cell_id")


@query("subtree_drop", """
  SELECT r.dataset, r.ids, r.num_w FROM region_counts_t r WHERE r.ids NOT IN (SELECT descendant FROM closure JOIN ontology
    ON ids = ancestor WHERE names IN ('ASIA', 'AFRICA'))""", "region_counts_t closure ontology")
def subtree_drop(spark, d):
    return G.in_subtree(D.region_table(spark, d), D.ontology(spark, d), ["ASIA", "AFRICA"], "drop").select("dataset", "ids", "num_w")


@query("region_group_tags", """
  SELECT l.cell_id, CASE WHEN label IN (SELECT descendant FROM closure JOIN ontology ON ids = ancestor WHERE acronym = 'R1') THEN 'one'
    WHEN label IN (SELECT descendant FROM closure JOIN ontology ON ids = ancestor WHERE acronym IN ('R2', 'R3', 'N1')) THEN 'two' END
    AS region_group FROM labelled l""", "labelled closure ontology")
def region_group_tags(spark, d):
    lab = R.label_cells(D.cells(spark, d).select("cell_id", "z", "y", "x"), D.atlas(spark, d), ("label",))
    return G.tag_groups(lab, D.ontology(spark, d), {"one": ["R1"], "two": ["R2", "R3", "N1"]}, "label", "acronym").select(
        "cell_id", "region_group"
    )


@query("children_pruned", """
  WITH gone AS (SELECT DISTINCT descendant AS ids FROM closure JOIN ontology ON ids = ancestor WHERE acronym IN ('R1', 'N0'))
  SELECT o.ids, count(k.ids) AS n_children, CAST(coalesce(sum(k.ids), 0) AS BIGINT) AS id_sum FROM ontology o
  LEFT JOIN (SELECT * FROM ontology WHERE ids NOT IN (SELECT ids FROM gone)) k ON k.parent = o.ids
  WHERE o.ids NOT IN (SELECT ids FROM gone) GROUP BY o.ids""", "closure ontology")
def children_pruned(spark, d):
    o = D.ontology(spark, d)
    p = G.prune_children(o, G.subtree_ids(o, ["R1", "N0"], "acronym"))
    return p.select(
        "ids", F.size("children").alias("n_children"), F.aggregate("children", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("id_sum")
    )


@query("weighted_mean_tree", """
  SELECT p.dataset, c.ancestor AS ids, round(sum(density_w * vol_w) / sum(vol_w), 6) AS weighted_mean
  FROM pooled p JOIN closure c ON c.descendant = p.ids WHERE density_w IS NOT NULL AND vol_w IS NOT NULL GROUP BY ALL""", "pooled closure")
def weighted_mean_tree(spark, d):
    return G.weighted_mean_tree(D.pooled(spark, d), D.ontology(spark, d), "density_w", "vol_w")


@query("subtree_statistics", f"""
  WITH per AS (SELECT c.ancestor, l.dataset, count(*) AS n, avg(l.vols) AS v FROM labelled l JOIN closure c ON c.descendant = l.label
               GROUP BY ALL)
  SELECT ancestor AS ids, round(avg(n), 6) AS n_objects, round(avg(v), 6) AS mean_vols,
         round(CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) END, 6) AS sem_vols FROM per GROUP BY ancestor""", "labelled closure")
def subtree_statistics(spark, d):
    lab = R.label_cells(D.cells(spark, d).drop("cell_id"), D.atlas(spark, d), ("label",))
    return G.subtree_stats(lab, D.ontology(spark, d), ["vols"], on="label")


@query("regions_to_show", f"""
  WITH m AS (SELECT acronym, CAST(st_level AS BIGINT) AS st_level, avg(density_w) AS density_w FROM pooled GROUP BY ALL)
  SELECT acronym, st_level, round(density_w, 6) AS density_w FROM m
  WHERE acronym IN (SELECT o.acronym FROM closure c JOIN ontology r ON r.ids = c.ancestor JOIN ontology o ON o.ids = c.descendant
                    WHERE r.names = 'root' AND NOT regexp_full_match(o.acronym, 'N1|N2'))
    AND density_w IS NOT NULL AND st_level > 5 AND st_level < 9""", "pooled closure ontology")
def regions_to_show(spark, d):
    m = D.pooled(spark, d).groupBy("acronym", "st_level").agg(F.avg("density_w").alias("density_w"))
    return G.regions_to_show(m, D.ontology(spark, d), "root", remove="N1|N2")


@query("regions_by_depth", "SELECT ids, CAST(st_level AS BIGINT) AS st_level FROM ontology", "ontology")
def regions_by_depth(spark, d):
    return G.by_depth(D.ontology(spark, d).select("ids", "st_level"))


@query("find_regions", "SELECT ids, names FROM ontology WHERE contains(lower(names), 'america') OR contains(lower(names), 'nation_1')", "ontology")
def find_regions(spark, d):
    return G.find_regions(D.ontology(spark, d), ["america", "nation_1"]).select("ids", "names")


@query("regions_with_brain", "SELECT r.dataset, r.ids, r.num_w, b.exp, b.sex, CAST(b.age AS BIGINT) AS age FROM region_counts_t r JOIN brains b USING (dataset)",
       "region_counts_t brains")
def regions_with_brain(spark, d):
    return R.with_brain(D.region_table(spark, d), D.brains(spark, d)).select("dataset", "ids", "num_w", "exp", "sex", "age")


@query("brains_in_list_order", """
  WITH w AS (SELECT unnest([7, 3, 12, 99, 0]) AS num, unnest(range(5)) AS pos)
  SELECT b.num, w.pos, b.dataset, b.exp, c.n AS n_cells FROM w JOIN brains b ON b.num = w.num
  LEFT JOIN (SELECT dataset, count(*) AS n FROM cells GROUP BY dataset) c ON c.dataset = b.dataset""", "brains cells")
def brains_in_list_order(spark, d):
    b = R.select_brains(D.brains(spark, d), [7, 3, 12, 99, 0])
    n = D.cells(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_cells"))
    return b.join(n, "dataset", "left").select("num", "pos", "dataset", "exp", "n_cells")


@query("stats_on_ontology", """
  SELECT o.ids, o.acronym, s.n AS n_cells, round(s.v, 6) AS mean_vols FROM ontology o
  LEFT JOIN (SELECT label, count(*) AS n, avg(vols) AS v FROM labelled GROUP BY label) s ON s.label = o.ids""", "ontology labelled")
def stats_on_ontology(spark, d):
    lab = R.label_cells(D.cells(spark, d).drop("cell_id"), D.atlas(spark, d), ("label",))
    s = lab.groupBy(F.col("label").alias("ids")).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("vols").alias("mean_vols"))
    return R.merge_stats(D.ontology(spark, d).select("ids", "acronym"), s)


@query("group_contrast", """
  WITH g AS (SELECT acronym, avg(density_w) FILTER (exp = 'P60') AS a, avg(density_w) FILTER (exp = 'Cuprizone') AS b,
                    avg(density_w) FILTER (exp = 'FVB') AS c FROM pooled GROUP BY acronym)
  SELECT acronym, round(a, 6) AS value_a, round(b, 6) AS value_b, round(b - a, 6) AS difference,
         round((b - a) / nullif(a, 0), 6) AS relative, round(c, 6) AS value_other FROM g
  WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""", "pooled")
def group_contrast(spark, d):
    from somagrid.operators.stats import group_contrast as gc

    return gc(D.pooled(spark, d), "acronym", "exp", "density_w", "P60", "Cuprizone", "FVB")


@query("match_regions_full", "SELECT dataset, acronym, round(density_w, 6) AS density_w FROM pooled WHERE regexp_full_match(acronym, 'N1|N2|R.')", "pooled")
def match_regions_full(spark, d):
    return S.match_regions(D.pooled(spark, d), "N1|N2|R.").select("dataset", "acronym", "density_w")


@query("match_regions_part", """
  SELECT dataset, acronym, round(density_w, 6) AS density_w FROM pooled WHERE regexp_matches(acronym, 'N1') AND NOT regexp_matches(acronym, 'N14')""", "pooled")
def match_regions_part(spark, d):
    p = S.match_regions(D.pooled(spark, d), "N1", "contains")
    return S.match_regions(p, "N14", "contains", keep=False).select("dataset", "acronym", "density_w")


@query("layer_filter", "SELECT dataset, names, round(density_w, 6) AS density_w FROM pooled WHERE contains(names, '2/3') AND acronym LIKE 'N%'", "pooled")
def layer_filter(spark, d):
    return S.layer_filter(D.pooled(spark, d), "2/3").filter("acronym LIKE 'N%'").select("dataset", "names", "density_w")


@query("parse_layer", """
  SELECT ids, trim(rtrim(before, ', ')) AS macro, layer, CAST(list_position(['L1', 'L2/3', 'L4', 'L5', 'L6a', 'L6b'], layer) AS BIGINT) AS layer_order FROM (
   SELECT ids, 'L' || trim(string_split(lower(names), 'layer')[-1]) AS layer,
         left(names, length(names) - length(string_split(lower(names), 'layer')[-1]) - 5) AS before
   FROM ontology WHERE contains(lower(names), 'layer'))
  WHERE list_position(['L1', 'L2/3', 'L4', 'L5', 'L6a', 'L6b'], layer) > 0 AND rtrim(before, ', ') <> before""", "ontology")
def parse_layer(spark, d):
    return S.parse_layer(D.ontology(spark, d)).select("ids", "macro", "layer", "layer_order")


@query("region_cell_location", """
  SELECT c.cell_id, CASE WHEN a.label > 0 AND a.label % 2 = 0 THEN 'GM' ELSE 'WM' END AS location FROM cells c LEFT JOIN atlas a USING (z, y, x)""",
       "cells atlas")
def region_cell_location(spark, d):
    a = D.atlas(spark, d)
    return R.tag_location(D.cells(spark, d), a.filter("label % 2 = 0")).select("cell_id", "location")


@query("composite_atlas", """
  WITH ids AS MATERIALIZED (SELECT DISTINCT descendant AS label FROM closure JOIN ontology ON ontology.ids = ancestor WHERE acronym IN ('N1', 'N2', 'N5')),
       new AS MATERIALIZED (SELECT z, y, x - 1 AS x, label FROM atlas JOIN ids USING (label) WHERE x >= 1)
  SELECT z, y, x, label FROM new
  UNION ALL SELECT z, y, x, label FROM (SELECT * FROM atlas ANTI JOIN ids USING (label)) ANTI JOIN new USING (z, y, x)""", "atlas closure ontology")
def composite_atlas(spark, d):
    a = D.atlas(spark, d)
    alt = a.filter("x >= 1").withColumn("x", F.col("x") - 1)
    return R.overlay_atlas(a, alt, G.subtree_ids(D.ontology(spark, d), ["N1", "N2", "N5"], "acronym"))


@query("composite_field", """
  WITH ids AS MATERIALIZED (SELECT DISTINCT descendant AS label FROM closure JOIN ontology ON ontology.ids = ancestor WHERE acronym IN ('N1', 'N2', 'N5')),
       spots AS MATERIALIZED (SELECT z, y, x - 1 AS x FROM atlas JOIN ids USING (label) WHERE x >= 1),
       new AS MATERIALIZED (SELECT z, y, x, d0, d1, d2::DOUBLE + 0.05 AS d2 FROM field SEMI JOIN spots USING (z, y, x))
  SELECT z, y, x, round(d0::DOUBLE, 6) AS d0, round(d1::DOUBLE, 6) AS d1, round(d2, 6) AS d2 FROM new
  UNION ALL SELECT z, y, x, round(d0::DOUBLE, 6), round(d1::DOUBLE, 6), round(d2::DOUBLE, 6) FROM field ANTI JOIN new USING (z, y, x)""", "atlas field closure ontology")
def composite_field(spark, d):
    alt = D.atlas(spark, d).filter("x >= 1").withColumn("x", F.col("x") - 1)
    f = D.field(spark, d)
    return R.overlay_field(f, f.withColumn("d2", F.col("d2") + 0.05), alt, G.subtree_ids(D.ontology(spark, d), ["N1", "N2", "N5"], "acronym"))


@query("label_intensity", """
  SELECT label, round(avg(value), 6) AS mean, round(sum(value), 6) AS total, count(value) AS n
  FROM voxels JOIN atlas USING (z, y, x) WHERE label > 0 GROUP BY label""", "voxels atlas")
def label_intensity(spark, d):
    return R.label_stats(D.voxels(spark, d), D.atlas(spark, d))


@query("label_intensity_floor", """
  SELECT label, round(avg(v), 6) AS mean, round(sum(v), 6) AS total, count(v) AS n
  FROM (SELECT label, CASE WHEN value >= 20 THEN value END AS v FROM voxels JOIN atlas USING (z, y, x) WHERE label > 0) GROUP BY label""",
       "voxels atlas")
def label_intensity_floor(spark, d):
    return R.label_stats(D.voxels(spark, d), D.atlas(spark, d), floor=20)


@query("painted_density", """
  WITH n AS (SELECT label, count(*) AS n FROM labelled WHERE label > 0 GROUP BY label),
       v AS (SELECT label, count(*) AS v FROM atlas WHERE label > 0 GROUP BY label)
  SELECT z, y, x, label, round(coalesce(n.n, 0) / (v.v * 8e-6), 6) AS density FROM atlas JOIN v USING (label) LEFT JOIN n USING (label)""",
       "labelled atlas")
def painted_density(spark, d):
    return R.paint_density(D.cells(spark, d), D.atlas(spark, d))


@query("top_regions", """
  WITH m AS (SELECT acronym, avg(density_w) AS density, avg(density_large_w) AS large FROM pooled WHERE st_level = 9 GROUP BY acronym),
       c AS (SELECT * FROM m WHERE density IS NOT NULL AND large IS NOT NULL),
       b AS (SELECT * FROM (SELECT acronym FROM c ORDER BY density, acronym LIMIT 10) UNION SELECT acronym FROM c WHERE acronym IN ('S3', 'S5')),
       t AS (SELECT acronym FROM c ORDER BY large DESC, acronym LIMIT 10)
  SELECT acronym, round(density, 6) AS density, round(large, 6) AS large,
         CASE WHEN acronym IN (FROM t) THEN 'top large' ELSE 'low density' END AS category
  FROM c WHERE acronym IN (FROM b) OR acronym IN (FROM t)""", "pooled")
def top_regions(spark, d):
    m = D.pooled(spark, d).filter("st_level = 9").groupBy("acronym").agg(
        F.avg("density_w").alias("density"), F.avg("density_large_w").alias("large")
    )
    return X.top_regions(m, 10, "density", "large", ["S3", "S5"])


@query("rank_regions", """
  SELECT acronym, round(m, 6) AS mean, rank() OVER (ORDER BY m DESC) AS rank FROM (
    SELECT acronym, avg(density_w) AS m FROM pooled WHERE st_level = 7 AND density_w IS NOT NULL GROUP BY acronym)""", "pooled")
def rank_regions(spark, d):
    from somagrid.operators.stats import rank_regions as rr

    return rr(D.pooled(spark, d).filter("st_level = 7 AND density_w IS NOT NULL"), "acronym", "density_w")
