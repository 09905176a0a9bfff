"""Queries on group statistics: tests, correlations, curves, layers, genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from somagrid.functions import scalars as S
from somagrid.operators import ordered as O, reshape as X, stats as Q
from somagrid.registry import derived as D
from somagrid.registry.base import query


def t_sql(t: str, df: str) -> str:
    """Two-sided Student p by the finite series, with gamma coefficients."""
    th = f"atan(abs({t}) / sqrt({df}))"
    odd = (f"(2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda k: "
           f"exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos({th}), 2 * k + 1))), 0)))")
    even = (f"(sin({th}) * list_sum(list_transform(range(0, {df} // 2), lambda k: "
            f"exp(lgamma(2 * k + 1) - k * ln(4) - 2 * lgamma(k + 1)) * pow(cos({th}), 2 * k))))")
    return f"CASE WHEN {df} < 1 OR {t} IS NULL THEN NULL WHEN {df} % 2 = 1 THEN greatest(0, 1 - {odd}) ELSE greatest(0, 1 - {even}) END"


def z_sql(z: str) -> str:
    return (f"greatest(0, 1 - 2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: "
            f"pow({z}, 2 * k + 1) * exp(k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))))")


def r_sql(r: str, n: str) -> str:
    t = f"(({r}) * sqrt({n} - 2) / sqrt(1 - ({r}) * ({r})))"
    return f"CASE WHEN {n} < 3 OR {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0 ELSE {t_sql(t, f'({n} - 2)')} END"


TTEST = f"""
  SELECT region, n1, n2, mean_x1, mean_x2, t, df, {t_sql('t', 'df')} AS p_val FROM (
    SELECT *, n1 + n2 - 2 AS df, (mean_x1 - mean_x2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t
    FROM (SELECT region, count(value) FILTER (grp = 'F') AS n1, count(value) FILTER (grp = 'O') AS n2,
                 avg(value) FILTER (grp = 'F') AS mean_x1, avg(value) FILTER (grp = 'O') AS mean_x2,
                 var_samp(value) FILTER (grp = 'F') AS v1, var_samp(value) FILTER (grp = 'O') AS v2 FROM samples GROUP BY region))"""


@query("ttest", f"SELECT region, n1, n2, round(mean_x1, 6) AS mean_x1, round(mean_x2, 6) AS mean_x2, round(t, 6) AS t, df, round(p_val, 6) AS p_val FROM ({TTEST})", "samples")
def ttest(spark, d):
    return Q.ttest(D.samples(spark, d), ["region"], "grp", "value", "F", "O")


GAPS = """
  SELECT region, count(v) FILTER (grp = 'F') AS n1, count(v) FILTER (grp = 'O') AS n2, avg(v) FILTER (grp = 'F') AS mean_x1,
         avg(v) FILTER (grp = 'O') AS mean_x2, var_samp(v) FILTER (grp = 'F') AS v1, var_samp(v) FILTER (grp = 'O') AS v2,
         count(*) FILTER (grp IN ('F', 'O') AND v IS NULL) AS gaps
  FROM (SELECT region, grp, CASE WHEN value > (SELECT quantile_disc(value, 0.001) FROM samples) THEN value END AS v FROM samples) GROUP BY region"""
GAPS_T = f"""SELECT *, n1 + n2 - 2 AS df, (mean_x1 - mean_x2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM ({GAPS})"""


@query("ttest_with_gaps", f"""
  SELECT region, n1, n2, CASE WHEN gaps = 0 THEN round({t_sql('t', 'df')}, 6) END AS p_val, round({t_sql('t', 'df')}, 6) AS p_skip FROM ({GAPS_T})""", "samples")
def ttest_with_gaps(spark, d):
    s = D.samples(spark, d)
    low = s.agg(F.expr("percentile_disc(0.001) WITHIN GROUP (ORDER BY value)")).scalar()
    s = s.withColumn("v", F.when(F.col("value") > low, F.col("value")))
    skip = Q.ttest(s, ["region"], "grp", "v", "F", "O", missing="skip").select("region", F.col("p_val").alias("p_skip"))
    return Q.ttest(s, ["region"], "grp", "v", "F", "O").select("region", "n1", "n2", "p_val").join(skip, "region")


@query("ttest_adjusted", f"""
  WITH t AS ({TTEST}),
       r AS (SELECT region, p_val, p_val * count(*) OVER () / row_number() OVER (ORDER BY p_val) AS q FROM t)
  SELECT region, round(p_val, 6) AS p_val,
         round(least(1, min(q) OVER (ORDER BY p_val RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r""", "samples")
def ttest_adjusted(spark, d):
    t = Q.ttest(D.samples(spark, d), ["region"], "grp", "value", "F", "O").select("region", "p_val")
    return Q.bh_adjust(t, "p_val")


@query("volcano", f"""
  WITH g AS (SELECT ids, acronym, count(density_w) FILTER (exp = 'P60') AS n1, count(density_w) FILTER (exp = 'Cuprizone') AS n2,
       avg(density_w) FILTER (exp = 'P60') AS x1, avg(density_w) FILTER (exp = 'Cuprizone') AS x2,
       CASE WHEN count(*) FILTER (exp = 'P60' AND density_w IS NULL) = 0 THEN var_samp(density_w) FILTER (exp = 'P60') END AS v1,
       CASE WHEN count(*) FILTER (exp = 'Cuprizone' AND density_w IS NULL) = 0 THEN var_samp(density_w) FILTER (exp = 'Cuprizone') END AS v2
     FROM pooled WHERE st_level <= 9 GROUP BY ids, acronym HAVING count(density_w) > 0),
   t AS (SELECT *, n1 + n2 - 2 AS df, (x1 - x2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)
       * (1.0 / nullif(n1, 0) + 1.0 / nullif(n2, 0))), 0) AS t FROM g),
   p AS (SELECT *, {t_sql('t', 'df')} AS p_val, CASE WHEN x1 > 0 AND x2 > 0 THEN log2(x2) - log2(x1) END AS lf FROM t)
  SELECT ids, acronym, round(x1, 6) AS mean_x1, round(x2, 6) AS mean_x2, round(t, 6) AS t, df, round(p_val, 6) AS p_val,
    round(round(x2 / nullif(x1, 0), 9), 6) AS fold_change, round(x2 - x1, 6) AS abs_change, round(lf, 6) AS log2fold,
    round(CASE WHEN p_val > 0 THEN -log10(p_val) END, 6) AS neg_log10_p,
    CASE WHEN p_val < 0.01 AND lf > 0.3 THEN 'up' WHEN p_val < 0.01 AND lf < -0.3 THEN 'down' ELSE 'none' END AS change_type FROM p""", "pooled")
def volcano(spark, d):
    return Q.volcano(D.pooled(spark, d), "exp", "P60", "Cuprizone").drop("n1", "n2").withColumn(
        "fold_change", F.round("fold_change", 9))  # simple fractions: settle the last bit before the final rounding


@query("left_right_correlation", f"""
  WITH a AS (SELECT dataset, count(*) AS n, CASE WHEN count(*) > 1 THEN corr(density_l, density_r) END AS r FROM pooled
             WHERE density_l IS NOT NULL AND density_r IS NOT NULL GROUP BY dataset),
       b AS (SELECT dataset, n, greatest(-1, least(1, CASE WHEN isnan(r) THEN NULL ELSE r END)) AS r FROM a)
  SELECT dataset, n, round(r, 6) AS r, round({r_sql('r', 'n')}, 6) AS p_val FROM b""", "pooled")
def left_right_correlation(spark, d):
    return Q.pearson(D.pooled(spark, d), ["dataset"], "density_l", "density_r")


RANKED = """
  SELECT region, value, other, rank() OVER (PARTITION BY region ORDER BY value)
           + (count(*) OVER (PARTITION BY region, value) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY region ORDER BY other) + (count(*) OVER (PARTITION BY region, other) - 1) / 2.0 AS ry FROM samples"""


@query("spearman", f"""
  SELECT region, n, round(rho, 6) AS rho, round({r_sql('rho', 'n')}, 6) AS p_val FROM (
    SELECT region, count(*) AS n, corr(rx, ry) AS rho FROM ({RANKED}) GROUP BY region)""", "samples")
def spearman(spark, d):
    return Q.spearman(D.samples(spark, d), ["region"], "value", "other")


@query("straight_line_fit", f"""
  SELECT region, n, round(slope, 6) AS slope, round(icpt, 6) AS intercept, round(r, 6) AS r, round({r_sql('r', 'n')}, 6) AS p_val,
         round(sqrt((1 - r * r) * syy / (sxx * (n - 2))), 6) AS stderr FROM (
    SELECT region, count(*) AS n, regr_slope(value, other) AS slope, regr_intercept(value, other) AS icpt, corr(other, value) AS r,
           regr_sxx(value, other) AS sxx, regr_syy(value, other) AS syy FROM samples GROUP BY region)""", "samples")
def straight_line_fit(spark, d):
    return Q.linfit(D.samples(spark, d), ["region"], "other", "value")


@query("mannwhitney", f"""
  WITH r AS (SELECT region, grp, value, rank() OVER (PARTITION BY region ORDER BY value)
                    + (count(*) OVER (PARTITION BY region, value) - 1) / 2.0 AS rk FROM samples WHERE grp IN ('F', 'P')),
       ties AS (SELECT region, sum(c * c * c - c) AS ties FROM (SELECT region, value, count(*)::DOUBLE AS c FROM r GROUP BY ALL) GROUP BY region),
       s AS (SELECT region, count(*) FILTER (grp = 'F') AS n1, count(*) FILTER (grp = 'P') AS n2, sum(rk) FILTER (grp = 'F') AS r1
             FROM r GROUP BY region),
       u AS (SELECT region, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS u,
               sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS sd FROM s JOIN ties USING (region)),
       z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sd AS z FROM u)
  SELECT region, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(CASE WHEN z < 0 THEN 1 ELSE {z_sql('z')} END, 6) AS p_val,
         'normal' AS method FROM z""", "samples")
def mannwhitney(spark, d):
    return Q.mannwhitney(D.samples(spark, d), ["region"], "grp", "value", "F", "P")


@query("group_median", "SELECT region, grp, round(median(value), 6) AS median, round(median(ln(1 + value)), 6) AS median_log FROM samples GROUP BY ALL", "samples")
def group_median(spark, d):
    s = D.samples(spark, d).withColumn("log", F.log1p("value"))
    a = O.exact_median(s, ["region", "grp"], "value")
    return a.join(O.exact_median(s, ["region", "grp"], "log", "median_log"), ["region", "grp"])


@query("gene_screen", f"""
  WITH e AS (SELECT region_id, gene_id, avg(value) AS value FROM expression GROUP BY ALL),
       den AS (SELECT ids AS region_id, avg(density_w) AS density_w FROM pooled GROUP BY ids),
       a AS (SELECT gene_id, count(*) AS n, greatest(-1, least(1, corr(value, density_w))) AS r FROM e JOIN den USING (region_id)
             WHERE density_w IS NOT NULL GROUP BY gene_id HAVING count(*) > 2),
       p AS (SELECT gene_id, n, r, {r_sql('r', 'n')} AS p_val FROM a),
       q AS (SELECT *, p_val * count(*) OVER () / row_number() OVER (ORDER BY p_val) AS q FROM p)
  SELECT gene_id, n, round(r, 6) AS r, round(p_val, 6) AS p_val,
         round(least(1, min(q) OVER (ORDER BY p_val RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM q""",
       "expression pooled")
def gene_screen(spark, d):
    dens = D.pooled(spark, d).groupBy(F.col("ids").alias("region_id")).agg(F.avg("density_w").alias("density_w"))
    return Q.gene_screen(Q.collapse_genes(D.expression(spark, d)), dens)


@query("collapse_genes", "SELECT region_id, gene_id, round(avg(value), 6) AS value FROM expression GROUP BY ALL", "expression")
def collapse_genes(spark, d):
    return Q.collapse_genes(D.expression(spark, d))


@query("merge_expression", """
  WITH e AS (SELECT region_id, avg(value) AS value FROM expression GROUP BY region_id),
       n AS (SELECT label AS region_id, count(*) AS n_cells FROM labelled WHERE label <> 1001 GROUP BY label)
  SELECT region_id, round(value, 6) AS value, n_cells FROM e FULL JOIN n USING (region_id)""", "expression labelled")
def merge_expression(spark, d):
    from somagrid.operators.regions import label_cells

    e = D.expression(spark, d).groupBy("region_id").agg(F.avg("value").alias("value"))
    lab = label_cells(D.cells(spark, d).select("z", "y", "x"), D.atlas(spark, d), ("label",)).filter("label <> 1001")
    return Q.merge_expression(e, lab.groupBy(F.col("label").alias("region_id")).agg(F.count(F.lit(1)).alias("n_cells")))


@query("name_genes", """
  WITH conv AS (SELECT p_partkey % 97 AS entrez, p_name AS gene_name, p_partkey AS row FROM part),
       a AS (SELECT * FROM conv QUALIFY row_number() OVER (PARTITION BY entrez ORDER BY row) = 1),
       b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY gene_name ORDER BY row) = 1)
  SELECT g.gene_id, round(g.m, 6) AS m, b.gene_name FROM (SELECT gene_id, avg(value) AS m FROM expression GROUP BY gene_id) g
  JOIN b ON b.entrez = g.gene_id""", "expression")
def name_genes(spark, d):
    conv = D.table(spark, d, "part").select(
        (F.col("p_partkey") % 97).alias("entrez"), F.col("p_name").alias("gene_name"), F.col("p_partkey").alias("row")
    )
    g = D.expression(spark, d).groupBy("gene_id").agg(F.avg("value").alias("m"))
    return Q.name_genes(g, conv)


@query("top_genes", """
  SELECT gene_id, round(m, 6) AS r FROM (SELECT gene_id, avg(value) AS m FROM expression GROUP BY gene_id) ORDER BY m DESC, gene_id LIMIT 10""", "expression")
def top_genes(spark, d):
    return Q.top_genes(D.expression(spark, d).groupBy("gene_id").agg(F.avg("value").alias("r")), 10)


@query("region_means", """
  SELECT ids, acronym, round(avg(density_w), 6) AS density_w, round(avg(density_l), 6) AS density_l, round(avg(num_w), 6) AS num_w
  FROM pooled GROUP BY ids, acronym""", "pooled")
def region_means(spark, d):
    return Q.region_means(D.pooled(spark, d), ["ids", "acronym"], ["density_w", "density_l", "num_w"])


CV = """SELECT parent AS area, acronym, avg(density_w) AS mean, CASE WHEN count(density_w) > 1 THEN stddev_samp(density_w) END AS std
        FROM pooled WHERE st_level = 9 GROUP BY ALL"""


@query("region_cv", f"""
  SELECT area, acronym, round(mean, 6) AS mean, round(std, 6) AS std, round(std / nullif(mean, 0), 6) AS cv,
         coalesce(std / nullif(mean, 0) > 0.3, false) AS outlier FROM ({CV})""", "pooled")
def region_cv(spark, d):
    return Q.region_cv(D.pooled(spark, d).filter("st_level = 9").withColumn("area", F.col("parent")), "area", "acronym", "density_w")


@query("area_cv", f"""
  WITH c AS (SELECT area, std / nullif(mean, 0) AS cv FROM ({CV}))
  SELECT area, round(avg(cv), 6) AS mean_cv, round(CASE WHEN count(cv) > 1 THEN stddev_samp(cv) / sqrt(count(cv)) END, 6) AS sem_cv,
         count(cv) AS n FROM c GROUP BY area""", "pooled")
def area_cv(spark, d):
    cv = Q.region_cv(D.pooled(spark, d).filter("st_level = 9").withColumn("area", F.col("parent")), "area", "acronym", "density_w")
    return Q.area_cv(cv, "area")


@query("age_curve", """
  SELECT acronym, CAST(age AS BIGINT) AS age, round(avg(density_w), 6) AS mean,
         round(CASE WHEN count(density_w) > 1 THEN stddev_samp(density_w) / sqrt(count(density_w)) END, 6) AS sem, count(density_w) AS n
  FROM pooled GROUP BY acronym, age""", "pooled")
def age_curve(spark, d):
    return Q.age_curve(D.pooled(spark, d), ["acronym", "age"], "density_w")


@query("standard_error", """
  SELECT region, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM samples GROUP BY region""", "samples")
def standard_error(spark, d):
    return D.samples(spark, d).groupBy("region").agg(Q.sem("value").alias("sem"))


@query("change_from_baseline", """
  WITH b AS (SELECT acronym, avg(density_w) FILTER (exp = 'P60') AS baseline FROM pooled GROUP BY acronym)
  SELECT dataset, acronym, round(density_w, 6) AS density_w, round(baseline, 6) AS baseline,
         round(density_w / nullif(baseline, 0), 6) AS fold_change, round(density_w - baseline, 6) AS raw_change FROM pooled JOIN b USING (acronym)""", "pooled")
def change_from_baseline(spark, d):
    return Q.vs_baseline(D.pooled(spark, d).select("dataset", "acronym", "density_w", "exp"), ["acronym"], "density_w", F.col("exp") == "P60").drop("exp")


def _layer_sql(src: str) -> str:
    return f"""SELECT dataset, area, layer, sum(num_w) AS num_w, sum(vol_w) AS vol_w, sum(num_w) / nullif(sum(vol_w), 0) AS density
      FROM {src}, (SELECT unnest(['N1', 'N', 'RSP']) AS area) a, (SELECT unnest(['1', '2/3', '4', '5', '6']) AS layer) l
      WHERE st_level = 7 AND contains(acronym, area) AND contains(names, layer) GROUP BY dataset, area, layer"""


@query("layer_density", f"SELECT dataset, area, layer, CAST(num_w AS BIGINT) AS num_w, round(vol_w, 6) AS vol_w, round(density, 6) AS density FROM ({_layer_sql('pooled')})", "pooled")
def layer_density(spark, d):
    return Q.layer_density(D.pooled(spark, d).filter("st_level = 7"), ["N1", "N", "RSP"])


@query("layer_density_over_baseline", f"""
  WITH p AS ({_layer_sql('pooled')}), b AS (SELECT area, layer, avg(density) AS b FROM ({_layer_sql("(SELECT * FROM pooled WHERE exp = 'P60')")}) GROUP BY area, layer)
  SELECT dataset, area, layer, round(density / nullif(b, 0), 6) AS density FROM p LEFT JOIN b USING (area, layer)""", "pooled")
def layer_density_over_baseline(spark, d):
    p = D.pooled(spark, d).filter("st_level = 7")
    return Q.layer_density(p, ["N1", "N", "RSP"], base=p.filter("exp = 'P60'")).select("dataset", "area", "layer", "density")


# layer profiles: macro region from the parent, gene value from the leaf regions
PROFILE = """
  SELECT macro, layer, layer_order, gene_id, avg(value) AS value, avg(density_w) AS density_w FROM (
    SELECT p.parent % 3 AS macro, trim(regexp_extract(n.names, 'layer (.*)$', 1)) AS layer,
           list_position(['1', '2/3', '4', '5', '6a', '6b'], trim(regexp_extract(n.names, 'layer (.*)$', 1))) AS layer_order,
           e.gene_id, e.value, p.density_w
    FROM (SELECT ids, names, parent, avg(density_w) AS density_w FROM pooled WHERE st_level = 7 GROUP BY ALL) p
    JOIN ontology n ON n.ids = p.ids JOIN ontology s ON s.parent = n.ids
    JOIN (SELECT region_id, gene_id, avg(value) AS value FROM expression GROUP BY ALL) e ON e.region_id = s.ids)
  WHERE layer_order > 0 GROUP BY ALL"""


def _profile(spark, d):
    p = D.pooled(spark, d).filter("st_level = 7").groupBy("ids", "names", "parent").agg(F.avg("density_w").alias("density_w"))
    p = S.parse_layer(p).withColumn("macro", F.col("parent") % 3)
    leaf = D.ontology(spark, d).select(F.col("ids").alias("region_id"), F.col("parent").alias("ids"))
    e = Q.collapse_genes(D.expression(spark, d)).join(leaf, "region_id")
    return Q.layer_profiles(e.join(p.select("ids", "macro", "layer", "layer_order", "density_w"), "ids"), ["value", "density_w"],
                            ("macro", "layer", "layer_order", "gene_id"))


@query("layer_profiles", f"SELECT macro, 'L' || layer AS layer, gene_id, round(value, 6) AS value, round(density_w, 6) AS density_w FROM ({PROFILE})",
       "pooled ontology expression")
def layer_profiles(spark, d):
    return _profile(spark, d).drop("layer_order")


@query("layer_zscore", f"""
  SELECT macro, 'L' || layer AS layer, gene_id, round(CASE WHEN count(value) OVER w >= 2 THEN
    (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) END, 6) AS z FROM ({PROFILE}) WINDOW w AS (PARTITION BY macro, gene_id)""",
       "pooled ontology expression")
def layer_zscore(spark, d):
    return Q.zscore(_profile(spark, d), ["macro", "gene_id"], "value").select("macro", "layer", "gene_id", "z")


@query("laminar_match", f"""
  SELECT macro, gene_id, n, round(r, 6) AS r FROM (SELECT macro, gene_id, count(*) AS n, corr(value, density_w) AS r FROM ({PROFILE})
    WHERE value IS NOT NULL AND density_w IS NOT NULL GROUP BY macro, gene_id HAVING count(*) >= 4 AND var_pop(value) > 0 AND var_pop(density_w) > 0)
  ORDER BY r DESC, gene_id LIMIT 20""", "pooled ontology expression")
def laminar_match(spark, d):
    return Q.laminar_match(_profile(spark, d), "gene_id", "value", "density_w", 20, keys=["macro"])


@query("interpolate_layers", """
  WITH s AS (SELECT user_id AS series, event_type, avg(value) AS v FROM events GROUP BY ALL),
       g AS (SELECT u.series, t.pos, CASE WHEN s.v > 50 THEN NULL ELSE s.v END AS v FROM (SELECT DISTINCT user_id AS series FROM events) u
             CROSS JOIN (SELECT unnest(['click','error','purchase','signup','view']) AS event_type, unnest(range(5)) AS pos) t
             LEFT JOIN s ON s.series = u.series AND s.event_type = t.event_type),
       n AS (SELECT series, pos, v, (SELECT max(pos) FROM g b WHERE b.series = g.series AND b.pos <= g.pos AND b.v IS NOT NULL) AS pb,
             (SELECT min(pos) FROM g a WHERE a.series = g.series AND a.pos >= g.pos AND a.v IS NOT NULL) AS pa FROM g)
  SELECT n.series, n.pos, round(CASE WHEN n.v IS NOT NULL THEN n.v WHEN pb IS NULL THEN a.v WHEN pa IS NULL THEN b.v
         ELSE b.v + (a.v - b.v) * (n.pos - pb) / (pa - pb) END, 6) AS filled
  FROM n LEFT JOIN g a ON a.series = n.series AND a.pos = pa LEFT JOIN g b ON b.series = n.series AND b.pos = pb""")
def interpolate_layers(spark, d):
    e = D.table(spark, d, "events")
    s = e.groupBy(F.col("user_id").alias("series"), "event_type").agg(F.avg("value").alias("v"))
    names = F.array(*[F.lit(v) for v in ("click", "error", "purchase", "signup", "view")])
    grid = e.select(F.col("user_id").alias("series")).distinct().select("series", F.posexplode(names).alias("pos", "event_type"))
    g = grid.join(s, ["series", "event_type"], "left").withColumn("v", F.when(F.col("v") <= 50, F.col("v")))
    return Q.interpolate(g, ["series"], "pos", "v").select("series", "pos", "filled")


@query("side_asymmetry", """
  SELECT dataset, ids, CAST(abs(num_l - num_r) AS BIGINT) AS abs_diff, round(abs(num_l - num_r) / nullif(num_w, 0), 6) AS scaled_diff FROM region_counts_t""", "region_counts_t")
def side_asymmetry(spark, d):
    return S.asymmetry(D.region_table(spark, d), "num_l", "num_r", "num_w").select("dataset", "ids", "abs_diff", "scaled_diff")


@query("percent_below", """
  SELECT region, grp, threshold, round(100.0 * count(*) FILTER (value <= threshold) / count(*), 6) AS percent
  FROM samples, (SELECT unnest([1000.0, 100000.0, 250000.0]::DOUBLE[]) AS threshold) GROUP BY ALL""", "samples")
def percent_below(spark, d):
    return Q.percent_below(D.samples(spark, d), ["region", "grp"], "value", [1000, 100000, 250000])


@query("percent_change", """
  WITH b AS (SELECT region, avg(value) AS c FROM samples WHERE grp = 'O' GROUP BY region)
  SELECT sample, round(100 * (value - c) / nullif(c, 0), 6) AS pct FROM samples JOIN b USING (region)""", "samples")
def percent_change(spark, d):
    s = D.samples(spark, d)
    b = s.filter("grp = 'O'").groupBy("region").agg(F.avg("value").alias("c"))
    return s.join(b, "region").select("sample", S.pct_change("value", "c").alias("pct"))


@query("melted_sides", """
  SELECT dataset, ids, side, round(value, 6) AS value FROM pooled UNPIVOT INCLUDE NULLS (value FOR side IN (density_l, density_r))""", "pooled")
def melted_sides(spark, d):
    return X.melt(D.pooled(spark, d), ["dataset", "ids"], ["density_l", "density_r"])


@query("zero_baseline", """
  SELECT acronym, 'P0' AS exp, 0::BIGINT AS age, 0.0::DOUBLE AS density_w FROM (SELECT DISTINCT acronym FROM pooled)
  UNION ALL SELECT acronym, exp, CAST(age AS BIGINT), round(coalesce(density_w, 0), 6) FROM pooled""", "pooled")
def zero_baseline(spark, d):
    return X.add_zero(D.pooled(spark, d), ["acronym"], ["density_w"], {"exp": "P0", "age": 0})


@query("recoded_groups", """
  SELECT CASE WHEN exp IN ('P60', 'FVB') THEN 'young' WHEN exp IN ('P240', 'P620') THEN 'old' ELSE 'treated' END AS cohort,
         CASE sex WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' END AS label, round(avg(density_w), 6) AS density_w, count(*) AS n
  FROM pooled GROUP BY ALL""", "pooled")
def recoded_groups(spark, d):
    p = D.pooled(spark, d)
    return p.groupBy(
        X.recode("exp", {"young": ["P60", "FVB"], "old": ["P240", "P620"]}, "treated").alias("cohort"),
        X.recode("sex", {"male": ["M"], "female": ["F"]}).alias("label"),
    ).agg(F.avg("density_w").alias("density_w"), F.count(F.lit(1)).alias("n"))


@query("group_table", """
  SELECT c_nationkey::BIGINT AS region, round(avg(o_totalprice), 6) AS value, count(*) AS n, round(max(o_totalprice), 6) AS top
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY region""")
def group_table(spark, d):
    from somagrid.operators.grouped import grouped_stats

    return grouped_stats(D.samples(spark, d), "region", "value")
