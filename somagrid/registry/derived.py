"""Cell-map tables derived from the given tables, as DataFrames and as SQL.

Everything grows with its source table: the volume gets more z planes with
more parts, cells and intensities come from order lines, boxes and trace trees
from orders, tracks from events, expression values from embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from somagrid.session import shared_out, spread

SIDE = 32          # y and x extent of the derived volume
PLANE_PARTS = 8    # parts per z plane
TASK_PARTS = 8192  # parts whose planes one task makes (about a million voxels)
RES = 25.0         # micrometres per voxel
TREE = 256         # trace nodes per tree

SQL: dict[str, tuple[str, str]] = {}


def with_tables(uses: str, body: str) -> str:
    """``body`` behind the CTEs of the derived tables it uses."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in SQL[name][0].split():
            visit(dep)
        done.append(name)

    for name in uses.split():
        visit(name)
    ctes = [f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in done]
    body = body.strip()
    if body.upper().startswith("WITH "):
        inner = body[5:].lstrip()
        if inner.upper().startswith("RECURSIVE "):
            inner = inner[10:]
        return "WITH RECURSIVE " + ",\n".join([*ctes, inner])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ cells
SQL["cells"] = ("", """
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS cell_id,
         'B' || (l_suppkey % 20) AS dataset,
         l_partkey // 8 AS z, (7 * l_orderkey) % 32 AS y,
         (3 * l_orderkey + 5 * l_linenumber + l_suppkey) % 32 AS x,
         CAST(l_quantity * 20 AS BIGINT) AS vols
  FROM lineitem""")


def cells(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        ).alias("cell_id"),
        F.concat(F.lit("B"), (F.col("l_suppkey") % 20).cast("string")).alias("dataset"),
        F.expr(f"l_partkey div {PLANE_PARTS}").alias("z"),
        ((7 * F.col("l_orderkey")) % SIDE).alias("y"),
        ((3 * F.col("l_orderkey") + 5 * F.col("l_linenumber") + F.col("l_suppkey")) % SIDE).alias("x"),
        (F.col("l_quantity") * 20).cast("bigint").alias("vols"),
    )


# ------------------------------------------------------------------ atlas
SQL["atlas"] = ("", """
  SELECT z, y, x,
         CASE WHEN y < 2 THEN 0
              ELSE 1000 + ((z // 8) * 16 + (y // 8) * 4 + x // 8) % (SELECT count(*) FROM supplier) END AS label,
         CASE WHEN x < 16 THEN 1 ELSE 2 END AS hemisphere
  FROM (SELECT DISTINCT p_partkey // 8 AS z FROM part) p,
       (SELECT unnest(range(32)) AS y) a, (SELECT unnest(range(32)) AS x) b""")


def _planes(spark, d) -> DataFrame:
    """The planes of the volume, dealt to tasks whose number follows the parts: the few rows become 1,024 voxels each,
    which Spark's own choice of partitions does not see."""
    part = table(spark, d, "part")
    n = part.count()
    tasks = max(min(2 * spark.sparkContext.defaultParallelism, n // 64 + 1), n // TASK_PARTS)
    return part.select(F.expr(f"p_partkey div {PLANE_PARTS}").alias("z")).distinct().repartition(tasks, "z")


def _volume(spark, d, planes: DataFrame) -> DataFrame:
    """The voxels of every row of ``planes``, line by line, with label and hemisphere."""
    grid = F.sequence(F.lit(0).cast("bigint"), F.lit(SIDE - 1).cast("bigint"))
    n = table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    rest = [c for c in planes.columns if c != "z"]
    v = planes.select(*rest, "z", F.explode(grid).alias("y")).select(*rest, "z", "y", F.explode(grid).alias("x"))
    return spread(v).select(
        *rest, "z", "y", "x",
        F.when(F.col("y") < 2, F.lit(0).cast("bigint"))
        .otherwise(1000 + F.expr("(z div 8) * 16 + (y div 8) * 4 + x div 8") % n).alias("label"),
        F.when(F.col("x") < 16, 1).otherwise(2).alias("hemisphere"),
    )


def atlas(spark, d) -> DataFrame:
    return _volume(spark, d, _planes(spark, d))


def shape(spark, d) -> dict:
    """Extent of the derived volume (one small read of the part keys)."""
    top = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return {"z": top // PLANE_PARTS + 1, "y": SIDE, "x": SIDE}


# --------------------------------------------------------------- ontology
SQL["ontology"] = ("", """
  SELECT CAST(0 AS BIGINT) AS ids, 'root' AS names, 'root' AS acronym, CAST(NULL AS BIGINT) AS parent, 0 AS st_level
  UNION ALL SELECT 1 + r_regionkey, r_name, 'R' || r_regionkey, 0, 5 FROM region
  UNION ALL SELECT 100 + n_nationkey, n_name || ' layer ' || CASE n_nationkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '2/3'
                   WHEN 2 THEN '4' WHEN 3 THEN '5' WHEN 4 THEN '6a' WHEN 5 THEN '6b' ELSE '7' END,
                   'N' || n_nationkey, 1 + n_regionkey, 7 FROM nation
  UNION ALL SELECT 1000 + s_suppkey, s_name, 'S' || s_suppkey, 100 + s_nationkey, 9 FROM supplier""")


def ontology(spark, d) -> DataFrame:
    layer = F.element_at(F.array(*[F.lit(v) for v in ("1", "2/3", "4", "5", "6a", "6b", "7")]), F.col("n_nationkey") % 7 + 1)
    b = lambda c: c.cast("bigint")
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    root = region.select(
        b(F.lit(0)).alias("ids"), F.lit("root").alias("names"), F.lit("root").alias("acronym"),
        b(F.lit(None)).alias("parent"), F.lit(0).alias("st_level"),
    ).distinct()
    r = region.select(
        b(F.col("r_regionkey") + 1), "r_name", F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), b(F.lit(0)), F.lit(5)
    )
    n = nation.select(
        b(F.col("n_nationkey") + 100), F.concat("n_name", F.lit(" layer "), layer),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), b(F.col("n_regionkey") + 1), F.lit(7),
    )
    s = supplier.select(
        b(F.col("s_suppkey") + 1000), "s_name", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")),
        b(F.col("s_nationkey") + 100), F.lit(9),
    )
    from somagrid.operators.tree import with_children

    return with_children(root.union(r).union(n).union(s))


# ----------------------------------------------------------------- brains
SQL["brains"] = ("", """
  SELECT 'B' || i AS dataset, ['P60','P240','P620','Cuprizone','FVB'][i % 5 + 1] AS exp,
         CASE (i // 5) % 2 WHEN 0 THEN 'M' ELSE 'F' END AS sex, [60, 240, 620, 100, 60][i % 5 + 1] AS age, i AS num
  FROM (SELECT DISTINCT s_suppkey % 20 AS i FROM supplier) s""")
SQL["exclusions"] = ("brains", """
  SELECT dataset, 'N3' AS acronym, 'B' AS side, 0 AS pos FROM brains WHERE num % 7 = 0
  UNION ALL SELECT dataset, 'R1', 'L', 0 FROM brains WHERE num % 7 = 1
  UNION ALL SELECT dataset, 'N6', 'R', 1 FROM brains WHERE num % 7 = 1""")


def brains(spark, d) -> DataFrame:
    i = F.col("num")
    entry = lambda a, s: F.struct(F.lit(a).alias("acronym"), F.lit(s).alias("side"))
    nums = table(spark, d, "supplier").select((F.col("s_suppkey") % 20).alias("num")).distinct()
    pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (i % 5 + 1).cast("int"))
    return nums.select(
        F.concat(F.lit("B"), i.cast("string")).alias("dataset"),
        pick(["P60", "P240", "P620", "Cuprizone", "FVB"]).alias("exp"),
        F.when(F.expr("(num div 5) % 2") == 0, "M").otherwise("F").alias("sex"),
        pick([60, 240, 620, 100, 60]).alias("age"),
        "num",
        F.when(i % 7 == 0, F.array(entry("N3", "B")))
        .when(i % 7 == 1, F.array(entry("R1", "L"), entry("N6", "R")))
        .otherwise(F.array().cast("array<struct<acronym:string,side:string>>")).alias("exclude"),
    )


# an atlas of its own for each brain: labels turned and the midline moved by its number
SQL["brain_atlas"] = ("atlas brains", """
  SELECT dataset, z, y, x, CASE WHEN label = 0 THEN 0 ELSE 1000 + (label - 1000 + num) % (SELECT count(*) FROM supplier) END AS label,
         CASE WHEN x < 14 + num % 4 THEN 1 ELSE 2 END AS hemisphere FROM atlas, brains""")
SQL["image_truth"] = ("cells", """
  SELECT DISTINCT dataset AS image, z, y, x, (z // 4) * 1000000 + (y // 4) * 1000 + x // 4 + 1 AS label FROM cells WHERE vols > 200""")
SQL["image_pred"] = ("cells", """
  SELECT DISTINCT dataset AS image, z, y, x + 1 AS x, (z // 4) * 1000000 + (y // 4) * 1000 + x // 4 + 1 AS label FROM cells WHERE vols > 300""")


def brain_atlas(spark, d) -> DataFrame:
    n = table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    num = F.col("num")
    each = F.collect_list(F.struct("dataset", "num"))  # one entry per brain of the sample list
    # brains come before lines, so that a volume's voxels follow each other
    many = _volume(spark, d, _planes(spark, d).withColumn("_b", F.explode(brains(spark, d).agg(each).scalar())))
    return spread(many).select("*", F.col("_b.dataset").alias("dataset"), F.col("_b.num").alias("num")).select(
        "dataset", "z", "y", "x", F.when(F.col("label") == 0, 0).otherwise(1000 + (F.col("label") - 1000 + num) % n).cast("bigint").alias("label"),
        F.when(F.col("x") < 14 + num % 4, 1).otherwise(2).alias("hemisphere"))


def image_truth(spark, d) -> DataFrame:
    return _bricks(cells(spark, d).filter("vols > 200"), table(spark, d, "lineitem").count(), "dataset").withColumnRenamed("dataset", "image")


def image_pred(spark, d) -> DataFrame:
    return _bricks(cells(spark, d).filter("vols > 300"), table(spark, d, "lineitem").count(), "dataset").withColumnRenamed("dataset", "image").withColumn("x", F.col("x") + 1)


# ------------------------------------------- per-brain region table (leaves up)
SQL["closure"] = ("ontology", """
  SELECT o.ids AS ancestor, o.ids AS descendant, 0 AS depth FROM ontology o
  UNION ALL SELECT o.parent, o.ids, 1 FROM ontology o WHERE o.parent IS NOT NULL
  UNION ALL SELECT p.parent, o.ids, 2 FROM ontology o JOIN ontology p ON o.parent = p.ids WHERE p.parent IS NOT NULL
  UNION ALL SELECT q.parent, o.ids, 3 FROM ontology o JOIN ontology p ON o.parent = p.ids
            JOIN ontology q ON p.parent = q.ids WHERE q.parent IS NOT NULL""")
SQL["labelled"] = ("cells atlas", """
  SELECT c.*, a.label, a.hemisphere FROM cells c LEFT JOIN atlas a USING (z, y, x)""")
SQL["region_counts_t"] = ("labelled ontology brains", """
  SELECT b.dataset, o.ids,
         count(l.label) AS num_w, count(l.label) FILTER (l.hemisphere = 1) AS num_l,
         count(l.label) FILTER (l.hemisphere = 2) AS num_r,
         count(l.label) FILTER (l.vols > 500) AS large_w,
         count(l.label) FILTER (l.vols > 500 AND l.hemisphere = 1) AS large_l,
         count(l.label) FILTER (l.vols > 500 AND l.hemisphere = 2) AS large_r
  FROM brains b CROSS JOIN ontology o
  LEFT JOIN labelled l ON l.dataset = b.dataset AND l.label = o.ids AND l.label > 0 AND l.vols > 30
  GROUP BY b.dataset, o.ids""")
SQL["region_volume_t"] = ("atlas", """
  SELECT label AS ids, count(*) * 15625 * 1e-9 AS vol_w,
         count(*) * 15625 * 1e-9 / 2 AS vol_l, count(*) * 15625 * 1e-9 / 2 AS vol_r
  FROM atlas WHERE label > 0 GROUP BY label""")
# pooled table: exclusions applied, rolled up from the deepest level, densities
SQL["kept"] = ("region_counts_t region_volume_t exclusions closure ontology", """
  WITH hit AS (SELECT e.dataset, c.descendant AS ids, e.side, e.pos FROM exclusions e
               JOIN ontology o ON o.acronym = e.acronym JOIN closure c ON c.ancestor = o.ids),
       one AS (SELECT dataset, ids, bool_or(side = 'B') AS dropped,
                      arg_min(side, pos) FILTER (side <> 'B') AS side FROM hit GROUP BY dataset, ids)
  SELECT r.dataset, r.ids, o.names, o.acronym, o.parent, o.st_level,
         CASE h.side WHEN 'L' THEN num_l WHEN 'R' THEN num_r ELSE num_l END AS num_l,
         CASE h.side WHEN 'L' THEN num_l WHEN 'R' THEN num_r ELSE num_r END AS num_r,
         CASE h.side WHEN 'L' THEN 2 * num_l WHEN 'R' THEN 2 * num_r ELSE num_w END AS num_w,
         large_l, large_r, large_w, vol_l, vol_r, vol_w
  FROM region_counts_t r JOIN ontology o USING (ids) LEFT JOIN one h ON h.dataset = r.dataset AND h.ids = r.ids
  LEFT JOIN region_volume_t v ON v.ids = r.ids
  WHERE NOT coalesce(h.dropped, false)""")
_SUMS = ["num_l", "num_r", "num_w", "large_l", "large_r", "large_w", "vol_l", "vol_r", "vol_w"]


def _roll_sql(src: str, level: int) -> str:
    picks = ", ".join(
        f"CASE WHEN k.st_level = {level} AND k.vol_w IS NULL AND c.parent IS NOT NULL THEN coalesce(c.{s}, 0) ELSE k.{s} END AS {s}"
        for s in _SUMS
    )
    sums = ", ".join(f"sum({s}) AS {s}" for s in _SUMS)
    return f"""SELECT k.dataset, k.ids, k.names, k.acronym, k.parent, k.st_level, {picks} FROM {src} k
      LEFT JOIN (SELECT dataset, parent, {sums} FROM {src} GROUP BY dataset, parent) c
      ON c.dataset = k.dataset AND c.parent = k.ids"""


SQL["rolled7"] = ("kept", _roll_sql("kept", 7))
SQL["rolled5"] = ("rolled7", _roll_sql("rolled7", 5))
SQL["rolled"] = ("rolled5", _roll_sql("rolled5", 0))
SQL["pooled"] = ("rolled brains", """
  SELECT r.*, num_l / nullif(vol_l, 0) AS density_l, num_r / nullif(vol_r, 0) AS density_r,
         num_w / nullif(vol_w, 0) AS density_w, large_w / nullif(vol_w, 0) AS density_large_w, b.exp, b.sex, b.age
  FROM rolled r JOIN brains b USING (dataset)""")


def region_table(spark, d) -> DataFrame:
    """Counts and volumes per (brain, region) straight from cells and atlas."""
    from somagrid.plans.brain import brain_tables

    return brain_tables(cells(spark, d), atlas(spark, d), ontology(spark, d), brains(spark, d), res=RES)


def pooled(spark, d) -> DataFrame:
    """Pooled region table: exclusions, roll-up, densities, brain columns."""
    from somagrid.plans.compare import pooled_regions

    return pooled_regions(region_table(spark, d), ontology(spark, d), brains(spark, d))


# ------------------------------------------------------ intensity voxels
SQL["voxels"] = ("", """
  SELECT l_partkey // 8 AS z, (7 * l_orderkey) % 32 AS y, (3 * l_orderkey + 5 * l_linenumber + l_suppkey) % 32 AS x,
         sum(l_quantity) AS value, CAST(sum(l_linenumber) AS DOUBLE) AS red FROM lineitem GROUP BY ALL""")


def voxels(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    at = li.select(
        F.expr(f"l_partkey div {PLANE_PARTS}").alias("z"), ((7 * F.col("l_orderkey")) % SIDE).alias("y"),
        ((3 * F.col("l_orderkey") + 5 * F.col("l_linenumber") + F.col("l_suppkey")) % SIDE).alias("x"), "l_quantity", "l_linenumber",
    )
    return shared_out(at, li.count(), "z", "y", "x").groupBy("z", "y", "x").agg(F.sum("l_quantity").alias("value"), F.sum("l_linenumber").cast("double").alias("red"))


# labelled objects: small bricks of bright voxels
SQL["object_voxels"] = ("voxels", """
  SELECT z, y, x, value, (z // 4) * 1000000 + (y // 4) * 1000 + x // 4 + 1 AS label FROM voxels WHERE value > 10""")


def object_voxels(spark, d) -> DataFrame:
    return voxels(spark, d).filter("value > 10").select(
        "z", "y", "x", "value", F.expr("(z div 4) * 1000000 + (y div 4) * 1000 + x div 4 + 1").alias("label")
    )


# truth and prediction for detection scores: bricks and bricks shifted in x
SQL["truth_voxels"] = ("cells", """
  SELECT DISTINCT z, y, x, (z // 4) * 1000000 + (y // 4) * 1000 + x // 4 + 1 AS label FROM cells WHERE vols > 200""")
SQL["pred_voxels"] = ("cells", """
  SELECT DISTINCT z, y, x + 1 AS x, (z // 4) * 1000000 + (y // 4) * 1000 + x // 4 + 1 AS label FROM cells WHERE vols > 300""")


def _bricks(df: DataFrame, rows: int, *by: str) -> DataFrame:
    at = df.select(*by, "z", "y", "x", F.expr("(z div 4) * 1000000 + (y div 4) * 1000 + x div 4 + 1").alias("label"))
    return shared_out(at, rows, "z", "y", "x").distinct()


def truth_voxels(spark, d) -> DataFrame:
    return _bricks(cells(spark, d).filter("vols > 200"), table(spark, d, "lineitem").count())


def pred_voxels(spark, d) -> DataFrame:
    return _bricks(cells(spark, d).filter("vols > 300"), table(spark, d, "lineitem").count()).withColumn("x", F.col("x") + 1)


# ------------------------------------------------------------ deformation
# mm positions of a mild shear of the volume at 0.02 mm per voxel
SQL["field"] = ("voxels", """
  SELECT z, y, x, round(0.02 * (z + (y % 3)), 6) AS d0, round(0.02 * (y + 0.4), 6) AS d1,
         round(0.02 * (x * 0.9 + 1), 6) AS d2 FROM voxels""")


def field(spark, d) -> DataFrame:
    return voxels(spark, d).select(
        "z", "y", "x", F.round(0.02 * (F.col("z") + F.col("y") % 3), 6).alias("d0"),
        F.round(0.02 * (F.col("y") + 0.4), 6).alias("d1"), F.round(0.02 * (F.col("x") * 0.9 + 1), 6).alias("d2"),
    )


# ------------------------------------------------------------- expression
SQL["expression"] = ("", """
  SELECT 1000 + vec_id % (SELECT count(*) FROM supplier) AS region_id, pos AS gene_id, CAST(v AS DOUBLE) AS value
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")


def expression(spark, d) -> DataFrame:
    n = table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select(
        (1000 + F.col("vec_id") % n).alias("region_id"), F.col("pos").cast("bigint").alias("gene_id"),
        F.col("v").cast("double").alias("value"),
    )


# ----------------------------------------------------------------- tracks
SQL["tracks"] = ("", """
  SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 + (user_id % 5) * 3 AS frame,
         event_id * 13 % 512 AS x, event_id * 29 % 512 AS y, CAST(trunc(value) AS BIGINT) % 64 AS z,
         event_type AS color, value AS mean_intensity FROM events""")


def tracks(spark, d) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts")
    return e.select(
        F.col("user_id").alias("series"),
        (F.row_number().over(w).cast("bigint") - 1 + F.col("user_id") % 5 * 3).alias("frame"),
        (F.col("event_id") * 13 % 512).alias("x"), (F.col("event_id") * 29 % 512).alias("y"),
        (F.col("value").cast("bigint") % 64).alias("z"), F.col("event_type").alias("color"),
        F.col("value").alias("mean_intensity"),
    )


# ------------------------------------------------------------ trace trees
SQL["trees"] = ("", """
  SELECT o_orderkey // 256 AS tree, o_orderkey % 256 AS cur_idx,
         CASE WHEN o_orderkey % 256 = 0 THEN -1 ELSE (o_orderkey % 256 - 1) // 2 END AS parent,
         o_custkey % 64 AS z, o_orderkey * 7 % 128 AS y, o_orderkey * 11 % 128 AS x,
         CAST(trunc(o_totalprice) AS BIGINT) % 7 + 1 AS len FROM orders""")


def trees(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.expr(f"o_orderkey div {TREE}").alias("tree"), (F.col("o_orderkey") % TREE).alias("cur_idx"),
        F.when(F.col("o_orderkey") % TREE == 0, F.lit(-1).cast("bigint"))
        .otherwise(F.expr(f"(o_orderkey % {TREE} - 1) div 2")).alias("parent"),
        (F.col("o_custkey") % 64).alias("z"), (F.col("o_orderkey") * 7 % 128).alias("y"),
        (F.col("o_orderkey") * 11 % 128).alias("x"), (F.col("o_totalprice").cast("bigint") % 7 + 1).alias("len"),
    )


# ------------------------------------------------------------------ boxes
SQL["boxes"] = ("", """
  SELECT o_orderkey AS box, o_orderkey // 60 AS z0, o_orderkey * 7 % 32 AS y0, o_custkey * 3 % 32 AS x0,
         o_orderkey // 60 + 1 + o_orderkey % 2 AS z1, o_orderkey * 7 % 32 + 2 + o_custkey % 3 AS y1,
         o_custkey * 3 % 32 + 2 + o_orderkey % 3 AS x1,
         round((CAST(trunc(o_totalprice) AS BIGINT) % 1000) / 1000.0, 3) AS score, o_custkey % 8 AS patch FROM orders""")


def boxes(spark, d) -> DataFrame:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    z, y, x = F.expr("o_orderkey div 60"), ok * 7 % 32, ck * 3 % 32
    return table(spark, d, "orders").select(
        ok.alias("box"), z.alias("z0"), y.alias("y0"), x.alias("x0"), (z + 1 + ok % 2).alias("z1"),
        (y + 2 + ck % 3).alias("y1"), (x + 2 + ok % 3).alias("x1"),
        F.round((F.col("o_totalprice").cast("bigint") % 1000) / 1000.0, 3).alias("score"), (ck % 8).alias("patch"),
    )


# -------------------------------------------------------------- landmarks
SQL["landmarks"] = ("", """
  SELECT 'I' || (c_custkey % 10) AS image, c_custkey // 10 AS label, CAST(trunc(c_acctbal) AS BIGINT) % 40 + 40 AS z,
         c_custkey * 7 % 50 AS y, c_nationkey * 3 % 50 AS x FROM customer""")


def landmarks(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.concat(F.lit("I"), (F.col("c_custkey") % 10).cast("string")).alias("image"),
        F.expr("c_custkey div 10").alias("label"), (F.col("c_acctbal").cast("bigint") % 40 + 40).alias("z"),
        (F.col("c_custkey") * 7 % 50).alias("y"), (F.col("c_nationkey") * 3 % 50).cast("bigint").alias("x"),
    )


# ------------------------------------------------------ two-group samples
SQL["samples"] = ("", """
  SELECT o_orderkey AS sample, CAST(c_nationkey AS BIGINT) AS region, o_orderstatus AS grp, o_totalprice AS value, c_acctbal AS other
  FROM orders JOIN customer ON o_custkey = c_custkey""")


def samples(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("sample"), F.col("c_nationkey").cast("bigint").alias("region"),
        F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("value"), F.col("c_acctbal").alias("other"),
    )
