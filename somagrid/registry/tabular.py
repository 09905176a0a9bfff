"""Queries that go through files and streams, and plain table reshaping.

The files are written from the given tables into the checkpoint folder first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from somagrid.operators import reshape as X
from somagrid.registry import derived as D
from somagrid.registry.base import query
from somagrid.session import checkpoint_root
from somagrid.sources import files as S
from somagrid.streaming import blocks as B


def scratch(spark) -> str:
    return f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"


@query("read_brains", """
  SELECT 'S' || s_suppkey AS dataset, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE s_suppkey % 90 END AS age, CASE s_suppkey % 2 WHEN 0 THEN 'CHECK' ELSE '24' END AS weight,
    CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS n_exclude, CASE WHEN s_suppkey % 4 = 0 THEN 'R' END AS second_side FROM supplier""")
def read_brains(spark, d):
    p = scratch(spark)
    k = F.col("s_suppkey")
    ex = F.when(k % 4 == 0, F.array(F.array(F.lit("N1"), F.lit("B")), F.array(F.lit("N2"), F.lit("R"))))
    rows = D.table(spark, d, "supplier").select(
        F.expr("s_suppkey div 50").alias("chunk"), F.concat(F.lit("S"), k.cast("string")).alias("name"), F.when(k % 3 == 0, "?").otherwise((k % 90).cast("string")).alias("age"),
        F.when(k % 2 == 0, "CHECK").otherwise("24").alias("weight"), ex.alias("exclude"))
    # one JSON array of at most 50 brains per file
    docs = rows.groupBy("chunk").agg(F.to_json(F.collect_list(F.struct("name", "age", "weight", "exclude"))).alias("value"))
    docs.write.partitionBy("chunk").text(p)
    b = S.read_brains(spark, p)
    return b.select("dataset", "age", "weight", F.size("exclude").alias("n_exclude"), F.try_element_at("exclude", F.lit(2))["side"].alias("second_side"))


@query("read_ontology", """
  SELECT o.ids, o.names, o.acronym, o.parent, o.st_level::BIGINT AS st_level, count(k.ids) AS n_children FROM ontology o LEFT JOIN ontology k ON k.parent = o.ids GROUP BY ALL""", "ontology")
def read_ontology(spark, d):
    o = D.ontology(spark, d).select(F.col("ids").alias("id"), F.col("names").alias("name"), "acronym", "st_level", F.col("parent").alias("parent_structure_id"))
    kids = None
    for level in (9, 7, 5, 0):
        node = o.filter(F.col("st_level") == level)
        if kids is None:
            full = node.withColumn("children", F.array().cast("array<string>"))
            as_json = F.to_json(F.struct(*node.columns, F.array().cast("array<string>").alias("children")))
            kids = full.select(F.col("parent_structure_id").alias("id"), as_json.alias("j"))
            continue
        g = kids.groupBy("id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("c"))
        body = F.regexp_replace(F.to_json(F.struct(*node.columns)), r"\}$", "")
        kids = node.join(g, "id", "left").select(
            F.col("parent_structure_id").alias("id"), F.concat(body, F.lit(',"children":'), F.coalesce("c", F.lit("[]")), F.lit("}")).alias("j"))
    p = scratch(spark)
    kids.select(F.col("j").alias("value")).coalesce(1).write.text(p)
    return S.read_ontology(spark, p).select("ids", "names", "acronym", "parent", "st_level", F.size("children").alias("n_children"))


@query("read_blocks", "SELECT dataset, z // 16 AS block, count(*) AS n, CAST(sum(vols) AS BIGINT) AS vols FROM cells GROUP BY ALL", "cells")
def read_blocks(spark, d):
    p = scratch(spark)
    c = D.cells(spark, d).withColumn("block", F.expr("z div 16"))
    c.filter("vols > 100").write.parquet(f"{p}/large")
    c.filter("vols <= 100").drop("cell_id").write.parquet(f"{p}/small")
    c.filter("vols < 0").write.parquet(f"{p}/empty")
    return S.read_blocks(spark, p).groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("vols").alias("vols"))


def _spot_frame(spark, d):
    t = D.tracks(spark, d)
    colors = F.array(*[F.lit(v) for v in ("r=255;g=255;b=255", "r=51;g=255;b=51", "r=204;g=255;b=204", "r=1;g=2;b=3")])
    return t.select(
        F.when(F.col("frame") % 11 == 0, "m").otherwise("s").alias("LABEL"), (F.col("series") * 1000 + F.col("frame")).cast("string").alias("ID"),
        F.col("series").cast("string").alias("TRACK_ID"), F.col("x").cast("string").alias("POSITION_X"), F.col("y").cast("string").alias("POSITION_Y"),
        F.col("z").cast("string").alias("POSITION_Z"), F.col("frame").cast("string").alias("FRAME"), colors[(F.col("frame") % 4).cast("int")].alias("MANUAL_SPOT_COLOR"),
        F.lit("extra").alias("RADIUS"))


SPOTS = """SELECT CASE WHEN frame % 11 = 0 THEN 'm' ELSE 's' END AS label, series * 1000 + frame AS id, series, frame,
   ['r=255;g=255;b=255', 'r=51;g=255;b=51', 'r=204;g=255;b=204', 'r=1;g=2;b=3'][frame % 4 + 1] AS color, x, y, z FROM tracks"""


@query("read_spots", f"SELECT label, id, series, frame, color, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM ({SPOTS})", "tracks")
def read_spots(spark, d):
    p = scratch(spark)
    s = _spot_frame(spark, d)
    heads = spark.range(3).select(*[F.lit(f"head {c}").alias(c) for c in s.columns])
    heads.unionByName(s).write.csv(p, header=True)
    return S.read_spots(spark, p).select(
        F.col("LABEL").alias("label"), F.col("ID").alias("id"), F.col("TRACK_ID").alias("series"), F.col("FRAME").alias("frame"),
        F.col("MANUAL_SPOT_COLOR").alias("color"), F.col("POSITION_X").alias("x"), F.col("POSITION_Y").alias("y"), F.col("POSITION_Z").alias("z"))


@query("read_tracks", """
  SELECT series, frame, color, X, Y, Z FROM (SELECT series, frame, color, round_even(round_even((x - 256)::DOUBLE * (1 / 0.8302662::DOUBLE) + 256.0, 12), 0) AS X,
     round_even(round_even((y - 256)::DOUBLE * (1 / 0.8302662::DOUBLE) + 256.0, 12), 0) AS Y, round_even(round_even(z::DOUBLE * (1.0::DOUBLE / 3) + 16.0, 12), 0) AS Z FROM tracks)
  WHERE X < 512 AND Y < 512 AND Z < 32""", "tracks")
def read_tracks(spark, d):
    p = scratch(spark)
    t = D.tracks(spark, d)
    t.select(F.col("series").alias("SERIES"), F.col("frame").alias("FRAME"), F.col("color").alias("COLOR"), (F.col("x") - 256).alias("X"),
             (F.col("y") - 256).alias("Y"), F.col("z").alias("Z")).write.csv(p, header=True)
    r = S.read_tracks(spark, p, {"X": 1 / 0.8302662, "Y": 1 / 0.8302662, "Z": 1 / 3}, {"X": 512, "Y": 512, "Z": 32})
    return r.select(F.col("SERIES").alias("series"), F.col("FRAME").alias("frame"), F.col("COLOR").alias("color"), "X", "Y", "Z")


@query("read_trees", """
  SELECT 't' || tree AS name, cur_idx AS node, parent, cur_idx * 2 AS orig_idx, 512::BIGINT AS width FROM trees""", "trees")
def read_trees(spark, d):
    p = scratch(spark)
    t = D.trees(spark, d)
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cur_idx", c.alias("v")))), lambda s: s["v"].cast("string")), ",")
    g = t.groupBy("tree").agg(line(F.col("parent")).alias("a"), line(F.col("cur_idx") * 2).alias("b"))
    head = F.concat(F.lit("t"), F.col("tree").cast("string"), F.lit(".tif,skip,512,512,64,"))
    rows = g.select("tree", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.concat(head, "a").alias("v")), F.struct(F.lit(1).alias("k"), F.concat(head, "b").alias("v")))).alias("r"))
    rows.repartitionByRange("tree").sortWithinPartitions("tree", "r.k").select("r.v").write.text(p)
    return S.read_trees(spark, p).select("name", "node", "parent", "orig_idx", F.col("size")[0].alias("width"))


@query("swc_lines", """
  SELECT tree, printf('%d %d %.5f %.5f %.5f %.5f %d', cur_idx, CASE WHEN cur_idx = 0 THEN 1 ELSE 2 END, y * 0.20756792660398113::DOUBLE, x * 0.20756792660398113::DOUBLE, z::DOUBLE, 0.5::DOUBLE, parent) AS value FROM trees""", "trees")
def swc_lines(spark, d):
    p = scratch(spark)
    S.write_swc(D.trees(spark, d), p)
    return spark.read.text(p).select(F.col("tree").cast("bigint").alias("tree"), "value")


@query("read_swc", """
  SELECT tree, cur_idx AS idx, CASE WHEN cur_idx = 0 THEN 1 ELSE 2 END::BIGINT AS type, x::DOUBLE AS x, y::DOUBLE AS y, round(z / 0.20756792660398113::DOUBLE, 6) AS z, 0.5::DOUBLE AS radius, parent FROM trees""", "trees")
def read_swc(spark, d):
    p = scratch(spark)
    t = D.trees(spark, d)
    row = t.select("tree", "cur_idx", F.format_string("%d 3 %d %d %d 9.0 %d", "cur_idx", "x", "y", "z", "parent").alias("value"))
    note = t.select("tree").distinct().select("tree", F.lit(-1).cast("bigint").alias("cur_idx"), F.lit("# a comment").alias("value"))
    S.write_folders(row.unionByName(note).repartition(8, "tree").sortWithinPartitions("tree", "cur_idx").select("tree", "value"), p, "tree")
    r = S.read_swc(spark, f"{p}/tree=*")
    return r.withColumn("tree", F.regexp_extract("file", r"tree=(\d+)", 1).cast("bigint")).drop("file")


@query("exported_spots", """
  WITH s AS (SELECT series, min(frame) AS a, max(frame) AS b FROM tracks GROUP BY series), g AS (SELECT min(a) AS lo, max(b) AS hi FROM s)
  SELECT '0' || frame || '0' || series AS id, series, frame, x, y, z, CASE WHEN a > lo AND b < hi THEN '-3407668' WHEN a > lo THEN '-13421569' WHEN b < hi THEN '-52429'
    ELSE '-13369549' END::BIGINT AS color FROM tracks JOIN s USING (series), g""", "tracks")
def exported_spots(spark, d):
    p = scratch(spark)
    S.write_tracks(D.tracks(spark, d), p)
    schema = "id string, series bigint, frame bigint, x bigint, y bigint, z bigint, color bigint"
    return spark.read.format("xml").option("rowTag", "Spot").schema(schema).load(f"{p}/spots")


@query("exported_edges", """
  SELECT series, '0' || frame || '0' || series AS source_id, '0' || nf || '0' || series AS target_id FROM (
    SELECT series, frame, lead(frame) OVER (PARTITION BY series ORDER BY frame) AS nf FROM tracks) WHERE nf IS NOT NULL""", "tracks")
def exported_edges(spark, d):
    p = scratch(spark)
    S.write_tracks(D.tracks(spark, d), p)
    return spark.read.format("xml").option("rowTag", "Edge").schema("series bigint, source_id string, target_id string").load(f"{p}/edges")


@query("obj_lines", """
  WITH m AS (SELECT t.*, cur_idx + o AS mi, CASE WHEN parent < 0 THEN parent ELSE parent + o END AS mp FROM trees t JOIN
    (SELECT tree, CAST(sum(n) OVER (ORDER BY tree) - n AS BIGINT) AS o FROM (SELECT tree, count(*) AS n FROM trees GROUP BY tree)) USING (tree))
  SELECT 'v ' || z || ' ' || y || ' ' || x AS value FROM m UNION ALL SELECT 'l ' || (mp + 1) || ' ' || (mi + 1) FROM m WHERE mp >= 0""", "trees")
def obj_lines(spark, d):
    p = scratch(spark)
    S.write_obj(D.trees(spark, d), p)
    return spark.read.text(p)


@query("resumed_brain_tables", "SELECT dataset, count(*) AS n, CAST(sum(CASE WHEN dataset IN ('B1', 'B2') THEN 1 ELSE 2 END) AS BIGINT) AS total FROM cells GROUP BY dataset", "cells")
def resumed_brain_tables(spark, d):
    p = scratch(spark)
    c = D.cells(spark, d).select("dataset", "z", "y", "x", F.lit(1).alias("run"))
    S.write_brain_tables(c.filter("dataset IN ('B1', 'B2')"), p)
    t = S.write_brain_tables(c.withColumn("run", F.lit(2)), p)
    return t.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("run").alias("total"))


@query("labels_from_paths", """
  SELECT label, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 6 IN (1, 2, 3) THEN 0 ELSE 1 END::BIGINT AS label FROM nation WHERE n_nationkey % 5 <> 4) GROUP BY label""")
def labels_from_paths(spark, d):
    p = scratch(spark)
    n = D.table(spark, d, "nation")
    name = F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit("_"), F.when(F.col("n_nationkey") % 5 == 4, "x").otherwise((F.col("n_nationkey") % 6).cast("string")), F.lit(".tif"))
    n.select(name.alias("name"), "n_name").write.partitionBy("name").text(p)
    # a folder per name: take the label from the folder instead of the part file
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("path"))
    return S.label_of(paths).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("natural_order", """
  SELECT name, row_number() OVER (ORDER BY series, frame) AS place FROM (SELECT DISTINCT 'block_' || series || '_' || frame AS name, series, frame FROM tracks)""", "tracks")
def natural_order(spark, d):
    from somagrid.operators.ordered import value_ranks

    n = D.tracks(spark, d).select(F.format_string("block_%d_%d", "series", "frame").alias("name")).distinct().withColumn("k", S.natural_key("name"))
    return n.join(value_ranks(n, [], "k").select("k", (F.col("before") + 1).alias("place")), "k").select("name", "place")


@query("ingested_blocks", "SELECT dataset, count(*) AS n, CAST(sum(vols) AS BIGINT) AS vols FROM cells GROUP BY dataset", "cells")
def ingested_blocks(spark, d):
    p = scratch(spark)
    c = D.cells(spark, d)
    c.filter("z % 2 = 0").write.parquet(f"{p}/in")
    B.ingest_blocks(spark, f"{p}/in", c.schema, f"{p}/out", f"{p}/state", 2)
    c.filter("z % 2 = 1").write.mode("append").parquet(f"{p}/in")
    B.ingest_blocks(spark, f"{p}/in", c.schema, f"{p}/out", f"{p}/state", 2)
    return spark.read.parquet(f"{p}/out").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("vols").alias("vols"))


@query("streamed_region_counts", "SELECT label, count(*) AS num, count(*) FILTER (vols > 500) AS num_large FROM labelled WHERE vols > 30 AND label > 0 GROUP BY label", "labelled")
def streamed_region_counts(spark, d):
    p = scratch(spark)
    c = D.cells(spark, d).select("z", "y", "x", "vols")
    c.repartition(4).write.parquet(f"{p}/in")
    B.stream_region_counts(spark, f"{p}/in", c.schema, D.atlas(spark, d), f"{p}/out", f"{p}/state", files_per_trigger=2)
    return B.latest_counts(spark, f"{p}/out")


@query("streamed_tracks", """
  SELECT a.series, a.frame, (b.z - a.z)::DOUBLE AS dz, (b.y - a.y)::DOUBLE AS dy, (b.x - a.x)::DOUBLE AS dx FROM tracks a JOIN tracks b ON a.series = b.series AND b.frame = a.frame + 1""", "tracks")
def streamed_tracks(spark, d):
    p = scratch(spark)
    t = D.tracks(spark, d).select("series", "frame", "z", "y", "x")
    t.filter("frame >= 30 OR frame % 7 = 0").write.parquet(f"{p}/in")  # part of the early frames comes late
    B.stream_tracks(spark, f"{p}/in", t.schema, f"{p}/out", f"{p}/state")
    t.filter("frame < 30 AND frame % 7 <> 0").write.mode("append").parquet(f"{p}/in")
    B.stream_tracks(spark, f"{p}/in", t.schema, f"{p}/out", f"{p}/state")
    return spark.read.parquet(f"{p}/out")


@query("pooled_tables", """
  SELECT dataset, count(*) AS n, count(a) AS with_a, count(b) AS with_b FROM (SELECT dataset, vols AS a, NULL AS b FROM cells WHERE vols > 500
    UNION ALL SELECT dataset, NULL, z FROM cells WHERE vols <= 500) GROUP BY dataset""", "cells")
def pooled_tables(spark, d):
    c = D.cells(spark, d)
    a = c.filter("vols > 500").select("dataset", F.col("vols").alias("a"))
    b = c.filter("vols <= 500").select("dataset", F.col("z").alias("b"))
    return X.pool([a, b]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("with_a"), F.count("b").alias("with_b"))


@query("deduplicated", "SELECT dataset, z, cell_id FROM cells QUALIFY row_number() OVER (PARTITION BY dataset, z ORDER BY cell_id) = 1", "cells")
def deduplicated(spark, d):
    return X.dedupe(D.cells(spark, d).select("dataset", "z", "cell_id"), ["dataset", "z"], ["cell_id"])


@query("first_rows", "SELECT z, cell_id, vols FROM cells QUALIFY row_number() OVER (PARTITION BY z ORDER BY vols DESC, cell_id) <= 3", "cells")
def first_rows(spark, d):
    return X.first_by(D.cells(spark, d).select("z", "cell_id", "vols"), ["z"], [F.desc("vols"), "cell_id"], 3)


@query("renamed_columns", "SELECT cell_id AS id, dataset AS brain, vols AS size FROM cells", "cells")
def renamed_columns(spark, d):
    return X.rename_from(D.cells(spark, d).select("cell_id", "dataset", "vols"), {"cell_id": "id", "dataset": "brain", "vols": "size"})


@query("class_counts", """
  SELECT lang, quality::BIGINT AS quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, quality)""")
def class_counts(spark, d):
    j = D.table(spark, d, "labels").join(D.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return X.class_counts(j, ["lang", "quality"])
