"""Readers and writers for the file forms of brains, regions, blocks, spots,
tracks and trace trees."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from somagrid.operators.tree import with_children
from somagrid.session import cut

BRAIN = ("path string, name string, exp string, num string, sex string, age string, thresh string, weight string, "
         "`Exact age` string, pkl_to_use string, side string, exclude array<array<string>>")


def read_brains(spark: SparkSession, path: str) -> DataFrame:
    """Brain metadata, one record per brain.  Fields that sometimes hold text stay
    text; numeric ones are NULL where they are not numbers."""
    b = spark.read.schema(BRAIN).json(path, multiLine=True)
    entry = lambda e: F.struct(e[0].alias("acronym"), F.coalesce(F.get(e, F.lit(1)), F.lit("")).alias("side"))
    return b.select(
        F.col("name").alias("dataset"), "path", "exp", "num", "sex", F.col("age").try_cast("int").alias("age"),
        F.col("thresh").try_cast("int").alias("thresh"), "weight", F.col("Exact age").alias("exact_age"), "pkl_to_use", "side",
        F.coalesce(F.transform("exclude", entry), F.array().cast("array<struct<acronym:string,side:string>>")).alias("exclude"))


NODE = "id bigint, name string, acronym string, st_level int, parent_structure_id bigint, children array<string>"


def read_ontology(spark: SparkSession, path: str, max_depth: int = 64) -> DataFrame:
    """Nested region tree to one row per region.  Children are kept as text and
    parsed level by level, so no depth is built into a schema."""
    level = spark.read.text(path, wholetext=True).select(F.from_json("value", NODE).alias("n"))
    levels = []
    for _ in range(max_depth):
        level = cut(level)
        if level.isEmpty():
            break
        levels.append(level.select(
            F.col("n.id").alias("ids"), F.col("n.name").alias("names"), F.col("n.acronym").alias("acronym"),
            F.col("n.parent_structure_id").alias("parent"), F.col("n.st_level").alias("st_level")))
        level = level.select(F.explode("n.children").alias("c")).select(F.from_json("c", NODE).alias("n"))
    else:
        raise ValueError(f"region tree deeper than {max_depth}")
    return with_children(functools.reduce(DataFrame.unionByName, levels))


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """All block tables of a folder as one; blocks without rows add nothing."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder)


SPOT = ["LABEL", "ID", "TRACK_ID", "POSITION_X", "POSITION_Y", "POSITION_Z", "FRAME", "MANUAL_SPOT_COLOR"]


def read_spots(spark: SparkSession, path: str) -> DataFrame:
    """Spot table with extra header rows: rows without a numeric id are headers."""
    d = spark.read.csv(path, header=True).select(*SPOT)
    num = {"ID": "bigint", "TRACK_ID": "bigint", "POSITION_X": "double", "POSITION_Y": "double", "POSITION_Z": "double", "FRAME": "bigint"}
    return d.select(*[F.col(c).try_cast(num[c]).alias(c) if c in num else F.col(c) for c in SPOT]).filter("ID IS NOT NULL")


def read_tracks(spark: SparkSession, path: str, scale: dict | None = None, dims: dict | None = None) -> DataFrame:
    """Tracking table; with a scale (pixels per micron) positions are scaled, moved
    to the volume centre and rounded, and those outside ``dims`` are dropped."""
    d = spark.read.csv(path, header=True, schema="SERIES bigint, FRAME bigint, COLOR string, X double, Y double, Z double")
    for a, s in (scale or {}).items():
        d = d.withColumn(a, F.bround(F.bround(F.col(a) * s + dims[a] / 2.0, 12)))
    for a, n in (dims or {}).items():
        d = d.filter(F.col(a) < n)
    return d


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their running number in their file, over any number of read
    tasks: a split is one run of rows inside a task, and the few line counts per
    split, in the order of the splits' places in the file, give the offsets."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    d = cut(raw)
    n = d.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    off = n.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return d.join(off, ["file", "_at"]).select("file", "value", (F.col("_id") - F.col("_first") + F.col("_o")).alias("line"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Trace trees kept as row pairs (parents, then original indices): one row per
    node of each tree; ``tree`` counts the pairs of a file from 0."""
    # Fixed form: name, a skipped field, three sizes, then the values
    f = F.split("value", ",")
    vals = F.filter(F.transform(F.slice(f, 6, F.greatest(F.size(f) - 5, F.lit(0))), lambda v: v.try_cast("bigint")), lambda v: v.isNotNull())
    d = numbered_lines(spark, path).select(
        "file", F.expr("line div 2").alias("tree"), (F.col("line") % 2).alias("kind"), F.split(f[0], "\\.tif")[0].alias("name"),
        F.slice(f, 3, 3).cast("array<bigint>").alias("size"), vals.alias("vals"))
    # the two lines of a pair meet whole, in a shuffled join: their nodes are many times what Spark sees of the text
    p = d.filter("kind = 0").select("file", "tree", "name", "size", F.col("vals").alias("_up"))
    j = p.join(d.filter("kind = 1").select("file", "tree", F.col("vals").alias("_orig")).hint("merge"), ["file", "tree"], "left")
    return j.select("file", "tree", "name", "size", F.posexplode("_up").alias("node", "parent"), "_orig").select(
        "file", "tree", "name", "size", "node", "parent", F.get("_orig", F.col("node")).alias("orig_idx"))


def read_swc(spark: SparkSession, paths, scale_xy: float = 0.20756792660398113) -> DataFrame:
    """Repaired trace files: comments skipped, all points axon (2), the first of a
    file soma (1), z over the XY scale, radius 0.5."""
    raw = spark.read.text(paths).withColumn("file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    d = cut(raw.withColumn("f", F.split(F.trim("value"), "\\s+")).filter("f[0] <> '#' AND f[0] <> ''"))
    first = d.groupBy("file").agg(F.min("_id").alias("_first"))
    n = lambda i, t: F.col("f")[i].try_cast(t)
    return d.join(first, "file").select(
        "file", n(0, "bigint").alias("idx"), F.when(F.col("_id") == F.col("_first"), 1).otherwise(2).alias("type"), n(2, "double").alias("x"),
        n(3, "double").alias("y"), (n(4, "double") / scale_xy).alias("z"), F.lit(0.5).alias("radius"), n(6, "bigint").alias("parent"))


def swc_lines(nodes: DataFrame, scale_xy: float = 0.20756792660398113, scale_z: float = 1.0) -> DataFrame:
    """Text lines of trace trees in micrometres (x and y change places)."""
    first = nodes.groupBy("tree").agg(F.min("cur_idx").alias("_first"))
    line = F.format_string(
        "%d %d %.5f %.5f %.5f %.5f %d", "cur_idx", F.when(F.col("cur_idx") == F.col("_first"), 1).otherwise(2),
        F.col("y") * F.lit(scale_xy), F.col("x") * F.lit(scale_xy), F.col("z") * F.lit(float(scale_z)), F.lit(0.5), "parent")
    return nodes.join(first, "tree").select("tree", "cur_idx", line.alias("value"))


def write_swc(nodes: DataFrame, path: str, **scale) -> None:
    """One folder per tree, lines in node order.  A very long tree may span several
    part files, which follow each other in name order."""
    d = swc_lines(nodes, **scale).repartitionByRange("tree", "cur_idx").sortWithinPartitions("tree", "cur_idx")
    write_folders(d.select("tree", "value"), path, "tree")


def write_folders(lines: DataFrame, path: str, key: str) -> None:
    """Lines (``value``) as text files, in one folder per ``key`` as ``partitionBy`` names them; equal keys follow each other
    within a partition.  What was at ``path`` is replaced.

    On a file system without permissions of its own Hadoop starts a process for each file it makes, which for many small
    folders is most of the time; there the tasks write the files themselves, each put in place once it is whole."""
    spark = lines.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        lines.write.mode("overwrite").partitionBy(key).text(path)
        return
    fs.delete(root, True)
    fs.mkdirs(root)
    folder = root.toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = f".part-{task.taskAttemptId()}"
        at, out, n = "", None, 0

        def done() -> None:
            if out is not None:
                out.close()
                os.replace(f"{at}/{own}", f"{at}/part-{task.partitionId():05d}-{n:07d}.txt")

        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                to = f"{folder}/{key}={_escaped(name)}"
                if to != at:
                    done()
                    at, n = to, n + 1
                    os.makedirs(at, exist_ok=True)
                    out = open(f"{at}/{own}", "w", encoding="utf-8", newline="")
                out.write(f"{value or ''}\n")
        done()
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    lines.select(F.col(key).cast("string"), "value").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, "_SUCCESS")).close()


def _escaped(name: str | None) -> str:
    """Name of a partition folder for a value, as Spark escapes it."""
    if not name:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def write_obj(nodes: DataFrame, path: str) -> None:
    """Vertices, then parent and child lines, of merged trees."""
    from somagrid.operators.traces import merge_trees

    m = merge_trees(nodes)
    v = m.select(F.lit(0).alias("part"), F.col("merged_idx").alias("i"), F.format_string("v %d %d %d", "z", "y", "x").alias("value"))
    e = m.filter("merged_parent >= 0").select(
        F.lit(1).alias("part"), F.col("merged_idx").alias("i"), F.format_string("l %d %d", F.col("merged_parent") + 1, F.col("merged_idx") + 1).alias("value"))
    v.unionByName(e).repartitionByRange("part", "i").sortWithinPartitions("part", "i").select("value").write.mode("overwrite").text(path)


def export_tracks(spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spots with id, name and colour code by track class, and track edges by id."""
    from somagrid.functions.scalars import EXPORT_COLORS, spot_id
    from somagrid.operators.tracks import track_class, track_edges

    kind = F.col("track_class")
    color = F.when(kind == "new", EXPORT_COLORS["new"]).when(kind == "old", EXPORT_COLORS["old"]).when(
        kind == "both", EXPORT_COLORS["both"]).otherwise(EXPORT_COLORS["all"])
    s = spots.join(track_class(spots), "series").select(
        spot_id("frame", "series").alias("id"), "series", "frame", "x", "y", "z", color.alias("color"))
    e = track_edges(spots).select("series", spot_id("source", "series").alias("source_id"), spot_id("target", "series").alias("target_id"))
    return s, e


def write_tracks(spots: DataFrame, path: str) -> None:
    s, e = export_tracks(spots)
    s.write.mode("overwrite").format("xml").option("rowTag", "Spot").option("rootTag", "AllSpots").save(f"{path}/spots")
    e.write.mode("overwrite").format("xml").option("rowTag", "Edge").option("rootTag", "AllTracks").save(f"{path}/edges")


def write_brain_tables(df: DataFrame, path: str, resume: bool = True) -> DataFrame:
    """Write per-brain partitions.  With ``resume``, brains that are there already
    are left alone; otherwise only the brains in ``df`` are replaced."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if resume and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        done = spark.read.parquet(path).select("dataset").distinct()
        df = df.join(done, "dataset", "left_anti")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)
    return spark.read.parquet(path)


def label_of(paths: DataFrame) -> DataFrame:
    """Label from the last ``_n.`` token of a path; other names are skipped."""
    token = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), "_"), -1)
    n = F.split(token, "\\.")[0].try_cast("int")
    return paths.select("path", n.alias("class_num")).filter("class_num IS NOT NULL").withColumn(
        "label", F.when(F.col("class_num").isin(1, 2, 3), 0).otherwise(1))


def labels_from_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the files of a folder.  Only paths are read, never contents."""
    return label_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path"))


def natural_key(c) -> Column:
    """Sort key in which digit runs compare as numbers."""
    parts = F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda v: F.when(v.rlike(r"^\d"), F.lpad(v, 20, "0")).otherwise(v))


def natural_order(df: DataFrame, c: str) -> DataFrame:
    return df.orderBy(natural_key(c))
