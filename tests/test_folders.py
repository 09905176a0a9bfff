"""Text files in one folder per tree."""

import numpy as np
from pyspark.sql import functions as F

from somagrid.sources import files as S
from test_space import frame


def test_folders(spark, tmp_path):
    """One folder per value with Spark's names, lines in order, nothing left over from before."""
    names = ["a", "a/b=c", None, "", "x y", "é%", "c:\\d"]
    df = spark.createDataFrame([(n, f"{n} {i}") for n in names for i in range(5)] + [("a", None)], "name string, value string").repartition(3, "name").sortWithinPartitions("name", "value")
    path, plain = str(tmp_path / "t"), str(tmp_path / "plain")
    spark.range(3).withColumn("value", F.lit("old")).select("id", "value").write.partitionBy("id").text(path)
    S.write_folders(df, path, "name")
    df.write.partitionBy("name").text(plain)
    tell = lambda p: sorted((f.relative_to(p).parts[0], line) for f in p.rglob("*.txt") for line in f.read_text(encoding="utf-8").split("\n"))
    assert tell(tmp_path / "t") == tell(tmp_path / "plain")
    assert sorted(map(tuple, spark.read.text(path).collect()), key=str) == sorted(map(tuple, spark.read.text(plain).collect()), key=str)
    assert not [f for f in (tmp_path / "t").rglob(".part*")] and (tmp_path / "t" / "_SUCCESS").exists() and not list((tmp_path / "t").rglob("*.crc*t"))


def test_trees_in_folders(spark, tmp_path):
    df = frame(spark, np.arange(60).reshape(20, 3)).withColumns({"tree": F.expr("z div 30"), "cur_idx": -F.col("z"), "parent": F.lit(-1)})
    S.write_swc(df, str(tmp_path / "s"))
    for t in (0, 1):
        files = sorted((tmp_path / "s" / f"tree={t}").iterdir())
        idx = [int(line.split()[0]) for f in files for line in f.read_text().splitlines()]
        assert idx == sorted(idx) and len(idx) == 10
