"""Streams that stop and go on: late frames, repeated rows, long tracks, what the state holds."""

import numpy as np
import pandas as pd
import pytest

from somagrid.operators import tracks as T
from somagrid.streaming import blocks as B


def _spots(rng, n_tracks, frames):
    rows = []
    for s in range(n_tracks):
        own = np.arange(frames) if s == 0 else np.flatnonzero(rng.random(frames) < 0.8)
        rows += [(s, int(f), *map(int, rng.integers(0, 100, 3))) for f in own]
    return pd.DataFrame(rows, columns=["series", "frame", "z", "y", "x"])


@pytest.mark.parametrize("width", [8, 4096])
def test_links_over_restarts(spark, tmp_path, width):
    rng = np.random.default_rng(4)
    pdf = _spots(rng, 5, 60)
    schema = spark.createDataFrame(pdf).schema
    part = rng.integers(0, 3, len(pdf))  # frames come in any order, over three runs
    for k in range(3):
        own = pdf[part == k]
        spark.createDataFrame(own, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        B.stream_tracks(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", files_per_trigger=1, width=width)
    # rows that were seen, and rows without a key, change nothing
    again = spark.createDataFrame([(0, 5, 1, 1, 1), (0, 59, 2, 2, 2), (None, 1, 1, 1, 1), (1, None, 1, 1, 1)], schema)
    again.write.mode("append").parquet(f"{tmp_path}/in")
    B.stream_tracks(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", width=width)
    cols = ["series", "frame", "dz", "dy", "dx"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()))
    want = sorted(map(tuple, T.link_frames(spark.createDataFrame(pdf)).select(*cols).collect()))
    assert got == [tuple(map(float, r)) for r in want] and len(got) == len(set(got))
    # of the whole track of 60 frames only the ends of its blocks are kept
    kept = spark.read.format("statestore").load(f"{tmp_path}/state").selectExpr("key.*", "value.groupState.runs AS runs").filter("series = 0")
    assert [len(r["runs"]) for r in kept.collect()] == [8] * -(-60 // width)


def test_timer_forgets_blocks(spark, tmp_path):
    schema = "series long, frame long, z long, y long, x long"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        B.stream_tracks(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", late_frames=20, width=8)

    feed([(1, f, f, 0, 0) for f in range(4)] + [(2, 0, 9, 9, 9)])
    feed([(1, 4, 4, 0, 0), (1, 100, 0, 0, 0)])
    feed([(1, 101, 3, 0, 0)])
    feed([(2, 1, 9, 9, 9)])  # a hundred frames late
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("series", "frame", "dz").collect()))
    assert got == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (1, 100, 3.0)]
    left = spark.read.format("statestore").load(f"{tmp_path}/state").selectExpr("key._block AS b").collect()
    assert {r["b"] for r in left} == {12}


def test_joined_runs():
    one = lambda f, p: [f, f, p, p, p, p, p, p]
    links, runs = B._joined(np.array([one(3, 1.0), one(1, 5.0), one(2, 7.0), one(2, 6.0), one(9, 0.0)]))
    assert links.tolist() == [[1, 1, 1, 1], [2, -5, -5, -5]]
    assert runs.tolist() == [[1, 3, 5, 5, 5, 1, 1, 1], one(9, 0.0)]
    links, runs = B._joined(np.zeros((0, 8)))
    assert len(links) == 0 and len(runs) == 0
