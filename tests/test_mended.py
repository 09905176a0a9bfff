"""Cases that once gave wrong results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somagrid.operators import ordered as O, spatial as P, stats as Q, voxels as V
from somagrid.sources import files as S
from somagrid.streaming import blocks as B

AXES = ["z", "y", "x"]


def _brute_clusters(pts, eps, need):
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    near = d2 <= eps * eps
    core = near.sum(1) >= need
    name = np.where(core, np.arange(len(pts)), len(pts))
    while True:
        new = np.where(core, np.where(near & core[None], name[None], len(pts)).min(1), len(pts))
        if (new == name).all():
            break
        name = new
    edge = np.where(near & core[None], name[None], len(pts)).min(1)
    return [None if n == len(pts) else int(n) for n in np.where(core, name, edge)]


@pytest.mark.parametrize("scale", [None, {"z": 2.5}])
@pytest.mark.parametrize("eps, need", [(1.0, 4), (0.6, 3), (3.0, 9)])
def test_dbscan(spark, eps, need, scale):
    rng = np.random.default_rng(11)
    pts = np.vstack([rng.random((180, 3)) * 8, rng.normal(3, 0.4, (60, 3))])
    pts = np.vstack([pts, pts[:5]])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=AXES).assign(i=np.arange(len(pts))))
    got = {r["i"]: r["cluster"] for r in P.dbscan(df, eps, need, "i", scale).collect()}
    want = _brute_clusters(pts * np.array([(scale or {}).get(a, 1.0) for a in AXES]), eps, need)
    assert [got[i] for i in range(len(pts))] == want


def test_dbscan_two_points_in_one_voxel(spark):
    rows = [(0, 0.0, 0.0, 0.2), (1, 0.0, 0.0, 0.8), (2, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, z double, y double, x double")
    assert {tuple(r) for r in P.dbscan(df, 1, 4, "i").collect()} == {(0, None), (1, None), (2, None)}


def test_smooth_keeps_weight_on_a_short_axis(spark):
    one = pd.DataFrame([(z, y, x, 1.0) for z in range(3) for y in range(3) for x in range(3)], columns=[*AXES, "value"])
    got = V.smooth(spark.createDataFrame(one), 2.0, {"z": 3, "y": 3, "x": 3}).toPandas()["value"]
    assert len(got) == 27 and np.allclose(got, 1.0)


def test_ranks_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "k string, v double")
    assert {tuple(r) for r in O.average_ranks(df, ["k"], "v").collect()} == {(None, 1.0, 1.0), (None, 3.0, 2.0), ("a", 2.0, 1.0)}


def test_missing_value_gives_no_p(spark):
    rows = [("r", "a", 1.0), ("r", "a", 2.0), ("r", "a", None), ("r", "b", 5.0), ("r", "b", 6.5), ("s", "a", 1.0), ("s", "a", 2.0), ("s", "b", 5.0), ("s", "b", 6.5)]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    none = {r["k"]: r["p_val"] for r in Q.ttest(df, ["k"], "g", "v", "a", "b").collect()}
    skip = {r["k"]: r["p_val"] for r in Q.ttest(df, ["k"], "g", "v", "a", "b", missing="skip").collect()}
    assert none["r"] is None and none["s"] is not None and skip["r"] == skip["s"] == none["s"]


def test_lines_of_files_in_several_splits(spark, tmp_path):
    want = set()
    for name, n in (("a", 126), ("b", 137), ("c", 3)):
        lines = [f"{name}{i}" + "x" * (i % 37) for i in range(n)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want |= {(name, i, v) for i, v in enumerate(lines)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = {(r["file"].rsplit("/", 1)[1][0], r["line"], r["value"]) for r in S.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_late_frames_keep_their_links(spark, tmp_path):
    spots = spark.createDataFrame([(s, f, f * 2, f, s) for s in (1, 2) for f in range(8)], "series bigint, frame bigint, z bigint, y bigint, x bigint")
    for part in ("frame IN (0, 3, 4, 7)", "frame IN (1, 6)", "frame IN (2, 5)"):
        spots.filter(part).write.mode("append").parquet(f"{tmp_path}/in")
        B.stream_tracks(spark, f"{tmp_path}/in", spots.schema, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").select("series", "frame", "dz", "dy", "dx").collect()
    assert sorted(map(tuple, got)) == [(s, f, 2.0, 1.0, 0.0) for s in (1, 2) for f in range(7)]


def test_density_in_blocks(spark):
    """Cells across block borders, at the edges, below 0 and beyond the far side, against single steps."""
    rng = np.random.default_rng(4)
    shape, r = {"z": 70, "y": 40, "x": 33}, 5
    pts = np.vstack([rng.integers(-4, [74, 44, 37], (300, 3)), [[31, 31, 31]] * 7, [[32, 0, 32]] * 2])
    want: dict = {}
    for p in pts:
        reach = {tuple(min(int(c + o), n - 1) for c, o, n in zip(p, (a, b, c), shape.values()))
                 for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1) if a * a + b * b + c * c <= r * r}
        for v in reach:
            if min(v) >= 0:
                want[v] = want.get(v, 0) + 1
    grid = np.indices(tuple(shape.values())).reshape(3, -1).T
    atlas = spark.createDataFrame(pd.DataFrame(grid, columns=AXES).assign(label=1))
    cells = spark.createDataFrame(pd.DataFrame(pts, columns=AXES))
    got = {(t.z, t.y, t.x): round(t.density * 0.2 ** 3) for t in V.density_map(cells, atlas, r, 20.0, shape).toPandas().itertuples()}
    assert got == want
