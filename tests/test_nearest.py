"""Nearest neighbours against all pairs: crowds, far places, groups, and the way down the pyramid."""

import numpy as np
import pandas as pd
import pytest

from somagrid.operators import nearest as N
from test_meet import plan


def brute(rows, pts, k):
    """{id: [(near, distance)]} of (id, group, position) rows and points."""
    out = {}
    for i, g, p in rows:
        d = sorted((float(np.sqrt(((np.array(p) - np.array(r)) ** 2).sum())), j) for j, h, r in pts if h == g and j != i)
        out[i] = d[:k]
    return {i: v for i, v in out.items() if v}


def result(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["distance"], r["near"]))
    return {i: [v[1:] for v in sorted(rows)] for i, rows in got.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for i in got:
        assert [n for _, n in got[i]] == [n for _, n in want[i]], i
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]])


def table(spark, rows, whole):
    t = "long" if whole else "double"
    return spark.createDataFrame([(i, g, *(p if not whole else map(int, p))) for i, g, p in rows], f"id string, brain string, z {t}, y {t}, x {t}")


@pytest.fixture(scope="module")
def places():
    """Two brains: a dense cube, crowded positions, a thin line, lone points far off on both sides of 0."""
    rng = np.random.default_rng(17)
    a = [*rng.integers(0, 12, (300, 3)), *np.full((40, 3), 5), *[[0, 0, v * 9] for v in range(-20, 20)], [4000, -7, 0], [-900, 0, 0], [4001, -7, 0]]
    b = [*rng.integers(-30, 30, (60, 3)), *np.full((9, 3), 2)]
    rows = [("a", p) for p in a] + [("b", p) for p in b]
    return [(f"{i:04d}", g, tuple(map(float, p))) for i, (g, p) in enumerate(rows)]


@pytest.mark.parametrize("limit,edge,whole", [(1 << 20, 2.0, True), (1 << 20, 0.7, False), (0, 2.0, True), (60, 3.0, False)])
def test_knn(spark, places, limit, edge, whole):
    """With a limit of 0 every position goes down the pyramid, with 60 some do."""
    df = table(spark, places, whole)
    got = result(N.knn(df, df.withColumnRenamed("id", "near"), 4, "id", "near", edge, by=["brain"], limit=limit))
    same(got, brute(places, places, 4))


def test_other_points(spark, places):
    """Queries that are no points, fewer points than asked for, a brain without points."""
    pts = [(f"p{i}", "a", p) for i, (_, _, p) in enumerate(places[:3])]
    got = result(N.knn(table(spark, places, True), table(spark, pts, True).withColumnRenamed("id", "near"), 5, "id", "near", by=["brain"]))
    same(got, brute(places, pts, 5))
    none = table(spark, pts, True).limit(0)
    assert N.knn(table(spark, places, True), none.withColumnRenamed("id", "near"), 5, "id", "near", by=["brain"]).count() == 0
    assert N.knn(none, table(spark, pts, True).withColumnRenamed("id", "near"), 5, "id", "near").count() == 0


def test_missing_positions(spark):
    df = spark.createDataFrame([("a", 1, 1, 1), ("b", None, 1, 1), ("c", 2, 1, 1)], "id string, z long, y long, x long")
    got = result(N.knn(df, df.withColumnRenamed("id", "near"), 2, "id", "near"))
    assert got == {"a": [(1.0, "c")], "c": [(1.0, "a")]}


@pytest.mark.parametrize("by", [[], ["b"]])
def test_counts_level_by_level(spark, by):
    """Counting and looking up one level at a time finds the same neighbours; wanted copies of points meet a short list of blocks before they are shuffled."""
    rng = np.random.default_rng(9)
    p = np.vstack([rng.integers(0, 12, (300, 3)), rng.integers(0, 900, (60, 3))])
    df = spark.createDataFrame(pd.DataFrame(p, columns=["z", "y", "x"]).assign(b=np.arange(360) % 2, _pid=np.arange(360))).select(*by, "z", "y", "x", "_pid")
    spots = df.select(*by, "z", "y", "x").distinct()
    found = [N.candidates(spots, df, 4, 2.0, by, [], many=many) for many in (1 << 17, 40, 0)]
    assert any("LeftSemi" in line and "Broadcast" in line for line in plan(found[0]).splitlines())
    a, b, c = ({tuple(r[:-1]): [(v["d2"], v["pid"]) for v in r[-1]] for r in f.collect()} for f in found)
    assert a == b == c and len(a) == spots.count()
    for r, near in a.items():
        d = sorted((float(((q - r[-3:]) ** 2).sum()), i) for i, q in enumerate(p) if not by or i % 2 == r[0])
        assert near == d[:4]


def test_rows_take_their_ids_along(spark, places, monkeypatch):
    """What is found in a block is not shuffled again, and blocks of many rows are shared out."""
    df = table(spark, places, True)
    search = lambda: N.knn(df, df.withColumnRenamed("id", "near"), 4, "id", "near", by=["brain"])
    got = search()
    assert "Exchange" not in plan(got).split("FlatMapCoGroupsInArrow")[0]
    monkeypatch.setattr(N, "ROWS", 16)
    same(result(search()), result(got))
    assert "_part" in plan(search())
