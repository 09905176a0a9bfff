"""Work is dealt to tasks by its size."""

import pathlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from somagrid import session
from somagrid.operators import spatial as P, voxels as V
from somagrid.operators.meet import close, meet, positions
from somagrid.registry import derived as D


def test_atlas_is_made_by_many_tasks(spark, tmp_path):
    spark.createDataFrame(pd.DataFrame({"p_partkey": range(4096)})).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(pd.DataFrame({"s_suppkey": range(20)})).write.parquet(f"{tmp_path}/supplier.parquet")
    per = [r["n"] for r in D.atlas(spark, tmp_path).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per) == 512 * 1024 and len(per) > 4 and max(per) < 512 * 1024 / 4


@pytest.mark.parametrize("pairs", [1 << 20, 16])
def test_node_links_join_like_all_pairs(monkeypatch, pairs):
    """A tile's links are few, and join the cells that any two positions within reach join."""
    monkeypatch.setattr(P, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    for n, eps in ((400, 0.9), (60, 1.7), (900, 0.4)):
        x = rng.random((n, 3)) * 8
        cell = np.floor(x / (eps / 3 ** 0.5 * (1 - 1e-9))).astype(int)
        name = np.array([",".join(map(str, c)) for c in cell])
        t = pa.table({**{a: x[:, i] for i, a in enumerate("zyx")}, **{f"_c{a}": cell[:, i] for i, a in enumerate("zyx")}, "_node": name.astype(object)})
        links = P._node_links(t, t, eps).to_pylist()
        assert len(links) < len(set(name))
        near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps

        def groups(edges):
            root = {k: k for k in name}
            for _ in range(len(root)):
                old = dict(root)
                for a, b in edges:
                    root[a] = root[b] = min(root[a], root[b])
                if old == root:
                    return root

        assert groups([(r["src"], r["dst"]) for r in links]) == groups({(name[i], name[j]) for i, j in zip(*np.nonzero(near))})


def test_density_beside_atlas_columns(spark):
    """Each atlas row has its label beside the density, and no shuffle holds a row per voxel."""
    cells = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 1, 1), ("b", 33, 0, 2), ("b", 40, 1, 1)], ["dataset", *"zyx"])
    grid = [(b, z, y, x, x % 2 + (b == "b") * 5, 1) for b in "ab" for z in range(36) for y in range(3) for x in range(3)]
    atlas = spark.createDataFrame([*grid, ("a", 1, 1, 1, 9, 1), ("a", 0, 0, 0, 0, 1), (None, 1, 1, 1, 4, 1)], ["dataset", *"zyx", "label", "hemisphere"])
    shape = {"z": 36, "y": 3, "x": 3}
    got = V.density_map(cells, atlas, 2, 500.0, shape, by=["dataset"], cols=["label"])
    plain = V.density_map(cells, atlas, 2, 500.0, shape, by=["dataset"])
    joined = plain.join(atlas.filter("label > 0").drop("hemisphere"), ["dataset", *"zyx"]).select(got.columns)
    assert got.count() > 30 and sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))
    assert (1, 1, 1, 9, 2 / 8) in {tuple(r)[1:] for r in got.collect()}
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_large_voxel_tables_are_shared_out(spark, tmp_path, monkeypatch):
    """A task takes a bounded number of rows, and components and voxels stay what they are."""
    n = 4000
    spark.createDataFrame(pd.DataFrame({"l_orderkey": range(n), "l_partkey": [i * 7 % 800 for i in range(n)], "l_suppkey": [i % 50 for i in range(n)],
                                        "l_linenumber": [i % 7 for i in range(n)], "l_quantity": [float(i % 50) for i in range(n)]})).write.parquet(f"{tmp_path}/lineitem.parquet")
    small = [set(map(tuple, t.collect())) for t in (D.voxels(spark, tmp_path), V.largest_component(D.object_voxels(spark, tmp_path), limit=2))]
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    v = D.voxels(spark, tmp_path)
    sizes = [r["n"] for r in v.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 30 and max(sizes) < 250
    assert [set(map(tuple, t.collect())) for t in (v, V.largest_component(D.object_voxels(spark, tmp_path), limit=2))] == small


def test_inverse_field_travels_as_runs(spark, monkeypatch):
    """A field of equal moves is few rows, in any order and with holes, and gives what every voxel by itself gives."""
    sent, real = [], P.packed
    monkeypatch.setattr(P, "packed", lambda *a: sent.append(real(*a)) or sent[-1])
    rng = np.random.default_rng(2)
    place = [(z, y, x) for z in range(6) for y in range(4) for x in range(40)]
    vox = spark.createDataFrame([(*p, float(i % 17), (p[2] // 3) * 10 + p[0] // 3) for i, p in enumerate(place) if i % 3], ["z", "y", "x", "value", "label"])
    field = spark.createDataFrame([(*p, *(0.02 * v for v in p)) for p in place], [*"zyx", "d0", "d1", "d2"])
    inverse = [(c, *p, p[0] - i, p[1], p[2] - (i + p[2] // 20)) for i, c in enumerate("ab") for p in place if p[2] % 13 and p != (0, 0, 7)] + [("a", 0, 0, 0, None, 0, 0), ("a", 3, 0, 39, 3, 0, 39)]
    inverse = [inverse[i] for i in rng.permutation(len(inverse))]
    names = ["control", *"zyx", "src_z", "src_y", "src_x"]
    kind = lambda t: ", ".join(f"{n} {'string' if n == 'control' else t if n[0] == 's' else 'long'}" for n in names)
    volumes = vox.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("control"), *"zyx", "value")
    run = lambda inv: sorted(map(tuple, P.control_intensity(vox.select(*"zyx", "label"), field, inv, volumes, {"z": 6, "y": 4, "x": 40}).collect()))
    got = run(spark.createDataFrame(inverse, kind("long")).coalesce(1))
    assert len(sent) == 1 and sent[0].count() < len(inverse) / 4
    assert got == run(spark.createDataFrame([(*r[:4], *(None if v is None else float(v) for v in r[4:])) for r in inverse], kind("double"))) and len(sent) == 1
    assert len({v for _, _, v in got}) > 5


def test_clusters_leave_few_tables(spark, monkeypatch):
    """Tables written on the way to the clusters are gone once the next one holds their rows."""
    made, real = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: made.append(real(df)) or made[-1])
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"{i:03d}", *map(int, p)) for i, p in enumerate(rng.integers(0, 30, (300, 3)))], "id string, z long, y long, x long")
    got = P.dbscan(df, 4.0, 5, "id")
    left = [t for t in made if pathlib.Path(t._cut_path).exists()]
    assert len(made) == 7 and len(left) == 3 and got.count() == 300


def test_copies_go_only_where_rows_are(spark):
    """With few left rows, copies of the right ones for other tiles are dropped, and the pairs stay the same."""
    rng = np.random.default_rng(6)
    a, b = (spark.createDataFrame(pd.DataFrame(rng.integers(low, high, (n, 3)), columns=["z", "y", "x"])) for low, high, n in ((0, 9, 12), (-40, 60, 3000)))
    count = lambda q, p: pa.table({"n": [q.num_rows], "m": [p.num_rows], "s": [sum(len(i) for i, _ in close(positions(q), positions(p), 3.0))]})
    every, some = ([r for r in meet(a, b, dict.fromkeys("zyx", 3.0), count, "n long, m long, s long", edge=dict.fromkeys("zyx", 6.0), few=few).collect()] for few in (False, True))
    assert sorted(r for r in every if r["n"]) == sorted(some) and len(every) > len(some)
