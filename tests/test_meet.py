"""Rows met tile by tile: results against plain loops, and no pairs between tasks."""

import contextlib
import io

import numpy as np
import pandas as pd

from somagrid.operators import boxes as B, meet as M, spatial as P

AXES = ["z", "y", "x"]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def places(rng, n, extent):
    return pd.DataFrame({a: rng.integers(-extent, extent, n) for a in AXES})


def test_crops(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cells = places(rng, 300, 20).assign(cell_id=[f"c{i % 280}" for i in range(300)])
    cells.loc[5:8, "cell_id"] = None
    vox = places(rng, 4000, 25).drop_duplicates().assign(value=lambda d: np.arange(len(d)) * 1.0)
    half = {"z": 2, "y": 3, "x": 3}
    want = {}
    for c in cells.itertuples():
        for v in vox.itertuples():
            rel = tuple(getattr(v, a) - getattr(c, a) + half[a] for a in AXES)
            if all(0 <= r <= 2 * half[a] - 1 for r, a in zip(rel, AXES)):
                want.setdefault(c.cell_id, []).append((*rel, v.value))
    rows = [(int(c.z), int(c.y), int(c.x), c.cell_id) for c in cells.itertuples()] + [(None, 1, 1, "none")]
    df = spark.createDataFrame(rows, "z long, y long, x long, cell_id string")
    for limit in (B.CROPS, 3):
        monkeypatch.setattr(B, "CROPS", limit)
        got = {r["cell_id"]: [tuple(v) for v in r["voxels"]] for r in B.extract_crops(df, spark.createDataFrame(vox), half).collect()}
        assert got == {k: sorted(v) for k, v in want.items()}
    monkeypatch.undo()
    once = spark.createDataFrame(cells.dropna().drop_duplicates("cell_id"))
    assert "Join" not in plan(B.extract_crops(once, spark.createDataFrame(vox), half))


def test_radius_count(spark):
    rng = np.random.default_rng(4)
    a = places(rng, 400, 12).assign(i=range(400))
    b = places(rng, 900, 12)
    d = ((a[AXES].to_numpy()[:, None] - b[AXES].to_numpy()[None]) ** 2).sum(axis=2)
    out = P.radius_count(spark.createDataFrame(a), spark.createDataFrame(b), 2.5)
    assert plan(out).count("Join") == 1  # only the counts are joined to the rows
    assert {r["i"]: r["n_near"] for r in out.collect()} == dict(enumerate((d <= 6.25).sum(axis=1)))


def test_crowded_tile(spark):
    rows = spark.createDataFrame(pd.DataFrame({"z": [0] * 50, "y": [0] * 50, "x": [0] * 50, "i": range(50)}))

    def kernel(q, p):
        assert q.num_rows < 50
        return q.select(["i"]).append_column("n", M.pa.array([p.num_rows] * q.num_rows, M.pa.int64()))

    got = M.meet(rows, rows, dict.fromkeys(AXES, 1), kernel, "i long, n long", limit=4).collect()
    assert sorted((r["i"], r["n"]) for r in got) == [(i, 50) for i in range(50)]


def test_bridges(spark):
    from somagrid.operators import traces as R

    rng = np.random.default_rng(5)
    body = places(rng, 700, 9).drop_duplicates()
    body["seg"] = (body.z // 4) * 100 + (body.y // 4) * 10 + body.x // 4
    ends = body.iloc[::3]
    want, r = {}, 2
    for kind, points, reach in (("body", body, r), ("end", ends, 2 * r)):
        for e in ends.itertuples():
            best = {}
            for v in points.itertuples():
                off = [abs(getattr(v, a) - getattr(e, a)) for a in AXES]
                if v.seg != e.seg and max(off) <= reach:
                    length = max(off) if kind == "end" else sum(o * o for o in off)
                    best[v.seg] = min(best.get(v.seg, (1e9, ())), (length, (v.z, v.y, v.x)))
            for s, (n, to) in best.items():
                want[e.seg, e.z, e.y, e.x, s] = (kind, round(float(n) if kind == "end" else n ** 0.5, 9), to)
    out = R.bridge_ends(spark.createDataFrame(ends), spark.createDataFrame(body), r)
    assert "Join" not in plan(out)
    got = {(t["seg"], t["z"], t["y"], t["x"], t["other"]): (t["kind"], round(t["length"], 9), tuple(t["to"])) for t in out.collect()}
    assert got == want and {"end", "body"} == {v[0] for v in got.values()}


def test_tree_lines_meet_before_their_nodes(spark, tmp_path):
    from somagrid.sources import files as S

    (tmp_path / "t.txt").write_text("a.tif,s,5,6,7,-1,0,1\na.tif,s,5,6,7,0,20\nb.tif,s,5,6,7,-1,x,0\n")
    out = S.read_trees(spark, str(tmp_path))
    text = plan(out)
    assert text.count("Generate") == 1 and text.index("Generate") < text.index("Join")  # nodes are spread out after the join
    got = sorted((t["name"], t["node"], t["parent"], t["orig_idx"]) for t in out.collect())
    assert [g[:3] for g in got] == [("a", 0, -1), ("a", 1, 0), ("a", 2, 1), ("b", 0, -1), ("b", 1, 0)]
    assert [g[3] for g in got] == [0, 20, None, None, None]


def test_own_atlas_in_runs(spark):
    from pyspark.sql import functions as F

    from somagrid.operators import regions as R

    rng = np.random.default_rng(6)
    atlas = places(rng, 3000, 8).assign(dataset=lambda d: [f"B{i % 3}" for i in range(len(d))]).drop_duplicates()
    atlas = atlas.assign(label=atlas.x // 3, hemisphere=(atlas.z > 0).astype(int))
    cells = places(rng, 500, 9).assign(dataset=[f"B{i % 4}" for i in range(500)], i=range(500))
    want = cells.merge(pd.concat([atlas, atlas[:50].assign(label=99)]), "left", ["dataset", *AXES])
    df = spark.createDataFrame(pd.concat([atlas, atlas[:50].assign(label=99)])).repartition(3)
    out = R.label_cells(spark.createDataFrame(cells), df, by=["dataset"])
    assert out.columns == ["dataset", *AXES, "i", "label", "hemisphere"]
    got = sorted((t["i"], -1 if t["label"] is None else t["label"], t["hemisphere"]) for t in out.collect())
    assert [g[:2] for g in got] == sorted((i, int(v)) for i, v in zip(want.i, want.label.fillna(-1)))
    line = spark.range(200).select(F.lit("a").alias("dataset"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").alias("x"), F.lit(5).alias("label"))
    assert R.packed(line.coalesce(1), ["label"], ["dataset"]).count() == 7  # one run per span of 32


def test_field_is_inverted_in_tiles(spark):
    rng = np.random.default_rng(8)
    atlas = places(rng, 600, 7).drop_duplicates()
    field = places(rng, 60, 7).drop_duplicates()
    for i, a in enumerate(AXES):
        field[f"d{i}"] = np.round(0.02 * (field[a] + rng.integers(-1, 2, len(field))) + 0.004 * (i == 1), 6)
    df = spark.createDataFrame(pd.concat([atlas, atlas[:9]])).unionByName(spark.createDataFrame([(None, 1, 1)], "z long, y long, x long"))
    out = P.invert_field(spark.createDataFrame(field), df, tol_mm=0.06)
    assert "Join" not in plan(out) and out.count() == len(atlas) + 1
    got = {(r["z"], r["y"], r["x"]): (r["src_z"], r["src_y"], r["src_x"]) for r in out.collect()}
    want = {(None, 1, 1): (None,) * 3}
    for v in atlas.itertuples(index=False):
        d2 = sum((getattr(v, a) * 0.02 - field[f"d{i}"]) ** 2 for i, a in enumerate(AXES))
        near = field.assign(d2=d2.round(12))[d2 <= 0.06**2].sort_values(["d2", *AXES])
        want[tuple(v)] = tuple(near[AXES].iloc[0]) if len(near) else (None,) * 3
    assert got == want and sum(w[0] is None for w in want.values()) > 1


def test_stragglers_meet_in_tiles(spark):
    """Fragments get the label that every step around every voxel of theirs meets most often, and no step is a row."""
    from somagrid.operators import voxels as V

    rng = np.random.default_rng(12)
    frag = [(*map(int, p), int(f)) for p, f in zip(rng.integers(-3, 40, (700, 3)), rng.integers(0, 90, 700))]
    lab = [(*map(int, p), int(v)) for p, v in zip(rng.integers(-3, 40, (9000, 3)), rng.integers(0, 7, 9000))]
    frag += frag[:30] + [(5, 5, 5, None), (None, 5, 5, 3)]  # rows that come twice, and some without a name or a place
    lab += lab[:500] + [(5, 5, 6, 4), (5, 5, 5, None), (5, None, 5, 2)]
    tables = lambda t: (spark.createDataFrame([tuple(float(v) if i < 3 and v is not None and t == "double" else v for i, v in enumerate(r)) for r in rows_], f"z {t}, y {t}, x {t}, {c} long") for rows_, c in ((frag, "frag"), (lab, "label")))
    met, stepped = (V.assign_stragglers(*tables(t)) for t in ("long", "double"))
    assert "FlatMapCoGroupsInArrow" in plan(met) and "FlatMapCoGroupsInArrow" not in plan(stepped)
    got = {tuple(r) for r in met.collect()}
    assert got == {tuple(r) for r in stepped.collect()} and any(r[0] is None for r in got)
    at, want = {}, {}
    for z, y, x, v in lab:
        if v and None not in (z, y, x):
            at.setdefault((z, y, x), []).append(v)
    for z, y, x, f in frag:
        if None not in (z, y, x):
            for i, j, k in np.ndindex(3, 3, 3):
                for v in at.get((z + i - 1, y + j - 1, x + k - 1), ()):
                    n = want.setdefault(f, {})
                    n[v] = n.get(v, 0) + 1
    assert got == {(f, *min(((v, n) for v, n in m.items()), key=lambda e: (-e[1], e[0]))) for f, m in want.items()}
