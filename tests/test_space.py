"""Voxel and neighbour operators against brute force on small fixtures."""

from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somagrid.operators import components as C, spatial as P, traces as R, tracks as T, voxels as V
from somagrid.operators.reshape import split

AXES = ["z", "y", "x"]


def frame(spark, pts, extra=None):
    pdf = pd.DataFrame(np.asarray(pts, dtype=np.int64), columns=AXES)
    return spark.createDataFrame(pdf.assign(**(extra or {})))


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def packed(p):
    return (int(p[0]) << 42) | (int(p[1]) << 21) | int(p[2])


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    return np.argwhere(rng.random((14, 13, 12)) < 0.25)


def flood(points, steps, same=None):
    pts = {tuple(p): (same[i] if same is not None else 0) for i, p in enumerate(points)}
    comp = {}
    for p in sorted(pts):
        if p in comp:
            continue
        comp[p], todo = p, deque([p])
        while todo:
            q = todo.popleft()
            for s in steps:
                n = tuple(a + b for a, b in zip(q, s))
                if n in pts and n not in comp and pts[n] == pts[q]:
                    comp[n] = p
                    todo.append(n)
    return comp


@pytest.mark.parametrize("conn", [6, 18, 26])
def test_components(spark, cloud, conn):
    got = rows(C.label_components(frame(spark, cloud), conn, block=4), *AXES, "component")
    assert got == {(*p, packed(r)) for p, r in flood(cloud, C.offsets(conn)).items()}


def test_components_within_label(spark, cloud):
    lab = [int(p[2]) // 3 for p in cloud]
    got = rows(C.label_components(frame(spark, cloud, {"label": lab}), 6, "label", block=5), *AXES, "component")
    assert got == {(*p, packed(r)) for p, r in flood(cloud, C.offsets(6), lab).items()}


def test_long_chain(spark):
    edges = spark.range(500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = C.connected(edges, spark.range(502))
    assert got.filter("id <= 500 AND component <> 0").count() == 0
    assert got.filter("id = 501").first()["component"] == 501


def test_seeded_split(spark, cloud):
    pts = {tuple(int(v) for v in p) for p in cloud}
    seeds = sorted(pts)[::40]
    got = rows(V.seeded_split(frame(spark, cloud), frame(spark, seeds, {"label": range(1, len(seeds) + 1)}), leftover=None), *AXES, "label")
    want = {s: i + 1 for i, s in enumerate(seeds)}
    front = dict(want)
    while front:
        new = {}
        for p, lab in front.items():
            for s in C.offsets(6):
                n = tuple(a + b for a, b in zip(p, s))
                if n in pts and n not in want:
                    new[n] = min(lab, new.get(n, 10**9))
        want.update(new)
        front = new
    assert got == {(*p, lab) for p, lab in want.items()}


def test_seeded_split_leftover(spark):
    mask = [(0, 0, x) for x in range(5)] + [(5, 0, x) for x in range(4)] + [(9, 9, 9)]
    got = rows(V.seeded_split(frame(spark, mask), frame(spark, [(0, 0, 0)], {"label": [7]}), leftover=2), *AXES, "label")
    assert got == {(0, 0, x, 7) for x in range(5)} | {(5, 0, x, 8) for x in range(4)}


def test_local_maxima(spark, cloud):
    rng = np.random.default_rng(2)
    val = rng.integers(1, 6, len(cloud)).astype(float)
    got = rows(V.local_maxima(frame(spark, cloud, {"distance": val}), min_distance=2), *AXES, "distance")
    v = {tuple(int(q) for q in p): d for p, d in zip(cloud, val)}
    cube = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    peaks = {p for p in v if all(v.get(tuple(a + b for a, b in zip(p, s)), 0) <= v[p] for s in cube)}
    kept = {g[:3] for g in got}
    far = lambda a, b: max(abs(i - j) for i, j in zip(a, b))
    assert kept <= peaks
    assert all(far(a, b) > 2 for a in kept for b in kept if a != b)
    assert all(any(far(p, k) <= 2 and v[k] >= v[p] for k in kept) for p in peaks)


def test_distance_map_without_bounds(spark, cloud):
    got = {r[:3]: r[3] for r in rows(V.distance_map(frame(spark, cloud), 4), *AXES, "distance")}
    pts = {tuple(int(v) for v in p) for p in cloud}
    reach = [s for s in V.footprint("ball", 4)]
    for p in pts:
        d = [np.sqrt(sum(v * v for v in s)) for s in reach if tuple(a + b for a, b in zip(p, s)) not in pts]
        assert abs(got[p] - min(d)) < 1e-9


def test_elongation(spark):
    rng = np.random.default_rng(0)
    pts = np.unique(np.round(rng.normal(size=(400, 3)) * [6, 1, 2]).astype(int) + 40, axis=0)
    r = V.elongation(frame(spark, pts, {"label": 1}), big=10_000, small=10, ratio=3.0).first()
    w = np.linalg.eigvalsh(np.cov(pts.T, bias=True))
    assert abs(r["major"] - 4 * np.sqrt(w[-1])) < 1e-6 and abs(r["minor"] - 4 * np.sqrt(w[0])) < 1e-6
    assert r["keep"] == (np.sqrt(w[-1] / w[0]) > 3.0)


def test_corrections(spark):
    lab = [((0, 0, x), 1) for x in range(6)] + [((2, 0, x), 2) for x in range(6)] + [((4, 0, x), 3) for x in range(6)] + [((6, 0, x), 4) for x in range(6)]
    codes = [((0, 0, 0), 1), ((2, 0, 1), 2), ((4, 0, 5), 4), ((4, 0, 6), 4), ((8, 0, 0), 3), ((5, 0, 2), 7), ((6, 0, 2), 7), ((4, 0, 2), 7)]
    L = frame(spark, [p for p, _ in lab], {"label": [v for _, v in lab]})
    K = frame(spark, [p for p, _ in codes], {"code": [v for _, v in codes]})
    got = {r[:3]: r[3] for r in rows(V.apply_corrections(L, K, 2), *AXES, "label")}
    assert (0, 0, 0) not in got and got[(0, 0, 1)] == 1          # code 1 clears a voxel
    assert (2, 0, 0) not in got and got[(2, 0, 1)] not in (0, 1)  # object with code 2 goes, the code piece stays
    assert got[(4, 0, 6)] == got[(4, 0, 0)]                       # code 4 extends the object it touches
    assert got[(6, 0, 0)] == got[(4, 0, 0)] == max(got.values())  # code 7 merges
    assert (8, 0, 0) in got


def test_knn_far_and_crowded(spark):
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.integers(0, 6, (200, 3)), np.full((50, 3), 3), [[500, 0, 0], [502, 0, 0], [0, 3000, 0]]])
    df = frame(spark, pts, {"id": [f"{i:04d}" for i in range(len(pts))]})
    got = {}
    for r in P.knn(df, df.withColumnRenamed("id", "near"), 3, "id", "near", 1.0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["near"], r["distance"]))
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(1))
        want = sorted((d[j], f"{j:04d}") for j in range(len(pts)) if j != i)[:3]
        have = sorted(got[f"{i:04d}"])
        assert [h[1] for h in have] == [w[1] for w in want] and np.allclose([h[2] for h in have], [w[0] for w in want])


def test_resolve_claims(spark):
    rng = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 25, (150, 2))}
    dist = {p: float(np.round(rng.random(), 2)) for p in pairs}
    df = spark.createDataFrame([(0, a, b, d) for (a, b), d in dist.items()], "frame int, cell int, cand int, distance double")
    used_a, used_b, want = set(), set(), set()
    for d, a, b in sorted((d, a, b) for (a, b), d in dist.items()):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    assert rows(T.resolve_claims(df), "cell", "cand") == want


def test_fill_gaps(spark):
    got = rows(R.fill_gaps(frame(spark, [(0, 0, 0), (0, 0, 1), (0, 0, 4), (0, 0, 5), (0, 0, 6)])), *AXES)
    assert got == {(0, 0, x) for x in range(7)}


def triangle(values, bins=256):
    """Triangle threshold by its definition: the bin farthest below the line from
    the peak to the far end of the histogram."""
    n, edges = np.histogram(values, bins)
    centre = (edges[:-1] + edges[1:]) / 2
    peak, low, high = n.argmax(), np.nonzero(n)[0][0], np.nonzero(n)[0][-1]
    far = high if peak - low < high - peak else low
    bins_ = [b for b in range(min(far, peak), max(far, peak) + 1) if b != peak]
    gap = {b: n[peak] * abs(b - far) - abs(peak - far) * n[b] for b in bins_}
    return centre[max(bins_, key=lambda b: (gap[b], -abs(b - far)))]


def test_triangle_threshold(spark):
    rng = np.random.default_rng(9)
    for values in (rng.gamma(2.0, 20.0, 900), 200 - rng.gamma(2.0, 20.0, 900)):
        pts = np.argwhere(np.ones((1, 30, 30), bool))
        got = V.hist_threshold(frame(spark, pts, {"value": values}), "triangle").first()[0]
        assert abs(got - triangle(values)) < 1e-6


def test_tissue_mask(spark):
    rng = np.random.default_rng(9)
    vol = np.floor(rng.gamma(1.0, 4.0, (3, 20, 20)))
    vol[:, 5:15, 5:15] += 150
    pts = np.argwhere(np.ones_like(vol, bool))
    t = triangle(vol[1].ravel()) + 5
    t = 100 if t > 200 else t
    bright = np.argwhere(vol > t)
    comp = flood(bright, C.offsets(26))
    roots = list(comp.values())
    best = max(set(roots), key=lambda r: (roots.count(r), tuple(-v for v in r)))
    got = rows(V.tissue_mask(frame(spark, pts, {"value": vol.ravel()})), *AXES)
    assert got == {tuple(int(v) for v in p) for p, r in comp.items() if r == best}


def test_split_is_stable(spark):
    df = spark.range(1000)
    a = rows(split(df, "id").filter("holdout"), "id")
    assert a == rows(split(df.repartition(7), "id").filter("holdout"), "id") and 60 < len(a) < 140


def test_dilation_contains_input_and_erosion_undoes_it(spark, cloud):
    v = frame(spark, cloud)
    big = V.dilate(v, "cube", 1)
    assert rows(v, *AXES) <= rows(big, *AXES)
    assert rows(v, *AXES) <= rows(V.erode(big, "cube", 1), *AXES)


def test_cut_goes_to_the_named_folder(spark, checkpoint_dir):
    from pathlib import Path

    from somagrid.session import checkpoint_root, cut, release

    assert checkpoint_root(spark).removeprefix("file:") == checkpoint_dir
    t = cut(spark.range(3))
    name = t._cut_path.rsplit("/", 1)[-1]
    assert t.count() == 3 and name in {p.name for p in Path(checkpoint_dir).iterdir()}
    release(t)
    assert name not in {p.name for p in Path(checkpoint_dir).iterdir()}
