"""Links between frames: places meet in tiles and no rows are written for pairs."""

import numpy as np
import pandas as pd

from somagrid.operators import tracks as T
from test_meet import plan


def test_predictions_meet_in_tiles(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"series": range(300), "frame": 0, **{c: rng.integers(-40, 40, 300) for c in "zyx"}})
    b = a.assign(frame=1, **{c: a[c] + rng.integers(-9, 9, 300) for c in "zyx"})
    out = T.predict_next(spark.createDataFrame(pd.concat([a, b])), {"z": 20, "y": 30, "x": 30}, [1.0])
    assert plan(out).count("Join") == 1  # the cells of a place; windows and links do not meet in a join
    got = {r["series"]: (r["pred_z"], r["pred_y"], r["pred_x"], r["n_tracked"]) for r in out.collect()}
    at, step, half = a[list("zyx")].to_numpy(), (b - a)[list("zyx")].to_numpy(), np.array([20, 30, 30])
    want = {}
    for s, p in enumerate(at):
        near = ((at >= p - half) & (at < p + half)).all(axis=1)
        if near.sum() >= 4:
            want[s] = (*np.trunc(p + np.median(step[near], axis=0)).astype(int), near.sum())
    assert got == want and want


def test_windows_with_missing_displacements(spark):
    rows = [(s, 0, s, 0, 0) for s in range(5)] + [(s, 1, None if s < 4 else 9, s, 0) for s in range(5)]
    out = T.predict_next(spark.createDataFrame(rows, "series long, frame long, z long, y long, x long"), {"z": 20, "y": 20, "x": 20}, [1.0])
    assert sorted(tuple(r) for r in out.collect()) == [(s, 0, s + 5, 2, 0, 5, 0) for s in range(5)]


def _two_frames(spark):
    rng = np.random.default_rng(2)
    cells = pd.DataFrame({"frame": rng.integers(0, 3, 400), "cell": range(400), **{c: rng.integers(-20, 20, 400) for c in "zyx"}})
    cand = pd.DataFrame({"frame": rng.integers(0, 4, 500), "cand": [f"c{i}" for i in range(500)], **{c: rng.integers(-25, 25, 500) for c in "zyx"}})
    j = cells.assign(frame=cells.frame + 1).merge(cand, on="frame")
    j["d2"] = sum((j[f"{c}_x"] - j[f"{c}_y"]) ** 2 for c in "zyx")
    return spark.createDataFrame(cells), spark.createDataFrame(cand), j[j.d2 <= 49]


def test_associate(spark):
    cells, cand, near = _two_frames(spark)
    out = T.associate(cells, cand, 7.0)
    assert "_by" not in plan(out) and plan(out).count("Join") == 1
    best = near.sort_values(["d2", "cand"]).drop_duplicates(["frame", "cell"])
    want = {(r.frame - 1, r.cell): (r.cand, round(r.d2 ** 0.5, 9)) for r in best.itertuples()}
    assert {(r["frame"], r["cell"]): (r["cand"], round(r["distance"], 9)) for r in out.collect()} == want and want


def test_linked_ends(spark):
    cells, cand, near = _two_frames(spark)
    for end in ("cell", "cand"):
        out = T.candidate_links(cells, cand, 7.0, only=end)
        got = [tuple(r) for r in out.collect()]
        assert sorted(got) == sorted({(f - 1, i) for f, i in zip(near.frame, near[end])})
        assert sorted(got) == sorted(tuple(r) for r in T.candidate_links(cells, cand, 7.0).select("frame", end).distinct().collect())


def test_frames_within_the_limit_are_settled_without_groups(spark, monkeypatch):
    from test_claims import greedy

    def never(*_):
        raise AssertionError("groups of claims are only for crowded frames")

    rng = np.random.default_rng(3)
    claims = {(int(f), int(a), int(b)): float(rng.integers(0, 9)) for f, a, b in rng.integers(0, 12, (300, 3))}
    claims = [(*k, d) for k, d in claims.items()]
    df = spark.createDataFrame(claims, "frame int, cell int, cand int, distance double")
    monkeypatch.setattr(T, "connected", never)
    assert {tuple(r)[:3] for r in T.resolve_claims(df).collect()} == greedy(claims)
