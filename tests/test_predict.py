"""Predicted positions against a walk over all pairs, with a crowd at one position."""

import numpy as np
import pandas as pd

from somagrid.operators import tracks as T

CROP, SCALES = {"z": 10, "y": 20, "x": 20}, [0.5, 1.0, 4.0]


def _walk(pdf):
    at = {(r.series, r.frame): (r.z, r.y, r.x) for r in pdf.itertuples()}
    links = {k: (v, at[k[0], k[1] + 1]) for k, v in at.items() if (k[0], k[1] + 1) in at}
    out = {}
    for (s, f), p in at.items():
        for i, scale in enumerate(SCALES):
            half = [c * (1 + scale) / 2 for c in CROP.values()]
            near = [np.subtract(b, a) for (t, g), (a, b) in links.items()
                    if g == f and all(int(c - h) <= q < int(c + h) for c, h, q in zip(p, half, a))]
            if len(near) >= 4:
                out[s, f] = (*(int(c + m) for c, m in zip(p, np.median(near, axis=0))), len(near), i)
                break
    return out


def test_predicted_positions(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(70):
        p = rng.integers(20, 90, 3) if s >= 30 else np.array([50, 50, 50])  # thirty cells share a position
        for f in range(4):
            if s < 30 and f == 0 or rng.random() < 0.9:
                rows.append((s, f, *map(int, p)))
            p = p + rng.integers(-3, 4, 3) * (f > 0 or s % 3)
    pdf = pd.DataFrame(rows, columns=["series", "frame", "z", "y", "x"])
    got = {(r["series"], r["frame"]): tuple(r)[2:] for r in T.predict_next(spark.createDataFrame(pdf), CROP, SCALES).collect()}
    want = _walk(pdf)
    assert got == want and len({v[-1] for v in want.values()}) == 3


def test_a_crowd_at_one_position(spark):
    n = 20_000  # all pairs would be 400 million rows
    a = pd.DataFrame({"series": np.arange(n), "frame": 0, "z": 5, "y": 5, "x": 5})
    b = a.assign(frame=1, z=5 + a["series"] % 7)
    got = T.predict_next(spark.createDataFrame(pd.concat([a, b])), CROP, SCALES)
    assert got.groupBy("frame", "pred_z", "pred_y", "pred_x", "n_tracked", "scale_index").count().collect() == [(0, 8, 5, 5, n, 0, n)]


def test_no_tracks(spark):
    none = spark.createDataFrame([], "series long, frame long, z long, y long, x long")
    assert T.predict_next(none, CROP, SCALES).count() == 0 and T.predict_next(none, CROP, SCALES[:1]).count() == 0
