"""Gaps of skeletons against all pairs in plain Python."""

import numpy as np
import pytest

from somagrid.operators import traces as R
from test_space import AXES, frame, rows


def plain_gaps(pts):
    out = set(pts)
    for a in pts:
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), f"{b[0]},{b[1]},{b[2]}", b) for b in pts if b != a)[:2]
        for d2, _, b in near:
            n = max(abs(x - y) for x, y in zip(a, b))
            if d2 >= 4 and n > 1:
                out |= {tuple(int(np.rint(x + (y - x) * i / n)) for x, y in zip(a, b)) for i in range(1, n)}
    return out


@pytest.mark.parametrize("size,n", [((70, 12, 9), 200), ((40, 37, 12), 700), ((90, 80, 70), 40)])
def test_gaps(spark, size, n):
    """Ties, block borders and places beyond the reach of a block; negative positions, rows twice and without a place."""
    rng = np.random.default_rng(n)
    pts = {tuple(int(v) for v in p) for p in rng.integers(0, size, (n, 3)) - 33}
    df = frame(spark, [*pts, *list(pts)[:9]])
    assert rows(R.fill_gaps(df), *AXES) == plain_gaps(pts)
    gone = spark.createDataFrame([(None, 1, 2)], "z long, y long, x long")
    assert rows(R.fill_gaps(df.unionByName(gone)), *AXES) == plain_gaps(pts) | {(None, 1, 2)}
    assert R.fill_gaps(gone.limit(0)).count() == 0


def test_gaps_of_near_neighbours_ask_no_search(spark, monkeypatch):
    """Before, every position went through the search over all of them."""
    def search(*a, **k):
        raise AssertionError("searched")
    monkeypatch.setattr(R, "knn", search)
    pts = {(z, y, 0) for z in range(40) for y in range(0, 9, 3)}
    assert rows(R.fill_gaps(frame(spark, sorted(pts))), *AXES) == plain_gaps(pts)
