"""Owners of the voxels of overlapping boxes against plain Python."""

import numpy as np
import pandas as pd
import pytest

from somagrid.operators import boxes as B
from test_space import AXES


def plain_owners(boxes):
    held = {}
    for i, z0, y0, x0, z1, y1, x1 in boxes:
        for z in range(z0, z1):
            for y in range(y0, y1):
                for x in range(x0, x1):
                    held.setdefault((z, y, x), []).append(i)
    mid = [(i, [int(np.rint((b - a) / 2 + a)) for a, b in zip(c[:3], c[3:])]) for i, *c in boxes]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in mid)[1]
    return {(*p, ids[0] if len(ids) == 1 else near(p)) for p, ids in held.items()}


@pytest.mark.parametrize("n,span,size", [(150, 60, 5), (25, 20, 16), (40, 110, 30)])
def test_owners(spark, n, span, size):
    """Small and large boxes over tile borders, equal boxes, centres out of reach."""
    rng = np.random.default_rng(n)
    low = rng.integers(-20, span - 20, (n, 3))
    low[:5] = low[5:10]
    width = rng.integers(1, size, (n, 3))
    width[:5] = width[5:10]
    boxes = [(int(i), *map(int, a), *map(int, a + b)) for i, a, b in zip(rng.permutation(n), low, width)]
    boxes += boxes[:3]
    df = spark.createDataFrame(pd.DataFrame(boxes, columns=["box", "z0", "y0", "x0", "z1", "y1", "x1"]))
    got = B.split_overlaps(df)
    found = got.collect()
    assert {(r["z"], r["y"], r["x"], r["box"]) for r in found} == plain_owners(boxes) and len(found) == len({tuple(r)[:3] for r in found})
    every = B.box_voxels(df, ["box"]).select(*AXES).distinct()
    assert got.select(*AXES).exceptAll(every).isEmpty() and got.count() == every.count()


def test_voxels_of_boxes_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 9, 9, 9), (2, 5, 5, 5, 9, 9, 9), (3, None, 0, 0, 1, 1, 1)], "box long, z0 long, y0 long, x0 long, z1 long, y1 long, x1 long")
    got = B.split_overlaps(df)
    assert got.count() == 9 ** 3 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
