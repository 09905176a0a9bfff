"""Floods and distance maps over several blocks against queues and all pairs in plain Python."""

import heapq
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from somagrid.operators import components as C, distance as D, flood as L
from test_space import AXES, frame, rows


def near(p, steps):
    return (tuple(a + b for a, b in zip(p, s)) for s in steps)


def plain_flood(height, seeds, steps):
    """Levels by a queue of least level, then waves from where each level is reached, the smaller label first."""
    level, todo = {}, []
    for p in seeds:
        heapq.heappush(todo, (height[p], p))
    while todo:
        h, p = heapq.heappop(todo)
        if p in level:
            continue
        level[p] = h
        for q in near(p, steps):
            if q in height and q not in level:
                heapq.heappush(todo, (max(h, height[q]), q))
    best, todo = {}, [((level[p], 0, lab), p) for p, lab in seeds.items() if level[p] == height[p]]
    heapq.heapify(todo)
    while todo:
        key, p = heapq.heappop(todo)
        if p in best:
            continue
        best[p] = key
        for q in near(p, steps):
            if q in height and q not in best and max(key[0], height[q]) == level[q]:
                heapq.heappush(todo, ((level[q], 1 if key[0] < level[q] else key[1] + 1, key[2]), q))
    return {p: k[2] for p, k in best.items()}


@pytest.fixture(scope="module")
def cave():
    rng = np.random.default_rng(31)
    pts = np.argwhere(rng.random((9, 26, 21)) < 0.45) + np.array([-7, 50, 3])
    return [tuple(int(v) for v in p) for p in pts]


@pytest.mark.parametrize("connectivity,block", [(6, 8), (26, 5), (6, 32)])
def test_by_steps(spark, cave, connectivity, block):
    steps = C.offsets(connectivity)
    seeds = {p: 1000 - i for i, p in enumerate(cave[::311])}
    got = rows(L.flood(frame(spark, cave), frame(spark, list(seeds), {"label": list(seeds.values())}), connectivity=connectivity, block=block), *AXES, "label")
    want = plain_flood(dict.fromkeys(cave, 0.0), seeds, steps)
    assert got == {(*p, v) for p, v in want.items()} and len(got) > len(cave) // 2


@pytest.mark.parametrize("levels,block", [(3, 8), (40, 6)])
def test_by_height(spark, cave, levels, block):
    """Plateaus and slopes; seeds on hills and in hollows; two labels on one voxel."""
    rng = np.random.default_rng(levels)
    height = {p: float(rng.integers(0, levels)) for p in cave}
    seeds = {p: 5 + 3 * i for i, p in enumerate(cave[::501])}
    twice = frame(spark, [*seeds, *seeds, (99, 99, 99)], {"label": [*seeds.values(), *(v + 1 for v in seeds.values()), 1]})
    df = frame(spark, cave, {"h": list(height.values())})
    got = rows(L.flood(df, twice, height="h", block=block), *AXES, "label")
    assert got == {(*p, v) for p, v in plain_flood(height, seeds, C.offsets(6)).items()}


def test_rounds_follow_borders(spark):
    """A winding path through one block takes no exchange; a straight one through eight blocks takes one a border."""
    winding = [(0, y, x) for y in range(0, 31, 2) for x in range(30)] + [(0, y, 29 if y % 4 == 1 else 0) for y in range(1, 30, 2)]
    straight = [(5, 0, x) for x in range(8 * 32)]
    for pts, most in ((winding, 1), (straight, 8)):
        done = []
        got = L.flood(frame(spark, pts), frame(spark, pts[:1], {"label": [3]}), rounds=done)
        assert got.count() == len(pts) and done[0] <= most


def test_flood_of_nothing(spark):
    mask = frame(spark, [(0, 0, 0), (4, 4, 4)], {"h": [1.0, 2.0]}).withColumn("label", F.lit("x")).withColumn("level", F.lit("y"))
    seeds = frame(spark, [(9, 9, 9)], {"label": [1]})
    assert L.flood(mask, seeds).count() == 0 and L.flood(mask.limit(0), seeds).count() == 0 and L.flood(mask, seeds, height="h").count() == 0


def far(mask, box=None):
    """Distances to all voxels outside the mask, by waves of growing distance over the whole surroundings."""
    pts = set(mask)
    low, high = np.min(mask, axis=0) - 1, np.max(mask, axis=0) + 2
    if box:
        low, high = np.zeros(3, int), np.array(list(box.values()))
    empty = np.array([p for p in np.ndindex(*(high - low)) if tuple(int(v) for v in low + np.array(p)) not in pts]).reshape(-1, 3) + low
    return {p: float(np.sqrt(((empty - np.array(p)) ** 2).sum(axis=1).min())) if len(empty) else None for p in mask}


def same(got, want):
    return got.keys() == want.keys() and all((a is None and want[p] is None) or abs(a - want[p]) < 1e-9 for p, a in got.items())


def test_distances(spark, cave):
    solid = sorted({(z, y, x) for z in range(-9, 12) for y in range(25) for x in range(40) if (z * 7 + y * 5 + x * 3) % 83})
    for pts in (cave, solid):
        got = {r[:3]: r[3] for r in rows(D.distance_map(frame(spark, [*pts, *pts[:9]])), *AXES, "distance")}
        assert same(got, far(pts))


def test_distances_in_bounds(spark):
    """Beyond the bounds is no background: a full volume has no distance, one hole gives all of them."""
    box = {"z": 3, "y": 20, "x": 61}
    full = list(np.ndindex(3, 20, 61))
    assert rows(D.distance_map(frame(spark, full), bounds=box), "distance") == {(None,)}
    holed = [p for p in full if p != (1, 2, 60)]
    got = {r[:3]: r[3] for r in rows(D.distance_map(frame(spark, holed), bounds=box), *AXES, "distance")}
    assert same(got, far(holed, box)) and max(got.values()) > 60
    near = {r[:3]: r[3] for r in rows(D.distance_map(frame(spark, holed), 4, box), *AXES, "distance")}
    assert near == {p: d if d <= 4 else None for p, d in got.items()}


def test_envelope():
    rng = np.random.default_rng(2)
    f = rng.choice([0, 1, 5, 50, 900, D.FAR], 400)
    cuts = np.r_[0, np.sort(rng.choice(np.arange(3, 397, 3), 30, replace=False)), 400]
    first, last = cuts[:-1], cuts[1:] - 1
    got = D.envelope(f, first, last)
    for a, b in zip(first, last):
        for i in range(a + 1, b):
            assert got[i] == min(f[j] + (i - j) ** 2 for j in range(a, b + 1))
