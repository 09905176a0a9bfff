"""Vector searches against brute force."""

import numpy as np
import pytest

from somagrid.llm import crosspoly, queries as Q, topk

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])


def test_recall(spark, vectors):
    ids, v = vectors
    got = {}
    for r in Q.op8_ann(spark, FOLDER).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -9
        want = set(ids[np.argsort(-s)[:20]].tolist())
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(own, own[1:]))
        hits += len(want & {i for _, i, _ in own})
        total += 20
    assert hits / total >= 0.9


def odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, -0.5]) for i in range(0, 60)] + [(100, None), (120, [None, 1.0, 2.0]), (140, [float("nan"), 1.0, 0.0]), (160, [float("inf"), 1.0, 0.0]),
            (180, []), (None, [1.0, 1.0, 1.0]), (200, [0.0, 0.0, 0.0]), (220, [1.0, 2.0]), (0, [0.0, 1.0, -0.5])]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")


def test_odd(spark):
    df = odd_vectors(spark)
    good = {i: np.array([i % 7, 1.0, -0.5]) for i in range(60)}
    got = {}
    for r in topk.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    with_zero = good | {200: np.zeros(3)}
    for q in (0, 20, 40, 200):
        w = sorted((-int(np.floor(64 * with_zero[q]) @ np.floor(64 * x)), i) for i, x in with_zero.items() if i != q)[:20]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in w]
    assert set(got) == {0, 20, 40, 200}
    near = {}
    for r in crosspoly.search(df, probes=6).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        w = sorted((-float(good[q] @ x), i) for i, x in good.items() if i != q)[:20]
        assert [i for _, i, _ in sorted(near[q])] == [i for _, i in w]
    assert topk.search(df.limit(0)).count() == 0 and crosspoly.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 12, 40, 130])
def test_few_rows_are_all_found(spark, n):
    """The registered parameters on tables so small that probes miss most buckets."""
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 64))
    v[n // 2:n // 2 + 3] = v[0]  # copies of a query
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in crosspoly.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, n, 20):
        own = sorted(got.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, min(20, n - 1) + 1))
        assert np.allclose([s for _, _, s in own], [v[q] @ v[i] for _, i, _ in own]) and len({i for _, i, _ in own} - {q}) == len(own)
        if n <= 21:
            assert [i for _, i, _ in own] == sorted(set(range(n)) - {q}, key=lambda i: (-own[[x for _, x, _ in own].index(i)][2], i))


def test_batches_meet_ranges_without_a_broadcast(spark, monkeypatch):
    """Many batches and ranges give the exact best, and pairs of them are neither rows nor sent to all tasks."""
    for name, value in (("RANGE", 64), ("BATCH", 4), ("GROUP", 2), ("SHARE", 3), ("BLOCK", 16)):
        monkeypatch.setattr(topk, name, value)
    seen, real = [], topk.cut
    monkeypatch.setattr(topk, "cut", lambda df: seen.append(df) or real(df))
    v = np.floor(np.random.default_rng(3).normal(size=(1000, 5)) * 64)
    v[500:540] = v[0]
    df = spark.createDataFrame([(i, (x / 64).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1000, 20))
    for q, own in got.items():
        s = (v @ v[q]).astype(int)
        assert [(i, x) for _, i, x in sorted(own)] == sorted(((i, int(s[i])) for i in range(1000) if i != q), key=lambda p: (-p[1], p[0]))[:7]
    plan = next(p for p in (df._jdf.queryExecution().executedPlan().toString() for df in reversed(seen)) if "forward" in p)
    assert plan.count("Join") == 1 and plan.count("BroadcastExchange") <= 1  # the lower bounds, a row per batch
