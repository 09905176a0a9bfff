"""Hot groups: the cut paths give what a plain window gives."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somagrid.functions.probability import normal_two_sided, t_log_pvalue, t_pvalue
from somagrid.operators import ordered as O, stats as Q, tracks as T


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.6, "hot", rng.choice(list("abc"), 4000))
    pdf = pd.DataFrame({"key": key, "value": rng.integers(0, 700, 4000).astype(float), "grp": rng.choice(["p", "q"], 4000)})
    return spark.createDataFrame(pdf).repartition(6).cache(), pdf


@pytest.mark.parametrize("limit", [10, 100_000])
def test_value_ranks(skewed, limit):
    df, pdf = skewed
    got = O.average_ranks(df, ["key"], "value", limit=limit).toPandas().sort_values(["key", "value"])
    want = pdf.assign(rank=pdf.groupby("key")["value"].rank()).sort_values(["key", "value"])
    assert np.allclose(got["rank"], want["rank"])


def test_bins_are_used(skewed):
    df, _ = skewed
    r = O.value_ranks(df, ["key"], "value", limit=10)
    assert r.filter("key = 'hot'").select("_bin").distinct().count() > 20


@pytest.mark.parametrize("limit", [10, 100_000])
def test_median(skewed, limit):
    df, pdf = skewed
    got = dict(O.exact_median(df, ["key"], "value", limit=limit).collect())
    assert got == pdf.groupby("key")["value"].median().to_dict()


def test_median_of_all(skewed):
    df, pdf = skewed
    d = df.withColumn("one", F.lit(1))
    assert O.exact_median(d, ["one"], "value", limit=10).first()["median"] == pdf["value"].median()


@pytest.mark.parametrize("limit", [5, 100_000])
def test_bh(spark, limit):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(300), 2)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(300), "p": p}))
    got = Q.bh_adjust(df, "p", limit=limit).toPandas().sort_values("i")["p_adj"].to_numpy()
    order = np.argsort(p, kind="stable")
    ratio = p[order] * 300 / np.arange(1, 301)
    want = np.empty(300)
    want[order] = np.minimum(1, np.minimum.accumulate(ratio[::-1])[::-1])
    assert np.allclose(got, want)


def test_mannwhitney_cut_equals_plain(skewed):
    df, _ = skewed
    a = Q.mannwhitney(df, ["key"], "grp", "value", "p", "q", limit=10).toPandas().sort_values("key")
    b = Q.mannwhitney(df, ["key"], "grp", "value", "p", "q").toPandas().sort_values("key")
    assert np.allclose(a[["u", "z", "p_val"]], b[["u", "z", "p_val"]])


@pytest.mark.parametrize("step", [1, -1])
def test_neighbour_row(spark, step):
    frames = [0, 1, 2, 9, 10, 33, 34, 35, 70]
    pdf = pd.DataFrame({"s": ["a"] * 9 + ["b"], "f": frames + [4], "v": range(10)})
    got = O.neighbour_row(spark.createDataFrame(pdf), ["s"], "f", ["f", "v"], step, width=8).toPandas().sort_values(["s", "f"])
    want = pdf.groupby("s")["f"].shift(-step)
    assert np.allclose(got["next_f"].astype(float).fillna(-1), want.fillna(-1))


def test_moving_average(spark):
    pdf = pd.DataFrame({"k": 1, "f": np.arange(0, 90, 3), "v": np.arange(30.0) ** 2})
    got = T.moving_average(spark.createDataFrame(pdf), ["k"], "f", "v", 4, width=7).toPandas().sort_values("f")
    want = pdf["v"].rolling(4).mean().dropna()
    assert np.allclose(got["average"], want)


def _t_tail(t, df):
    # Simpson's rule on the density after x = tan(u)
    u = np.linspace(np.arctan(t / np.sqrt(df)), np.pi / 2, 20001)
    y = np.cos(u) ** (df - 1)
    h = u[1] - u[0]
    area = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    full = np.linspace(0, np.pi / 2, 20001)
    z = np.cos(full) ** (df - 1)
    h = full[1] - full[0]
    return area / (h / 3 * (z[0] + z[-1] + 4 * z[1:-1:2].sum() + 2 * z[2:-1:2].sum()))


def test_t_pvalue(spark):
    cases = [(t, n) for t in (0.0, 0.3, -1.7, 2.9, 6.0) for n in (1, 2, 5, 6, 40, 999, 1000, 1001, 5000)]
    got = spark.createDataFrame(cases, "t double, n int").select("t", "n", t_pvalue(F.col("t"), F.col("n")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - _t_tail(abs(r["t"]), r["n"])) < 1e-9, r


def test_t_far_tails(spark):
    """Relative error far out, where the series 1 - area has no digits left."""
    want = {(30.0, 20): 4.2e-18, (60.0, 30): 8.3e-33}
    rows = spark.createDataFrame(list(want), "t double, n int").select("t", "n", t_pvalue(F.col("t"), F.col("n")).alias("p"), t_log_pvalue(F.col("t"), F.col("n")).alias("lp")).collect()
    for r in rows:
        assert abs(r["p"] / want[r["t"], r["n"]] - 1) < 0.02 and abs(np.exp(r["lp"]) / r["p"] - 1) < 1e-9, r
    # closed forms for 1 and 2 degrees of freedom
    t = 1e6
    one, two = spark.createDataFrame([(t, 1), (t, 2)], "t double, n int").select(t_pvalue(F.col("t"), F.col("n")).alias("p")).collect()
    assert abs(one["p"] / (2 / np.pi * np.arctan(1 / t)) - 1) < 1e-10 and abs(two["p"] * t * t - 1) < 1e-9


def test_normal(spark):
    from math import erfc, sqrt

    z = [0.0, 0.5, 1.96, 2.9999, 3.0, 4.5, 8.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", normal_two_sided(F.col("z")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - erfc(r["z"] / sqrt(2))) < 1e-12


def test_mannwhitney_exact(spark):
    from itertools import combinations

    a, b = [1.5, 7.0, 9.0, 12.0], [0.5, 2.0, 3.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([("p", v) for v in a] + [("q", v) for v in b], "grp string, value double").withColumn("k", F.lit(1))
    r = Q.mannwhitney(df, ["k"], "grp", "value", "p", "q", exact=True).first()
    u = sum(x > y for x in a for y in b)
    every = [sum(c) - 6 for c in combinations(range(10), 4)]
    far = max(u, 24 - u)
    assert r["u"] == u and r["method"] == "exact"
    assert abs(r["p_val"] - min(1.0, 2 * sum(e >= far for e in every) / len(every))) < 1e-12


@pytest.mark.parametrize("m,n", [(1, 1), (1, 9), (3, 3), (7, 12), (30, 30), (60, 200)])
def test_rank_distribution(m, n):
    ways = _box(m, n)
    total, half = sum(ways), m * n // 2
    got, below = Q.u_below(m, n, half), 0
    for u in range(half + 1):
        below += ways[u]
        assert abs(got[u] / float(Fraction(below, total)) - 1) < 1e-9


def _box(m, n):
    p = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            p[u] -= p[u - n - i]
        for u in range(i, m * n + 1):
            p[u] += p[u - i]
    return p


def test_mannwhitney_exact_by_choice(spark):
    rng = np.random.default_rng(8)
    parts = []
    for k, (m, n) in {"even": (40, 40), "also": (40, 40), "long": (5, 400)}.items():
        v = rng.permutation(m + n) + 0.5
        parts.append(pd.DataFrame({"k": k, "grp": ["p"] * m + ["q"] * n, "value": v}))
    parts.append(pd.DataFrame({"k": "tied", "grp": list("ppqq"), "value": [1.0, 2.0, 2.0, 3.0]}))
    parts.append(pd.DataFrame({"k": "one", "grp": list("pp"), "value": [1.0, 2.0]}))
    df = spark.createDataFrame(pd.concat(parts))
    exact = {r["k"]: r for r in Q.mannwhitney(df, ["k"], "grp", "value", "p", "q", exact=True).collect()}
    plain = {r["k"]: r for r in Q.mannwhitney(df, ["k"], "grp", "value", "p", "q").collect()}
    for k in ("even", "also", "long"):
        m, n = exact[k]["n1"], exact[k]["n2"]
        box, near = _box(m, n), int(min(exact[k]["u"], m * n - exact[k]["u"]))
        assert exact[k]["method"] == "exact" and abs(exact[k]["p_val"] - min(1.0, 2 * sum(box[:near + 1]) / sum(box))) < 1e-12
        assert abs(exact[k]["p_val"] - plain[k]["p_val"]) < 0.01
    assert exact["tied"]["method"] == "normal" and exact["tied"]["p_val"] == plain["tied"]["p_val"]
    assert exact["one"]["method"] == "normal"


@pytest.mark.parametrize("limit", [7, 100_000])
def test_interpolate(spark, limit):
    rng = np.random.default_rng(5)
    parts = []
    for k, n in {"hot": 900, "b": 40, "none": 12, None: 30}.items():
        v = np.where((rng.random(n) < 0.15) & (k != "none"), rng.normal(size=n), np.nan)
        v[n // 3:n // 2] = np.nan
        parts.append(pd.DataFrame({"k": k, "pos": rng.permutation(3 * n)[:n], "v": v}))
    pdf = pd.concat(parts).sample(frac=1, random_state=1)
    df = spark.createDataFrame([(r.k, int(r.pos), None if np.isnan(r.v) else float(r.v)) for r in pdf.itertuples()], "k string, pos long, v double")
    got = {(r["k"], r["pos"]): r["filled"] for r in Q.interpolate(df, ["k"], "pos", "v", limit=limit).collect()}
    assert len(got) == len(pdf)
    for k, g in pdf.groupby("k", dropna=False):
        g = g.sort_values("pos")
        at, v = np.arange(len(g)), g["v"].to_numpy()
        ok = ~np.isnan(v)
        key = None if not isinstance(k, str) else k
        if not ok.any():
            assert all(got[key, p] is None for p in g["pos"])
            continue
        assert np.allclose([got[key, p] for p in g["pos"]], np.interp(at, at[ok], v[ok]))


def test_interpolate_spreads_a_group(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 100 == 0, F.col("id") * 1.0).alias("v"))
    d = O.known_around(df, ["k"], "pos", "v", limit=10)
    assert d.filter("_i <> pos + 1").count() == 0
    assert d.filter("_b.v <> floor(pos / 100) * 100 OR _a.v <> ceil(pos / 100) * 100").count() == 0
    plain = Q.interpolate(df.drop("k"), [], "pos", "v", limit=10)
    assert plain.filter("abs(filled - least(pos, 400)) > 1e-9").count() == 0


def test_interpolate_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, None), (1, 0, None), (1, 1, 4.0)], "k int, pos int, v double")
    assert sorted(r["filled"] for r in Q.interpolate(df, ["k"], "pos", "v").collect()) == [2.0, 2.0, 2.0, 4.0]
    assert Q.interpolate(df.limit(0), ["k"], "pos", "v").count() == 0
