"""Claims settled by groups against one pass over all claims, closest first."""

import numpy as np
import pytest

from somagrid.operators import tracks as T
from test_space import rows


def greedy(claims):
    cells, cands, out = set(), set(), set()
    for f, a, b, d in sorted(claims, key=lambda c: (c[3], c[1], c[2])):
        if (f, a) not in cells and (f, b) not in cands:
            cells.add((f, a))
            cands.add((f, b))
            out.add((f, a, b))
    return out


@pytest.mark.parametrize("limit,n,chain", [(5, 60, 8), (1 << 18, 150, 60)])
def test_groups(spark, limit, n, chain):
    """Ties, several frames, a chain of claims each of which waits for the one before, and rows with nulls."""
    rng = np.random.default_rng(6)
    claims = {(int(f), int(a), int(b)): float(rng.integers(0, 9)) for f, a, b in rng.integers(0, 12, (n, 3))}
    claims = [(*k, d) for k, d in claims.items()]
    claims += [(99, i // 2, (i + 1) // 2, 100.0 + i) for i in range(chain)]
    df = spark.createDataFrame([*claims, (1, None, 2, 0.0), (1, 2, None, 0.0), (1, 2, 3, None), (None, 1, 1, 0.0)], "frame int, cell int, cand int, distance double")
    assert rows(T.resolve_claims(df, limit), "frame", "cell", "cand") == greedy(claims)
    assert T.resolve_claims(df.limit(0), limit).count() == 0


def test_near_claims_first(spark, monkeypatch):
    """Claims settled by growing distance are those of all links, and few of the links are made."""
    rng = np.random.default_rng(8)
    spot = lambda n: [(int(f), int(i), *map(int, p)) for f, i, p in zip(rng.integers(0, 3, n), rng.integers(0, n // 2, n), rng.integers(0, 25, (n, 3)))]
    a, b = spot(500), [(f + 1, *r) for f, *r in spot(400)]
    a += a[:20] + [(0, 900, 3, 3, None), (None, 901, 3, 3, 3), (0, None, 3, 3, 3)]  # rows that come twice, and some that take no part
    cells, cand = (spark.createDataFrame(r, f"frame int, {c} int, z int, y int, x int") for r, c in ((a, "cell"), (b, "cand")))
    plain = T.candidate_links(cells, cand, 40.0)
    claims = {tuple(r) for r in plain.collect() if None not in tuple(r)}
    made, real = [], T._settle
    monkeypatch.setattr(T, "_settle", lambda links, limit: made.append(links.count()) or real(links, limit))
    monkeypatch.setattr(T, "LINKS", 100)
    got = T.resolve_claims(plain)
    assert rows(got, "frame", "cell", "cand") == greedy(claims) and got.count() == len(greedy(claims))
    assert len(made) > 3 and sum(made) < plain.count() / 4
    assert rows(T.resolve_claims(T.candidate_links(cells, cand, 0.5)), "frame", "cell", "cand") == greedy({c for c in claims if c[3] <= 0.5})
