"""Ancestor chains and path sums by doubling, on deep trees, against a walk up from each node."""

import numpy as np
import pandas as pd

from somagrid.operators import traces as R, tree as G


def test_closure_of_a_deep_chain(spark):
    onto = spark.createDataFrame([(i, i - 1 if i else None) for i in range(101)], "ids long, parent long")
    got = {tuple(r) for r in G.closure(onto).select("ancestor", "descendant", "depth").collect()}
    assert got == {(a, d, d - a) for d in range(101) for a in range(d + 1)}


def test_closure_with_gaps(spark):
    """A parent that is no row, a lone node, two roots, an empty tree."""
    onto = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, None)], "ids long, parent long")
    got = {tuple(r) for r in G.closure(onto).select("ancestor", "descendant", "depth").collect()}
    assert got == {(i, i, 0) for i in range(1, 7)} | {(1, 2, 1), (1, 3, 2), (2, 3, 1), (4, 5, 1)}
    assert G.closure(onto.limit(0)).count() == 0


def test_path_sums(spark):
    """Random trees, one of them a chain of 300 nodes, one with a missing parent."""
    rng = np.random.default_rng(3)
    rows = [("chain", i, i - 1, int(rng.integers(1, 9))) for i in range(300)]
    for t in range(5):
        rows += [(f"t{t}", i, int(rng.integers(0, i)) if i else -1, int(rng.integers(1, 9))) for i in range(60)]
    rows += [("cut", 7, 3, 5), ("cut", 8, 7, 2)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["tree", "cur_idx", "parent", "len"]))
    by = {(t, i): (p, n) for t, i, p, n in rows}
    want, chain = {}, set()
    for t, i, _, _ in rows:
        depth = total = 0
        at = by[t, i][0]
        while at >= 0:
            depth += 1
            chain.add((t, i, at, depth))
            if (t, at) not in by:
                depth -= 1
                break
            total += by[t, at][1]
            at = by[t, at][0]
        want[t, i] = (depth, total)
    got = R.tree_paths(df).collect()
    assert {(r["tree"], r["cur_idx"]): (r["depth"], r["path_length"]) for r in got} == want
    for t in {r[0] for r in rows}:
        mine = sorted(((r["path_length"], r["cur_idx"], r["place"]) for r in got if r["tree"] == t))
        assert [p for _, _, p in mine] == list(range(1, len(mine) + 1))
    assert {tuple(r) for r in R.parent_chains(df).select("tree", "cur_idx", "ancestor", "step").collect()} == chain


def test_prune_children(spark):
    onto = spark.createDataFrame([(1, None, [2, 3, 4]), (2, 1, []), (3, 1, [5]), (4, 1, None), (5, 3, [])], "ids long, parent long, children array<long>")
    gone = spark.createDataFrame([(2,), (5,), (5,), (77,)], "ids long")
    assert {r["ids"]: r["children"] for r in G.prune_children(onto, gone).collect()} == {1: [3, 4], 3: [], 4: None}
