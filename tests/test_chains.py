"""Chains of many trees are dealt to tasks by rows."""

from somagrid import session
from somagrid.operators import traces as R, tree as G
from test_space import rows


def test_chains_are_dealt_by_rows(spark, monkeypatch):
    """A join of many chains has a task for every ``TASK_ROWS`` of them, not one for each so many compressed bytes."""
    df = spark.createDataFrame([(t, i, (i - 1) // 2 if i else -1) for t in range(40) for i in range(31)] + [(None, 1, 0), (None, 0, -1)], "tree long, cur_idx long, parent long")
    want = rows(R.parent_chains(df), "tree", "cur_idx", "ancestor", "step")
    assert len(want) == 40 * 98 + 1
    dealt = []
    deal = session.shared_out

    def seen(df, n, *keys):
        out = deal(df, n, *keys)
        dealt.append((n // session.TASK_ROWS, out is not df))
        return out
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    monkeypatch.setattr(G, "shared_out", seen)
    assert rows(R.parent_chains(df), "tree", "cur_idx", "ancestor", "step") == want
    assert len(dealt) == 6 and all(d for _, d in dealt) and dealt[-1][0] == (40 * 98 + 1) // 50
