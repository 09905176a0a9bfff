"""Removal of repeated passages against all windows compared in plain Python."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from somagrid.llm import queries as Q, repeats


def brute(rows, window):
    """(id, n_words, n_removed, kept) of (id, text) rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    seen, gone = set(), [set() for _ in rows]
    for r in order:
        for i in range(len(words[r]) - window + 1):
            w = tuple(words[r][i:i + window])
            if w in seen:
                gone[r].update(range(i, i + window))
            seen.add(w)
    return sorted((str(rows[r][0]), len(words[r]), len(gone[r]), " ".join(w for i, w in enumerate(words[r]) if i not in gone[r])) for r in range(len(rows)))


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_documents(spark, folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = brute(list(zip(t["doc_id"], t["text"])), 20)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q.op12_substring_dedup(spark, folder).collect())
    assert got == [(i, n, k, hashlib.sha256(x.encode()).hexdigest()) for i, n, k, x in want]


def test_odd(odd, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(repeats.remove_repeats(odd)) == brute(rows, 20)
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_few_words(docs_of):
    """Texts over a handful of words: runs, periods, overlaps and shared passages everywhere, in many small batches."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            k = rng.integers(0, 4)
            unit = [f"w{j}" for j in rng.integers(0, 3, int(rng.integers(1, 5)))]
            parts += unit * int(rng.integers(1, 9)) if k else [f"r{j}" for j in rng.integers(0, 10**6, 15)]
            if k == 3 and rows:
                parts += rows[rng.integers(0, len(rows))][1].split()[3:40]
        rows.append((i, "  ".join(parts)))
    df = docs_of(rows).repartition(7)
    for window in (5, 20):
        assert result(repeats.remove_repeats(df, window)) == brute(rows, window)


def test_shared_ids(docs_of):
    """Rows that share an id: alike ones count once, different texts in one fixed order."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"a{i}" for i in range(5, 40))
    got = result(repeats.remove_repeats(docs_of([(1, a), (1, a), (1, b), (None, a), (None, b)])))
    assert len(got) == 5 and sum(r[2] == 0 for r in got) == 1 and sorted(r[2] for r in got if r[1] == 30) in ([0, 30, 30], [25, 30, 30])


def test_inner_names_depend_on_the_passage_alone():
    """Whatever stands around a passage, each window in it has the same anchor."""
    rng = np.random.default_rng(10)
    for _ in range(60):
        passage = rng.integers(1, 5, 40).astype(np.uint64)
        seen = []
        for _ in range(2):
            before, after = rng.integers(1, 5, int(rng.integers(0, 30))), rng.integers(1, 5, int(rng.integers(0, 30)))
            h = repeats.mix(np.r_[before.astype(np.uint64), passage, after.astype(np.uint64)])
            start, anchor, _ = repeats.anchors(h, np.zeros(len(h), np.int64), np.array([0]), np.array([len(h)]), 20, 4)
            inside = (start >= len(before)) & (start + 20 <= len(before) + 40)
            seen.append(anchor[inside].tolist())
        assert seen[0] == seen[1]
