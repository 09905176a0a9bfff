"""Fill-in-the-middle forms against a plain walk over the units."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from somagrid.llm import middle, queries as Q

FOLDER = "/root/testdata/sf0.001"


def plain_walk(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def check(df, texts):
    got = middle.transform(df).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts)
    want = sorted((str(i), *plain_walk(i, t), t or "") for i, t in texts)
    assert sorted((str(r["id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want


def test_documents(spark):
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"), list(zip(t["doc_id"], t["text"])))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = dict(zip(t["doc_id"], t["text"]))
    for r in Q.op11_fill_in_middle(spark, FOLDER).collect():
        *head, output = plain_walk(r["doc_id"], text[r["doc_id"]])
        assert [r["n"], r["form"], r["prefix_chars"], r["middle_chars"]] == head
        assert r["output_sha256"] == sha(output) and r["restored_sha256"] == sha(text[r["doc_id"]])


def test_odd(odd, docs_of):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert middle.transform(docs_of([])).count() == 0


def test_any_code_point(docs_of):
    """Random mixes of letters, signs and code points of one to four bytes, many to a batch."""
    rng = np.random.default_rng(5)
    own = ["a", "Zz", "<", "P>", "S>", "<M>", "{", "`", "@", "[", "é", "漢", "😀", "\n", "\x00", "\x7f", "\u0080", "߿", "\U0010ffff", "abcdefghijklmnop"]
    rows = [(i, "".join(rng.choice(own, int(rng.integers(0, 40))).tolist())) for i in range(4000)]
    check(docs_of(rows), rows)


def test_rank_and_select():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 8, 9, 1000):
        flags = rng.random(n) < 0.3
        words = np.zeros((n + 7) // 8, "<u8")
        words.view(np.uint8)[:n][flags] = 0x80
        m = middle.Marks(words)
        assert m.rank(np.arange(n + 1)).tolist() == np.r_[0, np.cumsum(flags)].tolist()
        assert m.select(np.arange(1, flags.sum() + 1)).tolist() == np.flatnonzero(flags).tolist()
