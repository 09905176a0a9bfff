"""Text operators against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import compare
from somagrid.llm import backoff, bpe, cotrain, licences, near_dups, packing, queries as Q, secrets, toxicity

FOLDER = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(Q.WORD_BPE)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(texts, k):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql_twin(spark, name):
    bad = compare.compare(Q.QUERIES[name](spark, FOLDER), compare.connect(FOLDER), Q.ORACLES[name])
    assert not [b for b in bad if not b.startswith("note")], bad


def test_near_duplicates(spark, texts):
    want = groups(texts, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op1_minhash_near_dedup(spark, FOLDER).collect()}
    assert got == want


def test_near_duplicate_group(docs_of):
    """A large group of near copies on both sides of the limit, with chains."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = {}
    for i in range(300):
        w = list(base)
        for p in rng.choice(60, rng.integers(0, 7), replace=False):
            w[p] = f"e{rng.integers(0, 10**6)}"
        rows[i] = " ".join(w)
    want = groups(rows, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(docs_of(list(rows.items())), 2).collect()}
    assert got == want


def test_near_duplicates_odd(odd, docs_of):
    got = near_dups.near_duplicates(odd).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == 1 and by[2]["n_shingles"] == 0 and by[8]["component_id"] == 7 and not by[8]["kept"] and by[None]["component_id"] is None
    assert near_dups.near_duplicates(docs_of([])).count() == 0


def test_toxicity_held_out(spark):
    df = Q.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    clean, toxic = df[df.toxic == 0], df[df.toxic == 1]
    assert clean.predicted.mean() < 0.02 and toxic.predicted.mean() > 0.75


def test_toxicity_grammar():
    rate = toxicity._scorer([("idiot", 0, 6.0), ("scumb", 5, 6.0)])
    data = [b"you idiot", b"an idiot", b"he is not an idiot", b"fine words. you see", b"", b"a scumbone here", "Über ÉÊ".encode()]
    off = np.r_[0, np.cumsum([len(d) for d in data])]
    p, clauses = rate(np.frombuffer(b"".join(data), np.uint8), off)
    assert p[0] > p[1] > p[2] and p[1] >= 0.3 > p[3] == p[4] == p[6] and p[5] == p[1] and clauses.tolist() == [1, 1, 1, 0, 0, 1, 0]


def test_toxicity_odd(spark, odd, docs_of):
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(odd, labels)
    assert toxicity.score(odd, lexicon).count() == 12 and toxicity.keep(odd, lexicon).count() == 12
    assert toxicity.score(docs_of([]), []).count() == 0


def test_quality(spark, odd, docs_of):
    df = Q.op6_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert df[df.quality == 1].keep.mean() > 0.99 and df[df.quality == 0].keep.mean() < 0.1
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = cotrain.fit(odd, none)
    assert model is None and {r["score"] for r in cotrain.score(odd, model).collect()} == {0.5} and cotrain.keep(odd, model).columns == odd.columns
    assert cotrain.score(docs_of([]), cotrain.fit(docs_of([]), none)).count() == 0


def test_bpe_digests(spark, texts, reference):
    for r in Q.op7_bpe(spark, FOLDER).collect():
        ids = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd(odd, reference, docs_of):
    lex = bpe.compile_lexicon(odd, Q.WORD_BPE)
    enc = bpe.encode(odd, Q.WORD_BPE, lexicon=lex)
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in enc.collect():
        assert r["ids"] == reference.encode(text[r["id"]] or "", add_special_tokens=False).ids
    for r in bpe.decode(enc, Q.WORD_BPE).collect():
        assert r["text"] == reference.decode(reference.encode(text[r["id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False)
    empty = docs_of([])
    assert bpe.digests(empty, Q.WORD_BPE, lexicon=bpe.compile_lexicon(empty, Q.WORD_BPE)).count() == 0


def test_bpe_any_code_point(reference):
    """Random mixes of code points, among them ones that newer Unicode versions added, against the library."""
    rng = np.random.default_rng(3)
    own = ["'s", "'S", "don't", " ", "\u3000", "\x1c", "\x85", "é", "e\u0301", "Σ", "İ", "ẞ", "٣", "½", "😀", "...", "<|", "<|endoftext|>", "</w>", "क\u093c", "\u1c89", "\ua7cb", "\ua7ce",
           "\U00010940", "\U00010d50", "\U00016ea0"]
    e = bpe.Encoder(bpe.Vocabulary(Q.WORD_BPE))
    for _ in range(1500):
        wild = [chr(i) for i in (*rng.integers(32, 0xD800, 3), *rng.integers(0xE000, 0x20000, 3))]
        text = "".join(rng.choice([*own, *wild], int(rng.integers(1, 14))).tolist())
        number, _ = e.encode([text])
        assert bpe.expand(e.ids, e.bound, number).tolist() == reference.encode(text, add_special_tokens=False).ids, ascii(text)


def test_lexicon():
    words = sorted({w.encode() for w in "a ab abc bc bac tap taps top tops été".split()})
    bound = np.arange(len(words) + 1)
    lex = bpe.Lexicon.open(bpe.Lexicon.compile(words, np.arange(len(words)), bound))
    look = [*words, b"ta", b"zz", b""]
    got = lex.find(np.frombuffer(b"".join(look), np.uint8), np.r_[0, np.cumsum([len(w) for w in look])])
    assert got.tolist() == [*range(len(words)), -1, -1, -1]
    assert len(lex.final) < sum(map(len, words))  # suffixes are shared


def test_packing(spark, odd, reference, docs_of):
    rows = packing.pack_documents(odd, Q.WORD_BPE).collect()
    ids = {r["doc_id"]: reference.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in odd.collect()}
    seen, seq = Counter(), {}
    for r in rows:
        own = np.array(ids[r["doc_id"]], "<u4")
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] += r["length"]
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(seen[k] == len(v) * (2 if k == 8 else 1) for k, v in ids.items())
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(docs_of([]), Q.WORD_BPE).count() == 0


def test_patterns():
    rng = np.random.default_rng(2)
    hist = {int(q): int(n) for q, n in zip(range(1, 25), rng.integers(0, 400, 24))}
    plan = packing.patterns(hist, 64)
    used = Counter()
    for p, n in plan:
        assert sum(q * k for q, k in p.items()) <= 64
        for q, k in p.items():
            used[q] += k * n
    assert used == Counter({q: n for q, n in hist.items() if n})
    assert sum(n for _, n in plan) <= 1.01 * sum(q * n for q, n in hist.items()) / 64 + 3
    assert packing.patterns({}, 64) == []


def test_backoff_odd(odd, docs_of):
    got = {r["doc_id"]: r for r in backoff.scores(odd).collect()}
    assert backoff.scores(odd).count() == 12 and got[1]["n_words"] == 0 and got[1]["log_score"] == 0 and got[5]["n_words"] == 120000
    assert backoff.scores(docs_of([])).count() == 0


def test_licences(docs_of, odd):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "THIS work is licensed under the GNU general public license -- version 3"), (3, "licensed under nothing"), (4, None)]
    got = {r["doc_id"]: (r["licence"], r["n_units"]) for r in licences.match(docs_of(rows)).collect()}
    assert got[1] == ("MIT", 1) and got[2][0] == "GPL-3.0" and got[3] == (None, 0) and got[4] == (None, 0)
    assert licences.match(odd).count() == 12 and licences.match(docs_of([])).count() == 0


def brute_spans(text):
    out = []
    for order, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        for m in re.finditer(pattern.removeprefix("(?i)"), text, re.I if kind == "assign" else 0):
            if len(m[group]) >= least:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_secrets(docs_of, odd):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [(1, f'é token=token:abcdef Password: "hunter22" {key} {"ab12" * 8}x api-key=zz, {key}AKIA'), (2, "AKIA123 secret =  short token = abc"), (3, None)]
    rows += [(10 + i, "see 0123456789abcdef0123456789abcdef here") for i in range(8)]
    df = docs_of(rows)
    got = {r["doc_id"]: r for r in secrets.report(secrets.scan(secrets.with_rows(df))).withColumnRenamed("id", "doc_id").collect()}
    for i, t in rows:
        want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), i
    assert "example:4:36" in got[10]["spans"] and "live:" in got[1]["spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.with_rows(df)).collect()}
    assert key not in clean[1] and "hunter22" not in clean[1] and clean[10] == rows[3][1] and clean[3] is None
    assert secrets.scan(secrets.with_rows(odd.drop("_row"))).count() == 12 and secrets.scan(secrets.with_rows(docs_of([]))).count() == 0


def test_near_duplicates_under_the_limit(docs_of):
    """300 texts whose pairs nearly all lie between 0.7 and 0.8, and some links among them."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(300):
        w = list(base)
        for p in rng.choice(20, 2, replace=False) * 6 + rng.integers(0, 5, 2):
            w[p] = f"e{rng.integers(0, 10**6)}"
        rows[i] = " ".join(w)
    for i in range(300, 312):  # half of the edits of another text
        w = rows[i - 300].split()
        edits = [p for p in range(120) if w[p].startswith("e")]
        w[edits[0]] = base[edits[0]]
        rows[i] = " ".join(w)
    want = groups(rows, 5)
    sets = {i: shingle_set(t, 5) for i, t in rows.items()}
    near = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(0, 300, 5) for b in range(a)]
    assert np.mean([0.65 < x < 0.8 for x in near]) > 0.8 and len({c for _, c in want.values()}) > 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(docs_of(list(rows.items())), 5, whole_tiles=True).collect()}
    assert got == want
