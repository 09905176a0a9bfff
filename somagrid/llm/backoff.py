"""Stupid-backoff language-model scores from corpus-wide n-gram counts.

Words are lower-cased runs of non-blank characters.  An n-gram counts as seen
when the corpus holds it ``CUTOFF`` times or more.  A word's score is the
relative frequency of the longest seen n-gram that ends in it, times ``ALPHA``
for every order that was backed off; a single word is its share of all words.
A document's score is the sum of the logarithms.

The count tables are partitioned by the hash of the n-gram.  Documents travel
as blocks: a block's exploded n-grams, reduced to distinct ones with their
counts, go to the partitions of the count tables, are summed there over all
blocks, and the corpus' counts come back in the same order.  An n-gram is only
looked up if both shorter n-grams in it are seen, which loses nothing.

Null, empty and wordless texts get 0 words and score 0.  Repeated rows count
and score each on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from somagrid.llm.common import binary, bounds, mix, runs, text_chunks, words
from somagrid.session import cut

ORDER = 3
CUTOFF = 2
ALPHA = 0.4
BLOCK_WORDS = 1_500_000
PART_WORDS = 2_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def _pack(a: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: low numbers leave the high planes empty."""
    a = np.ascontiguousarray(a)
    head = np.int64(len(a)).tobytes()
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
    return head + np.int64(len(planes)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    n, size = np.frombuffer(b, np.int64, 2)
    if n == 0:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[16:], int(size), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel()


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of whole documents: ids, words per document, distinct word hashes and the words as numbers into them."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, hashes, total = [], [], [], 0

        def send():
            nonlocal ids, sizes, hashes, total, made
            h = np.concatenate(hashes)
            u, inv, n = np.unique(h, return_inverse=True, return_counts=True)
            by = np.argsort(-n, kind="stable")  # frequent words get low numbers
            place = np.empty(len(u), np.uint32)
            place[by] = np.arange(len(u), dtype=np.uint32)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) | made], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
                 binary([_pack(np.concatenate(sizes).astype(np.uint32))]), binary([_pack(u[by])]), binary([_pack(place[inv])]), pa.array([total], pa.int64())],
                ["block", "ids", "sizes", "words", "text", "n"])
            ids, sizes, hashes, total = [], [], [], 0
            made += 1
            return out

        for b in batches:
            for i, data, off in text_chunks(b, text_col):
                h, doc = words(data, off)
                n = len(off) - 1
                ids.append(b.column(0).slice(i, n))
                sizes.append(np.bincount(doc, minlength=n))
                hashes.append(h)
                total += len(h)
                if total >= BLOCK_WORDS:
                    yield send()
        if ids:
            yield send()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(text_col)).mapInArrow(
        run, "block long, ids array<long>, sizes binary, words binary, text binary, n long")


class _Block:
    """A block's words with what is known of their counts."""

    def __init__(self, row: dict, parts: int):
        self.parts = parts
        self.sizes = _unpack(row["sizes"], np.uint32).astype(np.int64)
        self.hash = _unpack(row["words"], np.uint64)
        self.text = _unpack(row["text"], np.uint32)
        stop = np.cumsum(self.sizes)
        self.within = np.arange(len(self.text)) - np.repeat(stop - self.sizes, self.sizes)  # words before it in its document
        self.counts: list[np.ndarray] = []  # per order: the corpus count of the n-gram that ends at each word, 0 if not looked up
        self.keys = self.hash[self.text] if len(self.text) else np.zeros(0, np.uint64)

    def ask(self, order: int):
        """Distinct n-gram keys of this order, their counts here, and which words ask for which key."""
        if order == 1:
            at = np.arange(len(self.text))
            key = self.keys
        else:
            low = self.counts[-1]
            seen = (self.within >= order - 1) & (low >= CUTOFF)
            seen[1:] &= low[:-1] >= CUTOFF
            at = np.flatnonzero(seen)
            key = self.keys[at]
            word = self.hash[self.text]
            for k in range(1, order):
                key = mix(key * _K ^ word[at - k])
        u, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        return u, n, at, inv

    def learn(self, order: int, answers: dict[int, bytes]):
        u, _, at, inv = self.ask(order)
        part = (u % np.uint64(self.parts)).astype(np.int64)
        total = np.zeros(len(u), np.int64)
        for p, blob in answers.items():
            total[part == p] = _unpack(blob, np.uint32)
        count = np.zeros(len(self.text), np.int64)
        count[at] = total[inv]
        self.counts.append(count)


def _told(rows: DataFrame, order: int, parts: int, use, schema: str) -> DataFrame:
    """Rows of blocks, with the answers of all orders below ``order``, through ``use(block, row)``."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = _Block(row, parts)
                for k in range(1, order):
                    block.learn(k, {x["part"]: x["counts"] for x in row[f"a{k}"] or []})
                got = use(block, row)
                if got is not None:
                    yield got

    return rows.mapInArrow(run, schema)


def _counted(asked: DataFrame, parts: int) -> DataFrame:
    """The count table's partitions: sums over all blocks, sent back to each block in its own order."""

    def run(batches):
        for t in runs(batches, ["part"]):
            edge = bounds(t, ["part"])
            block, part, keys, counts = (t.column(c).to_pylist() for c in ("block", "part", "keys", "counts"))
            for s, e in zip(edge[:-1], edge[1:]):
                k = [_unpack(keys[i], np.uint64) for i in range(s, e)]
                n = [_unpack(counts[i], np.uint32) for i in range(s, e)]
                _, inv = np.unique(np.concatenate(k), return_inverse=True)
                total = np.bincount(inv, np.concatenate(n).astype(float)).astype(np.int64)[inv]
                total = np.minimum(total, 2**32 - 1).astype(np.uint32)
                cuts = np.cumsum([len(x) for x in k])[:-1]
                blobs = [_pack(x) for x in np.split(total, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(block[s:e]), pa.array(part[s:e], pa.int32()), binary(blobs)], ["block", "part", "counts"])

    return asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "block long, part int, counts binary")


def scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score): natural logarithm of the backoff score of every whole text under the corpus' counts."""
    base = cut(blocks(docs, id_col, text_col))
    words_in = base.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = int(max(12, -(-words_in // PART_WORDS)))
    rows = base
    for k in range(1, order + 1):

        def ask(block, row, k=k):
            u, n, _, _ = block.ask(k)
            part = (u % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[by], np.arange(parts + 1))
            some = [p for p in range(parts) if edge[p] < edge[p + 1]]
            cells = [by[edge[p]:edge[p + 1]] for p in some]
            return pa.RecordBatch.from_arrays(
                [pa.array([row["block"]] * len(some), pa.int64()), pa.array(some, pa.int32()), binary([_pack(u[c]) for c in cells]),
                 binary([_pack(n[c].astype(np.uint32)) for c in cells])], ["block", "part", "keys", "counts"])

        asked = _told(rows, k, parts, ask, "block long, part int, keys binary, counts binary")
        answers = cut(_counted(asked, parts))
        own = answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias(f"a{k}"))  # no more than the block's own n-grams
        rows = rows.join(own, "block", "left")

    def final(block, row):
        n = len(block.text)
        log = np.log(np.maximum(block.counts[0], 1) / max(words_in, 1)) if n else np.zeros(0)
        reach = np.minimum(block.within + 1, order)
        used = np.ones(n, np.int64)
        for k in range(2, order + 1):
            c = block.counts[k - 1]
            hit = np.flatnonzero(c >= CUTOFF)
            log[hit] = np.log(c[hit] / block.counts[k - 2][hit - 1])
            used[hit] = k
        log = log + (reach - used) * np.log(ALPHA)
        doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        total = np.bincount(doc, log, len(block.sizes)).astype(float)
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(block.sizes), pa.array(total)], ["doc_id", "n_words", "log_score"])

    return _told(rows, order + 1, parts, final, "doc_id long, n_words long, log_score double")
