"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to unit length, padded to a power of two and turned by three
rounds of random signs and a fast Hadamard transform; its bucket is the nearest
signed axis.  ``TABLES`` independent turns give as many tables.  A query probes
the ``PROBES`` axes it is nearest to in each table, the candidates of all
buckets are scored exactly on the original vectors, and the best are kept.
Buckets are cut into parts of bounded size, so no task holds a whole hot one.
A query that its probes leave with fewer than ``k`` rows probes every bucket of
one table, which holds each vector once: it gets all candidates there are.

Recall was measured against brute force (README).  Vectors that are null,
empty, zero or hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths never meet; rows that share an id
and a vector are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from somagrid.llm.common import bounds, runs
from somagrid.llm.vectors import QUERY_STEP, best, copies, matrix, usable
from somagrid.session import cut

TABLES = 16
PROBES = 8
TURNS = 3
PART = 1024
SPARE = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def turned(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation of a table, the same for every vector of this length."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng([20240602, table, d])
    x = np.pad(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), ((0, 0), (0, d - x.shape[1])))
    for _ in range(TURNS):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: 2 i for the positive, 2 i + 1 for the negative axis i."""
    r = turned(x, table)
    both = np.stack([r, -r], axis=2).reshape(len(r), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def placed(rows: DataFrame, key: str, probes: int) -> DataFrame:
    """(dim, bucket, key): the buckets of every vector, ``probes`` in each table."""

    def run(batches):
        for b in batches:
            size = np.array([len(v) for v in b.column(1)])
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = matrix(b.column(1).take(pa.array(at)))
                for t in range(TABLES):
                    a = axes(x, t, probes)
                    p = a.shape[1]
                    bucket = (np.int64(t) << 32) | a.astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at) * p, dim, np.int32)), pa.array(bucket.ravel()), b.column(0).take(pa.array(np.repeat(at, p)))], ["dim", "bucket", key])

    return rows.select(key, "v").mapInArrow(run, f"dim int, bucket long, {key} long")


def _score(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` candidates of every query in every bucket part."""

    def exact(a, b):
        s = np.zeros(len(a))
        for d in range(a.shape[1]):
            s = s + a[:, d] * b[:, d]
        return s

    def run(batches):
        keys = ["dim", "bucket", "part"]
        for t in runs(batches, keys):
            edge = bounds(t, keys)
            side, ids, v = t.column("side").to_numpy(), t.column("id").to_numpy(), t.column("v").combine_chunks()
            v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
            out = []
            for s, e in zip(edge[:-1], edge[1:]):
                mid = s + int(np.searchsorted(side[s:e], 1))
                if mid in (s, e):
                    continue
                x = matrix(v.slice(s, e - s))
                q, c = x[:mid - s], x[mid - s:]
                score = q @ c.T
                m = min(k + SPARE, score.shape[1])
                at = np.argpartition(-score, m - 1, axis=1)[:, :m]
                who, what = np.repeat(np.arange(len(q)), m), at.ravel()
                val = exact(q[who], c[what])
                vec = ids[mid:e][what]
                o = np.lexsort((vec, -val, who))
                keep = o[np.tile(np.arange(m) < k, len(q))]
                out.append((ids[s:mid][who[keep]], vec[keep], val[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], ["query_id", "vec_id", "score"])

    return rows.repartition("dim", "bucket", "part").sortWithinPartitions("dim", "bucket", "part", "side").mapInArrow(run, "query_id long, vec_id long, score double")


def search(table: DataFrame, k: int = 20, step: int = QUERY_STEP, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``step`` the k nearest found other rows."""
    rows = usable(table, id_col, vec_col).filter(F.exists("v", lambda x: x != 0)).distinct()
    distinct = cut(copies(rows, ["v"], k).withColumn("id", F.col("ids")[0]))
    asked = rows.filter(F.col("vec_id") % step == 0)
    keyed = cut(asked.groupBy("v").agg(F.min("vec_id").alias("id")))

    index = cut(placed(distinct, "id", 1))
    sizes = index.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    body = index.join(sizes, ["dim", "bucket"]).select("dim", "bucket", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", F.lit(1).alias("side"))
    probe = placed(keyed, "id", probes).join(sizes, ["dim", "bucket"]).select(
        "dim", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", F.lit(0).alias("side"))
    sides = body.join(distinct.select("id", "v"), "id").unionByName(probe.join(keyed, "id"))
    found = cut(_score(sides, k + 1))
    # a query finds its own vector, so k others make k + 1 ids with their copies
    held = found.distinct().join(distinct.select(F.col("id").alias("vec_id"), "ids"), "vec_id").groupBy(F.col("query_id").alias("id")).agg(F.sum(F.size("ids")).alias("_n"))
    short = cut(keyed.join(held.filter(F.col("_n") > k), "id", "left_anti"))
    if not short.isEmpty():
        first = F.shiftright("bucket", 32) == 0
        every = short.withColumn("dim", F.size("v")).join(sizes.filter(first), "dim").select(
            "dim", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", F.lit(0).alias("side"), "v")
        own_dims = body.filter(first).join(short.select(F.size("v").alias("dim")).distinct(), "dim", "left_semi")
        whole = own_dims.join(distinct.select("id", "v"), "id")
        found = found.unionByName(cut(_score(whole.unionByName(every), k + 1)))
    # distinct vectors so far; their copies follow, at most k + 1 ids each
    top = best(found.distinct(), k + 1).join(distinct.select(F.col("id").alias("vec_id"), "ids"), "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score")
    top = best(top, k + 1).groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    own = asked.select("v", F.col("vec_id").alias("_q")).join(keyed, "v").select("_q", F.col("id").alias("query_id"))
    near = own.join(top, "query_id").select(F.col("_q").alias("query_id"), F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score")
    return best(near.filter("query_id <> vec_id"), k)
