"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are forward indexes of integer term weights: a component is a term.
Distinct vectors, ordered so that alike ones are near, are cut into document
ranges; a range holds blocks of ``BLOCK`` vectors with the largest and smallest
weight of each term.  For a query the term extremes sum to a bound on every
score in a block.  Blocks are taken in the order of their bounds and scored
through the forward index until the next bound falls below the k-th score so
far; a block whose bound equals it is still scored, so ties are exact.

Query batches meet every document range: ranges go to tasks in groups, with a
part of the batches each, so a batch is copied once per group and a range once
per part; each range answers with its best few.  Equal vectors are searched and stored once with their smallest
ids.  Vectors that are null, empty or hold null or non-finite components take no
part, nor do rows without an id; vectors of different lengths never meet; rows
that share an id and a vector are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from somagrid.llm.common import binary
from somagrid.llm.vectors import QUERY_STEP, best, copies, matrix, usable
from somagrid.session import cut

BLOCK = 128
RANGE = 8192
BATCH = 512
#: How many ranges, and about how many query batches, meet in a task.
GROUP = 8
SHARE = 64


def quantized(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): integer weights floor(scale * x)."""
    return usable(table, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def ranges(distinct: DataFrame, n: int) -> DataFrame:
    """One row per document range: (s, dim, ids, edge, forward), the forward index as a matrix of whole numbers."""

    def run(batches):
        s = TaskContext.get().partitionId()
        rows: dict[int, list] = {}
        for b in batches:
            for dim, v, ids in zip(b.column(2).to_pylist(), b.column(0), b.column(1)):
                rows.setdefault(dim, []).append((v.values.to_numpy(), ids.values.to_numpy()))
        for dim, own in rows.items():
            m = np.stack([v for v, _ in own]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([dim], pa.int32()), binary([np.concatenate([i for _, i in own]).astype(np.int64).tobytes()]),
                 binary([np.r_[0, np.cumsum([len(i) for _, i in own])].astype(np.int64).tobytes()]), binary([m.tobytes()])], ["s", "dim", "ids", "edge", "forward"])

    # near vectors get near places: by the strongest term and its sign, then the next terms
    strongest = F.array_position(F.transform("v", F.abs), F.array_max(F.transform("v", F.abs)))
    placed = distinct.select("v", "ids", F.size("v").alias("dim"), strongest.alias("_a"), F.get(F.col("v"), (strongest - 1).cast("int")).alias("_w"), F.col("ids")[0].alias("_i"))
    dealt = placed.repartitionByRange(max(1, -(-n // RANGE)), "dim", "_a", "_w", "_i").sortWithinPartitions("dim", "_a", "_w", "_i")
    return dealt.select("v", "ids", "dim").mapInArrow(run, "s long, dim int, ids binary, edge binary, forward binary")


def batches_of(queries: DataFrame) -> DataFrame:
    """Query batches: (dim, keys, weights) from (qkey, v)."""

    def run(batches):
        held: dict[int, list] = {}

        def send(dim):
            own = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), binary([np.array([k for k, _ in own], np.int64).tobytes()]), binary([np.stack([v for _, v in own]).astype(np.int64).tobytes()])],
                ["dim", "keys", "weights"])

        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                w = v.values.to_numpy()
                held.setdefault(len(w), []).append((k, w))
                if len(held[len(w)]) >= BATCH:
                    yield send(len(w))
        for dim in list(held):
            yield send(dim)

    return queries.select("qkey", "v").mapInArrow(run, "dim int, keys binary, weights binary")


def _search(q: np.ndarray, low: np.ndarray, docs: np.ndarray, k: int):
    """Scores of at least the k-th best: (query, document, score) and the k-th score of each query."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(docs).max(initial=0)) * q.shape[1] < 2**52
    if exact:  # whole numbers below 2**53 are exact in doubles
        q, docs = q.astype(float), docs.astype(float)
    starts = np.arange(0, len(docs), BLOCK)
    top, bottom = np.maximum.reduceat(docs, starts), np.minimum.reduceat(docs, starts)
    bound = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ bottom.T
    order = np.argsort(-bound, axis=1)
    limit = np.take_along_axis(bound, order, axis=1)
    least = low.astype(float) if exact else low
    best_ = np.tile(least[:, None], (1, k))  # the k best scores so far, or the given lower bound
    who, what, score = [], [], []
    for r in range(len(starts)):
        kth = best_.min(axis=1)
        active = np.flatnonzero(limit[:, r] >= kth)
        if not len(active):
            break
        for b in np.unique(order[active, r]):
            rows = active[order[active, r] == b]
            part = docs[starts[b]:starts[b] + BLOCK]
            s = q[rows] @ part.T
            x, y = np.nonzero(s >= kth[rows][:, None])
            who.append(rows[x])
            what.append(starts[b] + y)
            score.append(s[x, y])
            both = np.concatenate([best_[rows], s], axis=1)
            best_[rows] = -np.partition(-both, k - 1, axis=1)[:, :k]
    kth = best_.min(axis=1)
    if not who:
        z = np.zeros(0, np.int64)
        return z, z, z, kth
    who, what, score = np.concatenate(who), np.concatenate(what), np.concatenate(score)
    keep = score >= kth[who]
    return who[keep], what[keep], score[keep].astype(np.int64), kth


_NONE = -(2**62)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, weights and lower bounds of a query batch."""
    keys = np.frombuffer(row["keys"], np.int64)
    low = np.frombuffer(row["low"], np.int64) if row["low"] is not None else np.full(len(keys), _NONE, np.int64)
    return keys, np.frombuffer(row["weights"], np.int64).reshape(len(keys), row["dim"]), low


def _limits(rows: DataFrame, k: int) -> DataFrame:
    """(batch, low): the k-th scores in one range of each (query batch, range) row."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                _, q, low = _unpacked(row)
                kth = _search(q, low, np.frombuffer(row["forward"], np.int64).reshape(-1, row["dim"]), k)[3]
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]], pa.int64()), binary([np.maximum(kth, _NONE).astype(np.int64).tobytes()])], ["batch", "low"])

    return rows.mapInArrow(run, "batch long, low binary")


def _matches(batches: DataFrame, index: DataFrame, ranges: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` of each range that are not below the k-th score of those looked at before.

    Groups of ranges and parts of the batches meet in tasks; no row holds a batch and a range together."""
    groups = -(-ranges // GROUP)
    many = batches.count()
    parts = max(1, min(many, max(-(-many // SHARE), -(-2 * batches.sparkSession.sparkContext.defaultParallelism // groups))))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = batches.withColumn("_group", each(groups)).withColumn("_part", F.pmod(F.xxhash64("batch"), F.lit(parts)))
    held = index.withColumn("_group", F.expr(f"s div {GROUP}")).withColumn("_part", each(parts))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            docs = [[np.frombuffer(r[c], np.int64) for c in ("ids", "edge", "forward")] for r in right.to_pylist()]
            for row in left.to_pylist():
                keys, q, low = _unpacked(row)
                for ids, edge, forward in docs:
                    who, what, score, low = _search(q, low, forward.reshape(-1, row["dim"]), k)
                    low = np.maximum(low, _NONE).astype(np.int64)
                    n = edge[what + 1] - edge[what]
                    stop = np.cumsum(n)
                    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(edge[what] - (stop - n), n)
                    who, score, vec = np.repeat(who, n), np.repeat(score, n), ids[at]
                    o = np.lexsort((vec, -score, who))
                    who, score, vec = who[o], score[o], vec[o]
                    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
                    found.append((keys[who[keep]], vec[keep], score[keep]))
        return pa.table([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (list(zip(*found)) or [()] * 3)], ["query_id", "vec_id", "score"])

    keys = ["dim", "_group", "_part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")


def search(table: DataFrame, k: int = 20, step: int = QUERY_STEP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``step`` the k best other rows."""
    rows = quantized(table, id_col, vec_col).distinct()
    distinct = cut(copies(rows, ["v"], k))
    index = cut(ranges(distinct, distinct.count()))
    asked = rows.filter(F.col("vec_id") % step == 0)
    keyed = asked.groupBy("v").agg(F.min("vec_id").alias("qkey"))
    batches = cut(batches_of(keyed).withColumn("batch", F.monotonically_increasing_id()))
    count = (index.agg(F.max("s").alias("s")).first()["s"] or 0) + 1
    # a first range of each batch gives a lower bound of the k-th score; one more than k, as the query itself is among them
    seed = batches.withColumn("s", F.pmod(F.xxhash64("batch"), F.lit(count))).withColumn("low", F.lit(None).cast("binary")).join(index, ["s", "dim"])
    low = cut(_limits(seed, k + 1)).groupBy("batch").agg(F.first("low").alias("low"))
    found = cut(_matches(batches.join(low, "batch", "left"), index, count, k + 1))
    top = best(found, k + 1).groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))  # k + 1 rows each
    own = asked.select("v", F.col("vec_id").alias("_q")).join(keyed, "v").select("_q", F.col("qkey").alias("query_id"))
    near = own.join(top, "query_id").select(F.col("_q").alias("query_id"), F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score")
    return best(near.filter("query_id <> vec_id"), k)
