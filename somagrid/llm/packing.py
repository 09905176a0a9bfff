"""Packing of token sequences by cutting-stock column generation.

Documents longer than a sequence give full pieces; what remains of each is one
piece.  The histogram of piece lengths (exact up to ``max(SHORTS)`` tokens, on a
grid of ``GRID`` tokens above, so of a fixed size) is the only thing the driver
sees.  For the longer pieces, a linear program over patterns
(sets of lengths that fit one sequence) is solved by column generation: a
knapsack dynamic program over the dual prices finds the next pattern.  The
patterns' rounded-down counts, and best-fit patterns for the few pieces left
over, are topped up with short pieces at their exact lengths; further short
pieces form sequences of their own.  Which lengths count as short is tried for
each of ``SHORTS``; the plan of fewest sequences is taken.  Its patterns become
intervals of ranks: the r-th piece of a length goes to the
sequence whose interval holds r.  Ranks are counted in salted parts, so a
length that a third of all documents share is not ranked in one task.

Null text counts as empty: one piece with the end id.  Repeated rows are packed
each on their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from somagrid.llm.bpe import Encoder, Vocabulary, expand, word_batches
from somagrid.session import cut

CAPACITY = 2048
GRID = 16
SHORTS = (0, 64, 256)
SALT_ROWS = 4096
GAP = 0.0005
PIECES = ("doc_id {t}, start long, length long, ids_crc32 long, doc_tokens long")


def pieces(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Encode every text, append the end id and cut it at multiples of the capacity."""
    schema = PIECES.format(t=dict(docs.dtypes)[id_col])

    def run(batches):
        e = Encoder(Vocabulary(path))
        for b in batches:
            for i, texts in word_batches(b, text_col):
                number, at = e.encode(texts)
                row, start, length, crc, total = [], [], [], [], []
                for k, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    ids = np.append(expand(e.ids, e.bound, number[x:y]), np.int32(end_id)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        own = ids[s:s + capacity]
                        row.append(i + k)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(v, pa.int64()) for v in (start, length, crc, total)]],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text_col)).mapInArrow(run, schema)


def _best_fit(left: dict[int, int], units: int) -> list[dict[int, int]]:
    """Patterns for a few pieces: longest first, into the fullest sequence that has room."""
    room: dict[int, list[dict[int, int]]] = {}
    for q in sorted(left, reverse=True):
        for _ in range(left[q]):
            free = min((f for f in room if f >= q and room[f]), default=None)
            own = room[free].pop() if free is not None else {}
            own[q] = own.get(q, 0) + 1
            room.setdefault((units if free is None else free) - q, []).append(own)
    return [p for ps in room.values() for p in ps]


def patterns(histogram: dict[int, int], units: int, rounds: int = 20000) -> list[tuple[dict[int, int], int]]:
    """(pattern, how often) covering exactly the pieces of a length histogram.

    ``histogram``: pieces by length in grid units, 1 to ``units``.  Master program: fewest sequences that cover the
    histogram, by revised simplex on patterns; the pricing knapsack is exact."""
    size = np.array(sorted(q for q, n in histogram.items() if n > 0))
    if not len(size):
        return []
    need = np.array([histogram[int(q)] for q in size], float)
    m = len(size)
    columns = [np.zeros(m) for _ in range(m)]
    for k in range(m):
        columns[k][k] = units // size[k]
    inverse = np.diag([1 / c[k] for k, c in enumerate(columns)])
    amount = inverse @ need
    for _ in range(rounds):
        price = np.maximum(inverse.sum(axis=0), 0)  # every pattern costs one sequence
        value, last = np.zeros(units + 1), np.full(units + 1, -1)
        stop = np.searchsorted(size, np.arange(units + 1), side="right")
        for c in range(1, units + 1):
            value[c] = value[c - 1]
            if stop[c]:
                got = value[c - size[:stop[c]]] + price[:stop[c]]
                k = int(got.argmax())
                if got[k] > value[c] + 1e-12:
                    value[c], last[c] = got[k], k
        if value[units] <= 1 + GAP:  # the optimum is at least the present value over value[units]
            break
        new, c = np.zeros(m), units
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                new[last[c]] += 1
                c -= size[last[c]]
        step = inverse @ new
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[out] = new
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        amount = np.maximum(amount - step * ratio[out], 0)
        amount[out] = ratio[out]
    left = need.astype(int)
    plan = []
    for c, x in zip(columns, amount):
        own = {int(size[k]): int(c[k]) for k in np.flatnonzero(c)}
        n = min([int(x + 1e-9), *(int(left[k] // c[k]) for k in np.flatnonzero(c))])
        if n > 0:
            plan.append((own, n))
            left -= (c * n).astype(int)
    plan += [(p, 1) for p in _best_fit({int(q): int(n) for q, n in zip(size, left) if n > 0}, units)]
    return plan


def topped(plan: list[tuple[dict[int, int], int]], short: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``plan`` (patterns of lengths in tokens) with all short pieces added: longest first into the room of each pattern, then into new ones."""
    left = {q: n for q, n in sorted(short.items(), reverse=True) if n > 0}
    out = []

    def take(own: dict[int, int], room: int, n: int) -> dict[int, int]:
        for q in left:
            k = min(room // q, left[q] // n)
            if k:
                own[q], room = own.get(q, 0) + k, room - q * k
        return own

    def used(own: dict[int, int], n: int) -> None:
        for q, k in own.items():
            left[q] -= k * n
            if not left[q]:
                del left[q]

    for p, n in plan:
        own = take({}, capacity - sum(q * k for q, k in p.items()), n)
        used(own, n)
        out.append(({**p, **own}, n))
    while left:
        own = take({}, capacity, 1)
        n = min(left[q] // k for q, k in own.items())
        used(own, n)
        out.append((own, n))
    return out


def planned(seen: dict[int, int], short: int, capacity: int, grid: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of lengths in tokens for a histogram: the linear program on the grid above ``short``, exact lengths up to it."""
    units: dict[int, int] = {}
    for q, n in seen.items():
        if q > short:
            units[-(-q // grid)] = units.get(-(-q // grid), 0) + n
    plan = [({u * grid: k for u, k in p.items()}, n) for p, n in patterns(units, capacity // grid)]
    return topped(plan, {q: n for q, n in seen.items() if q <= short}, capacity)


def ranked(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Add ``rank`` from 0 within ``key``: salted parts are numbered alone and shifted by the parts before them."""
    parts = max(1, -(-df.count() // SALT_ROWS))
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(parts)))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    shift = df.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(W.partitionBy(key, "_salt").orderBy(*by)) - 1
    return df.withColumn("_own", own).join(shift, [key, "_salt"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_n", "_salt")


def pack(cuts: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Place pieces into sequences: adds ``sequence_id`` and the gapless ``offset``."""
    spark = cuts.sparkSession
    length, most = F.col("length"), max(SHORTS)
    key = lambda short: F.when(length == capacity, 0).when(length <= short, length).otherwise(F.ceil(length / grid) * grid).cast("int")
    seen = {r["_q"]: r["n"] for r in cuts.groupBy(key(most).alias("_q")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max(SHORTS) + capacity / grid + 1 rows
    whole = seen.pop(0, 0)
    used: dict[int, int] = {}
    ranges, base = [(0, 0, whole, 0, 1, 0)], whole
    plan, short = min(((planned(seen, x, capacity, grid), x) for x in SHORTS), key=lambda y: sum(n for _, n in y[0]))
    rows = ranked(cuts.withColumn("_q", key(short)), "_q", ["doc_id", "start", "ids_crc32"])
    for p, n in plan:
        slot = 0
        for q, k in sorted(p.items(), reverse=True):
            ranges.append((q, used.get(q, 0), used.get(q, 0) + n * k, base, k, slot))
            used[q] = used.get(q, 0) + n * k
            slot += k
        base += n
    where = spark.createDataFrame(ranges, "q int, lo long, hi long, base long, k long, slot long")
    placed = rows.join(F.broadcast(where), (F.col("_q") == F.col("q")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor(at / F.col("k"))).withColumn("_slot", F.col("slot") + at % F.col("k"))
    before = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Encode, cut and pack a table of documents; one row per piece."""
    return pack(cut(pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity)), capacity, grid)
