"""Exact Euclidean distance maps, one axis at a time.

The squared distance to the nearest background voxel is separable: along each
axis it is the lower envelope of parabolas that stand on the values of the
axis before.  A line of voxels is bounded by the extent of its axis and is one
sorted run of rows in a task; nothing depends on how far distances go.
Background parts the parabolas, so each gapless stretch of a line is an
envelope of its own with a background voxel at both ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

AXES = ["z", "y", "x"]
FAR = 1 << 50


def whole_lines(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of whole key runs, about ``rows`` rows each, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(n, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            same &= v == v[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def envelope(f: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """At each place i of every stretch the least f[j] + (i - j)**2 over the places j of the stretch.

    Stretches are ``first`` to ``last`` inclusive; their two end places give values but get none.  The best j never moves
    back as i grows, so all stretches halve together: the middle place searches its range, the halves what is left of it."""
    out = np.full(len(f), FAR, np.int64)
    a, b, lo, hi = first + 1, last, first, last
    while len(a):
        mid = (a + b) // 2
        width = hi - lo + 1
        start = np.r_[0, np.cumsum(width)[:-1]]
        node = np.repeat(np.arange(len(a)), width)
        j = np.arange(len(node)) - start[node] + lo[node]
        d = j - mid[node]
        v = f[j] + d * d
        least = np.minimum.reduceat(v, start)
        best = np.minimum.reduceat(np.where(v == least[node], j, len(f)), start)
        out[mid] = least
        left, right = a < mid, mid + 1 < b
        a, b, lo, hi = (np.r_[x[left], y[right]] for x, y in ((a, mid + 1), (mid, b), (lo, best), (best, hi)))
    return out


def distance_map(mask: DataFrame, rmax: float | None = None, bounds: dict | None = None, out: str = "distance") -> DataFrame:
    """Euclidean distance of each mask voxel to the nearest voxel outside the mask, NULL beyond ``rmax`` or if there is none.

    Outside the given bounds is not background."""
    cur = mask.select(*AXES).distinct().withColumn("_f", F.lit(FAR))
    kind = dict(mask.dtypes)
    cur = cur.select(*[F.col(a).cast("long").alias(a) for a in AXES], F.col("_f").cast("long"))
    for axis in ("x", "y", "z"):
        lines = [a for a in AXES if a != axis]
        size = bounds[axis] if bounds else None

        def run(batches, axis=axis, lines=lines, size=size):
            for t in whole_lines(batches, lines):
                p, f = t.column(axis).to_numpy(), t.column("_f").to_numpy()
                new = np.r_[True, p[1:] != p[:-1] + 1]
                for k in lines:
                    v = t.column(k).to_numpy()
                    new[1:] |= v[1:] != v[:-1]
                s = np.flatnonzero(new)
                count = np.diff(np.r_[s, len(p)])
                first = s + 2 * np.arange(len(s))  # each stretch gains a place at both ends
                last = first + count + 1
                wide = np.zeros(len(p) + 2 * len(s), np.int64)
                at = np.arange(len(p)) + 2 * np.cumsum(new) - 1
                wide[at] = f
                if size is not None:
                    wide[first[p[s] == 0]] = FAR
                    wide[last[p[s + count - 1] == size - 1]] = FAR
                f = np.minimum(envelope(wide, first, last)[at], FAR)
                t = t.set_column(t.column_names.index("_f"), "_f", pa.array(f))
                yield from t.to_batches()

        dealt = cur.repartition(*lines).sortWithinPartitions(*lines, axis)
        cur = dealt.mapInArrow(run, "z long, y long, x long, _f long")
    known = F.col("_f") < FAR if rmax is None else F.col("_f") <= int(rmax * rmax)
    return cur.select(*[F.col(a).cast(kind[a]).alias(a) for a in AXES], F.when(known, F.sqrt(F.col("_f").cast("double"))).alias(out))
