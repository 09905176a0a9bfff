"""Rows that lie near each other, met tile by tile.

A row of the left side goes to its own tile, a row of the right side to every
tile its reach touches; pairs are looked at inside the task and only what the
kernel makes of them is written.  A tile with too many left rows is shared out
over several tasks, each with all of the tile's right rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from somagrid.operators.nearest import PAIRS, _rows_near
from somagrid.session import cut, spread

AXES = ["z", "y", "x"]
#: Edge of a tile in reaches, and how many left rows a task takes.
TILE = 12
ROWS = 1 << 18


def positions(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(a).to_numpy().astype(float) for a in AXES], axis=1)


def close(q: np.ndarray, p: np.ndarray, reach: np.ndarray | float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) row numbers of all pairs whose positions differ by at most ``reach`` on every axis, and some
    others, in parts; all pairs of a left row are in one part."""
    if not len(q) or not len(p):
        return
    scale = 1.0 / (np.broadcast_to(np.asarray(reach, float), 3) * (1 + 1e-9))
    order, start, end = _rows_near(q * scale, p * scale, 1.0)
    many = (end - start).sum(axis=1)
    bounds, i = np.r_[0, np.cumsum(many)], 0
    while i < len(q):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PAIRS, side="right")) - 1)
        width = (end[i:j] - start[i:j]).ravel()
        at = np.arange(width.sum()) - np.repeat(np.r_[0, np.cumsum(width)[:-1]], width) + np.repeat(start[i:j].ravel(), width)
        yield np.repeat(np.arange(i, j), many[i:j]), order[at]
        i = j


def given(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a value in all ``cols``."""
    kind = dict(df.dtypes)
    keep = [F.col(c).isNotNull() & (~F.isnan(c) if kind[c] in ("float", "double") else F.lit(True)) for c in cols]
    return df.filter(functools.reduce(operator.and_, keep))


def meet(a: DataFrame, b: DataFrame, reach: dict, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, by=(), edge: dict | None = None,
         limit: int = ROWS, few: bool = False) -> DataFrame:
    """``kernel(left, right)`` for every tile, its rows with the ``by`` columns in front; ``right`` holds all rows of ``b``
    within ``reach`` (per axis) of any row of ``left``.  Rows without a position or a ``by`` value are left out.  With ``few`` (left
    rows are expected in few tiles) copies of ``b`` for tiles without any are dropped before they move."""
    by, tile = list(by), [f"_t{x}" for x in AXES]
    edge = edge or {x: float(TILE * reach[x]) for x in AXES}
    keys = [*by, *tile]
    a, b = given(a, [*by, *AXES]), given(b, [*by, *AXES])
    kind = dict(a.dtypes)
    none = a.limit(0).toArrow(), b.limit(0).toArrow()  # a tile without rows on one side comes without columns
    left = a.select("*", *[F.floor(F.col(x) / F.lit(edge[x])).alias(t) for x, t in zip(AXES, tile)])
    right = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of its own, also if both sides come from one table
    for x, t in zip(AXES, tile):
        r = float(reach[x]) * (1 + 1e-9)
        right = right.withColumn(t, F.explode(F.sequence(F.floor((F.col(x) - r) / F.lit(edge[x])), F.floor((F.col(x) + r) / F.lit(edge[x])))))
    if few:
        right = right.join(cut(left.select(*keys).distinct()), keys, "left_semi")
    right = spread(right)
    crowd = cut(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).alias("_parts")))
    if not crowd.isEmpty():
        parts = F.coalesce("_parts", F.lit(1))
        left = left.join(crowd, keys, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts)).drop("_parts")
        right = spread(right.join(crowd, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts"))
        keys = [*keys, "_part"]

    def run(key, q: pa.Table, p: pa.Table) -> pa.Table:
        out = kernel(q.combine_chunks() if q.num_rows else none[0], p.combine_chunks() if p.num_rows else none[1])
        return pa.table({**{c: pa.repeat(k, out.num_rows) for c, k in zip(by, key)}, **{n: out.column(n) for n in out.column_names}})

    front = "".join(f"{c} {kind[c]}, " for c in by)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, front + schema)
