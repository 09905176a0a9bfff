"""Connected components of graphs and of voxel sets."""

from __future__ import annotations

import functools
import json
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from somagrid.session import cut, release, shared_out, spread

AXES = ["z", "y", "x"]
BITS = 21


def voxel_id(prefix: str = "") -> Column:
    """Position packed into one long, 21 bits per axis, ordered z, y, x; a position that does not fit is an error."""
    fits = lambda a: F.col(f"{prefix}{a}").between(0, (1 << BITS) - 1)
    c = lambda a: F.when(F.col(f"{prefix}{a}").isNull() | fits(a), F.col(f"{prefix}{a}").cast("bigint")).otherwise(
        F.raise_error(F.lit(f"{prefix}{a} does not fit into {BITS} bits")).cast("bigint"))
    return F.shiftleft(c("z"), 2 * BITS).bitwiseOR(F.shiftleft(c("y"), BITS)).bitwiseOR(c("x"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  Every node's smallest neighbour comes from a partial
    aggregate, so a hub node never gathers its edges in one task."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low, "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id in it.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the
    edge set stops changing; each round is written once to the checkpoint
    folder and checked by row count and hash sums observed during the write.  Ids
    may be of any type that has an order.
    """
    canon = edges.filter("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()

    def write(e: DataFrame):
        seen = Observation()
        mark = F.bit_xor(F.xxhash64("u", "v"))
        t = cut(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("s"), mark.alias("x")))
        got = seen.get
        return t, (got["n"], got["s"], got["x"])

    cur, mark = write(canon)
    same = mark[0] == 0
    while not same:
        nxt, new = write(_stars(_stars(cur, True), False))
        release(cur)
        cur, same = nxt, new == mark
        mark = new
    return nodes.select("id").join(cur.select(F.col("u").alias("id"), F.col("v").alias("_m")), "id", "left").select(
        "id", F.coalesce("_m", "id").alias("component")
    )


def offsets(connectivity: int, forward: bool = False) -> list[tuple[int, int, int]]:
    """Neighbour steps for 6, 18 or 26 neighbours (``forward``: one per pair)."""
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    r = (-1, 0, 1)
    out = [(a, b, c) for a in r for b in r for c in r if 0 < abs(a) + abs(b) + abs(c) <= reach]
    return [o for o in out if o > (0, 0, 0)] if forward else out


def _local_roots(pos: np.ndarray, group: np.ndarray, steps) -> np.ndarray:
    """Index of the smallest connected row for each voxel of one block.

    Rows are in position order, so the smallest row is the smallest voxel."""
    lo = pos.min(axis=0)
    shape = pos.max(axis=0) - lo + 3
    flat = lambda p: np.ravel_multi_index(tuple((p - lo + 1).T), shape)
    lut = np.full(int(np.prod(shape)), -1, dtype=np.int64)
    here = flat(pos)
    lut[here] = np.arange(len(pos))
    a, b = [], []
    for s in steps:
        other = lut[flat(pos + np.array(s))]
        hit = other >= 0
        hit[hit] = group[other[hit]] == group[hit]
        a.append(np.nonzero(hit)[0])
        b.append(other[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(pos))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def label_components(voxels: DataFrame, connectivity: int = 26, within: str | None = None, block: int = 32,
                     out: str = "component", by: list[str] = ()) -> DataFrame:
    """3-D components of a voxel set; the id is the smallest :func:`voxel_id`.

    Each block of ``block**3`` voxels is labelled on its own (one shuffle, at
    most that many rows per group); only block pieces that meet across a block
    face become graph nodes.  ``within`` keeps voxels of different values apart.
    With ``by`` (a brain, say) each value has a volume of its own, and an id names
    a component together with it.  Positions must fit into 21 bits an axis.
    """
    by, at = list(by), [*by, *AXES]
    kind = dict(voxels.dtypes)
    steps = offsets(connectivity, forward=True)
    grp = F.xxhash64(within) if within else F.lit(0).cast("bigint")
    extra = [c for c in voxels.columns if c not in at]
    v = voxels.select(*at, grp.alias("_g")).distinct()
    keyed = v
    for a in AXES:
        keyed = keyed.withColumn(f"_b{a}", F.floor(F.col(a) / block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(AXES, ignore_index=True)
        pos = pdf[AXES].to_numpy(np.int64)
        if pos.min() < 0 or pos.max() >> BITS:
            raise ValueError(f"positions must lie between 0 and {(1 << BITS) - 1}")
        root = _local_roots(pos, pdf["_g"].to_numpy(), steps)
        packed = (pos[:, 0] << 2 * BITS) | (pos[:, 1] << BITS) | pos[:, 2]
        return pdf[at + ["_g"]].assign(_piece=packed[root])

    pieces = cut(keyed.groupBy(*by, "_bz", "_by", "_bx").applyInPandas(run, "".join(f"{b} {kind[b]}, " for b in by) + "z bigint, y bigint, x bigint, _g bigint, _piece bigint"))
    node = F.struct(*by, "_piece") if by else F.col("_piece")
    arr = F.from_json(F.lit(json.dumps([dict(zip(AXES, o)) for o in steps])), "array<struct<z:bigint,y:bigint,x:bigint>>")
    on_face = functools.reduce(operator.or_, [F.pmod(F.col(a), F.lit(block)).isin(0, block - 1) for a in AXES])
    rim = pieces.filter(on_face)
    sent = spread(rim.withColumn("_o", F.explode(arr)).select(
        *by, *[(F.col(a) + F.col(f"_o.{a}")).alias(a) for a in AXES], "_g", node.alias("src")
    ))
    meet = sent.join(rim.select(*at, "_g", node.alias("dst")), [*at, "_g"]).filter("src <> dst").select("src", "dst").distinct()
    comp = connected(meet, pieces.select(node.alias("id")).distinct())
    if by:
        comp = comp.select(*[F.col(f"id.{c}").alias(c) for c in (*by, "_piece")], F.col("component._piece").alias("component"))
    else:
        comp = comp.withColumnRenamed("id", "_piece")
    lab = shared_out(pieces, pieces.count(), *by, "_piece").join(comp, [*by, "_piece"]).select(*at, F.col("component").alias(out))
    return lab if not extra else voxels.join(lab, at)
