"""Trace trees and skeletons: parent chains, merging, loops, bridges, gaps."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from somagrid.operators.blocks import BLOCK, Grid, ball
from somagrid.operators.meet import close, given, meet, positions
from somagrid.operators.ordered import value_ranks
from somagrid.operators.spatial import knn
from somagrid.operators.tree import chains
from somagrid.session import cut, release, shared_out, spread

AXES = ["z", "y", "x"]
#: How far :func:`fill_gaps` looks for neighbours within a block, and how many places a task looks up at a time.
SEEN = 4
LOOKUPS = 1 << 21


def parent_chains(nodes: DataFrame) -> DataFrame:
    """(tree, cur_idx, ancestor, step): every node with its chain to the root."""
    up = nodes.filter("parent >= 0").select("tree", "cur_idx", F.col("parent").alias("ancestor"))
    return chains(up, ["tree"], "cur_idx", "ancestor")


def tree_paths(nodes: DataFrame, length: str = "len") -> DataFrame:
    """Depth and coordinate count of each node's parent chain, and its place in
    shortest-first order within the tree.

    Every node carries the sums up to one ancestor; each round it takes over that
    ancestor's sums and goes on from there, so a round is one row per node and the
    chains themselves are never written.  A parent without a row ends the chain."""
    at = lambda df, idx, **names: df.select("tree", F.col("cur_idx").alias(idx), *[F.col(c).alias(n) for c, n in names.items()])
    up = nodes.select("tree", "cur_idx", F.when(F.col("parent") >= 0, F.col("parent")).alias("_up"))
    j = up.join(at(nodes, "_up", **{length: "_l"}).withColumn("_there", F.lit(True)), ["tree", "_up"], "left")
    state = cut(j.select("tree", "cur_idx", F.when(F.col("_there"), F.col("_up")).alias("_up"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("depth"),
                         F.coalesce("_l", F.lit(0)).alias("path_length")))
    while not state.filter("_up IS NOT NULL").isEmpty():
        j = state.join(at(state, "_up", _up="_next", depth="_d", path_length="_p"), ["tree", "_up"], "left")
        add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        new = cut(j.select("tree", "cur_idx", F.col("_next").alias("_up"), add("depth", "_d"), add("path_length", "_p")))
        release(state)
        state = new
    j = cut(state.drop("_up").withColumn("_k", F.struct("path_length", "cur_idx")))
    r = value_ranks(j, ["tree"], "_k").select("tree", "_k", (F.col("before") + 1).alias("place"))
    return j.join(r, ["tree", "_k"]).drop("_k")


def merge_trees(nodes: DataFrame) -> DataFrame:
    """All trees in one numbering: each tree starts after the nodes of the trees
    before it; roots stay -1."""
    off = value_ranks(nodes, [], "tree").select("tree", F.col("before").alias("_o"))
    j = nodes.join(off, "tree")
    return j.withColumn("merged_idx", F.col("cur_idx") + F.col("_o")).withColumn(
        "merged_parent", F.when(F.col("parent") < 0, F.col("parent")).otherwise(F.col("parent") + F.col("_o"))).drop("_o")


def tree_edges(nodes: DataFrame) -> DataFrame:
    """Parent and child pairs of merged trees, for a polyline export."""
    return merge_trees(nodes).filter("merged_parent >= 0").select(F.col("merged_parent").alias("parent"), F.col("merged_idx").alias("child"))


def drop_loops(segs: DataFrame, ends: DataFrame) -> DataFrame:
    """Drop terminal segments (nothing starts at their end) that end on no end
    point.  ``segs``: seg, s_z.. and e_z.. corners; ``ends``: z, y, x."""
    starts = segs.select(F.col("seg").alias("_s"), *[F.col(f"s_{a}").alias(f"e_{a}") for a in AXES])
    keys = [f"e_{a}" for a in AXES]
    n = starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    own = functools.reduce(operator.and_, [F.col(f"s_{a}") == F.col(f"e_{a}") for a in AXES]).cast("int")
    j = segs.join(n, keys, "left").withColumn("_kids", F.coalesce("_n", F.lit(0)) - own)
    e = ends.select(*[F.col(a).alias(f"e_{a}") for a in AXES]).distinct().withColumn("_end", F.lit(True))
    j = j.join(e, keys, "left")
    return j.filter((F.col("_kids") > 0) | F.col("_end")).select(*segs.columns)


def bridge_ends(ends: DataFrame, voxels: DataFrame, r: int = 2) -> DataFrame:
    """Bridges from the end points of segments.

    Ends of different segments whose surroundings of radius ``r`` meet are
    joined, the shortest bridge per end and other segment; an end near the body
    of a segment it has no such bridge to is joined to that body's nearest voxel.
    """
    tips = ends.select("seg", *AXES).distinct()
    points = tips.withColumn("_end", F.lit(True)).unionByName(voxels.select("seg", *AXES).distinct().withColumn("_end", F.lit(False)))
    points = points.filter("seg IS NOT NULL")
    kind = dict(tips.dtypes)
    to = ", ".join(f"{x}:{kind[x]}" for x in AXES)

    def bridge(q: pa.Table, p: pa.Table) -> pa.Table:
        x, y = positions(q), positions(p)
        # segments of both sides as numbers
        names = pc.unique(pa.concat_arrays([c for t in (q, p) for c in t.column("seg").chunks] or [pa.array([], q.schema.field("seg").type)]))
        here, there = (pc.index_in(t.column("seg"), names).to_numpy() for t in (q, p))
        end = p.column("_end").to_numpy(zero_copy_only=False).astype(bool) if p.num_rows else np.zeros(0, bool)
        found = [[np.zeros(0, k) for k in (np.int64, np.int64, float, bool)]]
        for i, k in close(x, y, 2 * r):
            ok = here[i] != there[k]
            i, k = i[ok], k[ok]
            off = np.abs(x[i] - y[k])
            reach, d2 = off.max(axis=1), (off * off).sum(axis=1)
            is_tip = end[k] & (reach <= 2 * r)
            ok = is_tip | (~end[k] & (reach <= r))
            i, k, is_tip, length = i[ok], k[ok], is_tip[ok], np.where(is_tip, reach, np.sqrt(d2))[ok]
            # the shortest bridge per end and other segment, those to ends before those to bodies
            o = np.lexsort((y[k, 2], y[k, 1], y[k, 0], length, ~is_tip, there[k], i))
            i, k, is_tip, length = i[o], k[o], is_tip[o], length[o]
            first = np.r_[True, (i[1:] != i[:-1]) | (there[k[1:]] != there[k[:-1]])] if len(i) else np.zeros(0, bool)
            found.append([v[first] for v in (i, k, length, is_tip)])
        i, k, length, is_tip = (np.concatenate(v) for v in zip(*found))
        own, other = q.take(pa.array(i)).combine_chunks(), p.take(pa.array(k)).combine_chunks()
        flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        at = pa.StructArray.from_arrays([pa.concat_arrays([flat(other.column(a))]) for a in AXES], AXES)
        return pa.table({**{c: own.column(c) for c in ("seg", *AXES)}, "other": other.column("seg"), "length": pa.array(length), "to": at,
                         "kind": pa.array(np.where(is_tip, "end", "body").astype(object), pa.string())})

    schema = ", ".join(f"{c} {kind[c]}" for c in ("seg", *AXES)) + f", other {kind['seg']}, length double, to struct<{to}>, kind string"
    return meet(tips.filter("seg IS NOT NULL"), points, dict.fromkeys(AXES, 2 * r), bridge, schema)


def fill_gaps(coords: DataFrame, edge: float = 3.0) -> DataFrame:
    """Positions plus the lines to a first or second neighbour that is 2 or more away.

    Whole positions look for both neighbours in their block and its halo first; only those that do not find them within ``SEEN``
    go through the search over all positions."""
    p = cut(coords.select(*AXES).distinct())
    if all(k in ("tinyint", "smallint", "int", "bigint") for _, k in p.dtypes):
        near = cut(_near_lines(p))
        lone = near.filter("_lone").select(*AXES)
        near = near.filter("NOT _lone").select(*AXES).distinct()
        if lone.isEmpty():
            return p.unionByName(near)
    else:
        lone, near = p, None
    named = lambda df: df.withColumn("id", F.concat_ws(",", *AXES)).withColumn("at", F.struct(*AXES))
    q = named(lone)
    near2 = knn(q.select("id", *AXES), named(p).select(F.col("id").alias("nid"), "at", *AXES), 2, "id", "nid", edge, ["at"])
    far = near2.filter("distance >= 2").join(q.select("id", F.col("at").alias("a")), "id")
    n = F.greatest(*[F.abs(F.col(f"at.{x}") - F.col(f"a.{x}")) for x in AXES])
    far = far.withColumn("_n", n).filter("_n > 1").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int") - 1)))
    line = far.select(*[
        F.bround(F.col(f"a.{x}") + (F.col(f"at.{x}") - F.col(f"a.{x}")) * F.col("_i") / F.col("_n").cast("double")).cast("bigint").alias(x) for x in AXES])
    return (p if near is None else p.unionByName(near)).unionByName(line).distinct()


def _near_lines(p: DataFrame) -> DataFrame:
    """Of distinct positions, what lies on the lines of :func:`fill_gaps` and is no position, and (``_lone``) the positions
    without two neighbours within ``SEEN``."""
    ends = p.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = np.array([ends[f"lo{a}"] or 0 for a in AXES])
    bounds = {a: (ends[f"hi{a}"] or 0) - int(v) + 1 for a, v in zip(AXES, low)}
    steps, d2 = ball(SEEN)
    steps, d2 = steps[1:], d2[1:]  # without the position itself
    w = BLOCK + 2 * SEEN
    flat = (steps[:, 0] * w + steps[:, 1]) * w + steps[:, 2]

    def lines(key, t):
        first = np.array([k.as_py() * BLOCK for k in key])
        grid = Grid(t, list(first), BLOCK, (SEEN,) * 3, [])
        first = first + low - SEEN
        here = grid.present.ravel()
        count = grid.present.astype(np.int8)
        for a in range(3):  # rows in the 27 voxels around
            c = np.moveaxis(count, a, 0)
            c[1:-1] = c[:-2] + c[1:-1] + c[2:]
        inner = np.zeros_like(grid.present)
        inner[(slice(SEEN, SEEN + BLOCK),) * 3] = True
        todo = np.nonzero((grid.present & inner & (count < 3)).ravel())[0]
        lone, drawn = [], []
        for i in range(0, len(todo), LOOKUPS // len(flat)):
            own = todo[i:i + LOOKUPS // len(flat)]
            q, k = np.nonzero(here[own[:, None] + flat])  # by distance
            start, end = np.searchsorted(q, np.arange(len(own))), np.searchsorted(q, np.arange(len(own)), side="right")
            two = end - start >= 2
            lone.append(own[~two])
            last = np.full(len(own), -1)
            last[two] = d2[k[start[two] + 1]]
            ok = d2[k] <= last[q]
            q, k = q[ok], k[ok]
            a = np.stack(np.unravel_index(own[q], (w,) * 3), axis=1) + first
            b = a + steps[k]
            name = np.unique(np.array([f"{z},{y},{x}" for z, y, x in b.tolist()], str), return_inverse=True)[1]
            o = np.lexsort((name, d2[k], q))
            o = o[np.arange(len(q)) - np.searchsorted(q, q) < 2]  # two of each
            a, b = a[o], b[o]
            n = np.abs(b - a).max(axis=1) if len(a) else np.zeros(0, int)
            for j in range(1, SEEN):
                far = n > j
                drawn.append(np.rint(a[far] + (b[far] - a[far]) * j / n[far, None].astype(float)).astype(np.int64))
        lone = np.stack(np.unravel_index(np.concatenate([*lone, todo[:0]]), (w,) * 3), axis=1) + first
        drawn = np.unique(np.concatenate([*drawn, np.zeros((0, 3), np.int64)]), axis=0)
        drawn = drawn[~grid.present[tuple((drawn - first).T)]]
        both = np.concatenate([drawn, lone])
        return pa.table({**{a: both[:, i] for i, a in enumerate(AXES)}, "_lone": np.arange(len(both)) >= len(drawn)})

    at = given(p, AXES).select(*[(F.col(a).cast("long") - F.lit(int(v))).alias(a) for a, v in zip(AXES, low)])
    keys = [f"_b{a}" for a in AXES]
    wide = at
    for a, b in zip(AXES, keys):
        wide = wide.withColumn(b, F.explode(F.sequence(*[F.floor(c / BLOCK) for c in (F.greatest(F.col(a) - SEEN, F.lit(0)), F.least(F.col(a) + SEEN, F.lit(bounds[a] - 1)))])))
    return shared_out(spread(wide), 2 * p.count(), *keys).groupBy(*keys).applyInArrow(lines, "z long, y long, x long, _lone boolean")
