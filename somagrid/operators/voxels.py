"""Voxel tables: objects, masks, morphology, maps, thresholds.

A volume is a table with one row per voxel that matters (``z, y, x`` and
values); missing rows are background.  A neighbourhood is a fixed list of
steps set by the radius, never by the data.
"""

from __future__ import annotations

import functools
import json
import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from somagrid.operators.blocks import BLOCK, Grid, ball_sums, ball_total, boundaries, dealt, degree, dilate, erode, peaks, smooth, thin  # noqa: F401 - part of this module's functions
from somagrid.operators.components import label_components
from somagrid.operators.distance import distance_map  # noqa: F401
from somagrid.operators.flood import flood
from somagrid.operators.meet import close, meet, positions
from somagrid.operators.ordered import join_ranks, value_ranks
from somagrid.operators.regions import SPAN, packed
from somagrid.session import cut, shared_out, spread

AXES = ["z", "y", "x"]
WHOLE = {"tinyint", "smallint", "int", "bigint"}


STEPS = "array<struct<z:bigint,y:bigint,x:bigint>>"


def steps_array(steps) -> Column:
    """Fixed steps as one literal (folded once, however many there are)."""
    return F.from_json(F.lit(json.dumps([dict(zip(AXES, map(int, s))) for s in steps])), STEPS)


def send(df: DataFrame, steps, cols: list = ()) -> DataFrame:
    """One row per step: ``df`` rows moved by each step, with ``cols`` alongside."""
    moved = df.withColumn("_o", F.explode(steps_array(steps)))
    return spread(moved.select(*[(F.col(a) + F.col(f"_o.{a}")).alias(a) for a in AXES], *cols))


def footprint(shape: str, r: int) -> list[tuple[int, int, int]]:
    """Steps of a ball, of a disk in the slice, or of a cube of edge 2r+1."""
    rng = range(-r, r + 1)
    every = [(a, b, c) for a in rng for b in rng for c in rng]
    if shape == "ball":
        return [o for o in every if sum(v * v for v in o) <= r * r]
    if shape == "disk":
        return [o for o in every if o[0] == 0 and sum(v * v for v in o) <= r * r]
    if shape == "cube":
        return every
    raise ValueError(shape)


def inside(df: DataFrame, shape: dict | None) -> DataFrame:
    if not shape:
        return df
    return df.filter(functools.reduce(operator.and_, [F.col(a).between(0, n - 1) for a, n in shape.items()]))


# --------------------------------------------------------------- objects
def object_props(voxels: DataFrame, label: str = "label", by=()) -> DataFrame:
    """Volume, centroid and half-open bounding box per label (of each brain, with ``by``).  The voxel list of
    an object stays the labelled voxel table itself, so a huge object is never
    gathered into one row."""
    return voxels.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("volume"), *[F.avg(a).alias(f"c{a}") for a in AXES],
        *[F.min(a).alias(f"{a}0") for a in AXES], *[(F.max(a) + 1).alias(f"{a}1") for a in AXES],
    )


def inner_volume(objs: DataFrame, mask: DataFrame, label: str = "label") -> DataFrame:
    """Mask voxels inside each object, 0 where there are none."""
    m = mask.select(*AXES).distinct().withColumn("_in", F.lit(True))
    return objs.join(m, AXES, "left").groupBy(label).agg(F.count("_in").alias("core_vols"), F.count(F.lit(1)).alias("volume"))


def object_intensity(objs: DataFrame, voxels: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """Mean intensity over the voxels of each object."""
    return objs.select(*AXES, label).join(voxels.select(*AXES, value), AXES).groupBy(label).agg(F.avg(value).alias("mean_intensity"))


def elongation(voxels: DataFrame, label: str = "label", big: int = 300, small: int = 100, ratio: float = 5.0) -> DataFrame:
    """Axis lengths per object from second central moments, and ``keep``: over
    ``big`` voxels, or between the limits with a major/minor ratio over ``ratio``."""
    v = {a: F.col(a).cast("double") for a in AXES}
    cov = {(a, b): F.covar_pop(v[a], v[b]).alias(f"_{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]}
    m = voxels.groupBy(label).agg(F.count(F.lit(1)).alias("volume"), *cov.values())
    a, b, c, d, e, f = (F.col(n) for n in ("_zz", "_yy", "_xx", "_zy", "_yx", "_zx"))
    # closed-form eigenvalues of the symmetric 3x3 covariance
    q = (a + b + c) / 3.0
    p2 = (a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2.0 * (d * d + e * e + f * f)
    p = F.sqrt(p2 / 6.0)
    det = (a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(det, 2.0 * p * p * p)))
    phi = F.acos(F.coalesce(r, F.lit(0.0))) / 3.0
    top = q + 2.0 * p * F.cos(phi)
    low = q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)
    length = lambda x: 4.0 * F.sqrt(F.greatest(x, F.lit(0.0)))
    m = m.select(label, "volume", length(top).alias("major"), length(F.when(F.abs(low) < 1e-9, 0.0).otherwise(low)).alias("minor"))
    long = F.coalesce(F.try_divide("major", "minor") > ratio, F.lit(False))
    return m.withColumn("keep", (F.col("volume") > big) | ((F.col("volume") > small) & (F.col("volume") < big) & long))


def largest_component(parts: DataFrame, label: str = "label", limit: int = 30, connectivity: int = 6) -> DataFrame:
    """Voxels of each object with ``keep``: the largest piece (first one on ties)
    when it has more than ``limit`` voxels, or the only piece; the rest is to be
    assigned again."""
    lab = cut(label_components(parts.select(*AXES, label), connectivity, label))
    size = lab.groupBy(label, "component").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy(label).agg(
        F.max(F.struct(F.col("n"), (-F.col("component")).alias("c"))).alias("b"), F.count(F.lit(1)).alias("_pieces")
    )
    j = shared_out(lab, lab.count(), label).join(best, label)
    main = (F.col("component") == -F.col("b.c")) & ((F.col("b.n") > limit) | (F.col("_pieces") == 1))
    return j.select(*AXES, label, "component", main.alias("keep"))


def assign_stragglers(frag: DataFrame, lab: DataFrame, frag_id: str = "frag", label: str = "label", shape: dict | None = None) -> DataFrame:
    """Fragment to the label met most often in its 1-voxel surroundings (smaller
    label on ties), all fragments at once.  Positions over the edge count as the
    edge voxel when a shape is given."""
    found = lab.filter(F.col(label) != 0).select(*AXES, label)
    kind = {**dict(found.dtypes), **dict(frag.select(*AXES, frag_id).dtypes)}
    if shape or any(dict(t.dtypes)[a] not in WHOLE for t in (frag, lab) for a in AXES):
        around = send(frag, footprint("cube", 1), [frag_id])
        if shape:
            around = around.select(frag_id, *[F.greatest(F.lit(0), F.least(F.col(a), F.lit(n - 1))).alias(a) for a, n in shape.items()])
        n = around.groupBy(frag_id, *AXES).agg(F.count(F.lit(1)).alias("_n"))
        met = n.join(found, AXES).select(frag_id, label, "_n")
    else:  # voxels meet in tiles, and what is written is a row per fragment and label there
        def count(q: pa.Table, p: pa.Table) -> pa.Table:
            x, y = positions(q), positions(p)
            frags, labels = pc.unique(q.column("_f")), pc.unique(p.column("_l"))
            of, to = pc.index_in(q.column("_f"), frags).to_numpy(), pc.index_in(p.column("_l"), labels).to_numpy()
            codes, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in close(x, y, 1.0):
                ok = (np.abs(x[i] - y[j]) <= 1).all(axis=1)
                c, m = np.unique(of[i[ok]].astype(np.int64) * len(labels) + to[j[ok]], return_counts=True)
                codes.append(c)
                many.append(m)
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(at, np.concatenate(many), len(code)).astype(np.int64)
            wide = max(1, len(labels))
            return pa.table({"_f": frags.take(pa.array(code // wide)), "_l": labels.take(pa.array(code % wide)), "_n": pa.array(total)})

        met = meet(frag.select(*AXES, F.col(frag_id).alias("_f")), found.select(*AXES, F.col(label).alias("_l")), dict.fromkeys(AXES, 1.0), count,
                   f"_f {kind[frag_id]}, _l {kind[label]}, _n long", edge=dict.fromkeys(AXES, 32.0)).select(F.col("_f").alias(frag_id), F.col("_l").alias(label), "_n")
    hit = met.groupBy(frag_id, label).agg(F.sum("_n").alias("n"))
    best = hit.groupBy(frag_id).agg(F.max(F.struct(F.col("n"), (-F.col(label)).alias("l"))).alias("b"))
    return best.select(frag_id, (-F.col("b.l")).alias(label), F.col("b.n").alias("n"))


def by_size(voxels: DataFrame, label: str) -> DataFrame:
    """Voxels with the size of their label, through a small per-label table."""
    n = voxels.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    return voxels.join(n, label)


def remove_small(voxels: DataFrame, n: int, label: str | None = None, connectivity: int = 6) -> DataFrame:
    """Drop objects under ``n`` voxels; without a label, objects are components."""
    if label:
        return by_size(voxels, label).filter(F.col("size") >= n).drop("size")
    lab = cut(label_components(voxels.select(*AXES), connectivity))
    keep = by_size(lab, "component").filter(F.col("size") >= n).select(*AXES)
    return voxels.join(keep, AXES, "left_semi")


def clear_border(voxels: DataFrame, shape: dict, extra_z: int = 1, extra_xy: int = 3, skip_top: bool = False, label: str | None = None) -> DataFrame:
    """Drop objects that come near the edge of the volume."""
    lab = voxels if label else cut(label_components(voxels.select(*AXES), 26))
    key = label or "component"
    z = F.col("z") >= shape["z"] - extra_z
    edge = z if skip_top else z | (F.col("z") <= extra_z)
    for a in ("y", "x"):
        edge = edge | (F.col(a) <= extra_xy) | (F.col(a) >= shape[a] - extra_xy)
    bad = lab.groupBy(key).agg(F.bool_or(edge).alias("_e")).filter("_e").select(key)
    return lab.join(bad, key, "left_anti")


def trim_edges(voxels: DataFrame, shape: dict, n: int = 1) -> DataFrame:
    """Drop voxels within ``n`` of the volume edge."""
    return voxels.filter(functools.reduce(operator.and_, [F.col(a).between(n, s - 1 - n) for a, s in shape.items()]))


def drop_thin(voxels: DataFrame, limit: int = 10, label: str = "label") -> DataFrame:
    """Drop the slices of an object with fewer than ``limit`` voxels."""
    n = voxels.groupBy(label, "z").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= limit).drop("_n")
    return voxels.join(n, [label, "z"], "left_semi")


def min_span(voxels: DataFrame, slices: int = 5, label: str = "label") -> DataFrame:
    """Objects that span at least ``slices`` slices."""
    return voxels.groupBy(label).agg((F.max("z") - F.min("z") + 1).alias("span")).filter(F.col("span") >= slices)


def renumber(objects: DataFrame, tile: list[str], label: str = "label", out: str = "number") -> DataFrame:
    """Dense numbers of the surviving labels within a tile, from 1.

    Numbers are running counts over the distinct labels, so one tile (or none)
    may hold any number of labels."""
    names = value_ranks(objects.select(*tile, label).distinct(), tile, label)
    return join_ranks(objects, names.withColumn(out, F.col("before") + 1), tile, label, [out])


# ------------------------------------------------------------ morphology
def local_maxima(field: DataFrame, value: str = "distance", min_distance: int = 3) -> DataFrame:
    """Voxels not below any of their 26 neighbours, thinned so that no two stay
    within ``min_distance``: larger value first, then a hash of the position, so
    that plateaus settle in few rounds."""
    return thin(peaks(field, value), value, min_distance)


def seeded_split(mask: DataFrame, seeds: DataFrame, label: str = "label", connectivity: int = 6, leftover: int | None = 1000, height: str | None = None) -> DataFrame:
    """Mask voxels to the seed whose flood reaches them (:func:`flood`, by steps or by
    a column of heights, such as the inverted distance); pieces no seed reaches become
    new objects when they have more than ``leftover`` voxels."""
    done = flood(mask, seeds, label, connectivity, height)
    if leftover is None:
        return done
    done = cut(done)
    left = mask.select(*AXES).distinct().join(done, AXES, "left_anti")
    top = done.agg(F.coalesce(F.max(label), F.lit(0))).scalar()
    rest = cut(by_size(label_components(left, 26), "component").filter(F.col("size") > leftover).select(*AXES, "component"))
    new = renumber(rest, [], "component", "_n").select(*AXES, (F.col("_n") + top).cast(done.schema[label].dataType).alias(label))
    return done.unionByName(new)


def match_cores(halo: DataFrame, core: DataFrame, label: str = "label") -> DataFrame:
    """Core and halo voxels by status: ``core`` with the label of its halo,
    ``unmatched core``, ``halo`` without core."""
    c = core.select(*AXES).distinct().withColumn("_core", F.lit(True))
    j = halo.select(*AXES, label).join(c, AXES, "full_outer")
    status = F.when(F.col("_core") & F.col(label).isNotNull(), "core").when(F.col("_core"), "unmatched core").otherwise("halo")
    return j.select(*AXES, label, status.alias("status"))


def voxel_degree(voxels: DataFrame) -> DataFrame:
    """26-neighbour count of each skeleton voxel and its class."""
    kind = F.when(F.col("degree") == 0, "single").when(F.col("degree") == 1, "end").when(F.col("degree") == 2, "path").otherwise("branch")
    return degree(voxels).withColumn("kind", kind)


def apply_corrections(labels: DataFrame, codes: DataFrame, min_size: int = 10, label: str = "label") -> DataFrame:
    """Manual corrections from a code volume.

    Codes 1 and 6 clear voxels from labels; objects touching 2 or 3 and those
    under ``min_size`` are dropped; pieces of 2, 3 and 6 become objects; a piece
    of 4 joins the object marked 4 it shares most voxels with; a piece of 7
    merges all objects it touches into the one numbered last.  Objects are
    numbered in the order plain, 2, 3, 6, marked 4; where two overlap, the later
    number stands.
    """
    code = cut(codes.select(*AXES, F.col("code")))
    base = labels.select(*AXES, label).join(code.filter(F.col("code").isin(1, 6)), AXES, "left_anti")
    tagged = base.join(code, AXES, "left")
    per = tagged.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("code").isin(2, 3), F.lit(False))).alias("_drop"),
        F.bool_or(F.coalesce(F.col("code") == 4, F.lit(False))).alias("_four"),
    ).filter(~F.col("_drop") & (F.col("n") >= min_size))
    alive = cut(base.join(per.select(label, "_four"), label))
    parts = [alive.filter("NOT _four").select(*AXES, F.lit(0).alias("_rank"), F.col(label).alias("_key"))]
    for rank, c in ((1, 2), (2, 3), (3, 6)):
        p = label_components(code.filter(F.col("code") == c).select(*AXES), 6)
        parts.append(p.select(*AXES, F.lit(rank).alias("_rank"), F.col("component").alias("_key")))
    four = alive.filter("_four").select(*AXES, label)
    p4 = cut(label_components(code.filter(F.col("code") == 4).select(*AXES), 6))
    share = p4.join(four, AXES).groupBy("component", label).agg(F.count(F.lit(1)).alias("n"))
    owner = share.groupBy("component").agg(F.max(F.struct(F.col("n"), (-F.col(label)).alias("l"))).alias("b")).select(
        "component", (-F.col("b.l")).alias(label))
    grown = four.unionByName(p4.join(owner, "component").select(*AXES, label)).distinct()
    parts.append(grown.select(*AXES, F.lit(4).alias("_rank"), F.col(label).alias("_key")))
    every = functools.reduce(DataFrame.unionByName, parts)
    # later objects overwrite earlier ones
    won = cut(every.groupBy(*AXES).agg(F.max(F.struct("_rank", "_key")).alias("_o")))
    p7 = label_components(code.filter(F.col("code") == 7).select(*AXES), 6)
    touch = cut(p7.join(won, AXES).select("component", "_o").distinct())
    ids = value_ranks(won.select("_o").distinct(), [], "_o").select("_o", (F.col("before") + 1).alias("_num"))
    merged = merge_groups(touch.join(ids, "_o").select("component", "_num"), "component", "_num")
    final = ids.join(merged, "_num", "left").select("_o", F.coalesce("_to", "_num").alias("_num"))
    return won.join(final, "_o").select(*AXES, F.col("_num").alias(label))


def merge_groups(touch: DataFrame, group: str, item: str) -> DataFrame:
    """Items that share a group, directly or through others, to the largest item:
    (item, _to)."""
    from somagrid.operators.components import connected

    low = touch.groupBy(group).agg(F.min(item).alias("dst"))
    edges = touch.join(low, group).select(F.col(item).alias("src"), "dst")
    nodes = touch.select(F.col(item).alias("id")).distinct()
    comp = cut(connected(edges, nodes))
    top = comp.groupBy("component").agg(F.max("id").alias("_to"))
    return comp.join(top, "component").select(F.col("id").alias(item), "_to")


# ------------------------------------------------------------------ maps
def density_map(cells: DataFrame, atlas: DataFrame, radius: int = 5, res_um: float = 20.0, shape: dict | None = None, by=(), cols=()) -> DataFrame:
    """Cells per mm3 around each atlas voxel: every cell adds 1 to all voxels within
    ``radius``, over the volume of the surrounding cube.

    Cells are counted per voxel first, and the counts are summed in blocks, so
    crowded voxels cost one row.  With a shape, positions past the far side fall
    on its last voxel (once per cell); positions below 0 are dropped.  For a cell
    inside the shape the last voxel is then reached only if it is in the plain
    ball, so only cells beyond the far side go through single steps.  With ``by``
    (``["dataset"]``) every brain has its own map, over its own atlas.  With
    ``cols`` every row of the atlas has its density, beside these columns of it.

    The atlas comes to the blocks as runs of equal voxels, so no voxel of map or
    atlas is a row before the densities are known.
    """
    by, cols = list(by), list(cols)
    n = cells.groupBy(*by, *AXES).agg(F.count(F.lit(1)).alias("_n"))
    ball = footprint("ball", radius)
    kind = {**dict(atlas.dtypes), **{c: k for c, k in n.dtypes if c in (*by, *AXES)}}
    names = [f"_b{a}" for a in AXES]
    counts = dealt(n, (radius,) * 3, BLOCK, shape).withColumn("_far", F.lit(False))
    runs = packed(atlas.filter("label > 0"), cols, by)
    if shape:
        far = functools.reduce(operator.or_, [F.col(a) > s - 1 for a, s in shape.items()])
        capped = n.filter(far).withColumn("_o", F.explode(steps_array(ball))).select(
            *by, F.struct(*AXES).alias("_c"), *[F.least(F.col(a) + F.col(f"_o.{a}"), F.lit(shape[a] - 1)).cast(kind[a]).alias(a) for a in AXES], "_n"
        ).distinct().filter(functools.reduce(operator.and_, [F.col(a) >= 0 for a in AXES])).select(*by, *AXES, "_n")
        counts = dealt(n.filter(~far), (radius,) * 3, BLOCK, shape).withColumn("_far", F.lit(False)).unionByName(dealt(capped, (0, 0, 0), BLOCK).withColumn("_far", F.lit(True)))
        runs = runs.filter(functools.reduce(operator.and_, [F.col(a).between(0, shape[a] - 1) for a in ("z", "y")]) & (F.col("_to") >= 0) & (F.col("_from") < shape["x"]))
    runs = runs.select(*by, F.floor(F.col("z") / BLOCK).alias("_bz"), F.floor(F.col("y") / BLOCK).alias("_by"), F.floor(F.col("_span") * SPAN / BLOCK).alias("_bx"), "z", "y", "_from", "_to", *cols)
    scale = 1.0 / (radius * res_um * 0.001 * 2) ** 3
    schema = ", ".join([f"{b} {kind[b]}" for b in by] + ["z long, y long, x long"] + [f"{c} {kind[c]}" for c in cols] + ["density double"])
    none = runs.select(*by, "z", "y", F.col("_from").alias("x"), *cols).limit(0).toArrow()

    def add(key, q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return none.append_column("density", pa.array([], pa.float64()))
        low = [k.as_py() * BLOCK for k in key[len(by):]]
        plain = q.column("_far").to_numpy(zero_copy_only=False).astype(bool)
        grid = Grid(q.filter(pa.array(~plain)), low, BLOCK, (radius,) * 3, ["_n"])
        total = ball_total(grid.values["_n"], radius)
        extra = q.filter(pa.array(plain))
        np.add.at(total, tuple(extra.column(a).to_numpy() - s for a, s in zip(AXES, low)), extra.column("_n").to_numpy())
        first = r.column("_from").to_numpy()
        many = r.column("_to").to_numpy() - first + 1
        row = np.repeat(np.arange(r.num_rows), many)
        at = [r.column("z").to_numpy()[row] - low[0], r.column("y").to_numpy()[row] - low[1],
              first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) - low[2]]
        if cols:
            keep = total[tuple(at)] != 0
            row, at = row[keep], [v[keep] for v in at]
        else:  # each voxel once
            held = np.zeros(total.shape, bool)
            held[tuple(at)] = True
            at = np.nonzero(held & (total != 0))
        seen = r.select(cols).take(pa.array(row)) if cols else None
        return pa.table({**{b: pa.repeat(k, len(at[0])) for b, k in zip(by, key)}, **{a: v + s for a, v, s in zip(AXES, at, low)},
                         **{c: seen.column(c) for c in cols}, "density": total[tuple(at)] * scale})

    keys = [*by, *names]
    out = counts.groupBy(*keys).cogroup(runs.groupBy(*keys)).applyInArrow(add, schema)
    if shape:
        out = out.filter(F.col("x").between(0, shape["x"] - 1))
    return out.select(*by, *[F.col(a).cast(kind[a]).alias(a) for a in AXES], *cols, "density")


def mean_map(maps: DataFrame, mask: DataFrame, n_brains: int, value: str = "density", fill: float = 1.0) -> DataFrame:
    """Voxel-wise mean over brains (absent = 0); mask voxels no map covers get ``fill``."""
    m = maps.groupBy(*AXES).agg((F.sum(value) / F.lit(float(n_brains))).alias(value))
    return mask.select(*AXES).distinct().join(m, AXES, "left").withColumn(value, F.coalesce(F.when(F.col(value) != 0, F.col(value)), F.lit(fill)))


def project(voxels: DataFrame, axis: str = "z", kind: str = "max", value: str = "value") -> DataFrame:
    agg = {"max": F.max, "mean": F.avg}[kind]
    return voxels.groupBy(*[a for a in AXES if a != axis]).agg(agg(value).alias(value))


def mid_slice(atlas: DataFrame, ids: DataFrame, axis: str = "z") -> DataFrame:
    """Middle slice of a region set and its bounding box in that slice."""
    reg = atlas.join(ids.select(F.col("ids").alias("label")).distinct(), "label", "left_semi")
    mid = reg.agg(F.floor(F.avg(axis))).scalar()
    others = [a for a in AXES if a != axis]
    return reg.filter(F.col(axis) == mid).agg(
        F.first(axis).alias("slice"), *[F.min(a).alias(f"{a}_min") for a in others], *[F.max(a).alias(f"{a}_max") for a in others]
    )


def region_mask(atlas: DataFrame, ids: DataFrame, how: str = "keep") -> DataFrame:
    """Atlas voxels of a set of regions, or all the others."""
    want = ids.select(F.col("ids").alias("label")).distinct()
    return atlas.filter("label > 0").join(want, "label", "left_semi" if how == "keep" else "left_anti")


def visit_count(tiles: DataFrame, objects: DataFrame, often: int = 2, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Visits per voxel over overlapping tiles, and per object the highest count
    with ``seen_often`` (over ``often``)."""
    n = tiles.groupBy(*AXES).agg(F.count(F.lit(1)).alias("visits"))
    top = objects.join(n, AXES).groupBy(label).agg(F.max("visits").alias("level"))
    return n, top.withColumn("seen_often", F.col("level") > often)


def merge_blocks(parts: DataFrame) -> DataFrame:
    """Block sums to one row per region: mean of the non-zero values, intensity
    density free of cell bodies, share of voxels with a value."""
    s = parts.groupBy("region").agg(*[F.sum(c).alias(c) for c in ("reg_voxels", "cell_body_voxels", "sum_int", "num_vals")])
    return s.select(
        "region", F.try_divide("sum_int", "num_vals").alias("mean_intensity"),
        F.try_divide(F.col("sum_int"), F.col("reg_voxels") - F.col("cell_body_voxels")).alias("scaled_intden"),
        F.try_divide(F.col("num_vals").cast("double"), F.col("reg_voxels")).alias("mean_volume"),
    )


def block_parts(atlas: DataFrame, masked: DataFrame, bodies: DataFrame, block: int = 16) -> DataFrame:
    """Per (block, region): voxels, cell-body voxels, sum and number of non-zero values."""
    b = bodies.select(*AXES).distinct().withColumn("_body", F.lit(True))
    j = atlas.filter("label > 0").join(masked.select(*AXES, "value"), AXES, "left").join(b, AXES, "left")
    v = F.when(F.col("value") != 0, F.col("value"))
    return j.groupBy(F.expr(f"z div {block}").alias("block"), F.col("label").alias("region")).agg(
        F.count(F.lit(1)).alias("reg_voxels"), F.count("_body").alias("cell_body_voxels"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum_int"), F.count(v).alias("num_vals"),
    )


def dataset_moments(voxels: DataFrame, value: str = "value") -> DataFrame:
    return voxels.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def histogram(voxels: DataFrame, bins: int = 256, value: str = "value") -> DataFrame:
    """Equal-width histogram between the extremes: (bin, centre, n), empty bins left out."""
    e = voxels.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    v = voxels.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), e.alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("e.lo"), width)), F.lit(0)), F.lit(bins - 1))
    h = v.groupBy(b.alias("bin"), "e").agg(F.count(F.lit(1)).alias("n"))
    return h.select("bin", (F.col("e.lo") + (F.col("bin") + 0.5) * width).alias("centre"), "n")


def hist_threshold(voxels: DataFrame, method: str = "otsu", bins: int = 256, value: str = "value") -> DataFrame:
    """One-row threshold from the histogram (at most ``bins`` rows past the aggregate)."""
    h = histogram(voxels, bins, value)
    w = W.orderBy("bin")
    if method == "otsu":
        up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
        m = F.col("n") * F.col("centre")
        c = h.withColumn("w1", F.sum("n").over(up)).withColumn("w2", F.sum("n").over(down))
        c = c.withColumn("s1", F.sum(m).over(up)).withColumn("s2", F.sum(m).over(down)).filter("w2 IS NOT NULL")
        gap = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
        # rounded, so that the first of equal splits is taken
        between = F.round(F.col("w1") * 1.0 * F.col("w2") * gap * gap, 6)
        return c.agg(F.min_by("centre", F.struct((-between).alias("b"), "bin")).alias("threshold"))
    if method == "triangle":
        full = F.array_sort(F.collect_list(F.struct("bin", "n", "centre")))
        t = h.agg(full.alias("h"), F.max(F.struct(F.col("n"), (-F.col("bin")).alias("b"))).alias("p"))
        t = t.select("h", F.col("p.n").alias("pn"), (-F.col("p.b")).alias("pb"), F.col("h")[0]["bin"].alias("lo"),
                     F.element_at("h", -1)["bin"].alias("hi"))
        flip = (F.col("pb") - F.col("lo")) < (F.col("hi") - F.col("pb"))
        t = t.withColumn("flip", flip).withColumn("far", F.when(flip, F.col("hi")).otherwise(F.col("lo")))
        t = t.withColumn("e0", F.col("h")[0]).withColumn("e1", F.element_at("h", -1)).withColumn(
            "m", F.map_from_entries(F.transform("h", lambda q: F.struct(q["bin"], q["n"]))))
        step = F.coalesce(F.try_divide(F.col("e1.centre") - F.col("e0.centre"), F.col("e1.bin") - F.col("e0.bin")), F.lit(0.0))
        first, last = F.least("far", "pb"), F.greatest("far", "pb")
        x = t.withColumn("bin", F.explode(F.sequence(first, last))).filter((F.col("bin") != F.col("pb")) | (F.col("far") == F.col("pb")))
        run = F.greatest(F.abs(F.col("far") - F.col("pb")).cast("double"), F.lit(1.0))
        away = F.abs(F.col("bin") - F.col("far"))
        d = F.col("pn") * away / run - F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0))
        centre = F.col("e0.centre") + step * (F.col("bin") - F.col("e0.bin"))
        return x.agg(F.max_by(centre, F.struct(F.round(d, 6).alias("d"), (-away).alias("b"))).alias("threshold"))
    raise ValueError(method)


def tissue_mask(voxels: DataFrame, threshold: Column | float | None = None, value: str = "value") -> DataFrame:
    """Largest component above the triangle threshold of the middle slice (+5,
    over 200 taken as 100), or above a given threshold."""
    if threshold is None:
        mid = voxels.agg(F.expr("(max(z) + 1) div 2")).scalar()
        t = hist_threshold(voxels.filter(F.col("z") == mid), "triangle", value=value).select(F.col("threshold") + 5)
        t = t.select(F.when(F.col("(threshold + 5)") > 200, 100.0).otherwise(F.col("(threshold + 5)"))).scalar()
    else:
        t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    lab = cut(label_components(voxels.filter(F.col(value) > t).select(*AXES), 26))
    best = lab.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct(F.col("n"), (-F.col("component")).alias("c")))).scalar()
    return lab.filter(F.col("component") == -best["c"]).select(*AXES)


def slab_snr(voxels: DataFrame, depth: int = 33, value: str = "value", threshold: float | None = None, intensities: bool = False) -> DataFrame:
    """Signal-to-noise in dB of the max projection of each slab.

    As the source has it, signal is the mean of the row and column positions
    above the threshold and noise the deviation of those below;
    ``intensities`` uses the values instead.
    """
    t = F.lit(threshold) if threshold is not None else hist_threshold(voxels, "otsu", value=value).scalar()
    p = voxels.groupBy(F.expr(f"z div {depth}").alias("slab"), "y", "x").agg(F.max(value).alias("v"))
    what = F.array("v") if intensities else F.array(F.col("y").cast("double"), F.col("x").cast("double"))
    e = p.withColumn("_t", t).select("slab", "v", "_t", F.explode(what).alias("w"))
    a = e.groupBy("slab").agg(
        F.avg(F.when(F.col("v") > F.col("_t"), F.col("w"))).alias("signal"),
        F.stddev_pop(F.when(F.col("v") < F.col("_t"), F.col("w"))).alias("noise"),
    )
    r = F.try_divide("signal", "noise")
    return a.withColumn("snr_db", F.when(r > 0, 10.0 * F.log10(r)))


def divide_by_structure(a: DataFrame, b: DataFrame, threshold: float = 500, min_size: int = 100, value: str = "value") -> DataFrame:
    """``b`` over the bright structure of ``a``: voxels over the threshold in pieces
    of at least ``min_size``, scaled to their largest value and raised by 2;
    ``b`` is unchanged elsewhere.  Truncated to whole numbers."""
    bright = cut(remove_small(a.filter(F.col(value) > threshold), min_size).select(*AXES, F.col(value).alias("_s")))
    top = bright.agg(F.max("_s")).scalar()
    j = b.join(bright.select(*AXES, (F.col("_s") / top + 2.0).alias("_w")), AXES, "left")
    return j.select(*AXES, F.floor(F.col(value) / F.coalesce("_w", F.lit(1.0))).cast("bigint").alias("divided"))


def resize_labels(voxels: DataFrame, shape: dict, new: dict, label: str = "label") -> DataFrame:
    """Nearest-neighbour resize: target voxel i reads source floor((i + 0.5) * old/new).

    Each source voxel is sent to the targets that read it, so no join is needed."""
    d = voxels.filter(F.col(label) != 0)
    for a in AXES:
        s, n = shape[a], new[a]
        first, last = f"greatest(0L, {a} * {n} div {s} - 2)", f"least({n} - 1L, ({a} + 1) * {n} div {s} + 1)"
        d = d.withColumn(a, F.explode(F.expr(f"filter(sequence({first}, {last}), i -> (2 * i + 1) * {s} div {2 * n} = {a})")))
    return d


def pad_or_crop(voxels: DataFrame, shape: dict, pad: dict, fill=None, value: str = "value") -> DataFrame:
    """Shift by the padding before each axis and keep what lies in the new shape;
    negative padding crops.  With ``fill`` the padding voxels get rows too."""
    new = {a: shape[a] + pad[a][0] + pad[a][1] for a in AXES}
    moved = inside(voxels.select(*[(F.col(a) + pad[a][0]).alias(a) for a in AXES], *[c for c in voxels.columns if c not in AXES]), new)
    if fill is None:
        return moved
    one = voxels.sparkSession.range(new["z"]).withColumnRenamed("id", "z")
    for a in ("y", "x"):
        one = one.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(new[a] - 1)).cast("array<bigint>")))
    was = functools.reduce(operator.and_, [F.col(a).between(max(0, pad[a][0]), pad[a][0] + shape[a] - 1) for a in AXES])
    return moved.select(*AXES, value).unionByName(one.filter(~was).withColumn(value, F.lit(fill).cast(voxels.schema[value].dataType)))


def displacement_filter(voxels: DataFrame, label: str = "label", mean_limit: float = 15.0, max_limit: float = 15.0) -> DataFrame:
    """Objects whose slice centroids (truncated) move little from slice to slice:
    mean or largest step under its limit; one centroid or none drops the object."""
    from somagrid.operators.ordered import neighbour_row

    c = voxels.groupBy(label, "z").agg(F.floor(F.avg("y")).alias("cy"), F.floor(F.avg("x")).alias("cx"))
    n = neighbour_row(c, [label], "z", ["z", "cy", "cx"])
    sq = lambda p, q: (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
    step = F.sqrt((sq("z", "next_z") + sq("cy", "next_cy") + sq("cx", "next_cx")).cast("double"))
    a = n.groupBy(label).agg(F.avg(step).alias("mean_step"), F.max(step).alias("max_step"), F.count(F.lit(1)).alias("n"))
    return a.filter("n > 1").withColumn("keep", (F.col("mean_step") < mean_limit) | (F.col("max_step") < max_limit))
