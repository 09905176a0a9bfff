"""Neighbour joins on a grid of buckets.

Points are reduced to distinct positions before any bucket join, so a bucket
of edge ``e`` holds at most ``e**3`` voxel positions however many cells share
them; a crowded place costs one row, not one row per cell.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from somagrid.operators.meet import close, meet, positions
from somagrid.operators.nearest import PAIRS, _closest, knn
from somagrid.operators.regions import SPAN, packed
from somagrid.session import cut, release, spread

AXES = ["z", "y", "x"]


def dist2(a: str, b: str, axes=AXES, scale: dict | None = None) -> Column:
    """Squared distance between positions of two aliased tables."""
    s = scale or {}
    return functools.reduce(
        operator.add,
        [((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")).cast("double") * s.get(c, 1.0)) * ((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")).cast("double") * s.get(c, 1.0)) for c in axes],
    )


def _buckets(df: DataFrame, edge: float, axes=AXES, ring: int = 0) -> DataFrame:
    """Bucket columns ``_b*``; with a ring, one row per bucket within it."""
    for a in axes:
        b = F.floor(F.col(a) / F.lit(float(edge)))
        if ring:
            b = F.explode(F.sequence(b - ring, b + ring))
        df = df.withColumn(f"_b{a}", b)
    return spread(df) if ring else df


def bucket_join(a: DataFrame, b: DataFrame, radius: float, axes=AXES, scale: dict | None = None, by=()) -> DataFrame:
    """Pairs of positions within ``radius`` (and of equal ``by`` columns): left columns as ``a.*``, right as ``b.*``.

    ``a`` (the smaller side) is sent to the 27 buckets around it, ``b`` to one.
    """
    keys = [*by, *[f"_b{x}" for x in axes]]
    edge = radius * (1 + 1e-9)
    la, rb = _buckets(a, edge, axes, 1).alias("a"), _buckets(b, edge, axes).alias("b")
    on = functools.reduce(operator.and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return la.join(rb, on).withColumn("_d2", dist2("a", "b", axes, scale)).filter(F.col("_d2") <= float(radius) ** 2)


def radius_count(a: DataFrame, b: DataFrame, radius: float, out: str = "n_near", by=()) -> DataFrame:
    """Rows of ``a`` with the number of ``b`` points (of the same brain, with ``by``) within ``radius`` (0 when none)."""
    at = [*by, *AXES]
    pos = a.select(*at).distinct()
    pts = b.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))

    def count(q: pa.Table, p: pa.Table) -> pa.Table:
        x, y, n = positions(q), positions(p), p.column("_n").to_numpy()
        total = np.zeros(len(x), np.int64)
        for i, j in close(x, y, radius):
            d = x[i] - y[j]
            ok = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= float(radius) ** 2
            total += np.bincount(i[ok], weights=n[j[ok]], minlength=len(x)).astype(np.int64)
        return q.select(AXES).append_column("_near", pa.array(total))

    kind = dict(pos.dtypes)
    near = meet(pos, pts, dict.fromkeys(AXES, radius), count, ", ".join(f"{c} {kind[c]}" for c in AXES) + ", _near long", by)
    return a.join(near.withColumnRenamed("_near", out), at, "left").fillna(0, subset=[out])


def neighbour_contrast(large: DataFrame, cells: DataFrame, idc: str, value: str, k: int = 4, edge: float = 2.0) -> DataFrame:
    """Each large cell beside the mean of its ``k`` nearest cells; ``inverted``
    marks those below their neighbours."""
    near = knn(large, cells, k, idc, idc, edge, [value])
    m = near.groupBy(idc).agg(F.avg(value).alias("neighbour"), F.count(F.lit(1)).alias("n"))
    return large.select(idc, F.col(value).alias("large")).join(m, idc).withColumn("inverted", F.col("large") < F.col("neighbour"))


def warp_points(pts: DataFrame, field: DataFrame, res_mm: float = 0.02) -> DataFrame:
    """Positions in the atlas grid: deformation in mm at the rounded voxel, over
    the grid step, rounded half to even."""
    r = pts
    for a in AXES:
        r = r.withColumn(f"_{a}", F.bround(F.col(a).cast("double")).cast("bigint"))
    f = field.select(*[F.col(a).alias(f"_{a}") for a in AXES], "d0", "d1", "d2")
    step = 1.0 / res_mm
    j = r.join(f, [f"_{a}" for a in AXES])
    for i, a in enumerate(AXES):
        j = j.withColumn(f"{a}_atlas", F.bround(F.col(f"d{i}") * step).cast("bigint"))
    return j.drop(*[f"_{a}" for a in AXES], "d0", "d1", "d2")


def invert_field(field: DataFrame, atlas: DataFrame, res_mm: float = 0.02, tol_mm: float = 0.1, rounds: int = 3) -> DataFrame:
    """For each atlas voxel the source voxel mapped nearest to it within the
    tolerance (ties to the smaller position), else NULL.

    Voxels and the places that the field leads to meet in tiles, where the search
    widens up to the tolerance only for voxels not yet done, and one row per voxel
    is written.  ``rounds`` is of no effect any more.
    """
    place = [F.col(f"d{i}") for i in range(3)]
    src = field.groupBy("d0", "d1", "d2").agg(F.min(F.struct(*AXES)).alias("_s")).select(
        *[(d / F.lit(res_mm)).alias(a) for a, d in zip(AXES, place)], *place, *[F.col(f"_s.{a}").alias(f"_{a}") for a in AXES])
    todo = atlas.select(*AXES).distinct()
    kind, out = dict(todo.dtypes), dict(src.dtypes)
    names = [f"_{a}" for a in AXES]

    def near(q: pa.Table, p: pa.Table) -> pa.Table:
        at = np.full(q.num_rows, -1)
        if q.num_rows and p.num_rows:
            x, y = positions(q) * res_mm, np.stack([p.column(f"d{i}").to_numpy().astype(float) for i in range(3)], axis=1)
            rank = np.empty(p.num_rows, np.int64)
            rank[pc.sort_indices(p, [(n, "ascending") for n in names], null_placement="at_start").to_numpy()] = np.arange(p.num_rows)
            i, j, _ = _closest(x, y, rank, 1, tol_mm / 2, False, digits=12)
            at[i] = j
        found = p.select(names).take(pa.array(at, mask=at < 0))
        return pa.table({**{a: q.column(a) for a in AXES}, **{f"src{n}": found.column(n) for n in names}})

    schema = ", ".join([f"{a} {kind[a]}" for a in AXES] + [f"src{n} {out[n]}" for n in names])
    met = meet(todo, src, dict.fromkeys(AXES, tol_mm / res_mm), near, schema)
    lost = functools.reduce(operator.or_, [F.col(a).isNull() | F.isnan(F.col(a).cast("double")) for a in AXES])  # voxels without a position
    return met.unionByName(todo.filter(lost).select(*AXES, *[F.lit(None).cast(out[n]).alias(f"src{n}") for n in names]))


def control_intensity(objs: DataFrame, field: DataFrame, inverse: DataFrame, volumes: DataFrame, shape: dict, label: str = "label",
                      res_mm: float = 0.02) -> DataFrame:
    """Mean intensity of each object's voxel shape in every control brain.

    The corner of the object's box goes to the atlas by ``field``, from there to
    a control by ``inverse`` (``control, z, y, x, src_*``); the object's voxels
    move along.  A negative or unmapped corner gives -1, a box over the far side
    NULL.  Voxels of ``inverse`` that follow each other in a line and are moved alike travel as one run.
    """
    box = objs.groupBy(label).agg(*[F.min(a).alias(a) for a in AXES], *[(F.max(a) + 1 - F.min(a)).alias(f"_n{a}") for a in AXES])
    at = warp_points(box, field, res_mm)
    whole = {"tinyint", "smallint", "int", "bigint"}
    kind = dict(inverse.dtypes)
    names = inverse.select("control").distinct().agg(F.sort_array(F.collect_set("control"))).scalar()
    src = [f"src_{a}" for a in AXES]
    if all(kind[c] in whole for c in (*AXES, *src)):
        moves = inverse.select("control", *AXES, *[(F.col(f"src_{a}").cast("bigint") - F.col(a)).alias(f"_s{a}") for a in AXES])
        runs = packed(moves, [f"_s{a}" for a in AXES], ["control"]).alias("r")
        on = [F.col("c.z_atlas") == F.col("r.z"), F.col("c.y_atlas") == F.col("r.y"), F.floor(F.col("c.x_atlas") / SPAN) == F.col("r._span"), F.col("c.x_atlas").between(F.col("r._from"), F.col("r._to"))]
        hit = at.alias("c").join(runs, on).select("c.*", "r.control", *[(F.col(f"c.{a}_atlas") + F.col(f"r._s{a}")).cast(kind[f"src_{a}"]).alias(f"src_{a}") for a in AXES])
    else:
        hit = at.join(inverse.select("control", *[F.col(a).alias(f"{a}_atlas") for a in AXES], *src), [f"{a}_atlas" for a in AXES])
    at = box.select(label, F.explode(names).alias("control")).join(
        hit.select(label, "control", *src, *[(F.col(f"src_{a}") - F.col(a)).alias(f"_d{a}") for a in AXES],
                   *[(F.col(f"src_{a}") + F.col(f"_n{a}")).alias(f"_e{a}") for a in AXES]),
        [label, "control"], "left")
    neg = functools.reduce(operator.or_, [F.col(f"src_{a}").isNull() | (F.col(f"src_{a}") < 0) for a in AXES])
    over = functools.reduce(operator.or_, [F.col(f"_e{a}") > n for a, n in shape.items()])
    at = cut(at.withColumn("status", F.when(neg, "none").when(over, "over").otherwise("in")))
    moved = objs.select(*AXES, label).join(at.filter("status = 'in'"), label).select(
        label, "control", *[(F.col(a) + F.col(f"_d{a}")).alias(a) for a in AXES])
    mean = moved.join(volumes, ["control", *AXES]).groupBy(label, "control").agg(F.avg("value").alias("_v"))
    return at.select(label, "control", "status").join(mean, [label, "control"], "left").select(
        label, "control", F.when(F.col("status") == "none", -1.0).when(F.col("status") == "in", F.col("_v")).alias("value"))


def project_to_line(cells: DataFrame, line: DataFrame, idc: str, edge: float = 4.0) -> DataFrame:
    """Ordinal position of the nearest centreline point of each cell (ties to the
    first point)."""
    return _nearest(cells, line.groupBy(*AXES).agg(F.min("pos").alias("pos")), idc, edge)


def _nearest(cells: DataFrame, pts: DataFrame, idc: str, edge: float) -> DataFrame:
    """Nearest point (by distance, then ``pos``) of each cell."""
    return cells.join(nearest_point(cells.select(*AXES).distinct(), pts, edge), AXES).select(idc, "pos", "distance")


def nearest_point(q: DataFrame, pts: DataFrame, edge: float) -> DataFrame:
    """Nearest point of each distinct query position: ``z, y, x, pos, distance``."""
    p = pts.withColumn("_id", F.format_string("%020d", "pos"))
    q = q.withColumn("_id", F.concat_ws(",", F.lit("q"), *AXES))
    near = knn(q, p, 1, "_id", "_id", edge, ["pos"]).select("_id", "pos", "distance")
    return q.join(near, "_id").select(*AXES, "pos", "distance")


def landmark_error(a: DataFrame, b: DataFrame, um: float = 20.0) -> DataFrame:
    """Distance in micrometres between same-label landmarks of atlas and sample."""
    r = b.select("label", *[F.col(c).alias(f"_{c}") for c in AXES])
    d = functools.reduce(operator.add, [(F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in AXES])
    return a.join(r, "label").withColumn("error_um", F.sqrt(d.cast("double")) * um).drop("_z", "_y", "_x")


def flat_projection(voxels: DataFrame, lookup: DataFrame, kind: str = "max", value: str = "value") -> DataFrame:
    """Voxel values along their streamlines in a flat view, by maximum or mean."""
    agg = {"max": F.max, "avg": F.avg, "mean": F.avg}[kind]
    return voxels.join(lookup, AXES).groupBy("u", "v").agg(agg(value).alias(value))


def dbscan(points: DataFrame, eps: float, min_samples: int, idc: str, scale: dict | None = None) -> DataFrame:
    """Density clusters: core points have ``min_samples`` points within ``eps``
    (themselves counted), core points within ``eps`` share a cluster, border
    points take the smallest cluster near them, noise and points without a
    position get NULL.  A cluster is named by the smallest ``idc`` at its core
    positions.  ``scale`` multiplies axes before distances are taken.

    Work runs on distinct positions with counts, in cells whose diagonal is at
    most ``eps``: the core positions of a cell are one node, a cell of
    ``min_samples`` points is all core.  Positions meet in tiles, and a tile writes
    one link per node at most.
    """
    from somagrid.operators.components import connected

    for a, f in (scale or {}).items():
        points = points.withColumn(a, F.col(a) * F.lit(float(f)))
    place = functools.reduce(operator.and_, [F.col(a).isNotNull() for a in AXES])
    edge = float(eps) / math.sqrt(3) * (1 - 1e-9)
    cell = [f"_c{a}" for a in AXES]
    pos = points.filter(place).groupBy(*AXES).agg(F.count(F.lit(1)).alias("_n"), F.min(idc).alias("_id")).select(
        "*", *[F.floor(F.col(a) / F.lit(edge)).alias(c) for a, c in zip(AXES, cell)])
    every = cut(pos)
    full = every.groupBy(*cell).agg(F.sum("_n").alias("_full"), F.min("_id").alias("_node")).filter(F.col("_full") >= min_samples)
    pos = cut(every.join(full, cell, "left"))
    release(every)
    sparse = pos.filter("_full IS NULL")
    reach, tile = dict.fromkeys(AXES, eps), dict.fromkeys(AXES, 4.0 * eps)
    name = dict(pos.dtypes)["_id"]

    def within(q: pa.Table, p: pa.Table):
        """Row numbers of the pairs within ``eps``, in parts."""
        x, y = positions(q), positions(p)
        for i, j in close(x, y, eps):
            d = x[i] - y[j]
            ok = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= float(eps) ** 2
            yield i[ok], j[ok]

    def count(q: pa.Table, p: pa.Table) -> pa.Table:
        total = np.zeros(q.num_rows, np.int64)
        for i, j in within(q, p):
            total += np.bincount(i, weights=p.column("_n").to_numpy()[j], minlength=len(total)).astype(np.int64)
        return q.select(["_id"]).append_column("_m", pa.array(total))

    near = meet(sparse.select(*AXES, "_id"), pos.select(*AXES, "_n"), reach, count, f"_id {name}, _m long", edge=tile, few=True).groupBy("_id").agg(F.sum("_m").alias("_m"))
    lone = near.filter(F.col("_m") >= min_samples).select("_id")
    place = [*AXES, *cell, "_id", "_node"]
    some = cut(sparse.drop("_node").join(lone, "_id", "left_semi").select(*AXES, *cell, "_id"))
    lone = some.join(some.groupBy(*cell).agg(F.min("_id").alias("_node")), cell).select(*place)
    core = cut(pos.filter("_full IS NOT NULL").select(*place).unionByName(lone))
    release(some)
    nodes = core.filter("_node IS NOT NULL").select(*AXES, *cell, "_node")
    links = meet(nodes, nodes, reach, functools.partial(_node_links, eps=float(eps)), f"src {name}, dst {name}", edge=tile).distinct()
    links = cut(links)
    comp = connected(links, core.select(F.col("_node").alias("id")).distinct())
    named = cut(core.join(comp.withColumnRenamed("id", "_node"), "_node").select(*AXES, "_id", F.col("component").alias("cluster")))
    for old in (core, links):
        release(old)
    core = named
    rest = cut(sparse.join(core.select("_id"), "_id", "left_anti").select(*AXES, "_id"))

    def least(q: pa.Table, p: pa.Table) -> pa.Table:
        """The smallest cluster within ``eps`` of each position that has one."""
        names = pc.unique(p.column("cluster"))
        names = names.take(pc.sort_indices(names))
        rank = pc.index_in(p.column("cluster"), names).to_numpy()
        best = np.full(q.num_rows, len(names))
        for i, j in within(q, p):
            np.minimum.at(best, i, rank[j])
        found = np.flatnonzero(best < len(names))
        return pa.table({"_id": q.column("_id").take(pa.array(found)), "cluster": names.take(pa.array(best[found]))})

    border = meet(rest, core.filter("cluster IS NOT NULL").select(*AXES, "cluster"), reach, least, f"_id {name}, cluster {name}", edge=tile, few=True).groupBy("_id").agg(F.min("cluster").alias("cluster"))
    border = rest.join(border, "_id").select(*AXES, "cluster")
    return points.join(core.select(*AXES, "cluster").unionByName(border), AXES, "left").select(idc, "cluster")


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the nodes ``a`` and ``b`` are joined."""
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


class _Rows:
    """Positions of one side in order of their node: first row and number of rows per node, and the box around them."""

    def __init__(self, x: np.ndarray, node: np.ndarray, n: int):
        order = np.argsort(node, kind="stable")
        self.x, self.node = x[order], node[order]
        self.many = np.bincount(node, minlength=n)
        self.first = np.r_[0, np.cumsum(self.many)[:-1]]
        self.some = np.flatnonzero(self.many)
        self.low, self.high = np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
        if len(x):
            self.low[self.some] = np.minimum.reduceat(self.x, self.first[self.some])
            self.high[self.some] = np.maximum.reduceat(self.x, self.first[self.some])

    def farthest(self, way: np.ndarray) -> np.ndarray:
        """Per node the row that lies farthest in a direction."""
        v = self.x @ way
        top = np.zeros(len(self.many))
        top[self.some] = np.maximum.reduceat(v, self.first[self.some])
        at = np.flatnonzero(v == top[self.node])
        out = np.zeros(len(self.many), np.int64)
        out[self.node[at]] = at
        return out


def _touch(a: _Rows, b: _Rows, u: np.ndarray, v: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs of nodes have positions within ``eps`` of each other."""
    def near(i, j):
        d = a.x[i] - b.x[j]
        return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= eps * eps

    gap = np.maximum(0.0, np.maximum(a.low[u] - b.high[v], b.low[v] - a.high[u])) * (1 - 1e-9)
    size = np.where((gap * gap).sum(axis=1) <= eps * eps, a.many[u] * b.many[v], 0)
    out = np.zeros(len(u), bool)
    small = np.flatnonzero((size > 0) & (size <= PAIRS))
    bounds, i = np.r_[0, np.cumsum(size[small])], 0
    while i < len(small):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PAIRS, side="right")) - 1)
        part = small[i:j]
        of = np.repeat(part, size[part])
        k = np.arange(len(of)) - np.repeat(bounds[i:j] - bounds[i], size[part])
        ok = near(a.first[u[of]] + k // b.many[v[of]], b.first[v[of]] + k % b.many[v[of]])
        out[of[ok]] = True
        i = j
    for k in np.flatnonzero(size > PAIRS):
        right = np.arange(b.first[v[k]], b.first[v[k]] + b.many[v[k]])
        left = np.arange(a.first[u[k]], a.first[u[k]] + a.many[u[k]])
        step = max(1, PAIRS // len(left))
        out[k] = any(near(left[:, None], right[None, r:r + step]).any() for r in range(0, len(right), step))
    return out


def _node_links(q: pa.Table, p: pa.Table, eps: float) -> pa.Table:
    """Links that join the nodes of a tile, and those in its reach, as all pairs of positions within ``eps`` do: each node with
    the first one it hangs together with.  Nodes already joined are not looked at again, the nearest cells come first."""
    kind = p.schema.field("_node").type
    if not q.num_rows:
        return pa.table({"src": pa.array([], kind), "dst": pa.array([], kind)})
    names = pc.unique(p.column("_node"))
    n, cols = len(names), [f"_c{a}" for a in AXES]
    here, there = (pc.index_in(t.column("_node"), names).to_numpy() for t in (q, p))
    a, b = _Rows(positions(q), here, n), _Rows(positions(p), there, n)
    cell = np.zeros((n, 3), np.int64)
    cell[there] = np.stack([p.column(c).to_numpy() for c in cols], axis=1)
    cell -= cell.min(axis=0) - 2
    span = cell.max(axis=0) + 3
    flat = lambda c: (c[:, 0] * span[1] + c[:, 1]) * span[2] + c[:, 2]
    keys = flat(cell)
    order = np.argsort(keys)
    root, own = np.arange(n), a.some
    ways = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) != (0, 0, 0)]
    for way in sorted(ways, key=lambda w: sum(c * c for c in w)):
        want = flat(cell[own] + np.array(way))
        at = order[np.minimum(np.searchsorted(keys, want, sorter=order), n - 1)]
        u, v = own[keys[at] == want], at[keys[at] == want]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
        if not len(u):
            continue
        off = a.x[a.farthest(np.array(way, float))[u]] - b.x[b.farthest(-np.array(way, float))[v]]
        ok = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2] <= eps * eps
        root = _merged(root, u[ok], v[ok])
        left = ~ok & (root[u] != root[v])
        u, v = u[left], v[left]
        ok = _touch(a, b, u, v, eps)
        root = _merged(root, u[ok], v[ok])
    moved = np.flatnonzero(root != np.arange(n))
    return pa.table({"src": names.take(pa.array(root[moved])), "dst": names.take(pa.array(moved))})
