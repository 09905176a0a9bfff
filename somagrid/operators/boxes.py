"""Detection boxes and object matching.  Boxes are half-open: z0 <= z < z1."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from somagrid.operators.blocks import ball
from somagrid.operators.components import connected
from somagrid.operators.meet import close, meet, positions
from somagrid.operators.spatial import nearest_point
from somagrid.session import cut, shared_out, spread

AXES = ["z", "y", "x"]
CORNERS = [f"{a}{i}" for i in (0, 1) for a in AXES]
#: Cells of one tile that a task cuts out at a time.
CROPS = 1 << 14
#: Edge of a tile of :func:`split_overlaps`, and how far it looks for centres within one.
TILE = 48
NEAR = 4


def box_voxels(boxes: DataFrame, cols: list[str]) -> DataFrame:
    """One row per voxel of each box (a box is at most one patch in size)."""
    d = boxes
    for a in AXES:
        d = d.withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}1") - 1)))
    return spread(d.select(*cols, *AXES))


def split_overlaps(boxes: DataFrame, box: str = "box") -> DataFrame:
    """Voxels of all boxes with one owner each: the only box there, or, where boxes
    overlap, the box whose centre is nearest (smaller id on ties).

    Boxes, not their voxels, go to the tiles they touch; equal boxes go as one.  Only voxels without a centre within
    ``NEAR`` go through the search over all centres."""
    kind, place, own = dict(boxes.dtypes), [f"_{n}{a}" for a in AXES for n in ("lo", "hi", "c")], []
    for a in AXES:
        first, last = F.col(f"{a}0"), F.col(f"{a}1") - 1
        centre = F.bround((F.col(f"{a}1") - F.col(f"{a}0")) / 2.0 + F.col(f"{a}0"))
        own += [c.cast("bigint").alias(f"_{n}{a}") for n, c in (("lo", F.least(first, last)), ("hi", F.greatest(first, last)), ("c", centre))]
    one = boxes.select(F.col(box).alias("_box"), *own).filter(functools.reduce(operator.and_, [F.col(c).isNotNull() for a in AXES for c in (f"{a}0", f"{a}1")]))
    # a missing id comes before the others
    one = cut(one.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.when(F.count("_box") == F.count(F.lit(1)), F.min("_box")).alias("_box")))
    size = functools.reduce(operator.mul, [(F.col(f"_hi{a}") - F.col(f"_lo{a}") + 1).cast("double") for a in AXES])
    voxels = int(one.agg(F.sum(size)).first()[0] or 0)
    tiles = one
    for a in AXES:
        low, high = F.least(f"_lo{a}", F.col(f"_c{a}") - NEAR), F.greatest(f"_hi{a}", F.col(f"_c{a}") + NEAR)
        tiles = tiles.withColumn(f"_t{a}", F.explode(F.sequence(F.floor(low / TILE), F.floor(high / TILE))))
    keys = [f"_t{a}" for a in AXES]
    steps, d2 = ball(NEAR)
    wide = TILE + 2 * NEAR
    shells = np.split((steps[:, 0] * wide + steps[:, 1]) * wide + steps[:, 2], np.nonzero(np.diff(d2))[0] + 1)

    none = pa.table({**{a: pa.array([], pa.int64()) for a in AXES}, box: one.select("_box").limit(0).toArrow().column(0), "_open": pa.array([], pa.bool_())})

    def owners(key, t):
        t = t.combine_chunks()
        start = [k.as_py() * TILE for k in key]
        at = lambda n, shift, top: [np.clip(t.column(f"_{n}{a}").to_numpy() + shift - s, 0, top) for a, s in zip(AXES, start)]
        corners = list(zip(at("lo", 0, TILE), at("hi", 1, TILE)))
        if not functools.reduce(operator.and_, [b > a for a, b in corners]).any():  # only centres of boxes elsewhere
            return none
        # how many boxes hold a voxel, and the sum of their row numbers: which one it is where there is one
        n, which = np.zeros((TILE + 1,) * 3, np.int64), np.zeros((TILE + 1,) * 3, np.int64)
        for side in np.ndindex(2, 2, 2):
            where, sign = tuple(c[k] for c, k in zip(corners, side)), -1 if sum(side) % 2 else 1
            np.add.at(n, where, sign * t.column("_n").to_numpy())
            np.add.at(which, where, sign * np.arange(t.num_rows))
        for k in range(3):
            n, which = n.cumsum(axis=k), which.cumsum(axis=k)
        n, which = (v[:TILE, :TILE, :TILE] for v in (n, which))
        single, shared = np.nonzero(n == 1), np.nonzero(n > 1)
        # the first id at each centre, then the centres around by distance
        order = pc.sort_indices(t.column("_box"), null_placement="at_start").to_numpy().astype(np.int64)
        rank = np.empty(t.num_rows, np.int64)
        rank[order] = np.arange(t.num_rows)
        mid = [t.column(f"_c{a}").to_numpy() - s + NEAR for a, s in zip(AXES, start)]
        held = functools.reduce(operator.and_, [(m >= 0) & (m < wide) for m in mid])
        first = np.full((wide,) * 3, t.num_rows)
        np.minimum.at(first, tuple(m[held] for m in mid), rank[held])
        first, found = first.ravel(), np.full(len(shared[0]), t.num_rows)
        place, todo = np.ravel_multi_index(tuple(v + NEAR for v in shared), (wide,) * 3), np.arange(len(found))
        for shell in shells:
            found[todo] = first[place[todo] + shell[:, None]].min(axis=0)
            todo = todo[found[todo] == t.num_rows]
        row = np.r_[which[single], np.r_[order, 0][found]]
        left = np.r_[np.zeros(len(single[0]), bool), found == t.num_rows]
        return pa.table({**{a: np.r_[p, q] + s for a, p, q, s in zip(AXES, single, shared, start)},
                         box: t.column("_box").take(pa.array(row, mask=left)).combine_chunks(), "_open": left})

    seen = cut(shared_out(spread(tiles), voxels, *keys).groupBy(*keys).applyInArrow(owners, f"z long, y long, x long, {box} {kind[box]}, _open boolean"))
    done, left = seen.filter("NOT _open").select(*AXES, box), seen.filter("_open").select(*AXES)
    if left.isEmpty():
        return done
    centres = one.select(F.col("_box").alias("pos"), *[F.col(f"_c{a}").alias(a) for a in AXES])
    return done.unionByName(nearest_point(left, centres, 2.0).select(*AXES, F.col("pos").alias(box)))


def iou_pairs(a: DataFrame, b: DataFrame, la: str = "label", lb: str = "label", by=()) -> DataFrame:
    """Overlapping object pairs with intersection and IoU: one equi-join on voxel,
    linear in voxels, never all object pairs.  With ``by`` objects meet inside one
    image (or brain) only."""
    x = a.select(*by, *AXES, F.col(la).alias("a")).distinct()
    y = b.select(*by, *AXES, F.col(lb).alias("b")).distinct()
    both = x.join(y, [*by, *AXES]).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("inter"))
    na = x.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("na"))
    nb = y.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("nb"))
    j = both.join(na, [*by, "a"]).join(nb, [*by, "b"])
    return j.withColumn("iou", F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter")))


def detection_scores(truth: DataFrame, pred: DataFrame, iou: float = 0.3, min_size: int | None = None) -> DataFrame:
    """One row: TP (predictions that meet a truth object), FP, FN (truth objects no
    prediction meets), sensitivity, precision, voxel Jaccard.  With ``min_size``
    truth objects of that size or less are left out."""
    if min_size is not None:
        big = truth.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_size).select("label")
        truth = truth.join(big, "label", "left_semi")
    hit = cut(iou_pairs(truth, pred).filter(F.col("iou") > iou).select("a", "b"))
    one = lambda df, c, name: df.agg(F.count_distinct(c).alias(name)).withColumn("_k", F.lit(0))
    t, p = truth.select(*AXES).distinct(), pred.select(*AXES).distinct()
    union = t.withColumn("t", F.lit(1)).unionByName(p.withColumn("t", F.lit(2))).groupBy(*AXES).agg(F.sum("t").alias("s"))
    vox = union.agg(F.count_if(F.col("s") == 3).alias("both"), F.count(F.lit(1)).alias("any")).withColumn("_k", F.lit(0))
    r = functools.reduce(lambda x, y: x.join(y, "_k"), [
        one(hit, "b", "tp"), one(hit, "a", "found"), one(truth, "label", "n_truth"), one(pred, "label", "n_pred"), vox])
    r = r.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("found")).alias("fn"), "both", "any")
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    return r.select(
        "tp", "fp", "fn", d(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        d(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), d(F.col("both"), F.col("any")).alias("jaccard"))


def image_scores(truth: DataFrame, pred: DataFrame, by=("image",), iou: float = 0.3, min_size: int | None = None) -> DataFrame:
    """:func:`detection_scores` for every image that has a truth or predicted voxel,
    with the number and mean IoU of the matched pairs; :func:`matched_ious` lists them.

    A ratio with nothing below its line is NULL, as is the mean without a match."""
    by = list(by)
    objects = lambda df: df.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n"))
    t, p = truth.select(*by, *AXES, "label").distinct(), pred.select(*by, *AXES, "label").distinct()
    nt, np_ = objects(t), objects(p)
    if min_size is not None:
        nt = nt.filter(F.col("_n") > min_size)
        t = t.join(nt.select(*by, "label"), [*by, "label"], "left_semi")
    hit = cut(iou_pairs(t, p, by=by).filter(F.col("iou") > iou).select(*by, "a", "b", "iou"))
    # one row per object and per voxel, so an image with most of the objects is summed from partial counts
    seen = hit.select(*by, F.col("b").alias("label")).distinct().withColumn("_hit", F.lit(1))
    found = hit.select(*by, F.col("a").alias("label")).distinct().withColumn("_hit", F.lit(1))
    per_pred = np_.join(seen, [*by, "label"], "left").groupBy(*by).agg(F.count("_hit").alias("tp"), F.count_if(F.col("_hit").isNull()).alias("fp"))
    per_truth = nt.join(found, [*by, "label"], "left").groupBy(*by).agg(F.count_if(F.col("_hit").isNull()).alias("fn"))
    sides = t.select(*by, *AXES).distinct().withColumn("_s", F.lit(1)).unionByName(p.select(*by, *AXES).distinct().withColumn("_s", F.lit(2)))
    voxels = sides.groupBy(*by, *AXES).agg(F.sum("_s").alias("_s")).groupBy(*by).agg(F.count_if(F.col("_s") == 3).alias("_both"), F.count(F.lit(1)).alias("_any"))
    pairs = hit.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("iou").alias("mean_iou"))
    r = functools.reduce(lambda x, y: x.join(y, by, "full_outer"), [per_pred, per_truth, voxels, pairs]).fillna(0, subset=["tp", "fp", "fn", "n_pairs"])
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    return r.select(*by, "tp", "fp", "fn", d(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"), d(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    d(F.col("_both"), F.col("_any")).alias("jaccard"), "n_pairs", "mean_iou")


def matched_ious(truth: DataFrame, pred: DataFrame, by=("image",), iou: float = 0.3) -> DataFrame:
    """Each matched pair of a truth object ``a`` and a prediction ``b`` with its IoU, per image."""
    return iou_pairs(truth, pred, by=list(by)).filter(F.col("iou") > iou).select(*by, "a", "b", "iou")


def pooled_scores(scores: DataFrame) -> DataFrame:
    """One row from :func:`image_scores`: counts summed over images, sensitivity and
    precision of the sums, and the means over the images where a score is above 0."""
    total = scores.agg(F.count(F.lit(1)).alias("n_images"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
                       *[F.avg(F.when(F.col(c) > 0, F.col(c))).alias(f"mean_{c}") for c in ("sensitivity", "precision", "jaccard")])
    d = lambda *c: F.try_divide(F.col("tp").cast("double"), F.col(c[0]) + F.col(c[1]))
    return total.withColumn("sensitivity", d("tp", "fn")).withColumn("precision", d("tp", "fp"))


def overlap_objects(objs: DataFrame, mask: DataFrame, label: str = "label") -> DataFrame:
    """Objects that touch the mask."""
    m = mask.select(*AXES).distinct()
    return objs.join(m, AXES, "left_semi").select(label).distinct()


def _iou(a: str, b: str) -> tuple[Column, Column]:
    mul = lambda xs: functools.reduce(operator.mul, xs)
    side = [F.least(F.col(f"{a}.{c}1"), F.col(f"{b}.{c}1")) - F.greatest(F.col(f"{a}.{c}0"), F.col(f"{b}.{c}0")) for c in AXES]
    inter = mul([F.greatest(s, F.lit(0)) for s in side]).cast("double")
    vol = lambda t: mul([F.col(f"{t}.{c}1") - F.col(f"{t}.{c}0") for c in AXES]).cast("double")
    return inter, F.try_divide(inter, vol(a) + vol(b) - inter)


def box_pairs(boxes: DataFrame, iou: float, box: str = "box", tile: int = 8) -> DataFrame:
    """Pairs of boxes whose IoU is over the limit, each once.

    Boxes meet in the tiles they touch; a pair counts in the tile that holds the
    first corner of its intersection, so no de-duplication is needed.
    """
    t = boxes.select(box, *CORNERS)
    for a in AXES:
        t = t.withColumn(f"_t{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / tile), F.floor((F.col(f"{a}1") - 1) / tile))))
    t = spread(t)
    a, b = t.alias("a"), t.alias("b")
    on = functools.reduce(operator.and_, [F.col(f"a._t{c}") == F.col(f"b._t{c}") for c in AXES])
    home = functools.reduce(operator.and_, [
        F.floor(F.greatest(F.col(f"a.{c}0"), F.col(f"b.{c}0")) / tile) == F.col(f"a._t{c}") for c in AXES])
    _, ratio = _iou("a", "b")
    j = a.join(b, on & (F.col(f"a.{box}") < F.col(f"b.{box}"))).filter(home).withColumn("iou", ratio)
    return j.filter(F.col("iou") > iou).select(F.col(f"a.{box}").alias("a"), F.col(f"b.{box}").alias("b"), "iou")


def cluster_boxes(boxes: DataFrame, iou: float, box: str = "box", score: str = "score", tile: int = 8) -> DataFrame:
    """Weighted box clusters over patches: boxes linked by IoU share a cluster;
    corners and score are means weighted by score and volume.

    Boxes with equal corners are one node (their weights add up), so a pile of
    copies makes no pairs among itself.
    """
    vol = functools.reduce(operator.mul, [F.col(f"{a}1") - F.col(f"{a}0") for a in AXES]).cast("double")
    w = F.col(score) * vol
    same = cut(boxes.groupBy(*CORNERS).agg(
        F.min(box).alias(box), F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"), F.sum(w * F.col(score)).alias("_ws")))
    pairs = box_pairs(same, iou, box, tile)
    comp = connected(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), same.select(F.col(box).alias("id")))
    j = same.join(comp.select(F.col("id").alias(box), F.col("component").alias("cluster")), box)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("_w")), F.sum("_w")).alias(c)
    return j.groupBy("cluster").agg(
        F.sum("_n").alias("n_boxes"), *[mean(c) for c in CORNERS], F.try_divide(F.sum("_ws"), F.sum("_w")).alias("score"))


def extract_crops(cells: DataFrame, voxels: DataFrame, half: dict, idc: str = "cell_id", value: str = "value") -> DataFrame:
    """Voxel list of each cell's crop window (``position +- half``), relative to the
    window; a list is at most one window long.

    Cells go to one tile, voxels to the tiles whose windows they may lie in; the
    lists are made there.  Rows that share an id share a list.
    """
    c, v = cells.select(idc, *AXES), voxels.select(*AXES, value)
    probe = c.crossJoin(v.select(*[F.col(a).alias(f"_{a}") for a in AXES])).select(*[(F.col(f"_{a}") - F.col(a) + half[a]).alias(a) for a in AXES])
    kind = {**dict(probe.dtypes), "value": dict(v.dtypes)[value]}
    px = f"array<struct<{', '.join(f'{n}:{k}' for n, k in kind.items())}>>"

    def crop(q: pa.Table, p: pa.Table) -> pa.Table:
        x, y = positions(q), positions(p)
        h = np.array([float(half[a]) for a in AXES])
        own, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in close(x, y, h):
            rel = y[j] - x[i] + h
            ok = ((rel >= 0) & (rel <= 2 * h - 1)).all(axis=1)
            own.append(i[ok])
            other.append(j[ok])
        own, other = np.concatenate(own), np.concatenate(other)
        first = np.searchsorted(own, np.arange(len(x) + 1)).astype(np.int32)
        near, mid = p.take(pa.array(other)), q.take(pa.array(own))
        rel = [pc.add(pc.subtract(near.column(a), mid.column(a)), pa.scalar(half[a], near.schema.field(a).type)) for a in AXES]
        parts = [r.combine_chunks() if isinstance(r, pa.ChunkedArray) else r for r in (*rel, near.column(value))]
        parts = [pa.concat_arrays(r.chunks) if isinstance(r, pa.ChunkedArray) else r for r in parts]
        lists = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(parts, [*AXES, "value"]))
        out = pa.table({idc: q.column(idc), "voxels": lists})
        return out.filter(pa.array(first[1:] > first[:-1]))

    def lists(some: DataFrame) -> DataFrame:
        d = meet(some, v, half, crop, f"{idc} {dict(c.dtypes)[idc]}, voxels {px}", limit=CROPS)
        return d.withColumn("voxels", F.sort_array("voxels"))

    again = cut(c.groupBy(F.col(idc).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_again"))
    if again.isEmpty():
        return lists(c)
    shared = F.col(idc).eqNullSafe(F.col("_again"))
    merged = lists(c.join(again, shared, "left_semi")).groupBy(idc).agg(F.sort_array(F.flatten(F.collect_list("voxels"))).alias("voxels"))
    return lists(c.join(again, shared, "left_anti")).unionByName(merged)
