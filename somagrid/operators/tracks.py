"""Cell tracks: links, births and deaths, predictions, claims.

Rows are keyed by (series, frame).  A link to the next frame is an equi-join on
both columns, so a long track spreads over all tasks.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from somagrid.operators.components import connected
from somagrid.operators.meet import meet, positions
from somagrid.operators.nearest import _closest
from somagrid.operators.ordered import join_ranks, neighbour_row, value_ranks
from somagrid.session import cut, release, spread

AXES = ["z", "y", "x"]
#: How many places of one tile look for links in a task.
PLACES = 1 << 14
#: Up to this many pairs of ends, claims are settled at one distance.
LINKS = 1 << 24


def row_index(df: DataFrame, keys: list[str], order: str, out: str = "idx") -> DataFrame:
    """Dense position of each row in its group by a unique order column."""
    r = value_ranks(df, keys, order)
    return join_ranks(df, r.withColumnRenamed("before", out), keys, order, [out])


def track_edges(spots: DataFrame) -> DataFrame:
    """Each spot to the next of its track; a track of one spot has no edge."""
    n = neighbour_row(spots.select("series", "frame"), ["series"], "frame", ["frame"])
    return n.filter("next_frame IS NOT NULL").select("series", F.col("frame").alias("source"), F.col("next_frame").alias("target"))


def births_deaths(tracks: DataFrame) -> DataFrame:
    """New cells (not in the frame before, first frame left out) and terminated
    cells (no later spot, last frame left out)."""
    t = tracks.select("series", "frame")
    n = neighbour_row(neighbour_row(t, ["series"], "frame", ["frame"]), ["series"], "frame", ["frame"], -1, prefix="prev_")
    span = t.agg(F.struct(F.min("frame").alias("lo"), F.max("frame").alias("hi"))).scalar()
    n = n.withColumn("_s", span)
    new = (F.col("frame") > F.col("_s.lo")) & ~F.coalesce(F.col("prev_frame") == F.col("frame") - 1, F.lit(False))
    end = (F.col("frame") < F.col("_s.hi")) & F.col("next_frame").isNull()
    return n.select("series", "frame", new.alias("is_new"), end.alias("is_terminated")).filter("is_new OR is_terminated")


def track_summary(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("series").agg(
        F.count(F.lit(1)).alias("length"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        (F.max("frame") - F.min("frame") + 1).alias("span"))


def track_class(tracks: DataFrame) -> DataFrame:
    """Per track: appears late (new), ends early (old), both, or neither (all)."""
    s = track_summary(tracks)
    g = s.agg(F.struct(F.min("first_frame").alias("lo"), F.max("last_frame").alias("hi"))).scalar()
    s = s.withColumn("_g", g)
    late, early = F.col("first_frame") > F.col("_g.lo"), F.col("last_frame") < F.col("_g.hi")
    kind = F.when(late & early, "both").when(late, "new").when(early, "old").otherwise("all")
    return s.select("series", kind.alias("track_class"))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, n: int, width: int = 100_000, out: str = "average") -> DataFrame:
    """Trailing mean of ``n`` rows, only where the frame is full.

    Rows are cut into bins of ``width``; the last ``n - 1`` rows of a bin are
    repeated in front of the next one.
    """
    if n > width:
        raise ValueError("width must be at least n")
    d = row_index(df.select(*keys, order, value), keys, order, "_i").withColumn("_home", F.floor(F.col("_i") / width))
    spill = F.when(F.col("_i") % width >= width - (n - 1), F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array(F.col("_home")))
    d = d.withColumn("_bin", F.explode(spill))
    w = W.partitionBy(*keys, "_bin").orderBy("_i").rowsBetween(-(n - 1), 0)
    d = d.withColumn(out, F.avg(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    return d.filter((F.col("_bin") == F.col("_home")) & (F.col("_n") == n)).select(*keys, order, out)


def drop_repeats(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Rows whose position differs from the row before."""
    n = neighbour_row(df, keys, order, cols, -1, prefix="prev_")
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"prev_{c}")) for c in cols])
    first = functools.reduce(operator.and_, [F.col(f"prev_{c}").isNull() for c in cols])
    return n.filter(~same | first).select(*df.columns)


def link_frames(tracks: DataFrame, cols: list[str] = AXES) -> DataFrame:
    """Each spot with its track's spot in the next frame and the displacement."""
    nxt = tracks.select("series", (F.col("frame") - 1).alias("frame"), *[F.col(c).alias(f"next_{c}") for c in cols])
    j = tracks.select("series", "frame", *cols).join(nxt, ["series", "frame"])
    return j.select("*", *[(F.col(f"next_{c}") - F.col(c)).alias(f"d{c}") for c in cols])


def _window_medians(q: pa.Table, p: pa.Table, half: list[list[float]], need: int) -> pa.Table:
    """For each position of ``q`` the median displacement of the links ``p`` in the first window that holds ``need`` of them.

    ``half`` has the half widths of each window.  Links are sorted along the first axis, so those of a window are a run
    among the links whose other axes fit, which positions in one line along that axis share; medians come from counts
    per displacement."""
    x, y = positions(q), positions(p)
    order = np.argsort(y[:, 0], kind="stable")
    y, n = y[order], p.column("n").to_numpy()[order]
    shifts = []
    for c in AXES:
        v = p.column(f"d{c}").combine_chunks()
        known = np.asarray(v.is_valid())
        values, at = np.unique(v.drop_null().to_numpy(), return_inverse=True)
        rank = np.full(len(known), len(values))  # one past the last: no value
        rank[known] = at
        shifts.append((values.astype(float), rank[order]))
    level, total = np.full(len(x), -1), np.zeros(len(x), np.int64)
    median = np.full((len(x), 3), np.nan)
    line = np.lexsort((x[:, 2], x[:, 1]))
    ends = np.flatnonzero((x[line][1:, 1:] != x[line][:-1, 1:]).any(axis=1)) + 1
    for todo in np.split(line, ends) if len(x) and len(y) else ():
        for i, h in enumerate(half):
            low, high = np.trunc(x[todo] - h), np.trunc(x[todo] + h)
            near = np.flatnonzero(((y[:, 1:] >= low[0, 1:]) & (y[:, 1:] < high[0, 1:])).all(axis=1))
            start, end = (np.searchsorted(y[near, 0], v[:, 0]) for v in (low, high))
            upto = np.r_[0, np.cumsum(n[near])]
            many = upto[end] - upto[start]
            done = many >= need
            ranks = [r[near] for _, r in shifts]
            weight = n[near]
            for k, s, e, m in zip(todo[done], start[done], end[done], many[done]):
                level[k], total[k] = i, m
                for c, (values, _) in enumerate(shifts):
                    upto = np.bincount(ranks[c][s:e], weight[s:e], len(values) + 1)[:-1].cumsum()
                    if len(upto) and (t := int(upto[-1])):
                        lower, upper = np.searchsorted(upto, [(t - 1) // 2, t // 2], side="right")
                        median[k, c] = values[lower] if lower == upper else 0.5 * values[lower] + 0.5 * values[upper]
            todo = todo[~done]
            if not len(todo):
                break
    ok = level >= 0
    out = {**{a: q.column(a) for a in AXES}, "n_tracked": total, "_level": pa.array(level, pa.int32())}
    return pa.table({**out, **{f"_m{a}": pa.array(m, mask=np.isnan(m)) for a, m in zip(AXES, median.T)}}).filter(pa.array(ok))


def predict_next(tracks: DataFrame, crop: dict, scales: list[float], need: int = 4) -> DataFrame:
    """Expected place of each cell in the next frame: its position plus the median
    displacement of tracked neighbours, in the first window that holds ``need``.

    Cells of a frame at one position share a window, and links of one place and
    displacement are one row with a count.  Places and links of a frame meet in
    tiles, where the medians are taken from counts, so only one row per place is
    written.  All positions try the smallest window; only those that find too few
    neighbours go on to the wide ones.
    """
    links = cut(link_frames(tracks).groupBy("frame", *AXES, *[f"d{c}" for c in AXES]).agg(F.count(F.lit(1)).alias("n")))
    cells = tracks.select("series", "frame", *AXES).distinct()
    places = cells.select("frame", *AXES).distinct()
    kind = dict(places.dtypes)
    schema = "".join(f"{a} {kind[a]}, " for a in AXES) + "n_tracked long, _level int, " + ", ".join(f"_m{a} double" for a in AXES)

    def attempt(some: DataFrame, levels: list[float], base: int) -> DataFrame:
        half = [[crop[a] * (1 + s) / 2.0 for a in AXES] for s in levels]
        g = meet(some, links, {a: h + 1 for a, h in zip(AXES, half[-1])}, lambda q, p: _window_medians(q, p, half, need), schema, ["frame"], limit=PLACES)
        return g.select("frame", *AXES, *[(F.col(c) + F.col(f"_m{c}")).cast("bigint").alias(f"pred_{c}") for c in AXES], "n_tracked",
                        (F.col("_level") + base).alias("scale_index"))

    found = cut(attempt(places, scales[:1], 0))
    if len(scales) > 1:
        rest = places.join(found, ["frame", *AXES], "left_anti")
        found = found.unionByName(attempt(rest, scales[1:], 1))
    return cells.join(found, ["frame", *AXES]).select("series", "frame", *[f"pred_{c}" for c in AXES], "n_tracked", "scale_index")


def link_errors(tracks: DataFrame, crop: dict, scales: list[float], limit: float = 10.0) -> DataFrame:
    """Distance between the predicted and the real next position, flagged above the limit."""
    p = predict_next(tracks, crop, scales)
    nxt = tracks.select("series", (F.col("frame") - 1).alias("frame"), *AXES)
    d = functools.reduce(operator.add, [(F.col(c) - F.col(f"pred_{c}")) * (F.col(c) - F.col(f"pred_{c}")) for c in AXES])
    j = p.join(nxt, ["series", "frame"]).withColumn("error", F.sqrt(d.cast("double")))
    return j.select("series", "frame", "error", (F.col("error") > limit).alias("flagged"))


def _nearest(spots: DataFrame, points: DataFrame, d: float, name: str) -> DataFrame:
    """``frame, z, y, x`` of ``spots`` with the nearest point of the frame within ``d`` (its ``name``, smaller ones on
    ties) and the squared distance; both sides have one row per place."""
    kind = {**dict(points.dtypes), **dict(spots.dtypes)}

    def near(q: pa.Table, p: pa.Table) -> pa.Table:
        i, j, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if q.num_rows and p.num_rows:
            rank = np.empty(p.num_rows, np.int64)
            rank[pc.sort_indices(p.column(name), null_placement="at_start").to_numpy()] = np.arange(p.num_rows)
            i, j, d2 = _closest(positions(q), positions(p), rank, 1, d / 2, False)
        return q.take(pa.array(i)).select(AXES).append_column(name, p.column(name).take(pa.array(j))).append_column("_d2", pa.array(d2))

    return meet(spots, points, dict.fromkeys(AXES, d), near, "".join(f"{c} {kind[c]}, " for c in (*AXES, name)) + "_d2 double", ["frame"], limit=PLACES)


def candidate_links(cells: DataFrame, cand: DataFrame, d: float = 20.0, only: str | None = None) -> DataFrame:
    """(frame, cell, cand, distance) for candidates of the next frame within ``d``.

    With ``only`` (``cell`` or ``cand``) just the (frame, id) that have a link at all, each once: places meet in tiles and
    no pairs are written.  The links know their two ends, so :func:`resolve_claims` can ask for the near ones first."""
    a, b = cells.select("frame", "cell", *AXES), cand.select((F.col("frame") - 1).alias("frame"), "cand", *AXES)
    if only:
        own, other = (a, b) if only == "cell" else (b, a)
        place = lambda df: df.select("frame", *AXES).distinct()
        linked = _nearest(place(own), place(other).withColumn("_any", F.lit(0)), float(d), "_any").select("frame", *AXES)
        return own.join(linked, ["frame", *AXES], "left_semi").select("frame", only).distinct()
    edge = F.lit(4.0 * float(d))  # a cell goes to the few buckets that it reaches into
    near = float(d) * (1 + 1e-9)
    for x in AXES:
        a = a.withColumn(f"_b{x}", F.explode(F.sequence(F.floor((F.col(x) - near) / edge), F.floor((F.col(x) + near) / edge))))
        b = b.withColumn(f"_b{x}", F.floor(F.col(x) / edge))
    a = spread(a)
    on = functools.reduce(operator.and_, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ["frame", *[f"_b{x}" for x in AXES]]])
    d2 = functools.reduce(operator.add, [(F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in AXES]).cast("double")
    links = a.alias("a").join(b.alias("b"), on).filter(d2 <= d * d).select("a.frame", "a.cell", "b.cand", F.sqrt(d2).alias("distance"))
    links._ends = (cells.select("frame", "cell", *AXES), cand.select("frame", "cand", *AXES), float(d))
    return links


def associate(cells: DataFrame, cand: DataFrame, d: float = 20.0) -> DataFrame:
    """Nearest candidate of the next frame within ``d`` (smaller id on ties).

    Cells at one place share their search, and of the candidates at one place the smallest id is kept; places meet in
    tiles, and only the nearest candidate of each is written."""
    points = cand.groupBy((F.col("frame") - 1).alias("frame"), *AXES).agg(F.min(F.struct("cand")).alias("_c")).select("frame", *AXES, "_c.cand")
    near = _nearest(cells.select("frame", *AXES).distinct(), points, float(d), "cand")
    best = F.min(F.struct(F.sqrt("_d2").alias("distance"), "cand")).alias("b")
    return cells.select("frame", "cell", *AXES).join(near, ["frame", *AXES]).groupBy("frame", "cell").agg(best).select("frame", "cell", "b.cand", "b.distance")


def _settle_claims(claims: DataFrame) -> DataFrame:
    """Claims of whole groups, closest first, in one pass over each group's sorted rows; a group's settled ends are all that is held."""

    def run(batches):
        group, cells, cands = None, set(), set()
        for b in batches:
            keep = []
            for g, cell, cand in zip(*(b.column(c).to_pylist() for c in ("_g", "cell", "cand"))):
                if g != group:
                    group, cells, cands = g, set(), set()
                free = cell not in cells and cand not in cands
                keep.append(free)
                if free:
                    cells.add(cell)
                    cands.add(cand)
            yield b.select(["frame", "cell", "cand", "distance"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(claims.dtypes)
    dealt = claims.repartition("_g").sortWithinPartitions("_g", "distance", "cell", "cand")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in ("frame", "cell", "cand", "distance")))


def _settle(links: DataFrame, limit: int) -> list[DataFrame]:
    """Settled claims of all links, in written parts."""
    every = cut(links.select("frame", "cell", "cand", "distance").filter("frame IS NOT NULL AND cell IS NOT NULL AND cand IS NOT NULL AND distance IS NOT NULL"))
    crowded = cut(every.groupBy("frame").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("frame"))
    kept = [cut(_settle_claims(every.join(crowded, "frame", "left_anti").withColumn("_g", F.col("frame"))))]
    todo = cut(every.join(crowded, "frame", "left_semi"))
    release(every)
    while not todo.isEmpty():
        end = lambda side, c: F.struct(F.col("frame"), F.lit(side).alias("side"), F.col(c).cast("string").alias("id"))
        edges = todo.select(end(0, "cell").alias("src"), end(1, "cand").alias("dst"))
        comp = connected(edges, edges.select(F.col("src").alias("id")).distinct()).withColumnRenamed("component", "_g")
        grouped = cut(todo.withColumn("id", end(0, "cell")).join(comp, "id").drop("id"))
        size = grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        big = cut(size.filter(F.col("_n") > limit).select("_g"))
        kept.append(cut(_settle_claims(grouped.join(big, "_g", "left_anti"))))
        rest = grouped.join(big, "_g").drop("_g")
        key = F.struct("distance", "cell", "cand")
        by_cell = rest.groupBy("frame", "cell").agg(F.min(key).alias("_bc"))
        by_cand = rest.groupBy("frame", "cand").agg(F.min(key).alias("_bd"))
        j = rest.join(by_cell, ["frame", "cell"]).join(by_cand, ["frame", "cand"])
        win = cut(j.filter((F.col("_bc") == key) & (F.col("_bd") == key)).select("frame", "cell", "cand", "distance"))
        kept.append(win)
        left = cut(rest.join(win.select("frame", "cell"), ["frame", "cell"], "left_anti").join(win.select("frame", "cand"), ["frame", "cand"], "left_anti"))
        for old in (todo, grouped, big):
            release(old)
        todo = left
    return kept


def _reaches(cells: DataFrame, cand: DataFrame, d: float) -> list[float]:
    """Distances below ``d`` up to which claims are settled first: none for few ends, more of them the more claims an end may have."""
    many = cells.groupBy("frame").agg(F.count(F.lit(1)).alias("_a")).join(
        cand.groupBy((F.col("frame") - 1).alias("frame")).agg(F.count(F.lit(1)).alias("_b")), "frame")
    pairs, ends = many.agg(F.coalesce(F.sum(F.col("_a").cast("double") * F.col("_b")), F.lit(0.0)), F.coalesce(F.sum("_a"), F.lit(0))).first()
    if pairs <= LINKS:
        return []
    steps = max(0, math.ceil(2 * math.log2(pairs / ends) / 3))  # an end has about one pair in the first of them, if ends are even
    return [d / 2 ** (i / 2) for i in range(steps, 0, -1)]


def resolve_claims(links: DataFrame, limit: int = 1 << 22) -> DataFrame:
    """One candidate per cell and one cell per candidate, closest pairs first, ties to
    the smaller ids.

    Links that come from :func:`candidate_links` as they are, of many ends, are not all made: a claim depends on closer
    ones only, so those up to a small distance are settled first, and only cells and candidates still free are linked at
    the next.  Other links are settled at once.

    Frames of up to ``limit`` claims are settled at once, in one pass over their
    sorted claims.  In larger frames, claims that hang together form a group.
    Groups of up to ``limit`` claims are settled at once too, however long their
    chains are.  Of a larger group the pairs that are best for both their cell
    and their candidate settle, and what is left of it, which falls apart, is
    grouped again.
    """
    ends = getattr(links, "_ends", None)
    near = _reaches(*ends) if ends else []
    if not near:
        return functools.reduce(DataFrame.unionByName, _settle(links, limit))
    whole = lambda df, c: cut(df.dropna(subset=["frame", c, *AXES]))
    cells, cand, d = whole(ends[0], "cell"), whole(ends[1], "cand"), ends[2]
    kept = []
    for reach in [*near, None]:
        # a little further than the distance that is settled, so that all links of equal distance are there
        part = candidate_links(cells, cand, d) if reach is None else candidate_links(cells, cand, min(d, reach * (1 + 1e-9))).filter(F.col("distance") <= reach)
        done = _settle(part, limit)
        kept += done
        if reach is None:
            break
        won = cut(functools.reduce(DataFrame.unionByName, done).select("frame", "cell", "cand"))
        if won.isEmpty():
            continue
        free = (cut(cells.join(won, ["frame", "cell"], "left_anti")), cut(cand.join(won.select((F.col("frame") + 1).alias("frame"), "cand"), ["frame", "cand"], "left_anti")))
        for old in (cells, cand, won):
            release(old)
        cells, cand = free
    return functools.reduce(DataFrame.unionByName, kept)


def new_tracks(cand: DataFrame, links: DataFrame, tracks: DataFrame, min_size: int = 0) -> DataFrame:
    """Unlinked candidates of enough size become series after the last one."""
    free = cand.join(links.select((F.col("frame") + 1).alias("frame"), "cand"), ["frame", "cand"], "left_anti").filter(F.col("size") > min_size)
    r = value_ranks(free, [], "cand").select("cand", "before")
    top = tracks.agg(F.coalesce(F.max("series"), F.lit(0))).scalar()
    return free.join(r, "cand").select("frame", "cand", (F.col("before") + 1 + top).alias("series"))


def size_guard(links: DataFrame, cur: str = "size", nxt: str = "next_size") -> DataFrame:
    """Links whose size jump is believable."""
    jump = (F.col(nxt) > 2 * F.col(cur)) & ((F.col(cur) > 500) | (F.col(nxt) > 800))
    return links.filter(~jump)


def double_links(cells: DataFrame, centroids: DataFrame) -> DataFrame:
    """Next centroids that lie inside several cells of a frame: ``cells`` holds the
    voxels (series, frame, z, y, x)."""
    j = cells.join(centroids, ["frame", *AXES])
    return j.groupBy("frame", *AXES).agg(F.count_distinct("series").alias("n_cells")).filter("n_cells > 1")


def compare_tracks(t1: DataFrame, t2: DataFrame, seg: DataFrame) -> DataFrame:
    """Length difference of tracks matched through a shared segment.

    Per frame and segment the largest series of each tracking is taken; a pair
    counts when it is the first match of both its tracks.  (All segments are
    looked at together, not one after the other.)
    """
    def per(t: DataFrame, name: str) -> DataFrame:
        return t.join(seg, ["frame", *AXES]).groupBy("frame", "segment").agg(F.max("series").alias(name))

    j = cut(per(t1, "s1").join(per(t2, "s2"), ["frame", "segment"]))
    at = F.struct("frame", "segment")
    f1 = j.groupBy("s1").agg(F.min(at).alias("_f1"))
    f2 = j.groupBy("s2").agg(F.min(at).alias("_f2"))
    m = j.join(f1, "s1").join(f2, "s2").filter((F.col("_f1") == at) & (F.col("_f2") == at))
    n = lambda t, s, c: t.groupBy(F.col("series").alias(s)).agg(F.count(F.lit(1)).alias(c))
    m = m.join(n(t1, "s1", "length_1"), "s1").join(n(t2, "s2", "length_2"), "s2")
    return m.select("s1", "s2", "length_1", "length_2", (F.col("length_1") - F.col("length_2")).alias("difference"))
