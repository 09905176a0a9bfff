"""Column expressions and light projections on cells, voxels, spots and boxes."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------- coordinates
def to_global(cells: DataFrame, offset: str = "xyz_offset") -> DataFrame:
    """Block-local to global positions; the offset holds y, x, z in that order."""
    o = F.col(offset)
    return (
        cells.withColumn("z_global", F.col("z") + o[2])
        .withColumn("x_global", F.col("x") + o[1]).withColumn("y_global", F.col("y") + o[0])
    )


def crop_to_full(df: DataFrame, axes=("z", "y", "x")) -> DataFrame:
    """Crop-local to full-image positions: round, add box start, subtract overshoot."""
    for a in axes:
        df = df.withColumn(f"{a}_full", F.bround(F.col(a)) + F.col(f"box_{a}") - F.col(f"over_{a}"))
    return df


def add_vols_um(cells: DataFrame, xy_res: float, z_res: float) -> DataFrame:
    """Size as voxels over the resolution ratio, then over the XY resolution."""
    return cells.withColumn("vols_um", F.col("vols") / F.lit(xy_res / z_res) / F.lit(xy_res))


def to_atlas_space(df: DataFrame, factor: dict, overlap: dict | None = None, pad: dict | None = None) -> DataFrame:
    """(position - overlap) / factor + pad, truncated to an integer."""
    overlap, pad = overlap or {}, pad or {}
    for a, f in factor.items():
        v = (F.col(a) - overlap.get(a, 0)) / F.lit(float(f)) + pad.get(a, 0)
        df = df.withColumn(a, v.cast("bigint"))
    return df


def clamp(df: DataFrame, shape: dict, lower: bool = True) -> DataFrame:
    """Positions kept inside the volume; ``lower=False`` caps the far side only."""
    for a, n in shape.items():
        v = F.least(F.col(a), F.lit(n - 1))
        df = df.withColumn(a, F.greatest(v, F.lit(0)) if lower else v)
    return df


def reorient(df: DataFrame, perm: dict, flips=(), shape: dict | None = None) -> DataFrame:
    """Rename axes by ``perm`` (new -> old) and mirror those in ``flips``."""
    new = {n: F.col(o) for n, o in perm.items()}
    for a in flips:
        new[a] = F.lit(shape[a] - 1) - new[a]
    keep = [c for c in df.columns if c not in perm.values()]
    return df.select(*keep, *[e.alias(n) for n, e in new.items()])


def voxel_volume(n, res: float) -> Column:
    """Voxel count to cubic millimetres at ``res`` micrometres."""
    return col(n) * F.lit(res**3 * 1e-9)


def isotropic_factor(xy_res: float, z_res: float) -> tuple[dict, float]:
    """Per-axis scale that makes voxels isotropic by downsampling, and the new edge."""
    ratio = xy_res / z_res
    if ratio < 1:
        return {"z": 1.0, "y": ratio, "x": ratio}, z_res
    return {"z": 1.0 / ratio, "y": 1.0, "x": 1.0}, xy_res


# -------------------------------------------------------------- filters
def size_filter(df: DataFrame, low=None, high=None, on: str = "vols") -> DataFrame:
    """Strict bounds on object size."""
    if low is not None:
        df = df.filter(F.col(on) > low)
    return df if high is None else df.filter(F.col(on) < high)


def match_regions(df: DataFrame, pattern: str, mode: str = "full", on: str = "acronym", keep: bool = True) -> DataFrame:
    """Regex on a text column: whole value (``full``) or any part (``contains``)."""
    hit = F.col(on).rlike(f"^(?:{pattern})$" if mode == "full" else pattern)
    return df.filter(hit if keep else ~hit)


def layer_filter(df: DataFrame, layer: str, on: str = "names") -> DataFrame:
    """Unanchored layer token, so '1' also meets '10'."""
    return df.filter(F.col(on).contains(layer))


# The cortical layers in order.
LAYERS = ["L1", "L2/3", "L4", "L5", "L6a", "L6b"]


def parse_layer(df: DataFrame, on: str = "names", layers=LAYERS) -> DataFrame:
    """Split a name at its last word "layer": before it the macro region, after it a token of ``layers``.

    Names without a listed token, or without a blank or comma before the word, are dropped."""
    low = F.lower(on)
    token = F.trim(F.substring_index(low, "layer", -1))
    before = F.expr(f"left(`{on}`, length(`{on}`) - length(substring_index(lower(`{on}`), 'layer', -1)) - length('layer'))")
    order = F.array_position(F.array(*[F.lit(v) for v in layers]), F.col("layer"))
    named = df.filter(low.contains("layer")).withColumn("_before", before).withColumn("macro", F.expr("trim(TRAILING ', ' FROM _before)"))
    return (
        named.filter(F.col("macro") != F.col("_before")).drop("_before").withColumn("macro", F.trim("macro"))
        .withColumn("layer", F.concat(F.lit("L"), token)).withColumn("layer_order", order).filter("layer_order > 0")
    )


# --------------------------------------------------------------- values
def row_mean(df: DataFrame, pattern: str, out: str, sentinels=(0, -1)) -> DataFrame:
    """Mean over the columns whose name holds ``pattern``; sentinels count as missing."""
    names = [c for c in df.columns if pattern in c]
    vals = F.filter(
        F.array(*[F.col(f"`{c}`").cast("double") for c in names]), lambda v: v.isNotNull() & ~v.isin(*[float(s) for s in sentinels])
    )
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    return df.withColumn(out, F.try_divide(total, F.size(vals)))


def safe_div(a, b) -> Column:
    """Ratio that is NULL for a zero or missing divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def log_cols(df: DataFrame, on: str) -> DataFrame:
    v = F.col(on).cast("double")
    return df.withColumn("log2", F.log2(v)).withColumn("log10", F.log10(v)).withColumn("log1p", F.log1p(v))


def normalize(df: DataFrame, on: str, out: str = "normalized") -> DataFrame:
    """(value - mean) / population deviation over the whole table."""
    m = df.agg(F.struct(F.avg(on).alias("m"), F.stddev_pop(on).alias("s"))).scalar()
    return df.withColumn(out, F.try_divide(F.col(on) - m["m"], m["s"]))


def floor_null(v, threshold) -> Column:
    """Values under the threshold count as missing."""
    return F.when(col(v) >= threshold, col(v))


def bucket(v, edges=(0, 1000), names=("none", "small", "large")) -> Column:
    """Size class: 0, up to the edge, above it."""
    v = col(v)
    return F.when(v <= edges[0], names[0]).when(v <= edges[1], names[1]).otherwise(names[2])


def ratio_correct(df: DataFrame, signal: str = "value", red: str = "red", floor: float = 0.2) -> DataFrame:
    """Signal over the red/signal ratio, the ratio being at least ``floor``."""
    s = F.col(signal).cast("double")
    r = F.try_divide(F.col(red).cast("double"), s)
    return df.withColumn("corrected", F.coalesce(F.try_divide(s, F.greatest(r, F.lit(floor))), F.lit(0.0)))


def to_16bit(df: DataFrame, on: str = "value") -> DataFrame:
    top = df.agg(F.max(on)).scalar()
    return df.withColumn("scaled", F.try_divide(F.col(on), top).cast("double") * 65535.0).withColumn(
        "scaled", F.floor("scaled").cast("bigint")
    )


# Spot colours and cell type codes.
WHITE, GREEN, PALE = "r=255;g=255;b=255", "r=51;g=255;b=51", "r=204;g=255;b=204"
MATURE, NEW, OTHER, MATTER = 0, 1, 4, 7
# Colour codes of exported spots.
EXPORT_COLORS = {"new": "-13421569", "old": "-52429", "both": "-3407668", "all": "-13369549"}


def spot_type(spots: DataFrame, fully_tracked: bool = True, color: str = "color", label: str = "label") -> DataFrame:
    """Type code of a spot; green spots only count in fully tracked sets."""
    c = F.col(color)
    if not fully_tracked:
        spots = spots.filter(~c.eqNullSafe(F.lit(GREEN)))
    kind = F.when(F.col(label) == "m", OTHER).when(c == WHITE, NEW)
    if fully_tracked:
        kind = kind.when(c == GREEN, NEW).when(c == PALE, MATTER)
    return spots.withColumn("cell_type", kind.otherwise(MATURE))


def class_weight(target) -> Column:
    """1.5 for the hard classes, 1 for the rest."""
    # Classes with the larger weight
    return F.when(col(target).isin(0, 1, 3, 4), 1.5).otherwise(1.0)


def spot_id(frame, series) -> Column:
    return F.format_string("0%s0%s", col(frame).cast("string"), col(series).cast("string"))


def equivalent_diameter(volume) -> Column:
    return F.pow(col(volume) * (6.0 / math.pi), F.lit(1.0 / 3.0))


def pct_change(value, control) -> Column:
    return 100.0 * F.try_divide(col(value) - col(control), col(control))


def asymmetry(df: DataFrame, left: str, right: str, whole: str) -> DataFrame:
    d = F.abs(F.col(left) - F.col(right))
    return df.withColumn("abs_diff", d).withColumn("scaled_diff", safe_div(d, whole))


# ---------------------------------------------------------------- boxes
def box_geometry(df: DataFrame, patch: dict, shift: dict | None = None) -> DataFrame:
    """Centre (rounded half to even, capped to the patch), shifted corners, volume."""
    shift = shift or {}
    for a, n in patch.items():
        df = df.withColumn(f"c{a}", F.least(F.bround((F.col(f"{a}0") + F.col(f"{a}1")) / 2.0), F.lit(n - 1)).cast("bigint"))
    sides = [F.col(f"{a}1") - F.col(f"{a}0") for a in patch]
    df = df.withColumn("box_volume", functools.reduce(operator.mul, sides))
    for a, s in shift.items():
        df = df.withColumn(f"{a}0", F.col(f"{a}0") + s).withColumn(f"{a}1", F.col(f"{a}1") + s)
    return df


def box_in_bounds(df: DataFrame, shape: dict) -> DataFrame:
    """``in_bounds`` and ``status``: -1 for a negative corner, NULL when the box
    runs over the far side, 1 otherwise."""
    inside = functools.reduce(
        operator.and_, [(F.col(f"{a}0") >= 0) & (F.col(f"{a}0") < F.col(f"{a}1")) & (F.col(f"{a}1") <= n) for a, n in shape.items()]
    )
    negative = functools.reduce(operator.or_, [(F.col(f"{a}{i}") < 0) for a in shape for i in (0, 1)])
    return df.withColumn("in_bounds", inside).withColumn("status", F.when(negative, -1).when(inside, 1))


def center_weight(df: DataFrame, patch: dict, scale: float = 0.8) -> DataFrame:
    """Mean over axes of a Gaussian with peak 1 in the patch centre."""
    parts = []
    for a, n in patch.items():
        pc = n / 2.0
        d = ((F.col(f"{a}0") + F.col(f"{a}1")) / 2.0 - pc) / (pc * scale)
        parts.append(F.exp(-d * d / 2.0))
    return df.withColumn("center_weight", functools.reduce(operator.add, parts) / float(len(parts)))


def filter_boxes(df: DataFrame, threshold: float = 0.9, coords: str | None = None) -> DataFrame:
    """Confident boxes that have mask voxels."""
    df = df.filter(F.col("score") > threshold)
    return df.filter(F.size(coords) > 0) if coords else df


def _window(a: str, half: float) -> tuple[Column, Column]:
    """Window of +-half around a centroid in one-based positions."""
    v = F.col(a).cast("double")
    return (v - half).cast("bigint") + 1, (v + half).cast("bigint") + 1


def crop_box(df: DataFrame, half: dict, shape: dict) -> DataFrame:
    """Window around a centroid, moved inward at either edge of the volume."""
    for a, h in half.items():
        lo, hi = _window(a, h)
        back = F.greatest(hi - shape[a], F.lit(0))
        lo, hi = lo - back, hi - back
        ahead = F.greatest(1 - lo, F.lit(0))
        df = df.withColumn(f"{a}0", lo + ahead).withColumn(f"{a}1", hi + ahead)
    return df


def crop_box_padded(df: DataFrame, half: dict, shape: dict) -> DataFrame:
    """Window cut at the volume edge, with the missing voxels as padding counts."""
    for a, h in half.items():
        lo, hi = _window(a, h)
        df = (
            df.withColumn(f"{a}_pad0", F.greatest(-lo, F.lit(0))).withColumn(f"{a}_pad1", F.greatest(hi - shape[a], F.lit(0)))
            .withColumn(f"{a}0", F.greatest(lo, F.lit(0))).withColumn(f"{a}1", F.least(hi, F.lit(shape[a])))
        )
    return df
