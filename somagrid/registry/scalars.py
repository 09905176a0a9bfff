"""Queries on per-row geometry, filters and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from somagrid.functions import scalars as S
from somagrid.registry import derived as D
from somagrid.registry.base import query
from somagrid.registry.tabular import SPOTS


@query("global_positions", """
  SELECT cell_id, z + z // 16 * 100 AS z_global, y + x // 8 * 10 AS y_global, x + y // 8 * 1000 AS x_global FROM cells""", "cells")
def global_positions(spark, d):
    # block offsets hold y, x, z in that order
    off = F.array(F.expr("x div 8 * 10"), F.expr("y div 8 * 1000"), F.expr("z div 16 * 100"))
    return S.to_global(D.cells(spark, d).withColumn("xyz_offset", off)).select("cell_id", "z_global", "y_global", "x_global")


@query("crop_to_full", """
  SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, round_even(l_extendedprice / 100, 0) + 10 - 2 AS z_full, round_even(l_quantity / 2, 0) + 20 - 0 AS y_full,
         round_even(l_tax * 50, 0) + 30 - 1 AS x_full FROM lineitem""")
def crop_to_full(spark, d):
    c = D.table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey", (F.col("l_extendedprice") / 100).alias("z"), (F.col("l_quantity") / 2).alias("y"),
        (F.col("l_tax") * 50).alias("x"), *[F.lit(v).alias(n) for n, v in (("box_z", 10), ("box_y", 20), ("box_x", 30), ("over_z", 2), ("over_y", 0), ("over_x", 1))])
    return S.crop_to_full(c).select("l_orderkey", "line", "l_partkey", "z_full", "y_full", "x_full")


@query("volumes_um", "SELECT cell_id, round(vols / (1.152::DOUBLE / 5) / 1.152::DOUBLE, 6) AS vols_um FROM cells", "cells")
def volumes_um(spark, d):
    return S.add_vols_um(D.cells(spark, d), 1.152, 5).select("cell_id", "vols_um")


@query("atlas_positions", """
  SELECT cell_id, CAST(trunc((z - 3) / 2.0::DOUBLE + 1) AS BIGINT) AS z, CAST(trunc((y - 5) / 3.0::DOUBLE + 2) AS BIGINT) AS y, CAST(trunc((x - 5) / 3.0::DOUBLE + 2) AS BIGINT) AS x FROM cells""", "cells")
def atlas_positions(spark, d):
    return S.to_atlas_space(D.cells(spark, d), {"z": 2, "y": 3, "x": 3}, {"z": 3, "y": 5, "x": 5}, {"z": 1, "y": 2, "x": 2}).select("cell_id", "z", "y", "x")


@query("clamped_positions", "SELECT cell_id, greatest(least(z - 4, 15), 0) AS z, greatest(least(y, 19), 0) AS y, least(x - 9, 19) AS x FROM cells", "cells")
def clamped_positions(spark, d):
    c = D.cells(spark, d).withColumn("z", F.col("z") - 4).withColumn("x", F.col("x") - 9)
    return S.clamp(S.clamp(c, {"z": 16, "y": 20}), {"x": 20}, lower=False).select("cell_id", "z", "y", "x")


@query("reoriented_positions", "SELECT cell_id, y AS z, 39 - z % 40 AS y, 31 - x AS x FROM cells", "cells")
def reoriented_positions(spark, d):
    c = D.cells(spark, d).withColumn("z", F.col("z") % 40).select("cell_id", "z", "y", "x")
    return S.reorient(c, {"z": "y", "y": "z", "x": "x"}, ("y", "x"), {"y": 40, "x": 32})


@query("voxel_volume_isotropic", """
  SELECT label, round(count(*) * 125 / 1000.0, 6) AS mm3_e6 FROM (SELECT DISTINCT label, z, CAST(floor(y * 0.2304::DOUBLE) AS BIGINT) AS y, CAST(floor(x * 0.2304::DOUBLE) AS BIGINT) AS x
    FROM atlas WHERE label > 0) GROUP BY label""", "atlas")
def voxel_volume_isotropic(spark, d):
    f, res = S.isotropic_factor(1.152, 5)
    a = D.atlas(spark, d).filter("label > 0").select("label", *[F.floor(F.col(c) * F.lit(f[c])).alias(c) for c in "zyx"]).distinct()
    return a.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", (S.voxel_volume("n", res) * 1e6).alias("mm3_e6"))


@query("size_gates", "SELECT cell_id, vols FROM cells WHERE vols > 200 AND vols < 500", "cells")
def size_gates(spark, d):
    return S.size_filter(D.cells(spark, d), 200, 500).select("cell_id", "vols")


@query("row_means", """
  WITH w AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS a, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey END AS b, o_totalprice AS c FROM orders)
  SELECT o_orderkey, round(list_avg(list_filter([a::DOUBLE, b::DOUBLE, c::DOUBLE], lambda v: v <> 0 AND v <> -1)), 6) AS mean FROM w""")
def row_means(spark, d):
    o = D.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("a_6mos"),
        F.when(F.col("o_orderkey") % 4 == 0, -1).otherwise(F.col("o_orderkey")).alias("b_6mos"), F.col("o_totalprice").alias("c_6mos_x"))
    return S.row_mean(o, "6mos", "mean").select("o_orderkey", "mean")


@query("guarded_ratio", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, l_extendedprice, round(l_quantity / nullif(l_tax, 0), 6) AS ratio FROM lineitem")
def guarded_ratio(spark, d):
    return D.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey", "l_extendedprice", S.safe_div("l_quantity", "l_tax").alias("ratio"))


@query("log_values", "SELECT z, y, x, round(log2(value), 6) AS log2, round(log10(value), 6) AS log10, round(ln(1 + value), 6) AS log1p FROM voxels", "voxels")
def log_values(spark, d):
    return S.log_cols(D.voxels(spark, d), "value").select("z", "y", "x", "log2", "log10", "log1p")


@query("spot_types", f"""
  SELECT id, CASE WHEN label = 'm' THEN 4 WHEN color = 'r=255;g=255;b=255' THEN 1 WHEN color = 'r=51;g=255;b=51' THEN 1 WHEN color = 'r=204;g=255;b=204' THEN 7 ELSE 0 END::BIGINT AS cell_type
  FROM ({SPOTS})""", "tracks")
def spot_types(spark, d):
    return S.spot_type(_spots(spark, d)).select("id", "cell_type")


@query("spot_types_untracked", f"""
  SELECT id, CASE WHEN label = 'm' THEN 4 WHEN color = 'r=255;g=255;b=255' THEN 1 ELSE 0 END::BIGINT AS cell_type FROM ({SPOTS}) WHERE color <> 'r=51;g=255;b=51'""", "tracks")
def spot_types_untracked(spark, d):
    return S.spot_type(_spots(spark, d), fully_tracked=False).select("id", "cell_type")


def _spots(spark, d):
    from somagrid.registry.tabular import _spot_frame

    return _spot_frame(spark, d).select(F.col("ID").cast("bigint").alias("id"), F.col("LABEL").alias("label"), F.col("MANUAL_SPOT_COLOR").alias("color"))


@query("spot_ids", "SELECT series, frame, '0' || frame || '0' || series AS id FROM tracks", "tracks")
def spot_ids(spark, d):
    return D.tracks(spark, d).select("series", "frame", S.spot_id("frame", "series").alias("id"))


@query("class_weights", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 3, 4) THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM orders")
def class_weights(spark, d):
    return D.table(spark, d, "orders").select("o_orderkey", S.class_weight(F.col("o_orderkey") % 6).alias("weight"))


@query("equivalent_diameters", "SELECT label, round(pow(6 * count(*) / pi(), 1.0::DOUBLE / 3), 6) AS diameter FROM object_voxels GROUP BY label", "object_voxels")
def equivalent_diameters(spark, d):
    n = D.object_voxels(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", S.equivalent_diameter("n").alias("diameter"))


@query("box_geometry", """
  SELECT box, CAST(least(round_even((z0 + z1) / 2.0::DOUBLE, 0), 99) AS BIGINT) AS cz, CAST(least(round_even((y0 + y1) / 2.0::DOUBLE, 0), 31) AS BIGINT) AS cy,
         CAST(least(round_even((x0 + x1) / 2.0::DOUBLE, 0), 31) AS BIGINT) AS cx, (z1 - z0) * (y1 - y0) * (x1 - x0) AS box_volume, z0 + 7 AS z0, x1 + 9 AS x1 FROM boxes""", "boxes")
def box_geometry(spark, d):
    return S.box_geometry(D.boxes(spark, d), {"z": 100, "y": 32, "x": 32}, {"z": 7, "x": 9}).select("box", "cz", "cy", "cx", "box_volume", "z0", "x1")


@query("boxes_in_bounds", """
  WITH b AS (SELECT box, z0 - 2 AS z0, z1 - 2 AS z1, y0, y1, x0, x1 FROM boxes), i AS (SELECT *, z0 >= 0 AND z0 < z1 AND z1 <= 60 AND y0 >= 0 AND y0 < y1 AND y1 <= 32 AND x0 >= 0 AND x0 < x1 AND x1 <= 32 AS in_bounds FROM b)
  SELECT box, in_bounds, CASE WHEN least(z0, z1, y0, y1, x0, x1) < 0 THEN -1 WHEN in_bounds THEN 1 END::BIGINT AS status FROM i""", "boxes")
def boxes_in_bounds(spark, d):
    b = D.boxes(spark, d).withColumn("z0", F.col("z0") - 2).withColumn("z1", F.col("z1") - 2)
    return S.box_in_bounds(b, {"z": 60, "y": 32, "x": 32}).select("box", "in_bounds", "status")


@query("center_weights", """
  SELECT box, round((exp(-pow(((z0 + z1) / 2.0::DOUBLE - 8) / 6.4::DOUBLE, 2) / 2) + exp(-pow(((y0 + y1) / 2.0::DOUBLE - 16) / 12.8::DOUBLE, 2) / 2)
         + exp(-pow(((x0 + x1) / 2.0::DOUBLE - 16) / 12.8::DOUBLE, 2) / 2)) / 3, 6) AS center_weight FROM boxes""", "boxes")
def center_weights(spark, d):
    return S.center_weight(D.boxes(spark, d), {"z": 16, "y": 32, "x": 32}).select("box", "center_weight")


@query("confident_boxes", "SELECT box, round(score, 6) AS score FROM boxes WHERE score > 0.9 AND patch > 0", "boxes")
def confident_boxes(spark, d):
    b = D.boxes(spark, d).withColumn("coords", F.array_repeat(F.lit(1), F.col("patch").cast("int")))
    return S.filter_boxes(b, 0.9, "coords").select("box", "score")


def _window(a: str, h: float) -> tuple[str, str]:
    return f"(CAST(trunc({a} - {h}::DOUBLE) AS BIGINT) + 1)", f"(CAST(trunc({a} + {h}::DOUBLE) AS BIGINT) + 1)"


def _shifted(a: str, h: float, n: int) -> str:
    lo, hi = _window(a, h)
    back = f"greatest({hi} - {n}, 0)"
    ahead = f"greatest(1 - ({lo} - {back}), 0)"
    return f"{lo} - {back} + {ahead} AS {a}0, {hi} - {back} + {ahead} AS {a}1"


def _padded(a: str, h: float, n: int) -> str:
    lo, hi = _window(a, h)
    return f"greatest({lo}, 0) AS {a}0, least({hi}, {n}) AS {a}1, greatest(-{lo}, 0) AS {a}_pad0, greatest({hi} - {n}, 0) AS {a}_pad1"


@query("crop_windows", f"SELECT cell_id, {_shifted('z', 3, 24)}, {_shifted('y', 5.5, 32)}, {_shifted('x', 5, 32)} FROM cells", "cells")
def crop_windows(spark, d):
    return S.crop_box(D.cells(spark, d), {"z": 3, "y": 5.5, "x": 5}, {"z": 24, "y": 32, "x": 32}).select("cell_id", *[f"{a}{i}" for a in "zyx" for i in (0, 1)])


@query("padded_crop_windows", f"SELECT cell_id, {_padded('z', 3, 24)}, {_padded('y', 5.5, 32)}, {_padded('x', 5, 32)} FROM cells", "cells")
def padded_crop_windows(spark, d):
    c = S.crop_box_padded(D.cells(spark, d), {"z": 3, "y": 5.5, "x": 5}, {"z": 24, "y": 32, "x": 32})
    return c.select("cell_id", *[f"{a}{s}" for a in "zyx" for s in ("0", "1", "_pad0", "_pad1")])
