"""Queries on trace trees and skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from somagrid.operators import traces as R
from somagrid.registry import derived as D
from somagrid.registry.base import query

CHAIN = """chain AS (SELECT tree, cur_idx, parent AS ancestor, 1 AS step FROM trees WHERE parent >= 0 UNION ALL
   SELECT c.tree, c.cur_idx, t.parent, c.step + 1 FROM chain c JOIN trees t ON t.tree = c.tree AND t.cur_idx = c.ancestor WHERE t.parent >= 0)"""


@query("parent_chains", f"WITH RECURSIVE {CHAIN} SELECT tree, cur_idx, ancestor, step::BIGINT AS step FROM chain", "trees")
def parent_chains(spark, d):
    return R.parent_chains(D.trees(spark, d))


@query("tree_paths", f"""
  WITH RECURSIVE {CHAIN}, s AS (SELECT c.tree, c.cur_idx, max(step) AS depth, sum(t.len) AS path_length FROM chain c JOIN trees t ON t.tree = c.tree AND t.cur_idx = c.ancestor GROUP BY ALL)
  SELECT tree, cur_idx, coalesce(depth, 0)::BIGINT AS depth, coalesce(path_length, 0)::BIGINT AS path_length,
         row_number() OVER (PARTITION BY tree ORDER BY coalesce(path_length, 0), cur_idx) AS place FROM trees LEFT JOIN s USING (tree, cur_idx)""", "trees")
def tree_paths(spark, d):
    return R.tree_paths(D.trees(spark, d))


MERGED = """m AS (SELECT t.*, cur_idx + o AS mi, CASE WHEN parent < 0 THEN parent ELSE parent + o END AS mp FROM trees t JOIN
   (SELECT tree, CAST(sum(n) OVER (ORDER BY tree) - n AS BIGINT) AS o FROM (SELECT tree, count(*) AS n FROM trees GROUP BY tree)) USING (tree))"""


@query("merged_trees", f"WITH {MERGED} SELECT tree, cur_idx, mi AS merged_idx, mp AS merged_parent FROM m", "trees")
def merged_trees(spark, d):
    return R.merge_trees(D.trees(spark, d)).select("tree", "cur_idx", "merged_idx", "merged_parent")


@query("tree_edges", f"WITH {MERGED} SELECT mp AS parent, mi AS child FROM m WHERE mp >= 0", "trees")
def tree_edges(spark, d):
    return R.tree_edges(D.trees(spark, d))


SEGS = """segs AS (SELECT o_orderkey AS seg, o_orderkey % 16 AS s_z, o_custkey % 8 AS s_y, 0::BIGINT AS s_x, (o_orderkey // 3) % 16 AS e_z, (o_custkey + 3) % 16 AS e_y, 0::BIGINT AS e_x FROM orders)"""


@query("loops_dropped", f"""
  WITH {SEGS}, ends AS (SELECT DISTINCT c_custkey % 16 AS z, c_nationkey::BIGINT AS y, 0::BIGINT AS x FROM customer)
  SELECT seg, s_z, s_y, s_x, e_z, e_y, e_x FROM segs a WHERE EXISTS (SELECT 1 FROM segs b WHERE b.seg <> a.seg AND b.s_z = a.e_z AND b.s_y = a.e_y AND b.s_x = a.e_x)
     OR EXISTS (SELECT 1 FROM ends WHERE z = e_z AND y = e_y AND x = e_x)""")
def loops_dropped(spark, d):
    o = D.table(spark, d, "orders")
    zero = F.lit(0).cast("bigint")
    s = o.select(F.col("o_orderkey").alias("seg"), (F.col("o_orderkey") % 16).alias("s_z"), (F.col("o_custkey") % 8).alias("s_y"), zero.alias("s_x"),
                 F.expr("(o_orderkey div 3) % 16").alias("e_z"), ((F.col("o_custkey") + 3) % 16).alias("e_y"), zero.alias("e_x"))
    e = D.table(spark, d, "customer").select((F.col("c_custkey") % 16).alias("z"), F.col("c_nationkey").cast("bigint").alias("y"), zero.alias("x"))
    return R.drop_loops(s, e)


BODY = "body AS MATERIALIZED (SELECT DISTINCT z, y, x, (z // 8) * 16 + (y // 8) * 4 + x // 8 AS seg FROM cells)"
ENDS = "ends AS MATERIALIZED (SELECT DISTINCT z, y, x, (z // 8) * 16 + (y // 8) * 4 + x // 8 AS seg FROM cells WHERE vols > 500)"


@query("bridged_ends", f"""
  WITH {BODY}, {ENDS},
   tip AS MATERIALIZED (SELECT a.seg, a.z, a.y, a.x, b.seg AS other, min({{'l': greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)), 't': {{'z': b.z, 'y': b.y, 'x': b.x}}}}) AS m
     FROM ends a JOIN ends b ON a.seg <> b.seg AND b.z BETWEEN a.z - 4 AND a.z + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4 AND b.x BETWEEN a.x - 4 AND a.x + 4 GROUP BY ALL),
   bod AS (SELECT a.seg, a.z, a.y, a.x, b.seg AS other, min({{'l': (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2, 't': {{'z': b.z, 'y': b.y, 'x': b.x}}}}) AS m
     FROM ends a JOIN body b ON a.seg <> b.seg AND b.z BETWEEN a.z - 2 AND a.z + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL)
  SELECT seg, z, y, x, other, round(m.l::DOUBLE, 6) AS length, m.t.z AS to_z, m.t.y AS to_y, m.t.x AS to_x, 'end' AS kind FROM tip
  UNION ALL SELECT seg, z, y, x, other, round(sqrt(m.l), 6), m.t.z, m.t.y, m.t.x, 'body' FROM bod ANTI JOIN tip USING (seg, z, y, x, other)""", "cells")
def bridged_ends(spark, d):
    c = D.cells(spark, d)
    seg = F.expr("(z div 8) * 16 + (y div 8) * 4 + x div 8").alias("seg")
    b = R.bridge_ends(c.filter("vols > 500").select("z", "y", "x", seg), c.select("z", "y", "x", seg).distinct(), 2)
    return b.select("seg", "z", "y", "x", "other", "length", F.col("to.z").alias("to_z"), F.col("to.y").alias("to_y"), F.col("to.x").alias("to_x"), "kind")


@query("gaps_filled")
def gaps_filled(spark, d):
    return R.fill_gaps(D.cells(spark, d))


@query("distinct_coordinates", "SELECT DISTINCT z, y, x FROM cells", "cells")
def distinct_coordinates(spark, d):
    from somagrid.operators.reshape import distinct_coords

    return distinct_coords(D.cells(spark, d))
