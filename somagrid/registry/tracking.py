"""Queries on cell tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from somagrid.operators import tracks as T
from somagrid.registry import derived as D
from somagrid.registry.base import query

# spots without the odd frames of every third series, so that tracks have gaps
GAPPED = "SELECT * FROM tracks WHERE NOT (series % 3 = 0 AND frame % 2 = 1)"


def _gapped(spark, d):
    return D.tracks(spark, d).filter("NOT (series % 3 = 0 AND frame % 2 = 1)")


@query("track_edges", f"""
  SELECT series, source, target FROM (SELECT series, frame AS source, lead(frame) OVER (PARTITION BY series ORDER BY frame) AS target FROM ({GAPPED}))
  WHERE target IS NOT NULL""", "tracks")
def track_edges(spark, d):
    return T.track_edges(_gapped(spark, d))


@query("births_deaths", f"""
  WITH g AS ({GAPPED}), n AS (SELECT series, frame, lead(frame) OVER w AS nf, lag(frame) OVER w AS pf FROM g WINDOW w AS (PARTITION BY series ORDER BY frame)),
   f AS (SELECT series, frame, frame > (SELECT min(frame) FROM g) AND NOT coalesce(pf = frame - 1, false) AS is_new,
                frame < (SELECT max(frame) FROM g) AND nf IS NULL AS is_terminated FROM n)
  SELECT * FROM f WHERE is_new OR is_terminated""", "tracks")
def births_deaths(spark, d):
    return T.births_deaths(_gapped(spark, d))


@query("track_summary", f"""
  SELECT series, count(*) AS length, min(frame) AS first_frame, max(frame) AS last_frame, max(frame) - min(frame) + 1 AS span FROM ({GAPPED}) GROUP BY series""", "tracks")
def track_summary(spark, d):
    return T.track_summary(_gapped(spark, d))


@query("track_class", """
  WITH s AS (SELECT series, min(frame) AS a, max(frame) AS b FROM tracks GROUP BY series), g AS (SELECT min(a) AS lo, max(b) AS hi FROM s)
  SELECT series, CASE WHEN a > lo AND b < hi THEN 'both' WHEN a > lo THEN 'new' WHEN b < hi THEN 'old' ELSE 'all' END AS track_class FROM s, g""", "tracks")
def track_class(spark, d):
    return T.track_class(D.tracks(spark, d))


@query("moving_average", """
  SELECT series, frame, round(average, 6) AS average FROM (SELECT series, frame, avg(mean_intensity) OVER w AS average, count(*) OVER w AS n FROM tracks
    WINDOW w AS (PARTITION BY series ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""", "tracks")
def moving_average(spark, d):
    return T.moving_average(D.tracks(spark, d), ["series"], "frame", "mean_intensity", 5, width=16)


@query("repeats_dropped", """
  SELECT series, frame, color, z FROM (SELECT series, frame, color, z // 16 AS z, lag(color) OVER w AS pc, lag(z // 16) OVER w AS pz,
    row_number() OVER w AS i FROM tracks WINDOW w AS (PARTITION BY series ORDER BY frame)) WHERE i = 1 OR NOT (color = pc AND z = pz)""", "tracks")
def repeats_dropped(spark, d):
    t = D.tracks(spark, d).select("series", "frame", "color", F.expr("z div 16").alias("z"))
    return T.drop_repeats(t, ["series"], "frame", ["color", "z"])


@query("linked_frames", f"""
  WITH g AS ({GAPPED}) SELECT a.series, a.frame, b.z - a.z AS dz, b.y - a.y AS dy, b.x - a.x AS dx FROM g a JOIN g b ON a.series = b.series AND b.frame = a.frame + 1""", "tracks")
def linked_frames(spark, d):
    return T.link_frames(_gapped(spark, d)).select("series", "frame", "dz", "dy", "dx")


LINKS = """l AS MATERIALIZED (SELECT a.series, a.frame, a.z, a.y, a.x, b.z - a.z AS dz, b.y - a.y AS dy, b.x - a.x AS dx
   FROM tracks a JOIN tracks b ON a.series = b.series AND b.frame = a.frame + 1)"""
CROP, SCALES = {"z": 40, "y": 160, "x": 160}, [0.5, 1.0, 2.0]


def _level(i: int, s: float) -> str:
    box = " AND ".join(
        f"l.{a} >= CAST(trunc(t.{a} - {c * (1 + s) / 2.0}::DOUBLE) AS BIGINT) AND l.{a} < CAST(trunc(t.{a} + {c * (1 + s) / 2.0}::DOUBLE) AS BIGINT)" for a, c in CROP.items())
    return f"WHEN {box} THEN {i}"


PREDICT = f"""{LINKS},
   p AS MATERIALIZED (SELECT t.series, t.frame, t.z, t.y, t.x, l.dz, l.dy, l.dx, CASE {' '.join(_level(i, s) for i, s in enumerate(SCALES))} END AS lv
         FROM tracks t JOIN l ON l.frame = t.frame),
   c AS (SELECT series, frame, count(*) FILTER (lv <= 0) AS c0, count(*) FILTER (lv <= 1) AS c1, count(*) FILTER (lv <= 2) AS c2 FROM p GROUP BY ALL),
   f AS (SELECT series, frame, CASE WHEN c0 >= 4 THEN 0 WHEN c1 >= 4 THEN 1 WHEN c2 >= 4 THEN 2 END AS scale_index FROM c),
   m AS (SELECT series, frame, scale_index, z, y, x, count(*) AS n_tracked, median(dz) AS mz, median(dy) AS my, median(dx) AS mx FROM p JOIN f USING (series, frame)
         WHERE lv <= scale_index GROUP BY ALL),
   pred AS (SELECT series, frame, CAST(trunc(z + mz) AS BIGINT) AS pred_z, CAST(trunc(y + my) AS BIGINT) AS pred_y, CAST(trunc(x + mx) AS BIGINT) AS pred_x,
            n_tracked, scale_index::BIGINT AS scale_index FROM m)"""


@query("predicted_positions", f"WITH {PREDICT} SELECT * FROM pred", "tracks")
def predicted_positions(spark, d):
    return T.predict_next(D.tracks(spark, d), CROP, SCALES)


@query("link_errors", f"""
  WITH {PREDICT}, e AS (SELECT p.series, p.frame, sqrt((t.z - pred_z) ** 2 + (t.y - pred_y) ** 2 + (t.x - pred_x) ** 2) AS error
     FROM pred p JOIN tracks t ON t.series = p.series AND t.frame = p.frame + 1)
  SELECT series, frame, round(error, 6) AS error, error > 100 AS flagged FROM e""", "tracks")
def link_errors(spark, d):
    return T.link_errors(D.tracks(spark, d), CROP, SCALES, 100.0)


CANDS = """cand AS (SELECT series AS cand, frame, z, (y + 5) % 512 AS y, x, CAST(trunc(mean_intensity * 10) AS BIGINT) AS size FROM tracks),
   near AS MATERIALIZED (SELECT a.frame, a.series AS cell, b.cand, sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS distance
     FROM tracks a JOIN cand b ON b.frame = a.frame + 1 AND (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 3600)"""


def _cand(spark, d):
    t = D.tracks(spark, d)
    return t.select(F.col("series").alias("cand"), "frame", "z", ((F.col("y") + 5) % 512).alias("y"), "x",
                    (F.col("mean_intensity") * 10).cast("bigint").alias("size"))


def _cells(spark, d):
    return D.tracks(spark, d).withColumnRenamed("series", "cell")


@query("associated_cells", f"""
  WITH {CANDS}, b AS (SELECT frame, cell, min({{'d': distance, 'c': cand}}) AS b FROM near GROUP BY ALL)
  SELECT frame, cell, b.b.c AS cand, round(b.b.d, 6) AS distance FROM b""", "tracks")
def associated_cells(spark, d):
    return T.associate(_cells(spark, d), _cand(spark, d), 60.0)


@query("resolved_claims")
def resolved_claims(spark, d):
    return T.resolve_claims(T.candidate_links(_cells(spark, d), _cand(spark, d), 60.0))


@query("new_tracks", f"""
  WITH {CANDS}, f AS (SELECT c.frame, c.cand FROM cand c WHERE size > 100 AND NOT EXISTS (SELECT 1 FROM near n WHERE n.frame + 1 = c.frame AND n.cand = c.cand)),
   r AS (SELECT cand, count(*) AS n FROM f GROUP BY cand)
  SELECT f.frame, f.cand, CAST((SELECT max(series) FROM tracks) + 1 + coalesce((SELECT sum(n) FROM r r2 WHERE r2.cand < f.cand), 0) AS BIGINT) AS series FROM f""", "tracks")
def new_tracks(spark, d):
    links = T.candidate_links(_cells(spark, d), _cand(spark, d), 60.0, only="cand")
    return T.new_tracks(_cand(spark, d), links, D.tracks(spark, d), 100)


@query("size_guard", """
  WITH s AS (SELECT a.series, a.frame, CAST(trunc(a.mean_intensity * 10) AS BIGINT) AS size, CAST(trunc(b.mean_intensity * 10) AS BIGINT) AS next_size
     FROM tracks a JOIN tracks b ON a.series = b.series AND b.frame = a.frame + 1)
  SELECT series, frame FROM s WHERE NOT (next_size > 2 * size AND (size > 500 OR next_size > 800))""", "tracks")
def size_guard(spark, d):
    t = D.tracks(spark, d).withColumn("size", (F.col("mean_intensity") * 10).cast("bigint"))
    return T.size_guard(T.link_frames(t, ["size"])).select("series", "frame")


# voxels of a cell: a small cross around its position
CROSS = "(SELECT unnest([0, 1, -1, 0, 0]) AS oy, unnest([0, 0, 0, 1, -1]) AS ox)"
COARSE = "SELECT series, frame, z // 16 AS z, y // 16 AS y, x // 16 AS x FROM tracks"


def _coarse(spark, d):
    return D.tracks(spark, d).select("series", "frame", *[F.expr(f"{a} div 16").alias(a) for a in "zyx"])


def _cross(t):
    steps = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    return t.withColumn("_o", F.explode(steps)).select("series", "frame", "z", (F.col("y") + F.col("_o.y")).alias("y"), (F.col("x") + F.col("_o.x")).alias("x"))


@query("double_links", f"""
  WITH t AS ({COARSE}), v AS (SELECT series, frame, z, y + oy AS y, x + ox AS x FROM t, {CROSS}),
   c AS (SELECT DISTINCT frame - 1 AS frame, z, y, x FROM t)
  SELECT frame, z, y, x, count(DISTINCT series) AS n_cells FROM v JOIN c USING (frame, z, y, x) GROUP BY ALL HAVING count(DISTINCT series) > 1""", "tracks")
def double_links(spark, d):
    t = _coarse(spark, d)
    return T.double_links(_cross(t), t.select((F.col("frame") - 1).alias("frame"), "z", "y", "x").distinct())


@query("compared_tracks", f"""
  WITH t AS ({COARSE}), u AS (SELECT series + 7 AS series, frame, z, y, x FROM t WHERE series % 4 <> 0),
   seg AS (SELECT DISTINCT frame, z, y, x, z * 10000 + (y // 4) * 100 + x // 4 AS segment FROM t),
   a AS (SELECT frame, segment, max(series) AS s1 FROM t JOIN seg USING (frame, z, y, x) GROUP BY ALL),
   b AS (SELECT frame, segment, max(series) AS s2 FROM u JOIN seg USING (frame, z, y, x) GROUP BY ALL),
   j AS MATERIALIZED (SELECT * FROM a JOIN b USING (frame, segment)),
   m AS (SELECT s1, s2 FROM j WHERE {{'f': frame, 's': segment}} = (SELECT min({{'f': k.frame, 's': k.segment}}) FROM j k WHERE k.s1 = j.s1)
         AND {{'f': frame, 's': segment}} = (SELECT min({{'f': k.frame, 's': k.segment}}) FROM j k WHERE k.s2 = j.s2)),
   l AS (SELECT series, count(*) AS n FROM t GROUP BY series), r AS (SELECT series, count(*) AS n FROM u GROUP BY series)
  SELECT s1, s2, l.n AS length_1, r.n AS length_2, l.n - r.n AS difference FROM m JOIN l ON l.series = s1 JOIN r ON r.series = s2""", "tracks")
def compared_tracks(spark, d):
    t = _coarse(spark, d)
    u = t.filter("series % 4 <> 0").withColumn("series", F.col("series") + 7)
    seg = t.select("frame", "z", "y", "x", F.expr("z * 10000 + (y div 4) * 100 + x div 4").alias("segment")).distinct()
    return T.compare_tracks(t, u, seg)
