"""Brains and images that share positions are kept apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from somagrid.operators import boxes as B, components as C, regions as R, spatial as P, voxels as V
from test_space import AXES, flood, packed, rows


@pytest.fixture(scope="module")
def brains():
    """{brain: positions} over the same small volume."""
    rng = np.random.default_rng(41)
    return {b: sorted({tuple(int(v) for v in p) for p in rng.integers(0, 10, (n, 3))}) for b, n in (("a", 250), ("b", 120), ("c", 1))}


def table(spark, brains, **extra):
    flat = [(b, *p, *[f(b, p) for f in extra.values()]) for b, pts in brains.items() for p in pts]
    return spark.createDataFrame(flat, ["dataset", *AXES, *extra])


def test_components_by_brain(spark, brains):
    got = rows(C.label_components(table(spark, brains, n=lambda b, p: p[0]), 6, block=4, by=["dataset"]), "dataset", *AXES, "n", "component")
    want = {(b, *p, p[0], packed(r)) for b, pts in brains.items() for p, r in flood(pts, C.offsets(6)).items()}
    assert got == want
    lab = C.label_components(table(spark, brains), 6, out="label", by=["dataset"])
    size = {}
    for b, *_, root in want:
        size[b, root] = size.get((b, root), 0) + 1
    assert rows(V.object_props(lab, by=["dataset"]), "dataset", "label", "volume") == {(*k, n) for k, n in size.items()}


def test_positions_that_do_not_fit(spark):
    for bad in ((-1, 0, 0), (0, 1 << 21, 0)):
        df = spark.createDataFrame([bad], AXES)
        with pytest.raises(Exception, match="between 0 and"):
            C.label_components(df).collect()
        with pytest.raises(Exception, match="does not fit"):
            df.select(C.voxel_id()).collect()


def test_density_and_neighbours_by_brain(spark, brains):
    df = table(spark, brains)
    atlas = df.select("dataset").distinct().crossJoin(spark.createDataFrame([(z, y, x, 1) for z in range(10) for y in range(10) for x in range(10)], [*AXES, "label"]))
    whole = V.density_map(df, atlas, 3, shape=dict.fromkeys(AXES, 10), by=["dataset"])
    near = P.radius_count(df, df, 3, by=["dataset"])
    for b in brains:
        one = df.filter(F.col("dataset") == b).drop("dataset")
        plain = V.density_map(one, atlas.filter(F.col("dataset") == b).drop("dataset"), 3, shape=dict.fromkeys(AXES, 10))
        assert rows(whole.filter(F.col("dataset") == b), *AXES, "density") == rows(plain, *AXES, "density")
        assert rows(near.filter(F.col("dataset") == b), *AXES, "n_near") == rows(P.radius_count(one, one, 3), *AXES, "n_near")


def test_own_atlas(spark):
    cells = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 0, 0), ("c", 1, 0, 0)], ["dataset", *AXES])
    atlas = spark.createDataFrame([("a", 1, 0, 0, 5, 1), ("b", 1, 0, 0, 6, 2), ("b", 2, 0, 0, 6, 2)], ["dataset", *AXES, "label", "hemisphere"])
    assert rows(R.label_cells(cells, atlas, by=["dataset"]), "dataset", "label", "hemisphere") == {("a", 5, 1), ("b", 6, 2), ("c", None, None)}
    assert rows(R.region_volume(atlas, 1000.0, by=["dataset"]), "dataset", "ids", "vol_w") == {("a", 5, 1.0), ("b", 6, 2.0)}


def test_scores_per_image(spark):
    """An image with a double match, one with truth only, one with predictions only."""
    line = lambda i, lab, x0, x1: [(i, 0, 0, x, lab) for x in range(x0, x1)]
    truth = [*line("m", 1, 0, 10), *line("m", 2, 20, 24), *line("t", 1, 0, 5)]
    pred = [*line("m", 7, 0, 5), *line("m", 8, 5, 10), *line("m", 9, 40, 43), *line("p", 1, 0, 5)]
    t, p = (spark.createDataFrame(r, ["image", *AXES, "label"]) for r in (truth, pred))
    got = {r["image"]: r.asDict() for r in B.image_scores(t, p).collect()}
    assert [got["m"][c] for c in ("tp", "fp", "fn", "n_pairs", "mean_iou", "jaccard")] == [2, 1, 1, 2, 0.5, 10 / 17]
    assert [got["t"][c] for c in ("tp", "fp", "fn", "precision", "mean_iou", "sensitivity")] == [0, 0, 1, None, None, 0.0]
    assert [got["p"][c] for c in ("tp", "fp", "fn", "precision", "sensitivity")] == [0, 1, 0, 0.0, None]
    assert B.image_scores(t, p, min_size=4).filter("image = 'm'").first()["fn"] == 0
    assert rows(B.matched_ious(t, p), "image", "a", "b", "iou") == {("m", 1, 7, 0.5), ("m", 1, 8, 0.5)}
    total = B.pooled_scores(B.image_scores(t, p)).first()
    assert (total["n_images"], total["tp"], total["fp"], total["fn"], total["sensitivity"], total["precision"], total["mean_precision"]) == (3, 2, 2, 2, 0.5, 0.5, 2 / 3)


def test_field_overlay(spark):
    names = [*AXES, "d0", "d1", "d2"]
    base = spark.createDataFrame([(0, 0, x, 1.0, 2.0, float(x)) for x in range(4)], names)
    alt_field = spark.createDataFrame([(0, 0, 1, 9.0, 9.0, 9.0), (0, 0, 2, 8.0, 8.0, None), (0, 0, 3, 7.0, 7.0, 7.0), (0, 0, 5, 6.0, 6.0, 6.0)], names)
    alt = spark.createDataFrame([(0, 0, 1, 4), (0, 0, 2, 5), (0, 0, 3, 1), (0, 0, 5, 4)], [*AXES, "label"])
    ids = spark.createDataFrame([(4,), (5,), (5,)], "ids long")
    assert rows(R.overlay_field(base, alt_field, alt, ids), "x", "d0", "d2") == {(0, 1.0, 0.0), (1, 9.0, 9.0), (2, 8.0, 2.0), (3, 1.0, 3.0), (5, 6.0, 6.0)}


def test_field_overlay_broadcasts_no_voxels(spark):
    """The spots of an exploded atlas are more than Spark's estimate of them, so they stay shuffled."""
    names = [*AXES, "d0", "d1", "d2"]
    base = spark.createDataFrame([(0, 0, x, 1.0, 2.0, float(x)) for x in range(4)], names)
    line = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))
    alt = spark.range(1).select(F.lit(0).cast("bigint").alias("z"), F.lit(0).cast("bigint").alias("y"), line.alias("x")).withColumn("label", F.col("x"))
    got = R.overlay_field(base, base.withColumn("d2", F.col("d2") + 0.5), alt, spark.createDataFrame([(2,)], "ids long"))
    assert rows(got, "x", "d2") == {(0, 0.0), (1, 1.0), (2, 2.5), (3, 3.0)}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [z" not in plan and "BroadcastHashJoin" not in plan.split("LeftSemi")[0]
