"""Block files as a stream: resumable ingest, running region counts, track links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

VOXEL = ["z", "y", "x"]
#: Frames of a track whose ends are kept together in a stream's state.
FRAME_WIDTH = 4096
#: Second at which frame 0 stands for timers: a stream's clock starts at 0 and takes earlier frames for late ones.
CLOCK = 1 << 31


def _finish(query) -> None:
    query.awaitTermination()


def block_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def ingest_blocks(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, files_per_trigger: int | None = None) -> None:
    """Append new block files to a table and stop; blocks seen before are skipped by
    the checkpoint, so the call can be repeated."""
    s = block_stream(spark, folder, schema, files_per_trigger)
    _finish(s.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start(out))


def stream_region_counts(spark: SparkSession, folder: str, schema, atlas: DataFrame, out: str, checkpoint: str,
                         min_size: int = 30, large: int = 500, files_per_trigger: int | None = None) -> None:
    """Running cells per region over arriving blocks.

    The state holds one row per region.  Every batch writes the changed regions
    under its own batch number, so a repeated batch replaces itself;
    :func:`latest_counts` reads the newest row of each region.
    """
    cells = block_stream(spark, folder, schema, files_per_trigger).filter(F.col("vols") > min_size)
    n = cells.join(atlas.select(*VOXEL, "label"), VOXEL).filter("label > 0").groupBy("label").agg(
        F.count(F.lit(1)).alias("num"), F.count_if(F.col("vols") > large).alias("num_large"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _finish(n.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("label").agg(F.max_by(F.struct("num", "num_large"), "batch").alias("b")).select("label", "b.*")


def _joined(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between runs that follow each other without a gap, and the longer runs that they make.

    A run is a row (first frame, last frame, first position, last position); a link is (frame, displacement)."""
    runs = runs[np.lexsort(runs.T[::-1])]
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:, 0] > np.maximum.accumulate(runs[:, 1])[:-1]  # a frame that is known already counts once
    runs = runs[new]
    meet = runs[1:, 0] == runs[:-1, 1] + 1
    links = np.column_stack([runs[:-1, 1], runs[1:, 2:5] - runs[:-1, 5:8]])[meet]
    first, last = np.r_[True, ~meet][:len(runs)], np.r_[~meet, True][:len(runs)]
    return links, np.column_stack([runs[first, 0], runs[last, 1], runs[first, 2:5], runs[last, 5:8]])


def stream_tracks(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, files_per_trigger: int | None = None,
                  late_frames: int | None = None, width: int = FRAME_WIDTH) -> None:
    """Frame-by-frame links: each spot with its track's spot in the next frame, whichever arrives first.

    The state is kept per track and block of ``width`` frames and holds only the runs of frames without a gap: their ends, where a
    link may still come, and nothing of the spots between.  So it grows with tracks and gaps and not with spots, a frame may be
    as late as it likes, and a long track is spread over the blocks (the last frame of a block goes to the next one, too).
    With ``late_frames`` a timer forgets a block once the newest frame of all tracks is that far ahead of its last one; later
    frames of it are then left out.  A repeated frame of a track counts once: within a batch of rows the smallest position,
    else the one that came first.  Rows without series or frame are left out.
    """
    s = block_stream(spark, folder, schema, files_per_trigger).filter("series IS NOT NULL AND frame IS NOT NULL")
    kind = dict(s.dtypes)
    s = s.select("series", F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in VOXEL])
    home = F.floor(F.col("frame") / width)
    s = s.withColumn("_block", F.explode(F.when(F.pmod("frame", F.lit(width)) == width - 1, F.array(home, home + 1)).otherwise(F.array(home))))
    timer = "NoTimeout"
    if late_frames is not None:
        timer = "EventTimeTimeout"
        s = s.withColumn("_at", F.timestamp_seconds(F.col("frame") + CLOCK)).withWatermark("_at", f"{late_frames} seconds")

    def link(key, rows, state):
        if state.hasTimedOut:
            state.remove()
            return
        # frames count from the start of the block, so they are exact as doubles
        start = int(key[1]) * width
        runs = np.array(state.get[0] if state.exists else [], float).reshape(-1, 8)
        for pdf in rows:
            at, place = (pdf["frame"].to_numpy() - start).astype(float), pdf[VOXEL].to_numpy(float)
            fresh = np.column_stack([at, at, place, place])
            known = np.searchsorted(runs[:, 0], at, side="right") - 1
            old = (known >= 0) & (at <= runs[np.maximum(known, 0), 1]) if len(runs) else np.zeros(len(at), bool)
            links, runs = _joined(np.concatenate([runs, fresh[~old]]))
            if len(links):
                yield pd.DataFrame({"series": [key[0]] * len(links), "frame": links[:, 0].astype("int64") + start,
                                    **{f"d{c}": links[:, i + 1] for i, c in enumerate(VOXEL)}})
        state.update((runs.ravel().tolist(),))
        if late_frames is not None:
            last = int(runs[:, 1].max()) + start + CLOCK
            state.setTimeoutTimestamp(max((last + 1) * 1000, state.getCurrentWatermarkMs() + 1))

    links = s.groupBy("series", "_block").applyInPandasWithState(
        link, f"series {kind['series']}, frame long, dz double, dy double, dx double", "runs array<double>", "append", timer)
    links = links.withColumn("frame", F.col("frame").cast(kind["frame"]))
    _finish(links.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start(out))
