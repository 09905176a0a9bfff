"""Shared steps of the two vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

QUERY_STEP = 20


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id whose vector is neither null nor empty and has only finite components; extra columns go."""
    t = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return t.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(sound, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's list column as rows; all lists have the same length."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def copies(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, ids): of rows with equal vectors only the ``k`` + 1 smallest ids, which are all a top ``k`` can use.

    Ranked in salted parts first, so a vector that a third of all rows share is not ranked in one task."""
    salted = rows.select(*key, "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("_s"))
    near = salted.withColumn("_n", F.row_number().over(W.partitionBy(*key, "_s").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    near = near.groupBy(*key, "_s").agg(F.collect_list("vec_id").alias("_i"))
    return near.groupBy(*key).agg(F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("_i")))), 1, k + 1).alias("ids"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ties to the smaller id, ranked from 1."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
