"""Caller-supplied functions: per group or per batch of rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

def grouped(df: DataFrame, keys: list[str], partial: Callable, partial_schema: str, final: Callable, schema: str) -> DataFrame:
    """Grouped function in two steps, so that no group sits in one task.

    ``partial`` reduces the rows that a group has in one Arrow batch to a few
    (frame in, frame out) before anything is shuffled, ``final`` combines the
    reduced rows of the group.  Prefer built-in aggregates where they can say
    the same.
    """
    def reduce(batches):
        for pdf in batches:
            for _, rows in pdf.groupby(keys, dropna=False, sort=False):
                yield partial(rows)

    return df.mapInPandas(reduce, partial_schema).groupBy(*keys).applyInPandas(final, schema)


def grouped_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, count and largest value per group through :func:`grouped`."""
    t = dict(df.dtypes)[key]

    def partial(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [p[key].iloc[0]], "s": [p[value].sum()], "n": [p[value].count()], "top": [p[value].max()]})

    def final(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [p[key].iloc[0]], "value": [p["s"].sum() / p["n"].sum()], "n": [p["n"].sum()], "top": [p["top"].max()]})

    return grouped(df.select(key, value), [key], partial, f"{key} {t}, s double, n bigint, top double", final,
                   f"{key} {t}, value double, n bigint, top double")


def score_cells(crops: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], id_col: str, id_type: str = "string",
                scored: DataFrame | None = None) -> DataFrame:
    """Class and confidence of each crop from a caller's model function.

    ``fn`` takes a frame of crops and gives ``id, class, confidence``; it runs
    on Arrow batches.  Ids already in ``scored`` with a class other than -1 are
    skipped and kept, so a stopped run goes on where it was.
    """
    if scored is not None:
        done = scored.filter("class <> -1")
        crops = crops.join(done.select(id_col), id_col, "left_anti")

    def run(batches):
        for pdf in batches:
            yield fn(pdf)[[id_col, "class", "confidence"]]

    new = crops.mapInPandas(run, f"{id_col} {id_type}, class int, confidence double")
    return new if scored is None else done.select(id_col, "class", "confidence").unionByName(new)
