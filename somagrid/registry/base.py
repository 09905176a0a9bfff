"""Registry of queries over the given tables.

A query is a function ``(spark, folder) -> DataFrame``; its SQL twin names the
derived tables it needs, which are put in front as CTEs.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, functions as F, types as T

from somagrid.registry.derived import with_tables

QUERIES: dict = {}
ORACLES: dict = {}

MODULES = [
    "brains", "groups", "scalars", "spatial", "volumes", "objects", "tracking", "traces", "tiles", "tabular", "perbrain",
]


def tidy(df: DataFrame) -> DataFrame:
    """Long integers and doubles rounded to six places, for a stable comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, uses: str = ""):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(uses, sql)
        return fn

    return add


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"somagrid.registry.{m}")
