"""The training-data pipeline: toxicity, quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows to the shared folder and reads them back as the next one's
input.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from somagrid.llm import cotrain, secrets, toxicity  # noqa: E402
from somagrid.llm.near_dups import near_duplicates  # noqa: E402
from somagrid.llm.packing import pack_documents  # noqa: E402
from somagrid.llm.queries import WORD_BPE, table  # noqa: E402
from somagrid.session import cut  # noqa: E402


def _keep(docs: DataFrame, good: DataFrame) -> DataFrame:
    """One row of ``docs`` for each id in ``good``; rows without an id all stay."""
    listed = docs.filter("doc_id is not null").join(good.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return listed.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below its threshold."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, lexicon)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return cotrain.keep(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    groups = near_duplicates(docs, width=5, percent=80, whole_tiles=True)
    return _keep(docs, groups.filter("kept"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with owner-specific credentials replaced; widely copied examples stay."""
    return secrets.redact(secrets.with_rows(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, WORD_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Learned scores and a linear program are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
