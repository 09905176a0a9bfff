"""Stages of the pipeline on a small table."""

import corpus_pipeline as C
from somagrid.session import cut
from test_texts import groups

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    columns = docs.columns
    seen = {}
    for name, stage in C.STAGES:
        before = docs
        docs = cut(stage(spark, docs, FOLDER))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    gone = ids(seen["toxicity"][0]) - ids(seen["toxicity"][1])
    told = [i for i in gone if i in labels]
    assert told and sum(labels[i]["toxic"] for i in told) >= 0.9 * len(told)
    gone = ids(seen["quality"][0]) - ids(seen["quality"][1])
    told = [i for i in gone if i in labels]
    assert told and sum(labels[i]["quality"] == 0 for i in told) >= 0.9 * len(told)
    before, after = seen["near_dedup"]
    want = {i for i, (_, c) in groups({r["doc_id"]: r["text"] for r in before.collect()}, 5).items() if i == c}
    assert ids(after) == want
    assert ids(seen["secrets"][0]) == ids(seen["secrets"][1]) == ids(seen["packing"][1])
