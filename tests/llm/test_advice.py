"""Places where an operator once did less than its whole job."""

from pyspark.sql import functions as F

from somagrid.llm import licences, notices, packing, secrets


def test_secret_of_two_sources(docs_of):
    """A keyword in one source, the bare value in another: a verdict in scan, replaced in both documents."""
    key = "Zx81Qw72Er63Ty54Ui45Op36"
    rows = [(1, f'password = "{key}"'), (2, f"see {key} there"), (3, "nothing")] + [(10 + i, "an Example0123456789Example0 here") for i in range(4)]
    docs = secrets.with_rows(docs_of(rows))
    added = {r["id"]: {(x["kind"], x["value"]) for x in r["added"]} for r in secrets.scan(docs).collect()}
    assert added[1] == added[2] == {("shared", key)} and added[3] == set() and added[10] == {("example", "Example0123456789Example0")}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[1] == 'password = "<secret>"' and clean[2] == "see <secret> there" and clean[10] == rows[3][1]


def test_secret_holders_by_both_counts(docs_of):
    """Four owners in one repository, or four repositories of one owner, make no example."""
    rows = [(i, "see Zx81Qw72Er63Ty54Ui45Op36 there") for i in range(4)]
    docs = secrets.with_rows(docs_of(rows)).withColumn("one", F.lit("x"))
    for names in ({"repo_col": "one"}, {"owner_col": "one"}):
        assert {x["kind"] for r in secrets.scan(docs, **names).collect() for x in r["added"]} == {"live"}
        assert {r["text"] for r in secrets.redact(docs, **names).collect()} == {"see <secret> there"}


def test_packing_short_texts(spark):
    """A table ruled by short texts fills its sequences; every piece is placed once, without gaps."""
    cuts = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 17).otherwise(33).cast("long").alias("length"),
        F.col("id").alias("ids_crc32"), F.lit(33).cast("long").alias("doc_tokens"))
    rows = packing.pack(cuts).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(6000))
    parts = {}
    for r in rows:
        parts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in parts.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY
    assert sum(r["length"] for r in rows) >= 0.98 * packing.CAPACITY * len(parts)


def test_licence_spans(docs_of):
    """Wrapped, embedded and whole licences; lines and whole texts count as before."""
    grant = notices.MIT.replace("\n", " ").split()
    wrapped = "\n".join("# " + " ".join(grant[i:i + 9]) for i in range(0, len(grant), 9))
    filler = "\n".join(f"plain words of line {i} about nothing" for i in range(60))
    rows = [(1, f"{filler}\n{wrapped}\n{filler}"), (2, " ".join(grant)), (3, "code Released under the MIT License. See the LICENSE file in the root"),
            (4, f"{filler}\n{notices.APACHE}\n{filler}"), (5, f"{filler} {notices.BSD} {filler}"), (6, f"{notices.GPL}\n{filler}"),
            (7, notices.NOTICES["GPL-3.0"][1]), (8, f"{filler}\n{notices.NOTICES['Apache-2.0'][1]}\n{filler}"), (9, filler), (10, "Released under the\nMIT License."),
            (11, f"{filler}\nReleased under the MIT License.\n{filler}")]
    got = {r["doc_id"]: (r["licence"], round(r["dice"], 3) if r["dice"] else None, r["n_units"]) for r in licences.match(docs_of(rows)).collect()}
    assert got[1] == got[2] == ("MIT-text", 1.0, 1) and got[3] == ("MIT", 1.0, 1) and got[4][0] == "Apache-2.0" and got[5] == ("BSD-3-Clause", 1.0, 1)
    assert got[6] == ("GPL-3.0", 1.0, 1) and got[7] == ("GPL-3.0", 1.0, 1) and got[8][0] == "Apache-2.0" and got[9] == (None, None, 0)
    assert got[10] == ("MIT", 1.0, 1) and got[11] == ("MIT", 1.0, 1)
