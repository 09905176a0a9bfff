"""Conversation repair against a table over all states, row by row."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from somagrid.llm import queries as Q, repair

FOLDER = "/root/testdata/sf0.01"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FAULT = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, edits, repaired rows) by the least (cost, edits) of every (row, state), from the end.

    ``rows``: (role, text, must go, breaks off)."""
    n = len(rows)
    best = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        if i == n:
            base = {"": (0, "", []), "a": (0, "", [])}
        else:
            role, text, gone, cut = rows[i]
            base = {}
            for q in ("", "s", "u", "a"):
                ways = [(4 + best[i + 1][q][0], "D" + best[i + 1][q][1], best[i + 1][q][2])]
                if not gone:
                    to = q if role == "" else NEXT.get((q, role[0]))
                    if to is not None:
                        c, e, r = best[i + 1][to]
                        ways.append((3 * cut + c, "K" + e, [(role, text), *r]))
                    new = "assistant" if q == "u" else "user"
                    c, e, r = best[i + 1][new[0]]
                    ways.append((3 + 3 * cut + c, "R" + e, [(new, text), *r]))
                base[q] = min(ways, key=lambda w: w[:2])
        for q in ("", "s", "u", "a"):
            ways, state, ins = [], q, []
            for k in range(4):
                if state in base:
                    c, e, r = base[state]
                    ways.append((3 * k + c, "I" * k + e, ins + r))
                new = "assistant" if state == "u" else "user"
                ins, state = [*ins, (new, "")], new[0]
            best[i][q] = min(ways, key=lambda w: w[:2])
    return best[0][""]


def brute(table):
    """{conv_id: result} from (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            rows += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        count = dict(blank=0, duplicate=0, truncated=0)
        seen, marked = set(), []
        for turn, role, text in rows:
            solid = FAULT.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, fixed = cheapest(marked) if marked else (0, "", [])
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_conversations(spark):
    t = pq.read_table(f"{FOLDER}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pydict()
    assert result(Q.op13_conversation_repair(spark, FOLDER)) == brute(list(zip(*t.values())))


@pytest.fixture(scope="module")
def wild():
    """Odd roles, nulls everywhere, repeats, ties, and one conversation that is cut into many segments."""
    rng = np.random.default_rng(4)
    roles = ["user", "assistant", "system", "tool", "", None, "ulysses"]
    texts = ["Fine.", "Broken off", " \t", "", None, "Again!", "Ends? ", "é 漢 😀.", "x" * 3000]
    rows = []
    for conv in [*range(60), None, -3]:
        for _ in range(int(rng.integers(0, 12))):
            rows.append((conv, None if rng.random() < 0.1 else int(rng.integers(-2, 9)), roles[rng.choice(7, p=[.35, .3, .1, .1, .05, .05, .05])], texts[rng.integers(0, 9)]))
    rows += [rows[0]] * 5
    rows += [(1000, k, roles[rng.choice(4, p=[.45, .45, .05, .05])], f"{k} {texts[rng.choice([0, 0, 0, 0, 1, 2, 5])]}") for k in range(1500)]
    return rows


def test_wild(spark, wild):
    df = spark.createDataFrame(wild, "conv_id long, turn long, role string, text string")
    df = df.withColumn("conv", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("copies", F.lit(7)).withColumn("code", F.lit(0))
    assert result(repair.report(df)) == brute(wild)
    assert repair.report(df.limit(0)).count() == 0


def test_search():
    """Random letters against the table, as a whole and as a chain of segments."""
    rng = np.random.default_rng(8)
    role = dict(s="system", u="user", a="assistant", e="", x="tool")
    for _ in range(400):
        codes = "".join(rng.choice(list("suaexSUAEX--uaua"), int(rng.integers(0, 26))))
        rows = [(role.get(c.lower(), "user"), "", c == "-", c.isupper()) for c in codes]
        want = cheapest(rows)[:2]
        assert repair.search(codes) == want
        chain, i = repair.Chain(), 0
        while i < len(codes):
            k = int(rng.integers(1, 6))
            chain.add(repair.ways_of(codes[i:i + k]))
            i += k
        assert chain.result() == want
