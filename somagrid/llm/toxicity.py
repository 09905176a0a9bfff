"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, reported speech,
other).  Small transducers rewrite a clause's class sequence: one marks insults
and threats after a word of reported speech, one those after a negation, one
those near a target.  Their composition is one table; a clause's score is the
weight of its path, so ``you idiot`` counts more than ``idiot`` and ``not an
idiot`` less.  Words inside a clause never count across its end.

Insult words and stems (a stem accepts any suffix) and their weights are
learned from labelled documents: smoothed log odds of document frequencies,
kept where the surplus in toxic documents is far from chance.  The training
sample is bounded by ``TRAIN_ROWS`` labelled rows, taken in hash order.  A
document's score is the logistic of ``BIAS`` plus the clause scores, each
distinct insult once at its best.

Null or wordless texts score as if nothing matched.  Labels that are null or
without a document are not used; without any usable label only the fixed
words count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from somagrid.llm.common import LOWER, hash_spans, spans, text_chunks
from somagrid.session import cut

TRAIN_ROWS = 20000
LEXICON_LIMIT = 4000
STEMS = (4, 5, 6, 7)
SURPLUS = 0.0
PURITIES, STEM_PURITY = (0.98, 0.9, 0.75, 0.5), 0.9
BIAS = -5.0
THRESHOLD = 0.3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Small closed word classes in four languages.
FIXED = {
    INSULT: "idiot moron imbecile scum dumbass scumbag arschloch idioten connard salope pendejo gilipollas".split(),
    THREAT: "kill hurt strangle murder töten umbringen tuer matar".split(),
    TARGET: "you your yourself he she they du dich ihr sie tu toi vous il elle tú usted él ella".split(),
    NEGATION: "not never no nobody isn ain nicht kein keine nie pas jamais nunca jamás".split(),
    REPORT: "said says wrote writes claimed quoted sagte schrieb dit écrit dijo escribió".split(),
}
FIXED_WEIGHT = 5.0
FACTOR = {"": 1.0, "t": 1.2, "n": 0.7, "r": 0.7}
_KIND = np.uint8


def _marker(trigger: int, mark: str, reach: int) -> dict:
    """Transducer over (class, marks): for ``reach`` words after ``trigger`` it adds ``mark`` to insults and threats."""
    arcs = {}
    for state in range(reach + 1):
        for c in range(6):
            nxt = reach if c == trigger else max(0, state - 1)
            arcs[state, c] = (nxt, mark if state and c in (INSULT, THREAT) else "")
    return arcs


def compose(machines: list[dict]) -> dict:
    """Product of transducers that read the same classes: (state, class) -> (state, factor)."""
    start = (0,) * len(machines)
    number, todo, table = {start: 0}, [start], {}
    while todo:
        at = todo.pop()
        for c in range(6):
            moves = [m[s, c] for m, s in zip(machines, at)]
            to = tuple(x for x, _ in moves)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            factor = 1.0
            for _, mark in moves:
                factor *= FACTOR[mark]
            table[number[at], c] = (number[to], factor)
    return table


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """The composed machine as tables [state, class] of the next state and of the factor."""
    table = compose([_marker(REPORT, "r", 12), _marker(NEGATION, "n", 3), _marker(TARGET, "t", 4)])
    n = 1 + max(s for s, _ in table)
    nxt, factor = np.zeros((n, 6), np.int32), np.ones((n, 6))
    for (s, c), (to, f) in table.items():
        nxt[s, c], factor[s, c] = to, f
    return nxt, factor


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_STOP = np.zeros(256, np.int32)
_STOP[[10, 33, 46, 58, 59, 63, 124]] = 1


def letters(data: np.ndarray, off: np.ndarray):
    """Letter runs in lower case (ASCII and Latin-1): (bytes, start, end, text number, clause number)."""
    low = LOWER[data]
    lead = np.flatnonzero(low[:-1] == 0xC3) + 1
    up = lead[(low[lead] >= 0x80) & (low[lead] <= 0x9E) & (low[lead] != 0x97)]
    low[up] += 0x20
    inside = _LETTER[low]
    dash = np.flatnonzero((low[:-2] == 0xE2) & (low[1:-1] == 0x80))
    for k in range(3):
        inside[dash + k] = False
    s, e, doc = spans(low, off, inside)
    return low, s, e, doc, np.cumsum(_STOP[low])[s] if len(low) else s


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.r_[0, np.cumsum([len(w) for w in raw])].astype(np.int64)
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]) if raw else np.zeros(0, np.uint64)


def _stem_hashes(low, s, e):
    """For each stem length: hashes of the first bytes of the words that are longer, and which words these are."""
    for k in STEMS:
        long = np.flatnonzero(e - s > k)
        yield k, long, hash_spans(low, s[long], s[long] + k)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          limit: int = TRAIN_ROWS, usable: Column | None = None) -> list[tuple[str, int, float]]:
    """Lexicon of (word or stem, stem length or 0, weight) from a bounded sample of labelled documents."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = cut(rows)  # at most ``limit`` rows
    known = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(rows), "_id"))

    def count(batches):
        for b in batches:
            y = b.column(2).to_numpy(zero_copy_only=False)
            for i, data, off in text_chunks(b, "_text"):
                low, s, e, doc, _ = letters(data, off)
                sets = [(0, np.arange(len(s)), hash_spans(low, s, e)), *_stem_hashes(low, s, e)]
                text = low.tobytes()
                for k, who, h in sets:
                    if not len(h):
                        continue
                    pair = np.unique(np.stack([doc[who].astype(np.uint64), h]), axis=1, return_index=True)
                    d, hh, at = pair[0][0].astype(np.int64), pair[0][1], who[pair[1]]
                    _, first, inv = np.unique(hh, return_index=True, return_inverse=True)
                    bad = np.bincount(inv, weights=y[i + d] == 1).astype(np.int64)
                    n = np.bincount(inv)
                    size = e[at[first]] if k == 0 else s[at[first]] + k
                    word = [text[a:z].decode("utf-8", "replace") for a, z in zip(s[at[first]].tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.full(len(word), k, np.int32)), pa.array(bad), pa.array(n - bad)],
                                                     ["word", "stem", "toxic", "clean"])

    counts = cut(known.mapInArrow(count, "word string, stem int, toxic long, clean long").groupBy("word", "stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    base = rows.agg(F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    bad, good = (base["t"] or 0) + 1, (base["n"] or 0) - (base["t"] or 0) + 1
    odds = F.log((F.col("toxic") + 0.5) / bad) - F.log((F.col("clean") + 0.5) / good)
    # chance that a word of so many toxic documents and no other is innocent, against the number of words tried
    luck = np.log(max(counts.count(), 1)) + SURPLUS
    rare = -np.log(bad / (bad + good))
    pure = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    picked = counts.withColumn("weight", odds).withColumn("pure", F.when((F.col("stem") > 0) & (pure < STEM_PURITY), 0.0).otherwise(pure)).filter(
        (F.col("toxic") * F.lit(float(rare)) >= F.lit(float(luck))) & (F.col("pure") >= min(PURITIES)) & ~F.col("word").contains("�"))
    rows_ = picked.orderBy(F.desc(F.col("toxic") * F.col("weight")), "word", "stem").limit(LEXICON_LIMIT).collect()
    best, least = [], None
    for p in PURITIES:  # of the lexicons, the one with the fewest wrong documents in the sample
        own = [(r["word"], r["stem"], float(r["weight"])) for r in rows_ if r["pure"] >= p]
        told = score(known.select("_id", "_text"), own, "_id", "_text").join(F.broadcast(rows), F.col("id") == F.col("_id"))
        wrong = told.filter((F.col("score") >= THRESHOLD) != (F.col("_y") == 1)).count()
        if least is None or wrong < least:
            best, least = own, wrong
    return best


def _scorer(lexicon: list[tuple[str, int, float]]):
    """Function from (bytes, offsets) to the scores and the numbers of matched clauses of whole texts."""
    learned = {0: {}, **{k: {} for k in STEMS}}
    for w, k, x in lexicon:
        learned[k][w] = min(x, 6.0)
    kinds = {w: c for c, ws in FIXED.items() for w in ws}
    for w in FIXED[INSULT] + FIXED[THREAT]:
        learned[0].setdefault(w, FIXED_WEIGHT)
    every = sorted({*learned[0], *kinds})
    tables = {}
    for k in (0, *STEMS):
        own = every if k == 0 else sorted(learned[k])
        h = _hash_words(own)
        o = np.argsort(h)
        kind = np.array([INSULT if w in learned[k] and kinds.get(w) != THREAT else kinds.get(w, INSULT) for w in own], _KIND)
        tables[k] = (h[o], kind[o] if len(own) else kind, np.array([learned[k].get(w, 0.0) for w in own])[o] if len(own) else np.zeros(0))

    nxt, factor = grammar()

    def rate(data: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        total, clauses = np.zeros(n), np.zeros(n, np.int64)
        low, s, e, doc, clause = letters(data, off)
        h = hash_spans(low, s, e)
        kind, weight = np.zeros(len(s), _KIND), np.zeros(len(s))
        for k, who, hk in [(0, np.arange(len(s)), h), *_stem_hashes(low, s, e)]:
            th, tk, tw = tables[k]
            if not len(th) or not len(hk):
                continue
            at = np.minimum(np.searchsorted(th, hk), len(th) - 1)
            hit = np.flatnonzero(th[at] == hk)
            if k:
                hit = hit[tw[at[hit]] > weight[who[hit]]]
            kind[who[hit]], weight[who[hit]] = tk[at[hit]], tw[at[hit]]
        # clauses as runs of equal (text, clause); those with an insult or a threat are walked
        new = np.ones(len(s), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (clause[1:] != clause[:-1])
        first = np.r_[np.flatnonzero(new), len(s)]
        hot = np.unique(np.searchsorted(first, np.flatnonzero((kind == INSULT) | (kind == THREAT)), side="right") - 1)
        best: dict = {}
        for c in hot.tolist():
            state, a, z = 0, int(first[c]), int(first[c + 1])
            d = int(doc[a])
            for x, (what, w) in enumerate(zip(kind[a:z].tolist(), weight[a:z].tolist()), a):
                if w > 0:
                    word = (d, int(h[x]))
                    best[word] = max(best.get(word, 0.0), w * factor[state, what])
                state = nxt[state, what]
            clauses[d] += 1
        for (d, _), x in best.items():
            total[d] += x
        return 1 / (1 + np.exp(-np.clip(BIAS + total, -30, 30))), clauses

    return rate


def score(docs: DataFrame, lexicon: list[tuple[str, int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clauses): score from 0 to 1 and the number of matched clauses of every whole text."""

    def run(batches):
        rate = _scorer(lexicon)
        for b in batches:
            for i, data, off in text_chunks(b, text_col):
                p, clauses = rate(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(p)), pa.array(p), pa.array(clauses)], ["id", "score", "clauses"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, score double, clauses long")


def keep(docs: DataFrame, lexicon: list[tuple[str, int, float]], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, with all their columns; nothing is shuffled."""

    def run(batches):
        rate = _scorer(lexicon)
        for b in batches:
            for i, data, off in text_chunks(b, text_col):
                p, _ = rate(data, off)
                yield b.slice(i, len(p)).filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
