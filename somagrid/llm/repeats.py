"""Removal of words in long passages that occurred before, by recompression.

Every text is renamed in rounds.  A round replaces runs of one name by a name
of (name, length), then splits the names by a bit of their hash into left and
right ones and replaces every left-right neighbourhood by a name of the pair.
Names are fingerprints of what they replace, so every task gives equal parts
the same name without asking.  A name inside a passage depends on a short
stretch around it only; the rounds carry that stretch along, with a
fingerprint of the name in it (``ctx``).  Equal windows therefore hold the same
inner names at the same places, whatever stands around them.

Spark then settles what repeats, in three exchanges:

1. whole texts: copies of a text are one text from here on;
2. each window is represented by the least inner name of the highest round it
   holds; names that occur at one place of one text only cannot lie in a
   repeat.  The others reveal the windows that may (``_ask_names``);
3. those windows are compared by a 96-bit name of their words; all but the
   first of a name are repeats (``_ask_windows``).

In both, a batch settles what it holds several times by itself and asks about
each name once, so a passage in a third of all rows costs one row a batch.

Order: by document id, nulls last, then by a hash of the text among documents
that share an id, then by place.  Defined results: null and empty texts have no
words; texts of fewer words than a window lose nothing; of rows alike in id and
text one counts as the first.  Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from somagrid.llm.common import WORD, hash_spans, mix, spans, text_chunks
from somagrid.session import cut

WINDOW = 20
ROUNDS = 2
_K = np.uint64(0x9E3779B97F4A7C15)


def _name(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return mix((mix(a + np.uint64(kind * int(_K) & 0xFFFFFFFFFFFFFFFF)) ^ b) * _K)


class Level:
    """Names of one round over texts that lie end to end.

    ``lo`` and ``hi``: the words a name depends on; beyond its text where it depends on the text's end."""

    def __init__(self, name, ctx, lo, hi, doc):
        self.name, self.ctx, self.lo, self.hi, self.doc = name, ctx, lo, hi, doc

    def following(self, first: np.ndarray, last: np.ndarray, number: int) -> Level:
        """The next round; ``first`` and ``last`` are the first word of each text and the one after its last."""
        before, after = first - 1, last + 1  # places no window reaches
        n, doc = len(self.name), self.doc
        new = np.r_[True, (self.name[1:] != self.name[:-1]) | (doc[1:] != doc[:-1])]
        s = np.flatnonzero(new)
        e = np.r_[s[1:], n]
        d = doc[s]
        count = (e - s).astype(np.uint64)
        prev, nxt = np.maximum(s - 1, 0), np.minimum(e, n - 1)
        run = np.where(count > 1, _name(self.name[s], count, 8 * number + 1), self.name[s])
        ctx = _name(_name(self.ctx[prev], _name(self.ctx[s], self.ctx[e - 1], 8 * number + 2) + count, 8 * number + 3), self.ctx[nxt], 8 * number + 4)
        opens, closes = np.r_[True, d[1:] != d[:-1]], np.r_[d[1:] != d[:-1], True]
        lo = np.where(opens, before[d], self.lo[prev])
        hi = np.where(closes, after[d], self.hi[nxt])

        left = (mix(run + np.uint64(number)) & np.uint64(1)).astype(bool)
        head = np.r_[left[:-1] & ~left[1:] & ~closes[:-1], False]
        kept = ~np.r_[False, head[:-1]]
        i = np.flatnonzero(kept)
        j, p = np.minimum(i + 1, len(run) - 1), np.maximum(i - 1, 0)
        h, toleft = head[i], ~left[i]  # a right name that stayed alone was fixed by the one before it
        side = np.where(toleft, p, j)
        name = np.where(h, _name(run[i], run[j], 8 * number + 5), run[i])
        around = np.where(toleft, _name(ctx[side], ctx[i], 8 * number + 6), _name(ctx[i], ctx[side], 8 * number + 7))
        at = d[i]
        return Level(name, around, np.where(toleft, np.where(opens[i], before[at], lo[p]), lo[i]),
                     np.where(toleft, hi[i], np.where(closes[i], after[at], hi[j])), at)


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the least value, the first on ties, of each non-empty range [a, b)."""
    width = b - a
    out = np.empty(len(a), np.int64)
    table, size = np.arange(len(values)), 1

    def better(x, y):
        return np.where(values[x] <= values[y], x, y)

    while True:
        here = (width >= size) & (width < 2 * size)
        if here.any():
            out[here] = better(table[a[here]], table[b[here] - size])
        if not (width >= 2 * size).any():
            return out
        table, size = better(table[:-size], table[size:]), 2 * size


def anchors(h: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor, place) of every window: the least inner name of the highest round of which the window holds any, and where it stands."""
    many = np.maximum(last - first - window + 1, 0)
    start = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    anchor, where = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    if not len(start):
        return start, anchor, where
    at = np.arange(len(h))
    level = Level(h, _name(h, h, 0), at, at + 1, doc)
    levels = [level]
    for k in range(1, rounds + 1):
        level = level.following(first, last, k)
        levels.append(level)
    todo = np.arange(len(start))
    for k, level in reversed(list(enumerate(levels))):
        below = lambda edge: np.cumsum(np.bincount(edge + 1, minlength=len(h) + 3))  # noqa: E731 - at x: names with an edge below x
        s = start[todo]
        a, b = below(level.lo)[s], below(level.hi)[s + window + 1]
        some = b > a
        place = _least(level.ctx, a[some], b[some])
        anchor[todo[some]], where[todo[some]] = level.ctx[place], place * (rounds + 1) + k
        todo = todo[~some]
        if not len(todo):
            break
    return start, anchor, where


def window_names(h: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 32 bits) of the words of the given windows, by doubling."""
    out = []
    for salt in (11, 12):
        level, size, at, got = _name(h, h, salt), 1, start.copy(), None
        while size <= window:
            if window & size:
                piece = level[at]
                got = piece if got is None else _name(got, piece, salt + 2)
                at = at + size
            if 2 * size <= window:
                level = _name(level[:-size], level[size:], salt + 4)
            size *= 2
        out.append(got)
    return out[0].astype(np.int64), (out[1] >> np.uint64(32)).astype(np.int64) - (1 << 31)


def _texts(batch: pa.RecordBatch, column: str = "text"):
    """(first row, word names, text numbers, first word and end of each text) for runs of whole texts."""
    for i, data, off in text_chunks(batch, column):
        s, e, doc = spans(data, off, WORD[data])
        edge = np.searchsorted(doc, np.arange(len(off)))
        yield i, hash_spans(data, s, e), doc, edge[:-1], edge[1:]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("key_id"),
                       F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def _ask_names(keyed: DataFrame, window: int, rounds: int) -> DataFrame:
    """(h1, names): the anchors of each text that occur at two places of distinct texts, or of one."""

    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            fresh = np.zeros(len(key), bool)
            fresh[np.unique(key, return_index=True)[1]] = True
            names, texts = [], []
            for i, h, doc, first, last in _texts(b):
                start, anchor, where = anchors(h, doc, first, last, window, rounds)
                owner = i + doc[start] if len(start) else start
                turn = np.r_[True, where[1:] != where[:-1]][:len(where)] & fresh[owner]
                names.append(anchor[turn])
                texts.append(owner[turn])
            if not names:
                continue
            name, text = np.concatenate(names), key[np.concatenate(texts)]
            order = np.lexsort((text, name))
            name, text = name[order].astype(np.int64), text[order]
            lead = np.r_[True, name[1:] != name[:-1]][:len(name)]
            many = np.bincount(np.cumsum(lead) - 1)[np.cumsum(lead) - 1] > 1 if len(name) else lead
            once = np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])][:len(name)]
            name, text, lead, many = name[once], text[once], lead[once], many[once]
            yield pa.RecordBatch.from_arrays([pa.array(~lead), pa.array(name), pa.array(text), pa.array(many)], ["sure", "name", "h1", "many"])

    def settle(batches):
        held = None  # a row of the last name, which may go on in the next batch, and whether the name is known to repeat
        for b in batches:
            sure, name, text, many = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(text[sure]), pa.array(name[sure])], ["h1", "name"])
            name, text, many = name[~sure], text[~sure], many[~sure]
            if not len(name):
                continue
            if held is not None:
                name, text, many = np.r_[held[0], name], np.r_[held[1], text], np.r_[held[2], many]
            lead = np.r_[True, name[1:] != name[:-1]]
            group = np.cumsum(lead) - 1
            s = np.flatnonzero(lead)
            hit = (np.minimum.reduceat(text, s) != np.maximum.reduceat(text, s)) | np.logical_or.reduceat(many, s)
            out = hit[group]
            held = (name[s[-1]:s[-1] + 1], text[s[-1]:s[-1] + 1], hit[-1:])
            yield pa.RecordBatch.from_arrays([pa.array(text[out]), pa.array(name[out])], ["h1", "name"])

    asked = keyed.select("h1", "text").mapInArrow(run, "sure boolean, name long, h1 long, many boolean")
    dealt = asked.repartition(F.when(F.col("sure"), F.col("h1")).otherwise(F.col("name"))).sortWithinPartitions("sure", "name", "h1")
    return dealt.mapInArrow(settle, "h1 long, name long").groupBy("h1").agg(F.collect_set("name").alias("names"))


def _later(w1: np.ndarray, w2: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which of the sorted rows (name, place) stand at another place than the first row of their name."""
    n = len(w1)
    lead = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])][:n]
    first = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    return np.logical_or.reduce([p != p[first] for p in place]) if n else lead


def _ask_windows(held: DataFrame, window: int, rounds: int) -> DataFrame:
    """(key_id, sub, found): for each text with a repeat, the ranges (start, count) of its windows that occur earlier.

    ``held``: (key_id, sub, text, names), in any order."""

    def run(batches):
        for b in batches:
            ids, sub = b.column(0).to_numpy(), b.column(1).to_numpy()
            names = np.unique(b.column(3).combine_chunks().flatten().to_numpy() if isinstance(b.column(3), pa.ChunkedArray) else b.column(3).flatten().to_numpy())
            owners, places, w1, w2 = [], [], [], []
            for i, h, doc, first, last in _texts(b, "text"):
                start, anchor, _ = anchors(h, doc, first, last, window, rounds)
                start = start[np.isin(anchor.astype(np.int64), names)]
                x, y = window_names(h, start, window)
                owners.append(i + doc[start] if len(start) else start)
                places.append(start - first[doc[start]] if len(start) else start)
                w1.append(x)
                w2.append(y)
            if not owners:
                continue
            owner, place, w1, w2 = (np.concatenate(x) for x in (owners, places, w1, w2))
            order = np.lexsort((place, sub[owner], ids[owner], w2, w1))
            again = np.zeros(len(owner), bool)
            again[order] = _later(w1[order], w2[order], ids[owner[order]], sub[owner[order]], place[order])
            # windows of a text stand in order, so a range is a run of neighbours that occur earlier in this batch
            at = np.flatnonzero(again)
            lead = np.r_[True, (owner[at][1:] != owner[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)][:len(at)]
            s = np.flatnonzero(lead)
            ask, sure = np.flatnonzero(~again), at[s]
            both = np.r_[ask, sure]
            count = np.r_[np.zeros(len(ask), np.int32), np.diff(np.r_[s, len(at)]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(count), pa.array(np.where(count > 0, 0, w1[both])), pa.array(np.where(count > 0, 0, w2[both]).astype(np.int32)),
                 pa.array(ids[owner[both]]), pa.array(sub[owner[both]]), pa.array(place[both].astype(np.int32))],
                ["count", "w1", "w2", "key_id", "sub", "place"])

    def settle(batches):
        lead = None  # the first row of the last name
        for b in batches:
            count, *row = (b.column(k).to_numpy() for k in range(6))
            known = count > 0
            ask = [x[~known] for x in row]
            if len(ask[0]):
                if lead is not None:
                    ask = [np.r_[x, y] for x, y in zip(lead, ask)]
                later = _later(*ask)
                at = np.flatnonzero(np.r_[True, (ask[0][1:] != ask[0][:-1]) | (ask[1][1:] != ask[1][:-1])])[-1]
                known[~known] = later if lead is None else later[1:]
                lead = [x[at:at + 1] for x in ask]
            out = pa.array(known)
            yield pa.RecordBatch.from_arrays([b.column(3).filter(out), b.column(4).filter(out), b.column(5).filter(out), pa.array(np.maximum(count, 1).astype(np.int32)).filter(out)],
                                             ["key_id", "sub", "place", "count"])

    asked = held.select("key_id", "sub", "text", "names").mapInArrow(run, "count int, w1 long, w2 int, key_id long, sub long, place int")
    dealt = asked.repartition(F.when(F.col("count") > 0, F.col("key_id")).otherwise(F.col("w1"))).sortWithinPartitions("count", "w1", "w2", "key_id", "sub", "place")
    found = dealt.mapInArrow(settle, "key_id long, sub long, place int, count int")
    return found.groupBy("key_id", "sub").agg(F.collect_list(F.struct("place", "count")).alias("found"))


def _cleaned(held: DataFrame, window: int) -> DataFrame:
    """(h1, h2, key_id, n_words, n_removed, kept): every text's kept words, joined by one space.  ``found``: ranges of repeated windows, or null."""

    def run(batches):
        for b in batches:
            found = b.column(4)
            text_of, ranges = found.offsets.to_numpy(), found.flatten()
            place, count = ranges.field("place").to_numpy(), ranges.field("count").to_numpy()
            text_of = text_of - text_of[0]
            for i, data, off in text_chunks(b, "text"):
                m = len(off) - 1
                s, e, doc = spans(data, off, WORD[data])
                edge = np.searchsorted(doc, np.arange(m + 1))
                a, z = text_of[i], text_of[i + m]
                owner = np.repeat(np.arange(m), np.diff(text_of[i:i + m + 1]))
                step = np.zeros(len(s) + 1, np.int64)
                np.add.at(step, edge[owner] + place[a:z], 1)
                np.add.at(step, edge[owner] + place[a:z] + count[a:z] + window - 1, -1)
                kept = np.cumsum(step)[:-1] == 0
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, s[kept], 1)
                np.add.at(cover, e[kept], -1)
                stays = np.cumsum(cover)[:-1] > 0
                gap = e[kept][e[kept] < off[doc[kept] + 1]]  # the byte after a word, unless the text ends there
                stays[gap] = True
                plain = data.copy()
                plain[gap] = 32
                raw, cuts = plain[stays].tobytes(), np.r_[0, np.cumsum(stays)][off]
                out = [raw[x:y].rstrip(b" ") for x, y in zip(cuts[:-1], cuts[1:])]
                n, stay = np.diff(edge), np.diff(np.r_[0, np.cumsum(kept)][edge])
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, m) for k in range(3)], pa.array(n), pa.array(n - stay), pa.array(out, pa.binary()).cast(pa.string())],
                                                 ["h1", "h2", "key_id", "n_words", "n_removed", "kept"])

    return held.select("h1", "h2", "key_id", "text", F.coalesce("found", F.array().cast("array<struct<place:int,count:int>>")).alias("found")).mapInArrow(
        run, "h1 long, h2 long, key_id long, n_words long, n_removed long, kept string")


def _removed(docs: DataFrame, window: int, id_col: str, text_col: str, rounds: int, shown) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row, ``kept`` as ``shown`` makes it from the kept words."""
    keyed = _keyed(docs, id_col, text_col)
    rows = keyed.groupBy("h1", "h2", "key_id", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    firsts = rows.groupBy("h1", "h2").agg(F.min("key_id").alias("key_id"))
    shared = firsts.groupBy("key_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key_id", F.lit(True).alias("many"))
    firsts = cut(firsts.join(shared, "key_id", "left").select("h1", "h2", "key_id", F.when(F.col("many"), F.col("h1")).otherwise(0).alias("sub")))

    named = firsts.join(_ask_names(keyed, window, rounds), "h1")
    key = ["h1", "h2", "key_id"]
    found = _ask_windows(keyed.drop("doc_id").join(named, key), window, rounds)
    marked = cut(firsts.join(found, ["key_id", "sub"], "left"))
    texts = _cleaned(keyed.drop("doc_id").join(marked, key), window).withColumn("kept", shown(F.col("kept"))).dropDuplicates(["h1", "h2"])
    one = rows.join(texts.withColumnRenamed("key_id", "first_id"), ["h1", "h2"])
    one = one.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    stays = (F.col("key_id") == F.col("first_id")) & (F.col("k") == 1) | (F.col("n_words") < window)
    return one.select("doc_id", "n_words", F.when(stays, F.col("n_removed")).otherwise(F.col("n_words")).alias("n_removed"), F.when(stays, F.col("kept")).otherwise(shown(F.lit(""))).alias("kept"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row's words without those in a window of ``window`` words that starts earlier as well."""
    return _removed(docs, window, id_col, text_col, rounds, lambda kept: kept)


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The columns of :func:`remove_repeats` with a digest of the kept words, made before rows move."""
    return _removed(docs, window, id_col, text_col, rounds, lambda kept: F.sha2(kept, 256)).withColumnRenamed("kept", "kept_sha256")
