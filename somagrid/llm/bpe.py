"""Byte-pair encoding and decoding with a transducer lexicon.

The corpus' most frequent words, counted over all texts, are compiled into a
minimal acyclic transducer: words share prefixes and suffixes, the outputs on
a path add up to the word's number, and the number leads to its ids.  Tasks
memory-map the compiled file and look all distinct words of a batch up
together, one byte per step.  Words outside the lexicon are merged exactly, in
the order of the merge ranks, again for all distinct words of a batch at once.

Null counts as empty text (no ids).  Texts may be of any length.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from somagrid.llm.common import mix

LEXICON_WORDS = 32768
CHUNK_CHARS = 1 << 20
WIDE = 48
STORE_WORDS = 1_000_000
_K = np.uint64(0x9E3779B97F4A7C15)
SPACE, LETTER, DIGIT, OTHER, SPECIAL = 0, 1, 2, 3, 4
#: Endings split off behind an apostrophe, in the vocabulary's rule.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte, as byte-level vocabularies spell them."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    out = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


@functools.cache
def unicode_tables() -> tuple[np.ndarray, np.ndarray, int]:
    """(kind, lower case, first differing code point) of every code point, as the vocabulary's own library sees them.

    Unicode versions differ in what is a letter or has a lower case.  Classes of assigned code points are stable, so
    the library is asked about blanks and about what Python's version does not know yet; the planes 4 to 13 hold nothing."""
    kind = np.full(0x110000, OTHER, np.uint8)
    ask = []
    for i in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)):
        what = unicodedata.category(chr(i))
        if what == "Cn" or chr(i).isspace():
            ask.append(i)
        elif what[0] in "LN":
            kind[i] = LETTER if what[0] == "L" else DIGIT
    point, every = np.array(ask), "".join(map(chr, ask))
    for what, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, z) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            kind[point[a:z]] = what
    fold = np.arange(0x110000, dtype=np.uint32)
    new = [c for c in every if not c.isspace()]
    for c, x in zip(new, normalizers.Lowercase().normalize_str("\n".join(new)).split("\n")):
        fold[ord(c)] = ord(x) if len(x) == 1 else ord(c)
    changed = np.flatnonzero(fold != np.arange(0x110000))
    return kind, fold, int(changed[0]) if len(changed) else 0x110000


class Vocabulary:
    """Ids, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.ids = j["model"]["vocab"]
        self.end = j["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.merges = []
        for m in j["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.append((self.ids[a], self.ids[b], self.ids[a + b]))


class Encoder:
    """Splits texts into words and words into ids, many at a time."""

    def __init__(self, v: Vocabulary, lexicon: bytes | None = None):
        self.special = v.special
        self.by_code = {0x110000 + k: i for k, i in enumerate(v.special.values())}
        self.code = {s: 0x110000 + k for k, s in enumerate(v.special)}
        self.find_special = re.compile("|".join(re.escape(s) for s in v.special)) if v.special else None
        spell = byte_alphabet()
        self.inner = np.array([v.ids[c] for c in spell], np.int32)
        self.last = np.array([v.ids[c + v.end] for c in spell], np.int32)
        a, b, c = np.array(v.merges, np.int64).T
        rank = np.arange(len(a))
        self.rank_of = {(int(x), int(y)): (int(r), int(z)) for x, y, r, z in zip(a, b, rank, c)}
        key = (a << 20) | b
        o = np.argsort(key)
        self.key, self.rank, self.made = key[o], rank[o].astype(np.int32), c.astype(np.int32)
        self._slots()
        plain, self.fold, self.first_fold = unicode_tables()
        kind = np.full(0x110000 + 1 + len(v.special), OTHER, np.uint8)
        kind[:len(plain)] = plain
        kind[0x110000:] = SPECIAL
        self.kind = kind
        self.lexicon = Lexicon.open(lexicon) if lexicon else None
        self.age = 0
        self.forget()

    def _slots(self, bits: int = 20):
        """Open table of the merges' keys; what falls into a taken slot is found by search."""
        self.bits = np.uint64(64 - bits)
        slot = ((self.key.astype(np.uint64) * _K) >> self.bits).astype(np.int64)
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.zeros(1 << bits, np.int32)
        self.slot_key[slot], self.slot_rank[slot] = self.key, self.rank
        lost = self.slot_key[slot] != self.key
        self.more_key, self.more_rank = self.key[lost], self.rank[lost]
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[lost]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of id pairs, a large number where there is none."""
        key = (left.astype(np.int64) << 20) | right
        slot = ((key.astype(np.uint64) * _K) >> self.bits).astype(np.int64)
        none = np.int32(2**31 - 1)
        out = np.where(self.slot_key[slot] == key, self.slot_rank[slot], none)
        hard = np.flatnonzero((out == none) & self.crowded[slot] & (left >= 0) & (right >= 0))
        if len(hard) and len(self.more_key):
            at = np.minimum(np.searchsorted(self.more_key, key[hard]), len(self.more_key) - 1)
            hit = self.more_key[at] == key[hard]
            out[hard[hit]] = self.more_rank[at[hit]]
        return out

    def merge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes and bounds, by exact merging: (ids of all words, bounds)."""
        size = off[1:] - off[:-1]
        grid = np.zeros(len(data) + 1, np.int32)
        count = np.zeros(len(size), np.int64)
        for lo, hi in ((0, 8), (8, 16), (16, WIDE)):
            pick = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(pick), 4096):
                self._merge_rows(data, off, pick[k:k + 4096], hi, grid, count)
        for i in np.flatnonzero(size > WIDE):
            own = self._merge_long(data[off[i]:off[i + 1]].tobytes())
            grid[off[i]:off[i] + len(own)], count[i] = own, len(own)
        bound = np.r_[0, np.cumsum(count)]
        return grid[np.arange(bound[-1]) + np.repeat(off[:-1] - bound[:-1], count)], bound

    def _merge_rows(self, data, off, part, width, grid, count):
        """Words of at most ``width`` bytes as rows of a matrix; each step merges the best pair of every row."""
        size = off[part + 1] - off[part]
        col = np.arange(width)
        inside = col < size[:, None]
        at = np.where(inside, off[part][:, None] + col, 0)
        flat = data[at]
        sym = np.where(col == size[:, None] - 1, self.last[flat], self.inner[flat])
        sym[~inside] = -1
        none = np.int32(2**31 - 1)
        rank = np.full(sym.shape, none, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        rank[r, c] = self.ranks(sym[r, c], sym[r, c + 1])
        left = size.copy()
        row = np.arange(len(part))
        ids, done, live_sym, live_rank = sym, row, sym, rank
        while True:
            best = live_rank.argmin(axis=1)
            low = live_rank[row, best]
            go = low < none
            if not go.all():
                ids[done] = live_sym
                done, live_sym, live_rank, best, low = done[go], live_sym[go], live_rank[go], best[go], low[go]
                row = np.arange(len(done))
                if not len(done):
                    break
            new = self.made[low]
            shift = col[None, :-1] > best[:, None]
            block, rk = live_sym.copy(), live_rank.copy()
            block[:, :-1][shift] = live_sym[:, 1:][shift]
            rk[:, :-1][shift] = live_rank[:, 1:][shift]
            block[:, -1], rk[:, -1] = -1, none
            block[row, best] = new
            left[done] -= 1
            rk[row, best] = none
            has = np.flatnonzero(best + 1 < left[done])
            rk[has, best[has]] = self.ranks(new[has], block[has, best[has] + 1])
            has = np.flatnonzero(best > 0)
            rk[has, best[has] - 1] = self.ranks(block[has, best[has] - 1], new[has])
            live_sym, live_rank = block, rk
        keep = col < left[:, None]
        grid[np.where(inside, at, len(data))[keep]] = ids[keep]
        count[part] = left

    def _merge_long(self, w: bytes) -> np.ndarray:
        """One long word: a heap of candidate pairs over a linked list."""
        sym = [int(self.inner[b]) for b in w[:-1]] + [int(self.last[w[-1]])]
        n = len(sym)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = []

        def offer(i):
            j = after[i]
            if j < n and (got := self.rank_of.get((sym[i], sym[j]))):
                heap.append((got[0], i, sym[i], sym[j], got[1])) if not started else heapq.heappush(heap, (got[0], i, sym[i], sym[j], got[1]))

        started = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if gone[i] or sym[i] != a or after[i] >= n or sym[after[i]] != b:
                continue
            j = after[i]
            sym[i], gone[j], after[i] = made, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s, g in zip(sym, gone) if not g], np.int32)

    def codes(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Normalised code points of all texts, each followed by a blank, and the texts' bounds."""
        parts, size, plain = [], [], []

        def flush():
            if plain:
                parts.append(np.frombuffer((" ".join(plain) + " ").encode("utf-32-le", "surrogatepass"), np.uint32))
                plain.clear()

        def normal(s: str) -> str:
            return s.lower() if s.isascii() else unicodedata.normalize("NFC", s).replace("Σ", "σ").lower()

        for t in texts:
            t = t or ""
            if "<|" in t and self.find_special and self.find_special.search(t):
                flush()
                own, at = [], 0
                for m in self.find_special.finditer(t):
                    own.append(np.frombuffer(normal(t[at:m.start()]).encode("utf-32-le"), np.uint32))
                    own.append(np.array([self.code[m[0]]], np.uint32))
                    at = m.end()
                own.append(np.frombuffer((normal(t[at:]) + " ").encode("utf-32-le"), np.uint32))
                parts.extend(own)
                size.append(sum(map(len, own)))
            else:
                s = normal(t)
                plain.append(s)
                size.append(len(s) + 1)
        flush()
        code = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        high = np.flatnonzero((code >= self.first_fold) & (code < 0x110000))
        if len(high):
            if not code.flags.writeable:
                code = code.copy()
            code[high] = self.fold[code[high]]
        return code, np.r_[0, np.cumsum(size)].astype(np.int64)

    def split(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the words: letters together, digits and special strings alone, others together, endings after an apostrophe."""
        n = len(code)
        kind = self.kind[code]
        start = np.empty(n, bool)
        start[:1] = True
        start[1:] = kind[1:] != kind[:-1]
        alone = (kind == DIGIT) | (kind == SPECIAL)
        start |= alone
        quote = np.flatnonzero(code == 39)
        if len(quote):
            quote = quote[start[quote]]
            taken = np.zeros(len(quote), bool)
            for end in ENDINGS:
                hit = ~taken & (quote + len(end) < n)
                for k, ch in enumerate(end, 1):
                    hit[hit] = code[quote[hit] + k] == ord(ch)
                taken |= hit
                at = quote[hit]
                start[at + 1] = False
                start[at + len(end) + 1] |= kind[np.minimum(at + len(end) + 1, n - 1)] == LETTER
        s = np.flatnonzero(start & (kind != SPACE))
        stop = np.flatnonzero(start | (kind == SPACE))
        nxt = np.searchsorted(stop, s, side="right")
        e = np.where(nxt < len(stop), stop[np.minimum(nxt, max(len(stop) - 1, 0))], n)
        return s, e

    def forget(self):
        """Empty the store of known words."""
        self.known, self.number_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bound = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.age += 1

    def encode(self, texts: list):
        """Words of the texts as numbers into the store of known words, and the bounds of each text's words.

        ``self.ids`` and ``self.bound`` hold the ids of the known words; new words are added, and the store
        starts anew when it is large, so memory stays bounded."""
        if len(self.known) > STORE_WORDS:
            self.forget()
        code, off = self.codes(texts)
        if len(code) == 0:
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        s, e = self.split(code)
        h, first, number = np.unique(_hash_codes(code, s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != h
        if new.any():
            flat, bound = self._ids(code, s[first[new]], e[first[new]])
            base = len(self.bound) - 1
            self.ids = np.concatenate([self.ids, flat])
            self.bound = np.r_[self.bound, self.bound[-1] + bound[1:]]
            self.number_of = np.insert(self.number_of, at[new], base + np.arange(int(new.sum())))
            self.known = np.insert(self.known, at[new], h[new])
            at = np.searchsorted(self.known, h)
        return self.number_of[at][number], np.searchsorted(s, off)

    def _ids(self, code, s, e):
        """Ids of words given as spans of code points."""
        special = code[s] >= 0x110000
        data, off = utf8(code, s, e)
        if self.lexicon is not None:
            rank = self.lexicon.find(data, off)
        else:
            rank = np.full(len(s), -1, np.int64)
        rest = np.flatnonzero((rank < 0) & ~special)
        size = off[1:] - off[:-1]
        flat, bound = self.merge(expand(data, off, rest), np.r_[0, np.cumsum(size[rest])])
        count = np.zeros(len(s), np.int64)
        count[rest] = bound[1:] - bound[:-1]
        seen = np.flatnonzero((rank >= 0) & ~special)
        if len(seen):
            count[seen] = (self.lexicon.bound[1:] - self.lexicon.bound[:-1])[rank[seen]]
        count[special] = 1
        out = np.r_[0, np.cumsum(count)]
        ids = np.zeros(int(out[-1]), np.int32)
        put = lambda w, v: ids.__setitem__(np.arange(len(v)) + np.repeat(out[w] - np.r_[0, np.cumsum(count[w])[:-1]], count[w]), v)
        if len(rest):
            put(rest, flat)
        if len(seen):
            put(seen, expand(self.lexicon.ids, self.lexicon.bound, rank[seen]))
        for w in np.flatnonzero(special):
            ids[out[w]] = self.by_code[int(code[s[w]])]
        return ids, out


def utf8(code: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of spans of code points, and their bounds (special strings count as one blank)."""
    bound = np.r_[0, np.cumsum(e - s)]
    own = code[np.arange(bound[-1]) + np.repeat(s - bound[:-1], e - s)]
    own = np.where(own >= 0x110000, np.uint32(32), own)
    size = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
    data = np.frombuffer(own.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return data, np.r_[0, np.cumsum(size)][bound]


def expand(flat: np.ndarray, bound: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Concatenated ids of a sequence of word numbers."""
    size = (bound[1:] - bound[:-1])[number]
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return flat[np.arange(total) - np.repeat(stop - size - bound[number], size)]


def _hash_codes(code: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    pad = np.concatenate([code, np.zeros(2, np.uint32)])
    at = np.ndarray(shape=(len(code) + 1,), dtype="<u8", buffer=pad.data, strides=(4,))
    length = e - s
    h = mix(length.astype(np.uint64) + _K)
    live, k = np.arange(len(s)), 0
    while len(live):
        rest = length[live] - k
        block = at[s[live] + k]
        block = np.where(rest == 1, block & np.uint64(0xFFFFFFFF), block)
        h[live] = mix((h[live] ^ block) * _K)
        live = live[rest > 2]
        k += 2
    return h


def word_batches(batch: pa.RecordBatch, column: str):
    """Rows of a batch in slices of about a million characters: (first row, texts)."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS or j == len(texts) - 1:
            yield i, texts[i:j + 1]
            i, size = j + 1, 0


class Lexicon:
    """A minimal acyclic transducer from words to id lists, as arrays of one memory-mapped file."""

    FIELDS = ("arc", "goto", "out", "final", "bound", "ids")
    TYPES = {"arc": np.int64, "goto": np.int32, "out": np.int32, "final": np.uint8, "bound": np.int32, "ids": np.int32}

    def __init__(self, arrays: dict):
        self.__dict__.update(arrays)

    @staticmethod
    def compile(words: list[bytes], ids: np.ndarray, bound: np.ndarray) -> bytes:
        """``words`` distinct and sorted.  States are merged as soon as they are complete, so suffixes are shared."""
        known: dict = {}
        path: list = [[False, []]]
        prev = b""

        def freeze(node) -> int:
            return known.setdefault((node[0], tuple(node[1])), len(known))

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                node = path.pop()
                path[-1][1].append((prev[len(path) - 1], freeze(node)))

        for w in words:
            same = 0
            while same < min(len(w), len(prev)) and w[same] == prev[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(w) - same))
            path[-1][0] = True
            prev = w
        close(0)
        root = freeze(path[0])
        states = list(known)
        count, arc, goto, out, final = [], [], [], [], []
        for k, (last, arcs) in enumerate(states):
            total = int(last)
            final.append(int(last))
            for b, to in arcs:
                arc.append(k * 256 + b)
                goto.append(to)
                out.append(total)
                total += count[to]
            count.append(total)
        arrays = {"arc": arc, "goto": goto, "out": out, "final": final, "bound": bound, "ids": ids}
        parts = [np.asarray(arrays[f], Lexicon.TYPES[f]).tobytes() for f in Lexicon.FIELDS]
        head = json.dumps([root, *map(len, parts)]).encode().ljust(256)
        return head + b"".join(p.ljust(-(-len(p) // 8) * 8, b"\0") for p in parts)

    @staticmethod
    def open(blob: bytes) -> "Lexicon":
        """Write the compiled file to the task's own unnamed file and map it."""
        f = tempfile.TemporaryFile()
        f.write(blob)
        f.flush()
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        root, *sizes = json.loads(m[:256])
        at, arrays = 256, {"root": root, "map": m}
        for name, size in zip(Lexicon.FIELDS, sizes):
            arrays[name] = np.frombuffer(m, Lexicon.TYPES[name], size // Lexicon.TYPES[name]().itemsize, at)
            at += -(-size // 8) * 8
        return Lexicon(arrays)

    def find(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of each word (bytes and bounds), -1 where the lexicon has none; all words step together."""
        n = len(off) - 1
        rank = np.full(n, -1, np.int64)
        if n == 0 or len(self.arc) == 0:
            return rank
        at, size = off[:-1], off[1:] - off[:-1]
        state, total = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live, k = np.flatnonzero(size > 0), 0
        while len(live):
            key = state[live] * 256 + data[at[live] + k]
            pos = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[pos] == key
            live, pos = live[hit], pos[hit]
            state[live] = self.goto[pos]
            total[live] += self.out[pos]
            k += 1
            done = size[live] == k
            end = live[done]
            end = end[self.final[state[end]] == 1]
            rank[end] = total[end]
            live = live[~done]
        return rank


def count_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; each task adds its words up before they are shuffled."""

    def count(batches):
        e = Encoder(Vocabulary(path))
        words: dict = {}

        def send():
            b = pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.binary()), "n": pa.array(words.values(), pa.int64())})
            words.clear()
            return b

        for b in batches:
            for _, texts in word_batches(b, text_col):
                code, _ = e.codes(texts)
                if not len(code):
                    continue
                s, t = e.split(code)
                _, first, n = np.unique(_hash_codes(code, s, t), return_index=True, return_counts=True)
                text = code.tobytes()
                for a, z, k in zip(s[first].tolist(), t[first].tolist(), n.tolist()):
                    if code[a] < 0x110000:
                        w = text[4 * a:4 * z].decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                        words[w] = words.get(w, 0) + k
                if len(words) > 400_000:
                    yield send()
        if words:
            yield send()

    return docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, path: str, text_col: str = "text", limit: int = LEXICON_WORDS) -> bytes:
    """Compiled lexicon of the ``limit`` most frequent words of all texts (ties by spelling); its size is bounded by ``limit``."""
    rows = count_words(docs, path, text_col).filter(F.length("word") <= WIDE).orderBy(F.desc("n"), "word").limit(limit).collect()
    words = sorted(bytes(r["word"]) for r in rows)
    data, off = np.frombuffer(b"".join(words), np.uint8), np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    return Lexicon.compile(words, *Encoder(Vocabulary(path)).merge(data, off))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: bytes | None = None) -> DataFrame:
    """(id, ids array): ids of every text.  One row per input row; null text gives an empty array."""
    lex = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        e = Encoder(Vocabulary(path), lex.value)
        for b in batches:
            for i, texts in word_batches(b, text_col):
                number, at = e.encode(texts)
                own = [expand(e.ids, e.bound, number[x:y]) for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(texts)), pa.array(own, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """(id, text): ids back to text as the tokens' spellings joined by blanks."""

    def run(batches):
        names = Vocabulary(path).names
        for b in batches:
            text = [" ".join(names[i] for i in x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.large_string()).cast(pa.string())], ["id", "text"])

    return encoded.select("id", ids_col).mapInArrow(run, f"id {dict(encoded.dtypes)['id']}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: bytes | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded in one pass.

    The spelled-out ids and the decoded text are put together word by word and only hashed, so nothing long is shuffled."""
    lex = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        v = Vocabulary(path)
        e = Encoder(v, lex.value)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
        digits = spelt = None
        age = -1
        for b in batches:
            for i, texts in word_batches(b, text_col):
                number, at = e.encode(texts)
                if age != e.age:
                    digits, spelt, age = np.empty(0, object), np.empty(0, object), e.age
                edge = e.bound[len(digits):].tolist()
                ids = e.ids[edge[0]:].tolist()
                more, names = np.empty(len(edge) - 1, object), np.empty(len(edge) - 1, object)
                for k in range(len(more)):
                    own = ids[edge[k] - edge[0]:edge[k + 1] - edge[0]]
                    more[k] = " ".join(map(str, own))
                    names[k] = " ".join([v.names[x] for x in own])
                digits, spelt = np.concatenate([digits, more]), np.concatenate([spelt, names])
                total = np.r_[0, np.cumsum((e.bound[1:] - e.bound[:-1])[number])]
                a, c, d = [], [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = number[x:y]
                    a.append(int(total[y] - total[x]))
                    c.append(sha(digits[own].tolist()))
                    d.append(sha(spelt[own].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, len(texts)), pa.array(a, pa.int64()), pa.array(c), pa.array(d)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)).mapInArrow(run, schema)
