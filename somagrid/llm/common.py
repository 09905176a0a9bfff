"""Vectorised text helpers that run inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

#: Separators of words: blank and the controls 9 to 13.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Yield (first row, bytes, offsets) of whole texts, about ``limit`` bytes at a time; null counts as empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, o, d = arr.buffers()
    n = len(arr)
    if n == 0:
        return
    off = np.frombuffer(o, np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray):
    """(start, end, text number) of the maximal runs where ``inside`` holds; runs end with their text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    s = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    e = np.flatnonzero(inside & ~after) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, eight bytes at a step."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=pad.data, strides=(1,))
    length = e - s
    h = mix(length.astype(np.uint64) + _K1)
    live, k = np.arange(len(s)), 0
    while len(live):
        rest = length[live] - k
        block = at[s[live] + k] & _MASK[np.minimum(rest, 8)]
        h[live] = mix((h[live] ^ block) * _K1)
        live = live[rest > 8]
        k += 8
    return h


def words(data: np.ndarray, off: np.ndarray):
    """Lower-cased words of whole texts: (hash, text number)."""
    low = LOWER[data]
    s, e, doc = spans(low, off, WORD[low])
    return hash_spans(low, s, e), doc


def shingles(h: np.ndarray, doc: np.ndarray, width: int):
    """Hashes of all runs of ``width`` words within a text: (hash, text number), in text order.

    A text with fewer words gives its whole sequence as one."""
    if len(h) == 0:
        return h, doc
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[first, len(doc)])
    m = len(h) - width + 1
    parts, owners = [], []
    if m > 0:
        acc = np.full(m, _K3)
        for j in range(width):
            acc = mix((acc ^ h[j:j + m]) * _K1)
        ok = doc[:m] == doc[width - 1:]
        parts.append(acc[ok])
        owners.append(doc[:m][ok])
    short = np.flatnonzero(count < width)
    if len(short):
        acc = np.full(len(short), _K3)
        for j in range(width - 1):
            live = count[short] > j
            acc[live] = mix((acc[live] ^ h[first[short[live]] + j]) * _K1)
        parts.append(mix(acc + count[short].astype(np.uint64)))
        owners.append(doc[first[short]])
    sh, d = np.concatenate(parts), np.concatenate(owners)
    o = np.argsort(d, kind="stable")
    return sh[o], d[o]


def sets_of(sh: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each of ``n`` texts."""
    b = np.searchsorted(doc, np.arange(n + 1))
    return [np.unique(sh[b[i]:b[i + 1]]) for i in range(n)]


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def runs(batches, keys: list[str], small: int = 65536):
    """Tables of whole key runs from batches that are sorted by ``keys``; a run may cross batches."""
    held = None
    for b in batches:
        if b.num_rows == 0:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        n = t.num_rows
        same = np.ones(n, bool)
        for k in keys:
            v = t.column(k).to_numpy(zero_copy_only=False)
            same &= v == v[-1]
        cut = int(n - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the key runs of a sorted table, and its length."""
    n = t.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(new), n]
