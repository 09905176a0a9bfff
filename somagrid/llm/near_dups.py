"""Near-duplicate groups: a multi-index Hamming join over b-bit MinHash signatures.

Every text gets ``POSITIONS`` one-byte minima over its word shingles.  The
signature is split into chunks; two signatures that differ in at most
``chunks * (errors + 1) - 1`` positions agree, by the pigeonhole principle, in
all but ``errors`` positions of some chunk.  Enumerating the allowed error
places of each chunk turns this into equality of keys, so the join is an
equi-join that cannot miss a pair under that distance.

Links are confirmed on full shingle sets.  Copies with equal sets are one
representative.  Work follows what is still open, never all pairs of a group:

1. each representative is compared with one pivot, the first of the bucket it
   shares most often; this joins most of a group of near copies;
2. buckets whose members all belong together by now are closed.  In the
   others, the tiles (of bounded size) of members outside the bucket's largest
   component meet the other tiles of the bucket, each pair of tiles once for all
   buckets they share; signatures further apart than ``far`` are passed over (a
   pair at the limit is that far with a probability under 1e-7), the rest is
   compared by tiles, again on full sets, and only a spanning forest of the
   links is written.

Defined results: null or wordless texts have an empty set and link with
nothing; rows that share an id are one document; rows with a null id are kept,
each alone, with a null component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from somagrid.llm.common import binary, bounds, mix, runs, sets_of, shingles, text_chunks, words
from somagrid.operators.components import connected
from somagrid.session import cut

CHUNKS, CHUNK, ERRORS = 12, 5, 1
POSITIONS = CHUNKS * CHUNK
FAR = 30
#: Members of a tile and their shingles, about.
TILE = 128
SHINGLES = 1 << 17


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig): set size, 128-bit fingerprint of the set and signature of every whole text."""

    def run(batches):
        rng = np.random.default_rng(20240601)
        a = rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        c = rng.integers(1, 2**63, POSITIONS, dtype=np.uint64)
        for b in batches:
            for i, data, off in text_chunks(b, text_col):
                n = len(off) - 1
                size, f1, f2, sig = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
                for k, s in enumerate(sets_of(*shingles(*words(data, off), width), n)):
                    if not len(s):
                        continue
                    low = np.full(POSITIONS, 2**64 - 1, np.uint64)
                    for x in range(0, len(s), 8192):
                        low = np.minimum(low, (s[None, x:x + 8192] * a[:, None] + c[:, None]).min(axis=1))
                    size[k] = len(s)
                    f1[k] = mix(s).sum(dtype=np.uint64).astype(np.int64)
                    f2[k] = mix(s ^ a[0]).sum(dtype=np.uint64).astype(np.int64)
                    sig[k] = (mix(low) >> np.uint64(56)).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array(size), pa.array(f1), pa.array(f2), binary(sig)], ["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias(text_col)).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def chunk_keys(sigs: DataFrame) -> DataFrame:
    """(key, id): a key for every chunk and every set of error places in it."""
    kept = list(combinations(range(CHUNK), CHUNK - ERRORS))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, POSITIONS).astype(np.int64)
            keys = []
            for c in range(CHUNKS):
                for p, places in enumerate(kept):
                    key = np.full(len(sig), c * len(kept) + p, np.int64)
                    for x in places:
                        key = (key << 8) | sig[:, c * CHUNK + x]
                    keys.append(key)
            ids = pa.concat_arrays([b.column(0)] * len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), ids], ["key", "id"])

    return sigs.select("id", "sig").mapInArrow(run, "key long, id long")


def shingle_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, blob): the sorted full shingle set of every text."""

    def run(batches):
        for b in batches:
            for i, data, off in text_chunks(b, text_col):
                n = len(off) - 1
                blobs = [s.tobytes() for s in sets_of(*shingles(*words(data, off), width), n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), binary(blobs)], ["id", "blob"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias(text_col)).mapInArrow(run, "id long, blob binary")


def _links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which left and right sets have 100 * intersection >= percent * union."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    inter = np.zeros((len(left), len(right)), np.float32)
    own = lambda sets, part: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), part)
    la, lb = own(left, a), own(right, b)
    for x in range(0, len(both), 4096):
        part = both[x:x + 4096]
        m = []
        for who, h in (la, lb):
            at = np.searchsorted(part, h)
            ok = part[np.minimum(at, len(part) - 1)] == h
            z = np.zeros((int(who[-1]) + 1 if len(who) else 0, len(part)), np.float32)
            z[who[ok], at[ok]] = 1
            m.append(z)
        inter[:m[0].shape[0], :m[1].shape[0]] += m[0] @ m[1].T
    inter = inter.astype(np.int64)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
    return (100 * inter >= percent * union) & (union > 0)


def confirm(need: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst) links between the two sides of each tile pair; of the links of a tile pair only a spanning forest.

    ``need``: (t1, t2, side, id), at most two tiles of ids under a key (t1, t2)."""

    def run(batches):
        for t in runs(batches, ["t1", "t2"]):
            edge = bounds(t, ["t1", "t2"])
            side, ids, blob = t.column("side").to_numpy(), t.column("id").to_numpy(), t.column("blob").to_pylist()
            src, dst = [], []
            for s, e in zip(edge[:-1], edge[1:]):
                left, right = [i for i in range(s, e) if side[i] == 0], [i for i in range(s, e) if side[i] == 1]
                if not left or not right:
                    continue
                hit = _links([np.frombuffer(blob[i], np.uint64) for i in left], [np.frombuffer(blob[i], np.uint64) for i in right], percent)
                root = {}

                def find(v):
                    while root.get(v, v) != v:
                        v = root[v]
                    return v

                for x, y in zip(*np.nonzero(hit)):
                    u, v = int(ids[left[x]]), int(ids[right[y]])
                    a, c = find(u), find(v)
                    if a != c:
                        root[a] = c
                        src.append(u)
                        dst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    with_sets = need.join(sets, "id").select("t1", "t2", "side", "id", "blob")
    return with_sets.repartition("t1", "t2").sortWithinPartitions("t1", "t2", "side").mapInArrow(run, "src long, dst long")


def _settle(met: DataFrame, percent: int, far: int) -> DataFrame:
    """(src, dst) links between two tiles; of the links of a tile pair only a spanning forest.

    ``met``: (t1, m1, t2, m2), a row per tile pair with the members (id, comp, sig, blob) of both; members of one component or
    further apart than ``far`` are not compared."""

    def run(t: pa.Table) -> pa.Table:
        src, dst = [], []
        for a, b in zip(t.column("m1").to_pylist(), t.column("m2").to_pylist()):
            sig = [np.frombuffer(b"".join(v["sig"] for v in m), np.uint8).reshape(-1, POSITIONS) for m in (a, b)]
            comp = [np.array([v["comp"] for v in m]) for m in (a, b)]
            meet = comp[0][:, None] != comp[1][None, :]
            for i in np.flatnonzero(meet.any(axis=1)):
                meet[i] &= (sig[0][i] != sig[1]).sum(axis=1) <= far
            x, y = np.flatnonzero(meet.any(axis=1)), np.flatnonzero(meet.any(axis=0))
            if not len(x):
                continue
            sets = [[np.frombuffer(m[i]["blob"], np.uint64) for i in side] for m, side in ((a, x), (b, y))]
            root = {}

            def find(v):
                while root.get(v, v) != v:
                    v = root[v]
                return v

            for i, j in zip(*np.nonzero(_links(*sets, percent) & meet[np.ix_(x, y)])):
                u, v = a[x[i]], b[y[j]]
                p, q = find(u["comp"]), find(v["comp"])
                if p != q:
                    root[p] = q
                    src.append(u["id"])
                    dst.append(v["id"])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    # dealt by the second tile already, one pair at a time
    return met.groupBy("t2", "t1").applyInArrow(run, "src long, dst long")


def _open_tiles(rows: DataFrame, far: int) -> DataFrame:
    """Tile pairs that still need a comparison: (t1, t2, side, id) from tiled bucket members."""

    def run(batches):
        for t in runs(batches, ["key", "i", "j"]):
            edge = bounds(t, ["key", "i", "j"])
            side, ids, comp, tile = (t.column(c).to_numpy() for c in ("side", "id", "comp", "tile"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, POSITIONS)
            found = []
            for s, e in zip(edge[:-1], edge[1:]):
                mid = s + int(np.searchsorted(side[s:e], 1))
                if mid in (s, e):
                    continue
                x, y = np.nonzero(comp[s:mid, None] != comp[None, mid:e])
                if not len(x):
                    continue
                ok = (sig[s + x] != sig[mid + y]).sum(axis=1) <= far
                x, y = s + x[ok], mid + y[ok]
                swap = tile[x] > tile[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                for own, k in ((x, 0), (y, 1)):
                    found.append(np.unique(np.stack([tile[x], tile[y], np.full(len(x), k), ids[own]], axis=1), axis=0))
            if found:
                f = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2].astype(np.int32)), pa.array(f[:, 3])],
                                                 ["t1", "t2", "side", "id"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.mapInArrow(run, "t1 long, t2 long, side int, id long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", far: int = FAR,
                    whole_tiles: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    ``whole_tiles`` sends whole tiles once per pair (few rows, more disk) instead of the members that a bucket leaves open;
    the result is the same."""
    sigs = cut(signatures(docs, width, id_col, text_col))
    usable = sigs.filter("doc_id is not null and n_shingles > 0")
    reps = cut(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig"), F.first("n_shingles").alias("n")))

    keys = chunk_keys(reps)
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_z")).filter("pivot < _z").select("key", "pivot")
    members = cut(keys.join(shared, "key"))
    sets = cut(shingle_sets(docs.join(members.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi"), width, id_col, text_col))

    best = cut(members.filter("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(
        F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot")))
    tiles = best.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    left = tiles.select(F.col("pivot").alias("t1"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t2"), F.lit(0).alias("side"), F.col("pivot").alias("id"))
    right = best.join(tiles, "pivot").select(F.col("pivot").alias("t1"), F.pmod(F.xxhash64("id"), "tiles").alias("t2"), F.lit(1).alias("side"), "id")
    first = cut(confirm(left.union(right), sets, percent))

    nodes = members.select("id").distinct()
    comp = cut(connected(first, nodes))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # a lone representative is tiled with the component of its pivot: tiles then hold similar sets
    home = (
        comp.join(size, "component").join(best, "id", "left")
        .join(comp.select(F.col("id").alias("pivot"), F.col("component").alias("_of_pivot")), "pivot", "left")
        .select("id", F.col("component").alias("comp"), "size", F.when(F.col("size") > 1, F.col("component")).otherwise(F.coalesce("_of_pivot", "component")).alias("home"))
    )
    homes = home.join(reps.select("id", "n"), "id").groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / SHINGLES)).alias("tiles"))
    placed = cut(home.join(homes, "home").withColumn("tile", F.xxhash64("home", F.pmod(F.xxhash64("id"), "tiles"))).select("id", "comp", "size", "tile"))

    owned = members.select("key", "id").join(placed, "id")
    state = owned.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_z"), F.max(F.struct("size", "comp")).alias("_top"), F.count(F.lit(1)).alias("_n"))
    if whole_tiles:
        opened = cut(owned.join(state.filter("_a < _z").select("key", F.col("_top.comp").alias("top")), "key"))
        # tiles that share an open bucket, one of them with a member outside the bucket's largest component
        tiles = cut(opened.groupBy("key", "tile").agg(F.bool_or(F.col("comp") != F.col("top")).alias("outside")))
        one, two = tiles.filter("outside").select("key", F.col("tile").alias("a")), tiles.select("key", F.col("tile").alias("b"))
        pairs = cut(one.join(two, "key").select(F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2")).distinct())
        inside = opened.select("id", "comp", "tile").distinct().join(reps.select("id", "sig"), "id").join(sets, "id")
        sheets = cut(inside.groupBy("tile").agg(F.collect_list(F.struct("id", "comp", "sig", "blob")).alias("m")))
        met = pairs.join(sheets.toDF("t1", "m1"), "t1").join(sheets.toDF("t2", "m2"), "t2")
        second = cut(_settle(met, percent, far))
    else:
        opened = owned.join(state.filter("_a < _z").select("key", F.col("_top.comp").alias("top"), F.ceil(F.col("_n") / TILE).alias("nr")), "key")
        outside = opened.filter("comp <> top").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("nl"))
        opened = cut(opened.join(outside, "key").join(reps.select("id", "sig"), "id"))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        body = ["id", "comp", "tile", "sig"]
        spot = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
        sides = opened.filter("comp <> top").select("key", spot("nl").alias("i"), every("nr").alias("j"), F.lit(0).alias("side"), *body).union(
            opened.select("key", every("nl").alias("i"), spot("nr").alias("j"), F.lit(1).alias("side"), *body))
        second = cut(confirm(cut(_open_tiles(sides, far)), sets, percent))

    last = connected(first.union(second), nodes)
    of_set = reps.select("f1", "f2", "id").join(last, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("_c"))
    out = sigs.join(of_set, ["f1", "f2"], "left")
    alone = F.col("n_shingles") == 0
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("_c"))).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
