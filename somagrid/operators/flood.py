"""Floods of a mask from labelled seeds, block by block.

A block of ``block`` cubed with one voxel of halo is flooded to the end inside
its task; only values on block faces travel.  A round floods again the blocks
beside which a face value improved, so rounds follow the number of block
borders a flood crosses, not its length in voxels, and after the first round
only faces are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from somagrid.operators.components import offsets
from somagrid.session import cut, release, spread

AXES = ["z", "y", "x"]
KEYS = ["_bz", "_by", "_bx"]
BLOCK = 32
LAST = (1 << 62) - 1


class Cells:
    """Voxels of a block and its halo on a flat grid, with steps to the neighbours as flat distances."""

    def __init__(self, table: pa.Table, halo: pa.Table, low: np.ndarray, block: int, connectivity: int):
        w = block + 2
        self.pad = w * w + w + 1
        self.size = w ** 3 + 2 * self.pad
        flat = lambda t: self.pad + np.ravel_multi_index(tuple(t.column(a).to_numpy() - s + 1 for a, s in zip(AXES, low)), (w,) * 3)
        self.own, self.rim = flat(table), flat(halo)
        self.steps = np.array([(a * w + b) * w + c for a, b, c in offsets(connectivity)])
        self.open = np.zeros(self.size, bool)
        self.open[self.own] = True

    def array(self, fill, own: np.ndarray, rim: np.ndarray, kind) -> np.ndarray:
        a = np.full(self.size, fill, kind)
        a[self.rim] = rim
        a[self.own] = own
        return a

    def spread(self, value: np.ndarray, offer) -> np.ndarray:
        """Lower ``value`` by ``offer(from, to)`` between neighbours until nothing gets lower."""
        front = np.concatenate([self.own, self.rim])
        front = front[value[front] < value.dtype.type(LAST) if value.dtype.kind == "i" else np.isfinite(value[front])]
        while len(front):
            src = np.repeat(front, len(self.steps))
            dst = src + np.tile(self.steps, len(front))
            ok = self.open[dst]
            src, dst = src[ok], dst[ok]
            new = offer(value, src, dst)
            better = new < value[dst]
            dst = dst[better]
            np.minimum.at(value, dst, new[better])
            front = np.unique(dst)
        return value


def _levels(c: Cells, table: pa.Table, halo: pa.Table) -> pa.Table:
    """Lowest level at which a flood from the seeds reaches each voxel: the highest voxel on the best way there."""
    height = c.array(np.inf, table.column("height").to_numpy(), np.inf, float)
    seed = ~np.isnan(table.column("seed").to_numpy(zero_copy_only=False).astype(float))
    level = c.array(np.inf, np.where(seed, table.column("height").to_numpy(), np.inf), halo.column("level").to_numpy(), float)
    level = c.spread(level, lambda v, s, d: np.maximum(v[s], height[d]))
    return pa.table({**{a: table.column(a) for a in AXES}, "level": level[c.own]})


def _column(c: Cells, table: pa.Table, halo: pa.Table, name: str, fill, kind) -> np.ndarray:
    return c.array(fill, table.column(name).to_numpy(), halo.column(name).to_numpy(), kind)


def _ranked(table: pa.Table, halo: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels in order, which voxels are seeds, and the place of seeds' and halo's labels in that order."""
    seed = table.column("seed").combine_chunks()
    names = np.unique(pa.concat_arrays([seed.drop_null(), halo.column("label").combine_chunks()]).to_numpy())
    return names, np.asarray(seed.is_valid()), np.searchsorted(names, seed.fill_null(0).to_numpy()), np.searchsorted(names, halo.column("label").to_numpy())


def _waves(c: Cells, table: pa.Table, halo: pa.Table) -> pa.Table:
    """(steps, label) of each voxel without heights: the fewest steps from a seed, then the smaller label."""
    names, given, rank, far = _ranked(table, halo)
    one = np.int64(1 << 31)
    key = c.array(LAST, np.where(given, rank, LAST), halo.column("steps").to_numpy() << 31 | far, np.int64)
    key = c.spread(key, lambda v, s, d: v[s] + one)[c.own]
    hit = key < LAST
    label = np.zeros(len(key), np.int64)
    label[hit] = names[key[hit] & (one - 1)]
    return pa.table({**{a: table.column(a) for a in AXES}, "steps": pa.array(key >> 31, mask=~hit), "label": pa.array(label, mask=~hit)})


def _steps(c: Cells, table: pa.Table, halo: pa.Table) -> pa.Table:
    """Steps of each voxel from where a flood came to its level."""
    level, height = _column(c, table, halo, "level", np.inf, float), c.array(np.inf, table.column("height").to_numpy(), np.inf, float)
    given = np.asarray(table.column("seed").combine_chunks().is_valid())
    steps = c.array(LAST, np.where(given, 0, LAST), halo.column("steps").to_numpy(), np.int64)

    def offer(v, s, d):
        return np.where(np.maximum(level[s], height[d]) == level[d], np.where(level[s] < level[d], 1, v[s] + 1), LAST)

    steps = c.spread(steps, offer)[c.own]
    return pa.table({**{a: table.column(a) for a in AXES}, "steps": pa.array(steps, mask=steps == LAST), "level": table.column("level")})


def _labels(c: Cells, table: pa.Table, halo: pa.Table) -> pa.Table:
    """The least label that comes along the ways by which the levels and steps came."""
    names, given, rank, far = _ranked(table, halo)
    level, height = _column(c, table, halo, "level", np.inf, float), c.array(np.inf, table.column("height").to_numpy(), np.inf, float)
    steps = _column(c, table, halo, "steps", LAST, np.int64)
    label = c.array(LAST, np.where(given, rank, LAST), far, np.int64)

    def offer(v, s, d):
        way = np.where(level[s] < level[d], steps[d] == 1, (level[s] == level[d]) & (steps[s] + 1 == steps[d]))
        return np.where(way & (np.maximum(level[s], height[d]) == level[d]), v[s], LAST)

    label = c.spread(label, offer)[c.own]
    hit = label < LAST
    label[hit] = names[label[hit]]
    return pa.table({**{a: table.column(a) for a in AXES}, "label": pa.array(label, mask=~hit), "steps": table.column("steps"), "level": table.column("level")})


def _settle(base: DataFrame, kernel, values: list[str], better, connectivity: int, block: int, rounds: list | None) -> DataFrame:
    """``kernel`` on all blocks until no face gets better; ``values`` travel, ``better`` is what must be least."""
    kinds = {"level": "double", "steps": "long", "label": "long"}
    types = {"level": pa.float64(), "steps": pa.int64(), "label": pa.int64()}
    schema = "z long, y long, x long, " + ", ".join(f"{v} {kinds[v]}" for v in values)
    none = pa.table({**{a: pa.array([], pa.int64()) for a in AXES}, **{v: pa.array([], types[v]) for v in values}})
    home = [F.floor(F.col(a) / block).alias(k) for a, k in zip(AXES, KEYS)]
    rim = (F.pmod("z", F.lit(block)).isin(0, block - 1)) | (F.pmod("y", F.lit(block)).isin(0, block - 1)) | (F.pmod("x", F.lit(block)).isin(0, block - 1))

    def flooded(blocks: DataFrame, faces: DataFrame | None) -> DataFrame:
        def run(key, table, halo):
            if not table.num_rows:
                return none
            low = np.array([k.as_py() for k in key]) * block
            return kernel(Cells(table, halo, low, block, connectivity), table, halo).select([*AXES, *values])

        if faces is None:
            return blocks.groupBy(*KEYS).applyInArrow(lambda key, t: run(key, t, none), schema)
        return blocks.groupBy(*KEYS).cogroup(faces.groupBy(*KEYS)).applyInArrow(run, schema)

    def sent(faces: DataFrame) -> DataFrame:
        """Face values with the blocks beside them."""
        out = faces
        for a, k in zip(AXES, KEYS):
            out = out.withColumn(k, F.explode(F.array_distinct(F.array(*[F.floor((F.col(a) + d) / block) for d in (-1, 0, 1)]))))
        other = [F.floor(F.col(a) / block) != F.col(k) for a, k in zip(AXES, KEYS)]
        return spread(out.filter(other[0] | other[1] | other[2]))

    least = F.struct(*better)
    reached = F.col(better[-1]).isNotNull() & (F.lit(True) if better != ["level"] else F.col("level") < float("inf"))
    new = cut(flooded(base.select("*", *home), None).filter(rim & reached))
    faces = new
    done = 0
    while not new.isEmpty():
        halo = sent(faces)
        active = sent(new).select(*KEYS).distinct()
        again = base.select("*", *home).join(active, KEYS, "left_semi")
        seen = flooded(again, halo.join(active, KEYS, "left_semi")).filter(rim & reached)
        old = faces.select(*AXES, least.alias("_old"))
        nxt = cut(seen.join(old, AXES, "left").filter(F.col("_old").isNull() | (least < F.col("_old"))).select(*AXES, *values))
        merged = cut(faces.unionByName(nxt).groupBy(*AXES).agg(F.min_by(F.struct(*values), least).alias("_v")).select(*AXES, "_v.*"))
        if new is not faces:
            release(new)
        release(faces)
        faces, new, done = merged, nxt, done + 1
    if rounds is not None:
        rounds.append(done)
    return flooded(base.select("*", *home), sent(faces))


def flood(mask: DataFrame, seeds: DataFrame, label: str = "label", connectivity: int = 6, height: str | None = None, block: int = BLOCK, rounds: list | None = None) -> DataFrame:
    """Mask voxels with the label of the seed whose flood reaches them; voxels no flood reaches are left out.

    Without ``height`` that is the seed fewest steps away inside the mask, the smaller label on ties.  With a column of heights
    the mask fills from the seeds upward: a voxel is reached at the lowest level there is a way to it, and of the floods that
    meet at one level the one fewer steps from where they came to that level takes it.  Rows at one position count once, with
    the lowest height; ``rounds`` collects how often faces were exchanged."""
    kind, out = dict(mask.dtypes), dict(seeds.dtypes)[label]
    h = F.col(height).cast("double") if height else F.lit(0.0)
    pos = [F.col(a).cast("long").alias(a) for a in AXES]
    one = mask.select(*pos, h.alias("_h")).groupBy(*AXES).agg(F.min("_h").alias("height"))
    own = seeds.select(*pos, F.col(label).cast("long").alias("_l")).groupBy(*AXES).agg(F.min("_l").alias("seed"))
    base = cut(one.filter(F.col("height").isNotNull()).join(own, AXES, "left"))
    settle = lambda table, kernel, values, better: _settle(table, kernel, values, better, connectivity, block, rounds)
    if height:  # each depends on the one before being final
        level = settle(base, _levels, ["level"], ["level"])
        high = cut(base.join(level, AXES).filter(F.col("level") < float("inf")))
        far = cut(high.drop("level").join(settle(high, _steps, ["steps", "level"], ["steps"]), AXES))
        got = settle(far, _labels, ["label", "steps", "level"], ["label"])
    else:
        got = settle(base, _waves, ["steps", "label"], ["steps", "label"])
    return got.filter("label IS NOT NULL").select(*[F.col(a).cast(kind[a]).alias(a) for a in AXES], F.col("label").cast(out).alias(label))
