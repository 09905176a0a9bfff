"""Repair of damaged conversations by iterative-deepening A*.

A conversation's rows, ordered by turn (nulls first; within a turn by role and
digest of the text), become one letter each: what its role begins with, whether
its text breaks off, whether it has to go.  :func:`search` looks for the
cheapest edits after which the role initials read ``(s?(ua)+)?``: depth first
in ASCII order of the edits (Delete, Insert, Keep, Rerole) under a bound on the
cost that grows to the least excess met, with a table of states that failed and
the least cost they are known to need.  The first accepting path is therefore
the ASCII-least of the cheapest.

Long conversations are cut into segments of ``SEGMENT`` rows.  A segment is
searched from each of the four states of the pattern to each other, where the
rows are, and the segments are chained from left to right with four candidates.
An insert belongs to the row after it, so no segment's edits are a prefix of
another's and comparing candidates piece by piece gives the ASCII order of the
whole.  Rows of one conversation thus never meet in one task until their edits
are known; the last step walks them in order as a stream.

Defined results: null ids, turns, roles and texts count as one space, but a
null id names one conversation and comes back as null, and null turns come
first.  Rows alike in id, turn, role and text are repeats and stay adjacent.
A conversation without rows after the damage has zeros and empty edits.  Other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from somagrid.session import cut

SEGMENT = 128
#: Costs of the edits, and what a row that breaks off adds unless deleted.
DELETE, INSERT, REROLE, BROKEN = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a.  Moves by initial, and the initial that an edit gives in each state.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("u", "u", "a", "u")
FINISH = {0: "", 1: "II", 2: "I", 3: ""}
GONE = "-"
NEVER = 1 << 60


@functools.lru_cache(1 << 15)
def search(codes: str, start: int = 0, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, edits) from ``start`` to state ``goal``, or to any accepting state with inserts at the end; None if there is no way.

    ``codes`` has a letter per row: ``-`` must go, else s, u, a, e (no initial) or x (another one), upper case if the text breaks off."""
    n = len(codes)
    floor, system = [0] * (n + 1), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = codes[i]
        least = DELETE if c == GONE else min(DELETE, REROLE * (c in "xX") + BROKEN * c.isupper())
        floor[i], system[i] = floor[i + 1] + least, system[i + 1] or c in "sS"
    need: dict[tuple[int, int], int] = {}

    def bound_of(i: int, q: int) -> int:
        if goal is not None:
            if i == n and q != goal or goal < 2 and q > goal or goal == 1 and q == 0 and not system[i]:
                return NEVER
        return max(floor[i], need.get((i, q), 0))

    def edits(i: int, q: int):
        """(letter, cost, next row, next state) in ASCII order."""
        c = codes[i] if i < n else None
        if c is not None:
            yield "D", DELETE, i + 1, q
        if c is not None or goal is None:
            yield "I", INSERT, i, MOVES[q][WANTED[q]]
        if c is not None and c != GONE:
            extra, kind = BROKEN * c.isupper(), c.lower()
            if kind == "e":
                yield "K", extra, i + 1, q
            elif kind in MOVES[q]:
                yield "K", extra, i + 1, MOVES[q][kind]
            yield "R", REROLE + extra, i + 1, MOVES[q][WANTED[q]]

    def deepen(i: int, q: int, left: int):
        """(edits, 0) within ``left``, else (None, by how much the bound was too small)."""
        if i == n and (q == goal or goal is None and q in (0, 3)):
            return "", 0
        short = bound_of(i, q) - left
        if short > 0:
            return None, short
        excess = NEVER
        for letter, cost, j, r in edits(i, q):
            path, more = deepen(j, r, left - cost) if cost <= left else (None, cost + bound_of(j, r) - left)
            if path is not None:
                return letter + path, 0
            excess = min(excess, more)
        need[i, q] = max(need.get((i, q), 0), left + excess)
        return None, excess

    bound = bound_of(0, start)
    while bound < NEVER:
        path, excess = deepen(0, start, bound)
        if path is not None:
            return bound, path
        bound += excess
    return None


class Chain:
    """Cheapest, ASCII-least edits of a conversation whose segments come one after another."""

    def __init__(self):
        self.best = {0: (0, 0, None)}  # state: cost, place in ASCII order, (earlier pieces, piece)

    def add(self, ways: list[tuple[int, int, int, str]]) -> None:
        """``ways``: (from state, to state, cost, edits) of the next segment."""
        found = {}
        for q, r, cost, piece in ways:
            if q in self.best:
                total, place, before = self.best[q]
                key = (total + cost, place, piece)
                if r not in found or key < found[r][0]:
                    found[r] = (key, (before, piece))
        order = sorted(found, key=lambda r: found[r][0][1:])
        self.best = {r: (found[r][0][0], order.index(r), found[r][1]) for r in found}

    def result(self) -> tuple[int, str]:
        ends = [(cost + INSERT * len(FINISH[q]), place, FINISH[q], node) for q, (cost, place, node) in self.best.items()]
        cost, _, end, node = min(ends, key=lambda x: x[:3])
        parts = [end]
        while node is not None:
            node, piece = node
            parts.append(piece)
        return cost, "".join(reversed(parts))


def ways_of(codes: str) -> list[tuple[int, int, int, str]]:
    found = ((q, r, search(codes, q, r)) for q in range(4) for r in range(4))
    return [(q, r, *way) for q, r, way in found if way is not None]


def damage(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows after the damage; ``conv`` is a key that tells null from every id."""
    conv, turn = F.col(conv_col).cast("string"), F.col(turn_col)
    code = F.crc32(F.concat(F.coalesce(conv, F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return convs.select(conv_key(conv_col).alias("conv"), turn.cast("long").alias("turn"), code.alias("code"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text")).filter(
        "code <> 0").select(
        "conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("copies"))


def conv_key(conv_col: str = "conv_id"):
    return F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("null"))


ORDER = ["conv", "turn", "role", "digest"]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, copies, kind, blank, again, cut_off): one row for all repeats, without the text.

    ``again`` holds if an earlier turn has the same role and text."""
    text = F.col("text")
    seen = rows.select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", ~text.rlike(r"[^\x20\x09-\x0D]"),
        ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).toDF("conv", "turn", "role", "digest", "copies", "blank", "cut_off")
    one = seen.groupBy(*ORDER).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut_off").alias("cut_off"))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    first = one.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).when(initial == "", "e").otherwise("x")
    return one.join(first, ["conv", "role", "digest"]).select(
        *ORDER, "copies", kind.alias("kind"), "blank", (place > F.col("first")).alias("again"), "cut_off")


def summary(found: DataFrame) -> DataFrame:
    """(conv, n_rows, gaps, blank, duplicate, truncated) of every conversation that has rows."""
    many = F.col("copies")
    dup = F.when(F.col("blank"), 0).when(F.col("again"), many).otherwise(many - 1)
    cut_off = F.when(~F.col("blank") & ~F.col("again") & F.col("cut_off"), 1).otherwise(0)
    turns = found.groupBy("conv", "turn").agg(
        F.sum(many).alias("n_rows"), F.sum(F.when(F.col("blank"), many).otherwise(0)).alias("blank"), F.sum(dup).alias("duplicate"), F.sum(cut_off).alias("truncated"))
    return turns.groupBy("conv").agg(
        F.sum("n_rows").alias("n_rows"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def segments(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(conv, part, number, first, last, illegal, whole, ways): the searched segments of all conversations, in order of (part, number)."""
    step = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("number", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
                      ("whole", pa.bool_()), ("ways", pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))])

    def letters(batches):
        """(conv, rows in all, code, initial) of every row, repeats one by one."""
        for b in batches:
            for conv, n, copies, kind, blank, again, cut_off in zip(*(c.to_pylist() for c in b.columns)):
                gone = blank or again
                yield conv, n, GONE if gone else kind.upper() if cut_off else kind, kind
                for _ in range(copies - 1):
                    yield conv, n, GONE, kind

    def run(batches):
        part, number, out = TaskContext.get().partitionId(), 0, []

        def close(conv, n, codes, kinds):
            illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(kinds, kinds[1:]))
            whole = len(codes) == n
            ways = [(0, 0, *search(codes))] if whole else ways_of(codes)
            return dict(conv=conv, part=part, number=number, first=kinds[0], last=kinds[-1], illegal=illegal, whole=whole,
                        ways=[dict(q=q, r=r, cost=c, edits=e) for q, r, c, e in ways])

        now, total, codes, kinds = None, 0, [], []
        for conv, n, code, kind in letters(batches):
            if codes and (conv != now or len(codes) == SEGMENT):
                out.append(close(now, total, "".join(codes), "".join(kinds)))
                number, codes, kinds = number + 1, [], []
                if len(out) == 2048:
                    yield pa.RecordBatch.from_pylist(out, step)
                    out = []
            now, total = conv, n
            codes.append(code)
            kinds.append(kind)
        if codes:
            out.append(close(now, total, "".join(codes), "".join(kinds)))
        if out:
            yield pa.RecordBatch.from_pylist(out, step)

    ordered = found.join(totals.select("conv", "n_rows"), "conv").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.select("conv", "n_rows", "copies", "kind", "blank", "again", "cut_off").mapInArrow(
        run, "conv string, part int, number long, first string, last string, illegal long, whole boolean, ways array<struct<q:int,r:int,cost:bigint,edits:string>>")


def plans(segs: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit): the edits of every conversation that has rows."""
    step = pa.schema([("conv", pa.string()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches):
        now, chain, illegal, last, out = None, None, 0, "", []

        def close():
            cost, audit = chain if isinstance(chain, tuple) else chain.result()
            return dict(conv=now, illegal=illegal, cost=cost, audit=audit)

        for b in batches:
            for s in b.to_pylist():
                if s["conv"] != now:
                    if now is not None:
                        out.append(close())
                    now, chain, illegal, last = s["conv"], Chain(), 0, ""
                illegal += s["illegal"] + bool(last and last + s["first"] not in ("su", "ua", "au"))
                last = s["last"]
                if s["whole"]:
                    chain = (s["ways"][0]["cost"], s["ways"][0]["edits"])
                else:
                    chain.add([(w["q"], w["r"], w["cost"], w["edits"]) for w in s["ways"]])
            yield pa.RecordBatch.from_pylist(out, step)
            out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([close()], step)

    return segs.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(run, "conv string, illegal long, cost long, audit string")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, place, role, text): the rows after their edits, in order within a partition that holds the whole conversation."""
    step = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        audit, at, place, q = "", 0, 0, 0
        for b in batches:
            out = []

            def emit(conv, role, text):
                nonlocal place
                out.append((conv, place, role, text))
                place += 1

            def inserts(conv):
                nonlocal at, q
                while at < len(audit) and audit[at] == "I":
                    q = MOVES[q][WANTED[q]]
                    emit(conv, "user" if q == 2 else "assistant", "")
                    at += 1

            for conv, edits, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if edits is not None:
                    audit, at, place, q = edits, 0, 0, 0
                    continue
                for _ in range(copies):
                    inserts(conv)
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        q = MOVES[q][role[0]] if role else q
                        emit(conv, role, text)
                    elif edit == "R":
                        q = MOVES[q][WANTED[q]]
                        emit(conv, "user" if q == 2 else "assistant", text)
                if len(audit) - at <= 2 and set(audit[at:]) == {"I"}:  # nothing but the inserts at the end is left
                    inserts(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), step.types)], schema=step)

    lead = plan.select("conv", F.lit(0).alias("side"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"),
                       F.col("audit").alias("edits"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    body = rows.select("conv", F.lit(1).alias("side"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(None).cast("string").alias("edits"), "text", "copies")
    dealt = lead.union(body).repartition("conv").sortWithinPartitions("conv", "side", "turn", "role", "digest")
    return dealt.select("conv", "edits", "role", "text", "copies").mapInArrow(run, "conv string, place long, role string, text string")


def _digests(fixed: DataFrame) -> DataFrame:
    """(conv, repaired_sha256), read from the rows as they come, without holding a conversation."""

    def run(batches):
        now, sha = None, None
        for b in batches:
            done, hexes = [], []
            for conv, place, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now:
                    if now is not None:
                        done.append(now)
                        hexes.append(sha.hexdigest())
                    now, sha = conv, hashlib.sha256()
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(hexes, pa.string())], ["conv", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["conv", "repaired_sha256"])

    return fixed.mapInArrow(run, "conv string, repaired_sha256 string")


def report(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ``convs``: faults after the damage, cost and edits of the repair, digest of the repaired rows."""
    rows = damage(convs, conv_col, turn_col, role_col, text_col)
    found = cut(faults(rows))
    totals = summary(found)
    plan = cut(plans(segments(found, totals)))
    every = convs.select(conv_key(conv_col).alias("conv"), F.col(conv_col).alias("conv_id")).groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    out = every.join(totals, "conv", "left").join(plan, "conv", "left").join(_digests(repaired(rows, plan)), "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
