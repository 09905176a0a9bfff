"""Run registered queries next to their SQL twins.

    python tests/compare.py <folder> [name or prefix* ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


TIMES: dict[str, float] = {}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x)), f"{x:.6g}" if isinstance(x, float) else str(x)) for x in row)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def compare(df, con, sql) -> list[str]:
    t = time.time()
    res = con.execute(sql)
    TIMES["sql"] = time.time() - t
    names = [c[0] for c in res.description]
    types = {c[0]: str(c[1]) for c in res.description}
    rows = res.fetchall()
    bad = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for f in df.schema.fields:
        want = TYPES.get(f.dataType.simpleString())
        if want and want not in types[f.name].upper():
            bad.append(f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
    cols = sorted(names)
    got = [tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    pos = [names.index(c) for c in cols]
    exp = [tuple(norm(r[p]) for p in pos) for r in rows]
    if len(got) != len(exp):
        bad.append(f"rows {len(got)} vs {len(exp)}")
    got.sort(key=key)
    exp.sort(key=key)
    if got != exp:
        diff = [(g, e) for g, e in zip(got, exp) if not all(close(a, b) for a, b in zip(g, e))]
        if diff:
            bad.append(f"{len(diff)} rows differ, columns {cols}, first {diff[:2]}")
        exact = sum(g != e for g, e in zip(got, exp))
        if not diff and exact:
            one = next((c, a, b) for g, e in zip(got, exp) for c, a, b in zip(cols, g, e) if a != b)
            bad.append(f"note: {exact} rows differ in the last digit only, as {one}")
    if not got:
        bad.append("note: no rows")
    return bad


def main() -> int:
    from somagrid.registry import ORACLES, QUERIES, load_all
    from somagrid.session import build_session

    folder, pats = sys.argv[1], sys.argv[2:]
    load_all()
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = [n for n in QUERIES if not pats or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in pats)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, folder)
            bad = compare(df, con, ORACLES[n]) if n in ORACLES else [f"note: no SQL, {df.count()} rows"]
        except Exception as e:  # noqa: BLE001 - report and go on
            bad = [f"{type(e).__name__}: {str(e)[:700]}"]
        real = [b for b in bad if not b.startswith("note")]
        failed += bool(real)
        print(f"{'FAIL' if real else 'ok  '} {n} {time.time() - t:.1f}s (sql {TIMES.pop('sql', 0):.1f}s) {' ; '.join(bad)}", flush=True)
    print(f"{len(names)} run, {failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
