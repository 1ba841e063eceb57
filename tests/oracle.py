"""Side-by-side check of registered queries against their SQL."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(type_name: str) -> str:
    t = type_name.lower()
    for names, kind in (
        (("bigint", "long"), "long"),
        (("integer", "int"), "int"),
        (("double",), "double"),
        (("varchar", "string"), "string"),
        (("boolean",), "bool"),
        (("date",), "date"),
    ):
        if t in names:
            return kind
    return t


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("0", "")
    if isinstance(v, float):
        return ("1", f"{v:.6g}")
    return ("1", str(v))


def compare(spark, con, sf_dir, name, fn, sql) -> str:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    types = {r[0]: _kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    note = "" if types == mine else " TYPES " + str({c: (mine[c], types[c]) for c in cols if mine[c] != types[c]})
    key = lambda r: tuple(_cell(v) for v in r)
    a, b = sorted(map(key, got)), sorted(map(key, want))
    if a != b:
        diff_a = [r for r in a if r not in set(b)][:2]
        diff_b = [r for r in b if r not in set(a)][:2]
        return f"rows differ: spark {len(a)} sql {len(b)}\n   spark {diff_a}\n   sql   {diff_b}" + note
    return f"ok {len(a)}" + note


def main() -> None:
    from tracewell.session import build_session
    from tracewell.workloads import ORACLES, QUERIES

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                out = compare(spark, con, sf_dir, name, fn, ORACLES[name])
            else:
                out = f"rows {fn(spark, sf_dir).count()} (no sql)"
        except Exception as exc:  # report and go on
            out = f"FAILED {type(exc).__name__} {str(exc)[:600]}"
        flag = "" if out.startswith(("ok", "rows ")) and "TYPES" not in out and "rows differ" not in out else "  <<<<"
        bad += bool(flag)
        print(f"{name:34s} {time.time() - t:6.2f}s {out}{flag}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
