"""Compare registered queries with their SQL twins: ``python tests/compare.py [folder] [name prefix ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in data], key=repr)


def check(spark, con, name, fn, sql, folder):
    """Return (ok, message, seconds)."""
    start = time.time()
    frame = fn(spark, folder)
    got = rows(frame.columns, frame.collect())
    took = time.time() - start
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL twin", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} against {sorted(names)}", took
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
    mine = dict(frame.dtypes)
    for d in cur.description:
        if kinds.get(str(d[1])) != mine[d[0]]:
            return False, f"column {d[0]} is {mine[d[0]]} against {d[1]}", took
    if len(got) != len(want):
        return False, f"{len(got)} rows against {len(want)}: {got[:2]} / {want[:2]}", took
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if type(a) is not type(b) or a != b:
                return False, f"{sorted(names)} {g} against {w}", took
    return bool(got), f"{len(got)} rows equal", took


def main():
    from anamnesis.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    prefixes = tuple(args[1:])
    from anamnesis.plans import registry
    import importlib

    mods = os.environ.get("MODS")
    if mods:
        for m in mods.split(","):
            importlib.import_module(f"anamnesis.plans.{m}")
    else:
        from anamnesis.plans import catalog  # noqa: F401
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, message, took = check(spark, con, name, fn, registry.ORACLES.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        bad += not ok
        if not ok or os.environ.get("VERBOSE"):
            print(("ok  " if ok else "BAD ") + f"{name} {took:.2f}s {message}", flush=True)
    print(f"{bad} bad of {len([n for n in registry.QUERIES if not prefixes or n.startswith(prefixes)])}")


if __name__ == "__main__":
    main()
