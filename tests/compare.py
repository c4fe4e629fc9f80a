"""Run registered queries against their SQL in DuckDB.

Usage: python tests/compare.py [folder] [name ...]
"""

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def rows_of(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, Counter(tuple(cell(v) for v in r) for r in zip(*cols)), {n: str(table.schema.field(n).type) for n in names}


def check(spark, con, name, folder):
    """An empty string, or what differs."""
    from tabloom.workloads import ORACLES, runner

    df = runner(name)(spark, folder)
    got_names, got, got_types = rows_of(df.toArrow())
    if name not in ORACLES:
        return "" if got else "no rows"
    want_names, want, want_types = rows_of(con.sql(ORACLES[name]).to_arrow_table())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    plain = lambda t: {n: x.replace("large_", "").split("[us")[0] for n, x in t.items()}
    if plain(got_types) != plain(want_types):
        return f"types {[(n, got_types[n], want_types[n]) for n in got_names if plain(got_types)[n] != plain(want_types)[n]]}"
    if got != want:
        extra, missing = got - want, want - got
        return f"rows {sum(got.values())} vs {sum(want.values())}; only spark {list(extra)[:2]}; only sql {list(missing)[:2]}"
    return "" if got else "(both empty)"


def main(folder, names):
    from tabloom.session import local_session
    from tabloom.workloads import ORACLES, QUERIES

    spark, con = local_session(os.environ.get("BENCH_CPUS", "8")), connect(folder)
    bad = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            said = check(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        took = time.time() - started
        bad += bool(said)
        print(f"{'FAIL' if said else 'ok  '} {name} {took:.1f}s{'' if name in ORACLES else ' (rows only)'} {said}", flush=True)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    args = sys.argv[1:]
    main(args[0] if args else "/root/testdata/sf0.001", args[1:])
