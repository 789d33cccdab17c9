"""Compare registered queries with their SQL on the test tables.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


_KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "double": "float", "float": "float", "string": "str",
    "boolean": "bool", "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
}


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    table = df.select(*[f"`{c}`" for c in cols]).toArrow().to_pylist()
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in table)
    rel = con.sql(sql)
    want_cols = sorted(rel.columns)
    if cols != want_cols:
        return False, f"columns {cols} vs {want_cols}"
    want_kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    odd = [
        f"{c}: {kinds[c]} vs {want_kinds[c]}" for c in cols
        if _KINDS.get(kinds[c], kinds[c]) != _KINDS.get(want_kinds[c], want_kinds[c])
        or (kinds[c], want_kinds[c]) in (("int", "BIGINT"), ("bigint", "INTEGER"))
    ]
    if odd:
        return False, f"types {odd}"
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    extra, missing = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if extra or missing:
        first = [str(next(iter(c), None))[:400] for c in (extra, missing)]
        return False, f"{sum(extra.values())} of {len(got)} rows differ, first: {first}"
    return True, f"{len(got)} rows"


def main(argv=None) -> int:
    from postlake.session import build_session
    import __spark_entry__ as entry

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args(argv)
    sf_dir = f"/root/testdata/sf{a.sf}"
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        t = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                ok, note = True, f"{fn(spark, sf_dir).count()} rows, no oracle"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
