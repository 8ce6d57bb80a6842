"""Run queries in Spark and their SQL in DuckDB and compare whole results.

Usage: python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def key(row):
    return tuple(("",) if v is None else (str(type(v).__name__ in ("int", "float")), v) if not isinstance(v, float) else ("True", v) for v in row)


def normal(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def compare(spark, con, fn, sql, sf_dir):
    """Empty string when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(normal(v) for v in r) for r in df.select(*cols).collect()]
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    idx = [names.index(c) for c in cols]
    want = [tuple(normal(r[i]) for i in idx) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "both empty"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (spark_types[c], types[c]) for c in cols if kinds.get(spark_types[c]) != types[c]}
    if odd:
        return f"types {odd}"
    if sorted(map(repr, got)) != sorted(map(repr, want)):
        bad = sorted(set(map(repr, got)) - set(map(repr, want)))[:3], sorted(set(map(repr, want)) - set(map(repr, got)))[:3]
        return f"values {cols} differ: {bad}"
    return ""


def main():
    from natal.session import tuned_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir, *names = sys.argv[1:]
    spark = tuned_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            out = compare(spark, con, fn, oracle_sql().get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            out = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(out)
        print(f"{'ok ' if not out else 'BAD'} {name} {time.time() - t:.2f}s {'' if name in oracle_sql() else '(rows only) '}{out}", flush=True)
        spark.catalog.clearCache()
    print("bad:", bad)


if __name__ == "__main__":
    main()
