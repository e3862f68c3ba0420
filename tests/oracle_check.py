"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows, schema, values.

Usage: python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from parlance.plans.inputs import TABLES

_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                  "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
                  "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = [(f.name, f.dataType.simpleString()) for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [(d[0], str(d[1])) for d in rel.description]
    d_rows = rel.fetchall()
    t2 = time.time()
    problems = []
    if sorted(c for c, _ in s_cols) != sorted(c for c, _ in d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        dt = dict(d_cols)
        for c, t in s_cols:
            want = _SPARK_TO_DUCK.get(t)
            if want and dt[c] != want:
                problems.append(f"type {c}: spark {t} duck {dt[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        s_order = sorted(range(len(s_cols)), key=lambda i: s_cols[i][0])
        d_idx = {c: i for i, (c, _) in enumerate(d_cols)}
        d_order = [d_idx[s_cols[i][0]] for i in s_order]
        a = sorted((tuple(_norm(r[i]) for i in s_order) for r in s_rows), key=repr)
        b = sorted((tuple(_norm(r[i]) for i in d_order) for r in d_rows), key=repr)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows), t1 - t0, t2 - t1


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from parlance.session import get_spark
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in orc:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:28s} rows-only {n}")
            continue
        try:
            problems, n, ts, td = compare(spark, con, name, qs[name], orc[name], sf_dir)
        except Exception as e:  # report and go on
            problems, n, ts, td = [f"error: {str(e)[:600]}"], -1, 0, 0
        status = "OK" if not problems else "FAIL"
        bad += bool(problems)
        print(f"{name:28s} {status:4s} rows={n} spark={ts:.1f}s duck={td:.2f}s {'; '.join(problems)[:900]}")
    print(f"{bad} failing of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
