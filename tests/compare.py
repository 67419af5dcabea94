"""Run queries on Spark and their SQL on DuckDB and compare schema, rows and values exactly."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAME = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
        "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else -1.0)
                 for v in row)


def compare(spark, con, name, fn, sql, sf_dir):
    """Return an error text or None, the number of rows and the seconds Spark took."""
    t = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    took = time.time() - t
    if sql is None:
        return None, len(mine), took
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    theirs = res.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", len(mine), took
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in cols:
        if SAME.get(types[c]) != kinds[c]:
            return f"type of {c}: {kinds[c]} != {types[c]}", len(mine), took
    order = [names.index(c) for c in cols]
    theirs = [tuple(r[i] for i in order) for r in theirs]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}", len(mine), took
    mine.sort(key=_key), theirs.sort(key=_key)
    diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if diff:
        return f"{len(diff)} rows differ, first\n   spark {dict(zip(cols, diff[0][0]))}\n   duck  {dict(zip(cols, diff[0][1]))}", len(mine), took
    return None, len(mine), took


def main(argv):
    import __spark_entry__ as entry
    from caseload.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = duck(sf_dir), entry.queries(), entry.oracle_sql()
    picked = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad, total = 0, 0.0
    for n in picked:
        try:
            err, rows, took = compare(spark, con, n, queries[n], oracle.get(n), sf_dir)
        except Exception as e:  # report and go on with the next query
            err, rows, took = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0.0
        total += took
        bad += err is not None
        note = "" if n in oracle else " (no SQL)"
        print(f"{'FAIL' if err else 'ok  '} {n}{note} rows={rows} {took:.2f}s" + (f"\n  {err}" if err else ""), flush=True)
    print(f"{len(picked) - bad}/{len(picked)} ok, {total:.1f}s")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
