"""Compare registered queries with their SQL: columns, types by kind, rows as a multiset.

    python tests/oracle.py [name ...]      # all queries without names
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "tolist"):
        return cell(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in rows)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def kinds(counter):
    out = {}
    for row in counter:
        for i, v in enumerate(row):
            if v is not None:
                out.setdefault(i, set()).add(kind(v))
    return out


def expected(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return rows_of(columns, cur.fetchall())


def compare(df, sf, sql):
    """Problems found, empty when both sides agree."""
    got_columns, got = rows_of(df.columns, df.collect())
    want_columns, want = expected(sf, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if kinds(got) != kinds(want):
        return f"types {kinds(got)} != {kinds(want)} {got_columns}"
    if got != want:
        extra, lacking = list((got - want).items()), list((want - got).items())
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; {len(extra)} only here {sorted(extra, key=str)[:2]}, "
            f"{len(lacking)} only there {sorted(lacking, key=str)[:2]} {got_columns}"
        )
    return ""


def main(names):
    import __spark_entry__ as entry
    from jobsignals.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sqls:
                problem = compare(df, sf, sqls[name])
                note = "ok"
            else:
                problem, note = "", f"no SQL, {df.count()} rows"
        except Exception as e:  # keep going: the list of failures is the result
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += bool(problem)
        print(f"{name:36s} {time.time() - start:6.1f}s {problem or note}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
