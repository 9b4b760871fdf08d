"""Runs named queries in Spark and their SQL in DuckDB over one data folder and compares the rows.

python tests/compare.py FOLDER [NAME...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.9g}") + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted(((canon(k), canon(x)) for k, x in v.items()), key=repr))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def canon_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        name, path = f.removesuffix(".parquet"), os.path.join(folder, f)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def run_pair(spark, con, query, sql, folder):
    """'' if equal, else what differs."""
    df = query(spark, folder)
    got = canon_rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = canon_rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        a, b = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {sum(got.values())} and {sum(want.values())}\n   only spark {str(a)[:700]}\n   only sql   {str(b)[:700]}"
    return ""


def main():
    import __spark_entry__ as e
    from docweave.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sql = e.queries(), e.oracle_sql()
    bad = 0
    for n in names or sorted(queries):
        t = time.time()
        try:
            said = run_pair(spark, con, queries[n], sql[n], folder) if n in sql else f"no SQL; {queries[n](spark, folder).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:900]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(n, f"{time.time() - t:.1f}s", said or "equal", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
