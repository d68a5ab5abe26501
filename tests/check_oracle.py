"""Compare registered queries with their SQL answers: check_oracle.py SF_DIR [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402
from tallyboard.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SAME_KIND = {"int": "integer", "string": "varchar"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    """Whether the query's rows equal those of its SQL answer, and why not."""
    df = spark_entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        return bool(got), f"rows only: {len(got)}"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).lower() for d in cur.description}
    spark_kinds = dict(df.dtypes)
    apart = {
        c: (spark_kinds.get(c), kinds[c])
        for c in columns
        if SAME_KIND.get(spark_kinds.get(c), spark_kinds.get(c)) != kinds[c]
    }
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows" + (f", types {apart}" if apart else "")
    odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return False, f"{len(got)} vs {len(want)} rows, {sorted(columns)}: {odd}"


if __name__ == "__main__":
    sf = sys.argv[1]
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    bad = 0
    for q in sys.argv[2:] or list(spark_entry.queries()):
        began = time.time()
        try:
            ok, note = compare(session, db, sf, q)
        except Exception as error:  # noqa: BLE001
            ok, note = False, repr(error)[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {q} {time.time() - began:.1f}s {note}", flush=True)
    sys.exit(bad)
