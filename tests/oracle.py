"""Compares registered queries with their check SQL.  ``python tests/oracle.py [name …]``"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def normal_form(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(spark, con, query, sql, sf_dir):
    """None when equal, else a short text."""
    df = query(spark, sf_dir)
    ours = normal_form(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = normal_form([c[0] for c in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return (f"rows {len(ours[1])} / {len(theirs[1])}, only ours {len(a - b)}: {sorted(a - b)[:2]}, "
                f"only check {len(b - a)}: {sorted(b - a)[:2]}")[:3000]
    return None if ours[1] else "EMPTY"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from vulnsieve.session import build_session

    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    con, known, checks = connect(sf_dir), queries(), oracle_sql()
    bad = 0
    for name in sys.argv[1:] or known:
        start = time.time()
        try:
            if name in checks:
                outcome = differences(spark, con, known[name], checks[name], sf_dir)
            else:
                outcome = f"no check, {known[name](spark, sf_dir).count()} rows"
        except Exception as error:  # report and go on with the next query
            outcome = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += outcome is not None and not outcome.startswith("no check")
        print(f"{time.time() - start:6.1f}s {name}: {outcome or 'ok'}", flush=True)
    print("different:", bad)
