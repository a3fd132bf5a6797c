"""Run a registered query on Spark and its oracle on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (int, str)):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """(problem or None, spark rows, spark seconds, duck seconds)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    if sql is None:
        return None, len(got), spark_time, 0.0
    start = time.time()
    cur = con.execute(sql)
    want_columns, want = [d[0] for d in cur.description], cur.fetchall()
    duck_time = time.time() - start
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} / {sorted(want_columns)}", len(got), spark_time, duck_time
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2] if len(a) < 20000 else []
        missing = [r for r in b if r not in set(a)][:2] if len(b) < 20000 else []
        return f"rows {len(a)} / {len(b)}; only spark {extra}; only duckdb {missing}", len(got), spark_time, duck_time
    types = [(type(x), type(y)) for r, s in zip(a, b) for x, y in zip(r, s) if type(x) is not type(y)]
    return (f"types {types[0]}" if types else None), len(got), spark_time, duck_time


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from changelens.session import build_session

    sf, patterns = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(f"/root/testdata/sf{sf}")
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if patterns and not any(p in name for p in patterns):
            continue
        try:
            problem, n, t1, t2 = compare(spark, con, name, fn, oracle.get(name), f"/root/testdata/sf{sf}")
        except Exception as error:  # noqa: BLE001
            problem, n, t1, t2 = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0, 0
        flag = "ok  " if problem is None and n else "EMPTY" if problem is None else "FAIL"
        print(f"{flag} {name} rows={n} spark={t1:.2f}s duck={t2:.2f}s {'' if name in oracle else '(no oracle)'} {problem or ''}"[:1800], flush=True)
