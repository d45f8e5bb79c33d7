"""Run registered queries beside their SQL: python tests/oracle_check.py [sf] [name-prefix…]

SMALL_ROWS=0 forces the plans for large inputs.
"""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v


def run_oracle(sf, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def table_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canonical(r[i]) for i in at) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark_df, sf, sql):
    """None when equal, else a short description of the first difference."""
    a_names, a = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    b_names, b = table_of(*run_oracle(sf, sql))
    if a_names != b_names:
        return f"columns {a_names} vs {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; first {a[:2]} vs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {bad[0][0]} vs {bad[0][1]}"
    kinds = [(n, type(x), type(y)) for n, x, y in zip(a_names, a[0], b[0]) if x is not None and y is not None and type(x) is not type(y)] if a else []
    return f"types {kinds}" if kinds else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", os.environ.get("SESSION_TZ", "UTC")).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("SMALL_ROWS"):
        spark.conf.set("lumora.smallRows", os.environ["SMALL_ROWS"])
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args[1:] and not any(name.startswith(p) for p in args[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            problem = compare(df, sf, oracles[name]) if name in oracles else f"(no sql) rows={df.count()}"
        except Exception as e:  # noqa: BLE001
            problem = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if problem and not problem.startswith("(no sql)"):
            bad += 1
        print(f"{'ok ' if problem is None else '-- ' if problem.startswith('(no') else 'BAD'} {name} {time.time()-start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
