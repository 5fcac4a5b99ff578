"""Run registered queries and their SQL side by side: python tests/compare.py SF_DIR [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf_dir):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def canon(v):
    if isinstance(v, float):
        return repr(round(v, 6)) if v != int(v) else repr(int(v))
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, db, sf_dir, name, run, sql):
    t = time.time()
    df = run(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"rows-only {name} {len(got)} rows {took:.1f}s", None
    t = time.time()
    rel = db.sql(sql)
    want, want_cols = rows_of(rel.columns, rel.fetchall())
    sql_took = time.time() - t
    ok = got == want and got_cols == want_cols
    note = f"{'ok  ' if ok else 'DIFF'} {name} {len(got)}/{len(want)} rows spark {took:.1f}s sql {sql_took:.1f}s"
    if not ok:
        g, w = set(got), set(want)
        note += f"\n   columns {got_cols} {want_cols}\n   only spark {sorted(g - w)[:3]}\n   only sql {sorted(w - g)[:3]}"
    return note, ok


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "10g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    db, oracles = database(sf_dir), entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            note, ok = compare(spark, db, sf_dir, name, run, oracles.get(name))
            bad += ok is False
        except Exception as e:  # noqa: BLE001
            note, bad = f"FAIL {name} {type(e).__name__} {str(e)[:500]}", bad + 1
        print(note, flush=True)
    print("bad:", bad)
    sys.exit(1 if bad else 0)
