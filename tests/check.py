"""Compare every registered query with its SQL on one scale factor.

    python tests/check.py [sf_dir] [query ...]
"""

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows  {name:26s} {len(got):7d} rows {took:6.2f}s", True
    t = time.time()
    out = con.sql(sql)
    want = out.fetchall()
    sql_took = time.time() - t
    if sorted(df.columns) != sorted(out.columns):
        return f"FAIL  {name}: columns {sorted(df.columns)} != {sorted(out.columns)}", False
    kinds = dict(zip(df.columns, (f.dataType.simpleString() for f in df.schema.fields)))
    sql_kinds = dict(zip(out.columns, map(str, out.types)))
    a, b = rows_of(df.columns, got), rows_of(out.columns, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return (
            f"FAIL  {name}: {len(a)} vs {len(b)} rows; columns {sorted(df.columns)}; {diff}",
            False,
        )
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {c: (kinds[c], sql_kinds[c]) for c in kinds if same.get(kinds[c]) != sql_kinds[c]}
    note = f"  types differ: {odd}" if odd else ""
    return f"ok    {name:26s} {len(a):7d} rows {took:6.2f}s sql {sql_took:6.2f}s{note}", True


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        try:
            line, fine = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the other queries
            line, fine = f"ERROR {name}: {str(error)[:700]}", False
        bad += not fine
        print(line, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
