"""Compare queries with their SQL: ``python tests/oracle_check.py SF_DIR [name prefix ...]``."""

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, folder):
    """Difference between both sides as text; empty when they agree."""
    frame = query(spark, folder)
    columns = frame.columns
    left = rows_of(columns, frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} / {sorted(names)}"
    right = rows_of(names, cursor.fetchall())
    if left == right:
        return ""
    in_left, in_right = set(left), set(right)
    only_left = [r for r in left if r not in in_right][:4]
    only_right = [r for r in right if r not in in_left][:4]
    return f"rows {len(left)} / {len(right)}\n   spark {only_left}\n   sql   {only_right}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="rollkeeper-tables-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if name not in oracles or (prefixes and not any(name.startswith(p) for p in prefixes)):
            continue
        began = time.time()
        try:
            difference = compare(spark, con, name, query, oracles[name], folder)
        except Exception as error:  # noqa: BLE001
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(difference)
        print("DIFF" if difference else "SAME", name, round(time.time() - began, 1), difference, flush=True)
    print("DONE failed:", failed, flush=True)


if __name__ == "__main__":
    main()
