"""Compare a query with its SQL the way the driver does: names, row count and values without order."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "item"):
        return [plain(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir) -> list[str]:
    got = query(spark, sf_dir)
    names, rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    found = con.execute(sql)
    want_names, want = rows_of([d[0] for d in found.description], found.fetchall())
    out = []
    if names != want_names:
        out.append(f"columns {names} and {want_names}")
    if len(rows) != len(want):
        out.append(f"{len(rows)} rows and {len(want)}")
    odd = [(a, b) for a, b in zip(rows, want, strict=False) if repr(a) != repr(b)]
    return out + [f"{len(odd)} rows differ", *[f"{a}\n   {b}" for a, b in odd[:3]]] if odd else out


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sqls = connect(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        try:
            if name in sqls:
                wrong = differences(spark, con, queries[name], sqls[name], sf)
                print(name, "ok" if not wrong else "DIFFERS " + "\n  ".join(wrong), round(time.time() - began, 1), flush=True)
            else:
                print(name, "rows", queries[name](spark, sf).count(), round(time.time() - began, 1), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "FAILED", str(e)[:600], flush=True)
