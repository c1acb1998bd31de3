"""Runs registered queries against their DuckDB SQL on a folder of tables."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        at = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return tuple(plain(v) for _, v in sorted(x.asDict().items()))
    if isinstance(x, dict):
        return tuple(plain(v) for _, v in sorted(x.items()))
    return x


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if the rows agree, else the first difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = duck(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(names)}"
    if got != want:
        odd = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return f"{len(got)} rows, SQL {len(want)}; first difference {odd}"
    return "" if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or qs:
        t = time.time()
        try:
            said = difference(spark, qs[name], sql[name], sf) or "same" if name in sql else f"{qs[name](spark, sf).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
    sys.stdout.flush()
    os._exit(0)
