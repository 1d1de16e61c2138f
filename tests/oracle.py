"""python tests/oracle.py SF_DIR [QUERY...]: compares queries with their oracle SQL."""

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime, timezone
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, Decimal):
        return float(f"{float(x):.9g}") + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat() if x.tzinfo is None else x.astimezone(timezone.utc).replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, value(v)) for k, v in x.items()))
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = []
    for name in sys.argv[2:] or sorted(qs):
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, sf, qs[name], sqls[name])
            else:
                said = None
                print("  rows", len(qs[name](spark, sf).collect()), end=" ")
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{'ok  ' if said is None else 'BAD '} {name} {time.time() - t:.1f}s {said or ''}", flush=True)
        if said:
            bad.append(name)
    print("bad:", bad)
