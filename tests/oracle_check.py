"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, sf_dir: str, name: str, build, sql: str | None, con=None):
    con = con or duck_conn(sf_dir)
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    info = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(d_cols):
        info.update(ok=False, why=f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        return info
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
        info.update(ok=False, why=f"values differ, first: {diff}")
        return info
    info["ok"] = True
    tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT"}
    dtypes = {d[0]: str(d[1]) for d in res.description}
    bad_t = [(f.name, f.dataType.simpleString(), dtypes.get(f.name)) for f in sdf.schema.fields
             if tmap.get(f.dataType.simpleString(), f.dataType.simpleString()) != dtypes.get(f.name)]
    if bad_t:
        info.update(ok=False, why=f"types differ: {bad_t}")
    return info


def main(argv):
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession
    import __spark_entry__ as E

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="oracle-ckpt-"))
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    qs, orc = E.queries(), E.oracle_sql()
    con = duck_conn(sf)
    bad = 0
    for n in (names or sorted(qs)):
        try:
            r = compare(spark, sf, n, qs[n], orc.get(n), con)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"TOTAL {len(names or qs)} bad {bad}")


if __name__ == "__main__":
    main(sys.argv)
