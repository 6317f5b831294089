"""Run registered queries in Spark and their DuckDB twins, compare like the driver.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.plans.registry import entries  # noqa: E402
from tessera.session import local_session  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402

_SPARK2DUCK = {
    "IntegerType": "INTEGER",
    "LongType": "BIGINT",
    "DoubleType": "DOUBLE",
    "FloatType": "FLOAT",
    "StringType": "VARCHAR",
    "BooleanType": "BOOLEAN",
    "TimestampNTZType": "TIMESTAMP",
    "TimestampType": "TIMESTAMP WITH TIME ZONE",
    "DateType": "DATE",
    "ShortType": "SMALLINT",
    "ByteType": "TINYINT",
}


def spark_type_name(t) -> str:
    from pyspark.sql import types as T

    if isinstance(t, T.ArrayType):
        return spark_type_name(t.elementType) + "[]"
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    if isinstance(t, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {spark_type_name(f.dataType)}" for f in t.fields) + ")"
    return _SPARK2DUCK.get(type(t).__name__, type(t).__name__)


def norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, digits)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return tuple(norm(x, digits) for x in v)
    return v


def rows_key(rows, order, digits=None):
    out = [tuple(norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    res = {"name": name}
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    res["spark_sec"] = round(time.time() - t0, 2)
    scols = sdf.columns
    stypes = [spark_type_name(f.dataType) for f in sdf.schema.fields]
    res["rows"] = len(srows)
    if sql is None:
        res["status"] = "rows-only"
        return res
    t0 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = [str(t) for t in rel.types]
    drows = rel.fetchall()
    res["duck_sec"] = round(time.time() - t0, 2)
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={scols} duck={dcols}"
        return res
    so = sorted(range(len(scols)), key=lambda i: scols[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    st = [stypes[i] for i in so]
    dtt = [dtypes[i] for i in do]
    type_ok = st == dtt
    exact = rows_key(srows, so) == rows_key(drows, do)
    approx = exact or rows_key(srows, so, 6) == rows_key(drows, do, 6)
    res["status"] = ("OK" if exact else "APPROX" if approx else "MISMATCH") + ("" if type_ok else " TYPES")
    if not type_ok:
        res["types"] = [(scols[i], a, b) for i, a, b in zip(so, st, dtt) if a != b]
    if not approx:
        a = rows_key(srows, so, 6)
        b = rows_key(drows, do, 6)
        res["spark_only"] = [r for r in a if r not in set(b)][:3]
        res["duck_only"] = [r for r in b if r not in set(a)][:3]
    return res


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    reg = entries()
    bad = 0
    for name, e in reg.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, e.fn, e.sql, sf_dir)
        except Exception as ex:  # noqa: BLE001
            r = {"name": name, "status": "ERROR", "error": f"{type(ex).__name__}: {str(ex)[:400]}"}
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(json.dumps(r, default=str), flush=True)
    print(f"# {len(reg) if not names else len(names)} checked, {bad} not OK")


if __name__ == "__main__":
    main()
