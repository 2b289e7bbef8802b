"""Run Spark queries and their DuckDB oracle side by side and compare
row count, column names/types and order-insensitive values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
_DUCK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
               "HUGEINT": "hugeint", "FLOAT": "float", "DECIMAL": "decimal", "TIMESTAMP": "timestamp_ntz"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    """Strict value key: NaN stays distinct from NULL and the sign of zero
    counts (a value hash would see both)."""
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return (round(v, 6), math.copysign(1.0, v))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(records, cols):
    rows = [tuple(_norm(r[c]) for c in cols) for r in records]
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, name, qfn, sql, sf_dir):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    s_schema = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rec = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_schema = {c: _DUCK_TYPES.get(str(t).split("(")[0], str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rec = [dict(zip(rel.columns, row)) for row in rel.fetchall()]
    out = {"name": name, "spark_rows": len(s_rec), "oracle_rows": len(d_rec), "sec": round(t1 - t0, 2)}
    if sorted(s_schema) != sorted(d_schema):
        out["status"] = f"COLUMNS spark={sorted(s_schema)} oracle={sorted(d_schema)}"
        return out
    tdiff = {c: (s_schema[c], d_schema[c]) for c in s_schema if s_schema[c] != d_schema[c]}
    cols = sorted(s_schema)
    a, b = _rows(s_rec, cols), _rows(d_rec, cols)
    if len(a) != len(b):
        out["status"] = "ROWCOUNT"
    elif a == b:
        out["status"] = "OK"
    else:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        def close(u, v):
            return u == v or (isinstance(u, tuple) and isinstance(v, tuple)
                              and abs(u[0] - v[0]) <= 1e-6 * max(1.0, abs(u[0])))
        approx = all(all(close(u, v) for u, v in zip(x, y)) for x, y in bad)
        out["status"] = ("APPROX" if approx else "VALUES") + f" {len(bad)} rows differ, e.g. {bad[0]}"
    if tdiff:
        out["types"] = tdiff
    return out


def main(argv):
    sys.path.insert(0, "/root/repo")
    from furrow.plans import ORACLE_SQL, QUERIES
    from furrow.session import get_session
    sf_dir = "/root/testdata/sf0.01"
    names = argv or sorted(ORACLE_SQL)
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    for n in names:
        try:
            r = compare(spark, con, n, QUERIES[n], ORACLE_SQL[n], sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e).splitlines()[0][:300]}"}
        print(r, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
