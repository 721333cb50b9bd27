"""Cross-engine check: a catalogue query in Spark vs its SQL oracle in DuckDB.

Mirrors the acceptance check: same column names, same row count, same column
type families and the same order-insensitive hash of all values.
"""

from __future__ import annotations

import hashlib
import math
from typing import Any

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duckdb_connection(sf_dir: str):
    import os

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v: Any) -> Any:
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return v if isinstance(v, (int, str, bool)) else str(v)


def _family(type_name: str) -> str:
    t = type_name.lower()
    if any(k in t for k in ("tinyint", "smallint", "bigint", "long", "int", "hugeint")):
        return "int"
    if any(k in t for k in ("double", "float", "real", "decimal")):
        return "float"
    if any(k in t for k in ("string", "varchar", "char")):
        return "str"
    if "bool" in t:
        return "bool"
    return t


def value_hash(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\n")
    return h.hexdigest()


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_types = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duckdb_connection(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: _family(str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "types_match": s_types == d_types,
    }
    out["rows_match"] = out["spark_rows"] == out["oracle_rows"]
    out["hash_match"] = out["columns_match"] and value_hash(s_cols, s_rows) == value_hash(
        d_cols, d_rows
    )
    out["ok"] = all(out[k] for k in ("columns_match", "types_match", "rows_match", "hash_match"))
    if not out["ok"]:
        out["spark_columns"] = s_types
        out["oracle_columns"] = d_types
    return out
