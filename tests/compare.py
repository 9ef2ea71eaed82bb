"""Results of a query and of its SQL, made comparable."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v: object) -> object:
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def kinds(table: pa.Table) -> list[tuple[str, str]]:
    def kind(t: pa.DataType) -> str:
        for test, name in ((pa.types.is_integer, "int"), (pa.types.is_floating, "float"), (pa.types.is_decimal, "float"), (pa.types.is_timestamp, "timestamp"), (pa.types.is_large_string, "string")):
            if test(t):
                return name
        return str(t)

    return sorted((f.name, kind(f.type)) for f in table.schema)
