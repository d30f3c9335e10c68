"""Run a registered query in Spark and its twin in DuckDB and compare the rows."""

import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(table: pa.Table, columns: list[str]) -> list[tuple]:
    data = [table.column(c).to_pylist() for c in columns]
    rows = [tuple(_plain(v) for v in row) for row in zip(*data, strict=True)]
    return sorted(rows, key=repr)


def types_of(table: pa.Table, columns: list[str]) -> dict[str, str]:
    return {c: str(table.schema.field(c).type).replace("large_", "") for c in columns}


def difference(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    columns = sorted(spark_table.column_names)
    if columns != sorted(duck_table.column_names):
        return f"columns {columns} != {sorted(duck_table.column_names)}"
    a, b = types_of(spark_table, columns), types_of(duck_table, columns)
    if a != b:
        return "types " + ", ".join(f"{c}: {a[c]} != {b[c]}" for c in columns if a[c] != b[c])
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} != {duck_table.num_rows}"
    left, right = rows_of(spark_table, columns), rows_of(duck_table, columns)
    bad = [(x, y) for x, y in zip(left, right, strict=True) if x != y]
    return f"{len(bad)} of {len(left)} rows differ, first {columns}: {bad[0]}" if bad else None
