"""Run registered queries next to their DuckDB SQL and compare whole results.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    return df[columns].sort_values(columns).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """What differs, or nothing."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    a, b = sorted_rows(spark_rows), sorted_rows(sql_rows)
    for column in a.columns:
        if a[column].isna().any() and b[column].isna().any():
            # Whole numbers with nulls may come as floating-point numbers.
            numbers = [pd.api.types.is_numeric_dtype(x[column]) for x in (a, b)]
            if all(numbers):
                a[column], b[column] = (x[column].astype("float64") for x in (a, b))
        if a[column].dtype.kind != b[column].dtype.kind:
            return f"type of {column}: {a[column].dtype} / {b[column].dtype}"
        same = (a[column] == b[column]) | (a[column].isna() & b[column].isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} rows differ in {column}: {dict(a.loc[i])} / {dict(b.loc[i])}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = make_session()
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        rows = queries[name](spark, sf_dir).toPandas()
        middle = time.time()
        note = "no SQL"
        if name in sql:
            note = difference(rows, con.sql(sql[name]).df()) or "same"
        failed += note not in ("same", "no SQL")
        print(f"{name:32s} {len(rows):9d} rows  spark {middle - start:6.2f}s  "
              f"sql {time.time() - middle:6.2f}s  {note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    sys.exit(main(sys.argv[1:]))
