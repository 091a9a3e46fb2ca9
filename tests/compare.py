"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SAME_TYPE = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT",
    "timestamp_ntz": "TIMESTAMP",
}


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    shown = []
    for row in frame.itertuples(index=False, name=None):
        shown.append(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA else v for v in row))
    return sorted(shown, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark_df, con: duckdb.DuckDBPyConnection, query: str) -> list[str]:
    """Empty if columns, types, row count and values agree; floats must be equal."""
    found = []
    relation = con.sql(query)
    ours = {n: _SAME_TYPE.get(t, t) for n, t in spark_df.dtypes}
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types, strict=True)}
    if ours != theirs:
        found.append(f"types: {sorted(set(ours.items()) ^ set(theirs.items()))}")
    if set(ours) != set(theirs):
        return found
    left, right = _rows(spark_df.toPandas()), _rows(relation.df())
    if len(left) != len(right):
        found.append(f"rows: {len(left)} and {len(right)}")
    if not left:
        found.append("no rows")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, columns {sorted(ours)}, first {bad[0]}")
    return found


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import session

    spark = session()
    con = database(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf)
            problems = differences(df, con, sqls[name]) if name in sqls else ([] if df.count() else ["no rows"])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{'' if name in sqls else ' rows only'}", *problems, sep="\n     " if problems else " ", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
