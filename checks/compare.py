"""Compare queries with their SQL: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from checks.catalog import QUERIES
from checks.oracle import ORACLE
from checks.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def _sorted_rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)

    def plain(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return None
        return value.item() if hasattr(value, "item") else value

    rows = [tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def difference(spark_df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result; None if nothing does."""
    ours, theirs = spark_df.toPandas(), db.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for column in sorted(ours.columns):
        kinds = [f[column].dropna().infer_objects().dtype.kind for f in (ours, theirs)]
        if kinds[0] != kinds[1] and "O" in kinds:
            return f"{column}: type {kinds}"
    for a, b in zip(_sorted_rows(ours), _sorted_rows(theirs)):
        same = all(x == y and isinstance(x, str) == isinstance(y, str) for x, y in zip(a, b))
        if not same:
            return f"{str(a)[:300]} against {str(b)[:300]}"
    return None


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(QUERIES)
    spark, db, failed = local_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLE:
                found = difference(QUERIES[name](spark, sf_dir), db, ORACLE[name])
            else:
                found = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += found is not None
        verdict = "ok" if found is None else f"DIFFERS: {found}"
        kind = "sql" if name in ORACLE else "rows"
        print(f"{name:24} {kind:5} {time.time() - start:6.2f} s  {verdict}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
