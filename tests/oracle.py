"""Run registered queries next to their SQL in DuckDB and compare exactly."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


SPARK_TYPES = {
    "long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _sortable(row):
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, bool) else (True, "bool", v) for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types and values; empty when both agree."""
    rel = con.sql(sql)
    problems = []
    ours = {f.name: SPARK_TYPES.get(f.dataType.typeName(), f.dataType.typeName()) for f in df.schema.fields}
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    if set(ours) != set(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    problems += [f"type {n}: {ours[n]} != {theirs[n]}" for n in ours if ours[n] != theirs[n]]
    names = sorted(ours)
    spark_rows = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=_sortable)
    index = [rel.columns.index(n) for n in names]
    duck_rows = sorted((tuple(_plain(r[i]) for i in index) for r in rel.fetchall()), key=_sortable)
    if len(spark_rows) != len(duck_rows):
        return problems + [f"rows {len(spark_rows)} != {len(duck_rows)}"]
    wrong = [(a, b) for a, b in zip(spark_rows, duck_rows, strict=True) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} of {len(duck_rows)} rows differ, first {names}: {wrong[0]}")
    if not duck_rows:
        problems.append("empty result")
    return problems


def main(sf_dir: str, only: list[str]) -> int:
    from loomtable import catalog
    from loomtable.session import get_session

    catalog.load()
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, run in catalog.QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problems = compare(run(spark, sf_dir), con, catalog.ORACLES[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}{name} {time.time() - start:.1f}s", *problems, sep="\n    " if problems else " ")
    print(f"{bad} bad of {len(catalog.QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
