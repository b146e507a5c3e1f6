"""Writers for files and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from loomtable.sources.delimited import read_exported

#: Largest result that may be gathered into one output file.
SINGLE_FILE_ROWS = 1_000_000
#: Rows of one exported CSV file, which one task reads back.
ROWS_PER_FILE = 250_000


def write_text(df: DataFrame, path: str, line: Column | None = None) -> None:
    """Write one text line per row; ``line`` builds it, default is the only column."""
    out = df.select(line.alias("value")) if line is not None else df
    out.write.mode("overwrite").text(path)


def one_file(df: DataFrame, max_rows: int = SINGLE_FILE_ROWS) -> DataFrame:
    """One partition, hence one part file; more than ``max_rows`` rows, too many for one task, are an error."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"one file of more than {max_rows} rows was asked for: write a folder instead")
    return df.coalesce(1)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet dataset, optionally laid out by low-cardinality columns."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Headed CSV export: nulls as empty fields, empty texts as quoted ones, ISO dates, outer blanks kept.

    ``read_exported`` gives the rows back as they were. Quoted line breaks keep a file from being split when it is
    read, so files are cut at ROWS_PER_FILE rows.
    """
    out = one_file(df) if single_file else df
    out.write.mode("overwrite").option("maxRecordsPerFile", 0 if single_file else ROWS_PER_FILE).csv(
        path, header=True, nullValue="", emptyValue='""', escape='"', dateFormat="yyyy-MM-dd",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create a database unless it exists, below a given folder or in the warehouse."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")


def save_table(df: DataFrame, database: str, name: str, fmt: str = "parquet") -> str:
    """Replace the named table by ``df``, creating its database if needed.

    The rows are first written whole as a table of another name, then the two are swapped by renaming. So a run that
    fails, on a bad row or otherwise, leaves the old table as it was, and ``df`` may read the table it replaces.
    """
    spark = df.sparkSession
    create_database(spark, database)
    full, staged = f"{database}.{name}", f"{database}.{name}_staged_{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).saveAsTable(staged)
        _swap(spark, staged, full)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    return full


def _swap(spark: SparkSession, staged: str, full: str) -> None:
    """Give the staged table the name of the other, which goes only when that is done."""
    if not spark.catalog.tableExists(full):
        spark.sql(f"ALTER TABLE {staged} RENAME TO {full}")
        return
    old = f"{full}_old_{uuid.uuid4().hex}"
    spark.sql(f"ALTER TABLE {full} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {full}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {full}")
        raise
    spark.sql(f"DROP TABLE {old}")


def reload_table(
    spark: SparkSession, csv_path: str, database: str, name: str, schema: StructType
) -> str:
    """Idempotent load of an exported CSV folder: replace the table, abort on bad rows and keep the old table then.

    Bad are: a short or long row, a value that does not fit, a file with another header, a missing target column.
    """
    return save_table(read_exported(spark, csv_path, schema), database, name)
