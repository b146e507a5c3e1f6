"""Line-oriented and delimited files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomtable.functions.cleaning import strict_long
from loomtable.session import scratch_path

CORRUPT = "_corrupt_record"
#: Stands for a missing field while an export is read, so that empty texts differ from it.
NO_VALUE = "\ue000"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or many text files (wildcards allowed) as column ``value``."""
    return spark.read.text(path)


def drop_header(lines: DataFrame, header: str, column: str = "value") -> DataFrame:
    """Remove every line equal to the header, in whichever file it stands."""
    return lines.filter(F.col(column) != header)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    sep: str = ",",
    header: bool = False,
    encoding: str = "UTF-8",
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """Delimited files under an explicit schema; no inference pass over the data.

    A row that does not fit keeps what fits and nulls (PERMISSIVE), goes (DROPMALFORMED) or is an error (FAILFAST).
    The last two count all fields of a row, but Spark converts only those that are selected later: what is wrong in
    the others goes unseen. ``read_quarantined`` looks at all.
    """
    return spark.read.schema(schema).option("columnPruning", mode == "PERMISSIVE").csv(
        path, sep=sep, header=header, encoding=encoding, mode=mode
    )


def read_with_ids(
    spark: SparkSession, path: str | list[str], schema: StructType, ids: list[str], **options,
) -> DataFrame:
    """Like ``read_delimited``, with 64-bit ids in the columns ``ids``: a whole number beyond that is an error."""
    text = StructType([StructField(f.name, StringType() if f.name in ids else f.dataType) for f in schema])
    rows = read_delimited(spark, path, text, **options)
    return rows.select(*[strict_long(F.col(c)).alias(c) if c in ids else F.col(c) for c in rows.columns])


def read_raw(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Landing read: headed CSV with every column kept as text."""
    text_only = StructType([StructField(f.name, StringType()) for f in schema])
    return read_delimited(spark, path, text_only, header=True)


def read_exported(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Exported CSV folders as they were written, strictly: quoted line breaks, outer blanks and empty texts are kept.

    Columns are matched by name (any case). A missing column is an error at once; a short or long row, a file with
    another header, or a value that does not fit its type is an error when read.
    """
    layout = {"header": True, "multiLine": True, "escape": '"', "nullValue": NO_VALUE, "emptyValue": ""}
    names = spark.read.csv(path, **layout).columns
    missing = {n.lower() for n in schema.fieldNames()} - {n.lower() for n in names}
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    text = StructType([StructField(n, StringType()) for n in names])
    # Without pruning every field of a row is counted, whatever is selected.
    rows = spark.read.schema(text).option("columnPruning", False).csv(
        path, enforceSchema=False, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        **layout)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


#: Types that are inferred, the narrowest first: how their values look. Other columns stay text.
INFERRED = {
    "int": r"^[+-]?[0-9]{1,10}$",
    "bigint": r"^[+-]?[0-9]{1,19}$",
    "double": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "boolean": r"^(?i)(true|false)$",
}
#: Rows at the start of the data from which types are inferred.
SAMPLE_ROWS = 10_000


def _fits(value: Column, kind: str) -> Column:
    return value.isNull() | (value.rlike(INFERRED[kind]) & value.try_cast(kind).isNotNull())


def infer_types(sample: DataFrame) -> dict[str, str]:
    """The narrowest of INFERRED that all values of each text column fit; ``string`` where none does or all are null."""
    checks = [F.count(F.col(f"`{c}`")).alias(f"{i} n") for i, c in enumerate(sample.columns)]
    checks += [F.bool_and(_fits(F.col(f"`{c}`"), k)).alias(f"{i} {k}")
               for i, c in enumerate(sample.columns) for k in INFERRED]
    found = sample.agg(*checks).first()
    return {
        c: next((k for k in INFERRED if found[f"{i} n"] and found[f"{i} {k}"]), "string")
        for i, c in enumerate(sample.columns)
    }


def read_inferred(
    spark: SparkSession, path: str, names: list[str] | None = None, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Headed CSV with inferred types, optionally renamed by position.

    Types are inferred from the first ``sample_rows`` rows alone, so the data are read once. That read checks every
    value: one that does not fit its column's type is an error, never a silent null. A larger sample or an explicit
    schema then helps.
    """
    text = spark.read.csv(path, header=True)
    types = infer_types(spark.createDataFrame(text.head(sample_rows), text.schema))

    def typed(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind == "string":
            return value
        told = F.concat(F.lit(f"column {name} was inferred as {kind} and holds "), value)
        return F.when(_fits(value, kind), value.try_cast(kind)).otherwise(F.raise_error(told)).alias(name)

    df = text.select(*[typed(name, kind) for name, kind in types.items()])
    return df.toDF(*names) if names else df


def parse_lines(
    lines: DataFrame,
    schema: StructType,
    sep: str = ",",
    column: str = "value",
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """Parse one delimited text column into the schema's columns, keeping the others.

    In PERMISSIVE mode a ``_corrupt_record`` column holds each line that does not fit
    the schema. The parse is an ordinary expression, so neither a later column
    selection nor a ``count`` can change which lines are flagged (the CSV scan's own
    corrupt-record column is subject to column pruning and is not reliable there).
    """
    options = {"sep": sep, "mode": mode}
    target = StructType(list(schema.fields))
    if mode == "PERMISSIVE":
        target = target.add(CORRUPT, StringType())
        options["columnNameOfCorruptRecord"] = CORRUPT
    parsed = F.from_csv(F.col(column), ddl(target), options)
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, parsed.alias("_row")).select(
        *others, *[F.col("_row")[f.name].alias(f.name) for f in target]
    )


def read_quarantined(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    sep: str = ",",
    header: bool = True,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Read delimited files and split them into ``(usable, malformed)`` rows.

    Both carry ``source_filename``; ``malformed`` also keeps the whole raw record, and of its fields those that fit.
    With ``multi_line`` a quoted field may hold line breaks (a file is then read by one task). Quotes within quotes are
    doubled. With ``header``, every record that repeats the column names goes, in whichever file it stands.

    All fields of a record are parsed and the rows written once before they are split, so neither a later selection nor
    a count can change which of them are malformed.
    """
    names = schema.fieldNames()
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(wide).option("columnPruning", False).csv(
        path, sep=sep, encoding=encoding, multiLine=multi_line, escape='"', columnNameOfCorruptRecord=CORRUPT,
    ).select("*", source_file().alias("source_filename"))
    if header:
        raw = F.regexp_replace(CORRUPT, '["\ufeff]', "") == sep.join(names)
        same = F.forall(F.array(*[F.coalesce(F.col(f"`{n}`").cast("string") == n, F.lit(False)) for n in names]),
                        lambda x: x)
        rows = rows.filter(~F.coalesce(raw, F.lit(False)) & ~same)
    written = scratch_path(spark, "records")
    rows.write.parquet(written)
    rows = spark.read.schema(rows.schema).parquet(written)
    good = F.col(CORRUPT).isNull()
    return rows.filter(good).drop(CORRUPT), rows.filter(~good)


def ddl(schema: StructType) -> str:
    """Schema as a DDL string, with quoted names."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def source_file() -> Column:
    """Name of the file a row was read from (file sources only)."""
    return F.col("_metadata.file_name")
