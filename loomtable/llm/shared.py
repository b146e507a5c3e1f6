"""Helpers that the operators share: scratch tables, and row-wise Arrow work with whole rows passed through."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Text bytes that a worker looks at together; a longer single text is a slice of its own.
SLICE_BYTES = 4_000_000

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one for a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="loomtable-"))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there: later uses neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, texts: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_pylist()):
        if size and size + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def rows_with(
    df: DataFrame, text: str, make: Callable[[list[bytes | None]], list], out: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` as struct ``row`` beside struct ``out``, which ``make`` computes from a slice of texts.

    ``make`` gets UTF-8 texts (None for null) and returns one dict of the fields of ``out`` (a DDL string) for
    each. ``keep`` are the columns of ``row``, by default all. Since both sides stay structs, no name can clash.
    """
    names = df.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    src = df.select(row, F.col(f"`{text}`").cast("binary").alias("text"))
    fields = _parse_datatype_string(out)
    schema = StructType([src.schema["row"], StructField("out", fields)])
    kind = _arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = make(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(made, kind)], ["row", "out"])

    return src.mapInArrow(run, schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
