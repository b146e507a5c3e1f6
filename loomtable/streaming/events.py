"""Event files as a stream: routed to channels and counted by type.

Streams run with ``availableNow``: everything present is processed and the query ends.
State and progress live below the shared folder, so a restarted run continues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHANNELS = ("order", "navigation")


def read_event_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stream of the Parquet files under a path or path pattern."""
    return spark.readStream.schema(schema).parquet(path)


def channel(event_type: Column, order_types: list[str]) -> Column:
    """Channel of an event: order for the given types, navigation for the rest."""
    order, navigation = CHANNELS
    return F.when(event_type.isin(*order_types), order).otherwise(navigation)


def run_counts(events: DataFrame, keys: list[str], out: str, name: str = "events") -> None:
    """Write the count per key after each batch to a folder of its own below ``out``.

    A batch that is run again writes the same folder, and the earlier ones stay whole: see ``latest_counts``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/counts/batch={batch_id}")

    counts = events.groupBy(*keys).agg(F.count("*").alias(name))
    query = (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts after the newest batch that ``run_counts`` wrote."""
    every = spark.read.parquet(f"{out}/counts")
    return every.filter(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")


def run_routing(events: DataFrame, out: str) -> None:
    """Append events to ``out``, one folder per value of their ``channel`` column."""
    query = (
        events.writeStream.outputMode("append").format("parquet")
        .partitionBy("channel").option("path", f"{out}/routed")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
