"""Incremental refresh: new day files only, idempotent merges, minute bars on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_days(prints: DataFrame, stored: DataFrame) -> DataFrame:
    """Prints later than what is stored for their symbol (a true maximum each; symbols not stored are all new). Late rows stay out."""
    last = stored.groupBy("symbol").agg(F.max("date").alias("__last"))
    return prints.join(last, "symbol", "left").where(F.col("__last").isNull() | (F.col("date") > F.col("__last"))).drop("__last")


def merge_daily(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with fresh ones in their place, by symbol, broker and date: merging twice changes nothing."""
    return stored.join(fresh, ["symbol", "broker", "date"], "left_anti").unionByName(fresh.select(stored.columns))


def minute_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling one-minute bars of a tick stream; ticks later than the watermark are dropped."""
    w = ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "symbol")
    return w.agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").alias("n"))


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Take day files that have not been read yet and write them by date; each file is read once, also after a failure."""
    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).partitionBy("date").format("parquet").start(target)
    q.awaitTermination()
