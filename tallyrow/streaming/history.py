"""Incremental history bins: the same counts as the batch operator, as data arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrow.operators.history import GLOBAL_FID, history_values, available_time
from tallyrow.plans.fixed import DAY, HOUR


def history_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    columns: dict[int, str],
    bin_sec: int = HOUR,
    maturity: int = DAY,
    lateness_sec: int = 0,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Read Parquet files as they come, count per (fid, value, bin of availability time).

    A bin is written once the watermark has passed its end; later rows of it are dropped.
    Processes what is there now and returns the sink as a batch table; bins still open stay
    in the state of ``checkpoint`` for the next call.
    """
    when = available_time(F.col("timestamp"), F.col("label_type"), F.col("label_time"), maturity)
    positive = (F.coalesce(F.col("label_type"), F.lit(0)) == 2).cast("bigint")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = (
        reader.parquet(source)
        .select(
            F.timestamp_seconds(when).alias("available"),
            positive.alias("positive"),
            F.explode(history_values(columns)).alias("p"),
        )
        .select("available", "positive", "p.fid", "p.value")
        .where((F.col("fid") == GLOBAL_FID) | (F.col("value") > 0))
    )
    counts = (
        rows.withWatermark("available", f"{lateness_sec} seconds")
        .groupBy(F.window("available", f"{bin_sec} seconds"), "fid", "value")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("positive").alias("pos"))
        .select(
            "fid",
            "value",
            F.floor(F.unix_timestamp("window.start") / bin_sec).cast("bigint").alias("bin"),
            "cnt",
            "pos",
        )
    )
    query = (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(sink)
