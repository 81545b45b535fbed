"""Impression table derived from the ``events`` log, with per-user behaviour lists."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrow.operators.ordered import number_rows, preceding_lists
from tallyrow.sources.tables import scan_impressions

# Behaviour domain: letter, event type, fid of the timestamp list, fid of the item list.
DOMAINS = (
    ("a", "view", 39, 40),
    ("b", "click", 67, 68),
    ("c", "signup", 27, 28),
    ("d", "purchase", 26, 29),
)
LOOK_BACK = 64


def epoch_seconds(ts: Column, dtype: T.DataType) -> Column:
    """Epoch seconds, independent of the session zone for zone-less timestamps."""
    if isinstance(dtype, T.TimestampNTZType):
        days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
        return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("bigint")
    return F.unix_timestamp(ts)


def _ints(*values: Column) -> Column:
    return F.array(*[v.cast("bigint") for v in values])


def _bound(second: int, dtype: T.DataType) -> Column:
    """A second as a literal of the log's own time type, so that the comparison reaches the scan."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(str(datetime.fromtimestamp(second, timezone.utc).replace(tzinfo=None))).cast(dtype)
    return F.timestamp_seconds(F.lit(second))


def impressions(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """One impression per event, all columns but the behaviour lists. No shuffle.

    ``start`` and ``end`` keep ``start <= timestamp < end`` (epoch seconds); they are compared with the stored
    time, so the scan skips what lies outside.
    """
    events = scan_impressions(spark, f"{sf_dir}/events.parquet")
    stored = events.schema["ts"].dataType
    if start is not None:
        events = events.where(F.col("ts") >= _bound(start, stored))
    if end is not None:
        events = events.where(F.col("ts") < _bound(end, stored))
    t = epoch_seconds(F.col("ts"), stored).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    event_id, user_id, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")

    def every(n: int) -> Column:
        return event_id % n == 0

    base = events.select(
        "event_id", "user_id", "event_type", "value", t.alias("timestamp"), k.alias("item_id")
    )
    k, t = F.col("item_id"), F.col("timestamp")
    return base.select(
        "event_id",
        "timestamp",
        "user_id",
        "item_id",
        F.when(kind == "purchase", 2)
        .when(kind == "click", 1)
        .when(kind == "error", None)
        .otherwise(0)
        .cast("int")
        .alias("label_type"),
        F.when((kind == "purchase") & ~every(3), t + (event_id % 72) * 1800).cast("bigint").alias("label_time"),
        (user_id % 7).alias("user_int_feats_1"),
        F.when(every(5), None).when(every(11), -1).otherwise(event_id % 300).cast("bigint").alias("user_int_feats_2"),
        F.when(every(17), None)
        .when(every(13), F.array().cast("array<bigint>"))
        .otherwise(_ints(k % 4, k % 3, F.lit(-1)))
        .alias("user_int_feats_3"),
        (k + 1).alias("item_int_feats_11"),
        (k % 10).alias("item_int_feats_12"),
        F.array(F.col("value") / 100, -F.col("value") / 100).alias("user_dense_feats_61"),
        F.array(F.col("value") * 1000).alias("user_dense_feats_62"),
        F.floor(event_id / 97).cast("bigint").alias("block_time"),
        (event_id % 40).alias("block_mix"),
        "event_type",
    )


def impressions_with_sequences(
    spark: SparkSession, sf_dir: str, chunk_rows: int = 1 << 16, look_back: int = LOOK_BACK
) -> DataFrame:
    """Impressions plus, per domain, what the user did in the ``look_back`` events before (FIXTURES.md, B2)."""
    rows = impressions(spark, sf_dir)
    lists = {}
    for letter, kind, ts_fid, item_fid in DOMAINS:
        hit = F.col("event_type") == kind
        lists[f"domain_{letter}_seq_{ts_fid}"] = F.when(hit, F.col("timestamp"))
        lists[f"domain_{letter}_seq_{item_fid}"] = F.when(hit, F.col("item_id"))
    return preceding_lists(
        rows, "user_id", "timestamp", ["event_id"], lists, look_back, chunk_rows=chunk_rows
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored table: label, raw score (some NaN, many ties) and slice inputs."""
    rows = impressions(spark, sf_dir)
    event_id = F.col("event_id")
    label = (F.col("event_type") == "purchase").cast("bigint")
    score = ((event_id * 7919) % 1000).cast("double") / 250.0 - 2.0 + label.cast("double") * 0.5
    return rows.select(
        "*",
        label.alias("label"),
        F.when(event_id % 997 == 0, F.lit(float("nan"))).otherwise(score).alias("logit"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation log: one run per user, one validation event per step."""
    rows = impressions(spark, sf_dir).select("event_id", "timestamp", F.col("user_id").alias("run_id"))
    numbered = number_rows(rows, "run_id", "timestamp", ["event_id"], "step")
    event_id = F.col("event_id")

    def metric(base: float, factor: int, modulus: int) -> Column:
        return F.lit(base) + ((event_id * factor) % modulus).cast("double") / 1000.0

    return numbered.select(
        "run_id",
        "step",
        metric(0.70, 31, 100).alias("val_auc"),
        metric(0.20, 17, 50).alias("val_logloss"),
        metric(0.68, 13, 120).alias("aux_auc"),
    )
