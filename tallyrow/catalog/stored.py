"""Stored tables read by their layout: row groups and windows kept as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyrow.catalog.base import query, rows, with_base
from tallyrow.operators import blocks
from tallyrow.operators.intervals import window_join
from tallyrow.operators.ordered import null_safe_join
from tallyrow.operators.window_totals import window_totals
from tallyrow.plans.windows import local_epoch
from tallyrow.session import materialize, scratch_dir
from tallyrow.sources.row_groups import row_group_catalog, rows_of_row_groups
from tallyrow.sources.tables import scan_impressions

GROUP_ROWS = 100


def _store(spark, sf) -> str:
    """Impressions in one file a day, ordered by id, with row groups of GROUP_ROWS rows."""
    path = f"{scratch_dir(spark)}/days-{uuid.uuid4().hex}"
    day = F.floor(F.col("timestamp") / 86400).cast("int")
    table = rows(spark, sf).select("event_id", "timestamp", "label_type", day.alias("day"))
    table = table.repartition("day").sortWithinPartitions("day", "event_id")
    table.write.option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("day").parquet(path)
    return path


def _day():
    return F.regexp_extract("file", "day=(\\d+)", 1).cast("bigint")


_GROUPS = f""", g AS (
  SELECT event_id, "timestamp", "timestamp" // 86400 AS day, (row_number() OVER (PARTITION BY "timestamp" // 86400 ORDER BY event_id) - 1) // {GROUP_ROWS} AS row_group
  FROM impressions),
cat AS (SELECT day, row_group, count(*) AS n_rows, min("timestamp") AS min_ts, max("timestamp") AS max_ts FROM g GROUP BY 1, 2)"""


@query(
    "row_group_catalog",
    with_base(
        _GROUPS
        + f""" SELECT day, CAST(row_group AS INTEGER) AS row_group, row_group * {GROUP_ROWS} AS first_row, n_rows, min_ts, max_ts, CAST(0 AS BIGINT) AS n_nulls, true AS from_stats
FROM cat"""
    ),
)
def _(spark, sf):
    found = row_group_catalog(spark, _store(spark, sf))
    return found.select(_day().alias("day"), "row_group", "first_row", "n_rows", "min_ts", "max_ts", "n_nulls", "from_stats")


@query(
    "row_group_sample",
    with_base(
        _GROUPS
        + """, ranked AS (SELECT *, row_number() OVER (ORDER BY day, row_group) - 1 AS r FROM cat), n AS (SELECT count(*) AS n FROM cat),
picks AS (SELECT DISTINCT CASE WHEN i = 4 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 4.0::DOUBLE)) AS BIGINT) END AS r FROM n, range(5) t(i))
SELECT event_id, g.day FROM g JOIN ranked USING (day, row_group) JOIN picks USING (r)"""
    ),
)
def _(spark, sf):
    path = _store(spark, sf)
    chosen = blocks.sample_blocks(row_group_catalog(spark, path, key="event_id"), 5)
    found = rows_of_row_groups(scan_impressions(spark, path), chosen, time="timestamp", key="event_id")
    return found.select("event_id", F.col("day").cast("bigint").alias("day"))


@query(
    "row_group_split",
    with_base(
        _GROUPS
        + """, ranked AS (SELECT *, row_number() OVER (ORDER BY max_ts, min_ts, day, row_group) - 1 AS r FROM cat),
n1 AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT)) AS h FROM cat),
n2 AS (SELECT n - h AS rest, greatest(1, CAST(floor((n - h) * 0.2::DOUBLE) AS BIGINT)) AS v, greatest(1, CAST(floor((n - h) * 0.1::DOUBLE) AS BIGINT)) AS gap FROM n1),
roles AS (SELECT ranked.*, CASE WHEN r < rest - v - gap THEN 'train' WHEN r < rest - v THEN 'gap' WHEN r < rest THEN 'valid' ELSE 'holdout' END AS role FROM ranked, n2),
p AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY r) AS i, count(*) OVER (PARTITION BY role) AS c FROM roles)
SELECT event_id, role FROM g JOIN p USING (day, row_group)
WHERE (role = 'train' AND i > c - 5) OR (role = 'valid' AND i <= 3)"""
    ),
)
def _(spark, sf):
    path = _store(spark, sf)
    roles = blocks.split_blocks(row_group_catalog(spark, path, key="event_id"), valid_ratio=0.2, holdout_ratio=0.1, gap_ratio=0.1)
    chosen = blocks.limit_blocks(roles, 5, 3).where(F.col("role").isin("train", "valid"))
    found = rows_of_row_groups(scan_impressions(spark, path), chosen, ["role"], "timestamp", "event_id")
    return found.select("event_id", "role")


_TRAIN_MAX = local_epoch("2024-01-20")


@query(
    "window_table_join",
    with_base(
        f""", w AS (SELECT event_id AS "window", "timestamp" - 900 * (1 + event_id % 8) - CASE WHEN event_id % 250 = 1 THEN 86400 ELSE 0 END AS a,
  "timestamp" + 900 AS b FROM impressions WHERE event_type = 'purchase')
SELECT "window", a >= {_TRAIN_MAX} AS clean, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos, count(DISTINCT user_id) AS n_users, min(event_id) AS first_event
FROM impressions JOIN w ON "timestamp" >= a AND "timestamp" < b GROUP BY 1, 2"""
    ),
)
def _(spark, sf):
    """What happened around each purchase: as many overlapping windows as purchases."""
    table = rows(spark, sf)
    long = F.when(F.col("event_id") % 250 == 1, 86400).otherwise(0)
    windows = table.where("event_type = 'purchase'").select(
        F.col("event_id").alias("window"),
        (F.col("timestamp") - 900 * (1 + F.col("event_id") % 8) - long).alias("start"),
        (F.col("timestamp") + 900).alias("end"),
    )
    read = table.select("event_id", "timestamp", "user_id", "event_type")
    bought = F.col("event_type") == "purchase"
    clean = (F.col("start") >= _TRAIN_MAX).alias("clean")
    again = materialize(windows.groupBy("window").count().where("count > 1"))
    found = window_totals(read, null_safe_join(windows, again, ["window"], "left_anti"), bought, "user_id", "event_id")
    found = found.select("window", clean, "n_rows", "n_pos", "n_users", F.col("first").alias("first_event"))
    if again.isEmpty():
        return found
    # windows of one name count their rows and users together
    joined = window_join(read, null_safe_join(windows, again, ["window"], "left_semi"))
    together = joined.groupBy("window", clean).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bought).alias("n_pos"),
        F.countDistinct("user_id").alias("n_users"),
        F.min("event_id").alias("first_event"),
    )
    return found.unionByName(together)
