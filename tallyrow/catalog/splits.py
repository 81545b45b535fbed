"""Splits, named windows and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrow.catalog.base import query, rows, with_base
from tallyrow.operators import blocks, splits, windows
from tallyrow.plans.windows import TimeWindow, local_epoch

def _ts():
    return F.col("timestamp")


@query(
    "split_row_cutoff",
    with_base(
        """, n AS (SELECT count(*) AS n FROM impressions),
cut AS (SELECT "timestamp" AS c FROM (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS r FROM impressions), n
  WHERE r = n - greatest(1, CAST(floor(n * 0.05::DOUBLE) AS BIGINT)))
SELECT event_id, "timestamp", CASE WHEN "timestamp" < c THEN 'train' ELSE 'valid' END AS role FROM impressions, cut"""
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    cutoff = splits.row_cutoff(table, 0.05)
    return table.select("event_id", "timestamp", splits.role_by_cutoff(_ts(), cutoff).alias("role"))


@query(
    "split_row_gap",
    with_base(
        """, n AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT)) AS v,
  greatest(1, CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT)) AS g FROM impressions),
r AS (SELECT "timestamp" AS t, row_number() OVER (ORDER BY "timestamp") - 1 AS r FROM impressions),
cut AS (SELECT max(CASE WHEN r = n - v THEN t END) AS vs, max(CASE WHEN r = n - v - g THEN t END) AS gs FROM r, n)
SELECT event_id, CASE WHEN "timestamp" < gs THEN 'train' WHEN "timestamp" < vs THEN 'gap' ELSE 'valid' END AS role
FROM impressions, cut"""
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    gap, valid = splits.row_gap_cutoffs(table, 0.05, 0.05)
    return table.select("event_id", splits.role_by_gap(_ts(), gap, valid).alias("role"))


_BLOCKS = """, cat AS (SELECT {b} AS block, count(*) AS n_rows, min("timestamp") AS min_ts, max("timestamp") AS max_ts FROM impressions GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY max_ts, min_ts, block) - 1 AS block_rank FROM cat),
n1 AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT)) AS h FROM cat),
n2 AS (SELECT n, h, n - h AS rest, greatest(1, CAST(floor((n - h) * 0.2::DOUBLE) AS BIGINT)) AS v,
  greatest(1, CAST(floor((n - h) * 0.1::DOUBLE) AS BIGINT)) AS g FROM n1),
roles AS (SELECT ranked.*, CASE WHEN block_rank < rest - v - g THEN 'train' WHEN block_rank < rest - v THEN 'gap'
  WHEN block_rank < rest THEN 'valid' ELSE 'holdout' END AS role FROM ranked, n2)"""


def _roles(spark, sf, block):
    table = rows(spark, sf)
    catalog = blocks.block_catalog(table, block)
    return table, blocks.split_blocks(catalog, valid_ratio=0.2, holdout_ratio=0.1, gap_ratio=0.1)


@query(
    "split_blocks",
    with_base(_BLOCKS.format(b="block_mix") + " SELECT event_id, role FROM impressions JOIN roles ON block_mix = block"),
)
def _(spark, sf):
    table, roles = _roles(spark, sf, "block_mix")
    return blocks.with_block_role(table, "block_mix", roles).select("event_id", "role")


@query(
    "limit_blocks",
    with_base(
        _BLOCKS.format(b="block_time")
        + """, p AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY block_rank) AS i, count(*) OVER (PARTITION BY role) AS c FROM roles)
SELECT block, block_rank, role, n_rows FROM p
WHERE (role <> 'train' OR i > c - 5) AND (role <> 'valid' OR i <= 3)"""
    ),
)
def _(spark, sf):
    _table, roles = _roles(spark, sf, "block_time")
    return blocks.limit_blocks(roles, 5, 3).select("block", "block_rank", "role", "n_rows")


@query(
    "block_time_split",
    with_base(
        """, cat AS (SELECT block_mix AS block, count(*) AS n_rows, min("timestamp") AS lo, max("timestamp") AS hi FROM impressions GROUP BY 1),
n AS (SELECT count(*) AS n FROM cat),
r AS (SELECT cat.*, row_number() OVER (ORDER BY hi, block) > n - greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS valid FROM cat, n),
s AS (SELECT CAST(sum(n_rows) FILTER (NOT valid) AS BIGINT) AS train_rows, min(lo) FILTER (NOT valid) AS train_min, max(hi) FILTER (NOT valid) AS train_max,
  CAST(sum(n_rows) FILTER (valid) AS BIGINT) AS valid_rows, min(lo) FILTER (valid) AS valid_min, max(hi) FILTER (valid) AS valid_max FROM r)
SELECT *, train_max - valid_min AS overlap_sec FROM s"""
    ),
)
def _(spark, sf):
    return windows.block_time_split(rows(spark, sf), "block_mix", 0.2)


_VALID = (local_epoch("2024-01-25"), local_epoch("2024-01-28"))
_TRAIN = (local_epoch("2024-01-05"), local_epoch("2024-01-24"))


@query(
    "split_fixed_window",
    with_base(
        f"""SELECT event_id, CASE WHEN "timestamp" >= {_VALID[0]} THEN 'valid' ELSE 'train' END AS role FROM impressions
WHERE ("timestamp" >= {_TRAIN[0]} AND "timestamp" < {_TRAIN[1]}) OR ("timestamp" >= {_VALID[0]} AND "timestamp" < {_VALID[1]})"""
    ),
)
def _(spark, sf):
    split = splits.FixedSplit(*_VALID, train_max=_TRAIN[1], train_min=_TRAIN[0])
    table = rows(spark, sf, split.train_min, split.valid_max).select("event_id", "timestamp")
    train = split.train(table).withColumn("role", F.lit("train"))
    valid = split.valid(table).withColumn("role", F.lit("valid"))
    return train.unionByName(valid).select("event_id", "role")


_WINDOWS = [
    TimeWindow("late morning", local_epoch("2024-01-20 09:00:00"), local_epoch("2024-01-20 14:00:00")),
    TimeWindow("day_20", local_epoch("2024-01-20"), local_epoch("2024-01-21")),
    TimeWindow("week", local_epoch("2024-01-18"), local_epoch("2024-01-25")),
]
_TRAIN_MAX = local_epoch("2024-01-20")


@query(
    "aux_windows",
    with_base(
        ", w AS (SELECT * FROM (VALUES "
        + ", ".join(f"('{w.name.replace(' ', '_')}', {w.start}, {w.end})" for w in _WINDOWS)
        + f""") v(name, a, b))
SELECT event_id, name AS "window", {_TRAIN_MAX} <= a AS clean FROM impressions JOIN w ON "timestamp" >= a AND "timestamp" < b"""
    ),
)
def _(spark, sf):
    earliest, latest = min(w.start for w in _WINDOWS), max(w.end for w in _WINDOWS)
    inside = splits.window_rows(rows(spark, sf, earliest, latest), _WINDOWS)
    clean = [w.name.replace(" ", "_") for w in _WINDOWS if splits.is_clean_window(w, _TRAIN_MAX)]
    return inside.select("event_id", "window", F.col("window").isin(clean).alias("clean"))


@query(
    "split_overlap_audit",
    with_base(
        _BLOCKS.format(b="block_time")
        + """, r AS (SELECT "timestamp" AS t, role FROM impressions JOIN roles ON block_time = block),
a AS (SELECT count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'gap') AS gap_rows,
  count(*) FILTER (role = 'valid') AS valid_rows, count(*) FILTER (role = 'holdout') AS holdout_rows,
  min(t) FILTER (role = 'train') AS train_min, max(t) FILTER (role = 'train') AS train_max,
  min(t) FILTER (role = 'valid') AS valid_min, max(t) FILTER (role = 'valid') AS valid_max,
  min(t) FILTER (role = 'holdout') AS holdout_min FROM r)
SELECT *, train_max - valid_min AS overlap_sec, valid_min - train_max AS train_to_valid_sec,
  valid_max - holdout_min AS valid_holdout_overlap_sec FROM a"""
    ),
)
def _(spark, sf):
    table, roles = _roles(spark, sf, "block_time")
    return splits.overlap_audit(blocks.with_block_role(table, "block_time", roles))
