"""Registry, the feature plan of the derived impression table, and shared SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.plans.features import (
    ITEM_INT,
    USER_INT,
    DenseFeature,
    FeaturePlan,
    IntFeature,
    SequenceDomain,
)
from tallyrow.session import materialize
from tallyrow.sources.event_log import impressions, impressions_with_sequences

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return register


# Vocabularies are set below the largest ids, so that the out-of-range paths are used.
PLAN = FeaturePlan(
    user_int=(
        IntFeature(USER_INT, 1, 7),
        IntFeature(USER_INT, 2, 250),
        IntFeature(USER_INT, 3, 4, 2),
    ),
    item_int=(IntFeature(ITEM_INT, 11, 90), IntFeature(ITEM_INT, 12, 10)),
    user_dense=(DenseFeature(61, 3), DenseFeature(62, 1)),
    domains=(
        SequenceDomain("a", {39: 0, 40: 90}, 39, 8),
        SequenceDomain("b", {67: 0, 68: 90}, 67, 4),
        SequenceDomain("c", {27: 0, 28: 0}, 27, 8),
        SequenceDomain("d", {26: 0, 29: 100}, 26, 6),
    ),
)

SEQ_COLUMNS = [d.column(fid) for d in PLAN.domains for fid in sorted(d.vocabs)]
HISTORY_COLUMNS = {11: "item_int_feats_11", 12: "item_int_feats_12"}


def rows(spark: SparkSession, sf: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return impressions(spark, sf, start, end)


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    return impressions_with_sequences(spark, sf)


def stored_seqs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Written once per query, for reports that read the lists in several passes."""
    return materialize(seqs(spark, sf).select(*columns))


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def joined(column: Column) -> Column:
    """A list as text, so that it compares the same everywhere."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def long_vector(df: DataFrame, vector: Column) -> DataFrame:
    """(event_id, pos, v) of a dense vector."""
    return df.select("event_id", F.posexplode(vector).alias("pos", "v")).select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), r6("v").alias("v")
    )


BASE_SQL = """base AS (
  SELECT event_id, user_id, event_type, value,
         CAST(floor(epoch(ts)) AS BIGINT) AS t,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
impressions AS (
  SELECT event_id, t AS "timestamp", user_id, k AS item_id, event_type,
    CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN NULL ELSE 0 END AS label_type,
    CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN t + (event_id % 72) * 1800 END AS label_time,
    user_id % 7 AS user_int_feats_1,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 11 = 0 THEN -1 ELSE event_id % 300 END AS user_int_feats_2,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST([] AS BIGINT[])
         ELSE CAST([k % 4, k % 3, -1] AS BIGINT[]) END AS user_int_feats_3,
    k + 1 AS item_int_feats_11, k % 10 AS item_int_feats_12,
    [value / 100, -value / 100] AS user_dense_feats_61, [value * 1000] AS user_dense_feats_62,
    CAST(floor(event_id / 97) AS BIGINT) AS block_time, event_id % 40 AS block_mix,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y
  FROM base)"""

_SEQ_PARTS = ",\n".join(
    f"    coalesce(list_filter(list(CASE WHEN event_type = '{kind}' THEN {source} END) OVER w, "
    f"lambda v: v IS NOT NULL), CAST([] AS BIGINT[])) AS domain_{letter}_seq_{fid}"
    for letter, kind, ts_fid, item_fid in (
        ("a", "view", 39, 40),
        ("b", "click", 67, 68),
        ("c", "signup", 27, 28),
        ("d", "purchase", 26, 29),
    )
    for fid, source in ((ts_fid, '"timestamp"'), (item_fid, "item_id"))
)

SEQ_SQL = (
    BASE_SQL
    + ",\nseqs AS (\n  SELECT *,\n"
    + _SEQ_PARTS
    + """
  FROM impressions
  WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))"""
)

SCORED_SQL = (
    BASE_SQL
    + """,
scored AS (
  SELECT *, CAST(y AS BIGINT) AS label,
    CASE WHEN event_id % 997 = 0 THEN NULL
         ELSE CAST((event_id * 7919) % 1000 AS DOUBLE) / 250.0::DOUBLE - 2.0::DOUBLE + 0.5::DOUBLE * y END AS logit
  FROM impressions)"""
)

RUNS_SQL = (
    BASE_SQL
    + """,
runs AS (
  SELECT user_id AS run_id,
    row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS step,
    0.70::DOUBLE + CAST((event_id * 31) % 100 AS DOUBLE) / 1000.0::DOUBLE AS val_auc,
    0.20::DOUBLE + CAST((event_id * 17) % 50 AS DOUBLE) / 1000.0::DOUBLE AS val_logloss,
    0.68::DOUBLE + CAST((event_id * 13) % 120 AS DOUBLE) / 1000.0::DOUBLE AS aux_auc
  FROM base)"""
)

DOMAIN_TS = (("a", 39, 40, 8, 90), ("b", 67, 68, 4, 90), ("c", 27, 28, 8, 0), ("d", 26, 29, 6, 100))


def per_domain(template: str, between: str = " UNION ALL ") -> str:
    """``template`` once per domain; {d} letter, {ts}/{item} columns, {L} max_len, {v} vocab."""
    return between.join(
        template.format(d=d, ts=f"domain_{d}_seq_{ts}", item=f"domain_{d}_seq_{item}", fid=item, L=length, v=vocab)
        for d, ts, item, length, vocab in DOMAIN_TS
    )


def with_base(body: str) -> str:
    return f"WITH {BASE_SQL}\n{body}"


def with_seqs(body: str) -> str:
    return f"WITH {SEQ_SQL}\n{body}"


def with_scored(body: str) -> str:
    return f"WITH {SCORED_SQL}\n{body}"


def with_runs(body: str) -> str:
    return f"WITH {RUNS_SQL}\n{body}"
