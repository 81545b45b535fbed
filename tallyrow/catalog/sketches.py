"""Reports from mergeable summaries, held against exact counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyrow.catalog.base import PLAN, per_domain, query, rounded, rows, seqs, stored_seqs, with_base, with_seqs
from tallyrow.operators import sketches
from tallyrow.plans.windows import local_epoch
from tallyrow.session import materialize, scratch_dir

_DOMAINS = PLAN.domains
#: Ranges of UTC days: all, the first ten, the last week, a single day.
_RANGES = (("all", 19723, 19753), ("first ten", 19723, 19732), ("last week", 19746, 19753), ("one", 19740, 19740))
_ADDED_FROM = 19745


def _stored_by_day(make, table):
    """The summaries of ``table``, stored in two steps: the days before _ADDED_FROM, then the others."""
    path = f"{scratch_dir(table.sparkSession)}/days-{uuid.uuid4().hex}"
    border = _ADDED_FROM * 86400
    for part in (table.where(F.col("timestamp") < border), table.where(F.col("timestamp") >= border)):
        like = make(part)
        sketches.store_days(like, path)
    return like, path


_RANGE_SQL = "(VALUES " + ", ".join(f"('{name}', {a}, {b})" for name, a, b in _RANGES) + ") v(days, a, b)"


@query(
    "distinct_id_ranges",
    with_base(
        f""", long AS (SELECT "timestamp" // 86400 AS day, 'user_id' AS id_column, user_id AS id FROM impressions
  UNION ALL SELECT "timestamp" // 86400, 'item_id', item_id FROM impressions)
SELECT days, id_column, count(DISTINCT id) AS n_distinct, true AS within FROM long JOIN {_RANGE_SQL} ON day BETWEEN a AND b GROUP BY 1, 2"""
    ),
)
def _(spark, sf):
    """Distinct ids of ranges of days from the stored sketches; ``within`` holds the estimate against the exact count."""
    table = rows(spark, sf).select("timestamp", "user_id", "item_id")
    like, path = _stored_by_day(sketches.daily_ids, table)
    parts = []
    for name, first, last in _RANGES:
        estimate = sketches.distinct_ids(sketches.stored_days(like, path, first, last))
        inside = table.where(F.col("timestamp").between(first * 86400, last * 86400 + 86399))
        counts = inside.agg(*[F.count_distinct(c).alias(c) for c in ("user_id", "item_id")])
        exact = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("id_column"), F.col(c).alias("n_distinct")) for c in counts.columns])).alias("x")).select("x.*")
        near = F.abs(F.col("n_estimate") - F.col("n_distinct")) <= sketches.distinct_error() * F.col("n_distinct") + 1
        parts.append(exact.join(estimate, "id_column").select(F.lit(name).alias("days"), "id_column", "n_distinct", near.alias("within")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


_SHARES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@query(
    "merged_time_diff_quantiles",
    with_seqs(
        ", d AS ("
        + per_domain("SELECT 'seq_{d}' AS domain, \"timestamp\" AS t, unnest({ts}) AS s FROM seqs")
        + f"""), n AS (SELECT domain, count(*) AS n FROM d WHERE s > 0 AND t >= s GROUP BY 1)
SELECT domain, n, share, true AS within FROM n, (VALUES {", ".join(f"({s}::DOUBLE)" for s in _SHARES)}) v(share)"""
    ),
)
def _(spark, sf):
    """Quantiles of time differences from the stored sketches; ``within`` holds their exact ranks against the error bound."""
    table = stored_seqs(spark, sf, "timestamp", *[d.ts_column for d in _DOMAINS])
    like, path = _stored_by_day(lambda part: sketches.daily_time_diffs(part, _DOMAINS), table)
    found = sketches.merged_quantiles(sketches.stored_days(like, path), ["domain"], _SHARES)
    asked = materialize(found.select("domain", "n", F.arrays_zip(F.array(*map(F.lit, _SHARES)).alias("share"), F.col("quantiles").alias("value")).alias("asked")))
    diffs = sketches.seq_time_diffs(table, _DOMAINS).join(asked, "domain").select("domain", "n", "diff", F.explode("asked").alias("q"))
    ranks = diffs.groupBy("domain", "n", F.col("q.share").alias("share")).agg(
        F.avg((F.col("diff") < F.col("q.value")).cast("double")).alias("below"), F.avg((F.col("diff") <= F.col("q.value")).cast("double")).alias("upto")
    )
    error = F.lit(sketches.KLL_ERROR) + 1 / F.col("n")
    return ranks.select("domain", "n", "share", ((F.col("below") <= F.col("share") + error) & (F.col("upto") >= F.col("share") - error)).alias("within"))


_ITEM_ROWS = "SELECT 'seq_{d}' AS domain, CAST({fid} AS BIGINT) AS fid, \"timestamp\" AS t, unnest({item}) AS item FROM seqs"


@query(
    "seq_heavy_hitters",
    with_seqs(
        ", items AS ("
        + per_domain(_ITEM_ROWS)
        + """), f AS (SELECT domain, fid, item, count(*) AS freq FROM items WHERE item > 0 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, fid ORDER BY freq DESC, item) AS item_rank FROM f)
SELECT * FROM r WHERE item_rank <= 5"""
    ),
)
def _(spark, sf):
    items = materialize(sketches.seq_items(seqs(spark, sf), _DOMAINS))
    return sketches.heavy_hitters(items, ["domain", "fid"], "item", 5, room=64)


_CUT = local_epoch("2024-01-02")


@query(
    "seq_bucket_overlap",
    with_seqs(
        ", raw AS ("
        + per_domain(_ITEM_ROWS)
        + f"""), kinds AS (SELECT k AS buckets, domain, fid, t, greatest(item % k, 1) AS item FROM raw, (VALUES (32), (100000)) v(k) WHERE item > 0),
sides AS (SELECT buckets, domain, fid, item, max((t < {_CUT})::INT) AS a, max((t >= {_CUT})::INT) AS b FROM kinds GROUP BY 1, 2, 3, 4)
SELECT CAST(buckets AS BIGINT) AS buckets, domain, fid, CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_test, CAST(sum(a * b) AS BIGINT) AS n_both,
  round(CASE WHEN sum(b) > 0 THEN sum(a * b) / CAST(sum(b) AS DOUBLE) ELSE 0 END, 6) AS test_share_seen
FROM sides GROUP BY 1, 2, 3"""
    ),
)
def _(spark, sf):
    table = stored_seqs(spark, sf, "timestamp", *[d.column(f) for d in _DOMAINS for f in d.side_fids])
    train, test = table.where(F.col("timestamp") < _CUT), table.where(F.col("timestamp") >= _CUT)
    parts = [sketches.bucket_overlap(train, test, _DOMAINS, k).select(F.lit(k).cast("bigint").alias("buckets"), "*") for k in (32, 100_000)]
    return rounded(parts[0].unionByName(parts[1]), "test_share_seen")
