"""Scans, blocks, sinks and schema inference."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyrow.catalog.base import (
    PLAN,
    SEQ_COLUMNS,
    query,
    r6,
    rows,
    stored_seqs,
    with_base,
    with_seqs,
)
from tallyrow.functions.losses import sigmoid
from tallyrow.operators import blocks, schema
from tallyrow.operators.profile import missing_gap
from tallyrow.operators.scoring import last_predictions, write_predictions
from tallyrow.plans.features import column_roles
from tallyrow.session import scratch_dir
from tallyrow.sources.event_log import scored
from tallyrow.sources.tables import scan_columns, scan_impressions, write_profile


@query(
    "scan_impressions",
    with_base(
        """SELECT event_id, "timestamp", user_id, item_id, CAST(label_type AS INTEGER) AS label_type, label_time,
  user_int_feats_1, user_int_feats_2, array_to_string(user_int_feats_3, ',') AS user_int_feats_3,
  item_int_feats_11, item_int_feats_12, block_time, block_mix FROM impressions"""
    ),
)
def _(spark, sf):
    text = F.array_join(F.transform("user_int_feats_3", lambda x: x.cast("string")), ",")
    return rows(spark, sf).select(
        "event_id",
        "timestamp",
        "user_id",
        "item_id",
        "label_type",
        "label_time",
        "user_int_feats_1",
        "user_int_feats_2",
        text.alias("user_int_feats_3"),
        "item_int_feats_11",
        "item_int_feats_12",
        "block_time",
        "block_mix",
    )


@query(
    "scan_columns",
    """SELECT l_orderkey, l_quantity, 'l_not_there' AS absent FROM lineitem""",
)
def _(spark, sf):
    table = scan_impressions(spark, f"{sf}/lineitem.parquet")
    found, absent = scan_columns(table, ["l_orderkey", "l_quantity", "l_not_there"])
    return found.withColumn("absent", F.lit(",".join(absent)))


_CATALOG = """cat AS (SELECT {b} AS block, count(*) AS n_rows, min("timestamp") AS min_ts, max("timestamp") AS max_ts
  FROM impressions GROUP BY 1)"""


@query(
    "block_catalog",
    with_base("," + _CATALOG.format(b="block_time") + " SELECT * FROM cat"),
)
def _(spark, sf):
    return blocks.block_catalog(rows(spark, sf), "block_time")


@query(
    "block_sample",
    with_base(
        ","
        + _CATALOG.format(b="block_mix")
        + """, ranked AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS block_rank FROM cat),
  n AS (SELECT count(*) AS n FROM cat),
  picks AS (SELECT CASE WHEN i = 7 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 7.0::DOUBLE)) AS BIGINT) END AS r
            FROM n, range(8) t(i))
SELECT event_id, block_mix FROM impressions
WHERE block_mix IN (SELECT block FROM ranked WHERE block_rank IN (SELECT r FROM picks))"""
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    chosen = blocks.sample_blocks(blocks.block_catalog(table, "block_mix"), 8)
    return blocks.rows_of_blocks(table, "block_mix", chosen).select("event_id", "block_mix")


@query("shuffle_rows", with_base('SELECT event_id, user_id, "timestamp" FROM impressions'))
def _(spark, sf):
    return blocks.shuffled(rows(spark, sf).select("event_id", "user_id", "timestamp"), ["event_id"], seed=7)


def _missing_sql(tail: str) -> str:
    cells = ", ".join(
        f"('{s}', {fid}, {'user' if s == 'user_int' else 'item'}_int_feats_{fid})"
        for s, fid in (("user_int", 1), ("user_int", 2), ("item_int", 11), ("item_int", 12))
    )
    return with_base(
        f""", long AS (
  SELECT section, fid, coalesce(v, 0) <= 0 AS is_null, y FROM impressions, LATERAL (VALUES {cells}) x(section, fid, v)
  UNION ALL SELECT 'user_int', 3, coalesce(len(list_filter(user_int_feats_3, lambda v: v > 0)), 0) = 0, y FROM impressions),
agg AS (SELECT section, CAST(fid AS BIGINT) AS fid, count(*) AS n_total,
  CAST(sum(CASE WHEN is_null THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
  sum(CASE WHEN is_null THEN y ELSE 0 END)::DOUBLE AS pn, sum(CASE WHEN is_null THEN 0 ELSE y END)::DOUBLE AS ps
  FROM long GROUP BY 1, 2),
rates AS (SELECT *, CASE WHEN n_null > 0 THEN pn / n_null ELSE 0 END AS a,
  CASE WHEN n_total > n_null THEN ps / (n_total - n_null) ELSE 0 END AS b FROM agg)
{tail}"""
    )


MISSING_SQL = _missing_sql(
    """SELECT section, fid, n_total, n_null, round(n_null / n_total::DOUBLE, 6) AS null_rate,
  round(a, 6) AS cvr_null, round(b, 6) AS cvr_notnull, round(a - b, 6) AS cvr_gap FROM rates"""
)


def missing_report(spark, sf):
    report = missing_gap(rows(spark, sf), PLAN.int_features())
    return report.select(
        "section",
        "fid",
        "n_total",
        "n_null",
        *[r6(c).alias(c) for c in ("null_rate", "cvr_null", "cvr_notnull", "cvr_gap")],
    )


@query("sink_profile", MISSING_SQL)
def _(spark, sf):
    path = f"{scratch_dir(spark)}/profile-{uuid.uuid4().hex}"
    report = missing_report(spark, sf)
    write_profile(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "sink_predictions",
    with_base(
        """, p AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, "timestamp",
  CASE WHEN event_id % 997 = 0 THEN 0.0::DOUBLE
       ELSE 1 / (1 + exp(-(((event_id * 7919) % 1000) / 250.0::DOUBLE - 2 + 0.5::DOUBLE * y))) END AS prob FROM impressions)
SELECT user_id, round(arg_max(prob, ("timestamp", event_id)), 6) AS prob FROM p GROUP BY 1"""
    ),
)
def _(spark, sf):
    table = scored(spark, sf).withColumn("p", sigmoid(F.col("logit")))
    path = f"{scratch_dir(spark)}/predictions-{uuid.uuid4().hex}"
    predictions = last_predictions(table, "p")
    write_predictions(predictions, path)
    return spark.read.schema(predictions.schema).json(path).select("user_id", r6("prob").alias("prob"))


# --- schema inference ---------------------------------------------------------------------

_ID_LONG = "SELECT '{s}' AS section, {f} AS fid, {c} AS v FROM seqs"
_SCALARS = (
    ("user_int", 1, "user_int_feats_1"),
    ("user_int", 2, "user_int_feats_2"),
    ("item_int", 11, "item_int_feats_11"),
    ("item_int", 12, "item_int_feats_12"),
)
_LISTS = (("user_int", 3, "user_int_feats_3"),) + tuple(
    (f"seq_{c.split('_')[1]}", int(c.rsplit("_", 1)[1]), c) for c in SEQ_COLUMNS
)
_IDS_SQL = ", ids AS (" + " UNION ALL ".join(
    [_ID_LONG.format(s=s, f=f, c=c) for s, f, c in _SCALARS]
    + [_ID_LONG.format(s=s, f=f, c=f"unnest({c})") for s, f, c in _LISTS]
) + ")"
_ALL_KEYS = ", ".join(f"('{s}', {f})" for s, f, _c in _SCALARS + _LISTS)
_VOCAB_SQL = (
    _IDS_SQL
    + f""", vocabs AS (SELECT section, fid, coalesce(max(CASE WHEN v > 0 THEN v END) + 1, 1) AS vocab,
    CAST(floor(coalesce(quantile_cont(CASE WHEN v > 0 THEN v END, 0.9), 0)) AS BIGINT) + 1 AS vocab_p90,
    coalesce(median(CASE WHEN v > 0 THEN v END) > 1000000000, false) AS late
  FROM (SELECT * FROM ids UNION ALL SELECT s, f, NULL FROM (VALUES {_ALL_KEYS}) k(s, f)) GROUP BY 1, 2)"""
)

_DIM_LISTS = (("user_int", 3, "user_int_feats_3"), ("user_dense", 61, "user_dense_feats_61"),
              ("user_dense", 62, "user_dense_feats_62"))
_DIMS_SQL = ", dims AS (" + " UNION ALL ".join(
    [f"SELECT '{s}' AS section, {f} AS fid, greatest(max(coalesce(len({c}), 0)), 1) AS dim FROM seqs"
     for s, f, c in _DIM_LISTS]
    + [f"SELECT '{s}', {f}, 1" for s, f, _c in _SCALARS]
) + ")"

_FEATURES = ["user_int_feats_1", "user_int_feats_2", "user_int_feats_3", "item_int_feats_11",
             "item_int_feats_12", "user_dense_feats_61", "user_dense_feats_62", *SEQ_COLUMNS]


@query(
    "infer_vocab_size",
    with_seqs(
        _VOCAB_SQL
        + " SELECT section, CAST(fid AS BIGINT) AS fid, CAST(vocab AS BIGINT) AS vocab, vocab_p90 FROM vocabs"
    ),
)
def _(spark, sf):
    table = stored_seqs(spark, sf, *_FEATURES)
    whole = schema.infer_catalog(table).where("vocab IS NOT NULL").select("section", "fid", "vocab")
    cut = schema.infer_catalog(table, vocab_share=0.9).select("section", "fid", F.col("vocab").alias("vocab_p90"))
    return whole.join(cut, ["section", "fid"])


@query(
    "infer_list_dim",
    with_seqs(
        ", len3 AS (SELECT greatest(CAST(floor(quantile_cont(coalesce(len(user_int_feats_3), 0), 0.1)) AS BIGINT), 1)"
        " AS d FROM seqs)"
        + _DIMS_SQL
        + """ SELECT section, CAST(fid AS BIGINT) AS fid, CAST(dim AS BIGINT) AS dim,
  CAST(CASE WHEN section = 'user_int' AND fid = 3 THEN (SELECT d FROM len3) ELSE dim END AS BIGINT) AS dim_p10 FROM dims"""
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    whole = schema.infer_catalog(table).select("section", "fid", "dim")
    cut = schema.infer_catalog(table, dim_share=0.1).select("section", "fid", F.col("dim").alias("dim_p10"))
    return whole.join(cut, ["section", "fid"])


@query(
    "detect_ts_column",
    with_seqs(
        _VOCAB_SQL
        + """ SELECT section, CAST(min(fid) AS BIGINT) AS ts_fid FROM vocabs
  WHERE section LIKE 'seq_%' AND late GROUP BY 1"""
    ),
)
def _(spark, sf):
    catalog = schema.infer_catalog(stored_seqs(spark, sf, *SEQ_COLUMNS))
    return catalog.where("is_ts").select("section", F.col("fid").alias("ts_fid"))


@query(
    "infer_schema",
    with_seqs(
        _VOCAB_SQL
        + _DIMS_SQL
        + """, firsts AS (SELECT section, min(fid) AS fid FROM vocabs WHERE section LIKE 'seq_%' AND late GROUP BY 1),
merged AS (
  SELECT coalesce(v.section, d.section) AS section, coalesce(v.fid, d.fid) AS fid, v.vocab, d.dim
  FROM vocabs v FULL JOIN dims d ON v.section = d.section AND v.fid = d.fid),
flagged AS (SELECT m.*, f.fid IS NOT NULL AS is_ts, m.section LIKE 'seq_%' AS is_seq,
    m.section IN ('user_int', 'item_int') AS is_int
  FROM merged m LEFT JOIN firsts f ON m.section = f.section AND m.fid = f.fid)
SELECT section, CAST(fid AS BIGINT) AS fid, CAST(vocab AS BIGINT) AS vocab, CAST(dim AS BIGINT) AS dim, is_ts,
  coalesce(is_seq AND NOT is_ts AND vocab > 1000000, false) AS is_high_vocab_seq,
  coalesce(is_int AND vocab <= 256, false) AS is_low_vocab_int,
  CASE WHEN NOT is_int THEN NULL WHEN vocab <= 100 THEN 'T_small' WHEN vocab <= 2000 THEN 'T_mid' ELSE 'T_large' END AS tier
FROM flagged"""
    ),
)
def _(spark, sf):
    table = stored_seqs(spark, sf, *_FEATURES)
    assert len(column_roles(table.schema)) == len(_FEATURES)
    return schema.infer_catalog(table)
