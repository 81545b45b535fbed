"""Historical conversion rates, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyrow.catalog.base import HISTORY_COLUMNS, query, r6, rows, with_base
from tallyrow.operators import history
from tallyrow.operators.history_store import HistoryStore
from tallyrow.plans.fixed import HOUR
from tallyrow.session import materialize, scratch_dir
from tallyrow.streaming.history import history_stream
from tallyrow.streaming.lookup import LookupStream

def _ts():
    return F.col("timestamp")

_WHEN = """CASE WHEN coalesce(label_type, 0) = 2
  THEN greatest(CASE WHEN label_time > 0 THEN label_time ELSE "timestamp" END, "timestamp") ELSE "timestamp" + 86400 END"""


def _bins(when: str) -> str:
    return f""", bins AS (
  SELECT CAST(fid AS BIGINT) AS fid, CAST(value AS BIGINT) AS value, ({when}) // 3600 AS bin, count(*) AS cnt, CAST(sum(y) AS BIGINT) AS pos
  FROM impressions, LATERAL (VALUES (0, 0), (11, item_int_feats_11), (12, item_int_feats_12)) x(fid, value)
  WHERE fid = 0 OR value > 0 GROUP BY ALL)"""


_CUMULATIVE = """, store AS (SELECT fid, value, bin, (bin + 1) * 3600 - 1 AS bin_end_ts,
  CAST(sum(cnt) OVER w AS BIGINT) AS cum_cnt, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos
  FROM bins WINDOW w AS (PARTITION BY fid, value ORDER BY bin ROWS UNBOUNDED PRECEDING))"""


@query(
    "history_bins",
    with_base(
        _bins('"timestamp"')
        + _bins(_WHEN).replace("bins AS", "late AS")
        + " SELECT 'timestamp' AS mode, * FROM bins UNION ALL SELECT 'available', * FROM late"
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    late = history.available_time(_ts(), F.col("label_type"), F.col("label_time"))
    parts = [
        history.history_bins(table, HISTORY_COLUMNS, when).select(F.lit(mode).alias("mode"), "*")
        for mode, when in (("timestamp", history.event_time(_ts())), ("available", late))
    ]
    return parts[0].unionByName(parts[1])


@query("history_cumulative", with_base(_bins('"timestamp"') + _CUMULATIVE + " SELECT * FROM store"))
def _(spark, sf):
    bins = history.history_bins(rows(spark, sf), HISTORY_COLUMNS, history.event_time(_ts()))
    return history.history_cumulative(bins)


@query("history_build", with_base(_bins(_WHEN) + _CUMULATIVE + " SELECT * FROM store"))
def _(spark, sf):
    return history.history_build(rows(spark, sf), HISTORY_COLUMNS, "available")


_LOOKED = """, prior AS (SELECT max(cum_pos) / CAST(max(cum_cnt) AS DOUBLE) AS p FROM store WHERE fid = 0),
probe AS (SELECT event_id, "timestamp" - 86400 AS at, CAST(0 AS BIGINT) AS zero, item_int_feats_11 AS v11, item_int_feats_12 AS v12 FROM impressions),
looked AS (SELECT event_id, coalesce(s0.cum_cnt, 0) AS c0, coalesce(s0.cum_pos, 0) AS p0,
    coalesce(s11.cum_cnt, 0) AS c11, coalesce(s11.cum_pos, 0) AS p11, coalesce(s12.cum_cnt, 0) AS c12, coalesce(s12.cum_pos, 0) AS p12
  FROM probe
  ASOF LEFT JOIN (SELECT * FROM store WHERE fid = 0) s0 ON s0.value = probe.zero AND s0.bin_end_ts <= probe.at
  ASOF LEFT JOIN (SELECT * FROM store WHERE fid = 11) s11 ON s11.value = probe.v11 AND s11.bin_end_ts <= probe.at
  ASOF LEFT JOIN (SELECT * FROM store WHERE fid = 12) s12 ON s12.value = probe.v12 AND s12.bin_end_ts <= probe.at),
g AS (SELECT *, CASE WHEN c0 > 0 THEN p0 / CAST(c0 AS DOUBLE) ELSE p END AS g FROM looked, prior)
SELECT event_id, round(g, 6) AS hist_rate, round(ln(1 + c0), 6) AS hist_log_count,
  round(CASE WHEN c11 > 0 THEN (p11 + 20 * g) / (c11 + 20) ELSE g END, 6) AS hist_rate_11, round(ln(1 + c11), 6) AS hist_log_count_11,
  round(CASE WHEN c12 > 0 THEN (p12 + 20 * g) / (c12 + 20) ELSE g END, 6) AS hist_rate_12, round(ln(1 + c12), 6) AS hist_log_count_12
FROM g"""


def _lookup_sql(when: str) -> str:
    return with_base(_bins(when) + _CUMULATIVE + _LOOKED)


def _looked(spark, sf, mode):
    """The store is a written table, as a user of the look-up has it; the events are read once for it and once for the rows."""
    table = rows(spark, sf)
    store = materialize(history.history_build(table, HISTORY_COLUMNS, mode))
    looked = history.history_lookup(table, store, HISTORY_COLUMNS)
    return looked.select("event_id", *[r6(c).alias(c) for c in history.history_columns([11, 12])])


@query("history_lookup", _lookup_sql('"timestamp"'))
def _(spark, sf):
    return _looked(spark, sf, "timestamp_cutoff")


@query("history_lookup_available", _lookup_sql(_WHEN))
def _(spark, sf):
    return _looked(spark, sf, "available")


_LATENESS = 3 * 86400
_PIECE_FILES = 12


@query(
    "history_stream",
    with_base(
        _bins(_WHEN)
        + f""", mark AS (SELECT max({_WHEN}) - {_LATENESS} AS mark FROM impressions)
SELECT fid, value, bin, cnt, pos FROM bins, mark WHERE (bin + 1) * 3600 <= mark"""
    ),
)
def _(spark, sf):
    table = rows(spark, sf).select("timestamp", "label_type", "label_time", *HISTORY_COLUMNS.values())
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/in")
    return history_stream(
        spark,
        f"{folder}/in",
        table.schema,
        f"{folder}/out",
        f"{folder}/state",
        HISTORY_COLUMNS,
        HOUR,
        lateness_sec=_LATENESS,
    )


def _stored_by_days(spark, sf) -> HistoryStore:
    """The events up to some days stored first, then the later ones appended, five days at a time."""
    suffix = uuid.uuid4().hex
    store = HistoryStore(f"history_{suffix}", f"{scratch_dir(spark)}/history-{suffix}", 8)
    table = rows(spark, sf)
    first, last = (t // 86400 for t in table.agg(F.min("timestamp"), F.max("timestamp")).first())
    border = first + (last - first) // 2
    for start in [None, *range(border, last + 1, 5)]:
        stop = border if start is None else start + 5
        part = table.where(_ts() < stop * 86400)
        if start is not None:
            part = part.where(_ts() >= start * 86400)
        bins = history.history_bins(part, HISTORY_COLUMNS, history.event_time(_ts()))
        store.create(bins) if start is None else store.append(bins)
    return store


@query("history_append", with_base(_bins('"timestamp"') + _CUMULATIVE + " SELECT * FROM store"))
def _(spark, sf):
    return _stored_by_days(spark, sf).open(spark)


@query("history_lookup_stored", _lookup_sql('"timestamp"'))
def _(spark, sf):
    store = _stored_by_days(spark, sf)
    looked = history.history_lookup(rows(spark, sf), store.open(spark), HISTORY_COLUMNS, buckets=store.buckets)
    return looked.select("event_id", *[r6(c).alias(c) for c in history.history_columns([11, 12])])


@query("history_lookup_stream", _lookup_sql(_WHEN))
def _(spark, sf):
    """The events in shuffled pieces, one of which comes twice; the last answers are those of the batch look-up."""
    kept = ["event_id", "timestamp", "label_type", "label_time", *HISTORY_COLUMNS.values()]
    table = materialize(rows(spark, sf).select(*kept))
    folder = f"{scratch_dir(spark)}/lookups-{uuid.uuid4().hex}"
    pieces = [table.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)]
    for piece in [*pieces, pieces[0]]:
        piece.repartition(_PIECE_FILES, "event_id").write.mode("append").parquet(f"{folder}/in")
    prior = history.global_prior(history.history_build(table, HISTORY_COLUMNS, "available"))
    late = lambda: history.available_time(_ts(), F.col("label_type"), F.col("label_time"))
    stream = LookupStream(spark, f"{folder}/in", table.schema, f"{folder}/state", HISTORY_COLUMNS, late, prior, compact_every=2)
    return stream.run(files_per_batch=_PIECE_FILES).select("event_id", *[r6(c).alias(c) for c in history.history_columns([11, 12])])
