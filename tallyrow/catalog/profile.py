"""Distribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrow.catalog.base import PLAN, per_domain, query, rounded, rows, seqs, stored_seqs, with_base, with_seqs
from tallyrow.catalog.features import CLEAN_SQL
from tallyrow.catalog.scans import MISSING_SQL, missing_report
from tallyrow.operators import profile, windows
from tallyrow.operators.assemble import clean_ids
from tallyrow.plans.fixed import LENGTH_PERCENTILES, VALUE_PERCENTILES
from tallyrow.plans.windows import audit_windows, local_epoch

_DOMAINS = PLAN.domains
_TS_COLUMNS = [d.ts_column for d in _DOMAINS]
_L_NAMES = [profile.percentile_name(p) for p in LENGTH_PERCENTILES]
_V_NAMES = [profile.percentile_name(p) for p in VALUE_PERCENTILES]


def _quantiles_sql(value: str, percentiles) -> str:
    return ", ".join(
        f"round(quantile_cont({value}, {p / 100}), 6) AS {profile.percentile_name(p)}" for p in percentiles
    )


def _spread_sql(value: str, percentiles) -> str:
    return (
        f"count(*) AS n, round(avg({value}), 6) AS mean, min({value}) AS min, max({value}) AS max, "
        + _quantiles_sql(value, percentiles)
    )


@query(
    "global_cvr",
    with_base(
        "SELECT count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(y), 6) AS cvr FROM impressions"
    ),
)
def _(spark, sf):
    return rounded(profile.global_cvr(rows(spark, sf)), "cvr")


@query(
    "id_frequency",
    with_base(
        """, f AS (SELECT 'user_id' AS id_column, user_id AS id, count(*) AS freq FROM impressions GROUP BY 1, 2
  UNION ALL SELECT 'item_id', item_id, count(*) FROM impressions GROUP BY 1, 2)
SELECT id_column, count(*) AS n_distinct, round(avg((freq = 1)::INT), 6) AS share_once,
  round(avg((freq BETWEEN 2 AND 10)::INT), 6) AS share_2_10, round(avg((freq > 10)::INT), 6) AS share_over_10,
  max(freq) AS max_freq, round(avg(freq), 6) AS mean_freq, CAST(sum(freq) AS BIGINT) AS n_total FROM f GROUP BY 1"""
    ),
)
def _(spark, sf):
    return rounded(
        profile.id_frequency(rows(spark, sf)), "share_once", "share_2_10", "share_over_10", "mean_freq"
    )


@query(
    "freq_histogram",
    with_base(
        """SELECT freq, count(*) AS n_ids FROM (SELECT user_id, count(*) AS freq FROM impressions GROUP BY 1)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
    ),
)
def _(spark, sf):
    return profile.freq_histogram(rows(spark, sf))


@query("distinct_users", with_base("SELECT count(DISTINCT user_id) AS n_users FROM impressions"))
def _(spark, sf):
    return profile.distinct_users(rows(spark, sf))


@query("missing_gap", MISSING_SQL)
def _(spark, sf):
    return missing_report(spark, sf)


@query("missing_rates", f"SELECT section, fid, n_total, n_null, null_rate FROM ({MISSING_SQL}) x")
def _(spark, sf):
    unlabelled = rows(spark, sf).drop("label_type", "label_time")
    return rounded(profile.missing_rates(unlabelled, PLAN.int_features()), "null_rate")


_LEN_LONG = """SELECT 'seq_{d}' AS domain, '{kind}' AS kind, CAST({expr} AS BIGINT) AS length FROM seqs"""
_LENGTH_KINDS = {
    "true": "len(list_filter({ts}, lambda v: v > 0))",
    "true_head": "len(list_filter({ts}[1:{L}], lambda v: v > 0))",
    "model": "least(len({item}), {L})",
    "clipped": "least(len({ts}), {L})",
}


@query(
    "seq_len_quantiles",
    with_seqs(
        ", lens AS ("
        + " UNION ALL ".join(
            per_domain(_LEN_LONG.replace("{kind}", kind).replace("{expr}", expr))
            for kind, expr in _LENGTH_KINDS.items()
        )
        + f") SELECT kind, domain, {_spread_sql('length', LENGTH_PERCENTILES)} FROM lens GROUP BY 1, 2"
    ),
)
def _(spark, sf):
    table = stored_seqs(spark, sf, *[d.column(f) for d in _DOMAINS for f in sorted(d.vocabs)])
    parts = [
        profile.seq_len_quantiles(table, _DOMAINS, kind).select(F.lit(kind).alias("kind"), "*")
        for kind in _LENGTH_KINDS
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return rounded(whole, "mean", *_L_NAMES)


_DIFF_LONG = """SELECT 'seq_{d}' AS domain, "timestamp" - s AS diff
  FROM (SELECT "timestamp", unnest({ts}) AS s FROM seqs) WHERE s > 0 AND "timestamp" - s >= 0"""


@query(
    "time_diff_quantiles",
    with_seqs(
        ", diffs AS ("
        + per_domain(_DIFF_LONG)
        + f") SELECT domain, {_spread_sql('diff', LENGTH_PERCENTILES)} FROM diffs GROUP BY 1"
    ),
)
def _(spark, sf):
    table = seqs(spark, sf)
    return rounded(profile.time_diff_quantiles(table, _DOMAINS), "mean", *_L_NAMES)


_ITEMS = "SELECT 'seq_{d}' AS domain, CAST({fid} AS BIGINT) AS fid, unnest({item}) AS item FROM seqs"


@query(
    "seq_topk_items",
    with_seqs(
        ", items AS ("
        + per_domain(_ITEMS)
        + """), f AS (SELECT domain, fid, item, count(*) AS freq FROM items WHERE item > 0 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, fid ORDER BY freq DESC, item) AS item_rank,
  count(*) OVER (PARTITION BY domain, fid) AS n_distinct FROM f)
SELECT * FROM r WHERE item_rank <= 50"""
    ),
)
def _(spark, sf):
    return profile.seq_topk_items(seqs(spark, sf), _DOMAINS, 50)


_CUT = local_epoch("2024-01-02")


@query(
    "seq_item_overlap",
    with_seqs(
        ", raw AS ("
        + per_domain(
            'SELECT \'seq_{d}\' AS domain, CAST({fid} AS BIGINT) AS fid, "timestamp" AS t, unnest({item}) AS item FROM seqs'
        )
        + f"""), kinds AS (SELECT 'item' AS kind, domain, fid, t, item FROM raw WHERE item > 0
  UNION ALL SELECT 'bucket', domain, fid, t, greatest(item % 32, 1) FROM raw WHERE item > 0),
sides AS (SELECT kind, domain, fid, item, max((t < {_CUT})::INT) AS a, max((t >= {_CUT})::INT) AS b FROM kinds GROUP BY 1, 2, 3, 4)
SELECT kind, domain, fid, CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_test, CAST(sum(a * b) AS BIGINT) AS n_both,
  round(CASE WHEN sum(b) > 0 THEN sum(a * b) / CAST(sum(b) AS DOUBLE) ELSE 0 END, 6) AS test_share_seen
FROM sides GROUP BY 1, 2, 3"""
    ),
)
def _(spark, sf):
    table = stored_seqs(spark, sf, "timestamp", *[d.column(f) for d in _DOMAINS for f in d.side_fids])
    train, test = table.where(F.col("timestamp") < _CUT), table.where(F.col("timestamp") >= _CUT)
    parts = [
        profile.seq_item_overlap(train, test, _DOMAINS, buckets).select(F.lit(kind).alias("kind"), "*")
        for kind, buckets in (("item", None), ("bucket", 32))
    ]
    return rounded(parts[0].unionByName(parts[1]), "test_share_seen")


@query(
    "cvr_by_day",
    with_base(
        """SELECT "timestamp" // 86400 AS day, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos, round(avg(y), 6) AS cvr,
  round(count(*) / CAST((SELECT count(*) FROM impressions) AS DOUBLE), 6) AS share,
  strftime(DATE '1970-01-01' + CAST("timestamp" // 86400 AS INTEGER), '%Y-%m-%d') AS date_utc,
  strftime(DATE '1970-01-01' + CAST("timestamp" // 86400 AS INTEGER), '%Y-%m-%d') AS date_local,
  ("timestamp" // 86400 + 3) % 7 AS weekday FROM impressions GROUP BY "timestamp" // 86400"""
    ),
)
def _(spark, sf):
    return rounded(profile.cvr_by_day(rows(spark, sf)), "cvr", "share")


@query(
    "cvr_by_hour",
    with_base(
        """SELECT ("timestamp" // 3600) % 24 AS hour_utc, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos,
  round(avg(y), 6) AS cvr, (("timestamp" // 3600) % 24 + 8) % 24 AS hour_local FROM impressions GROUP BY ALL"""
    ),
)
def _(spark, sf):
    return rounded(profile.cvr_by_hour(rows(spark, sf)), "cvr")


_LOCAL = """, loc AS (SELECT strftime(DATE '1970-01-01' + CAST(("timestamp" + 28800) // 86400 AS INTEGER), '%Y-%m-%d') AS day,
  (("timestamp" + 28800) // 3600) % 24 AS h, y FROM impressions),
parts AS (SELECT *, CASE WHEN h < 6 THEN '00_05' WHEN h < 9 THEN '06_08' WHEN h < 15 THEN '09_14' WHEN h < 21 THEN '15_20' ELSE '21_23' END AS part FROM loc)"""
_LOCAL_KINDS = {"day": "day", "hour": "'hour_' || lpad(CAST(h AS VARCHAR), 2, '0')", "daypart": "part"}


def _local_query(name: str, kind: str):
    @query(
        name,
        with_base(
            _LOCAL
            + f""" SELECT {_LOCAL_KINDS[kind]} AS bucket, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos,
  round(avg(y), 6) AS cvr FROM parts GROUP BY 1"""
        ),
    )
    def _(spark, sf):
        report = profile.local_cvr(rows(spark, sf), kinds=[kind]).drop("kind")
        return rounded(report, "cvr")


_local_query("cvr_by_local_day", "day")
_local_query("cvr_by_local_hour", "hour")
_local_query("cvr_by_local_daypart", "daypart")


@query(
    "cvr_by_local_time",
    with_base(
        _LOCAL
        + " UNION ALL ".join(
            f""" SELECT '{kind}' AS kind, {bucket} AS bucket, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos,
  round(avg(y), 6) AS cvr FROM parts GROUP BY ALL"""
            for kind, bucket in _LOCAL_KINDS.items()
        )
    ),
)
def _(spark, sf):
    return rounded(profile.local_cvr(rows(spark, sf)), "cvr")


@query(
    "abs_ts_quantiles",
    with_base(
        'SELECT ' + _spread_sql('"timestamp"', LENGTH_PERCENTILES) + ' FROM impressions WHERE "timestamp" > 0'
    ),
)
def _(spark, sf):
    return rounded(profile.abs_ts_quantiles(rows(spark, sf)), "mean", *_L_NAMES)


_VALUES = (
    CLEAN_SQL
    + """, vals AS (
  SELECT section, CAST(fid AS BIGINT) AS fid, v, "timestamp" FROM cleaned, LATERAL (VALUES ('user_int', 1, u1), ('user_int', 2, u2),
    ('item_int', 11, i11), ('item_int', 12, i12)) x(section, fid, v) WHERE v <> 0
  UNION ALL SELECT 'user_int', 3, {list}, "timestamp" FROM cleaned WHERE u3a <> 0 OR u3b <> 0)"""
)
_FIRST_SLOT = "u3a"
_FIRST_NONZERO = "CASE WHEN u3a <> 0 THEN u3a ELSE u3b END"


def _cleaned(spark, sf):
    """The id profiles describe what the model sees: cleaned, clipped and truncated ids."""
    return clean_ids(rows(spark, sf), PLAN)


@query(
    "value_quantiles",
    with_base(
        _VALUES.replace("{list}", _FIRST_SLOT)
        + f" SELECT section, fid, {_spread_sql('v', VALUE_PERCENTILES)}, count(DISTINCT v) AS n_distinct FROM vals GROUP BY 1, 2"
    ),
)
def _(spark, sf):
    report = profile.value_quantiles(_cleaned(spark, sf), PLAN.int_features())
    return rounded(report, "mean", *_V_NAMES)


@query(
    "reservoir_sample",
    with_base(
        """, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id
    ORDER BY ((event_id % 1000003) * 7919 + 12345) % 1000003, event_id) AS i FROM impressions)
SELECT event_id, user_id FROM r WHERE i <= 10"""
    ),
)
def _(spark, sf):
    draw = ((F.col("event_id") % 1000003) * 7919 + 12345) % 1000003
    return profile.reservoir_sample(rows(spark, sf).select("event_id", "user_id"), ["user_id"], 10, "event_id", draw)


_START, _END = "2024-01-29 10:00:00", "2024-01-29 15:00:00"
_LO, _HI = local_epoch(_START), local_epoch(_END)
_S_LO, _S_HI = 10 * 3600, 15 * 3600
_CLOCK = f""", sec AS (SELECT ("timestamp" + 28800) // 86400 AS day, ("timestamp" + 28800) % 86400 AS s, "timestamp" AS t, y FROM impressions),
days AS (SELECT day, count(*) FILTER (s BETWEEN {_S_LO} AND {_S_HI}) AS window_rows,
  CAST(coalesce(sum(y) FILTER (s BETWEEN {_S_LO} AND {_S_HI}), 0) AS BIGINT) AS window_pos,
  count(*) AS dr, sum(y)::DOUBLE AS dp, count(*) FILTER (s < {_S_LO}) AS pr, coalesce(sum(y) FILTER (s < {_S_LO}), 0)::DOUBLE AS pp
  FROM sec GROUP BY 1)"""


@query(
    "clock_window_by_day",
    with_base(
        _CLOCK
        + """ SELECT day, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS date_local, window_rows, window_pos,
  round(window_pos / CAST(window_rows AS DOUBLE), 6) AS cvr, round(dp / dr, 6) AS day_cvr,
  round(CASE WHEN pr > 0 THEN pp / pr ELSE 0 END, 6) AS pre_cvr FROM days WHERE window_rows > 0"""
    ),
)
def _(spark, sf):
    report = profile.clock_window_by_day(rows(spark, sf), _START.split()[1], _END.split()[1])
    return rounded(report, "cvr", "day_cvr", "pre_cvr")


@query(
    "window_backtest_summary",
    with_base(
        _CLOCK
        + f""", e AS (SELECT count(*) FILTER (t BETWEEN {_LO} AND {_HI}) AS exact_rows,
  CAST(coalesce(sum(y) FILTER (t BETWEEN {_LO} AND {_HI}), 0) AS BIGINT) AS exact_pos, {_LO} - max(t) AS train_max_to_start_sec FROM sec),
v AS (SELECT count(*) FILTER (window_rows >= 10) AS viable_days,
  CAST(coalesce(sum(window_rows) FILTER (day = ({_LO} + 28800) // 86400), 0) AS BIGINT) AS target_day_rows FROM days)
SELECT exact_rows, exact_pos, CAST(train_max_to_start_sec AS BIGINT) AS train_max_to_start_sec, target_day_rows, viable_days,
  viable_days >= 2 AS recommend FROM e, v"""
    ),
)
def _(spark, sf):
    return windows.window_backtest_summary(rows(spark, sf), _START, _END, 10)


BOARD_WINDOWS = audit_windows(
    _START,
    _END,
    ["2024-01-28", "2024-01-27", "2024-01-26"],
    {"inner_wide": ("11:00:00", "14:00:00"), "inner_narrow": ("12:00:00", "13:00:00")},
)
_DETAIL_SQL = (
    ", w AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{w.name}', {w.start}, {w.end})" for w in BOARD_WINDOWS)
    + """) v("window", a, b)),
inw AS (SELECT * FROM seqs JOIN w ON "timestamp" >= a AND "timestamp" < b)"""
)


@query(
    "window_details",
    with_seqs(
        _DETAIL_SQL
        + ", lens AS ("
        + per_domain("""SELECT "window", 'seq_{d}' AS domain, CAST(least(len({ts}), {L}) AS BIGINT) AS length FROM inw""")
        + """) SELECT "window", domain, count(*) AS n, round(avg(length), 6) AS mean, max(length) AS max,
  round(quantile_cont(length, 0.5), 6) AS p50, round(quantile_cont(length, 0.95), 6) AS p95,
  round(avg((length = 0)::INT), 6) AS empty_share FROM lens GROUP BY 1, 2"""
    ),
)
def _(spark, sf):
    details = windows.window_details(seqs(spark, sf), BOARD_WINDOWS, _DOMAINS)
    return rounded(details, "mean", "p50", "p95", "empty_share")


_TIME_SHARES = (1, 5, 25, 50, 75, 95, 99)


@query(
    "window_time_quantiles",
    with_seqs(
        _DETAIL_SQL
        + """ SELECT "window", count(*) AS n, """
        + _quantiles_sql('("timestamp" - a) / CAST(b - a AS DOUBLE)', _TIME_SHARES)
        + """ FROM inw GROUP BY 1"""
    ),
)
def _(spark, sf):
    report = windows.window_time_quantiles(rows(spark, sf), BOARD_WINDOWS, _TIME_SHARES)
    return rounded(report, *[profile.percentile_name(p) for p in _TIME_SHARES])


# Invented targets: times spread evenly over the window, and round sequence lengths.
TIME_TARGETS = {p: p / 100 for p in (1, 5, 25, 50, 75, 95, 99)}
LENGTH_TARGETS = {"seq_a": (6.8, 8.0), "seq_b": (3.1, 4.0), "seq_c": (5.5, 6.0), "seq_d": (5.2, 6.0)}


def board(spark, sf):
    table = stored_seqs(spark, sf, "timestamp", "label_type", "user_id", "item_id", *_TS_COLUMNS)
    return windows.window_scoreboard(table, BOARD_WINDOWS, _DOMAINS, TIME_TARGETS, LENGTH_TARGETS, 10)


def _local_text(epoch: int) -> str:
    return f"strftime(make_timestamp(({epoch} + 28800)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S')"


_BOARD_SQL = (
    ", w AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{w.name}', {w.start}, {w.end}, {_local_text(w.start)}, {_local_text(w.end)})" for w in BOARD_WINDOWS)
    + """) v("window", a, b, start_local, end_local)),
inw AS (SELECT * FROM seqs JOIN w ON "timestamp" >= a AND "timestamp" < b),
tot AS (SELECT "window", any_value(start_local) AS start_local, any_value(end_local) AS end_local, count(*) AS n_rows,
  CAST(sum(y) AS BIGINT) AS n_pos, ("""
    + " + ".join(
        f'abs(quantile_cont(("timestamp" - a) / CAST(b - a AS DOUBLE), {p / 100}) - {v}::DOUBLE)'
        for p, v in TIME_TARGETS.items()
    )
    + ") / 7 AS time_q_l1, ("
    + " + ".join(
        f"abs(avg(least(len(domain_{d.letter}_seq_{d.ts_fid}), {d.max_len})) - {LENGTH_TARGETS[d.name][0]}::DOUBLE) / {max(LENGTH_TARGETS[d.name][0], 1.0)}::DOUBLE"
        for d in _DOMAINS
    )
    + ") / 4 AS seq_mean_rel_l1, ("
    + " + ".join(
        f"abs(quantile_cont(least(len(domain_{d.letter}_seq_{d.ts_fid}), {d.max_len}), 0.5) - {LENGTH_TARGETS[d.name][1]}::DOUBLE) / {max(LENGTH_TARGETS[d.name][1], 1.0)}::DOUBLE"
        for d in _DOMAINS
    )
    + """) / 4 AS seq_p50_rel_l1 FROM inw GROUP BY 1),
u AS (SELECT "window", count(*) AS user_unique, avg((c = 1)::INT) AS user_singleton_share, max(c) AS user_max_freq
  FROM (SELECT "window", user_id, count(*) AS c FROM inw GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT "window", count(*) AS item_unique, max(c) AS item_max_freq
  FROM (SELECT "window", item_id, count(*) AS c FROM inw GROUP BY 1, 2) GROUP BY 1),
board AS (SELECT tot.*, u.* EXCLUDE ("window"), i.* EXCLUDE ("window"), n_pos / CAST(n_rows AS DOUBLE) AS cvr,
  time_q_l1 + seq_mean_rel_l1 + 0.25 * seq_p50_rel_l1 + 0.10 * greatest(0, 0.95 - user_singleton_share) AS oracle_distance,
  n_rows >= 10 AS viable FROM tot JOIN u USING ("window") JOIN i USING ("window")),
every AS (SELECT "window", w.start_local, w.end_local, coalesce(n_rows, 0) AS n_rows, coalesce(n_pos, 0) AS n_pos,
  coalesce(user_unique, 0) AS user_unique, coalesce(user_max_freq, 0) AS user_max_freq, coalesce(item_unique, 0) AS item_unique,
  coalesce(item_max_freq, 0) AS item_max_freq, coalesce(viable, false) AS viable, user_singleton_share, cvr,
  coalesce(time_q_l1, 'infinity'::DOUBLE) AS time_q_l1, coalesce(seq_mean_rel_l1, 'infinity'::DOUBLE) AS seq_mean_rel_l1,
  coalesce(seq_p50_rel_l1, 'infinity'::DOUBLE) AS seq_p50_rel_l1, coalesce(oracle_distance, 'infinity'::DOUBLE) AS oracle_distance
  FROM w LEFT JOIN board USING ("window"))"""
)
_BOARD_FLOATS = ["time_q_l1", "seq_mean_rel_l1", "seq_p50_rel_l1", "user_singleton_share", "cvr", "oracle_distance"]


@query(
    "window_scoreboard",
    with_seqs(
        _BOARD_SQL
        + ' SELECT "window", start_local, end_local, n_rows, n_pos, user_unique, user_max_freq, item_unique, item_max_freq, viable, '
        + ", ".join(f"round({c}, 6) AS {c}" for c in _BOARD_FLOATS)
        + " FROM every"
    ),
)
def _(spark, sf):
    return rounded(board(spark, sf), *_BOARD_FLOATS)


@query(
    "scoreboard_decision",
    with_seqs(
        _BOARD_SQL
        + """, d AS (SELECT count(*) FILTER (viable) AS viable_windows,
  arg_min("window", (round(oracle_distance, 9), "window")) FILTER (viable AND "window" LIKE 'clk%') AS best_same_clock,
  arg_min("window", (round(oracle_distance, 9), "window")) FILTER (viable AND "window" LIKE 'pre%') AS best_same_day FROM board)
SELECT *, viable_windows >= 3 AND best_same_clock IS NOT NULL AS recommend_gate FROM d"""
    ),
)
def _(spark, sf):
    return windows.scoreboard_decision(board(spark, sf))


@query(
    "value_cvr_signal",
    with_base(
        """, vals AS (
  SELECT section, CAST(fid AS BIGINT) AS fid, coalesce(v, 0) AS value, y FROM impressions, LATERAL (VALUES ('user_int', 1, user_int_feats_1),
    ('user_int', 2, user_int_feats_2), ('item_int', 11, item_int_feats_11), ('item_int', 12, item_int_feats_12)) x(section, fid, v)
  UNION ALL SELECT 'user_int', 3, coalesce(list_filter(user_int_feats_3, lambda v: v <> 0)[1], 0), y FROM impressions),
g AS (SELECT avg(y) AS g FROM impressions),
s AS (SELECT section, fid, value, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos, avg(y) AS cvr, avg(y) - any_value(g) AS cvr_gap
  FROM vals, g GROUP BY 1, 2, 3 HAVING count(*) >= 20),
t AS (SELECT *, n_rows * abs(cvr_gap) AS signal FROM s ORDER BY round(n_rows * abs(cvr_gap), 9) DESC, section, fid, value LIMIT 200)
SELECT section, fid, value, n_rows, n_pos, round(cvr, 6) AS cvr, round(cvr_gap, 6) AS cvr_gap, round(signal, 6) AS signal FROM t"""
    ),
)
def _(spark, sf):
    report = profile.value_cvr_signal(rows(spark, sf), PLAN.int_features(), min_count=20)
    return rounded(report, "cvr", "cvr_gap", "signal")


_TEST_FROM = local_epoch("2024-01-24")
_DRIFT_COLUMNS = ["null_rate_diff", "mean_diff", *[f"{n}_diff" for n in _V_NAMES]]


@query(
    "train_test_drift",
    with_base(
        _VALUES.replace("{list}", _FIRST_NONZERO)
        + f""", q AS (SELECT section, fid, "timestamp" >= {_TEST_FROM} AS late, avg(v) AS mean, {", ".join(f"quantile_cont(v, {p / 100}) AS {n}" for p, n in zip(VALUE_PERCENTILES, _V_NAMES))}
  FROM vals GROUP BY ALL),
nulls AS (SELECT section, CAST(fid AS BIGINT) AS fid, "timestamp" >= {_TEST_FROM} AS late, avg(m::INT) AS null_rate FROM cleaned,
  LATERAL (VALUES ('user_int', 1, u1 = 0), ('user_int', 2, u2 = 0), ('user_int', 3, u3a = 0 AND u3b = 0),
    ('item_int', 11, i11 = 0), ('item_int', 12, i12 = 0)) x(section, fid, m) GROUP BY ALL),
j AS (SELECT * FROM q JOIN nulls USING (section, fid, late))
SELECT section, fid, round(b.null_rate - a.null_rate, 6) AS null_rate_diff, round(b.mean - a.mean, 6) AS mean_diff,
  {", ".join(f"round(b.{n} - a.{n}, 6) AS {n}_diff" for n in _V_NAMES)}
FROM (SELECT * FROM j WHERE NOT late) a JOIN (SELECT * FROM j WHERE late) b USING (section, fid)"""
    ),
)
def _(spark, sf):
    table = _cleaned(spark, sf)
    train, test = table.where(F.col("timestamp") < _TEST_FROM), table.where(F.col("timestamp") >= _TEST_FROM)
    return rounded(profile.train_test_drift(train, test, PLAN.int_features()), *_DRIFT_COLUMNS)


