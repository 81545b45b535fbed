"""Sequence measures, recency buckets, dense blocks, vectors and sample weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrow.catalog.base import (
    PLAN,
    joined,
    long_vector,
    per_domain,
    query,
    r6,
    rows,
    seqs,
    stored_seqs,
    with_base,
    with_seqs,
)
from tallyrow.functions import dense
from tallyrow.functions import sequences as s
from tallyrow.operators import assemble, profile, training, weights
from tallyrow.operators.ranks import exact_quantiles
from tallyrow.plans.fixed import (
    COUNT_FID,
    HOUR_ONLY_FID,
    LOCAL_TIME_FID,
    LOCAL_TIME_V2_FID,
    MISSING_FID,
    SEQ_STATS_FID,
    TIME_BUCKET_EDGES,
    TIME_OF_DAY_FID,
)
from tallyrow.plans.windows import local_day_number

def _ts():
    return F.col("timestamp")

_DOMAINS = PLAN.domains
_TARGET, _FESTIVAL = local_day_number("2024-01-29"), local_day_number("2024-01-28")
_EDGES = "[" + ", ".join(map(str, TIME_BUCKET_EDGES)) + "]"


def _model_length(d):
    return s.model_length([F.col(d.column(f)) for f in d.side_fids], d.max_len)


_LENGTHS = """SELECT event_id, 'seq_{d}' AS domain, CAST(least(len({item}), {L}) AS BIGINT) AS model,
  CAST(len(list_filter({ts}, lambda v: v > 0)) AS BIGINT) AS true_all,
  CAST(len(list_filter({ts}[1:{L}], lambda v: v > 0)) AS BIGINT) AS true_head,
  CAST(least(len({ts}), {L}) AS BIGINT) AS clipped FROM seqs"""


@query("seq_len", with_seqs(per_domain(_LENGTHS)))
def _(spark, sf):
    parts = [
        F.struct(
            F.lit(d.name).alias("domain"),
            _model_length(d).alias("model"),
            s.true_length(F.col(d.ts_column)).alias("true_all"),
            s.true_length(F.col(d.ts_column), d.max_len).alias("true_head"),
            s.clipped_length(F.col(d.ts_column), d.max_len).alias("clipped"),
        )
        for d in _DOMAINS
    ]
    return seqs(spark, sf).select("event_id", F.explode(F.array(*parts)).alias("p")).select("event_id", "p.*")


_DIFFS = """SELECT event_id, 'seq_{d}' AS domain, "timestamp" - s AS diff
  FROM (SELECT event_id, "timestamp", unnest({ts}) AS s FROM seqs) WHERE s > 0 AND "timestamp" - s >= 0"""


@query("seq_time_diffs", with_seqs(per_domain(_DIFFS)))
def _(spark, sf):
    return profile.seq_time_diffs(seqs(spark, sf), _DOMAINS, 0, False, "event_id")


#: The recency buckets of domain {d} as a list.
BUCKET_LIST = (
    "list_transform({ts}[1:{L}], lambda v: CASE WHEN v = 0 THEN 0 ELSE "
    'least(len(list_filter(' + _EDGES + ', lambda b: b < greatest("timestamp" - v, 0))), 62) + 1 END)'
)
_BUCKETS = f"array_to_string({BUCKET_LIST}, ',') AS tb_{{d}}"


@query("time_bucket", with_seqs("SELECT event_id, " + per_domain(_BUCKETS, ", ") + " FROM seqs"))
def _(spark, sf):
    return seqs(spark, sf).select(
        "event_id",
        *[joined(s.time_buckets(_ts(), F.col(d.ts_column), d.max_len)).alias(f"tb_{d.letter}") for d in _DOMAINS],
    )


_POSITIVE_DIFFS = """SELECT 'seq_{d}' AS domain, "timestamp" - s AS diff
  FROM (SELECT "timestamp", unnest({ts}) AS s FROM seqs) WHERE s > 0 AND "timestamp" - s > 0"""


@query(
    "fit_log_bounds",
    with_seqs(
        ", diffs AS ("
        + per_domain(_POSITIVE_DIFFS)
        + f"""), p AS (SELECT domain, count(*) AS n, quantile_cont(diff, 0.99) AS p99 FROM diffs GROUP BY 1),
ideal AS (SELECT domain, n, p99, i,
  greatest(round_even(exp(ln(5) + i * (ln(p99) - ln(5)) / 62), 0), CASE WHEN i = 0 THEN 5 ELSE 0 END) AS e FROM p, range(63) t(i)),
fitted AS (SELECT domain, n, p99, i, max(e - i) OVER (PARTITION BY domain ORDER BY i) + i AS e FROM ideal)
SELECT domain, CAST(i AS BIGINT) AS pos,
  CAST(CASE WHEN n < 100 OR p99 <= 5 THEN {_EDGES}[i + 1] ELSE e END AS BIGINT) AS edge FROM fitted"""
    ),
)
def _(spark, sf):
    edges = profile.fit_time_edges(seqs(spark, sf), _DOMAINS)
    frames = [(name, i, e) for name, found in edges.items() for i, e in enumerate(found)]
    return spark.createDataFrame(frames, "domain string, pos bigint, edge bigint")


@query(
    "bucket_fit_sample",
    with_seqs(
        """, cat AS (SELECT block_time AS block, row_number() OVER (ORDER BY block_time) - 1 AS r FROM seqs GROUP BY 1),
n AS (SELECT count(*) AS n FROM cat),
picks AS (SELECT CASE WHEN i = 7 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 7.0::DOUBLE)) AS BIGINT) END AS r FROM n, range(8) t(i)),
chosen AS (SELECT * FROM seqs WHERE block_time IN (SELECT block FROM cat WHERE r IN (SELECT r FROM picks))),
diffs AS ("""
        + per_domain(_POSITIVE_DIFFS).replace("FROM seqs", "FROM chosen")
        + """) SELECT domain, count(*) AS n, round(quantile_cont(diff, 0.99), 6) AS p99 FROM diffs GROUP BY 1"""
    ),
)
def _(spark, sf):
    table = stored_seqs(spark, sf, "event_id", "timestamp", "block_time", *[d.ts_column for d in _DOMAINS])
    sample = profile.bucket_fit_sample(table, _DOMAINS, "block_time", "event_id", 8)
    found = exact_quantiles(sample, ["domain"], "diff", [0.99])
    return found.select("domain", "n", r6(F.get("quantiles", F.lit(0))).alias("p99"))


_SPREAD = "coalesce(list_max(list_filter({ts}[1:{L}], lambda v: v > 0)) - list_min(list_filter({ts}[1:{L}], lambda v: v > 0)), 0)"
_STATS = (
    "SELECT event_id, 'seq_{d}' AS domain, round(ln(1 + least(len({item}), {L})), 6) AS log_len, "
    "round(ln(1 + " + _SPREAD + "), 6) AS log_range FROM seqs"
)


@query("seq_stats", with_seqs(per_domain(_STATS)))
def _(spark, sf):
    parts = []
    for d in _DOMAINS:
        log_len, log_range = dense.seq_stats_block(_model_length(d), F.col(d.ts_column), d.max_len)
        parts.append(
            F.struct(F.lit(d.name).alias("domain"), r6(log_len).alias("log_len"), r6(log_range).alias("log_range"))
        )
    return seqs(spark, sf).select("event_id", F.explode(F.array(*parts)).alias("p")).select("event_id", "p.*")


@query(
    "seq_total_len",
    with_seqs("SELECT event_id, CAST(" + per_domain("least(len({item}), {L})", " + ") + " AS BIGINT) AS total FROM seqs"),
)
def _(spark, sf):
    total = sum((_model_length(d) for d in _DOMAINS), F.lit(0).cast("bigint"))
    return seqs(spark, sf).select("event_id", total.alias("total"))


# --- dense blocks --------------------------------------------------------------------------

CLEAN_SQL = """, cleaned AS (SELECT event_id, "timestamp",
  CASE WHEN user_int_feats_1 > 0 AND user_int_feats_1 < 7 THEN user_int_feats_1 ELSE 0 END AS u1,
  CASE WHEN user_int_feats_2 > 0 AND user_int_feats_2 < 250 THEN user_int_feats_2 ELSE 0 END AS u2,
  coalesce(CASE WHEN user_int_feats_3[1] > 0 AND user_int_feats_3[1] < 4 THEN user_int_feats_3[1] ELSE 0 END, 0) AS u3a,
  coalesce(CASE WHEN user_int_feats_3[2] > 0 AND user_int_feats_3[2] < 4 THEN user_int_feats_3[2] ELSE 0 END, 0) AS u3b,
  CASE WHEN item_int_feats_11 > 0 AND item_int_feats_11 < 90 THEN item_int_feats_11 ELSE 0 END AS i11,
  CASE WHEN item_int_feats_12 > 0 AND item_int_feats_12 < 10 THEN item_int_feats_12 ELSE 0 END AS i12,
  user_dense_feats_61, user_dense_feats_62 FROM impressions)"""
_NZ_USER = "((u1 <> 0)::BIGINT + (u2 <> 0)::BIGINT + (u3a <> 0)::BIGINT + (u3b <> 0)::BIGINT)"
_NZ_ITEM = "((i11 <> 0)::BIGINT + (i12 <> 0)::BIGINT)"


def user_nonzero():
    return dense.nonzero_count(
        [F.col("user_int_feats_1"), F.col("user_int_feats_2")], [F.col("user_int_feats_3")]
    )


def item_nonzero():
    return dense.nonzero_count([F.col("item_int_feats_11"), F.col("item_int_feats_12")])


@query(
    "count_features",
    with_base(
        CLEAN_SQL
        + f" SELECT event_id, round(ln(1 + {_NZ_USER}), 6) AS user_count, round(ln(1 + {_NZ_ITEM}), 6) AS item_count FROM cleaned"
    ),
)
def _(spark, sf):
    cleaned = assemble.clean_ids(rows(spark, sf), PLAN)
    user, item = dense.count_block(user_nonzero(), item_nonzero())
    return cleaned.select("event_id", r6(user).alias("user_count"), r6(item).alias("item_count"))


_CLOCK_SQL = """, clock AS (SELECT event_id, ("timestamp" // 3600) % 24 AS h, ("timestamp" // 86400 + 3) % 7 AS d,
  (("timestamp" + 28800) // 3600) % 24 AS lh, ("timestamp" + 28800) // 86400 AS lday,
  (("timestamp" + 28800) // 86400 + 3) % 7 AS ld FROM impressions)"""


def _vector_sql(parts: list[str]) -> str:
    cells = ", ".join(f"({i}, CAST({p} AS DOUBLE))" for i, p in enumerate(parts))
    return with_base(
        _CLOCK_SQL
        + f""" SELECT event_id, CAST(pos AS BIGINT) AS pos, round(v, 6) AS v
FROM clock, LATERAL (VALUES {cells}) x(pos, v)"""
    )


def _wave_sql(col: str, period: int) -> list[str]:
    return [f"sin(2 * pi() * {col} / {period}.0::DOUBLE)", f"cos(2 * pi() * {col} / {period}.0::DOUBLE)"]


_TOD_SQL = _wave_sql("h", 24) + _wave_sql("d", 7) + ["d >= 5"]
_LOCAL_SQL = (
    _wave_sql("lh", 24)
    + _wave_sql("lh", 12)
    + _wave_sql("ld", 7)
    + ["ld >= 5", "ld < 5", "lh BETWEEN 9 AND 14", "lh BETWEEN 6 AND 8"]
)
_DAYS = f"greatest(least({_TARGET} - lday, 7), -7)"
_V2_SQL = [
    f"{_DAYS} / 7.0::DOUBLE",
    f"abs({_DAYS}) / 7.0::DOUBLE",
    f"lday = {_FESTIVAL}",
    f"lday = {_TARGET}",
    f"lday < {_FESTIVAL}",
    f"lday > {_TARGET}",
    "least(CASE WHEN lh < 9 THEN 9 - lh WHEN lh > 14 THEN lh - 14 ELSE 0 END, 12) / 12.0::DOUBLE",
    "((lh + 0.5::DOUBLE) - 24 * floor((lh + 0.5::DOUBLE) / 24) - 12) / 12",
    "lh < 6",
    "lh BETWEEN 6 AND 8",
    "lh BETWEEN 9 AND 14",
    "lh BETWEEN 15 AND 20",
    "lh > 20",
    f"lday = {_TARGET} AND lh BETWEEN 9 AND 14",
]


def _block_query(name, sql_parts, columns):
    @query(name, _vector_sql(sql_parts))
    def _(spark, sf):
        return long_vector(rows(spark, sf), F.array(*columns()))


_block_query("time_of_day", _TOD_SQL, lambda: dense.time_of_day_block(_ts()))
_block_query("hour_only", _TOD_SQL[:2], lambda: dense.hour_block(_ts()))
_block_query("local_time", _LOCAL_SQL, lambda: dense.local_time_block(_ts()))
_block_query("local_time_v2", _V2_SQL, lambda: dense.local_time_v2_block(_ts(), _TARGET, _FESTIVAL))


_ASSEMBLED = [
    "user_dense_feats_61[1]",
    "user_dense_feats_61[2]",
    "0",
    "ln(1 + greatest(user_dense_feats_62[1], 0))",
    f"ln(1 + {_NZ_USER})",
    f"ln(1 + {_NZ_ITEM})",
    *[p.replace("h /", 'CAST(("timestamp" // 3600) % 24 AS DOUBLE) /').replace("d /", '(("timestamp" // 86400 + 3) % 7) /')
      for p in _TOD_SQL[:4]],
    '("timestamp" // 86400 + 3) % 7 >= 5',
]
_LAYOUT = [(61, 0, 3), (62, 3, 1), (COUNT_FID, 4, 2), (TIME_OF_DAY_FID, 6, 5)]


@query(
    "assemble_dense",
    with_base(
        CLEAN_SQL
        + ", vec AS (SELECT event_id, pos, round(v, 6) AS v FROM cleaned, LATERAL (VALUES "
        + ", ".join(f"({i}, CAST({p} AS DOUBLE))" for i, p in enumerate(_ASSEMBLED))
        + ") x(pos, v)), layout AS (SELECT * FROM (VALUES "
        + ", ".join(map(str, _LAYOUT))
        + """) l(fid, off, length))
SELECT event_id, CAST(fid AS BIGINT) AS fid, CAST(pos - off AS BIGINT) AS pos, v
FROM vec JOIN layout ON pos >= off AND pos < off + length"""
    ),
)
def _(spark, sf):
    cleaned = assemble.clean_ids(rows(spark, sf), PLAN)
    parts = assemble.raw_dense_blocks(PLAN)
    parts.append(assemble.block(COUNT_FID, dense.count_block(user_nonzero(), item_nonzero())))
    parts.append(assemble.block(TIME_OF_DAY_FID, dense.time_of_day_block(_ts())))
    vector, layout = assemble.assemble_dense(parts)
    pieces = F.array(
        *[
            F.struct(F.lit(fid).cast("bigint").alias("fid"), F.slice("vector", offset + 1, length).alias("values"))
            for fid, offset, length in layout
        ]
    )
    split = cleaned.select("event_id", vector.alias("vector")).select("event_id", F.explode(pieces).alias("p"))
    return split.select("event_id", "p.fid", F.posexplode("p.values").alias("pos", "v")).select(
        "event_id", "fid", F.col("pos").cast("bigint").alias("pos"), r6("v").alias("v")
    )


@query(
    "assemble_int",
    with_base(
        CLEAN_SQL
        + """ SELECT event_id, concat_ws(',', u1, u2, u3a, u3b) AS user_vector, concat_ws(',', i11, i12) AS item_vector,
  '1:0:1 2:1:1 3:2:2' AS user_layout FROM cleaned"""
    ),
)
def _(spark, sf):
    cleaned = assemble.clean_ids(rows(spark, sf), PLAN)
    layout = " ".join(":".join(map(str, e)) for e in assemble.int_layout(PLAN.user_int))
    return cleaned.select(
        "event_id",
        joined(assemble.assemble_ints(cleaned, PLAN.user_int)).alias("user_vector"),
        joined(assemble.assemble_ints(cleaned, PLAN.item_int)).alias("item_vector"),
        F.lit(layout).alias("user_layout"),
    )


# --- weights ----------------------------------------------------------------------------------

_END = ', e AS (SELECT max("timestamp") AS hi, min("timestamp") AS lo FROM impressions)'
_MATURE = "CASE WHEN coalesce(label_type, 0) <> 2 AND hi - \"timestamp\" < 86400 THEN 0.25::DOUBLE ELSE 1 END"
_RECENCY = 'exp(1.5::DOUBLE * (("timestamp" - lo) / CAST(hi - lo AS DOUBLE)))'
_HOUR_IN = '(("timestamp" + 28800) // 3600) % 24 BETWEEN 9 AND 14'
_HOURS = f"CASE WHEN {_HOUR_IN} THEN 2.0::DOUBLE ELSE 1 END"
_ON_DAY = f'(("timestamp" + 28800) // 86400 = {_TARGET} AND {_HOUR_IN})'
_DAY_W = f"CASE WHEN {_ON_DAY} THEN 3.0::DOUBLE ELSE 1 END"


@query(
    "weight_mature_negative",
    with_base(_END + f" SELECT event_id, {_MATURE} AS w FROM impressions, e"),
)
def _(spark, sf):
    table = rows(spark, sf)
    end = weights.ts_range(table)[1]
    return table.select(
        "event_id", weights.mature_negative(_ts(), F.col("label_type"), end, weight=0.25).alias("w")
    )


@query(
    "weight_recency",
    with_base(
        _END + f", raw AS (SELECT event_id, {_RECENCY} AS w FROM impressions, e)"
        " SELECT event_id, round(w / (SELECT avg(w) FROM raw), 6) AS w FROM raw"
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    raw = weights.recency(_ts(), *weights.ts_range(table), 1.5)
    return table.select("event_id", r6(weights.normalised(table, raw)).alias("w"))


@query(
    "weight_hours",
    with_base(
        f", raw AS (SELECT event_id, {_HOURS} AS w FROM impressions)"
        " SELECT event_id, round(w / (SELECT avg(w) FROM raw), 6) AS w FROM raw"
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    return table.select("event_id", r6(weights.normalised(table, weights.hours(_ts(), 9, 14, 2.0))).alias("w"))


@query(
    "weight_target_day",
    with_base(
        _END
        + f""", n AS (SELECT 1 + 2 * avg(CAST({_ON_DAY} AS DOUBLE)) AS norm FROM impressions),
r AS (SELECT avg({_RECENCY}) AS mean FROM impressions, e)
SELECT event_id, round({_DAY_W} / norm, 6) AS w, round({_DAY_W} / norm * {_MATURE} * ({_RECENCY} / mean), 6) AS combined
FROM impressions, e, n, r"""
    ),
)
def _(spark, sf):
    table = rows(spark, sf)
    first, last = weights.ts_range(table)
    norm = weights.target_day_norm(table, _ts(), _TARGET, 9, 14, 3.0)
    day = weights.target_day(_ts(), _TARGET, 9, 14, 3.0, norm)
    mature = weights.mature_negative(_ts(), F.col("label_type"), last, weight=0.25)
    recent = weights.normalised(table, weights.recency(_ts(), first, last, 1.5))
    return table.select(
        "event_id", r6(day).alias("w"), r6(weights.product(day, mature, recent)).alias("combined")
    )



@query(
    "training_table",
    with_seqs(
        CLEAN_SQL
        + """, lens AS (SELECT event_id, """
        + per_domain("CAST(least(len({item}), {L}) AS BIGINT) AS len_{d}", ", ")
        + ", "
        + per_domain(_BUCKETS, ", ")
        + ", "
        + per_domain("ln(1 + least(len({item}), {L})) + ln(1 + " + _SPREAD + ") AS stat_{d}", ", ")
        + """, CAST(coalesce(label_type, 0) = 2 AS BIGINT) AS label, CAST(coalesce(label_type, 0) >= 1 AS BIGINT) AS label_click,
  coalesce(user_int_feats_1, 0) <= 0 AS m1, coalesce(user_int_feats_2, 0) <= 0 AS m2,
  CASE WHEN coalesce(user_int_feats_1, 0) <= 0 THEN 7 WHEN user_int_feats_1 < 8 THEN user_int_feats_1 ELSE 0 END AS r1,
  CASE WHEN coalesce(user_int_feats_2, 0) <= 0 THEN 250 WHEN user_int_feats_2 < 251 THEN user_int_feats_2 ELSE 0 END AS r2
  FROM seqs)
SELECT event_id, label, label_click, concat_ws(',', r1, r2, u3a, u3b) AS user_int, concat_ws(',', i11, i12) AS item_int,
  len_a + len_b + len_c + len_d AS seq_total_len, tb_a, tb_b, tb_c, tb_d, CAST(18 AS BIGINT) AS dense_len,
  round(ln(1 + greatest(user_dense_feats_62[1], 0))
    + ln(1 + ((r1 <> 0)::INT + (r2 <> 0)::INT + (u3a <> 0)::INT + (u3b <> 0)::INT)) + ln(1 + ((i11 <> 0)::INT + (i12 <> 0)::INT))
    + stat_a + stat_b + stat_c + stat_d + sin(2 * pi() * h / 24) + cos(2 * pi() * h / 24) + m1::INT + m2::INT, 5) AS dense_sum
FROM cleaned JOIN lens USING (event_id), LATERAL (SELECT CAST(("timestamp" // 3600) % 24 AS DOUBLE) AS h) x"""
    ),
)
def _(spark, sf):
    options = training.TableOptions(
        routed_user=[1, 2, 3], count_features=True, seq_stats=True, hour_only=True
    )
    table, _layout = training.training_table(seqs(spark, sf), PLAN, "event_id", options)
    return table.select(
        "event_id",
        "label",
        "label_click",
        joined(F.col("user_int")).alias("user_int"),
        joined(F.col("item_int")).alias("item_int"),
        "seq_total_len",
        *[joined(F.col(f"{d.name}_time_bucket")).alias(f"tb_{d.letter}") for d in _DOMAINS],
        F.size("user_dense").cast("bigint").alias("dense_len"),
        F.round(F.aggregate("user_dense", F.lit(0.0), lambda a, x: a + x), 5).alias("dense_sum"),
    )


_SEQ_CELLS = ["ln(1 + least(len({item}), {L}))", "ln(1 + " + _SPREAD + ")"]
#: (fid, cells) of the whole dense vector in its order; fid 0 stands for the sample weight.
_SLOTS = [
    (61, ["user_dense_feats_61[1]", "user_dense_feats_61[2]", "0"]),
    (62, ["ln(1 + greatest(user_dense_feats_62[1], 0))"]),
    (
        COUNT_FID,
        ["ln(1 + (r1 <> 0)::INT + (r2 <> 0)::INT + (u3a <> 0)::INT + (u3b <> 0)::INT)", "ln(1 + (i11 <> 0)::INT + (i12 <> 0)::INT)"],
    ),
    (SEQ_STATS_FID, per_domain("\n".join(_SEQ_CELLS), "\n").split("\n")),
    (TIME_OF_DAY_FID, _TOD_SQL),
    (LOCAL_TIME_FID, _LOCAL_SQL),
    (LOCAL_TIME_V2_FID, _V2_SQL),
    (HOUR_ONLY_FID, _TOD_SQL[:2]),
    (MISSING_FID, ["m1", "m2"]),
    (0, [_HOURS]),
]


@query(
    "training_table_slots",
    with_seqs(
        CLEAN_SQL
        + _CLOCK_SQL
        + """, routed AS (SELECT * EXCLUDE (user_dense_feats_61, user_dense_feats_62), coalesce(user_int_feats_1, 0) <= 0 AS m1, coalesce(user_int_feats_2, 0) <= 0 AS m2,
  CASE WHEN coalesce(user_int_feats_1, 0) <= 0 THEN 7 WHEN user_int_feats_1 < 8 THEN user_int_feats_1 ELSE 0 END AS r1,
  CASE WHEN coalesce(user_int_feats_2, 0) <= 0 THEN 250 WHEN user_int_feats_2 < 251 THEN user_int_feats_2 ELSE 0 END AS r2
  FROM seqs),
wide AS (SELECT routed.*, h, d, lh, ld, lday, u3a, u3b, i11, i12, cleaned.user_dense_feats_61, cleaned.user_dense_feats_62
  FROM routed JOIN cleaned USING (event_id) JOIN clock USING (event_id))
SELECT event_id, CAST(fid AS BIGINT) AS fid, CAST(pos AS BIGINT) AS pos, round(v, 6) AS v FROM wide, LATERAL (VALUES """
        + ", ".join(f"({fid}, {i}, CAST({cell} AS DOUBLE))" for fid, cells in _SLOTS for i, cell in enumerate(cells))
        + ") x(fid, pos, v)"
    ),
)
def _(spark, sf):
    options = training.TableOptions(
        routed_user=[1, 2, 3],
        count_features=True,
        seq_stats=True,
        time_of_day=True,
        local_time=True,
        local_time_v2=(_TARGET, _FESTIVAL),
        hour_only=True,
    )
    weight = weights.hours(_ts(), 9, 14, 2.0)
    table, layout = training.training_table(seqs(spark, sf), PLAN, "event_id", options, weight)
    pieces = [(fid, F.slice("user_dense", offset + 1, length)) for fid, offset, length in layout]
    pieces.append((0, F.array("sample_weight")))
    parts = F.array(*[F.struct(F.lit(fid).cast("bigint").alias("fid"), values.alias("values")) for fid, values in pieces])
    split = table.select("event_id", F.explode(parts).alias("p"))
    return split.select("event_id", "p.fid", F.posexplode("p.values").alias("pos", "v")).select(
        "event_id", "fid", F.col("pos").cast("bigint").alias("pos"), r6("v").alias("v")
    )
