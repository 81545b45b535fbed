"""Metrics and losses over the scored table, and the linear baseline."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyrow.catalog.base import PLAN, SEQ_SQL, per_domain, query, r6, rounded, rows, with_base, with_scored, with_seqs
from tallyrow.catalog.features import CLEAN_SQL, item_nonzero, user_nonzero
from tallyrow.functions import sequences as s
from tallyrow.functions.cleaning import binary_label
from tallyrow.operators import assemble, joint, metrics, scoring, splits, training, weights
from tallyrow.plans.windows import TimeWindow, local_epoch
from tallyrow.session import materialize
from tallyrow.sources import event_log

_BCE = "greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))"
_P = "(1 / (1 + exp(-logit)))"


def _auc_sql(source: str, keys: str = "") -> str:
    """AUC by rank sums: average rank of the positives, ties sharing a rank."""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    select = f"{keys}, " if keys else ""
    return f"""SELECT {select}count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos,
  (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
    / nullif(sum(label) * CAST(count(*) - sum(label) AS DOUBLE), 0) AS auc
FROM (SELECT *, rank() OVER ({part} ORDER BY logit) + (count(*) OVER (PARTITION BY {select}logit) - 1) / 2.0::DOUBLE AS r
      FROM {source} WHERE logit IS NOT NULL) {group}"""


def scored(spark, sf):
    return event_log.scored(spark, sf)


@query("auc", with_scored(f"SELECT n, n_pos, round(auc, 6) AS auc FROM ({_auc_sql('scored')})"))
def _(spark, sf):
    return rounded(metrics.auc(scored(spark, sf)), "auc")


@query(
    "logloss",
    with_scored(f"SELECT count(*) AS n, round(avg({_BCE}), 6) AS logloss FROM scored WHERE logit IS NOT NULL"),
)
def _(spark, sf):
    return rounded(metrics.logloss(scored(spark, sf)), "logloss")


def _diagnostics(spark, sf):
    """Scored rows with the slice columns: non-zero id slots, list length, raw label."""
    table = event_log.impressions_with_sequences(spark, sf)
    total = sum(
        (s.model_length([F.col(d.column(f)) for f in d.side_fids], d.max_len) for d in PLAN.domains),
        F.lit(0).cast("bigint"),
    )
    cleaned = assemble.clean_ids(table.withColumn("seq_total_len", total), PLAN)
    slices = cleaned.select(
        "event_id",
        user_nonzero().alias("user_nonzero"),
        item_nonzero().alias("item_nonzero"),
        "seq_total_len",
        F.coalesce("label_type", F.lit(0)).cast("bigint").alias("label_type_raw"),
        F.col("label_type"),
        "timestamp",
        "event_type",
    )
    label = (F.col("event_type") == "purchase").cast("bigint")
    score = ((F.col("event_id") * 7919) % 1000).cast("double") / 250.0 - 2.0 + label.cast("double") * 0.5
    logit = F.when(F.col("event_id") % 997 == 0, F.lit(float("nan"))).otherwise(score)
    return slices.select("*", label.alias("label"), logit.alias("logit"))


def _diagnostics_sql(body: str) -> str:
    lengths = per_domain("least(len({item}), {L})", " + ")
    return (
        f"WITH {SEQ_SQL}"
        + CLEAN_SQL
        + f""", diag AS (SELECT q.event_id, CAST(q.y AS BIGINT) AS label, CAST({lengths} AS BIGINT) AS seq_total_len,
    CAST(coalesce(label_type, 0) AS BIGINT) AS label_type_raw,
    (u1 <> 0)::BIGINT + (u2 <> 0)::BIGINT + (u3a <> 0)::BIGINT + (u3b <> 0)::BIGINT AS user_nonzero,
    (i11 <> 0)::BIGINT + (i12 <> 0)::BIGINT AS item_nonzero,
    CASE WHEN q.event_id % 997 = 0 THEN NULL
         ELSE CAST((q.event_id * 7919) % 1000 AS DOUBLE) / 250.0::DOUBLE - 2.0::DOUBLE + 0.5::DOUBLE * q.y END AS logit
  FROM seqs q JOIN cleaned c ON q.event_id = c.event_id)
{body}"""
    )


_SLICES = ("user_nonzero", "item_nonzero", "seq_total_len")


@query(
    "slice_inputs",
    _diagnostics_sql("SELECT event_id, user_nonzero, item_nonzero, seq_total_len, label_type_raw FROM diag"),
)
def _(spark, sf):
    return _diagnostics(spark, sf).select("event_id", *_SLICES, "label_type_raw")


_SLICE_OUT = "slice, bucket, n, n_pos, round(n_pos / CAST(n AS DOUBLE), 6) AS pos_rate, round(auc, 6) AS auc"


@query(
    "slice_quantile",
    _diagnostics_sql(
        ", ok AS (SELECT * FROM diag WHERE logit IS NOT NULL), long AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS slice, {c} AS v, label, logit FROM ok" for c in _SLICES)
        + """), edges AS (SELECT slice, list_sort(list_distinct([quantile_cont(v, 0.0), quantile_cont(v, 0.25),
    quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 1.0)])) AS e FROM long GROUP BY 1),
placed AS (SELECT l.slice, label, logit, e, CAST(len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS BIGINT) AS bucket
  FROM long l JOIN edges USING (slice) WHERE len(e) >= 2),
cut AS (SELECT slice, label, logit, bucket, CAST(floor(e[bucket + 1]) AS BIGINT) AS lower, CAST(floor(e[bucket + 2]) AS BIGINT) AS upper FROM placed),
a AS ("""
        + _auc_sql("cut", "slice, bucket")
        + f"""), m AS (SELECT slice, bucket, min(lower) AS lower, min(upper) AS upper, avg({_P}) AS pred_mean FROM cut GROUP BY 1, 2)
SELECT {_SLICE_OUT}, lower, upper, round(pred_mean, 6) AS pred_mean FROM a JOIN m USING (slice, bucket)"""
    ),
)
def _(spark, sf):
    table = materialize(_diagnostics(spark, sf).select(*_SLICES, "label", "logit"))
    return rounded(metrics.slice_report(table, _SLICES), "pos_rate", "auc", "pred_mean")


@query(
    "slice_label_type",
    _diagnostics_sql(
        ", cut AS (SELECT 'label_type_raw' AS slice, label_type_raw AS bucket, CAST(NULL AS BIGINT) AS lower, CAST(NULL AS BIGINT) AS upper, label, logit FROM diag WHERE logit IS NOT NULL), a AS ("
        + _auc_sql("cut", "slice, bucket")
        + f"""), m AS (SELECT slice, bucket, min(lower) AS lower, min(upper) AS upper, avg({_P}) AS pred_mean FROM cut GROUP BY 1, 2)
SELECT {_SLICE_OUT}, lower, upper, round(pred_mean, 6) AS pred_mean FROM a JOIN m USING (slice, bucket)"""
    ),
)
def _(spark, sf):
    table = scored(spark, sf).withColumn("label_type_raw", F.coalesce("label_type", F.lit(0)))
    return rounded(metrics.slice_report(table, [], ["label_type_raw"]), "pos_rate", "auc", "pred_mean")


_WINDOWS = [
    TimeWindow("valid", local_epoch("2024-01-24"), local_epoch("2024-01-27")),
    TimeWindow("holdout", local_epoch("2024-01-27"), local_epoch("2024-01-31")),
    TimeWindow("aux_mid", local_epoch("2024-01-25"), local_epoch("2024-01-28")),
]


@query(
    "eval_windows",
    with_scored(
        ", w AS (SELECT * FROM (VALUES "
        + ", ".join(f"('{w.name}', {w.start}, {w.end})" for w in _WINDOWS)
        + """) v("window", a, b)),
inw AS (SELECT "window", label, logit FROM scored JOIN w ON "timestamp" >= a AND "timestamp" < b), a AS ("""
        + _auc_sql("inw", '"window"')
        + f"""), l AS (SELECT "window", avg({_BCE}) AS logloss FROM inw WHERE logit IS NOT NULL GROUP BY 1)
SELECT "window", n, n_pos, round(auc, 6) AS auc, round(logloss, 6) AS logloss,
  CASE WHEN "window" <> 'valid' THEN round((SELECT auc FROM a WHERE "window" = 'valid') - auc, 6) END AS gap
FROM a JOIN l USING ("window")"""
    ),
)
def _(spark, sf):
    inside = splits.window_rows(scored(spark, sf), _WINDOWS)
    return rounded(metrics.eval_windows(inside, "valid"), "auc", "logloss", "gap")


@query(
    "loss_weighted_bce",
    with_scored(
        f""", t AS (SELECT *, CASE WHEN (("timestamp" + 28800) // 3600) % 24 BETWEEN 9 AND 14 THEN 2.0::DOUBLE ELSE 1 END AS w
  FROM scored WHERE logit IS NOT NULL)
SELECT round(sum(w * ({_BCE})) / greatest(sum(w), 1), 6) AS loss FROM t"""
    ),
)
def _(spark, sf):
    table = scored(spark, sf).withColumn("w", weights.hours(F.col("timestamp"), 9, 14, 2.0))
    return rounded(metrics.weighted_bce(table, "w"), "loss")


_FOCAL = f"""(CASE WHEN label = 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END)
  * pow(1 - CASE WHEN label = 1 THEN {_P} ELSE 1 - {_P} END, 2) * ({_BCE})"""


@query("loss_focal", with_scored(f"SELECT round(avg({_FOCAL}), 6) AS loss FROM scored WHERE logit IS NOT NULL"))
def _(spark, sf):
    return rounded(metrics.focal_loss(scored(spark, sf)), "loss")


def _batch():
    return F.floor(F.col("event_id") / 256)


_BPR = """, pairs AS (SELECT p.event_id // 256 AS batch, p.logit - n.logit - 0.5::DOUBLE AS d
  FROM scored p JOIN scored n ON p.event_id // 256 = n.event_id // 256
  WHERE p.label = 1 AND n.label = 0 AND p.logit IS NOT NULL AND n.logit IS NOT NULL),
bpr AS (SELECT avg(loss) AS bpr FROM
  (SELECT batch, avg(greatest(-d, 0) + ln(1 + exp(-abs(d)))) AS loss FROM pairs GROUP BY 1))"""


@query("loss_bpr", with_scored(_BPR + " SELECT round(bpr, 6) AS loss FROM bpr"))
def _(spark, sf):
    return rounded(metrics.bpr_loss(scored(spark, sf), _batch(), 0.5), "loss")


@query(
    "loss_combined_auc",
    with_scored(
        _BPR
        + f", b AS (SELECT avg({_BCE}) AS bce FROM scored WHERE logit IS NOT NULL)"
        + " SELECT round(0.7 * bce + 0.3 * bpr, 6) AS loss FROM bpr, b"
    ),
)
def _(spark, sf):
    return rounded(metrics.combined_auc_loss(scored(spark, sf), _batch(), 0.3, 0.5), "loss")


@query(
    "loss_multitask",
    with_scored(
        f""", c AS (SELECT avg({_BCE.replace('logit', 'cl').replace('label', 'cy')}) AS c FROM
  (SELECT ((event_id * 6151) % 1000) / 250.0::DOUBLE - 2 AS cl, (coalesce(label_type, 0) >= 1)::INT AS cy FROM scored)),
f AS (SELECT avg({_FOCAL}) AS f FROM scored WHERE logit IS NOT NULL)
SELECT round(1.0 * c + 2.0 * f, 6) AS loss FROM c, f"""
    ),
)
def _(spark, sf):
    table = scored(spark, sf).select(
        "*",
        (((F.col("event_id") * 6151) % 1000).cast("double") / 250.0 - 2.0).alias("click_logit"),
        binary_label(F.col("label_type"), 1).alias("label_click"),
    )
    click = metrics.mean_bce(table, "click_logit", "label_click")
    return rounded(metrics.multitask_loss(click, metrics.focal_loss(table)), "loss")


_VALID = with_seqs(
    """, n AS (SELECT count(*) AS n FROM seqs),
cut AS (SELECT "timestamp" AS c FROM (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS r FROM seqs), n
  WHERE r = n - greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))),
valid AS (SELECT seqs.*, (coalesce(label_type, 0) = 2)::INT AS conversion, (coalesce(label_type, 0) >= 1)::INT AS click
  FROM seqs, cut WHERE "timestamp" >= c)"""
)


def _parts(spark, sf):
    """The assembled table, written once for both heads, split at one cut."""
    options = training.TableOptions(
        routed_user=[1, 2, 3], count_features=True, seq_stats=True, time_of_day=True, local_time=True
    )
    daytime = weights.hours(F.col("timestamp"), 9, 14, 2.0)
    sequences = event_log.impressions_with_sequences(spark, sf)
    assembled, _layout = training.training_table(sequences, PLAN, "event_id", options, daytime)
    table = materialize(scoring.model_inputs(assembled, PLAN, ["event_id", "user_id", "timestamp", "label", "label_click"]))
    cutoff = splits.row_cutoff(table, 0.1)
    return table.where(F.col("timestamp") < cutoff), table.where(F.col("timestamp") >= cutoff)


@query(
    "train_baseline",
    _VALID
    + """ SELECT head, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, true AS in_range, true AS learned FROM
  (SELECT 'conversion' AS head, conversion AS y FROM valid UNION ALL SELECT 'click', click FROM valid) GROUP BY 1""",
)
def _(spark, sf):
    """Both heads. No feature explains the labels of the test table, so ``learned`` is about the fit:
    the weighted loss on the training part is below that of the best constant rate."""
    train, valid = _parts(spark, sf)
    heads = []
    for head, label in (("conversion", "label"), ("click", "label_click")):
        model = scoring.train_baseline(train, label, weight="sample_weight")
        y, w = F.col(label), F.col("sample_weight")
        loss = F.sum(-w * F.log(F.when(y == 1, F.col("prob")).otherwise(1 - F.col("prob")))) / F.sum(w)
        rate = F.sum(w * y) / F.sum(w)
        constant = -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))
        learned = scoring.score(model, train).agg((loss < constant).alias("learned")).first().learned
        heads.append(
            scoring.score(model, valid).agg(
                F.lit(head).alias("head"),
                F.count(F.lit(1)).alias("n"),
                F.sum(y).alias("n_pos"),
                F.bool_and(F.coalesce(F.col("prob").between(0.0, 1.0), F.lit(False))).alias("in_range"),
                F.lit(bool(learned)).alias("learned"),
            )
        )
    return heads[0].unionByName(heads[1])


@query(
    "score",
    _VALID + " SELECT CAST(user_id AS VARCHAR) AS user_id, true AS in_range FROM valid GROUP BY 1",
)
def _(spark, sf):
    train, valid = _parts(spark, sf)
    scored_rows = scoring.score(scoring.train_baseline(train, "label", weight="sample_weight"), valid)
    return scoring.last_predictions(scored_rows, "prob").select(
        "user_id", F.coalesce(F.col("prob").between(0.0, 1.0), F.lit(False)).alias("in_range")
    )


# Labels that two ids explain: user_int_feats_1 is 0 to 6, item_int_feats_12 is 0 to 9.
_CLICK = "user_int_feats_1 + item_int_feats_12 >= 9"
_PLANTED = with_base(
    f""", n AS (SELECT count(*) AS n FROM impressions),
cut AS (SELECT "timestamp" AS c FROM (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS r FROM impressions), n
  WHERE r = n - greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT))),
valid AS (SELECT ({_CLICK})::INT AS click, ({_CLICK} AND item_int_feats_12 >= 7)::INT AS conversion FROM impressions, cut WHERE "timestamp" >= c),
heads AS (SELECT 'click' AS head, click AS y FROM valid UNION ALL SELECT 'conversion', conversion FROM valid)"""
)


def _planted(spark, sf):
    table = rows(spark, sf)
    ids = ["user_int_feats_1", "user_int_feats_2", "item_int_feats_11", "item_int_feats_12"]
    named = [F.when(F.col(c).isNotNull(), F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c in ids]
    click = F.expr(_CLICK)
    planted = table.select(
        "event_id",
        "timestamp",
        F.array_compact(F.array(*named)).alias("tokens"),
        F.col("user_dense_feats_61").alias("dense"),
        click.cast("int").alias("click"),
        (click & (F.col("item_int_feats_12") >= 7)).cast("int").alias("conversion"),
    )
    stored = materialize(planted)
    cutoff = splits.row_cutoff(stored, 0.1)
    return stored.where(F.col("timestamp") < cutoff), stored.where(F.col("timestamp") >= cutoff)


def _ranking(scored_rows, head):
    found = metrics.auc(scored_rows.select(F.col(head).alias("label"), F.col(f"{head}_logit").alias("logit")))
    return found.select(F.lit(head).alias("head"), "n", "n_pos", (F.col("auc") >= 0.95).alias("ranked"))


@query("joint_heads", _PLANTED + " SELECT head, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, true AS ranked, true AS learned FROM heads GROUP BY 1")
def _(spark, sf):
    """One fit of both heads on labels that two ids explain; ``ranked``: an AUC of 0.95 or more on later rows, ``learned``: a loss below that of both constant rates."""
    train, valid = _planted(spark, sf)
    model = joint.fit_heads(joint.hashed_rows(train, ["click", "conversion"], 1 << 12), 1 << 12, (1.0, 2.0), most_steps=25)
    rates = train.agg(F.avg("click"), F.avg("conversion")).first()
    constant = sum(weight * -(p * math.log(p) + (1 - p) * math.log(1 - p)) for weight, p in zip((1.0, 2.0), rates))
    scored_rows = materialize(joint.score_heads(valid, model, ["click_logit", "conversion_logit"]))
    both = _ranking(scored_rows, "click").unionByName(_ranking(scored_rows, "conversion"))
    return both.withColumn("learned", F.lit(bool(model.loss < constant)))


@query("baseline_ranks", _PLANTED + " SELECT head, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, true AS ranked FROM heads WHERE head = 'click' GROUP BY 1")
def _(spark, sf):
    """The linear baseline on the same planted label."""
    train, valid = _planted(spark, sf)
    found = scoring.score(scoring.train_baseline(train, "click"), valid, "click_logit")
    return _ranking(materialize(found), "click")
