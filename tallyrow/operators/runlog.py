"""Rules over a validation log (run_id, step, val_auc, val_logloss, aux_auc).

Steps are 1-based and consecutive within a run. Everything is built from running extremes,
which are computed in chunks of steps, so a long run does not sit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.functions.search import with_count_below
from tallyrow.operators.ordered import null_safe_join, running, top_per_key
from tallyrow.session import materialize

RUN, STEP = "run_id", "step"


def _leader(runs: DataFrame, score: Column, chunk_rows: int) -> DataFrame:
    """Add ``_lead``: the best score so far and, negated, the first step that reached it."""
    pair = F.struct(score.alias("score"), (-F.col(STEP)).alias("neg_step"))
    return running(runs, RUN, STEP, {"_lead": ("max", pair)}, True, chunk_rows)


def best_step(runs: DataFrame, metric: str = "val_auc", chunk_rows: int = 1 << 16) -> DataFrame:
    """Add ``best_so_far`` (this step included) and ``is_best`` (a strict improvement)."""
    return _leader(runs, F.col(metric), chunk_rows).select(
        *runs.columns,
        F.col("_lead.score").alias("best_so_far"),
        (F.col("_lead.neg_step") == -F.col(STEP)).alias("is_best"),
    )


def _next_accepted(records: DataFrame, delta: float) -> DataFrame:
    """The records (run, at, score, chunk) with ``next``: the first step whose score is more than ``delta`` higher.

    Scores rise from record to record, so a record's next one lies in the first chunk whose top is high enough, and is found there by order.
    """
    tops = records.groupBy(RUN, "chunk").agg(F.max("score").alias("top"))
    ladder = tops.groupBy(RUN).agg(F.sort_array(F.collect_list(F.struct("chunk", "top"))).alias("ladder"))  # one entry a chunk
    ladder = materialize(ladder.select(RUN, F.col("ladder.chunk").alias("chunks"), F.col("ladder.top").alias("tops")))
    longest = ladder.agg(F.max(F.size("tops"))).first()[0] or 1
    aimed = null_safe_join(records, ladder, [RUN]).withColumn("wanted", F.col("score") + F.lit(float(delta)))
    aimed = with_count_below(aimed, "wanted", "tops", 1 << longest.bit_length(), "rung", inclusive=True)
    probes = aimed.select(RUN, F.get("chunks", F.col("rung")).alias("chunk"), F.col("wanted").alias("value"), "at", F.lit(True).alias("probe"))
    line = records.select(RUN, "chunk", F.col("score").alias("value"), "at", F.lit(False).alias("probe")).unionByName(probes.where("chunk is not null"))
    # from above: what comes before a probe is higher than it
    higher = W.partitionBy(RUN, "chunk").orderBy(F.desc("value"), F.desc("probe")).rowsBetween(W.unboundedPreceding, 0)
    found = line.withColumn("next", F.min(F.when(~F.col("probe"), F.col("at"))).over(higher)).where("probe").select(RUN, "at", "next")
    return null_safe_join(records.select(RUN, "at"), found, [RUN, "at"], "left")


def _stop_with_delta(seen: DataFrame, delta: float, patience: int, chunk_rows: int) -> DataFrame:
    """(run, stop_step) where a score counts only if it beats the last accepted one by more than ``delta``.

    Only new maxima can be accepted. Each points to the one that would be accepted next, or to itself if that is more than ``patience``
    steps away; the first step of a run is accepted, and doubling the pointers leads it to the last one before the stop, in as many rounds
    as the logarithm of the number of accepted steps.
    """
    lead = -F.col("_lead.neg_step") == F.col(STEP)
    chunk = F.floor((F.col(STEP) - 1) / chunk_rows).alias("chunk")
    records = materialize(seen.where(lead).select(RUN, F.col(STEP).cast("bigint").alias("at"), F.col("_score").cast("double").alias("score"), chunk))
    chain = materialize(_next_accepted(records, delta))
    ends = F.coalesce(F.col("next") - F.col("at") > patience, F.lit(True))
    chain = chain.withColumn("to", F.when(ends, F.col("at")).otherwise(F.col("next")))
    stops = materialize(chain.where(ends).select(RUN, F.col("at").alias("to"), "next"))
    first = materialize(records.groupBy(RUN).agg(F.min("at").alias("at")))
    pointers = materialize(chain.select(RUN, "at", "to"))
    while True:
        starts = null_safe_join(first, pointers, [RUN, "at"])
        if null_safe_join(starts, stops, [RUN, "to"], "left_anti").isEmpty():
            break
        further = pointers.select(RUN, F.col("at").alias("to"), F.col("to").alias("beyond"))
        pointers = materialize(null_safe_join(pointers, further, [RUN, "to"]).select(RUN, "at", F.col("beyond").alias("to")))
    last = null_safe_join(starts, stops, [RUN, "to"]).select(RUN, (F.col("to") + patience).alias("_stop"), F.col("next").isNotNull().alias("_sure"))
    steps = seen.groupBy(RUN).agg(F.max(STEP).cast("bigint").alias("_steps"))
    reached = F.col("_sure") | (F.col("_stop") <= F.col("_steps"))
    return null_safe_join(steps, last, [RUN], "left").select(RUN, F.when(reached, F.col("_stop")).alias("stop_step"))


def early_stop_step(
    runs: DataFrame,
    metric: str = "val_auc",
    patience: int = 5,
    delta: float = 0.0,
    mode: str = "max",
    chunk_rows: int = 1 << 16,
) -> DataFrame:
    """First step per run with ``patience`` steps in a row without improvement (null: never)."""
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode!r}")
    score = F.col(metric) if mode == "max" else -F.col(metric)
    seen = _leader(runs.withColumn("_score", score), F.col("_score"), chunk_rows)
    if delta > 0:
        return _stop_with_delta(materialize(seen.select(RUN, STEP, "_score", "_lead")), delta, patience, chunk_rows)
    waited = F.col(STEP) + F.col("_lead.neg_step")
    return seen.groupBy(RUN).agg(F.min(F.when(waited >= patience, F.col(STEP))).alias("stop_step"))


def logloss_rebound(
    runs: DataFrame, delta: float = 0.0, patience: int = 1, metric: str = "val_logloss", chunk_rows: int = 1 << 16
) -> DataFrame:
    """Steps whose loss exceeds the lowest earlier one by more than ``delta``.

    ``streak`` counts them in a row; ``tripped`` marks a streak of at least ``patience``.
    """
    if patience <= 0:
        raise ValueError("patience must be positive")
    seen = running(runs, RUN, STEP, {"_low": ("min", F.col(metric))}, False, chunk_rows)
    rebound = F.coalesce(F.col(metric) > F.col("_low") + F.lit(float(delta)), F.lit(False))
    flagged = materialize(seen.select(*runs.columns, rebound.alias("rebound")))
    calm = {"_calm": ("max", F.when(~F.col("rebound"), F.col(STEP)))}
    islands = running(flagged, RUN, STEP, calm, True, chunk_rows)
    streak = F.col(STEP) - F.coalesce("_calm", F.lit(0))
    return islands.select(*runs.columns, "rebound", streak.alias("streak"), (streak >= patience).alias("tripped"))


def topk_steps(runs: DataFrame, k: int = 3) -> DataFrame:
    return top_per_key(runs, [RUN], [F.desc("val_auc"), F.asc(STEP)], k, [STEP], rank="step_rank")


def aux_select(runs: DataFrame, tolerance: float = 0.0008, blend: float = 0.5, chunk_rows: int = 1 << 16) -> DataFrame:
    """Best auxiliary and best blended step among those near the best score so far; earliest on ties."""
    seen = best_step(runs, chunk_rows=chunk_rows).where(
        F.col("val_auc") >= F.col("best_so_far") - F.lit(float(tolerance))
    )
    mixed = F.lit(1.0 - blend) * F.col("val_auc") + F.lit(float(blend)) * F.col("aux_auc")

    def first_best(value: Column) -> Column:
        return F.max(F.struct(value.alias("score"), (-F.col(STEP)).alias("neg_step")))

    picked = seen.groupBy(RUN).agg(first_best(F.col("aux_auc")).alias("a"), first_best(mixed).alias("b"))
    return picked.select(
        RUN,
        (-F.col("a.neg_step")).alias("aux_step"),
        F.col("a.score").alias("aux_score"),
        (-F.col("b.neg_step")).alias("blend_step"),
        F.col("b.score").alias("blend_score"),
    )


def average_candidates(runs: DataFrame, tolerance: float = 0.001, k: int = 4, at_least: int = 2) -> DataFrame:
    """Steps worth averaging: within ``tolerance`` of the run's best, at most ``k``.

    Runs with fewer than ``at_least`` such steps are left out. A repeated step counts once,
    with its best score.
    """
    once = runs.groupBy(RUN, STEP).agg(F.max("val_auc").alias("val_auc"))
    top = top_per_key(once, [RUN], [F.desc("val_auc"), F.asc(STEP)], k, [STEP], rank="candidate_rank")
    # At most k rows per run are left, the best one among them.
    of_run = W.partitionBy(RUN)
    near = top.withColumn("_best", F.max("val_auc").over(of_run)).where(
        F.col("val_auc") >= F.col("_best") - F.lit(float(tolerance))
    )
    return near.withColumn("_n", F.count(F.lit(1)).over(of_run)).where(F.col("_n") >= at_least).drop("_best", "_n")
