"""Rules over the validation log."""

from __future__ import annotations

from tallyrow.catalog.base import query, rounded, with_runs
from tallyrow.operators import runlog
from tallyrow.sources.event_log import runs

_PREV = """, p AS (SELECT *, max(val_auc) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  min(val_logloss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM runs)"""


@query(
    "best_step",
    with_runs(
        _PREV
        + """ SELECT run_id, step, round(val_auc, 6) AS val_auc, round(greatest(val_auc, coalesce(prev, val_auc)), 6) AS best_so_far,
  prev IS NULL OR val_auc > prev AS is_best FROM p"""
    ),
)
def _(spark, sf):
    report = runlog.best_step(runs(spark, sf)).select("run_id", "step", "val_auc", "best_so_far", "is_best")
    return rounded(report, "val_auc", "best_so_far")


@query(
    "early_stop_step",
    with_runs(
        _PREV
        + """, l AS (SELECT *, max(CASE WHEN prev IS NULL OR val_auc > prev THEN step END) OVER (PARTITION BY run_id ORDER BY step) AS last_best FROM p)
SELECT run_id, min(CASE WHEN step - last_best >= 5 THEN step END) AS stop_step FROM l GROUP BY 1"""
    ),
)
def _(spark, sf):
    return runlog.early_stop_step(runs(spark, sf), patience=5)


def _recurrence(metric: str, better: str) -> str:
    """Early stopping step by step, as a recursive query."""
    return with_runs(
        f""", m AS MATERIALIZED (SELECT run_id, step, {metric} AS x FROM runs),
e AS (SELECT run_id, step, x AS best, step AS moved FROM m WHERE step = 1
  UNION ALL SELECT m.run_id, m.step, CASE WHEN {better} THEN x ELSE best END, CASE WHEN {better} THEN m.step ELSE moved END
  FROM e JOIN m ON m.run_id = e.run_id AND m.step = e.step + 1)
SELECT run_id, min(CASE WHEN step - moved >= 5 THEN step END) AS stop_step FROM e GROUP BY 1"""
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("early_stop_delta", _recurrence("val_auc", "x > best + 0.01::DOUBLE"))
def _(spark, sf):
    return runlog.early_stop_step(runs(spark, sf), patience=5, delta=0.01)


@query("early_stop_min", _recurrence("val_logloss", "x < best - 0.005::DOUBLE"))
def _(spark, sf):
    return runlog.early_stop_step(runs(spark, sf), "val_logloss", 5, 0.005, "min")


@query(
    "logloss_rebound",
    with_runs(
        _PREV
        + """, b AS (SELECT run_id, step, coalesce(val_logloss > low + 0.005::DOUBLE, false) AS rebound FROM p),
i AS (SELECT *, step - coalesce(max(CASE WHEN NOT rebound THEN step END) OVER (PARTITION BY run_id ORDER BY step), 0) AS streak FROM b)
SELECT run_id, step, rebound, streak, streak >= 3 AS tripped FROM i"""
    ),
)
def _(spark, sf):
    report = runlog.logloss_rebound(runs(spark, sf), 0.005, 3)
    return report.select("run_id", "step", "rebound", "streak", "tripped")


@query(
    "topk_steps",
    with_runs(
        """, r AS (SELECT run_id, step, round(val_auc, 6) AS val_auc, row_number() OVER (PARTITION BY run_id ORDER BY val_auc DESC, step) AS step_rank FROM runs)
SELECT * FROM r WHERE step_rank <= 3"""
    ),
)
def _(spark, sf):
    return rounded(runlog.topk_steps(runs(spark, sf), 3), "val_auc").select("run_id", "step", "val_auc", "step_rank")


@query(
    "aux_select",
    with_runs(
        _PREV
        + """, n AS (SELECT *, 0.5 * val_auc + 0.5 * aux_auc AS mix FROM p WHERE val_auc >= greatest(val_auc, coalesce(prev, val_auc)) - 0.0008::DOUBLE)
SELECT run_id, arg_max(step, (aux_auc, -step)) AS aux_step, round(max(aux_auc), 6) AS aux_score,
  arg_max(step, (mix, -step)) AS blend_step, round(max(mix), 6) AS blend_score FROM n GROUP BY 1"""
    ),
)
def _(spark, sf):
    return rounded(runlog.aux_select(runs(spark, sf)), "aux_score", "blend_score")


@query(
    "average_candidates",
    with_runs(
        """, b AS (SELECT *, max(val_auc) OVER (PARTITION BY run_id) AS best FROM runs),
r AS (SELECT run_id, step, val_auc, row_number() OVER (PARTITION BY run_id ORDER BY val_auc DESC, step) AS candidate_rank
  FROM b WHERE val_auc >= best - 0.001::DOUBLE),
k AS (SELECT *, max(candidate_rank) OVER (PARTITION BY run_id) AS m FROM r WHERE candidate_rank <= 4)
SELECT run_id, step, round(val_auc, 6) AS val_auc, candidate_rank FROM k WHERE m >= 2"""
    ),
)
def _(spark, sf):
    report = runlog.average_candidates(runs(spark, sf))
    return rounded(report, "val_auc").select("run_id", "step", "val_auc", "candidate_rank")
