"""Operators against brute force, with settings small enough to cross every internal border."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrow.operators import assemble, blocks, history, metrics, ordered, pairs, profile, runlog, schema, scoring, splits, weights
from tallyrow.operators.ordered import number_rows, preceding_lists, running, top_per_key
from tallyrow.operators.ranks import exact_quantiles, narrow_quantiles, select_ranks
from tallyrow.operators.windows import scoreboard_decision, window_scoreboard
from tallyrow.plans.features import FeaturePlan, IntFeature, SequenceDomain
from tallyrow.plans.fixed import TIME_BUCKET_EDGES
from tallyrow.plans.windows import TimeWindow, audit_windows, checked_windows, local_epoch
from tallyrow.sources.event_log import impressions
from tallyrow.sources.tables import scan_columns, scan_impressions


def skewed(spark, n=3000, seed=1):
    """A third of the rows share one key; values repeat, are negative and have long tails."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "k": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n)),
            "t": rng.integers(0, 400_000, n),
            "v": np.where(rng.random(n) < 0.4, 7, (rng.standard_cauchy(n) * 100).astype(int)),
            "x": rng.normal(size=n).round(2),
        }
    )
    return pdf, spark.createDataFrame(pdf)


# --- order ----------------------------------------------------------------------------------


def test_number_rows_equals_rank(spark):
    pdf, df = skewed(spark)
    got = number_rows(df, "k", "t", ["id"], "n", slot_sec=5000).toPandas().set_index("id").n.sort_index()
    want = pdf.sort_values(["t", "id"]).groupby("k").cumcount().sort_index() + 1
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize("chunk", [8, 13, 1 << 16])
def test_preceding_lists_cross_chunks(spark, chunk):
    pdf, df = skewed(spark, 600)
    even = F.when(F.col("v") % 2 == 0, F.col("v"))
    got = preceding_lists(df, "k", "t", ["id"], {"l": even}, 8, chunk).toPandas().set_index("id").l.sort_index()
    want = {}
    for _, g in pdf.sort_values(["t", "id"]).groupby("k"):
        vs = g.v.tolist()
        for i, row_id in enumerate(g.id):
            want[row_id] = [v for v in vs[max(0, i - 8) : i] if v % 2 == 0]
    assert [list(x) for x in got] == [want[i] for i in range(600)]


def test_preceding_lists_needs_room(spark):
    _, df = skewed(spark, 10)
    with pytest.raises(ValueError):
        preceding_lists(df, "k", "t", ["id"], {"l": F.col("v")}, 8, 4)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("kind", ["max", "min", "sum"])
def test_running_equals_cumulative(spark, inclusive, kind):
    pdf, df = skewed(spark, 900)
    numbered = number_rows(df, "k", "t", ["id"], "n")
    got = running(numbered, "k", "n", {"r": (kind, F.col("v"))}, inclusive, 7).toPandas().set_index("id").r.sort_index()
    ordered = pdf.sort_values(["t", "id"])
    grouped = ordered.groupby("k").v
    want = {"max": grouped.cummax, "min": grouped.cummin, "sum": grouped.cumsum}[kind]()
    if not inclusive:
        want = want.groupby(ordered.k).shift(1)
    want = want.sort_index()
    assert got.fillna(-9e9).tolist() == want.fillna(-9e9).tolist()


def test_top_per_key_with_hot_key(spark):
    pdf, df = skewed(spark)
    got = top_per_key(df, ["k"], [F.desc("v"), F.asc("id")], 5, ["id"], "r", salts=4).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("k").head(5)
    assert sorted(got.id) == sorted(want.id)
    assert got.r.max() == 5


# --- ranks ------------------------------------------------------------------------------------


@pytest.mark.parametrize("cuts", [4, 16, 256])
@pytest.mark.parametrize("column", ["v", "x"])
def test_exact_quantiles_equal_numpy(spark, cuts, column):
    pdf, df = skewed(spark)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    rows = exact_quantiles(df, ["k"], column, shares, cuts).collect()
    assert len(rows) == pdf.k.nunique()
    for row in rows:
        values = pdf[pdf.k == row.k][column]
        assert row.quantiles == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-9)
        assert (row.n, row.min, row.max) == (len(values), values.min(), values.max())


def test_narrow_quantiles_equal_numpy(spark):
    pdf, df = skewed(spark)
    for row in narrow_quantiles(df, ["k"], "v", [0.1, 0.5, 0.95]).collect():
        values = pdf[pdf.k == row.k].v
        assert row.quantiles == pytest.approx(np.quantile(values, [0.1, 0.5, 0.95]).tolist())
        assert row["mean"] == pytest.approx(values.mean())


def test_select_ranks_ignores_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "v bigint")
    row = select_ranks(df, [], "v", lambda n: F.array(F.lit(0), n - 1)).first()
    assert row.picked == [1, 3] and row.n == 2
    assert select_ranks(df.where("v > 9"), [], "v", lambda n: F.array(F.lit(0))).first() is None


# --- splits -------------------------------------------------------------------------------------


def test_row_cutoff_is_the_order_statistic(spark):
    pdf, df = skewed(spark)
    cut = splits.row_cutoff(df, 0.05, "t")
    assert cut == np.sort(pdf.t)[len(pdf) - max(1, int(len(pdf) * 0.05))]


def test_row_gap_cutoffs_and_tie_fallback(spark):
    pdf, df = skewed(spark)
    gap, valid = splits.row_gap_cutoffs(df, 0.1, 0.2, "t")
    ordered = np.sort(pdf.t)
    n_valid, n_gap = int(3000 * 0.1), int(3000 * 0.2)
    assert (gap, valid) == (ordered[3000 - n_valid - n_gap], ordered[3000 - n_valid])
    tied = spark.createDataFrame([(t,) for t in [1, 2, 3, 4] + [5] * 96], "t bigint")
    assert splits.row_gap_cutoffs(tied, 0.1, 0.1, "t") == (4, 5)
    with pytest.raises(ValueError):
        splits.row_gap_cutoffs(spark.createDataFrame([(1,), (2,), (2,), (2,)], "t bigint"), 0.3, 0.3, "t")
    with pytest.raises(ValueError):
        splits.row_gap_cutoffs(df, 0.6, 0.5, "t")


def test_splits_are_disjoint_and_whole(spark, sf_dir):
    table = impressions(spark, sf_dir)
    gap, valid = splits.row_gap_cutoffs(table, 0.1, 0.1)
    roles = table.groupBy(splits.role_by_gap(F.col("timestamp"), gap, valid).alias("r")).count().collect()
    assert {r.r for r in roles} == {"train", "gap", "valid"}
    assert sum(r["count"] for r in roles) == table.count()


@pytest.mark.parametrize(
    "options,want",
    [
        ({"valid_ratio": 0.2}, ((0, 8), (8, 8), (8, 10), (10, 10))),
        ({"valid_ratio": 0.2, "holdout_ratio": 0.1}, ((0, 8), (8, 8), (8, 9), (9, 10))),
        ({"valid_ratio": 0.2, "gap_ratio": 0.2}, ((0, 6), (6, 8), (8, 10), (10, 10))),
        ({"valid_ratio": 0.2, "train_ratio": 0.5}, ((0, 4), (4, 4), (4, 10), (10, 10))),
    ],
)
def test_block_split_plan(options, want):
    split = blocks.plan_block_split(10, **options)
    assert (split.train, split.gap, split.valid, split.holdout) == want


def test_block_split_errors():
    for bad in ({"holdout_ratio": 1.0}, {"valid_ratio": 0.5, "gap_ratio": 0.5}, {"train_ratio": 0.0}):
        with pytest.raises(ValueError):
            blocks.plan_block_split(4, **bad)


def test_sample_ranks_equal_linspace():
    for n, k in [(10, 8), (1044, 8), (5, 8), (7, 1), (100, 3)]:
        want = np.linspace(0, n - 1, num=min(k, n)).astype(np.int64).tolist()
        assert blocks.sample_ranks(n, k) == want


def test_file_blocks(spark, tmp_path):
    spark.range(100).selectExpr("id AS timestamp").repartition(4).write.parquet(str(tmp_path / "t"))
    table = blocks.with_file_block(scan_impressions(spark, str(tmp_path / "t")))
    catalog = blocks.block_catalog(table, "block").collect()
    assert len(catalog) == 4 and sum(r.n_rows for r in catalog) == 100


def test_fixed_split_checks():
    with pytest.raises(ValueError):
        splits.FixedSplit(10, 20, train_max=11)
    with pytest.raises(ValueError):
        splits.FixedSplit(20, 20)
    with pytest.raises(ValueError):
        splits.FixedSplit(10, 20, train_min=10)
    assert splits.FixedSplit(10, 20).train_end == 10


def test_window_names_are_checked():
    assert checked_windows([TimeWindow(" a b ", 0, 1)])[0].name == "a_b"
    for bad in ([TimeWindow("a", 1, 1)], [TimeWindow("a", 0, 1), TimeWindow("a", 2, 3)], [TimeWindow(" ", 0, 1)]):
        with pytest.raises(ValueError):
            checked_windows(bad)


def test_filter_time_is_half_open(spark):
    df = spark.range(5).selectExpr("id AS timestamp")
    assert [r[0] for r in splits.filter_time(df, 1, 3).collect()] == [1, 2]
    assert splits.filter_time(df, None, 2).count() == 2 and splits.filter_time(df).count() == 5
    with pytest.raises(ValueError):
        splits.filter_time(df, 3, 3)


# --- history --------------------------------------------------------------------------------------


def _brute_history(pdf, mode, cutoff, bin_sec, strength):
    when = pdf.timestamp.copy()
    if mode == "available":
        known = np.maximum(np.where(pdf.label_time.fillna(0) > 0, pdf.label_time, pdf.timestamp), pdf.timestamp)
        when = np.where(pdf.label_type == 2, known, pdf.timestamp + 86400)
    end = (when // bin_sec + 1) * bin_sec - 1
    positive = (pdf.label_type == 2).astype(int)
    prior = positive.mean()
    out = []
    for row in pdf.itertuples():
        seen = end <= row.timestamp - cutoff
        count, pos = seen.sum(), positive[seen].sum()
        overall = pos / count if count else prior
        values = [overall, math.log1p(count)]
        for column in ("a", "b"):
            value = getattr(row, column)
            match = seen & (pdf[column] == value) & (value > 0)
            c, p = match.sum(), positive[match].sum()
            values += [(p + strength * overall) / (c + strength) if c else overall, math.log1p(c)]
        out.append(values)
    return np.array(out)


@pytest.mark.parametrize("mode,cutoff", [("timestamp_cutoff", 7200), ("timestamp_cutoff", 0), ("available", 0), ("available", 600)])
def test_history_lookup_equals_brute_force(spark, mode, cutoff):
    rng = np.random.default_rng(5)
    n = 400
    ts = rng.integers(1_000_000, 1_300_000, n)
    label = rng.choice([0, 1, 2], n, p=[0.5, 0.2, 0.3])
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "timestamp": ts,
            "label_type": label,
            "label_time": np.where(rng.random(n) < 0.5, ts + rng.integers(-5000, 90_000, n), 0),
            "a": np.where(rng.random(n) < 0.35, 1, rng.integers(-1, 12, n)),
            "b": rng.integers(0, 3, n),
        }
    )
    df = spark.createDataFrame(pdf)
    columns = {1: "a", 2: "b"}
    store = history.history_build(df, columns, mode, bin_sec=900)
    got = history.history_lookup(df, store, columns, cutoff, 20.0, bin_sec=900).toPandas().sort_values("id")
    want = _brute_history(pdf, mode, cutoff, 900, 20.0)
    assert len(got) == n
    np.testing.assert_allclose(got[history.history_columns([1, 2])].to_numpy(), want, atol=1e-9)


def test_history_build_arguments(spark):
    df = spark.createDataFrame([(1, 2, 0, 5)], "timestamp bigint, label_type int, label_time bigint, a bigint")
    for bad in ({"mode": "x"}, {"bin_sec": 0}, {"maturity": -1}):
        with pytest.raises(ValueError):
            history.history_build(df, {1: "a"}, **bad)
    with pytest.raises(ValueError):
        history.history_build(df, {})
    assert history.history_build(df, {1: "a"}, ts_min=2).count() == 0


def test_history_stream_resumes_and_equals_batch(spark, tmp_path):
    from tallyrow.streaming.history import history_stream

    rows = [(t, 2 if t % 5 == 0 else 0, 0, t % 3) for t in range(0, 20_000, 50)]
    df = spark.createDataFrame(rows, "timestamp bigint, label_type int, label_time bigint, a bigint")
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    args = (spark, source, df.schema, sink, state, {1: "a"}, 1000, 0, 0)
    df.where("timestamp < 9000").coalesce(1).write.parquet(source)
    first = history_stream(*args).count()
    df.where("timestamp >= 9000").coalesce(1).write.mode("append").parquet(source)
    got = history_stream(*args)
    when = history.available_time(F.col("timestamp"), F.col("label_type"), F.col("label_time"), 0)
    batch = history.history_bins(df, {1: "a"}, when, 1000).where("(bin + 1) * 1000 <= 19950")
    assert 0 < first < got.count()
    columns = ["fid", "value", "bin", "cnt", "pos"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


# --- metrics ---------------------------------------------------------------------------------------


def _auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    if not len(pos) or not len(neg):
        return None
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("cuts", [2, 16, 256])
def test_auc_equals_pair_counting(spark, cuts):
    pdf, _ = skewed(spark, 1500)
    pdf["label"] = (np.random.default_rng(2).random(1500) < 0.3).astype(int)
    pdf.loc[pdf.k == 3, "label"] = 1
    df = spark.createDataFrame(pdf).withColumnRenamed("x", "logit")
    got = {r.k: r.auc for r in metrics.auc(df, ["k"], one_class=None, cuts=cuts).collect()}
    for k, g in pdf.groupby("k"):
        want = _auc(g.label.to_numpy(), g.x.to_numpy())
        assert got[k] is None if want is None else got[k] == pytest.approx(want, abs=1e-12)
    overall = metrics.auc(df, cuts=cuts).first()
    assert overall.auc == pytest.approx(_auc(pdf.label.to_numpy(), pdf.x.to_numpy()), abs=1e-12)


def test_auc_degenerate_and_nan(spark):
    df = spark.createDataFrame([(1, 0.5), (1, float("nan")), (0, float("nan"))], "label bigint, logit double")
    row = metrics.auc(df).first()
    assert (row.n, row.auc) == (1, 0.0)
    empty = metrics.logloss(df.where("label > 1")).first()
    assert empty.n == 0 and math.isinf(empty.logloss)


def test_losses_by_hand(spark):
    df = spark.createDataFrame([(1, 2.0, 1, 0.1), (0, -1.0, 2, 0.2), (0, 0.5, 3, 0.2)], "label bigint, logit double, event_id bigint, w double")
    x, y = np.array([2.0, -1.0, 0.5]), np.array([1, 0, 0])
    bce = np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))
    p = 1 / (1 + np.exp(-x))
    pt, at = np.where(y == 1, p, 1 - p), np.where(y == 1, 0.1, 0.9)
    assert metrics.mean_bce(df).first().loss == pytest.approx(bce.mean())
    assert metrics.focal_loss(df).first().loss == pytest.approx((at * (1 - pt) ** 2 * bce).mean())
    weight = np.array([0.1, 0.2, 0.2])
    assert metrics.weighted_bce(df, "w").first().loss == pytest.approx((weight * bce).sum())
    bpr = np.log1p(np.exp(-(2.0 - np.array([-1.0, 0.5]) - 0.25))).mean()
    assert metrics.bpr_loss(df, F.lit(0), 0.25).first().loss == pytest.approx(bpr)
    assert metrics.combined_auc_loss(df, metrics.pair_batches(df, "event_id"), 0.4, 0.25).first().loss == pytest.approx(0.6 * bce.mean() + 0.4 * bpr)
    assert metrics.bpr_loss(df.where("label = 1"), F.lit(0)).first().loss == 0.0
    with pytest.raises(ValueError):
        metrics.combined_auc_loss(df, F.lit(0), 1.5)


def test_slices_skip_single_values(spark):
    df = spark.createDataFrame([(i % 2, float(i), 4, i % 3) for i in range(30)], "label bigint, logit double, same bigint, few bigint")
    report = metrics.slice_report(df, ["same", "few"]).collect()
    assert {r.slice for r in report} == {"few"}
    assert sum(r.n for r in report) == 30


# --- run log -------------------------------------------------------------------------------------------


def _early_stop(scores, patience, delta, mode):
    best, waited = None, 0
    for step, score in enumerate(scores, 1):
        if best is None:
            best = score
        elif score > best + delta if mode == "max" else score < best - delta:
            best, waited = score, 0
        else:
            waited += 1
            if waited >= patience:
                return step
    return None


def _runs(spark, seed=4, n_runs=12):
    rng = np.random.default_rng(seed)
    rows = []
    for run in range(n_runs):
        for step in range(1, int(rng.integers(3, 40)) + 1):
            rows.append((run, step, round(float(rng.integers(600, 700)) / 1000, 3), round(float(rng.integers(200, 260)) / 1000, 3), round(float(rng.random()), 3)))
    pdf = pd.DataFrame(rows, columns=["run_id", "step", "val_auc", "val_logloss", "aux_auc"])
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("delta", [0.0, 0.01, 0.05])
@pytest.mark.parametrize("mode", ["max", "min"])
def test_early_stop_equals_recurrence(spark, delta, mode):
    pdf, df = _runs(spark)
    got = {r.run_id: r.stop_step for r in runlog.early_stop_step(df, "val_auc", 4, delta, mode, chunk_rows=5).collect()}
    for run, g in pdf.groupby("run_id"):
        assert got[run] == _early_stop(g.val_auc.tolist(), 4, delta, mode)


def test_rebound_streaks(spark):
    pdf, df = _runs(spark)
    got = runlog.logloss_rebound(df, 0.01, 2, chunk_rows=4).toPandas().sort_values(["run_id", "step"])
    for run, g in pdf.groupby("run_id"):
        low, streak, want = None, 0, []
        for loss in g.val_logloss:
            streak = streak + 1 if low is not None and loss > low + 0.01 else 0
            low = loss if low is None else min(low, loss)
            want.append((streak, streak >= 2))
        mine = got[got.run_id == run]
        assert list(zip(mine.streak, mine.tripped)) == want


def test_best_and_aux_selection(spark):
    pdf, df = _runs(spark)
    best = runlog.best_step(df, chunk_rows=3).toPandas().sort_values(["run_id", "step"])
    assert best.best_so_far.tolist() == pdf.groupby("run_id").val_auc.cummax().tolist()
    chosen = {r.run_id: r for r in runlog.aux_select(df, 0.02, 0.25, chunk_rows=3).collect()}
    for run, g in pdf.groupby("run_id"):
        near = g[g.val_auc >= g.val_auc.cummax() - 0.02]
        mix = 0.75 * near.val_auc + 0.25 * near.aux_auc
        assert chosen[run].aux_step == near.step[near.aux_auc.idxmax()]
        assert chosen[run].blend_step == near.step[mix.idxmax()]


def test_average_candidates_need_company(spark):
    rows = [(1, 1, 0.70), (1, 2, 0.7005), (1, 2, 0.7002), (1, 3, 0.69), (2, 1, 0.8), (2, 2, 0.7)]
    df = spark.createDataFrame(rows, "run_id bigint, step bigint, val_auc double")
    got = sorted((r.run_id, r.step, r.candidate_rank) for r in runlog.average_candidates(df).collect())
    assert got == [(1, 1, 2), (1, 2, 1)]


# --- schema, codes, pairs ---------------------------------------------------------------------------


def test_schema_of_small_table(spark):
    rows = [
        ([1_700_000_000, 5], [3, 0], 4, [0.5, 1.0], None),
        ([1_700_000_100], [9], -1, [], [7, 8, 300]),
        (None, None, None, None, []),
    ]
    df = spark.createDataFrame(
        rows,
        "domain_a_seq_39 array<bigint>, domain_a_seq_40 array<bigint>, user_int_feats_1 bigint, "
        "user_dense_feats_61 array<double>, item_int_feats_7 array<bigint>",
    )
    plan = schema.infer_plan(df)
    assert plan.user_int == (IntFeature("user_int", 1, 5, 1),)
    assert plan.item_int == (IntFeature("item_int", 7, 301, 3),)
    assert [(f.fid, f.dim) for f in plan.user_dense] == [(61, 2)]
    domain = plan.domains[0]
    assert (domain.name, domain.ts_fid, domain.side_fids) == ("seq_a", 39, [40])
    assert FeaturePlan.from_dict(json.loads(json.dumps(plan.to_dict()))) == plan


@pytest.mark.parametrize("values,late", [([5, 2_000_000_001], True), ([5, 1_999_999_995], False), ([5], False), ([], False)])
def test_timestamp_median_ties(spark, values, late):
    df = spark.createDataFrame([(values,)], "domain_b_seq_1 array<bigint>")
    assert schema.infer_catalog(df).first().is_ts is late


def test_out_of_range_is_reported_and_raised(spark):
    plan = FeaturePlan(user_int=(IntFeature("user_int", 1, 5), IntFeature("user_int", 2, 50)))
    df = spark.createDataFrame([(7, 1), (5, 2), (4, 3), (None, -1)], "user_int_feats_1 bigint, user_int_feats_2 bigint")
    rows = assemble.oob_stats(df, plan).collect()
    assert [(r.column_name, r.oob_count, r.min_oob, r.max_oob, r.vocab) for r in rows] == [("user_int_feats_1", 2, 5, 7, 5)]
    with pytest.raises(ValueError, match="user_int_feats_1"):
        assemble.require_in_range(df, plan)
    assemble.require_in_range(df.where("user_int_feats_1 < 5"), plan)


def test_skipped_fids(spark):
    plan = FeaturePlan(user_int=(IntFeature("user_int", 1, 5), IntFeature("user_int", 3, 5, 2)))
    assert [f.fid for f in assemble.routed_fids(plan)] == [1]
    assert assemble.skipped_fids(plan, [1, 3, 99]) == [3, 99]


def test_code_tables_respect_the_cap(spark):
    df = spark.range(300).selectExpr("id % 4 AS a", "id AS b", "CASE WHEN id > 5 THEN id % 3 END AS c", "id % 64 AS d")
    tables = assemble.code_tables(df, ["a", "b", "c", "d"], 64)
    assert tables == {"a": [0, 1, 2, 3], "c": [0, 1, 2], "d": list(range(64))}


def _cramers(a, b, va, vb):
    table = np.zeros((va, vb))
    np.add.at(table, (a, b), 1)
    n = table.sum()
    expected = table.sum(1, keepdims=True) @ table.sum(0, keepdims=True) / n
    ok = expected > 0
    chi2 = ((table[ok] - expected[ok]) ** 2 / expected[ok]).sum()
    p = table / n
    full = p > 0
    mi = (p[full] * np.log(p[full] / (expected / n)[full])).sum()
    return math.sqrt(chi2 / (n * max(min(va, vb) - 1, 1))), mi


def test_association_equals_definition_and_is_symmetric(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.integers(0, 3, 500), "b": rng.integers(0, 40, 500), "label_type": rng.choice([0, 2], 500)})
    pdf["c"] = (pdf.a * 2 + (rng.random(500) < 0.2)) % 5
    names = {"a": "user_int_feats_1", "b": "user_int_feats_2", "c": "item_int_feats_3"}
    features = [IntFeature("user_int", 1), IntFeature("user_int", 2), IntFeature("item_int", 3)]
    df = spark.createDataFrame(pdf.rename(columns=names))
    found = [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "b")]
    asked = [(names[x], names[y]) for x, y in found]
    short = {v: k for k, v in names.items()}
    got = {(short[r.a], short[r.b]): r for r in pairs.pairwise(df, features, asked, 16, None).collect()}
    codes = {"a": (pdf.a, 3), "c": (pdf.c, 5), "b": (np.where(pdf.b > 0, (pdf.b - 1) % 15 + 1, 0), 16)}
    for pair in found:
        (x, vx), (y, vy) = codes[pair[0]], codes[pair[1]]
        v, mi = _cramers(np.array(x), np.array(y), vx, vy)
        assert got[pair].cramers_v == pytest.approx(v, abs=1e-9) and got[pair].mi == pytest.approx(mi, abs=1e-9)
    assert got["a", "b"].cramers_v == pytest.approx(got["b", "a"].cramers_v)


def test_pair_counts_read_the_codes_once(spark, monkeypatch):
    """46 + 14 columns: 1,035 pairs inside the first, 644 between both; both ways of counting agree."""
    rng = np.random.default_rng(2)
    names = [f"c{i}" for i in range(60)]
    codes = np.minimum(rng.integers(0, 40, (60, 400)), rng.integers(1, 40, (60, 1)))
    df = spark.createDataFrame(pd.DataFrame({n: codes[i] for i, n in enumerate(names)}))
    found = pairs.user_user_pairs(names[:46]) + [(a, b) for a in names[:46] for b in names[46:]]
    assert len(found) == 1035 + 644
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 150)
    counted = pairs.contingency(df, found)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Scan ") == 1
    got = {tuple(r)[:4]: r.n for r in counted.where("a in ('c0', 'c7') or b = 'c59'").collect()}
    want = {}
    for a, b in found:
        if a in ("c0", "c7") or b == "c59":
            for x, y in zip(codes[names.index(a)], codes[names.index(b)]):
                want[a, b, x, y] = want.get((a, b, x, y), 0) + 1
    assert got == want
    few = found[:9]
    assert sorted(pairs.contingency(df, few).collect()) == sorted(pairs.contingency(df, few, folded=False).collect())
    assert pairs.contingency(df.where("c0 < 0"), few).count() == 0 == pairs.contingency(df, []).count()


def test_encoding_clamps_negatives_and_truncates_lists(spark):
    rows = [(-4, [0, 3, 9]), (None, [0, 0, 9]), (5, None), (7, [2, -1])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "user_int_feats_1 bigint, user_int_feats_2 array<bigint>, label_type int")
    coded, sizes, _ = pairs.encoded(df, [IntFeature("user_int", 1), IntFeature("user_int", 2, 10, 2)], 8)
    assert sorted((r[0], r[1]) for r in coded.collect()) == [(0, 0), (0, 0), (1, 0), (2, 1)]  # stored rows have no order
    assert sizes == {"user_int_feats_1": 3, "user_int_feats_2": 2}


def test_association_of_constant_column(spark):
    df = spark.createDataFrame(
        [(1, i % 3, 0) for i in range(9)], "user_int_feats_1 bigint, user_int_feats_2 bigint, label_type int"
    )
    features = [IntFeature("user_int", 1), IntFeature("user_int", 2)]
    row = pairs.pairwise(df, features, [("user_int_feats_1", "user_int_feats_2")], 16).first()
    assert row.cramers_v == 0.0 and row.mi == pytest.approx(0.0)


# --- profile -------------------------------------------------------------------------------------------


def test_log_edges_of_a_narrow_range_count_up():
    assert profile.log_edges(100, 5.5) == list(range(5, 68))


@pytest.mark.parametrize("p99", [1e4, 3e7])
def test_log_edges_grow_by_one_ratio(p99):
    edges = profile.log_edges(100, p99)
    assert len(edges) == 63 and edges[0] == 5 and edges[-1] == round(p99)
    assert all(a < b for a, b in zip(edges, edges[1:]))
    ratio = (p99 / 5) ** (1 / 62)
    assert all(b / a == pytest.approx(ratio, rel=0.01) for a, b in zip(edges, edges[1:]) if a > 200)


def test_log_edges_fall_back():
    assert profile.log_edges(99, 1e6) == TIME_BUCKET_EDGES
    assert profile.log_edges(1000, 5.0) == TIME_BUCKET_EDGES
    assert profile.log_edges(0, None) == TIME_BUCKET_EDGES


def test_fit_fails_loudly_without_differences(spark):
    df = spark.createDataFrame([(5, [0, -1])], "timestamp bigint, domain_a_seq_1 array<bigint>")
    with pytest.raises(ValueError):
        profile.fit_time_edges(df, [SequenceDomain("a", {1: 0}, 1)])


def test_bucket_fit_sample_respects_limits(spark):
    rows = [(i, 10_000 + i, i // 10, [1, 2, 3]) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, timestamp bigint, block bigint, domain_a_seq_1 array<bigint>")
    domain = [SequenceDomain("a", {1: 0}, 1)]
    sample = profile.bucket_fit_sample(df, domain, "block", "id", 4, rows_per_block=5, diffs_per_block=7, diffs_per_domain=20)
    assert sample.count() == 20
    assert profile.bucket_fit_sample(df, domain, "block", "id", 4).count() == 4 * 10 * 3


def test_bucket_fit_sample_takes_all_rows_and_cuts_no_prefix(spark):
    """One block of 120,000 rows, differences growing with the key: the former limits would all have been reached."""
    df = spark.range(120_000).selectExpr("id", "id + 10 AS timestamp", "0 AS block", "array(9L) AS domain_a_seq_1")
    domain = [SequenceDomain("a", {1: 0}, 1)]
    whole = profile.bucket_fit_sample(df, domain, "block", "id")
    assert whole.agg(F.count(F.lit(1)), F.max("diff")).first() == (120_000, 120_000)
    part = profile.bucket_fit_sample(df, domain, "block", "id", rows_per_block=5_000)
    n, mean, top = part.agg(F.count(F.lit(1)), F.avg("diff"), F.max("diff")).first()
    assert n == 5_000 and 57_000 < mean < 63_000 and top > 119_000


def test_exact_codes_agree_with_dense_ones_over_many_passes(spark):
    """66 pairs take two passes; ids themselves and dense codes give the same figures, folding is reported."""
    names = [f"user_int_feats_{i}" for i in range(1, 13)]
    df = spark.range(400).selectExpr(*[f"(id * {i + 3}) % {i + 2} AS {c}" for i, c in enumerate(names)], "2 * (id % 2) AS label_type")
    features, asked = [IntFeature("user_int", i) for i in range(1, 13)], pairs.user_user_pairs(names)
    exact = pairs.pairwise(df, features, asked, None, None).collect()
    dense = {(r.a, r.b): r for r in pairs.pairwise(df, features, asked, 256, None).collect()}
    assert len(exact) == len(dense) == 66
    for r in exact:
        other = dense[r.a, r.b]
        assert (r.v_a, r.v_b, r.n_rows, r.folded) == (other.v_a, other.v_b, 400, False)
        assert r.cramers_v == pytest.approx(other.cramers_v) and r.mi == pytest.approx(other.mi)
    few = pairs.pairwise(df, features, asked, 4, None)
    assert few.where("folded").count() == 66 - 3


def test_whole_numbers_are_counted_once(spark):
    """Quantiles of integers equal those of the same doubles, and come with the distinct count."""
    df = spark.range(5000).selectExpr("id % 3 AS k", "(id * id) % 97 AS v").unionByName(spark.sql("SELECT 1L AS k, CAST(NULL AS BIGINT) AS v"))
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    whole = {r.k: r for r in exact_quantiles(df, ["k"], "v", shares, distinct=True).collect()}
    for r in exact_quantiles(df.withColumn("v", F.col("v").cast("double")), ["k"], "v", shares).collect():
        assert (r.n, r.mean, r.min, r.max, r.quantiles) == (whole[r.k].n, pytest.approx(whole[r.k].mean), whole[r.k].min, whole[r.k].max, whole[r.k].quantiles)
    assert {k: r.n_distinct for k, r in whole.items()} == {r.k: r.d for r in df.groupBy("k").agg(F.countDistinct("v").alias("d")).collect()}
    assert exact_quantiles(df.where("k > 5"), [], "v", shares).collect() == []


def test_pairwise_loss_uses_every_row(spark):
    """Two batches of 2,000 rows; the pairs of a single extreme row shift the mean."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"event_id": range(4000), "label": rng.integers(0, 2, 4000), "logit": rng.normal(size=4000)})
    pdf.loc[3999, ["label", "logit"]] = [1, -5000.0]
    got = metrics.bpr_loss(spark.createDataFrame(pdf), F.col("event_id") % 2, 0.5).first().loss
    want = []
    for _, g in pdf.groupby(pdf.event_id % 2):
        d = g.logit[g.label == 1].to_numpy()[:, None] - g.logit[g.label == 0].to_numpy()[None, :] - 0.5
        want.append((np.maximum(-d, 0) + np.log1p(np.exp(-np.abs(d)))).mean())
    assert got == pytest.approx(np.mean(want))
    sizes = spark.createDataFrame(pdf).groupBy(metrics.pair_batches(spark.createDataFrame(pdf), "event_id", 500)).count()
    assert sizes.count() == 8 and sizes.agg(F.sum("count")).first()[0] == 4000


def test_early_stop_over_a_long_rise(spark):
    """100,000 rising scores in chunks of 30,000; every tenth step is accepted, until the rise ends."""
    df = spark.range(1, 100_101).selectExpr("1 AS run_id", "id AS step", "least(id, 100000) / 8.0D AS val_auc")
    got = {p: runlog.early_stop_step(df, "val_auc", p, 1.2, chunk_rows=30_000).first().stop_step for p in (9, 10, 110)}
    assert got == {9: 10, 10: 100_001, 110: None}


def test_early_stop_rounds_are_few(spark, monkeypatch):
    """A million rising scores, half of which are accepted: the pointers are doubled about twenty times."""
    written = []
    monkeypatch.setattr(runlog, "materialize", lambda df, plain=runlog.materialize: written.append(1) or plain(df))
    df = spark.range(1, 1_000_011).selectExpr("1 AS run_id", "id AS step", "least(id, 1000000) / 8.0D AS val_auc")
    assert runlog.early_stop_step(df, "val_auc", 5, 0.2).first().stop_step == 1_000_004
    assert len(written) < 30


def test_reservoir_sample_is_uniform_and_repeatable(spark):
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END AS k")
    first = profile.reservoir_sample(df, ["k"], 200, "id", seed=3)
    again = profile.reservoir_sample(df.repartition(5), ["k"], 200, "id", seed=3)
    ids = sorted(r.id for r in first.collect())
    assert ids == sorted(r.id for r in again.collect())
    hot = first.where("k = 0").toPandas().id
    assert len(hot) == 200 and 3500 < hot.mean() < 5500
    assert ids != sorted(r.id for r in profile.reservoir_sample(df, ["k"], 200, "id", seed=4).collect())


def test_missing_gap_with_one_sided_columns(spark):
    df = spark.createDataFrame([(1, None, 2), (2, None, 0)], "user_int_feats_1 bigint, user_int_feats_2 bigint, label_type int")
    rows = profile.missing_gap(df, [IntFeature("user_int", 1), IntFeature("user_int", 2)]).collect()
    found = {r.fid: (r.n_null, r.cvr_null, r.cvr_notnull) for r in rows}
    assert found == {1: (0, 0.0, 0.5), 2: (2, 0.5, 0.0)}


def test_scoreboard_keeps_empty_windows(spark):
    rows = [(100 + i, 2 if i % 4 == 0 else None, i, 1, [1] * (i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "timestamp bigint, label_type int, user_id bigint, item_id bigint, domain_a_seq_1 array<bigint>")
    windows = [TimeWindow("clk_a", 100, 110), TimeWindow("pre_b", 105, 120), TimeWindow("clk_none", 900, 950)]
    board = window_scoreboard(df, windows, [SequenceDomain("a", {1: 0}, 1)], {50: 0.5}, {"seq_a": (1.0, 1.0)}, 5)
    rows = {r.window: r for r in board.collect()}
    assert rows["clk_a"].n_rows == 10 and rows["pre_b"].n_rows == 15
    assert rows["clk_none"].n_rows == 0 and math.isinf(rows["clk_none"].oracle_distance) and not rows["clk_none"].viable
    assert rows["clk_a"].time_q_l1 == pytest.approx(abs(0.45 - 0.5))
    decision = scoreboard_decision(board).first()
    assert (decision.viable_windows, decision.best_same_clock, decision.recommend_gate) == (2, "clk_a", False)


def test_audit_windows_names():
    found = audit_windows("2024-01-29 09:00:00", "2024-01-29 10:00:00", ["2024-01-28"])
    assert [w.name for w in found] == ["clk_0128", "pre_all", "pre_60m", "pre_30m"]
    assert found[0].end - found[0].start == 3600
    assert found[1].end == local_epoch("2024-01-29 09:00:00")


# --- weights, sources, scoring -------------------------------------------------------------------------


def test_weights_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (50, 2), (100, None)], "timestamp bigint, label_type int")
    ts = F.col("timestamp")
    mature = weights.mature_negative(ts, F.col("label_type"), 100, 100, 0.5)
    assert [r[0] for r in df.select(mature).collect()] == [1.0, 1.0, 0.5]
    recent = weights.recency(ts, 0, 100, 2.0)
    got = [r[0] for r in df.select(weights.normalised(df, recent)).collect()]
    raw = np.exp([0, 1, 2])
    assert got == pytest.approx((raw / raw.mean()).tolist())
    assert df.select(weights.recency(ts, 5, 5, 2.0)).first()[0] == 1.0
    with pytest.raises(ValueError):
        weights.ts_range(df.where("timestamp > 900"))


def test_scan_errors_and_missing_columns(spark, tmp_path, sf_dir):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        scan_impressions(spark, str(tmp_path / "empty"))
    nested = tmp_path / "deep" / "er"
    spark.range(3).write.parquet(str(nested))
    assert scan_impressions(spark, str(tmp_path / "deep"), recursive=True).count() == 3
    found, absent = scan_columns(scan_impressions(spark, f"{sf_dir}/events.parquet"), ["ts", "nope"])
    assert found.columns == ["ts"] and absent == ["nope"]


def test_last_prediction_and_bounds(spark):
    rows = [("u", 1, 1, 0.2), ("u", 2, 1, float("nan")), ("v", 5, 1, float("inf")), ("v", 5, 0, 0.3), ("w", 1, 1, float("-inf"))]
    df = spark.createDataFrame(rows, "user_id string, timestamp bigint, event_id bigint, p double")
    got = {r.user_id: r.prob for r in scoring.last_predictions(df, "p").collect()}
    assert got == {"u": 0.0, "v": 1.0, "w": 0.0}


@pytest.mark.parametrize("bound, windows", [(4_000_000, 2), (100, 3)])
def test_top_per_key_merges_parts_when_k_is_large(spark, monkeypatch, bound, windows):
    monkeypatch.setattr(ordered, "SECOND_ROUND_ROWS", bound)
    rows = [(None if i % 3 == 0 else i % 2, (i * 7919) % 1009, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, v long, id long")
    top = ordered.top_per_key(df, ["k"], [F.col("v"), F.col("id")], 20, ["id"], rank="r", salts=16)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert sum(" Window [" in line or line.startswith("Window [") for line in plan.splitlines()) == windows
    want = [(k, v, i, r) for key in (None, 0, 1) for r, (k, v, i) in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: x[1:])[:20], 1)]
    assert sorted(map(tuple, top.collect()), key=repr) == sorted(want, key=repr)
