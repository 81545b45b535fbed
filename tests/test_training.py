"""The model-ready table and the plan files that go with it."""

import pytest
from pyspark.sql import functions as F

from tallyrow.catalog.base import HISTORY_COLUMNS, PLAN
from tallyrow.operators import blocks, history, ordered, weights
from tallyrow.operators.training import HistoryOptions, TableOptions, training_table
from tallyrow.plans import fixed
from tallyrow.session import materialize
from tallyrow.sources.event_log import impressions_with_sequences
from tallyrow.sources.tables import read_plan, write_plan


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return materialize(impressions_with_sequences(spark, sf_dir))


def test_layout_covers_the_vector_and_history_sits_where_it_says(spark, table):
    store = history.history_build(table, HISTORY_COLUMNS)
    options = TableOptions(
        routed_user=[1, 2],
        routed_item=[12],
        count_features=True,
        seq_stats=True,
        history=HistoryOptions(store, HISTORY_COLUMNS),
        time_of_day=True,
        local_time=True,
        local_time_v2=(19751, 19750),
        hour_only=True,
    )
    got, layout = training_table(table, PLAN, "event_id", options)
    sizes = {fid: (offset, length) for fid, offset, length in layout}
    assert [length for _, _, length in layout] == [3, 1, 2, 8, 6, 5, 10, 14, 2, 3]
    assert got.where(F.size("user_dense") != sum(length for _, _, length in layout)).count() == 0
    offset, length = sizes[fixed.HISTORY_FID]
    # ids that the plan does not know (item_int_feats_11 goes up to 100 at a vocab of 90) have no history of their own
    known = table.withColumns({c: F.when(F.col(c) < v, F.col(c)).otherwise(0) for c, v in (("item_int_feats_11", 90), ("item_int_feats_12", 10))})
    assert table.where("item_int_feats_11 >= 90").count() > 0
    looked = history.history_lookup(known, store, HISTORY_COLUMNS).select(
        "event_id", F.array(*history.history_columns([11, 12])).alias("want")
    )
    both = got.join(looked, "event_id").select(F.slice("user_dense", offset + 1, length).alias("have"), "want")
    assert both.where("have != want").count() == 0


def test_masked_positions_are_blank_in_all_columns(spark, table):
    options = TableOptions(mask_probability=0.4, mask_domains=["a"], mask_seed=9)
    plain, _ = training_table(table, PLAN, "event_id")
    masked, _ = training_table(table, PLAN, "event_id", options)
    pairs = plain.join(masked.select("event_id", *[F.col(c).alias(f"m_{c}") for c in masked.columns[1:]]), "event_id")
    rows = pairs.select(
        "seq_a_len", "m_seq_a_len", "domain_a_seq_40", "m_domain_a_seq_40", "m_seq_a_time_bucket", "seq_b_time_bucket", "m_seq_b_time_bucket"
    ).collect()
    dropped = 0
    for row in rows:
        assert row.seq_a_len == row.m_seq_a_len and row.seq_b_time_bucket == row.m_seq_b_time_bucket
        for before, after, bucket in zip(row.domain_a_seq_40, row.m_domain_a_seq_40, row.m_seq_a_time_bucket):
            assert after in (0, before)
            if bucket == 0:
                assert after == 0
                dropped += 1
    assert dropped > 100


def test_unlabelled_table_and_disabled_lists(spark, table):
    unlabelled = table.drop("label_type")
    got, _ = training_table(unlabelled, PLAN, "event_id", TableOptions(disabled_seq=[40]), labelled=False)
    assert got.agg(F.max("label"), F.max("label_click"), F.max("label_type_raw")).first() == (0, 0, 0)
    assert got.where(F.exists("domain_a_seq_40", lambda x: x != 0)).count() == 0
    assert got.agg(F.max("seq_a_len")).first()[0] == 8


def test_rows_stay_local_without_history(spark, table):
    got, _ = training_table(
        table, PLAN, "event_id", TableOptions(count_features=True, time_of_day=True), weights.hours(F.col("timestamp"), 9, 14, 2.0)
    )
    assert "sample_weight" in got.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_fitted_edges_travel_with_the_plan(spark, tmp_path):
    edges = {"seq_a": list(range(5, 68))}
    write_plan(spark, PLAN, str(tmp_path / "plan"), edges)
    plan, found = read_plan(spark, str(tmp_path / "plan"), {d.name: d.max_len for d in PLAN.domains})
    assert plan == PLAN and found == edges
    write_plan(spark, PLAN, str(tmp_path / "bare"))
    assert read_plan(spark, str(tmp_path / "bare"))[1] is None


def test_rows_without_a_time_or_block_stay(spark, table):
    store = history.history_build(table, HISTORY_COLUMNS)
    holes = table.withColumn("timestamp", F.when(F.col("event_id") % 10 != 0, F.col("timestamp")))
    looked = history.history_lookup(holes, store, HISTORY_COLUMNS, prior=0.25)
    assert looked.count() == table.count()
    assert looked.where("timestamp is null and (hist_rate <> 0.25 or hist_log_count <> 0)").count() == 0

    roles = spark.createDataFrame([(None, "train"), (1, "valid")], "block bigint, role string")
    rows = spark.createDataFrame([(None,), (1,), (1,), (None,)], "b bigint")
    assert blocks.with_block_role(rows, "b", roles).where("role is not null").count() == 4
    assert blocks.rows_of_blocks(rows, "b", roles).count() == 4

    events = spark.createDataFrame([(None, 5, 1), (None, 70, 2), (3, None, 3), (3, 1, 4)], "k bigint, t bigint, e bigint")
    numbered = ordered.number_rows(events, "k", "t", ["e"], "pos")
    assert sorted(map(tuple, numbered.select("e", "pos").collect())) == [(1, 1), (2, 2), (3, 1), (4, 2)]


def test_fit_deals_out_its_vectors_by_rows(spark, tmp_path, monkeypatch):
    """Rows that are much smaller in their file than as vectors, all in one split."""
    from tallyrow.operators import scoring

    monkeypatch.setattr(scoring, "TASK_ROWS", 100)
    tokens = F.array(*[F.concat(F.lit(f"t{i}="), (F.col("id") % (i + 2)).cast("string")) for i in range(5)])
    spark.range(4000).select(tokens.alias("tokens"), F.array(F.col("id") % 3 * 1.0).alias("dense"), (F.col("id") % 2).cast("int").alias("y")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sizes, fit = [], scoring.LogisticRegression.fit

    def seen(self, vectors):
        sizes.extend(vectors.groupBy(F.spark_partition_id()).count().toPandas()["count"])
        return fit(self, vectors)

    monkeypatch.setattr(scoring.LogisticRegression, "fit", seen)
    model = scoring.train_baseline(df, "y")
    assert sum(sizes) == 4000 and len(sizes) == 40 and max(sizes) <= 150
    found = scoring.score(model, df).agg(F.corr("y", "prob").alias("r"), F.count(F.lit(1)).alias("n")).first()
    assert found.n == 4000 and found.r > 0.9
