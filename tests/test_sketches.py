"""Mergeable summaries and the stored history against exact counts, on skewed tables."""

import os
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrow.operators import history, sketches
from tallyrow.operators.history_store import HistoryStore
from tallyrow.plans.features import SequenceDomain


def frame(spark, pdf, schema):
    """With None for what pandas calls missing."""
    rows = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def clicks(spark, n=4000, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "timestamp": rng.integers(0, 5 * 86400, n),
            "user_id": pd.array(np.where(rng.random(n) < 0.33, 1, rng.integers(1, 2500, n)), dtype="Int64"),
            "item_id": rng.integers(0, 40, n),
        }
    )
    pdf.loc[:20, "user_id"] = None
    return pdf, frame(spark, pdf, "timestamp long, user_id long, item_id long")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_distinct_ids_of_ranges_and_an_added_day(spark, tmp_path):
    pdf, df = clicks(spark)
    path = str(tmp_path / "ids")
    for day in (0, 1, 3):
        sketches.store_days(sketches.daily_ids(df.where(F.floor(F.col("timestamp") / 86400) == day)), path)
    before = files(path)
    late = sketches.daily_ids(df.where("timestamp >= 2 * 86400 and timestamp < 3 * 86400 or timestamp >= 4 * 86400"))
    sketches.store_days(late, path)
    sketches.store_days(late, path)  # the same days again change nothing
    assert before.items() <= files(path).items()
    for first, last in ((0, 4), (1, 2), (4, 4)):
        found = {r.id_column: r.n_estimate for r in sketches.distinct_ids(sketches.stored_days(late, path, first, last)).collect()}
        inside = pdf[(pdf.timestamp // 86400).between(first, last)]
        for column, n in found.items():
            assert abs(n - inside[column].nunique()) <= sketches.distinct_error() * inside[column].nunique() + 1
    plan = sketches.stored_days(late, path, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert sketches.distinct_ids(sketches.stored_days(late, path, 90)).count() == 0


def test_merged_quantiles_keep_their_rank_error(spark, tmp_path):
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(1, 10**6, rng.integers(0, 40))).tolist() for _ in range(2000)]
    pdf = pd.DataFrame({"timestamp": rng.integers(10**6, 10**6 + 4 * 86400, 2000), "domain_a_seq_1": lists})
    df = spark.createDataFrame(pdf)
    domain = SequenceDomain("a", {1: 0, 2: 9}, 1, 8)
    path, like = str(tmp_path / "diffs"), sketches.daily_time_diffs(df, [domain])
    days = sorted(r.day for r in like.select("day").distinct().collect())
    for day in days:
        sketches.store_days(like.where(F.col("day") == day), path)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    for first, last in ((days[0], days[-1]), (days[1], days[1])):
        inside = pdf[(pdf.timestamp // 86400).between(first, last)]
        diffs = np.sort(np.concatenate([t - np.array(s) for t, s in zip(inside.timestamp, inside.domain_a_seq_1)]))
        (r,) = sketches.merged_quantiles(sketches.stored_days(like, path, first, last), ["domain"], shares).collect()
        assert r.n == len(diffs)
        for share, value in zip(shares, r.quantiles):
            low, high = np.searchsorted(diffs, value, "left") / r.n, np.searchsorted(diffs, value, "right") / r.n
            assert low <= share + sketches.KLL_ERROR and high >= share - sketches.KLL_ERROR


@pytest.mark.parametrize("kind", ["steep", "flat", "few"])
def test_heavy_hitters_are_the_exact_ones(spark, kind):
    rng = np.random.default_rng(6)
    items = {"steep": rng.zipf(1.4, 20_000) % 10**6, "flat": rng.integers(0, 9000, 20_000), "few": rng.integers(0, 7, 20_000)}[kind]
    pdf = pd.DataFrame({"k": np.where(rng.random(20_000) < 0.5, "a", None), "item": pd.array(items, dtype="Int64")})
    pdf.loc[:5, "item"] = None
    want = pdf.dropna(subset="item").groupby(["k", "item"], dropna=False).size().rename("freq").reset_index()
    want = want.sort_values(["freq", "item"], ascending=[False, True]).groupby("k", dropna=False).head(10)
    found = sketches.heavy_hitters(frame(spark, pdf, "k string, item long"), ["k"], "item", 10, room=32, most_room=2048).collect()
    clean = lambda k: None if pd.isna(k) else k
    assert sorted((str(r.k), r.item, r.freq) for r in found) == sorted((str(clean(k)), i, f) for k, i, f in want.itertuples(index=False))
    assert sorted(r.item_rank for r in found) == sorted([*range(1, min(10, want.item.nunique() if kind == "few" else 10) + 1)] * 2)


def test_heavy_hitters_without_rows(spark):
    none = spark.createDataFrame([("a", None)], "k string, item long")
    assert sketches.heavy_hitters(none, ["k"], "item", 3).count() == 0


def shuffled_records(spark):
    sc = spark.sparkContext
    quantiles = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_heavy_hitters_shuffle_does_not_grow_with_the_items(spark):
    """A third of the rows are two items, the others are all different."""
    written = []
    for n in (6_000, 60_000):
        df = spark.range(n).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id") % 2).otherwise(F.col("id") + 2).alias("item"))
        before = shuffled_records(spark)
        found = sketches.heavy_hitters(df, ["k"], "item", 2, room=256).collect()
        written.append(shuffled_records(spark) - before)
        assert [r.item for r in sorted(found, key=lambda r: r.item_rank)] == [0, 1]
    assert 0 < written[0] < 3000 and written[1] <= 2 * written[0]


# --- stored history ---------------------------------------------------------------------------


def outcomes(spark, n=3000, seed=9):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "event_id": np.arange(n),
            "timestamp": np.sort(rng.integers(0, 12 * 86400, n)),
            "label_type": rng.choice([0, 1, 2], n),
            "item": np.where(rng.random(n) < 0.33, 5, rng.integers(0, 60, n)),
        }
    )
    return spark.createDataFrame(pdf)


def bins_between(df, start, stop):
    part = df.where((F.col("timestamp") >= start * 86400) & (F.col("timestamp") < stop * 86400))
    return history.history_bins(part, {7: "item"}, F.col("timestamp"))


def test_appended_days_equal_a_rebuild(spark, tmp_path):
    df = outcomes(spark)
    store = HistoryStore(f"h_{uuid.uuid4().hex}", str(tmp_path / "h"), 4)
    store.create(bins_between(df, 0, 5))
    before = files(store.path)
    for start, stop in ((5, 6), (6, 10), (10, 12), (12, 20)):
        store.append(bins_between(df, start, stop))
    assert before.items() <= files(store.path).items()
    rebuilt = history.history_build(df, {7: "item"})
    key = lambda r: tuple(r)
    assert sorted(map(key, store.open(spark).collect())) == sorted(map(key, rebuilt.collect()))
    with pytest.raises(ValueError):
        store.append(bins_between(df, 3, 4))
    with pytest.raises(Exception):
        store.create(bins_between(df, 0, 1))

    looked = history.history_lookup(df, store.open(spark), {7: "item"}, prior=0.2, buckets=4)
    want = history.history_lookup(df, rebuilt, {7: "item"}, prior=0.2)
    assert sorted(map(key, looked.collect())) == sorted(map(key, want.collect()))

    # the stored side is read bucket by bucket, without an exchange between it and the window
    lines = looked._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert "Window" in next(line for line in above if "Exchange" in line or "Window" in line)

    # another session, which only knows the folder
    spark.sql(f"DROP TABLE {store.name}")
    again = HistoryStore(f"h_{uuid.uuid4().hex}", store.path, 4)
    assert sorted(map(key, again.open(spark).collect())) == sorted(map(key, rebuilt.collect()))
    again.append(bins_between(outcomes(spark, 50).withColumn("timestamp", F.col("timestamp") + 20 * 86400), 20, 40))
    assert again.open(spark).where("fid = 0").agg(F.max("cum_cnt")).first()[0] == 3050
