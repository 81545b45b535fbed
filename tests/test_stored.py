"""Row groups, windows and stored layouts against plain versions, with checks of what is read."""

import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyrow.operators import blocks
from tallyrow.operators import window_totals as totals_of
from tallyrow.operators.intervals import window_join
from tallyrow.sources import row_groups
from tallyrow.sources.row_groups import row_group_catalog, rows_of_row_groups
from tallyrow.sources.tables import scan_impressions


def leaves(df):
    """The scans of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getName():
        plan = plan.finalPhysicalPlan()
    found, out = plan.collectLeaves(), []
    for i in range(found.size()):
        leaf = found.apply(i)
        while "QueryStage" in leaf.getClass().getName():
            inner = leaf.plan().collectLeaves()
            assert inner.size() == 1
            leaf = inner.apply(0)
        out.append(leaf)
    return out


def files_read(df):
    """Files that the scan of the stored rows has opened; scratch tables do not count."""
    (scan,) = [leaf for leaf in leaves(df) if leaf.metrics().contains("numFiles") and "/table-" not in leaf.toString()]
    return scan.metrics().get("numFiles").get().value()


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    """Six files of row groups of 50 rows; one file without statistics, one without rows, nulls in one."""
    folder = tmp_path_factory.mktemp("a folder=1%")
    rng = np.random.default_rng(3)
    for i in range(6):
        n = 0 if i == 4 else 120 + 10 * i
        ts = pd.array(1000 * i + rng.permutation(n) * 3, dtype="Int64")
        if i == 3:
            ts[:7] = None
        table = pa.table({"event_id": pa.array(np.arange(n) + 1000 * i), "timestamp": pa.array(ts), "x": rng.normal(size=n)})
        pq.write_table(table, folder / f"part-{i}.parquet", row_group_size=50, write_statistics=i != 2)
    (folder / "notes.txt").write_text("no parquet")
    return str(folder)


def catalog_rows(spark, path, time="timestamp"):
    found = row_group_catalog(spark, path, time).collect()
    return {(os.path.basename(r.file), r.row_group): r for r in found}


def test_catalog_equals_parquet_metadata(spark, store):
    got = catalog_rows(spark, store)
    want = duckdb.sql(
        f"""SELECT file_name, row_group_id, any_value(row_group_num_rows), sum(total_compressed_size), min(coalesce(dictionary_page_offset, data_page_offset)),
        max(stats_min_value) FILTER (path_in_schema = 'timestamp')::BIGINT, max(stats_max_value) FILTER (path_in_schema = 'timestamp')::BIGINT
        FROM parquet_metadata('{store}/*.parquet') GROUP BY 1, 2"""
    ).fetchall()
    assert len(want) == len(got) > 12
    for name, group, n, size, start, low, high in want:
        r = got[os.path.basename(name), group]
        assert (r.n_rows, r.n_bytes, r.byte_start, r.first_row) == (n, size, start, 50 * group)
        part = pq.ParquetFile(name).read_row_group(group).column("timestamp")
        assert r.n_nulls == part.null_count and r.from_stats == ("part-2" not in name)
        if r.from_stats:
            assert (r.min_ts, r.max_ts) == (low, high)
        else:
            assert low is None and (r.min_ts, r.max_ts) == (min(part.to_pylist()), max(part.to_pylist()))


def test_catalog_of_the_events(spark, sf_dir):
    (r,) = row_group_catalog(spark, f"{sf_dir}/events.parquet", "ts").collect()
    n, low, high = duckdb.sql(f"SELECT count(*), floor(epoch(min(ts)))::BIGINT, floor(epoch(max(ts)))::BIGINT FROM '{sf_dir}/events.parquet'").fetchall()[0]
    assert (r.n_rows, r.min_ts, r.max_ts, r.from_stats) == (n, low, high, True)
    assert row_group_catalog(spark, f"{sf_dir}/events.parquet", "none").first().min_ts is None


def test_no_data_page_is_read(spark, store, tmp_path):
    """All bytes in front of the footer are zero."""
    for i in (0, 1, 3):
        raw = open(f"{store}/part-{i}.parquet", "rb").read()
        footer = 8 + int.from_bytes(raw[-8:-4], "little")
        (tmp_path / f"part-{i}.parquet").write_bytes(b"PAR1" + bytes(len(raw) - footer - 4) + raw[-footer:])
    got, want = catalog_rows(spark, str(tmp_path)), catalog_rows(spark, store)
    assert got and all(r[3:] == want[k][3:] for k, r in got.items())


def test_files_that_only_spark_reads(spark, store, monkeypatch):
    want = catalog_rows(spark, store)
    monkeypatch.setattr(row_groups, "_footer_rows", lambda file, length, time: iter([(file, -1, 0, 0, 0, length, None, None, None, False)]))
    got = catalog_rows(spark, store)
    assert sorted(got) == [(f"part-{i}.parquet", -1) for i in range(6)]
    for (name, _), r in got.items():
        parts = [w for (n, _), w in want.items() if n == name]
        assert r.n_rows == sum(w.n_rows for w in parts) and r.n_nulls == sum(w.n_nulls for w in parts)
        assert r.min_ts == min((w.min_ts for w in parts if w.min_ts is not None), default=None)
    whole = scan_impressions(spark, store)
    chosen = row_group_catalog(spark, store).where("file like '%part-1%' or file like '%part-4%'")
    assert rows_of_row_groups(whole, chosen).count() == 130


@pytest.mark.parametrize("time", [None, "timestamp"])
def test_only_chosen_row_groups_are_read(spark, store, time):
    whole = scan_impressions(spark, store)
    catalog = row_group_catalog(spark, store)
    chosen = catalog.where("(file like '%part-1%' and row_group = 1) or (file like '%part-3%' and row_group <> 1)")
    found = rows_of_row_groups(whole, chosen, ["row_group"], time)
    assert files_read(found) == 2
    ids = {(r.event_id, r.row_group) for r in found.collect()}
    assert ids == {(1000 + k, 1) for k in range(50, 100)} | {(3000 + k, k // 50) for k in [*range(50), *range(100, 150)]}
    assert rows_of_row_groups(whole, catalog).count() == whole.count()
    assert rows_of_row_groups(whole, catalog.where("false"), ["block"], time).count() == 0


def test_sample_split_and_limit_open_their_files_only(spark, store):
    whole = scan_impressions(spark, store)
    catalog = row_group_catalog(spark, store).where("n_rows > 0")
    roles = blocks.split_blocks(catalog, valid_ratio=0.2)
    for chosen in (blocks.sample_blocks(catalog, 3), roles.where("role = 'valid'"), blocks.limit_blocks(roles, 2, 1)):
        want = {r.file for r in chosen.collect()}
        found = rows_of_row_groups(whole, chosen)
        assert files_read(found) == len(want) < 6
        assert found.count() == chosen.agg(F.sum("n_rows")).first()[0]


@pytest.mark.parametrize("key, most", [("event_id", 300), (None, 900)])
def test_scan_skips_the_groups_between_the_chosen_ones(spark, tmp_path, key, most):
    """Two files in order of id; by time the chosen groups lie at both ends of their file."""
    for i in range(2):
        n = 2000
        table = pa.table({"event_id": pa.array(np.arange(n) * 2 + i), "timestamp": pa.array(np.arange(n) * 7 + i)})
        pq.write_table(table, tmp_path / f"part-{i}.parquet", row_group_size=50)
    catalog = row_group_catalog(spark, str(tmp_path), key=key)
    chosen = catalog.where("file like '%part-1%' and row_group in (0, 39)")
    found = rows_of_row_groups(scan_impressions(spark, str(tmp_path)), chosen, time="timestamp", key=key)
    assert sorted(r.event_id for r in found.collect()) == [2 * k + 1 for k in [*range(50), *range(1950, 2000)]]
    (scan,) = [leaf for leaf in leaves(found) if leaf.metrics().contains("numFiles") and "/table-" not in leaf.toString()]
    assert 100 <= scan.metrics().get("numOutputRows").get().value() <= most


def test_ranges_are_few_and_cover_the_groups(spark, monkeypatch):
    monkeypatch.setattr(row_groups, "MOST_RANGES", 3)
    spans = spark.createDataFrame([(0, 9), (5, 7), (100, 110), (120, 130), (300, 310), (311, 320)], "low long, high long")
    assert row_groups._ranges(spans, "low", "high", F.lit(False)) == [(0, 9), (100, 130), (300, 320)]
    assert row_groups._ranges(spans, "low", "high", F.col("low") == 5) == []


# --- windows ----------------------------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ten_thousand_overlapping_windows(spark):
    rng = np.random.default_rng(8)
    ts = rng.integers(-50_000, 1_000_000, 4000)
    start = rng.integers(-60_000, 1_000_000, 10_000)
    length = np.where(rng.random(10_000) < 0.002, 700_000, 2 ** rng.integers(0, 9, 10_000) + rng.integers(0, 2, 10_000))
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(4000), "timestamp": ts}))
    windows = spark.createDataFrame(pd.DataFrame({"w": np.arange(10_000), "start": start, "end": start + length}))
    found = window_join(rows, windows)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.id, r.w) for r in found.select("id", "w").collect()}
    inside = (ts[:, None] >= start) & (ts[:, None] < start + length)
    assert got == set(zip(*map(list, (x.tolist() for x in np.nonzero(inside))))) and found.count() == inside.sum() > 20_000
    # rows times the levels in use, not rows times windows
    made = [leaf for leaf in plan.splitlines() if "Generate explode" in leaf]
    assert made


def test_window_edges(spark):
    rows = spark.createDataFrame([(1, 10), (2, 19), (3, 20), (4, None), (5, 15), (5, 15)], "id int, timestamp long")
    make = lambda *w: spark.createDataFrame(list(w), "name string, start long, end long")
    found = window_join(rows, make(("a", 10, 20), ("a", 10, 20), ("b", 19, 20), ("c", 20, 2**40)))
    assert sorted((r.id, r.name) for r in found.collect()) == [(1, "a")] * 2 + [(2, "a")] * 2 + [(2, "b"), (3, "c")] + [(5, "a")] * 4
    assert window_join(rows, make()).count() == 0 and window_join(rows.where("false"), make(("a", 1, 2))).count() == 0
    for bad in (("x", 5, 5), ("x", None, 5), ("x", 5, None)):
        with pytest.raises(ValueError):
            window_join(rows, make(bad))
    with pytest.raises(ValueError):
        window_join(rows.withColumn("Name", F.lit(1)), make(("a", 1, 2)))


@pytest.mark.parametrize("slot_rows, part_windows", [(1 << 14, 1 << 17), (64, 50)])
def test_window_totals_equal_the_joined_rows(spark, monkeypatch, slot_rows, part_windows):
    """One slot and many, one task a slot and several; hot seconds, null users and keys, users that come back after longer than a chunk."""
    monkeypatch.setattr(totals_of, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(totals_of, "PART_WINDOWS", part_windows)
    monkeypatch.setattr(totals_of, "CHUNK_BITS", 10)
    rng = np.random.default_rng(4)
    n, m = 3000, 600
    ts = pd.array(np.where(rng.random(n) < 0.1, 5000, rng.integers(-20_000, 60_000, n)), dtype="Int64")
    ts[:5] = None
    user = pd.array(np.where(rng.random(n) < 0.3, 0, rng.integers(0, 200, n)), dtype="Int64")
    user[100:200] = None
    id = pd.array(rng.permutation(n), dtype="Int64")
    id[50:60] = None
    columns = [[None if v is pd.NA else int(v) for v in c] for c in (id, ts, user, rng.integers(0, 3, n))]
    rows = spark.createDataFrame(list(zip(*columns)), "id long, timestamp long, user long, kind int")
    start = rng.integers(-30_000, 70_000, m)
    length = np.where(rng.random(m) < 0.1, 40_000, rng.integers(1, 3000, m))
    windows = spark.createDataFrame(pd.DataFrame({"w": np.arange(m), "start": start, "end": start + length}))
    found = totals_of.window_totals(rows, windows, F.col("kind") == 1, "user", "id")
    assert found.columns == ["w", "start", "end", "n_rows", "n_pos", "n_users", "first"]
    want = window_join(rows, windows).groupBy("w", "start", "end").agg(
        F.count(F.lit(1)), F.count_if(F.col("kind") == 1), F.countDistinct("user"), F.min("id")
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and 100 < want.count() < m
    assert totals_of.window_totals(rows, windows.where("false"), F.col("kind") == 1, "user", "id").count() == 0
    assert totals_of.window_totals(rows.where("false"), windows, F.col("kind") == 1, "user", "id").count() == 0


def test_window_query_lists_no_matches(spark, sf_dir):
    from tallyrow.catalog import REGISTRY

    plan = plan_of(REGISTRY["window_table_join"].run(spark, sf_dir))
    assert "_level" not in plan and "count(distinct" not in plan


def test_windows_of_one_name_count_together(spark, tmp_path):
    """An event that is stored twice."""
    from oracle import duck

    from tallyrow.catalog import REGISTRY

    source = "/root/testdata/sf0.001/events.parquet"
    duckdb.sql(f"COPY (SELECT * FROM '{source}' UNION ALL SELECT * FROM '{source}' WHERE event_id < 200) TO '{tmp_path}/events.parquet'")
    item = REGISTRY["window_table_join"]
    result = duck(str(tmp_path)).execute(item.sql)
    names = [d[0] for d in result.description]
    assert sorted(map(tuple, item.run(spark, str(tmp_path)).select(*names).collect())) == sorted(result.fetchall())
