"""Validation-window reports: backtest of a clock window and the window scoreboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.functions.cleaning import binary_label
from tallyrow.functions.clock import clock_text
from tallyrow.operators.blocks import block_catalog
from tallyrow.operators.profile import clock_window_by_day, named_quantiles, seq_lengths, unpack
from tallyrow.operators.ranks import exact_quantiles, narrow_quantiles
from tallyrow.operators.splits import window_rows
from tallyrow.plans.features import SequenceDomain
from tallyrow.plans.fixed import LOCAL_OFFSET
from tallyrow.plans.windows import TimeWindow, local_day_number, local_epoch


def window_backtest_summary(
    df: DataFrame, start: str, end: str, min_rows: int = 10_000, offset: int = LOCAL_OFFSET
) -> DataFrame:
    """One row: is repeating the clock window on earlier days a usable backtest?

    ``start`` and ``end`` are local times of the target window, both included.
    """
    lo, hi = local_epoch(start, offset), local_epoch(end, offset)
    target_day = local_day_number(start.split()[0])
    by_day = clock_window_by_day(df, start.split()[1], end.split()[1], offset)
    days = by_day.agg(
        F.count(F.when(F.col("window_rows") >= min_rows, 1)).alias("viable_days"),
        F.coalesce(F.sum(F.when(F.col("day") == target_day, F.col("window_rows"))), F.lit(0)).alias(
            "target_day_rows"
        ),
    )
    inside = F.col("timestamp").between(lo, hi)
    exact = df.agg(
        F.count(F.when(inside, 1)).alias("exact_rows"),
        F.coalesce(F.sum(F.when(inside, binary_label(F.col("label_type")))), F.lit(0)).alias("exact_pos"),
        (F.lit(lo) - F.max("timestamp")).alias("train_max_to_start_sec"),
    ).first()
    return days.select(
        F.lit(exact.exact_rows).cast("bigint").alias("exact_rows"),
        F.lit(exact.exact_pos).cast("bigint").alias("exact_pos"),
        F.lit(exact.train_max_to_start_sec).cast("bigint").alias("train_max_to_start_sec"),
        "target_day_rows",
        "viable_days",
        (F.col("viable_days") >= 2).alias("recommend"),
    )


def block_time_split(df: DataFrame, block: str, valid_ratio: float = 0.05) -> DataFrame:
    """One row: how far the latest ``valid_ratio`` of the blocks overlap the rest in time.

    Blocks are ordered by their latest time, ties by the block itself; at least one validates. With a single block
    the training side is empty and its columns null.
    """
    catalog = block_catalog(df, block)
    ranked = catalog.select(
        "*",
        F.row_number().over(W.orderBy("max_ts", "block")).alias("_rank"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("_n"),
    )
    valid = F.col("_rank") > F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(valid_ratio))))

    def over(side: Column, fn, column: str) -> Column:
        return fn(F.when(side, F.col(column)))

    split = ranked.agg(
        *[
            over(side, fn, column).alias(f"{name}_{short}")
            for name, side in (("train", ~valid), ("valid", valid))
            for short, fn, column in (("rows", F.sum, "n_rows"), ("min", F.min, "min_ts"), ("max", F.max, "max_ts"))
        ]
    )
    return split.select("*", (F.col("train_max") - F.col("valid_min")).alias("overlap_sec"))


def window_details(df: DataFrame, windows: Sequence[TimeWindow], domains: Sequence[SequenceDomain]) -> DataFrame:
    """Per window and domain: rows, mean, median, p95 and maximum of the clipped length, share of empty lists.

    A window without rows has no line. Lengths are counted value by value, so only counts are shuffled.
    """
    lengths = seq_lengths(window_rows(df, windows), domains, "clipped", "window")
    keys = ["window", "domain"]
    counted = lengths.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("_n"))
    n, value = F.sum("_n"), F.col("length")
    spread = counted.groupBy(*keys).agg(
        n.alias("n"),
        (F.sum(value * F.col("_n")) / n).alias("mean"),
        F.max(value).alias("max"),
        F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)), F.col("_n")).alias("quantiles"),
        (F.sum(F.when(value == 0, F.col("_n")).otherwise(0)) / n).alias("empty_share"),
    )
    return named_quantiles(spread, [50, 95])


def window_time_quantiles(df: DataFrame, windows: Sequence[TimeWindow], percentiles: Sequence[float]) -> DataFrame:
    """Per window: rows, and exact percentiles of the position inside it (0 the start, 1 the end)."""
    length = F.lit(None).cast("double")
    start = F.lit(None).cast("bigint")
    for w in windows:
        here = F.col("window") == w.name
        start = F.when(here, F.lit(w.start)).otherwise(start)
        length = F.when(here, F.lit(float(max(1, w.end - w.start)))).otherwise(length)
    position = (F.col("timestamp") - start) / length
    rows = window_rows(df, windows).select("window", position.alias("_at"))
    spread = exact_quantiles(rows, ["window"], "_at", [p / 100 for p in percentiles])
    return named_quantiles(spread.select("window", "n", "quantiles"), percentiles)


def _mean_of(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total / F.lit(float(len(parts)))


def window_scoreboard(
    df: DataFrame,
    windows: Sequence[TimeWindow],
    domains: Sequence[SequenceDomain],
    time_targets: dict[float, float],
    length_targets: dict[str, tuple[float, float]],
    min_rows: int = 10_000,
    offset: int = LOCAL_OFFSET,
) -> DataFrame:
    """How close each window's rows look to a target described by published statistics.

    ``time_targets`` maps percentile to position within the window (0 … 1);
    ``length_targets`` maps domain to (mean, median) of the clipped sequence length.
    A window without rows has infinite distances and no rate.
    """
    rows = window_rows(df, windows)
    starts = {w.name: w for w in windows}
    position = F.lit(None).cast("double")
    for w in starts.values():
        share = (F.col("timestamp") - w.start) / F.lit(float(max(1, w.end - w.start)))
        position = F.when(F.col("window") == w.name, share).otherwise(position)

    totals = rows.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(binary_label(F.col("label_type"))).alias("n_pos")
    )

    percentiles = sorted(time_targets)
    spread = exact_quantiles(
        rows.select("window", position.alias("_at")), ["window"], "_at", [p / 100 for p in percentiles]
    )
    gaps = [F.abs(F.get("quantiles", F.lit(i)) - F.lit(time_targets[p])) for i, p in enumerate(percentiles)]
    times = spread.select("window", _mean_of(gaps).alias("time_q_l1"))

    used = [d for d in domains if d.name in length_targets]
    lengths = narrow_quantiles(
        seq_lengths(rows, used, "clipped", "window"), ["window", "domain"], "length", [0.5]
    )
    mean_target, median_target = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (mean, median) in length_targets.items():
        here = F.col("domain") == name
        mean_target = F.when(here, F.lit(float(mean))).otherwise(mean_target)
        median_target = F.when(here, F.lit(float(median))).otherwise(median_target)

    def relative(value: Column, target: Column) -> Column:
        return F.abs(value - target) / F.greatest(target, F.lit(1.0))

    seqs = lengths.groupBy("window").agg(
        F.avg(relative(F.col("mean"), mean_target)).alias("seq_mean_rel_l1"),
        F.avg(relative(F.get("quantiles", F.lit(0)), median_target)).alias("seq_p50_rel_l1"),
    )

    ids = [F.struct(F.lit(c).alias("id_column"), F.col(f"{c}_id").alias("id")) for c in ("user", "item")]
    counted = unpack(rows, ids, "window").groupBy("window", "id_column", "id").agg(F.count(F.lit(1)).alias("freq"))

    def of(column: str, value: Column) -> Column:
        return F.when(F.col("id_column") == column, value)

    freq = F.col("freq")
    repeats = counted.groupBy("window").agg(
        F.count(of("user", freq)).alias("user_unique"),
        F.avg(of("user", (freq == 1).cast("double"))).alias("user_singleton_share"),
        F.max(of("user", freq)).alias("user_max_freq"),
        F.count(of("item", freq)).alias("item_unique"),
        F.max(of("item", freq)).alias("item_max_freq"),
    )

    facts = unpack(
        df.sparkSession.range(1),
        [
            F.struct(
                F.lit(w.name).alias("window"),
                clock_text(F.lit(w.start), offset).alias("start_local"),
                clock_text(F.lit(w.end), offset).alias("end_local"),
            )
            for w in starts.values()
        ],
    )
    board = facts
    for part in (totals, times, seqs, repeats):
        board = board.join(part, "window", "left")
    never = F.lit(float("inf"))
    board = board.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_pos", "user_unique", "user_max_freq")},
            **{c: F.coalesce(c, F.lit(0)) for c in ("item_unique", "item_max_freq")},
            **{c: F.coalesce(c, never) for c in ("time_q_l1", "seq_mean_rel_l1", "seq_p50_rel_l1")},
        }
    )
    penalty = F.greatest(F.lit(0.0), F.lit(0.95) - F.coalesce("user_singleton_share", F.lit(1.0)))
    distance = F.col("time_q_l1") + F.col("seq_mean_rel_l1") + 0.25 * F.col("seq_p50_rel_l1") + 0.10 * penalty
    return board.select(
        "*",
        F.when(F.col("n_rows") > 0, F.col("n_pos") / F.col("n_rows")).alias("cvr"),
        distance.alias("oracle_distance"),
        (F.col("n_rows") >= min_rows).alias("viable"),
    ).orderBy(F.col("n_rows") < min_rows, F.round("oracle_distance", 9), "window")


def scoreboard_decision(board: DataFrame) -> DataFrame:
    """Viable windows, the best same-clock and same-day ones, and whether to gate on several."""

    def best(prefix: str) -> Column:
        fits = F.col("viable") & F.col("window").startswith(prefix)
        return F.min(F.when(fits, F.struct(F.round("oracle_distance", 9).alias("d"), "window")))["window"]

    picked = board.agg(
        F.count(F.when(F.col("viable"), 1)).alias("viable_windows"),
        best("clk").alias("best_same_clock"),
        best("pre").alias("best_same_day"),
    )
    gate = (F.col("viable_windows") >= 3) & F.col("best_same_clock").isNotNull()
    return picked.select("*", gate.alias("recommend_gate"))
