"""Leak-safe historical conversion rates.

Rates are kept per (fid, value, time bin) as cumulative counts. A row may only see bins
that ended ``cutoff`` seconds before it. The as-of lookup never brings rows of one value
together: it works on the distinct (fid, value, bin) that are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.functions.clock import floor_div
from tallyrow.plans.fixed import DAY, HOUR
from tallyrow.operators.ordered import null_safe_join
from tallyrow.session import materialize

GLOBAL_FID = 0


def event_time(ts: Column) -> Column:
    return ts


def available_time(ts: Column, label_type: Column, label_time: Column, maturity: int = DAY) -> Column:
    """When the outcome is known: feedback time of a conversion, else after ``maturity``."""
    known = F.greatest(F.when(label_time > 0, label_time).otherwise(ts), ts)
    return F.when(F.coalesce(label_type, F.lit(0)) == 2, known).otherwise(ts + F.lit(maturity))


def history_values(columns: dict[int, str]) -> Column:
    """All (fid, value) a row contributes to; fid 0 stands for the whole table."""
    pairs = [(GLOBAL_FID, F.lit(0))] + [(fid, F.col(c)) for fid, c in sorted(columns.items())]
    return F.array(
        *[
            F.struct(F.lit(fid).cast("bigint").alias("fid"), F.coalesce(v, F.lit(0)).cast("bigint").alias("value"))
            for fid, v in pairs
        ]
    )


def history_bins(df: DataFrame, columns: dict[int, str], when: Column, bin_sec: int = HOUR) -> DataFrame:
    """Count and conversions per (fid, value, bin); hot values shrink before the shuffle."""
    positive = (F.coalesce(F.col("label_type"), F.lit(0)) == 2).cast("bigint")
    long = df.select(
        floor_div(when, bin_sec).alias("bin"), positive.alias("positive"), F.explode(history_values(columns)).alias("p")
    ).select("p.fid", "p.value", "bin", "positive")
    return (
        long.where((F.col("fid") == GLOBAL_FID) | (F.col("value") > 0))
        .groupBy("fid", "value", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("positive").alias("pos"))
    )


def history_cumulative(bins: DataFrame, bin_sec: int = HOUR) -> DataFrame:
    """Running totals per value with the last second of each bin. One row per bin and value."""
    upto = W.partitionBy("fid", "value").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return bins.select(
        "fid",
        "value",
        "bin",
        ((F.col("bin") + 1) * bin_sec - 1).alias("bin_end_ts"),
        F.sum("cnt").over(upto).alias("cum_cnt"),
        F.sum("pos").over(upto).alias("cum_pos"),
    )


def history_build(
    df: DataFrame,
    columns: dict[int, str],
    mode: str = "timestamp_cutoff",
    bin_sec: int = HOUR,
    maturity: int = DAY,
    ts_min: int | None = None,
    ts_max: int | None = None,
) -> DataFrame:
    """The stored table: cumulative counts of all values and of the whole (fid 0)."""
    if mode not in ("timestamp_cutoff", "available"):
        raise ValueError(f"unknown mode {mode!r}")
    if bin_sec <= 0 or maturity < 0:
        raise ValueError("bin_sec must be positive and maturity not negative")
    if not columns:
        raise ValueError("no columns selected")
    ts = F.col("timestamp")
    if ts_min is not None:
        df = df.where(ts >= F.lit(ts_min))
    if ts_max is not None:
        df = df.where(ts < F.lit(ts_max))
    when = event_time(ts)
    if mode == "available":
        when = available_time(ts, F.col("label_type"), F.col("label_time"), maturity)
    return history_cumulative(history_bins(df, columns, when, bin_sec), bin_sec)


def global_prior(store: DataFrame) -> float:
    """Conversion rate of everything in the store; one scalar."""
    row = store.where(F.col("fid") == GLOBAL_FID).agg(F.max("cum_cnt"), F.max("cum_pos")).first()
    return float(row[1]) / float(row[0]) if row[0] else 0.0


def probe_bin(ts: Column, cutoff: int, bin_sec: int) -> Column:
    """Latest bin whose last second is not after ``ts - cutoff``."""
    return floor_div(ts - F.lit(cutoff - 1), bin_sec) - 1


def history_lookup(
    df: DataFrame,
    store: DataFrame,
    columns: dict[int, str],
    cutoff: int = DAY,
    strength: float = 20.0,
    prior: float | None = None,
    bin_sec: int = HOUR,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``hist_rate``, ``hist_log_count`` and ``hist_rate_<fid>``, ``hist_log_count_<fid>``.

    1. the distinct (ids, probe bin) of the rows; 2. of those the distinct (fid, value, bin);
    3. one running maximum per value over stored and probed bins (the cumulative counts
    never fall); 4. equi-joins back to 1 and to the rows. A row without a time has the prior
    and counts of 0. ``buckets`` is the number of buckets of a store kept by (fid, value): the probes go there, and
    the store is not shuffled.
    """
    if prior is None:
        prior = global_prior(store)
    fids = sorted(columns)
    ids = {fid: f"_id_{fid}" for fid in fids}
    rows = df.withColumns(
        {
            "_bin": probe_bin(F.col("timestamp"), cutoff, bin_sec),
            **{ids[fid]: F.greatest(F.coalesce(F.col(columns[fid]), F.lit(0)), F.lit(0)).cast("bigint") for fid in fids},
        }
    )
    key = ["_bin", *ids.values()]
    # written once: both the probes and the answers of a tuple come from it
    tuples = materialize(rows.select(*key).distinct())
    asked = tuples.select(*key, F.explode(history_values(ids)).alias("p")).select(*key, "p.fid", "p.value")
    probes = (
        asked.where((F.col("fid") == GLOBAL_FID) | (F.col("value") > 0))
        .select("fid", "value", F.col("_bin").alias("bin"))
        .distinct()
    )
    nothing = F.lit(None).cast("bigint")
    probes = probes.select("*", nothing.alias("cum_cnt"), nothing.alias("cum_pos"))
    if buckets:
        probes = probes.repartition(buckets, "fid", "value")
    timeline = store.select("fid", "value", "bin", "cum_cnt", "cum_pos").unionByName(probes)
    upto = W.partitionBy("fid", "value").orderBy("bin").rangeBetween(W.unboundedPreceding, 0)
    ran = timeline.withColumns({"_cnt": F.max("cum_cnt").over(upto), "_pos": F.max("cum_pos").over(upto)})
    answers = ran.where(F.col("cum_cnt").isNull()).select("fid", "value", F.col("bin").alias("_bin"), "_cnt", "_pos")
    # null-safe, since a filter on null keys would hide the store's buckets from the window
    found = null_safe_join(asked, answers, ["fid", "value", "_bin"], "left")

    def of(fid: int, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("fid") == fid, F.col(column))), F.lit(0)).cast("double")

    wide = found.groupBy(*key).agg(
        *[of(fid, c).alias(f"{c}_{fid}") for fid in [GLOBAL_FID, *fids] for c in ("_cnt", "_pos")]
    )
    rate = F.when(F.col("_cnt_0") > 0, F.col("_pos_0") / F.col("_cnt_0")).otherwise(F.lit(float(prior)))
    features = [rate.alias("hist_rate"), F.log1p("_cnt_0").alias("hist_log_count")]
    for fid in fids:
        cnt, pos = F.col(f"_cnt_{fid}"), F.col(f"_pos_{fid}")
        smoothed = F.when(cnt > 0, (pos + F.lit(float(strength)) * rate) / (cnt + F.lit(float(strength)))).otherwise(rate)
        features += [smoothed.alias(f"hist_rate_{fid}"), F.log1p(cnt).alias(f"hist_log_count_{fid}")]
    return null_safe_join(rows, wide.select(*key, *features), key).drop(*key)


def history_columns(fids: Sequence[int]) -> list[str]:
    """Names in the order of the dense block."""
    names = ["hist_rate", "hist_log_count"]
    for fid in sorted(fids):
        names += [f"hist_rate_{fid}", f"hist_log_count_{fid}"]
    return names
