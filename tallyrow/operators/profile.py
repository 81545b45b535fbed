"""Distribution reports over impression tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.functions.cleaning import (
    binary_label,
    list_is_null,
    primary_first_nonzero,
    primary_first_slot,
    scalar_is_null,
)
from tallyrow.functions.clock import date_text, day_number, daypart, hour_of_day, second_of_day
from tallyrow.functions.sequences import clipped_length, model_length, true_length
from tallyrow.operators.blocks import block_catalog, rows_of_blocks, sample_blocks
from tallyrow.operators.ordered import top_per_key
from tallyrow.operators.ranks import exact_quantiles, narrow_quantiles
from tallyrow.plans.features import IntFeature, SequenceDomain, is_list
from tallyrow.plans.fixed import (
    LENGTH_PERCENTILES,
    LOCAL_OFFSET,
    TIME_BUCKET_EDGES,
    VALUE_PERCENTILES,
)
from tallyrow.session import materialize


def unpack(df: DataFrame, structs: Sequence[Column], *keep: str) -> DataFrame:
    """One output row per struct; used to turn columns into rows."""
    return df.select(*keep, F.explode(F.array(*structs)).alias("_s")).select(*keep, "_s.*")


def rate(pos: Column, n: Column) -> Column:
    return F.when(n > 0, pos / n).otherwise(F.lit(0.0))


def _totals() -> list[Column]:
    positive = binary_label(F.col("label_type"))
    return [F.count(F.lit(1)).alias("n_rows"), F.sum(positive).alias("n_pos")]


def global_cvr(df: DataFrame) -> DataFrame:
    return df.agg(*_totals()).select("*", rate(F.col("n_pos"), F.col("n_rows")).alias("cvr"))


# --- ids ---------------------------------------------------------------------------------


def id_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, id); null counts as 0."""
    parts = [
        F.struct(F.lit(c).alias("id_column"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("id"))
        for c in columns
    ]
    return unpack(df, parts).groupBy("id_column", "id").agg(F.count(F.lit(1)).alias("freq"))


def id_frequency(df: DataFrame, columns: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    """How often ids repeat, per id column."""
    freq = F.col("freq")
    return id_counts(df, columns).groupBy("id_column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.avg((freq == 1).cast("double")).alias("share_once"),
        F.avg(freq.between(2, 10).cast("double")).alias("share_2_10"),
        F.avg((freq > 10).cast("double")).alias("share_over_10"),
        F.max(freq).alias("max_freq"),
        F.avg(freq).alias("mean_freq"),
        F.sum(freq).alias("n_total"),
    )


def freq_histogram(df: DataFrame, column: str = "user_id", top: int = 20) -> DataFrame:
    """The ``top`` most common repeat counts and how many ids have them."""
    return (
        id_counts(df, [column])
        .groupBy("freq")
        .agg(F.count(F.lit(1)).alias("n_ids"))
        .orderBy(F.desc("n_ids"), "freq")
        .limit(top)
    )


def distinct_users(df: DataFrame, approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(fn(F.col("user_id")).alias("n_users"))


# --- missing values ------------------------------------------------------------------------


def missing_gap(df: DataFrame, features: Sequence[IntFeature]) -> DataFrame:
    """Null share per feature and the conversion gap between null and non-null rows.

    All features are counted by one aggregate without multiplying rows.
    """
    positive = binary_label(F.col("label_type"))
    counts = []
    for i, f in enumerate(features):
        column = F.col(f.column)
        is_null = list_is_null(column) if is_list(df, f.column) else scalar_is_null(column)
        counts += [
            F.sum(is_null.cast("bigint")).alias(f"null_{i}"),
            F.sum(F.when(is_null, positive).otherwise(0)).cast("bigint").alias(f"pos_null_{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("n"), F.sum(positive).alias("pos"), *counts)
    rows = []
    for i, f in enumerate(features):
        n_null, pos_null = F.col(f"null_{i}"), F.col(f"pos_null_{i}")
        cvr_null = rate(pos_null, n_null)
        cvr_set = rate(F.col("pos") - pos_null, F.col("n") - n_null)
        rows.append(
            F.struct(
                F.lit(f.section).alias("section"),
                F.lit(f.fid).cast("bigint").alias("fid"),
                F.col("n").alias("n_total"),
                n_null.alias("n_null"),
                rate(n_null, F.col("n")).alias("null_rate"),
                cvr_null.alias("cvr_null"),
                cvr_set.alias("cvr_notnull"),
                (cvr_null - cvr_set).alias("cvr_gap"),
            )
        )
    return unpack(wide, rows).where("n_total > 0").orderBy(F.desc(F.abs("cvr_gap")), "section", "fid")


def missing_rates(df: DataFrame, features: Sequence[IntFeature]) -> DataFrame:
    """Label-free part of :func:`missing_gap`, for unlabelled tables."""
    unlabelled = df.withColumn("label_type", F.lit(0))
    return missing_gap(unlabelled, features).select("section", "fid", "n_total", "n_null", "null_rate")


# --- sequences -------------------------------------------------------------------------------


def seq_lengths(df: DataFrame, domains: Sequence[SequenceDomain], kind: str = "true", *keep: str) -> DataFrame:
    """Long table (domain, length) by one of the three length definitions.

    ``true`` counts positive timestamps, ``true_head`` those within max_len, ``model`` is
    the longest truncated side list and ``clipped`` the raw list length up to max_len.
    """

    def length(d: SequenceDomain) -> Column:
        if kind == "model":
            return model_length([F.col(d.column(f)) for f in d.side_fids], d.max_len)
        ts_list = F.col(d.ts_column)
        if kind == "clipped":
            return clipped_length(ts_list, d.max_len)
        if kind not in ("true", "true_head"):
            raise ValueError(f"unknown length kind {kind!r}")
        return F.coalesce(true_length(ts_list, d.max_len if kind == "true_head" else None), F.lit(0))

    parts = [F.struct(F.lit(d.name).alias("domain"), length(d).cast("bigint").alias("length")) for d in domains]
    return unpack(df, parts, *keep)


def seq_len_quantiles(df: DataFrame, domains: Sequence[SequenceDomain], kind: str = "true") -> DataFrame:
    shares = [p / 100 for p in LENGTH_PERCENTILES]
    return named_quantiles(
        narrow_quantiles(seq_lengths(df, domains, kind), ["domain"], "length", shares), LENGTH_PERCENTILES
    )


def named_quantiles(df: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """Spread the ``quantiles`` array over columns ``p1``, ``p99_9`` and so on."""
    columns = [F.get("quantiles", F.lit(i)).alias(percentile_name(p)) for i, p in enumerate(percentiles)]
    return df.select(*[c for c in df.columns if c != "quantiles"], *columns)


def percentile_name(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


def seq_time_diffs(
    df: DataFrame, domains: Sequence[SequenceDomain], min_diff: int = 0, truncate: bool = False, *keep: str
) -> DataFrame:
    """Long table (domain, diff): impression time minus each positive list timestamp.

    Reports keep differences from 0 on; edge fitting asks for ``min_diff=1``.
    """
    parts = []
    for d in domains:
        if d.ts_column is None:
            continue
        seen = F.slice(F.col(d.ts_column), 1, d.max_len) if truncate else F.col(d.ts_column)
        parts.append(F.struct(F.lit(d.name).alias("domain"), seen.alias("seen")))
    long = df.select(*keep, "timestamp", F.explode(F.array(*parts)).alias("p")).select(
        *keep, "timestamp", "p.domain", F.explode("p.seen").alias("s")
    )
    diff = (F.col("timestamp") - F.col("s")).alias("diff")
    return long.where("s > 0").select(*keep, "domain", diff).where(F.col("diff") >= min_diff)


def time_diff_quantiles(df: DataFrame, domains: Sequence[SequenceDomain]) -> DataFrame:
    shares = [p / 100 for p in LENGTH_PERCENTILES]
    return named_quantiles(
        exact_quantiles(seq_time_diffs(df, domains), ["domain"], "diff", shares), LENGTH_PERCENTILES
    )


def log_edges(
    n: int, p99: float | None, count: int = len(TIME_BUCKET_EDGES), lowest: int = 5, least_rows: int = 100
) -> list[int]:
    """Log-spaced edges from ``lowest`` to ``p99``; fewer than ``least_rows`` or too short differences keep the default."""
    if n < least_rows or p99 is None or p99 <= lowest:
        return list(TIME_BUCKET_EDGES)
    ideal = np.rint(np.exp(np.linspace(np.log(lowest), np.log(p99), count)))
    ideal[0] = max(ideal[0], lowest)
    # strictly increasing: an edge is at least as far right as all before it plus their distance
    steps = np.arange(count)
    return (np.maximum.accumulate(ideal - steps) + steps).astype(int).tolist()


def fit_time_edges(df: DataFrame, domains: Sequence[SequenceDomain]) -> dict[str, list[int]]:
    """Recency edges per domain from all positive differences; needs data in at least one domain."""
    diffs = seq_time_diffs(df, domains, 1)
    rows = exact_quantiles(diffs, ["domain"], "diff", [0.99]).collect()
    if not rows:
        raise ValueError("no domain has a positive time difference; check the timestamp columns")
    found = {r.domain: (r.n, r.quantiles[0]) for r in rows}
    return {d.name: log_edges(*found.get(d.name, (0, None))) for d in domains}


def bucket_fit_sample(
    df: DataFrame,
    domains: Sequence[SequenceDomain],
    block: str,
    row_key: str,
    n_blocks: int | None = None,
    rows_per_block: int | None = None,
    diffs_per_block: int | None = None,
    diffs_per_domain: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Positive differences (domain, diff) from ``n_blocks`` evenly spaced blocks (None: all).

    Every row of the chosen blocks counts. A limit that the caller sets keeps a repeatable
    uniform sample, chosen by a hash and not by the order of the keys.
    """
    rows = df
    if n_blocks is not None:
        rows = rows_of_blocks(df, block, sample_blocks(block_catalog(df, block), n_blocks))
    if rows_per_block is not None:
        rows = reservoir_sample(rows, [block], rows_per_block, row_key, seed=seed)
    diffs = seq_time_diffs(rows, domains, 1, False, block, row_key)
    draw = F.xxhash64(row_key, "domain", "diff", F.lit(seed))
    if diffs_per_block is not None:
        diffs = reservoir_sample(diffs, ["domain", block], diffs_per_block, row_key, draw)
    if diffs_per_domain is not None:
        diffs = reservoir_sample(diffs, ["domain"], diffs_per_domain, row_key, draw)
    return diffs.select("domain", "diff")


def seq_items(df: DataFrame, domains: Sequence[SequenceDomain], fids: Sequence[int] | None = None) -> DataFrame:
    """Long table (domain, fid, item) of positive side ids."""
    parts = [
        F.struct(
            F.lit(d.name).alias("domain"),
            F.lit(fid).cast("bigint").alias("fid"),
            F.col(d.column(fid)).alias("items"),
        )
        for d in domains
        for fid in d.side_fids
        if fids is None or fid in fids
    ]
    return unpack(df, parts).select("domain", "fid", F.explode("items").alias("item")).where("item > 0")


def seq_topk_items(
    df: DataFrame, domains: Sequence[SequenceDomain], k: int = 50_000, fids: Sequence[int] | None = None
) -> DataFrame:
    """The ``k`` most frequent items per (domain, fid), ties by item, with the distinct count.

    ``fids`` restricts the report, for instance to those the catalog flags as high-vocabulary.
    """
    counted = seq_items(df, domains, fids).groupBy("domain", "fid", "item").agg(F.count(F.lit(1)).alias("freq"))
    freq = materialize(counted)
    keys = ["domain", "fid"]
    distinct = freq.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    top = top_per_key(freq, keys, [F.desc("freq"), F.asc("item")], k, ["item"], rank="item_rank")
    return top.join(distinct, keys)


def seq_item_overlap(
    train: DataFrame, test: DataFrame, domains: Sequence[SequenceDomain], buckets: int | None = None
) -> DataFrame:
    """Share of the distinct test items per (domain, fid) that training has seen too.

    With ``buckets`` items are folded first, as a hashed embedding would.
    """
    keys = ["domain", "fid", "item"]

    def seen(df: DataFrame, flag: str) -> DataFrame:
        items = seq_items(df, domains)
        if buckets:
            items = items.withColumn("item", F.greatest(F.pmod("item", F.lit(buckets)), F.lit(1)).cast("bigint"))
        return items.select(*keys, F.lit(flag).alias("side"))

    sides = (
        seen(train, "train")
        .unionByName(seen(test, "test"))
        .groupBy(*keys)
        .agg(
            F.max((F.col("side") == "train").cast("bigint")).alias("in_train"),
            F.max((F.col("side") == "test").cast("bigint")).alias("in_test"),
        )
    )
    both = F.sum(F.col("in_train") * F.col("in_test"))
    return sides.groupBy("domain", "fid").agg(
        F.sum("in_train").alias("n_train"),
        F.sum("in_test").alias("n_test"),
        both.alias("n_both"),
        rate(both, F.sum("in_test")).alias("test_share_seen"),
    )


# --- time --------------------------------------------------------------------------------------


def cvr_by_day(df: DataFrame) -> DataFrame:
    """Per UTC day. The shifted date is that of UTC midnight plus 8 h, hence the same date."""
    days = df.groupBy(day_number(F.col("timestamp")).alias("day")).agg(*_totals())
    total = F.sum("n_rows").over(W.partitionBy())  # one row per day
    return days.select(
        "*",
        rate(F.col("n_pos"), F.col("n_rows")).alias("cvr"),
        (F.col("n_rows") / total).alias("share"),
        date_text(F.col("day")).alias("date_utc"),
        date_text(F.floor((F.col("day") * 86400 + LOCAL_OFFSET) / 86400)).alias("date_local"),
        F.pmod(F.col("day") + 3, F.lit(7)).cast("bigint").alias("weekday"),
    )


def cvr_by_hour(df: DataFrame) -> DataFrame:
    hours = df.groupBy(hour_of_day(F.col("timestamp")).alias("hour_utc")).agg(*_totals())
    return hours.select(
        "*",
        rate(F.col("n_pos"), F.col("n_rows")).alias("cvr"),
        F.pmod(F.col("hour_utc") + 8, F.lit(24)).cast("bigint").alias("hour_local"),
    )


def local_cvr(
    df: DataFrame, offset: int = LOCAL_OFFSET, kinds: Sequence[str] = ("day", "hour", "daypart")
) -> DataFrame:
    """Rows and conversion rate by local date, hour and daypart, as far as ``kinds`` names them.

    Several kinds share one pass (grouping sets); a single one is a plain grouping without row expansion.
    """
    ts = F.col("timestamp")
    buckets = {
        "day": date_text(day_number(ts, offset)),
        "hour": F.format_string("hour_%02d", hour_of_day(ts, offset)),
        "daypart": daypart(ts, offset),
    }
    if not kinds or set(kinds) - set(buckets):
        raise ValueError(f"unknown kinds {list(kinds)!r}")
    base = df.select(*[buckets[k].alias(k) for k in kinds], "label_type")
    if len(kinds) == 1:
        grouped, kind = base.groupBy(kinds[0]).agg(*_totals()), F.lit(kinds[0])
    else:
        kept = [F.when(F.grouping(k) == 0, k) for k in kinds]
        grouped = base.groupingSets([[F.col(k)] for k in kinds], *kinds).agg(*_totals(), F.coalesce(*kept).alias("kind"))
        kind = F.col("kind")
    return grouped.select(
        kind.alias("kind"),
        F.coalesce(*kinds).alias("bucket"),
        "n_rows",
        "n_pos",
        rate(F.col("n_pos"), F.col("n_rows")).alias("cvr"),
    )


def clock_window_by_day(df: DataFrame, start: str, end: str, offset: int = LOCAL_OFFSET) -> DataFrame:
    """Per local date: rows and rate inside a clock window (both ends included), before it, and all day."""
    lo, hi = (_clock_seconds(c) for c in (start, end))
    ts = F.col("timestamp")
    sec = second_of_day(ts, offset)
    inside, before = sec.between(lo, hi), sec < lo
    positive = binary_label(F.col("label_type"))

    def part(condition: Column, name: str) -> list[Column]:
        return [
            F.count(F.when(condition, 1)).alias(f"{name}_rows"),
            F.sum(F.when(condition, positive).otherwise(0)).alias(f"{name}_pos"),
        ]

    days = df.groupBy(day_number(ts, offset).alias("day")).agg(
        *part(inside, "window"), *part(before, "pre"), *part(F.lit(True), "day")
    )
    return days.where("window_rows > 0").select(
        "day",
        date_text(F.col("day")).alias("date_local"),
        "window_rows",
        "window_pos",
        rate(F.col("window_pos"), F.col("window_rows")).alias("cvr"),
        rate(F.col("day_pos"), F.col("day_rows")).alias("day_cvr"),
        rate(F.col("pre_pos"), F.col("pre_rows")).alias("pre_cvr"),
    )


def _clock_seconds(clock: str) -> int:
    h, m, s = (int(x) for x in clock.split(":"))
    return h * 3600 + m * 60 + s


def abs_ts_quantiles(df: DataFrame) -> DataFrame:
    positive = df.where(F.col("timestamp") > 0).select("timestamp")
    shares = [p / 100 for p in LENGTH_PERCENTILES]
    return named_quantiles(exact_quantiles(positive, [], "timestamp", shares), LENGTH_PERCENTILES)


# --- values --------------------------------------------------------------------------------------


def primary_values(
    df: DataFrame, features: Sequence[IntFeature], mode: str = "first_slot", *keep: str
) -> DataFrame:
    """Long table (section, fid, v): one representative value per row and feature.

    ``first_slot`` and ``first_nonzero`` drop rows without any non-zero slot; ``zero_filled``
    is ``first_slot`` with 0 for those rows.
    """

    def value(f: IntFeature) -> Column:
        column = F.col(f.column)
        if not is_list(df, f.column):
            value = F.when(column != 0, column)
        elif mode == "first_nonzero":
            value = primary_first_nonzero(column)
        else:
            value = primary_first_slot(column)
        return F.coalesce(value, F.lit(0)) if mode == "zero_filled" else value

    if mode not in ("first_slot", "first_nonzero", "zero_filled"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = [
        F.struct(
            F.lit(f.section).alias("section"),
            F.lit(f.fid).cast("bigint").alias("fid"),
            value(f).cast("bigint").alias("v"),
        )
        for f in features
    ]
    return unpack(df, parts, *keep).where(F.col("v").isNotNull())


def value_quantiles(df: DataFrame, features: Sequence[IntFeature], mode: str = "first_slot") -> DataFrame:
    """Quantiles, mean, range and distinct count of the primary value per feature.

    Meant for cleaned ids; on raw ones negative values would count as values.
    """
    keys = ["section", "fid"]
    values = primary_values(df, features, mode)
    spread = exact_quantiles(values, keys, "v", [p / 100 for p in VALUE_PERCENTILES], distinct=True)
    return named_quantiles(spread, VALUE_PERCENTILES)


def value_cvr_signal(
    df: DataFrame, features: Sequence[IntFeature], min_count: int = 100, top: int = 200, scalar_only: bool = False
) -> DataFrame:
    """(section, fid, value) with the largest count · |rate − overall rate|.

    Lists count by their first non-zero value; rows without one count as value 0. Scalars
    are taken as they are, null as 0. ``scalar_only`` leaves lists out.
    """
    positive = binary_label(F.col("label_type"))
    overall = df.agg(F.avg(positive.cast("double"))).first()[0] or 0.0
    parts = []
    for f in features:
        if scalar_only and is_list(df, f.column):
            continue
        column = F.col(f.column)
        value = primary_first_nonzero(column) if is_list(df, f.column) else column
        parts.append(
            F.struct(
                F.lit(f.section).alias("section"),
                F.lit(f.fid).cast("bigint").alias("fid"),
                F.coalesce(value, F.lit(0)).cast("bigint").alias("value"),
            )
        )
    rows = unpack(df.select("*", positive.alias("_positive")), parts, "_positive")
    counts = rows.groupBy("section", "fid", "value").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_positive").alias("n_pos")
    )
    cvr = F.col("n_pos") / F.col("n_rows")
    return (
        counts.where(F.col("n_rows") >= min_count)
        .select("*", cvr.alias("cvr"), (cvr - F.lit(overall)).alias("cvr_gap"))
        .withColumn("signal", F.col("n_rows") * F.abs("cvr_gap"))
        .orderBy(F.desc(F.round("signal", 9)), "section", "fid", "value")
        .limit(top)
    )


def reservoir_sample(
    df: DataFrame, keys: Sequence[str], k: int, row_key: str, draw: Column | None = None, seed: int = 0
) -> DataFrame:
    """``k`` rows per key, uniform and repeatable: those with the smallest draws."""
    order = draw if draw is not None else F.xxhash64(F.col(row_key), F.lit(seed))
    with_draw = df.withColumn("_draw", order)
    return top_per_key(with_draw, list(keys), [F.asc("_draw"), F.asc(row_key)], k, [row_key]).drop("_draw")


def train_test_drift(train: DataFrame, test: DataFrame, features: Sequence[IntFeature]) -> DataFrame:
    """Differences (test − train) of null rate and value quantiles per feature."""
    keys, both = ["section", "fid"], {"train": train, "test": test}
    names = [percentile_name(p) for p in VALUE_PERCENTILES]

    def tagged(report: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return reduce(
            DataFrame.unionByName, [report(df).withColumn("side", F.lit(tag)) for tag, df in both.items()]
        )

    # the side is a key, so that both tables go through one count
    values = tagged(lambda df: primary_values(df, features, "first_nonzero"))
    spread = exact_quantiles(values, ["side", *keys], "v", [p / 100 for p in VALUE_PERCENTILES])
    nulls = tagged(lambda df: missing_rates(df, features)).select("side", *keys, "null_rate")
    told = nulls.join(named_quantiles(spread, VALUE_PERCENTILES), ["side", *keys], "left")

    def of(tag: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == tag, F.col(name)))

    return told.groupBy(*keys).agg(
        *[(of("test", c) - of("train", c)).alias(f"{c}_diff") for c in ["null_rate", "mean", *names]]
    )
