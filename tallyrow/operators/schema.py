"""Feature catalog inferred from column names and one aggregation over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.functions.cleaning import list_size
from tallyrow.operators.ranks import exact_quantiles, narrow_quantiles
from tallyrow.plans.features import (
    ITEM_INT,
    USER_DENSE,
    USER_INT,
    ColumnRole,
    DenseFeature,
    FeaturePlan,
    IntFeature,
    SequenceDomain,
    column_roles,
)
from tallyrow.plans.fixed import DEFAULT_SEQ_LEN

# Thresholds of the derived catalog flags.
TIMESTAMP_FLOOR = 1_000_000_000
HIGH_VOCAB = 1_000_000
LOW_VOCAB = 256
TIER_LIMITS = (100, 2000)


def _values(role: ColumnRole) -> Column:
    column = F.col(role.column)
    return column.cast("array<bigint>") if role.is_list else F.array(column.cast("bigint"))


def _statistics(role: ColumnRole, floor: int) -> Column:
    """One struct of aggregates per column; no row is multiplied.

    For behaviour lists also the number of positive ids, how many exceed ``floor``, and the ids next to it.
    """
    none = F.lit(None).cast("bigint")
    n = above = low = high = none
    if role.letter:
        ids = F.filter(_values(role), lambda x: x > 0)
        late, early = F.filter(ids, lambda x: x > floor), F.filter(ids, lambda x: x <= floor)
        n, above = F.sum(list_size(ids)), F.sum(list_size(late))
        low, high = F.max(F.array_max(early)), F.min(F.array_min(late))
    top = F.max(F.array_max(_values(role))) if role.section != USER_DENSE else none
    length = F.max(list_size(F.col(role.column))) if role.is_list else F.lit(1)
    return F.struct(
        F.lit(role.section).alias("section"),
        F.lit(role.fid).cast("bigint").alias("fid"),
        top.cast("bigint").alias("top"),
        length.cast("bigint").alias("length"),
        *[c.cast("bigint").alias(k) for k, c in (("n", n), ("above", above), ("low", low), ("high", high))],
    )


def _late(floor: int) -> Column:
    """Whether the median of the positive ids exceeds ``floor``: half of them above, or the middle two around it."""
    twice = 2 * F.col("above")
    tie = (twice == F.col("n")) & ((F.col("low") + F.col("high")) / 2.0 > F.lit(float(floor)))
    return (twice > F.col("n")) | tie


def id_values(df: DataFrame, roles: list[ColumnRole]) -> DataFrame:
    """Long table (section, fid, id) of the positive ids of the given columns."""
    parts = [
        F.struct(
            F.lit(r.section).alias("section"), F.lit(r.fid).cast("bigint").alias("fid"), _values(r).alias("ids")
        )
        for r in roles
    ]
    return (
        df.select(F.explode(F.array(*parts)).alias("p"))
        .select("p.section", "p.fid", F.explode("p.ids").alias("id"))
        .where("id > 0")
    )


def list_lengths(df: DataFrame, roles: list[ColumnRole]) -> DataFrame:
    parts = [
        F.struct(
            F.lit(r.section).alias("section"),
            F.lit(r.fid).cast("bigint").alias("fid"),
            list_size(F.col(r.column)).cast("bigint").alias("length"),
        )
        for r in roles
        if r.is_list
    ]
    return df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def tier(vocab: Column) -> Column:
    small, mid = TIER_LIMITS
    return F.when(vocab <= small, "T_small").when(vocab <= mid, "T_mid").otherwise("T_large")


def infer_catalog(
    df: DataFrame,
    vocab_share: float = 1.0,
    dim_share: float = 1.0,
    ts_floor: int = TIMESTAMP_FLOOR,
) -> DataFrame:
    """One row per feature column: section, fid, vocab, dim, flags and tier.

    Shares below 1 use that quantile of the ids or lengths in place of the maximum.
    """
    roles = column_roles(df.schema)
    if not roles:
        raise ValueError("no feature columns found")
    wide = df.agg(*[_statistics(r, ts_floor).alias(f"c{i}") for i, r in enumerate(roles)])
    stats = wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(roles))])).alias("s")).select("s.*")
    vocab = F.when(F.col("top") > 0, F.col("top") + 1).otherwise(F.lit(1))
    dim = F.greatest(F.col("length"), F.lit(1))
    keys = ["section", "fid"]
    if vocab_share < 1.0:
        with_ids = [r for r in roles if r.section != USER_DENSE]
        cut = exact_quantiles(id_values(df, with_ids), keys, "id", [vocab_share])
        stats = stats.join(cut.select(*keys, F.get("quantiles", F.lit(0)).alias("_id")), keys, "left")
        vocab = F.coalesce(F.floor("_id").cast("bigint") + 1, F.lit(1))
    if dim_share < 1.0:
        cut = narrow_quantiles(list_lengths(df, roles), keys, "length", [dim_share])
        stats = stats.join(cut.select(*keys, F.get("quantiles", F.lit(0)).alias("_len")), keys, "left")
        dim = F.greatest(F.coalesce(F.floor("_len").cast("bigint"), F.lit(1)), F.lit(1))
    is_seq = F.col("section").startswith("seq_")
    stats = stats.withColumn("late", _late(ts_floor))
    # The first list of a domain that looks like timestamps is its time axis.
    first_ts = F.min(F.when(is_seq & F.col("late"), F.col("fid"))).over(W.partitionBy("section"))
    vocab = F.when(F.col("section") != USER_DENSE, vocab)
    return (
        stats.withColumn("is_ts", F.coalesce(F.col("fid") == first_ts, F.lit(False)))
        .select(
            "section",
            "fid",
            vocab.cast("bigint").alias("vocab"),
            F.when(~is_seq, dim).cast("bigint").alias("dim"),
            "is_ts",
            F.coalesce(is_seq & ~F.col("is_ts") & (vocab > HIGH_VOCAB), F.lit(False)).alias("is_high_vocab_seq"),
            F.coalesce(F.col("section").isin(USER_INT, ITEM_INT) & (vocab <= LOW_VOCAB), F.lit(False)).alias(
                "is_low_vocab_int"
            ),
            F.when(F.col("section").isin(USER_INT, ITEM_INT), tier(vocab)).alias("tier"),
        )
    )


def plan_from_catalog(catalog: DataFrame, max_lens: dict[str, int] | None = None) -> FeaturePlan:
    """Collect the catalog (one row per column) into a driver-side plan."""
    lens = max_lens or {}
    ints: dict[str, list[IntFeature]] = {USER_INT: [], ITEM_INT: []}
    dense: list[DenseFeature] = []
    vocabs: dict[str, dict[int, int]] = {}
    ts_fids: dict[str, int] = {}
    for row in catalog.orderBy("section", "fid").collect():
        if row.section in ints:
            ints[row.section].append(IntFeature(row.section, row.fid, row.vocab, row.dim))
        elif row.section == USER_DENSE:
            dense.append(DenseFeature(row.fid, row.dim))
        else:
            vocabs.setdefault(row.section, {})[row.fid] = row.vocab
            if row.is_ts:
                ts_fids[row.section] = row.fid
    domains = tuple(
        SequenceDomain(name.removeprefix("seq_"), vocabs[name], ts_fids.get(name), lens.get(name, DEFAULT_SEQ_LEN))
        for name in sorted(vocabs)
    )
    return FeaturePlan(tuple(ints[USER_INT]), tuple(ints[ITEM_INT]), tuple(dense), domains)


def infer_plan(df: DataFrame, max_lens: dict[str, int] | None = None, **shares: float) -> FeaturePlan:
    return plan_from_catalog(infer_catalog(df, **shares), max_lens)
