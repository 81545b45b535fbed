"""Cleaned id columns, out-of-range accounting, code tables and flat feature vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.functions.cleaning import (
    clean_and_clip,
    hash_bucket,
    head,
    is_missing,
    log1p_list,
    pad_floats,
    pad_ints,
    route_missing,
)
from tallyrow.functions.sequences import seq_head
from tallyrow.operators.ranks import number_array
from tallyrow.plans.features import FeaturePlan, IntFeature, is_list
from tallyrow.plans.fixed import LOG1P_DENSE_FIDS


def routed_fids(plan: FeaturePlan, user: Iterable[int] | None = None, item: Iterable[int] = ()) -> list[IntFeature]:
    """Scalar features whose missing ids get a slot; by default all of the user side."""
    chosen_user = {f.fid for f in plan.user_int} if user is None else set(user)
    chosen_item = set(item)
    out = [f for f in plan.user_int if f.dim == 1 and f.fid in chosen_user]
    return out + [f for f in plan.item_int if f.dim == 1 and f.fid in chosen_item]


def skipped_fids(plan: FeaturePlan, user: Iterable[int] = (), item: Iterable[int] = ()) -> list[int]:
    """Requested fids that are unknown or not scalar and therefore not routed."""
    known = {f.fid for f in routed_fids(plan, user, item)}
    return sorted((set(user) | set(item)) - known)


def cleaned_int(feature: IntFeature, as_list: bool, routed: bool = False) -> Column:
    column = F.col(feature.column)
    if as_list:
        return pad_ints(column, feature.dim, feature.vocab)
    return route_missing(column, feature.vocab) if routed else clean_and_clip(column, feature.vocab)


def clean_ids(df: DataFrame, plan: FeaturePlan, routed: Sequence[IntFeature] = ()) -> DataFrame:
    """Replace all id columns by their cleaned form; lists are padded to their dim."""
    names = {f.column for f in routed}
    return df.withColumns(
        {
            f.column: cleaned_int(f, is_list(df, f.column), f.column in names)
            for f in plan.int_features()
            if f.column in df.columns
        }
    )


def clean_sequences(df: DataFrame, plan: FeaturePlan, disabled: Iterable[int] = ()) -> DataFrame:
    """Truncate and clean all side lists; those of ``disabled`` fids become zeros."""
    off = set(disabled)
    columns = {}
    for domain in plan.domains:
        for fid in domain.side_fids:
            vocab = 0 if fid in off else domain.vocabs[fid]
            columns[domain.column(fid)] = seq_head(F.col(domain.column(fid)), domain.max_len, vocab)
    return df.withColumns(columns)


def _at_least(values: Column, vocab: int) -> Column:
    return F.filter(values, lambda x: x >= F.lit(vocab))


def oob_stats(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Columns with ids at or above their vocab: count, smallest, largest, vocab."""
    targets = [(f.column, f.vocab, f.dim) for f in plan.int_features() if f.vocab > 0]
    targets += [
        (d.column(fid), d.vocabs[fid], d.max_len) for d in plan.domains for fid in d.side_fids if d.vocabs[fid] > 0
    ]
    parts = []
    for column, vocab, dim in targets:
        if column not in df.columns:
            continue
        values = head(F.col(column), dim) if is_list(df, column) else F.array(F.col(column))
        bad = _at_least(values, vocab)
        parts.append(
            F.struct(
                F.lit(column).alias("column_name"),
                F.coalesce(F.sum(F.when(bad.isNotNull(), F.size(bad))), F.lit(0)).cast("bigint").alias("oob_count"),
                F.min(F.array_min(bad)).cast("bigint").alias("min_oob"),
                F.max(F.array_max(bad)).cast("bigint").alias("max_oob"),
                F.lit(vocab).cast("bigint").alias("vocab"),
            )
        )
    wide = df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    long = wide.select(F.explode(F.array(*[f"c{i}" for i in range(len(parts))])).alias("s")).select("s.*")
    return long.where("oob_count > 0")


def require_in_range(df: DataFrame, plan: FeaturePlan) -> None:
    """Strict mode: raise when any id is out of range."""
    worst = oob_stats(df, plan).orderBy("column_name").first()
    if worst is not None:
        raise ValueError(
            f"{worst.column_name}: {worst.oob_count} ids outside [0, {worst.vocab}), "
            f"found {worst.min_oob} to {worst.max_oob}"
        )


def missing_bitmap(routed: Sequence[IntFeature]) -> list[Column]:
    """One 0/1 flag per feature, user before item, fids ascending. Reads the raw columns."""
    ordered = sorted(routed, key=lambda f: (f.section != "user_int", f.fid))
    return [is_missing(F.col(f.column)) for f in ordered]


def code_tables(df: DataFrame, columns: Sequence[str], cap: int) -> dict[str, list[int]]:
    """Sorted distinct values of those columns that have at most ``cap``; null counts as 0.

    A first pass counts distinct residues, which bounds what it shuffles; a column with
    more residues than ``cap`` has more values too. Only the rest is looked at exactly.
    """

    def distinct(names: Sequence[str], fold) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("c"), fold(F.coalesce(F.col(c), F.lit(0)).cast("bigint")).alias("v"))
            for c in names
        ]
        return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()

    residues = distinct(columns, lambda v: F.pmod(F.xxhash64(v), F.lit(64 * cap)))
    few = [r.c for r in residues.groupBy("c").count().where(F.col("count") <= cap).collect()]
    if not few:
        return {}
    exact = distinct(few, lambda v: v)
    # first cap + 1 values decide; anything longer is left to hashing
    small = exact.groupBy("c").count().where(F.col("count") <= cap).select("c")
    tables: dict[str, list[int]] = {}
    for row in exact.join(small, "c", "left_semi").collect():
        tables.setdefault(row.c, []).append(row.v)
    return {c: sorted(v) for c, v in tables.items()}


def encode(column: str, table: Sequence[int] | None, cap: int) -> Column:
    """Dense code in value order when a table exists, else a hash bucket."""
    value = F.coalesce(F.col(column), F.lit(0)).cast("bigint")
    if table is None:
        return hash_bucket(value, cap)
    # halving search among the sorted values; every value of the column is one of them
    codes, steps = number_array(table), [1 << i for i in reversed(range(len(table).bit_length()))]
    found = F.aggregate(
        number_array(steps),
        F.lit(0).cast("bigint"),
        lambda at, step: F.when(F.get(codes, (at + step - 1).cast("int")) < value, at + step).otherwise(at),
    )
    return found.cast("bigint")


def assemble_ints(df: DataFrame, features: Sequence[IntFeature]) -> Column:
    """Scalars and padded lists of one side, one after the other (on cleaned columns)."""
    parts = [F.col(f.column) if is_list(df, f.column) else F.array(f.column) for f in features]
    return F.concat(*parts)


def int_layout(features: Sequence[IntFeature]) -> list[tuple[int, int, int]]:
    """(fid, offset, length) of :func:`assemble_ints`."""
    return _layout([(f.fid, f.dim) for f in features])


def _layout(parts: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    out, offset = [], 0
    for fid, length in parts:
        out.append((fid, offset, length))
        offset += length
    return out


DenseBlock = tuple[int, int, Column]


def raw_dense_blocks(plan: FeaturePlan, log1p_fids: Iterable[int] = LOG1P_DENSE_FIDS) -> list[DenseBlock]:
    scaled = set(log1p_fids)
    blocks = []
    for f in plan.user_dense:
        padded = pad_floats(F.col(f.column), f.dim)
        blocks.append((f.fid, f.dim, log1p_list(padded) if f.fid in scaled else padded))
    return blocks


def block(fid: int, columns: Sequence[Column]) -> DenseBlock:
    return fid, len(columns), F.array(*[c.cast("double") for c in columns])


def assemble_dense(blocks: Sequence[DenseBlock]) -> tuple[Column, list[tuple[int, int, int]]]:
    """The flat vector and its layout, both from the same list, so they cannot disagree."""
    return F.concat(*[b[2] for b in blocks]), _layout([(fid, dim) for fid, dim, _ in blocks])
