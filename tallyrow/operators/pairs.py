"""Association between encoded columns: contingency counts, Cramér's V, mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.functions.cleaning import binary_label, clean_id, clean_list, head, primary_first_slot
from tallyrow.operators.assemble import code_tables, encode
from tallyrow.plans.features import IntFeature, is_list
from tallyrow.session import materialize

PAIRS_PER_PASS = 64
BLOCK_ROWS = 1 << 17


def encoded(
    df: DataFrame, features: Sequence[IntFeature], cap: int | None = 256
) -> tuple[DataFrame, dict[str, int], list[str]]:
    """Each feature as codes below ``cap``, the number of codes per column, and the folded columns.

    Null and negative ids count as 0. Lists are cut to their dim and reduced to slot 0 of rows
    with any non-zero slot, else 0. Adds ``label``. A column of more than ``cap`` values is folded
    by a hash; ``cap`` None keeps the ids themselves. The source is read once, the codes are stored.
    """

    def value(f: IntFeature) -> Column:
        if not is_list(df, f.column):
            return clean_id(F.col(f.column))
        kept = clean_list(head(F.col(f.column), f.dim))
        return F.coalesce(primary_first_slot(kept), F.lit(0).cast("bigint"))

    columns = [f.column for f in features]
    plain = materialize(
        df.select(
            *[F.coalesce(value(f), F.lit(0)).cast("bigint").alias(f.column) for f in features],
            binary_label(F.col("label_type")).alias("label"),
        )
    )
    if cap is None:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))
        counts = plain.select(cells.alias("p")).select("p.*").distinct().groupBy("c").count()
        return plain, {r["c"]: r["count"] for r in counts.collect()}, []
    tables = code_tables(plain, columns, cap)
    coded = plain.select(*[encode(c, tables.get(c), cap).cast("int").alias(c) for c in columns], "label")
    sizes = {c: len(tables[c]) if c in tables else cap for c in columns}
    return materialize(coded), sizes, [c for c in columns if c not in tables]


def _named(cells: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    def name(side: int) -> Column:
        return F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair"))

    return cells.select(name(0).alias("a"), name(1).alias("b"), "code_a", "code_b", "n")


def block_cells(codes: np.ndarray, pairs: Sequence[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Non-empty cells (pair, code_a, code_b, n) of all pairs of rows of a block of codes, one row a column."""
    found = []
    width = codes.max(axis=1).astype(np.int64) + 1
    for i, (a, b) in enumerate(pairs):
        n = np.bincount(codes[a] * width[b] + codes[b], minlength=1)
        cells = np.flatnonzero(n)
        found.append((np.full(len(cells), i, np.int32), cells // width[b], cells % width[b], n[cells]))
    return tuple(np.concatenate(x) for x in zip(*found))


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str]], folded: bool = True) -> DataFrame:
    """Non-empty cells (a, b, code_a, code_b, n) of all pairs.

    The codes are read once: tasks take blocks of BLOCK_ROWS rows as columns and count every pair of columns in place, so rows are not multiplied;
    what is shuffled are the blocks' non-empty cells. ``folded`` False is for codes without a bound (exact ids), where each row yields one cell a pair.
    Codes are whole numbers from 0, without null.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, code_a bigint, code_b bigint, n bigint")
    if not folded:
        return _named(_exploded_cells(df, pairs), pairs)
    columns = sorted({c for p in pairs for c in p})
    places = [(columns.index(a), columns.index(b)) for a, b in pairs]

    def count(batches):
        pending, held = [], 0

        def cells():
            block = np.concatenate(pending, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in block_cells(block, places)], ["pair", "code_a", "code_b", "n"])

        for batch in batches:
            pending.append(np.stack([np.asarray(batch.column(i)) for i in range(len(columns))]).astype(np.int64))
            held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield cells()
                pending, held = [], 0
        if held:
            yield cells()

    counted = df.select(*[F.col(c).cast("bigint").alias(c) for c in columns]).mapInArrow(count, "pair int, code_a bigint, code_b bigint, n bigint")
    return _named(counted.groupBy("pair", "code_a", "code_b").agg(F.sum("n").alias("n")), pairs)


def _exploded_cells(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, code_a, code_b, n), a row of ``df`` once for each pair, in passes that bound the state."""
    numbered = list(enumerate(pairs))
    passes = [numbered[i : i + PAIRS_PER_PASS] for i in range(0, len(numbered), PAIRS_PER_PASS)]

    def one(batch: Sequence[tuple[int, tuple[str, str]]]) -> DataFrame:
        cells = [
            F.struct(
                F.lit(i).alias("pair"),
                F.col(a).cast("bigint").alias("code_a"),
                F.col(b).cast("bigint").alias("code_b"),
            )
            for i, (a, b) in batch
        ]
        return (
            df.select(F.explode(F.array(*cells)).alias("c"))
            .select("c.*")
            .groupBy("pair", "code_a", "code_b")
            .agg(F.count(F.lit(1)).alias("n"))
        )

    return reduce(DataFrame.unionByName, [one(p) for p in passes])


def association(cells: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Cramér's V and mutual information (nats) per pair from its non-empty cells.

    Margins are aggregates joined back, so a pair with many cells does not sit in one task.
    """
    cells = materialize(cells)

    def margin(name: str, *keys: str) -> DataFrame:
        return cells.groupBy("a", "b", *keys).agg(F.sum("n").alias(name))

    margins = (
        cells.join(margin("n_a", "code_a"), ["a", "b", "code_a"])
        .join(margin("n_b", "code_b"), ["a", "b", "code_b"])
        .join(margin("total"), ["a", "b"])
    )
    n, n_a, n_b, total = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "total"))
    stats = margins.groupBy("a", "b").agg(
        F.first("total").alias("n_rows"),
        F.sum(n * n / (n_a * n_b)).alias("_ratio"),
        F.sum(n / total * F.log(n * total / (n_a * n_b))).alias("mi"),
    )
    size = F.create_map(*[F.lit(x) for c, v in sizes.items() for x in (c, v)])
    v_a, v_b = size[F.col("a")].cast("bigint"), size[F.col("b")].cast("bigint")
    dof = F.greatest(F.least(v_a, v_b) - 1, F.lit(1))
    share = F.greatest(F.col("_ratio") - 1, F.lit(0.0)) / dof
    return stats.select(
        "a", "b", v_a.alias("v_a"), v_b.alias("v_b"), "n_rows", F.sqrt(share).alias("cramers_v"), "mi"
    )


def user_user_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pairwise(
    df: DataFrame,
    features: Sequence[IntFeature],
    pairs: Sequence[tuple[str, str]],
    cap: int | None = 256,
    top: int | None = 50,
) -> DataFrame:
    """All pairs, strongest Cramér's V first; ``top`` None keeps all. ``folded``: a column was hashed."""
    used = {c for p in pairs for c in p}
    coded, sizes, folded = encoded(df, [f for f in features if f.column in used], cap)
    measured = association(contingency(coded, pairs, cap is not None), sizes)
    hashed = F.col("a").isin(folded) | F.col("b").isin(folded) if folded else F.lit(False)
    ranked = measured.withColumn("folded", hashed).orderBy(F.desc(F.round("cramers_v", 9)), "a", "b")
    return ranked if top is None else ranked.limit(top)


def label_mi(df: DataFrame, features: Sequence[IntFeature], cap: int | None = 256) -> DataFrame:
    """Mutual information of each feature with the conversion label."""
    coded, sizes, _folded = encoded(df, features, cap)
    cells = contingency(coded, [(f.column, "label") for f in features], cap is not None)
    result = association(cells, {**sizes, "label": 2})
    return result.select(F.col("a").alias("column_name"), F.col("v_a").alias("v"), "mi").orderBy(
        F.desc(F.round("mi", 9)), "column_name"
    )
