"""Exact order statistics without sorting everything.

Approximate cut points split each key's values into ranges of similar weight; counting the
ranges tells which of them hold the wanted ranks, and only those are looked at value by
value. Apart from those few ranges nothing but counts is shuffled.

Whole numbers (seconds, ids, lengths) repeat, so their input is read once: rows are counted
per value first, with partial aggregation, and the steps above run over the stored counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyrow.functions.search import with_count_below
from tallyrow.session import materialize

CUTS = 256


def cut_points(value: str, cuts: int) -> Column:
    """``cuts`` - 1 sorted values that split ``value`` into parts of similar weight."""
    shares = ", ".join(f"{i / cuts!r}D" for i in range(1, cuts))
    return F.expr(f"percentile_approx(`{value}`, array({shares}), {4 * cuts})")


def grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregate per key, or over everything when there are no keys."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def number_array(values: Sequence[float]) -> Column:
    """A literal array of numbers, built in one call."""

    def text(v: float) -> str:
        if isinstance(v, int):
            return f"{v}L"
        return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"

    return F.expr(f"array({', '.join(map(text, values))})")


def held(table: DataFrame, keys: Sequence[str]) -> DataFrame | dict[str, Column]:
    """Keep a small per-key table for several uses: written out, or one row as literals."""
    if keys:
        return materialize(table)
    row = table.first()
    if row is None:
        return {}

    def literal(name: str) -> Column:
        value = row[name]
        column = number_array(value) if isinstance(value, list) and value else F.lit(value)
        return column.cast(table.schema[name].dataType)

    return {name: literal(name) for name in table.columns}


def attach(
    df: DataFrame, table: DataFrame | dict[str, Column], keys: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Add columns of a held table: by equi-join on the keys, or as literals."""
    if isinstance(table, DataFrame):
        return df.join(table.select(*keys, *names), list(keys))
    return df.withColumns({name: table[name] for name in names})


def summaries(df: DataFrame, keys: Sequence[str], value: str, cuts: int = CUTS) -> DataFrame:
    """Per key: n, mean, min, max and sorted cut points. One pass with bounded state.

    A row stands for ``_w`` equal values.
    """
    return grouped(
        df,
        keys,
        F.coalesce(F.sum("_w"), F.lit(0)).alias("n"),
        (F.sum(F.col(value).cast("double") * F.col("_w")) / F.sum("_w")).alias("mean"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        cut_points(value, cuts).alias("_cuts"),
    ).where("n > 0")


def select_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    cuts: int = CUTS,
) -> DataFrame:
    """Values at 0-based ``ranks`` of each key's sorted values.

    ``ranks`` gets the row count and returns an array of ranks. The result has the keys, n,
    mean, min, max, ``picked``, the values in the order of the ranks, and for whole numbers
    ``n_distinct``. Nulls are left out.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    counted_first = isinstance(df.schema[value].dataType, IntegralType)
    if counted_first:
        rows = materialize(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w")))
    else:
        rows = rows.withColumn("_w", F.lit(1).cast("bigint"))
    table = summaries(rows, keys, value, cuts).withColumn("_ranks", ranks(F.col("n")).cast("array<bigint>"))
    summary = held(table, keys)
    told = ["n", "mean", "min", "max", *(["n_distinct"] if counted_first else [])]
    output = [*keys, *told]
    if not keys and not summary:
        return table.select(*output, F.array(F.col("min")).alias("picked"))
    bucketed = with_count_below(
        attach(rows, summary, keys, ["_cuts"]), value, "_cuts", cuts, "_bucket"
    ).drop("_cuts")
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_n"))
    totals = attach(
        counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))), summary, keys, ["_ranks"]
    )
    wanted = materialize(
        totals.select(
            *keys,
            "_bucket",
            "_start",
            F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_n"))).alias("_here"),
        ).where(F.size("_here") > 0)
    )
    counted = (
        bucketed.join(wanted.select(*keys, "_bucket"), [*keys, "_bucket"], "left_semi")
        .groupBy(*keys, "_bucket", value)
        .agg(F.sum("_w").alias("_n"))
    )
    upto = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    hits = (
        counted.withColumn("_upto", F.sum("_n").over(upto))
        .join(wanted, [*keys, "_bucket"])
        .withColumn("_end", F.col("_start") + F.col("_upto"))
        .select(
            *keys,
            value,
            F.explode(
                F.filter(
                    F.array_distinct("_here"), lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n"))
                )
            ).alias("_rank"),
        )
    )
    found = grouped(
        hits, keys, F.map_from_entries(F.collect_list(F.struct("_rank", F.col(value)))).alias("_at")
    )
    return attach(found, summary, keys, [*told, "_ranks"]).select(
        *output, F.transform("_ranks", lambda r: F.try_element_at(F.col("_at"), r)).alias("picked")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], cuts: int = CUTS, distinct: bool = False
) -> DataFrame:
    """Linearly interpolated quantiles per key as ``quantiles`` (array in order of ``shares``).

    ``distinct`` keeps ``n_distinct``, which whole numbers come with.
    """

    wanted = number_array([float(s) for s in shares])

    def place(share: Column, n: Column) -> Column:
        return share * (n - 1)

    def bounds(n: Column) -> Column:
        return F.flatten(F.transform(wanted, lambda s: F.array(F.floor(place(s, n)), F.ceil(place(s, n)))))

    def point(share: Column, i: Column) -> Column:
        low, high = (F.get(F.col("picked"), 2 * i + offset) for offset in (0, 1))
        at = place(share, F.col("n"))
        return (low + (high - low) * (at - F.floor(at))).cast("double")

    picked = select_ranks(df, keys, value, bounds, cuts)
    unasked = [] if distinct else ["n_distinct"]
    return picked.withColumn("quantiles", F.transform(wanted, point)).drop("picked", *unasked)


def narrow_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]
) -> DataFrame:
    """Same result for values with a bounded domain (lengths, hours): count, then weigh."""
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.percentile(F.col(value), F.array(*[F.lit(float(s)) for s in shares]), F.col("_n")).alias("quantiles"),
    )
