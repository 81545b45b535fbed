"""Ordered work inside a key that never puts a whole key into one task.

A key may hold a large share of all rows. Rows are therefore numbered per (key, time
slot) with offsets from slot totals, and windows run over bounded chunks of positions;
what a chunk needs from the one before it is passed on as a small summary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.functions.clock import floor_div

SECOND_ROUND_ROWS = 4_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, where a null key equals a null key; ``keys`` come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def number_rows(
    df: DataFrame, key: str, time: str, ties: Sequence[str], name: str, slot_sec: int = 60
) -> DataFrame:
    """Add ``name``: 1-based position of each row inside ``key`` by (time, ties).

    A task sorts one ``slot_sec`` of one key; offsets have one row per key and used slot.
    """
    slotted = df.withColumn("_slot", floor_div(F.col(time), slot_sec))
    before = W.partitionBy(key).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(key, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(key, "_slot").orderBy(time, *ties)
    return (
        null_safe_join(slotted.withColumn("_local", F.row_number().over(inside)), offsets, [key, "_slot"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_slot", "_local", "_offset")
    )


def preceding_lists(
    df: DataFrame,
    key: str,
    time: str,
    ties: Sequence[str],
    lists: dict[str, Column],
    look_back: int,
    chunk_rows: int = 1 << 16,
) -> DataFrame:
    """Per row, the non-null values of each expression over the ``look_back`` rows before it.

    Oldest first. Only the last ``look_back`` rows of a chunk are sent on to the next chunk.
    """
    if chunk_rows < look_back:
        raise ValueError("chunk_rows must be at least look_back")
    columns = df.columns
    numbered = number_rows(df, key, time, ties, "_pos").withColumn("_at", F.col("_pos") - 1)
    own = floor_div(F.col("_at"), chunk_rows)
    to_next = F.pmod(F.col("_at"), F.lit(chunk_rows)) >= chunk_rows - look_back
    spread = numbered.withColumn(
        "_target", F.explode(F.when(to_next, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = W.partitionBy(key, "_target").orderBy("_pos").rowsBetween(-look_back, -1)
    collected = [F.collect_list(expr).over(frame).alias(name) for name, expr in lists.items()]
    is_own = F.col("_target") == floor_div(F.col("_at"), chunk_rows)
    return (
        spread.select(*columns, *collected, is_own.alias("_own")).where("_own").drop("_own")
    )


def running(
    df: DataFrame,
    key: str,
    position: str,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    chunk_rows: int = 1 << 16,
) -> DataFrame:
    """Running ``max``, ``min`` or ``sum`` per key in order of a 1-based ``position``.

    ``values`` maps a new column to (function, expression). Exclusive means only earlier
    rows; the first row then gets null.
    """
    fold = {"max": F.max, "min": F.min, "sum": F.sum}
    merge = {
        "max": F.greatest,
        "min": F.least,
        "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        ),
    }
    chunked = df.select(
        "*",
        floor_div(F.col(position) - 1, chunk_rows).alias("_chunk"),
        *[expr.alias(f"_v_{name}") for name, (_, expr) in values.items()],
    )
    earlier = W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    summary = chunked.groupBy(key, "_chunk").agg(
        *[fold[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in values.items()]
    )
    carried = summary.select(
        key,
        "_chunk",
        *[fold[kind](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    )
    frame = (
        W.partitionBy(key, "_chunk")
        .orderBy(position)
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    ran = chunked.select(
        *df.columns,
        "_chunk",
        *[fold[kind](f"_v_{name}").over(frame).alias(f"_r_{name}") for name, (kind, _) in values.items()],
    )
    joined = null_safe_join(ran, carried, [key, "_chunk"])
    return joined.select(
        *df.columns,
        *[
            merge[kind](F.col(f"_c_{name}"), F.col(f"_r_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_on: Sequence[str],
    rank: str | None = None,
    salts: int | None = None,
) -> DataFrame:
    """First ``k`` rows per key: a hot key is first cut down in many parts.

    The number of parts is chosen so that the last round gets at most some million rows of a key. Where ``k`` is
    too large for that, parts are merged by fours in rounds of their own, and the last one gets at most 4 k rows.
    """
    salts = salts or max(16, min(4096, SECOND_ROUND_ROWS // max(k, 1)))
    rounds = [salts]
    while rounds[-1] > 4 and rounds[-1] * k > SECOND_ROUND_ROWS:
        rounds.append(-(-rounds[-1] // 4))
    kept = df
    for parts in rounds:
        salt = F.pmod(F.xxhash64(*spread_on), F.lit(parts)).alias("_salt")
        inside = W.partitionBy(*keys, "_salt").orderBy(*order)
        kept = (
            kept.select("*", salt)
            .withColumn("_rank", F.row_number().over(inside))
            .where(F.col("_rank") <= k)
            .drop("_rank", "_salt")
        )
    whole = W.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    ranked = kept.withColumn(name, F.row_number().over(whole).cast("bigint")).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)
