"""Rows in time windows, where the windows are a table of any length.

A window of length n lies in at most two bins of 2 ** k seconds for the least 2 ** k >= n. Rows meet windows by an equi-join on (k, bin), once for
each k in use, and an exact test follows; the cost is rows times the number of k (63 at most) plus the matches, whatever the number of windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrow.operators.splits import filter_time
from tallyrow.session import materialize


def binned_windows(windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The windows with ``_level`` and ``_bin``, one row for each of the one or two bins they touch."""
    length = F.col(end) - F.col(start)
    # the bit length of length - 1
    level = F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))
    leveled = windows.withColumn("_level", level.cast("int"))
    first, last = F.expr(f"shiftright(`{start}`, _level)"), F.expr(f"shiftright(`{end}` - 1, _level)")
    return leveled.withColumn("_bin", F.explode(F.sequence(first, last)))


def checked_windows(windows: DataFrame, start: str = "start", end: str = "end") -> tuple[DataFrame, int | None, int | None]:
    """The windows, stored once, their first start and their last end; one without an end or a positive length is a ValueError."""
    windows = materialize(windows)
    bad = F.col(start).isNull() | F.col(end).isNull() | (F.col(end) <= F.col(start))
    low, high, broken = windows.agg(F.min(start), F.max(end), F.count_if(bad)).first()
    if broken:
        raise ValueError(f"{broken} windows without a start, an end or a length")
    return windows, low, high


def window_join(df: DataFrame, windows: DataFrame, ts: str = "timestamp", start: str = "start", end: str = "end") -> DataFrame:
    """Each row of ``df`` with each window that has ``start <= ts < end``; all columns of both.

    A row in several windows comes out once for each, a row in none or without a time not at all. Windows need both ends and a positive length,
    else ValueError; equal windows count each. A column of both is an error.
    """
    both = {c.lower() for c in df.columns} & {c.lower() for c in windows.columns}
    if both:
        raise ValueError(f"columns of rows and windows: {sorted(both)}")
    windows, low, high = checked_windows(windows, start, end)
    binned = materialize(binned_windows(windows, start, end))
    levels = sorted(r[0] for r in binned.select("_level").distinct().collect())
    if levels:
        df = filter_time(df, low, high, ts)
    at = F.array(*[F.struct(F.lit(k).alias("_k"), F.shiftright(F.col(ts).cast("bigint"), k).alias("_b")) for k in levels]) if levels else F.array().cast(
        "array<struct<_k:int,_b:bigint>>"
    )
    rows = df.select("*", F.explode(at).alias("_at"))
    on = (F.col("_at._k") == F.col("_level")) & (F.col("_at._b") == F.col("_bin")) & (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    return rows.join(binned, on).drop("_at", "_level", "_bin")
