"""Time-aware splits. Cut points are literals, so the row filters reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.operators.ranks import select_ranks
from tallyrow.plans.windows import TimeWindow, checked_windows


def filter_time(df: DataFrame, lo: int | None = None, hi: int | None = None, column: str = "timestamp") -> DataFrame:
    """Rows with ``lo <= column < hi``; either bound may be left out."""
    if lo is not None and hi is not None and lo >= hi:
        raise ValueError(f"empty time range [{lo}, {hi})")
    if lo is not None:
        df = df.where(F.col(column) >= F.lit(lo))
    if hi is not None:
        df = df.where(F.col(column) < F.lit(hi))
    return df


def _share(n: Column, ratio: float) -> Column:
    """max(1, n · ratio with the fraction dropped)."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio)))).cast("bigint")


def _check_ratio(name: str, ratio: float) -> None:
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"{name} must be in (0, 1), got {ratio}")


def row_cutoff(df: DataFrame, valid_ratio: float, column: str = "timestamp") -> int:
    """Timestamp at which the latest ``valid_ratio`` of the rows starts; ties go to validation."""
    _check_ratio("valid_ratio", valid_ratio)
    row = select_ranks(df, [], column, lambda n: F.array(n - _share(n, valid_ratio))).first()
    if row is None:
        raise ValueError("no timestamps to split")
    return row.picked[0]


def row_gap_cutoffs(
    df: DataFrame, valid_ratio: float, gap_ratio: float, column: str = "timestamp"
) -> tuple[int, int]:
    """Start of the dropped gap and of validation.

    When equal timestamps make both cuts coincide, the cuts are taken again on the axis of
    distinct timestamps.
    """
    _check_ratio("valid_ratio", valid_ratio)
    _check_ratio("gap_ratio", gap_ratio)

    def cuts(n: Column) -> Column:
        valid = n - _share(n, valid_ratio)
        return F.array(F.greatest(valid - _share(n, gap_ratio), F.lit(0)), valid)

    row = select_ranks(df, [], column, cuts).first()
    if row is None:
        raise ValueError("no timestamps to split")
    if max(1, int(row.n * valid_ratio)) + max(1, int(row.n * gap_ratio)) >= row.n:
        raise ValueError("validation and gap take all rows")
    gap, valid = row.picked
    if gap < valid:
        return gap, valid
    distinct = df.where(F.col(column).isNotNull()).select(column).distinct()
    u = distinct.count()
    if u < 3:
        raise ValueError(f"need 3 distinct timestamps, found {u}")
    gap_at = max(0, u - max(2, int(u * (valid_ratio + gap_ratio))))
    valid_at = min(max(gap_at + 1, u - max(1, int(u * valid_ratio))), u - 1)
    gap, valid = select_ranks(distinct, [], column, lambda n: F.array(F.lit(gap_at), F.lit(valid_at))).first().picked
    if gap >= valid:
        raise ValueError("timestamps do not allow three slices")
    return gap, valid


def role_by_cutoff(ts: Column, cutoff: int) -> Column:
    return F.when(ts < F.lit(cutoff), "train").otherwise("valid")


def role_by_gap(ts: Column, gap_start: int, valid_start: int) -> Column:
    return F.when(ts < F.lit(gap_start), "train").when(ts < F.lit(valid_start), "gap").otherwise("valid")


@dataclass(frozen=True)
class FixedSplit:
    """Validation ``[valid_min, valid_max)``; training ends at ``train_max`` at the latest."""

    valid_min: int
    valid_max: int
    train_max: int | None = None
    train_min: int | None = None

    def __post_init__(self):
        if self.valid_max <= self.valid_min:
            raise ValueError("validation must end after it starts")
        if self.train_end > self.valid_min:
            raise ValueError("training must end before validation starts")
        if self.train_min is not None and self.train_min >= self.train_end:
            raise ValueError("training range is empty")

    @property
    def train_end(self) -> int:
        return self.valid_min if self.train_max is None else self.train_max

    def train(self, df: DataFrame) -> DataFrame:
        return filter_time(df, self.train_min, self.train_end)

    def valid(self, df: DataFrame) -> DataFrame:
        return filter_time(df, self.valid_min, self.valid_max)

    def role(self, ts: Column) -> Column:
        in_train = ts < F.lit(self.train_end)
        if self.train_min is not None:
            in_train &= ts >= F.lit(self.train_min)
        in_valid = (ts >= F.lit(self.valid_min)) & (ts < F.lit(self.valid_max))
        return F.when(in_train, "train").when(in_valid, "valid")


def window_rows(df: DataFrame, windows: Sequence[TimeWindow], ts: str = "timestamp") -> DataFrame:
    """Rows with the ``window`` they fall into; a row in several windows comes out once for each.

    The windows are parameters, so they become literals of a projection: no join is needed.
    """
    windows = checked_windows(list(windows))
    names = F.array_compact(F.array(*[F.when(w.contains(F.col(ts)), F.lit(w.name)) for w in windows]))
    lo, hi = min(w.start for w in windows), max(w.end for w in windows)
    return filter_time(df, lo, hi, ts).select("*", F.explode(names).alias("window"))


def is_clean_window(window: TimeWindow, train_max: int) -> bool:
    """Clean when no training row is as late as the window's start."""
    return train_max <= window.start


def overlap_audit(df: DataFrame, role: str = "role", ts: str = "timestamp") -> DataFrame:
    """Time ranges of the roles and how far they overlap (0 or less is clean)."""

    def at(name: str, fn) -> Column:
        return fn(F.when(F.col(role) == name, F.col(ts)))

    ranges = df.agg(
        *[F.count(F.when(F.col(role) == r, 1)).alias(f"{r}_rows") for r in ("train", "gap", "valid", "holdout")],
        at("train", F.min).alias("train_min"),
        at("train", F.max).alias("train_max"),
        at("valid", F.min).alias("valid_min"),
        at("valid", F.max).alias("valid_max"),
        at("holdout", F.min).alias("holdout_min"),
    )
    return ranges.select(
        "*",
        (F.col("train_max") - F.col("valid_min")).alias("overlap_sec"),
        (F.col("valid_min") - F.col("train_max")).alias("train_to_valid_sec"),
        (F.col("valid_max") - F.col("holdout_min")).alias("valid_holdout_overlap_sec"),
    )
