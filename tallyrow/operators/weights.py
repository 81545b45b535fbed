"""Sample weights. Normalisers are scalars measured over the rows being weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.functions.clock import day_number, hour_of_day
from tallyrow.plans.fixed import DAY, LOCAL_OFFSET

_TINY = 1e-6


def mature_negative(ts: Column, label_type: Column, end_ts: int, maturity: int = DAY, weight: float = 0.0) -> Column:
    """``weight`` for non-conversions younger than ``maturity`` at ``end_ts``, else 1."""
    young = F.lit(end_ts) - ts < F.lit(maturity)
    return F.when((F.coalesce(label_type, F.lit(0)) != 2) & young, F.lit(float(weight))).otherwise(F.lit(1.0))


def recency(ts: Column, first: int, last: int, alpha: float) -> Column:
    if last <= first:
        return F.lit(1.0)
    share = (ts - F.lit(first)).cast("double") / F.lit(float(last - first))
    return F.exp(F.lit(float(alpha)) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def in_hours(ts: Column, first: int, last: int, offset: int = LOCAL_OFFSET) -> Column:
    """Whether the local hour is within ``[first, last]``, both included."""
    return hour_of_day(ts, offset).between(first, last)


def hours(ts: Column, first: int, last: int, multiplier: float) -> Column:
    return F.when(in_hours(ts, first, last), F.lit(float(multiplier))).otherwise(F.lit(1.0))


def on_day(ts: Column, day: int, first: int, last: int, offset: int = LOCAL_OFFSET) -> Column:
    return (day_number(ts, offset) == day) & in_hours(ts, first, last, offset)


def target_day_norm(df: DataFrame, ts: Column, day: int, first: int, last: int, multiplier: float) -> float:
    """1 + (multiplier - 1) · share of rows in the target window; one scalar job."""
    share = df.agg(F.avg(on_day(ts, day, first, last).cast("double"))).first()[0] or 0.0
    return 1.0 + (multiplier - 1.0) * share


def target_day(ts: Column, day: int, first: int, last: int, multiplier: float, norm: float) -> Column:
    raw = F.when(on_day(ts, day, first, last), F.lit(float(multiplier))).otherwise(F.lit(1.0))
    return raw / F.lit(max(norm, _TINY))


def ts_range(df: DataFrame, column: str = "timestamp") -> tuple[int, int]:
    row = df.agg(F.min(column), F.max(column)).first()
    if row[0] is None:
        raise ValueError("no rows to take a time range from")
    return row[0], row[1]


def normalised(df: DataFrame, weight: Column) -> Column:
    """``weight`` over its mean across ``df``; one scalar job."""
    mean = df.agg(F.avg(weight)).first()[0]
    return weight / F.lit(max(mean or 0.0, _TINY))


def product(*weights: Column) -> Column:
    total = F.lit(1.0)
    for weight in weights:
        total = total * weight
    return total
