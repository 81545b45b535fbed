"""Derived dense blocks. Each function returns the block as a list of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrow.functions.clock import day_number, hour_of_day, weekday
from tallyrow.functions.sequences import time_range
from tallyrow.plans.fixed import LOCAL_OFFSET


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def _wave(value: Column, period: float) -> list[Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return [F.sin(angle), F.cos(angle)]


def nonzero_count(scalars: Sequence[Column], lists: Sequence[Column] = ()) -> Column:
    """Number of non-zero slots over scalar ids and (padded) id lists."""
    parts = [(c != 0).cast("bigint") for c in scalars]
    parts += [F.size(F.filter(c, lambda x: x != 0)).cast("bigint") for c in lists]
    total = F.lit(0).cast("bigint")
    for part in parts:
        total = total + part
    return total


def count_block(user_nonzero: Column, item_nonzero: Column) -> list[Column]:
    return [F.log1p(user_nonzero.cast("double")), F.log1p(item_nonzero.cast("double"))]


def seq_stats_block(length: Column, ts_list: Column | None, max_len: int) -> list[Column]:
    """log1p of the model length and of the covered time range."""
    spread = F.lit(0).cast("bigint") if ts_list is None else time_range(ts_list, max_len)
    return [F.log1p(length.cast("double")), F.log1p(spread.cast("double"))]


def hour_block(ts: Column) -> list[Column]:
    return _wave(hour_of_day(ts), 24)


def time_of_day_block(ts: Column) -> list[Column]:
    """UTC hour and weekday waves, weekend flag."""
    dow = weekday(ts)
    return hour_block(ts) + _wave(dow, 7) + [_flag(dow >= 5)]


def local_time_block(ts: Column, offset: int = LOCAL_OFFSET) -> list[Column]:
    """Local 24 h and 12 h waves, weekday wave, weekend/workday, 09-14 and 06-08 flags."""
    hour, dow = hour_of_day(ts, offset), weekday(ts, offset)
    return [
        *_wave(hour, 24),
        *_wave(hour, 12),
        *_wave(dow, 7),
        _flag(dow >= 5),
        _flag(dow < 5),
        _flag(hour.between(9, 14)),
        _flag(hour.between(6, 8)),
    ]


def local_time_v2_block(
    ts: Column, target_day: int, festival_day: int, offset: int = LOCAL_OFFSET
) -> list[Column]:
    """Distance to a target date and to the 09-14 window, date flags, five dayparts."""
    day, hour = day_number(ts, offset), hour_of_day(ts, offset)
    days = F.greatest(F.least(F.lit(target_day) - day, F.lit(7)), F.lit(-7)).cast("double")
    outside = F.when(hour < 9, 9 - hour).when(hour > 14, hour - 14).otherwise(F.lit(0))
    centred = F.pmod(hour.cast("double") - F.lit(11.5) + F.lit(12.0), F.lit(24.0)) - F.lit(12.0)
    on_target, in_window = _flag(day == target_day), _flag(hour.between(9, 14))
    return [
        days / 7.0,
        F.abs(days) / 7.0,
        _flag(day == festival_day),
        on_target,
        _flag(day < festival_day),
        _flag(day > target_day),
        F.least(outside, F.lit(12)).cast("double") / 12.0,
        centred / 12.0,
        _flag(hour < 6),
        _flag(hour.between(6, 8)),
        in_window,
        _flag(hour.between(15, 20)),
        _flag(hour > 20),
        on_target * in_window,
    ]
