"""Calendar arithmetic on integer epoch seconds (no session time zone involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrow.plans.fixed import DAY, DAYPARTS, HOUR, LOCAL_OFFSET


def floor_div(value: Column, by: int) -> Column:
    """Floored integer division as bigint."""
    return F.floor(value / F.lit(by)).cast("bigint")


def day_number(ts: Column, offset: int = 0) -> Column:
    return floor_div(ts + F.lit(offset), DAY)


def second_of_day(ts: Column, offset: int = 0) -> Column:
    return F.pmod(ts + F.lit(offset), F.lit(DAY)).cast("bigint")


def hour_of_day(ts: Column, offset: int = 0) -> Column:
    return floor_div(second_of_day(ts, offset), HOUR)


def weekday(ts: Column, offset: int = 0) -> Column:
    """Monday 0 … Sunday 6."""
    return F.pmod(day_number(ts, offset) + F.lit(3), F.lit(7)).cast("bigint")


def date_text(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")


def clock_text(ts: Column, offset: int = 0) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of epoch seconds shifted by ``offset``."""
    sec = second_of_day(ts, offset)
    return F.format_string(
        "%s %02d:%02d:%02d",
        date_text(day_number(ts, offset)),
        floor_div(sec, HOUR),
        F.pmod(floor_div(sec, 60), F.lit(60)),
        F.pmod(sec, F.lit(60)),
    )


def daypart(ts: Column, offset: int = LOCAL_OFFSET) -> Column:
    hour = hour_of_day(ts, offset)
    expr = F
    for name, first, last in DAYPARTS:
        expr = expr.when(hour.between(first, last), F.lit(name))
    return expr
