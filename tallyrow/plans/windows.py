"""Named half-open time windows given as parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrow.plans.fixed import DAY, LOCAL_OFFSET


@dataclass(frozen=True)
class TimeWindow:
    name: str
    start: int
    end: int
    note: str = ""

    def contains(self, ts: Column) -> Column:
        return (ts >= F.lit(self.start)) & (ts < F.lit(self.end))


def local_epoch(text: str, offset: int = LOCAL_OFFSET) -> int:
    """Epoch seconds of a local ``YYYY-MM-DD HH:MM:SS`` (or a bare date)."""
    layout = "%Y-%m-%d %H:%M:%S" if " " in text else "%Y-%m-%d"
    return int(datetime.strptime(text, layout).replace(tzinfo=timezone.utc).timestamp()) - offset


def local_day_number(date: str) -> int:
    """Days since 1970-01-01 of a local calendar date."""
    return local_epoch(date, 0) // DAY


def checked_windows(windows: list[TimeWindow]) -> list[TimeWindow]:
    """Sanitise names to ``[A-Za-z0-9_-]`` and reject empty, reversed or repeated windows."""
    seen: dict[str, TimeWindow] = {}
    for window in windows:
        name = re.sub(r"[^0-9A-Za-z_-]+", "_", window.name.strip()).strip("_")
        if not name:
            raise ValueError(f"window needs a name: {window}")
        if name in seen:
            raise ValueError(f"window name {name!r} is used twice")
        if window.end <= window.start:
            raise ValueError(f"window {name!r} must end after it starts")
        seen[name] = TimeWindow(name, int(window.start), int(window.end), window.note)
    return list(seen.values())


def audit_windows(
    start: str,
    end: str,
    same_clock_dates: list[str],
    inner: dict[str, tuple[str, str]] | None = None,
    offset: int = LOCAL_OFFSET,
) -> list[TimeWindow]:
    """Candidate validation windows around a local target window ``[start, end)``.

    ``clk_*`` repeat the clock range on earlier dates; ``inner`` names clock sub-ranges on
    the first of these dates; ``pre_*`` are the rows of the target date before the target.
    """
    target_start = local_epoch(start, offset)
    date, start_clock = start.split()
    end_clock = end.split()[1]
    windows = [
        TimeWindow(
            f"clk_{d.replace('-', '')[4:]}",
            local_epoch(f"{d} {start_clock}", offset),
            local_epoch(f"{d} {end_clock}", offset),
            "same clock",
        )
        for d in same_clock_dates
    ]
    for name, (a, b) in (inner or {}).items():
        day = same_clock_dates[0]
        windows.append(
            TimeWindow(name, local_epoch(f"{day} {a}", offset), local_epoch(f"{day} {b}", offset), "inner clock")
        )
    windows += [
        TimeWindow("pre_all", local_epoch(date, offset), target_start, "target date before start"),
        TimeWindow("pre_60m", target_start - 3600, target_start, "last hour before start"),
        TimeWindow("pre_30m", target_start - 1800, target_start, "last half hour before start"),
    ]
    return checked_windows(windows)
