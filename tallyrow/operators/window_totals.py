"""Totals of rows in time windows, where windows are a table and overlap so much that the matches of :func:`intervals.window_join` can't be listed.

The time line is cut into at most MOST_SLOTS slots of about as many rows. A window is the rest of its first slot, whole slots, and the start of its
last one. Whole slots come from summaries by slot and pair of slots; the two ends are counted in tasks that hold one slot.
Users: every (user, second) but those whose user was in the window before, which is a pair (second before, second) of a user with both ends in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.operators.intervals import checked_windows
from tallyrow.operators.splits import filter_time
from tallyrow.session import materialize

SLOT_ROWS = 1 << 14
MOST_SLOTS = 512
PART_WINDOWS = 1 << 17
CHUNK_BITS = 20
NONE = np.iinfo(np.int64).max
TOTALS = "_w bigint, n_rows bigint, n_pos bigint, n_users bigint, first bigint"
PAIR, SECOND, WINDOW = 0, 1, 2


def dominated(before: np.ndarray, at: np.ndarray, weight: np.ndarray, low: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each (low, last) the weight of the pairs with ``before >= low`` and ``at <= last``.

    Pairs in falling order of ``before``: the wanted ones are a prefix, which is one block for each bit of its length; blocks are sorted by ``at``.
    """
    order = np.argsort(-before, kind="stable")
    weight, ranks = weight[order], np.searchsorted(np.sort(at), at[order])
    prefix = np.searchsorted(-before[order], -low, side="right")
    below = np.searchsorted(np.sort(at), last, side="right")  # ranks under this one are wanted
    wide, total = len(at) + 1, np.zeros(len(low), np.int64)
    place = np.arange(len(at))
    for bit in range(len(at).bit_length()):
        ask = np.flatnonzero(prefix >> bit & 1)
        if len(ask):
            keys = (place >> bit) * wide + ranks
            by = np.argsort(keys, kind="stable")
            summed = np.concatenate([[0], np.cumsum(weight[by])])
            block = (prefix[ask] >> bit) - 1
            total[ask] += summed[np.searchsorted(keys[by], block * wide + below[ask])] - summed[block << bit]
    return total


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Least of 2 ** k neighbours for each k."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low:high]`` for each pair; NONE where there is none."""
    found, table = np.full(len(low), NONE), _least(values)
    size = np.maximum(high - low, 0)
    for k, level in enumerate(table):
        of = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
        found[of] = np.minimum(level[low[of]], level[high[of] - (1 << k)])
    return found


def _pairs(df: DataFrame, user: str, ts: str, longest: int) -> DataFrame:
    """(at, before, n): how many users were there in both seconds and in none between; null where that is longer ago than a window is long.

    A task sorts one chunk of one user, and the seconds before it that a window can reach back to.
    """
    bits = max(CHUNK_BITS, int(longest).bit_length())
    own, reach = F.shiftright(ts, bits), F.shiftright(F.col(ts) + F.lit(longest), bits)
    chunks = F.explode(F.array_distinct(F.array(own, reach))).alias("_chunk")
    seen = df.where(F.col(user).isNotNull()).select(F.col(user).alias("_user"), F.col(ts).alias("at"), chunks)
    before = F.lag("at").over(W.partitionBy("_user", "_chunk").orderBy("at"))
    linked = seen.select("at", "_chunk", before.alias("before")).where(F.shiftright("at", bits) == F.col("_chunk"))
    linked = linked.where("before is null or before < at")  # a user once a second
    return linked.groupBy("at", "before").agg(F.count(F.lit(1)).alias("n"))


def _cuts(df: DataFrame, ts: str) -> list[int]:
    """The first seconds of all slots but the first one."""
    slots = min(MOST_SLOTS, df.count() // SLOT_ROWS)
    if slots < 2:
        return []
    shares = [k / slots for k in range(1, slots)]
    return sorted(set(df.agg(F.percentile_approx(ts, shares, 20 * slots)).first()[0]))


def _by_slot(df: DataFrame, key: list[str], names: list[str], slots: int) -> list[np.ndarray]:
    """Columns of a summary with one row a slot or pair of slots at most."""
    found = df.groupBy(*key).agg(*[(F.min if n == "first" else F.sum)(n).alias(n) for n in names]).toArrow()
    out = []
    for name in names:
        full = np.full([slots] * len(key), NONE if name == "first" else 0)
        values = found.column(name).combine_chunks().fill_null(int(NONE) if name == "first" else 0)
        full[tuple(np.asarray(found.column(k)) for k in key)] = np.asarray(values)
        out.append(full)
    return out


def window_totals(
    df: DataFrame, windows: DataFrame, positive: Column, user: str, key: str, ts: str = "timestamp", start: str = "start", end: str = "end"
) -> DataFrame:
    """The windows with rows in ``start <= ts < end``: all their columns, and ``n_rows``, ``n_pos``, ``n_users`` (different ones, null none) and ``first`` (least ``key``).

    Bad windows are errors as in :func:`intervals.window_join`. ``ts`` and ``key`` are whole numbers, ``positive`` is a condition. The work is that of
    a few sorts of rows and windows, however many rows a window has.
    """
    windows, low, high = checked_windows(windows.withColumn("_w", F.monotonically_increasing_id()), start, end)
    if low is None:
        return windows.select("*", *[F.lit(0).cast("bigint").alias(c.split()[0]) for c in TOTALS.split(", ")[1:]]).drop("_w")
    longest = windows.agg(F.max(F.col(end) - F.col(start))).first()[0]
    rows = filter_time(df, low, high, ts).withColumn(ts, F.col(ts).cast("bigint"))
    cuts = _cuts(rows, ts)
    slots = len(cuts) + 1

    starts = np.array(cuts, np.int64)

    def with_slots(table: DataFrame, **slot_of: str) -> DataFrame:
        def add(batches):
            for batch in batches:
                for name, second in slot_of.items():
                    found = np.searchsorted(starts, batch.column(second).to_numpy(zero_copy_only=False), side="right")
                    batch = batch.append_column(name, pa.array(found, pa.int32()))
                yield batch

        return table.mapInArrow(add, ", ".join([*[f"`{c}` {t}" for c, t in table.dtypes], *[f"`{c}` int" for c in slot_of]]))

    counts = rows.groupBy(F.col(ts).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("pos"), F.min(F.col(key).cast("bigint")).alias("first"))
    pairs = materialize(_pairs(rows, user, ts, longest))
    users = pairs.groupBy("at").agg(F.sum("n").alias("users"))
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    seconds = counts.select("at", "n", "pos", zero.alias("users"), "first").unionByName(
        users.select("at", zero.alias("n"), zero.alias("pos"), "users", nothing.alias("first"))
    )
    seconds = materialize(with_slots(seconds, slot="at"))
    pairs = materialize(with_slots(pairs.where("before is not null"), **{"from": "before", "to": "at"}))
    asked = windows.select("_w", F.col(start).cast("bigint").alias("low"), (F.col(end).cast("bigint") - 1).alias("last"))
    asked = materialize(with_slots(asked, **{"from": "low", "to": "last"}))

    # whole slots: at most MOST_SLOTS rows, and the square of it for pairs
    n, pos, seen, first = _by_slot(seconds, ["slot"], ["n", "pos", "users", "first"], slots)
    upto = [np.concatenate([[0], np.cumsum(x)]) for x in (n, pos, seen)]
    (cells,) = _by_slot(pairs, ["from", "to"], ["n"], slots)
    within = np.zeros((slots + 1, slots + 1), np.int64)  # [a, b]: pairs from slot a on and before slot b
    within[:-1, 1:] = np.cumsum(np.cumsum(cells[::-1], axis=0)[::-1], axis=1)

    def ends(table: pa.Table) -> pa.Table:
        kind, x, y, z, u, v = (table.column(c).to_numpy() for c in ("kind", "x", "y", "z", "u", "v"))
        side = int(table.column("side")[0].as_py())
        p, s, q = (kind == k for k in (PAIR, SECOND, WINDOW))
        a, b = z[q], u[q]  # first and last slot
        bound = x[q] if side == 0 else starts[a]  # where the slot after the first one starts
        again = dominated(x[p], y[p], z[p], bound, y[q])
        by = np.argsort(x[s], kind="stable")
        at = x[s][by]
        i, j = np.searchsorted(at, bound), np.searchsorted(at, y[q], side="right")
        sums = [np.concatenate([[0], np.cumsum(c[s][by])]) for c in (y, z, u)]
        total = [c[j] - c[i] for c in sums]
        least = least_between(v[s][by], i, j)
        if side == 0:
            between = b > a + 1
            after, until = np.where(between, a + 1, 0), np.where(between, b, 0)
            total = [t + c[until] - c[after] for t, c in zip(total, upto)]
            again = again + np.where(between, within[after, until], 0)
            least = np.minimum(least, least_between(first, after, until))
        columns = [v[q], total[0], total[1], total[2] - again, least]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in TOTALS.split(", ")])

    sides = F.when(F.col("from") == F.col("to"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    asked = asked.select("*", F.explode(sides).alias("side"))
    asked = asked.withColumn("slot", F.when(F.col("side") == 0, F.col("from")).otherwise(F.col("to")))
    load = {(r.side, r.slot): r.n for r in asked.groupBy("side", "slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = [[-(-load.get((k, s), 0) // PART_WINDOWS) for s in range(slots)] for k in (0, 1)]  # tasks of a slot: none without windows

    def dealt(table: DataFrame, side: int, slot: str, kind: int, columns: list[Column]) -> DataFrame:
        tasks = F.get(F.lit(shares[side]), F.col(slot))
        parts = F.explode(F.sequence(F.lit(1), tasks)).alias("part")
        named = [c.cast("bigint").alias(n) for n, c in zip(("x", "y", "z", "u", "v"), columns)]
        return table.where(tasks > 0).select(F.col(slot).cast("int").alias("slot"), F.lit(side).alias("side"), parts, F.lit(kind).alias("kind"), *named)

    col, most = F.col, F.lit(int(NONE))
    of_part = F.pmod(F.xxhash64("_w"), F.get(F.when(col("side") == 0, F.lit(shares[0])).otherwise(F.lit(shares[1])), col("slot"))) + 1
    work = asked.select(
        col("slot").cast("int").alias("slot"), "side", of_part.cast("int").alias("part"), F.lit(WINDOW).alias("kind"),
        *[c.cast("bigint").alias(n) for n, c in zip(("x", "y", "z", "u", "v"), (col("low"), col("last"), col("from"), col("to"), col("_w")))],
    )
    for side, slot in ((0, "from"), (1, "to")):
        work = work.unionByName(dealt(pairs, side, slot, PAIR, [col("before"), col("at"), col("n"), zero, zero]))
        work = work.unionByName(dealt(seconds, side, "slot", SECOND, [col("at"), col("n"), col("pos"), col("users"), F.coalesce("first", most)]))
    halves = work.groupBy("slot", "side", "part").applyInArrow(ends, TOTALS)
    names = [c.split()[0] for c in TOTALS.split(", ")[1:]]
    totals = halves.groupBy("_w").agg(*[F.sum(c).alias(c) for c in names[:-1]], F.nullif(F.min("first"), most).alias("first"))
    return windows.join(materialize(totals.where("n_rows > 0")), "_w").drop("_w")
