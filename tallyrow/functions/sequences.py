"""Expressions over behaviour lists: lengths, truncation, recency buckets, masking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrow.functions.cleaning import clean_list, head, list_size
from tallyrow.functions.search import count_below
from tallyrow.plans.fixed import TIME_BUCKET_EDGES


def model_length(columns: Sequence[Column], max_len: int) -> Column:
    """Longest truncated side list; content is not looked at."""
    sizes = [F.least(list_size(c), F.lit(max_len)) for c in columns]
    return (sizes[0] if len(sizes) == 1 else F.greatest(*sizes)).cast("bigint")


def true_length(ts_list: Column, max_len: int | None = None) -> Column:
    """Number of positive timestamps, optionally among the first ``max_len``."""
    seen = head(ts_list, max_len) if max_len else ts_list
    return list_size(F.filter(seen, lambda s: s > 0)).cast("bigint")


def clipped_length(ts_list: Column, max_len: int) -> Column:
    """Raw length of the timestamp list, at most ``max_len``."""
    return F.least(list_size(ts_list), F.lit(max_len)).cast("bigint")


def seq_head(values: Column, max_len: int, vocab: int | None) -> Column:
    """First ``max_len`` entries, cleaned; later entries are not looked at."""
    return clean_list(head(values, max_len), vocab)


def seq_tail(values: Column, length: Column, keep: int) -> Column:
    """The last ``keep`` of the first ``length`` positions (by position, not by content)."""
    start = F.greatest(length - F.lit(keep), F.lit(0)).cast("int") + F.lit(1)
    return F.slice(values, start, F.least(length, F.lit(keep)).cast("int"))


def check_edges(edges: Sequence[int]) -> list[int]:
    edges = [int(e) for e in edges]
    if len(edges) != len(TIME_BUCKET_EDGES):
        raise ValueError(f"need {len(TIME_BUCKET_EDGES)} edges, got {len(edges)}")
    if edges[0] <= 0 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must be positive and strictly increasing")
    return edges


def time_buckets(
    ts: Column, ts_list: Column, max_len: int, edges: Sequence[int] = tuple(TIME_BUCKET_EDGES)
) -> Column:
    """Recency bucket id of each of the first ``max_len`` positions.

    Ids run from 1; ages beyond the last edge share the last bucket. Only a timestamp of
    exactly 0 is padding (id 0); a future timestamp counts as age 0.
    """
    edges = check_edges(edges)

    def bucket(s: Column) -> Column:
        age = F.greatest(ts - s, F.lit(0))
        slot = F.least(count_below(age, edges), F.lit(len(edges) - 1)) + F.lit(1)
        return F.when(s == 0, F.lit(0)).otherwise(slot).cast("bigint")

    return F.transform(head(ts_list, max_len), bucket)


def time_range(ts_list: Column, max_len: int) -> Column:
    """Newest minus oldest positive timestamp among the first ``max_len``; 0 without any."""
    seen = F.filter(head(ts_list, max_len), lambda s: s > 0)
    return F.coalesce(F.array_max(seen) - F.array_min(seen), F.lit(0)).cast("bigint")


def hashed_draw(row_key: Column, domain: str, seed: int) -> Callable[[Column], Column]:
    """Uniform number in [0, 1) per (row, domain, position), the same on every run."""
    scale = 1 << 52

    def draw(position: Column) -> Column:
        mixed = F.xxhash64(row_key, F.lit(domain), position, F.lit(seed))
        return F.pmod(mixed, F.lit(scale)).cast("double") / F.lit(float(scale))

    return draw


def domain_letters(names: Sequence[str]) -> set[str]:
    """Domain letters of names given as ``c`` or ``seq_c``."""
    return {n.removeprefix("seq_") for n in names}


def mask_positions(values: Column, draw: Callable[[Column], Column], probability: float) -> Column:
    """Blank each position whose draw is below ``probability``; the length stays."""
    return F.transform(
        values, lambda x, i: F.when(draw(i) < F.lit(probability), F.lit(0).cast("bigint")).otherwise(x)
    )
