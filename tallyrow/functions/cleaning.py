"""Cleaning of sparse ids and lists. Zero means missing or padding everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def binary_label(label_type: Column, at_least: int = 2) -> Column:
    """1 where the raw label reaches ``at_least`` (2 conversion, 1 click); null counts as 0."""
    if at_least == 2:
        return (F.coalesce(label_type, F.lit(0)) == 2).cast("bigint")
    return (F.coalesce(label_type, F.lit(0)) >= at_least).cast("bigint")


def clean_id(value: Column, vocab: int | None = None) -> Column:
    """Null and non-positive ids become 0; a known vocab of 0 blanks the column."""
    if vocab == 0:
        return _zero()
    return F.when(value > 0, value).otherwise(_zero()).cast("bigint")


def clip_id(value: Column, vocab: int) -> Column:
    """Ids at or above ``vocab`` become 0."""
    return F.when(value < F.lit(vocab), value).otherwise(_zero())


def clean_and_clip(value: Column, vocab: int) -> Column:
    return clip_id(clean_id(value, vocab), vocab) if vocab > 0 else _zero()


def route_missing(value: Column, vocab: int) -> Column:
    """Missing scalar ids get their own slot, the last one of a vocab grown by one.

    The grown vocab also bounds the out-of-range test, so a raw id equal to the old
    vocab shares the missing slot.
    """
    missing = F.coalesce(value, _zero()) <= 0
    return F.when(missing, F.lit(vocab).cast("bigint")).otherwise(clean_and_clip(value, vocab + 1))


def is_missing(value: Column) -> Column:
    return (F.coalesce(value, _zero()) <= 0).cast("double")


def clean_list(values: Column, vocab: int | None = None) -> Column:
    """Element-wise :func:`clean_id`, with out-of-range ids blanked when a vocab is given."""
    items = F.coalesce(values, _empty())
    if vocab == 0:
        return F.transform(items, lambda x: _zero())
    if vocab is None:
        return F.transform(items, lambda x: F.when(x > 0, x).otherwise(_zero()))
    return F.transform(items, lambda x: F.when((x > 0) & (x < F.lit(vocab)), x).otherwise(_zero()))


def head(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def pad(values: Column, dim: int, filler: Column) -> Column:
    """First ``dim`` entries, filled up on the right."""
    kept = head(values, dim)
    return F.concat(kept, F.array_repeat(filler, F.lit(dim) - F.size(kept)))


def pad_ints(values: Column, dim: int, vocab: int | None = None) -> Column:
    return pad(clean_list(head(F.coalesce(values, _empty()), dim), vocab), dim, _zero())


def pad_floats(values: Column, dim: int) -> Column:
    """Negatives are kept; only ids are clamped."""
    empty = F.array().cast("array<double>")
    return pad(F.coalesce(values.cast("array<double>"), empty), dim, F.lit(0.0))


def list_size(values: Column) -> Column:
    """Raw list length, 0 for null."""
    return F.when(values.isNull(), F.lit(0)).otherwise(F.size(values))


def kept_length(values: Column, dim: int) -> Column:
    return F.least(list_size(values), F.lit(dim)).cast("bigint")


def log1p_list(values: Column) -> Column:
    return F.transform(values, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))


def list_is_null(values: Column) -> Column:
    """True when a list is null, empty, or has no positive entry."""
    return F.coalesce(~F.exists(values, lambda x: F.coalesce(x, F.lit(0)) > 0), F.lit(True))


def scalar_is_null(value: Column) -> Column:
    return F.coalesce(value, _zero()) <= 0


def primary_first_slot(values: Column) -> Column:
    """Slot 0 when any slot is non-zero (slot 0 itself may be 0); all-zero and null give null."""
    return F.when(F.exists(values, lambda x: x != 0), F.get(values, F.lit(0)))


def primary_first_nonzero(values: Column) -> Column:
    """First non-zero entry, else null."""
    return F.get(F.filter(values, lambda x: x != 0), F.lit(0))


def hash_bucket(value: Column, buckets: int) -> Column:
    """0 stays 0; other values spread over ``1 … buckets-1``."""
    spread = F.pmod(value - F.lit(1), F.lit(buckets - 1)) + F.lit(1)
    return F.when(value != 0, spread).otherwise(_zero()).cast("bigint")


def hash_mod(value: Column, size: int) -> Column:
    """Non-zero ids folded into ``1 … size-1``; size 0 drops the column."""
    if size <= 0:
        return _zero()
    return F.when(value != 0, F.greatest(F.pmod(value, F.lit(size)), F.lit(1))).otherwise(_zero()).cast("bigint")


def hash_mod_vocab(value: Column, vocab: int, threshold: int, size: int) -> Column:
    """:func:`hash_mod` for vocabs above ``threshold``; smaller ones stay as they are."""
    return hash_mod(value, size) if vocab > threshold > 0 else value
