"""Reports from small mergeable summaries: distinct counts and quantiles by day, heavy hitters, overlaps of hashed ids.

The summaries are Spark's own sketches and bitmaps. Those by day are stored in one partition a day; a range of days merges what it
reads, and a new day is added without touching the others. The exact operators of :mod:`tallyrow.operators.profile` stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.functions.clock import day_number
from tallyrow.operators.ordered import null_safe_join, top_per_key
from tallyrow.operators.profile import rate, seq_items, seq_time_diffs, unpack
from tallyrow.plans.features import SequenceDomain
from tallyrow.session import materialize

LG_K = 12
KLL_K = 800
#: Greatest error of a rank, as a share of the rows: about 2.7 times the one that KLL_K gives in 99 of 100 cases.
KLL_ERROR = 0.015
ROOM, MOST_ROOM = 4096, 1 << 20


# --- by day -----------------------------------------------------------------------------------


def store_days(sketches: DataFrame, path: str) -> None:
    """Writes one partition for each ``day`` of the table. A day that is there already is replaced, others are not touched."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(like: DataFrame, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The stored summaries of the days from ``first`` to ``last``; ``like`` has their columns. Other days are not read."""
    table = like.sparkSession.read.schema(like.schema).parquet(path)
    if first is not None:
        table = table.where(F.col("day") >= F.lit(first))
    return table if last is None else table.where(F.col("day") <= F.lit(last))


def daily_ids(df: DataFrame, columns: Sequence[str] = ("user_id", "item_id"), lg_k: int = LG_K) -> DataFrame:
    """(day, id_column, sketch): the distinct ids of each UTC day; null ids do not count. All columns in one aggregate."""
    day = day_number(F.col("timestamp")).alias("day")
    wide = df.groupBy(day).agg(*[F.hll_sketch_agg(c, F.lit(lg_k)).alias(f"of_{c}") for c in columns])
    return unpack(wide, [F.struct(F.lit(c).alias("id_column"), F.col(f"of_{c}").alias("sketch")) for c in columns], "day")


def distinct_ids(sketches: DataFrame) -> DataFrame:
    """(id_column, n_estimate) over all days of the table."""
    return sketches.groupBy("id_column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimate"))


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative error of a distinct count, at four standard errors."""
    return 4 * 1.04 / sqrt(1 << lg_k)


def daily_time_diffs(df: DataFrame, domains: Sequence[SequenceDomain], k: int = KLL_K) -> DataFrame:
    """(day, domain, sketch): the time differences of each UTC day's impressions."""
    diffs = seq_time_diffs(df.withColumn("day", day_number(F.col("timestamp"))), domains, 0, False, "day")
    return diffs.groupBy("day", "domain").agg(F.kll_sketch_agg_bigint("diff", F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], k: int = KLL_K) -> DataFrame:
    """The keys with n and ``quantiles``, one value for each share, each from the sketch's own values."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))
    values = F.array(*[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(s))) for s in shares])
    return merged.select(*keys, F.kll_sketch_get_n_bigint("sketch").alias("n"), values.alias("quantiles"))


# --- heavy hitters ------------------------------------------------------------------------------


def _map_size(room: int) -> int:
    """Counters that a sketch of ``room`` tracked items has: a power of two, filled to three quarters."""
    return 1 << (ceil(room / 0.75) - 1).bit_length()


def heavy_hitters(df: DataFrame, keys: Sequence[str], item: str, k: int, room: int = ROOM, most_room: int = MOST_ROOM) -> DataFrame:
    """The ``k`` most frequent items of each key with their exact ``freq`` and ``item_rank`` (ties by item), as an exact count gives them.

    A first pass keeps ``room`` counters a key and task. They are off by 3.5 n / counters at most, for the n items of the key, so every item that is
    more frequent than twice that is among the candidates, and a second pass counts those alone. Where the k-th of them is no more
    frequent than that, the key gets sixteen times the room, and an exact count beyond ``most_room``. Null items do not count; null keys are keys.
    """
    keys = list(keys)
    df = df.where(F.col(item).isNotNull())
    found, left = [], df
    while room <= most_room:
        top = F.expr(f"approx_top_k(`{item}`, {room}, {room})").alias("_top")
        sketched = materialize(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct(item, 0.02).alias("_distinct"), top))
        candidates = materialize(sketched.select(*keys, F.explode("_top.item").alias(item)))
        counted = null_safe_join(left, candidates, [*keys, item], "left_semi").groupBy(*keys, item).agg(F.count(F.lit(1)).alias("freq"))
        ranked = materialize(top_per_key(counted, keys, [F.desc("freq"), F.asc(item)], k, [item], rank="item_rank"))
        last = ranked.groupBy(*keys).agg(F.min("freq").alias("_last"), F.count(F.lit(1)).alias("_found"))
        bound = 2 * F.ceil(F.lit(3.5 / _map_size(room)) * F.col("_n"))
        settled = ((F.col("_found") >= k) & (F.col("_last") > bound)) | (1.1 * F.col("_distinct") <= room)
        state = materialize(null_safe_join(sketched.drop("_top"), last, keys, "left").select(*keys, F.coalesce(settled, F.lit(False)).alias("_settled")))
        found.append(null_safe_join(ranked, state.where("_settled").drop("_settled"), keys, "left_semi"))
        unsettled = state.where("not _settled").drop("_settled")
        if unsettled.isEmpty():
            break
        left = null_safe_join(left, unsettled, keys, "left_semi")
        room *= 16
    else:
        counted = left.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("freq"))
        found.append(top_per_key(counted, keys, [F.desc("freq"), F.asc(item)], k, [item], rank="item_rank"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


# --- overlap ------------------------------------------------------------------------------------


def _bitmaps(items: DataFrame, side: str) -> DataFrame:
    """(domain, fid, part, side, bits): the ids of one side, 32,768 to a bitmap of 4 KB."""
    at = F.bitmap_bucket_number("item")
    marked = items.select("domain", "fid", at.alias("part"), F.bitmap_bit_position("item").alias("bit")).distinct()
    return marked.groupBy("domain", "fid", "part").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("side", F.lit(side))


def folded_items(df: DataFrame, domains: Sequence[SequenceDomain], buckets: int) -> DataFrame:
    """The items folded to ids below ``buckets``, as a hashed embedding has them."""
    folded: Column = F.greatest(F.pmod("item", F.lit(buckets)), F.lit(1)).cast("bigint")
    return seq_items(df, domains).withColumn("item", folded)


def bucket_overlap(train: DataFrame, test: DataFrame, domains: Sequence[SequenceDomain], buckets: int) -> DataFrame:
    """Distinct hashed items per (domain, fid) in training, in test and in both, with the share of the test's that training has.

    Equal to the exact operator with ``buckets``; what is joined is a bitmap for each 32,768 ids.
    """
    sides = _bitmaps(folded_items(train, domains, buckets), "train").unionByName(_bitmaps(folded_items(test, domains, buckets), "test"))
    size = F.bitmap_count("bits")
    parts = sides.groupBy("domain", "fid", "part").agg(
        F.sum(F.when(F.col("side") == "train", size).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("side") == "test", size).otherwise(0)).alias("b"),
        F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(0).alias("both"),
    )
    totals = [F.sum(c).cast("bigint").alias(n) for c, n in (("a", "n_train"), ("b", "n_test"), ("both", "n_both"))]
    return parts.groupBy("domain", "fid").agg(*totals).withColumn("test_share_seen", rate(F.col("n_both"), F.col("n_test")))
