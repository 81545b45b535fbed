"""Blocks: a key column that groups rows read together (a file, a date, a shard).

Block tables have one row per block, so ordering them globally is cheap; rows meet their
block again through an ordinary equi-join, which Spark broadcasts only if it measures the
block table as small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.operators.ordered import null_safe_join


def with_file_block(df: DataFrame, name: str = "block") -> DataFrame:
    """Add the source file as block key (only on a DataFrame read straight from files)."""
    return df.select("*", F.col("_metadata.file_path").alias(name))


def block_catalog(df: DataFrame, block: str, time: str = "timestamp") -> DataFrame:
    """Row count and time range per block."""
    return df.groupBy(F.col(block).alias("block")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("min_ts"),
        F.max(time).alias("max_ts"),
    )


def ranked_blocks(catalog: DataFrame, by: str = "time") -> DataFrame:
    """Add ``block_rank`` (0-based), by block name or by latest then earliest time."""
    if by not in ("time", "filename"):
        raise ValueError(f"unknown block order {by!r}")
    order = ["block"] if by == "filename" else ["max_ts", "min_ts", "block"]
    return catalog.withColumn(
        "block_rank", (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint")
    )


def sample_ranks(n: int, k: int) -> list[int]:
    """``k`` evenly spaced ranks out of ``n``, first and last included, fractions dropped."""
    k = max(1, min(k, n))
    if k == 1:
        return [0]
    step = (n - 1) / (k - 1)
    return [int(i * step) for i in range(k - 1)] + [n - 1]


def sample_blocks(catalog: DataFrame, k: int, by: str = "filename") -> DataFrame:
    """Evenly spaced sample of ``k`` blocks."""
    ranked = ranked_blocks(catalog, by)
    return ranked.where(F.col("block_rank").isin(sample_ranks(catalog.count(), k)))


def rows_of_blocks(df: DataFrame, block: str, blocks: DataFrame) -> DataFrame:
    """The rows of the given blocks; a null block is a block like others."""
    return null_safe_join(df, blocks.select(F.col("block").alias(block)), [block], "left_semi")


@dataclass(frozen=True)
class BlockSplit:
    """Half-open rank ranges of the four roles."""

    train: tuple[int, int]
    gap: tuple[int, int]
    valid: tuple[int, int]
    holdout: tuple[int, int]


def plan_block_split(
    n: int,
    valid_ratio: float = 0.1,
    holdout_ratio: float = 0.0,
    gap_ratio: float = 0.0,
    train_ratio: float = 1.0,
) -> BlockSplit:
    """Rank ranges in order train | gap | valid | holdout; raises when train would be empty."""
    for name, ratio in (("valid", valid_ratio), ("holdout", holdout_ratio), ("gap", gap_ratio)):
        if not 0.0 <= ratio < 1.0:
            raise ValueError(f"{name} ratio must be in [0, 1), got {ratio}")
    if not 0.0 < train_ratio <= 1.0:
        raise ValueError(f"train ratio must be in (0, 1], got {train_ratio}")
    held = max(1, int(n * holdout_ratio)) if holdout_ratio else 0
    left = n - held
    if left <= 0:
        raise ValueError("holdout takes all blocks")
    valid = max(1, int(left * valid_ratio))
    gap = max(1, int(left * gap_ratio)) if gap_ratio else 0
    if gap and gap + valid >= left:
        raise ValueError("gap and validation leave no block for training")
    train = left - valid - gap
    if train_ratio < 1.0:
        train = max(1, int(train * train_ratio))
    return BlockSplit((0, train), (train, train + gap), (train + gap, left), (left, n))


def split_blocks(catalog: DataFrame, by: str = "time", **ratios: float) -> DataFrame:
    """Catalog with ``block_rank`` and ``role``."""
    split = plan_block_split(catalog.count(), **ratios)
    rank = F.col("block_rank")

    def inside(bounds: tuple[int, int]):
        return (rank >= bounds[0]) & (rank < bounds[1])

    role = (
        F.when(inside(split.train), "train")
        .when(inside(split.gap), "gap")
        .when(inside(split.valid), "valid")
        .when(inside(split.holdout), "holdout")
    )
    return ranked_blocks(catalog, by).withColumn("role", role)


def limit_blocks(blocks: DataFrame, last_train: int = 0, first_valid: int = 0) -> DataFrame:
    """Keep the train blocks nearest to validation and the validation blocks nearest to train."""
    by_role = W.partitionBy("role")
    position = F.row_number().over(by_role.orderBy("block_rank"))
    size = F.count(F.lit(1)).over(by_role)
    numbered = blocks.withColumn("_position", position).withColumn("_size", size)
    keep = F.lit(True)
    if last_train > 0:
        keep &= (F.col("role") != "train") | (F.col("_position") > F.col("_size") - last_train)
    if first_valid > 0:
        keep &= (F.col("role") != "valid") | (F.col("_position") <= first_valid)
    return numbered.where(keep).drop("_position", "_size")


def with_block_role(df: DataFrame, block: str, blocks: DataFrame) -> DataFrame:
    roles = blocks.select(F.col("block").alias(block), "role")
    return null_safe_join(df, roles, [block])


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """All rows in a repeatable pseudo-random order (a range-partitioned sort on a hash)."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
