"""Position of a value among sorted edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def count_below(value: Column, edges: Sequence[float], inclusive: bool = False) -> Column:
    """Number of ``edges`` below ``value`` (``inclusive``: not above).

    A balanced CASE tree over literals: log2(n) comparisons, no array work.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = F.lit(edges[mid])
        above = value >= edge if inclusive else value > edge
        return F.when(above, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(edges))


def with_count_below(df: DataFrame, value: str, cuts: str, size: int, name: str, inclusive: bool = False) -> DataFrame:
    """Add ``name``: how many of the sorted array column ``cuts`` are below ``value`` (``inclusive``: not above).

    The array holds ``size`` - 1 entries or fewer, ``size`` a power of two. One projection per halving
    step keeps the binary search flat and inside generated code.
    """
    if size < 2 or size & (size - 1):
        raise ValueError(f"size must be a power of two, got {size}")
    df = df.withColumn(name, F.lit(0))
    step = size // 2
    while step:
        probe = F.get(F.col(cuts), F.col(name) + F.lit(step - 1))
        under = probe <= F.col(value) if inclusive else probe < F.col(value)
        df = df.withColumn(name, F.col(name) + F.when(under, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return df
