"""Ranking metrics and losses over scored tables (label, logit)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.functions.losses import bce, focal, sigmoid, softplus
from tallyrow.functions.search import count_below, with_count_below
from tallyrow.operators.ranks import CUTS, attach, cut_points, exact_quantiles, grouped, held, number_array

def valid_scores(df: DataFrame, score: str = "logit") -> DataFrame:
    """Rows whose score is neither null nor NaN."""
    return df.where(F.col(score).isNotNull() & ~F.isnan(score))


def auc(
    df: DataFrame,
    keys: Sequence[str] = (),
    score: str = "logit",
    label: str = "label",
    one_class: float | None = 0.0,
    cuts: int = CUTS,
) -> DataFrame:
    """ROC AUC per key, ties counted half. A group with one class gets ``one_class``.

    Scores are cut into ranges of similar weight. Inside a range a window counts the negatives
    below each score; the ranges before it enter through their totals. No task ever holds
    all scores of a key.
    """
    keys = list(keys)
    rows = valid_scores(df, score).select(*keys, F.col(score).cast("double").alias("_x"), F.col(label).alias("_y"))
    limits = held(grouped(rows, keys, cut_points("_x", cuts).alias("_cuts")), keys)
    counted = (
        with_count_below(attach(rows, limits, keys, ["_cuts"]), "_x", "_cuts", cuts, "_range")
        .groupBy(*keys, "_range", "_x")
        .agg(F.sum(F.col("_y")).cast("double").alias("_pos"), F.sum(1 - F.col("_y")).cast("double").alias("_neg"))
    )
    below = W.partitionBy(*keys, "_range").orderBy("_x").rowsBetween(W.unboundedPreceding, -1)
    inside = counted.select(
        *keys, "_range", "_pos", "_neg", F.coalesce(F.sum("_neg").over(below), F.lit(0.0)).alias("_below")
    )
    ranges = inside.groupBy(*keys, "_range").agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_wins"),
        F.sum("_pos").alias("_pos"),
        F.sum("_neg").alias("_neg"),
    )
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    summed = grouped(
        ranges.withColumn("_before", F.coalesce(F.sum("_neg").over(before), F.lit(0.0))),
        keys,
        F.sum(F.col("_wins") + F.col("_pos") * F.col("_before")).alias("_wins"),
        F.coalesce(F.sum("_pos"), F.lit(0.0)).alias("_p"),
        F.coalesce(F.sum("_neg"), F.lit(0.0)).alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    value = F.when(both, F.col("_wins") / (F.col("_p") * F.col("_n"))).otherwise(F.lit(one_class).cast("double"))
    return summed.select(
        *keys,
        (F.col("_p") + F.col("_n")).cast("bigint").alias("n"),
        F.col("_p").cast("bigint").alias("n_pos"),
        value.alias("auc"),
    )


def logloss(df: DataFrame, keys: Sequence[str] = (), score: str = "logit", label: str = "label") -> DataFrame:
    """Mean binary cross-entropy from raw scores; infinite when nothing is left."""
    value = F.avg(bce(F.col(score), F.col(label).cast("double")))
    return grouped(
        valid_scores(df, score),
        keys,
        F.count(F.lit(1)).alias("n"),
        F.coalesce(value, F.lit(float("inf"))).alias("logloss"),
    )


def slice_edges(df: DataFrame, columns: Sequence[str], parts: int = 4) -> dict[str, list[float]]:
    """Distinct quantile edges per diagnostic column (``parts`` + 1 numbers each)."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("bigint").alias("v")) for c in columns])
        ).alias("s")
    ).select("s.*")
    shares = [i / parts for i in range(parts + 1)]
    return {r.slice: sorted(set(r.quantiles)) for r in exact_quantiles(long, ["slice"], "v", shares).collect()}


def slice_report(df: DataFrame, columns: Sequence[str], categories: Sequence[str] = (), parts: int = 4) -> DataFrame:
    """Per slice and bucket: rows, positive share, AUC (null for one class), mean probability.

    ``columns`` are cut at their quantiles, a value on an inner edge going up; ``lower`` and
    ``upper`` are the edges without fractions. Columns with a single value are left out.
    ``categories`` are used as they are.
    """
    rows = valid_scores(df)

    def entry(name: str, bucket: Column, lower: Column, upper: Column) -> Column:
        fields = {"bucket": bucket, "lower": lower, "upper": upper}
        return F.struct(F.lit(name).alias("slice"), *[v.cast("bigint").alias(k) for k, v in fields.items()])

    structs = []
    for name, edges in (slice_edges(rows, columns, parts) if columns else {}).items():
        if len(edges) < 2:
            continue
        bucket = count_below(F.col(name).cast("double"), edges[1:-1], inclusive=True)
        bounds = number_array(edges)
        structs.append(entry(name, bucket, F.get(bounds, bucket), F.get(bounds, bucket + 1)))
    structs += [entry(name, F.col(name), F.lit(None), F.lit(None)) for name in categories]
    long = rows.select("label", "logit", F.explode(F.array(*structs)).alias("s")).select("label", "logit", "s.*")
    keys = ["slice", "bucket"]
    means = long.groupBy(*keys).agg(
        F.min("lower").alias("lower"),
        F.min("upper").alias("upper"),
        F.avg(F.col("label").cast("double")).alias("pos_rate"),
        F.avg(sigmoid(F.col("logit"))).alias("pred_mean"),
    )
    return auc(long, keys, one_class=None).join(means, keys)


def eval_windows(df: DataFrame, primary: str, window: str = "window") -> DataFrame:
    """AUC and log loss per window, and how far each AUC is below that of ``primary``."""
    scores = auc(df, [window]).join(logloss(df, [window]).drop("n"), window)
    reference = F.max(F.when(F.col(window) == primary, F.col("auc"))).over(W.partitionBy())  # a row per window
    gap = reference - F.col("auc")
    return scores.select("*", F.when(F.col(window) != primary, gap).alias("gap"))


def weighted_bce(df: DataFrame, weight: str, score: str = "logit", label: str = "label") -> DataFrame:
    """Weighted cross-entropy; the weight sum is taken as at least 1."""
    loss = bce(F.col(score), F.col(label).cast("double"))
    total = F.greatest(F.sum(F.col(weight)), F.lit(1.0))
    return valid_scores(df, score).agg((F.sum(F.col(weight) * loss) / total).alias("loss"))


def focal_loss(df: DataFrame, alpha: float = 0.1, gamma: float = 2.0, label: str = "label") -> DataFrame:
    return valid_scores(df).agg(F.avg(focal(F.col("logit"), F.col(label), alpha, gamma)).alias("loss"))


def pair_batches(df: DataFrame, row_key: str, rows: int = 512) -> Column:
    """A batch number per row, from a hash of its key, so that batches hold about ``rows`` rows."""
    return F.pmod(F.xxhash64(row_key), F.lit(max(1, -(-df.count() // rows))))


def bpr_loss(df: DataFrame, batch: Column, margin: float = 0.0) -> DataFrame:
    """Mean over the batches of the pairwise ranking loss of all their (positive, negative) pairs.

    Every row is in the batch that ``batch`` names; :func:`pair_batches` keeps batches small.
    Pairs are summed inside the batch and never become rows. Batches without both classes
    have no pair; without any pair the loss is 0.
    """

    def side(value: int) -> Column:
        return F.collect_list(F.when(F.col("label") == value, F.col("logit")))

    batches = (
        valid_scores(df)
        .select("label", "logit", batch.alias("_batch"))
        .groupBy("_batch")
        .agg(side(1).alias("pos"), side(0).alias("neg"))
        .where((F.size("pos") > 0) & (F.size("neg") > 0))
    )

    def against(p: Column) -> Column:
        return F.aggregate("neg", F.lit(0.0), lambda a, q: a + softplus(-(p - q - F.lit(float(margin)))))

    total = F.aggregate("pos", F.lit(0.0), lambda a, p: a + against(p))
    loss = total / (F.size("pos") * F.size("neg"))
    return batches.agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"))


def mean_bce(df: DataFrame, score: str = "logit", label: str = "label") -> DataFrame:
    loss = bce(F.col(score), F.col(label).cast("double"))
    return valid_scores(df, score).agg(F.avg(loss).alias("loss"))


def blended(parts: Sequence[tuple[float, DataFrame]]) -> DataFrame:
    """Weighted sum of one-row losses."""
    terms = [frame.select((F.lit(float(share)) * F.col("loss")).alias("loss")) for share, frame in parts]
    return reduce(DataFrame.unionByName, terms).agg(F.sum("loss").alias("loss"))


def combined_auc_loss(df: DataFrame, batch: Column, share: float = 0.5, margin: float = 0.0) -> DataFrame:
    """(1 - share) · cross-entropy + share · pairwise ranking loss."""
    if not 0.0 <= share <= 1.0:
        raise ValueError(f"share must be in [0, 1], got {share}")
    if share == 0.0:
        return mean_bce(df)
    return blended([(1.0 - share, mean_bce(df)), (share, bpr_loss(df, batch, margin))])


def multitask_loss(
    click: DataFrame, conversion: DataFrame, click_weight: float = 1.0, conversion_weight: float = 2.0
) -> DataFrame:
    """Weighted sum of a click loss and a conversion loss (any of the losses above)."""
    return blended([(click_weight, click), (conversion_weight, conversion)])
