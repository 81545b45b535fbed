"""Predictions per user, and a linear baseline that produces them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.plans.features import FeaturePlan

TASK_ROWS = 1 << 16


def bounded_probability(prob: Column) -> Column:
    """NaN and minus infinity become 0, plus infinity 1."""
    inf = F.lit(float("inf"))
    return F.when(F.isnan(prob) | (prob == -inf), F.lit(0.0)).when(prob == inf, F.lit(1.0)).otherwise(prob)


def last_predictions(df: DataFrame, prob: str, time: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """One probability per user, that of the latest row (order: time, then tie key)."""
    return df.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(
        F.max_by(bounded_probability(F.col(prob)), F.struct(time, tie)).alias("prob")
    )


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def model_inputs(table: DataFrame, plan: FeaturePlan, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``sample_weight`` if there is one, and the inputs of the linear model.

    ``tokens``: one string per non-zero id slot, side id and recency bucket, named by its place.
    ``dense``: the dense vector and the list lengths; null counts as 0.
    """

    def slots(column: str) -> Column:
        named = F.transform(column, lambda v, i: F.when(v != 0, F.concat_ws("=", F.lit(column), i.cast("string"), v.cast("string"))))
        return F.filter(named, lambda t: t.isNotNull())

    def bag(column: str) -> Column:
        named = F.transform(column, lambda v: F.when(v != 0, F.concat_ws("=", F.lit(column), v.cast("string"))))
        return F.filter(named, lambda t: t.isNotNull())

    lists = [d.column(f) for d in plan.domains for f in d.side_fids if d.column(f) in table.columns]
    lists += [f"{d.name}_time_bucket" for d in plan.domains if d.ts_column]
    tokens = F.concat(slots("user_int"), slots("item_int"), *[bag(c) for c in lists])
    lengths = F.array(*[F.log1p(F.col(f"{d.name}_len").cast("double")) for d in plan.domains])
    numbers = F.transform(
        F.concat("user_dense", lengths), lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    )
    weight = ["sample_weight"] if "sample_weight" in table.columns else []
    return table.select(*keep, *weight, tokens.alias("tokens"), numbers.alias("dense"))


def _with_numbers(df: DataFrame) -> DataFrame:
    return df.withColumn("numbers", array_to_vector("dense"))


def train_baseline(
    df: DataFrame, label: str, weight: str | None = None, buckets: int = 1 << 12, max_iter: int = 20
) -> PipelineModel:
    """Logistic regression for one label on all assembled features (see :func:`model_inputs`).

    Vectors are much larger than the stored rows they come from, and the fit keeps them. So they are dealt out by number of rows, about TASK_ROWS a task.
    """
    hasher = HashingTF(inputCol="tokens", outputCol="hashed", numFeatures=buckets, binary=True)
    assembler = VectorAssembler(inputCols=["hashed", "numbers"], outputCol="features")
    options = {"weightCol": weight} if weight else {}
    inputs = PipelineModel([hasher, assembler])
    vectors = inputs.transform(_with_numbers(df)).select("features", label, *options.values())
    tasks = -(-df.count() // TASK_ROWS)
    if tasks > 1:
        # the fit goes over its input several times before it has its own copy
        vectors = vectors.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism)).persist(StorageLevel.DISK_ONLY)
    try:
        model = LogisticRegression(labelCol=label, regParam=0.01, maxIter=max_iter, **options).fit(vectors)
    finally:
        vectors.unpersist()
    return PipelineModel([hasher, assembler, model])


def score(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    """Add the probability of the positive class."""
    scored = model.transform(_with_numbers(df))
    prob = bounded_probability(vector_to_array("probability")[1])
    return scored.select(*df.columns, prob.alias(name))
