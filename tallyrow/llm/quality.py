"""Quality classifier over subword embeddings, and the pipeline stage that drops what it rejects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm import subwords
from tallyrow.llm.base import register, table

THRESHOLD = 0.3
CLASSES = (0, 1)


def fit_quality(documents: DataFrame, labels: DataFrame) -> subwords.Model:
    """Learns from labelled rows outside fold 0 only; ids choose rows but are no feature."""
    return subwords.fit(documents, labels.where(subwords.fold() != 0), "quality", CLASSES)


def score_quality(documents: DataFrame, model: subwords.Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    An empty or null text has no features and gets the prior. Rows with a null id are scored and are not
    held out; repeated rows are scored one by one; other columns are ignored. With no labelled row at all
    every score is the even prior. ``score`` is at most 1 and at least 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            score = subwords.posteriors(shared.value, batch.column(2))[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(subwords.fold() == 0, F.lit(False))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string")).mapInArrow(
        scan, f"doc_id {id_type}, held_out boolean, score double, predicted int"
    )


def keep_good(documents: DataFrame, model: subwords.Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, unchanged, that the model does not reject."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def scan(batches):
        for batch in batches:
            good = subwords.posteriors(shared.value, batch.column(at).cast(pa.string()))[:, 1] >= threshold
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(scan, documents.schema)


@register("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, table(spark, sf_dir, "labels")))
