"""Parquet readers and report writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyrow.plans.features import FeaturePlan


def scan_impressions(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """All ``*.parquet`` of a folder (or one file). A folder without any is an error."""
    reader = spark.read
    if not path.endswith(".parquet"):
        reader = reader.option("pathGlobFilter", "*.parquet").option(
            "recursiveFileLookup", str(recursive).lower()
        )
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise FileNotFoundError(f"no parquet files under {path}") from error
        raise


def scan_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names of those that do not."""
    present = [c for c in wanted if c in df.columns]
    return df.select(*present), [c for c in wanted if c not in df.columns]


def write_profile(df: DataFrame, path: str, layout: str = "json") -> None:
    """Write a report as JSON lines or Parquet."""
    if layout not in ("json", "parquet"):
        raise ValueError(f"unknown layout {layout!r}")
    df.write.mode("overwrite").format(layout).save(path)


def write_plan(spark: SparkSession, plan: FeaturePlan, path: str, edges: dict[str, list[int]] | None = None) -> None:
    """Write a feature plan as one line of JSON, with the fitted recency edges if given.

    Fitted edges belong to the plan: scoring must bucket with the edges used in training.
    """
    raw = plan.to_dict() | ({"time_edges": edges} if edges else {})
    spark.createDataFrame([(json.dumps(raw),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_plan(
    spark: SparkSession, path: str, max_lens: dict[str, int] | None = None
) -> tuple[FeaturePlan, dict[str, list[int]] | None]:
    raw = json.loads(spark.read.text(path).first().value)
    return FeaturePlan.from_dict(raw, max_lens), raw.get("time_edges")
