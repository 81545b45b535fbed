"""Cumulative history as a stored table, bucketed by (fid, value), to which newer bins are appended.

Look-ups read the buckets where they lie: only the probes are shuffled, to the same buckets. An appended part carries
on the totals of what is stored, so nothing old is rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.operators.history import history_cumulative
from tallyrow.plans.fixed import HOUR
from tallyrow.session import materialize

KEY = ("fid", "value")
SCHEMA = "fid bigint, value bigint, bin bigint, bin_end_ts bigint, cum_cnt bigint, cum_pos bigint"


@dataclass(frozen=True)
class HistoryStore:
    """A bucketed table ``name`` whose files lie in the shared folder ``path``."""

    name: str
    path: str
    buckets: int = 64
    bin_sec: int = HOUR

    def open(self, spark: SparkSession) -> DataFrame:
        """The stored rows; a session that does not know the table yet is told where it lies."""
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (fid, value) SORTED BY (fid, value, bin) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        return spark.table(self.name)

    def _write(self, cumulative: DataFrame, mode: str) -> None:
        dealt = cumulative.select(*[c.split()[0] for c in SCHEMA.split(", ")]).repartition(self.buckets, *KEY)
        writer = dealt.write.format("parquet").mode(mode).bucketBy(self.buckets, *KEY).sortBy(*KEY, "bin")
        writer.option("path", self.path).saveAsTable(self.name)

    def create(self, bins: DataFrame) -> None:
        """Stores the running totals of (fid, value, bin, cnt, pos); a store that is there already is an error."""
        self._write(history_cumulative(bins, self.bin_sec), "errorifexists")

    def append(self, bins: DataFrame) -> None:
        """Adds bins that are later than all stored ones, with the stored totals carried on.

        Earlier bins, of late outcomes, would change totals that are stored; they are an error, and need a rebuild.
        No bins, no change.
        """
        spark = bins.sparkSession
        stored = self.open(spark)
        bins = materialize(bins)
        first, last = bins.agg(F.min("bin")).first()[0], stored.agg(F.max("bin")).first()[0]
        if first is None:
            return
        if last is not None and first <= last:
            raise ValueError(f"bin {first} is not later than the stored bin {last}")
        added = history_cumulative(bins, self.bin_sec)
        totals = stored.groupBy(*KEY).agg(F.max("cum_cnt").alias("_cnt"), F.max("cum_pos").alias("_pos"))
        carried = added.repartition(self.buckets, *KEY).join(totals, list(KEY), "left")
        grown = carried.withColumns({c: F.col(c) + F.coalesce(F.col(t), F.lit(0)) for c, t in (("cum_cnt", "_cnt"), ("cum_pos", "_pos"))})
        # written aside first: the table is not read while it is written
        self._write(materialize(grown.drop("_cnt", "_pos")), "append")
        spark.catalog.refreshTable(self.name)
