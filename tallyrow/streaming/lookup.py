"""As-of history look-ups of impressions as they arrive, with corrections when older outcomes come late.

The state is three Parquet tables in one folder, each with a partition per micro-batch: rows seen, bins added, answers given. A batch only writes its
own partitions, and writes them anew when it is replayed, so a restart changes nothing; an answer is replaced by a later batch's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrow.operators.history import GLOBAL_FID, history_bins, history_columns, history_cumulative, history_lookup, history_values, probe_bin
from tallyrow.operators.ordered import null_safe_join
from tallyrow.plans.fixed import DAY, HOUR
from tallyrow.session import materialize

BINS = "fid bigint, value bigint, bin bigint, cnt bigint, pos bigint"
ASKED = "_rows"


class LookupStream:
    """The look-ups over the Parquet files that come into ``source``.

    ``key`` names a row: one that was seen is ignored when it comes again, whatever its other columns. ``when`` gives the time from which an outcome counts.
    Every ``compact_every`` batches the bins so far are summed up, so a batch reads one sum and the bins since.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        schema: T.StructType,
        folder: str,
        columns: dict[int, str],
        when: Callable[[], Column],
        prior: float,
        key: str = "event_id",
        cutoff: int = DAY,
        strength: float = 20.0,
        bin_sec: int = HOUR,
        compact_every: int = 16,
    ):
        self.spark, self.source, self.schema, self.folder = spark, source, schema, folder.rstrip("/")
        self.columns, self.when, self.prior, self.key = columns, when, prior, key
        self.cutoff, self.strength, self.bin_sec, self.compact_every = cutoff, strength, bin_sec, compact_every
        needed = dict.fromkeys([key, "timestamp", "label_type", "label_time", *columns.values()])
        self.kept = [c for c in needed if c in schema.names]

    # --- state ----------------------------------------------------------------------------------

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{table}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, table: str, schema, first: int, last: int) -> DataFrame:
        """The table's partitions of the batches from ``first`` to ``last``; none is an empty table."""
        if last < first:
            return self.spark.createDataFrame([], schema)
        kept = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table}/batch={b}" for b in range(first, last + 1)])
        return kept

    def _bins(self, batch: int) -> DataFrame:
        """All bins up to a batch: the last sum before it, and what came since."""
        base = batch // self.compact_every * self.compact_every - 1
        since = self._read("bins", BINS, base + 1, batch)
        if base >= 0:
            since = since.unionByName(self._read("sums", BINS, base, base))
        return since.groupBy("fid", "value", "bin").agg(F.sum("cnt").alias("cnt"), F.sum("pos").alias("pos"))

    # --- one batch ------------------------------------------------------------------------------

    def _probed(self, rows: DataFrame) -> DataFrame:
        """(key, fid, value, probe) for everything a row asks for."""
        asked = F.explode(history_values(self.columns)).alias("p")
        probes = rows.select(self.key, probe_bin(F.col("timestamp"), self.cutoff, self.bin_sec).alias("probe"), asked).select(self.key, "probe", "p.*")
        return probes.where((F.col("fid") == GLOBAL_FID) | (F.col("value") > 0))

    def process(self, arrived: DataFrame, batch: int) -> None:
        """New rows are stored and counted; they and the older rows whose history they change are looked up."""
        row_schema = arrived.select(*self.kept).schema
        seen = self._read(ASKED, row_schema, 0, batch - 1)
        arrived = arrived.select(*self.kept).dropDuplicates([self.key])
        fresh = self._write(null_safe_join(arrived, seen.select(self.key), [self.key], "left_anti"), ASKED, batch)
        added = self._write(history_bins(fresh, self.columns, self.when(), self.bin_sec), "bins", batch)
        bins = materialize(self._bins(batch))
        if batch % self.compact_every == self.compact_every - 1:
            self._write(bins, "sums", batch)
        # an older row is asked again if something was added that it could have seen
        earliest = added.groupBy("fid", "value").agg(F.min("bin").alias("first"))
        changed = self._probed(seen).join(earliest, ["fid", "value"]).where("first <= probe").select(self.key).distinct()
        asked = fresh.unionByName(null_safe_join(seen, materialize(changed), [self.key], "left_semi"))
        store = materialize(history_cumulative(bins, self.bin_sec))
        found = history_lookup(asked, store, self.columns, self.cutoff, self.strength, self.prior, self.bin_sec)
        self._write(found.select(self.key, *history_columns(list(self.columns))), "answers", batch)

    # --- the stream -----------------------------------------------------------------------------

    def run(self, files_per_batch: int | None = None) -> DataFrame:
        """Takes in what has come since the last call, of this session or another, and returns the answers."""
        reader = self.spark.readStream.schema(self.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        stream = reader.parquet(self.source).writeStream.foreachBatch(lambda df, batch: self.process(df, batch))
        query = stream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.answers()

    def answers(self) -> DataFrame:
        """The last answer to each row."""
        table = self.spark.read.option("basePath", f"{self.folder}/answers").parquet(f"{self.folder}/answers")
        values = [c for c in table.columns if c not in (self.key, "batch")]
        last = table.groupBy(self.key).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
        return last.select(self.key, "_last.*")
