"""Row groups of Parquet files as blocks: listed from the files' footers, and read without opening other files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce
from operator import or_
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrow.session import materialize
from tallyrow.sources.tables import scan_impressions

CATALOG = (
    "file string, row_group int, first_row bigint, n_rows bigint, byte_start bigint, n_bytes bigint, min_ts bigint, max_ts bigint, "
    "n_nulls bigint, from_stats boolean"
)
UNREAD = -1
MOST_RANGES = 64


def _seconds(value) -> int | None:
    """Epoch seconds of a time stamp, whole numbers as they are."""
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return int(value.timestamp() // 1)
    return None if value is None else int(value)


def _key_range(columns, key: str | None) -> tuple[int | None, int | None]:
    """Least and largest ``key`` of a row group by its statistics; null unless it is a whole number without nulls there."""
    stats = next((c.statistics for c in columns if c.path_in_schema == key), None) if key else None
    known = stats is not None and stats.has_min_max and stats.has_null_count and not stats.null_count and isinstance(stats.min, int)
    return (stats.min, stats.max) if known else (None, None)


def _footer_rows(uri: str, length: int, time: str, key: str | None = None):
    """One tuple for each row group; the time column is read only where a group has no statistics of it."""
    import pyarrow.compute as pc
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    scheme, _, rest = uri.partition(":")
    try:
        system, path = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)
        file = pq.ParquetFile(system.open_input_file(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        yield uri, UNREAD, 0, 0, 0, length, None, None, None, False, None, None  # a store that only Spark reads
        return
    first = 0
    for i in range(file.metadata.num_row_groups):
        group = file.metadata.row_group(i)
        columns = [group.column(c) for c in range(group.num_columns)]
        own = next((c for c in columns if c.path_in_schema == time), None)
        starts = [c.dictionary_page_offset or c.data_page_offset for c in columns]
        low = high = nulls = None
        stats = own.statistics if own is not None else None
        full = stats is not None and stats.has_null_count and (stats.has_min_max or stats.null_count == group.num_rows)
        if not group.num_rows:
            nulls, full = 0, own is not None
        elif full:
            nulls = stats.null_count
            low, high = (stats.min, stats.max) if stats.has_min_max else (None, None)
        elif own is not None:
            values = file.read_row_group(i, columns=[time]).column(0)
            found = pc.min_max(values).as_py()
            low, high, nulls = found["min"], found["max"], values.null_count
        yield uri, i, first, group.num_rows, min(starts, default=0), sum(c.total_compressed_size for c in columns), _seconds(low), _seconds(high), nulls, full, *_key_range(columns, key)
        first += group.num_rows


def row_group_catalog(spark: SparkSession, path: str, time: str = "timestamp", recursive: bool = False, key: str | None = None) -> DataFrame:
    """(block, file, row_group, first_row, n_rows, byte_start, n_bytes, min_ts, max_ts, n_nulls, from_stats) of all files under ``path``.

    Tasks read the footers; a data page is read only in row groups without statistics of the time column, and of that column alone.
    Times are whole numbers as stored, or epoch seconds of a time stamp; a file without the column has null there. A file in a store that tasks
    can't open by its address is read by Spark, the time column only, and is one block with row_group -1. ``block`` sorts by file, then row group.
    ``key``, a column of whole numbers by which files are ordered, adds ``min_key`` and ``max_key`` from the footers, null where they don't tell.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", "length", F.col("_metadata.file_path").alias("file"))

    layout = CATALOG + (", min_key bigint, max_key bigint" if key else "")

    def footers(batches):
        names = [c.split()[0] for c in layout.split(", ")]
        kinds = {"file": pa.string(), "row_group": pa.int32(), "from_stats": pa.bool_()}
        for batch in batches:
            for address, length, file in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = [(file, *row[1:]) for row in _footer_rows(address, length, time, *([key] if key else []))]
                columns = [pa.array([r[k] for r in rows], kinds.get(n, pa.int64())) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names)

    found = materialize(files.mapInArrow(footers, layout))
    unread = [r.file for r in found.where(F.col("row_group") == UNREAD).select("file").collect()]  # one name a file, as in Spark's own listing
    if unread:
        table = scan_impressions(spark, path, recursive)
        ts = _as_seconds(table, time)
        at = F.col("_metadata.file_path")
        read = table.where(at.isin(unread)).groupBy(at.alias("file")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count_if(ts.isNull()).alias("n_nulls")
        )
        empty = found.where(F.col("row_group") == UNREAD).drop("n_rows", "min_ts", "max_ts", "n_nulls")
        read = empty.join(read, "file", "left").fillna(0, ["n_rows", "n_nulls"])
        found = materialize(found.where(F.col("row_group") != UNREAD).unionByName(read))
    return found.select(F.format_string("%s#%06d", "file", "row_group").alias("block"), "*")


def _as_seconds(table: DataFrame, time: str):
    if time not in table.columns:
        return F.lit(None).cast("bigint")
    kind = table.schema[time].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.floor(F.unix_micros(F.to_utc_timestamp(F.col(time).cast("timestamp"), F.lit("UTC"))) / 1_000_000)
    return F.floor(F.unix_micros(time) / 1_000_000) if isinstance(kind, T.TimestampType) else F.col(time).cast("bigint")


def _ranges(spans: DataFrame, low: str, high: str, unknown: Column) -> list[tuple[int, int]]:
    """At most MOST_RANGES ranges that cover all spans, parted at the widest gaps; none if a span has no known range."""
    whole = spans.agg(F.count_if(unknown), F.min(low), F.max(high)).first()
    if whole[0] or whole[1] is None:
        return []
    before = F.max(high).over(W.orderBy(low, high).rowsBetween(W.unboundedPreceding, -1))  # one row a row group
    gaps = spans.select(before.alias("a"), F.col(low).alias("b")).where("b > a + 1").orderBy(F.expr("a - b"), "b").limit(MOST_RANGES - 1)
    inner = sorted((r.a, r.b) for r in gaps.collect())
    return list(zip([whole[1], *[b for _, b in inner]], [*[a for a, _ in inner], whole[2]]))


def rows_of_row_groups(df: DataFrame, chosen: DataFrame, keep: Sequence[str] = (), time: str | None = None, key: str | None = None) -> DataFrame:
    """The rows of the chosen row groups, with the columns ``keep`` of their group.

    ``df`` is read straight from the cataloged files; files without a chosen group are not opened. With ``time``, a column of whole numbers, the
    chosen groups' ranges go to the scan too, which skips groups outside of them in the other files; likewise with ``key``, which the catalog was made with.
    """
    end = (F.col("first_row") + F.col("n_rows")).alias("_end_row")
    ranges = {time: ("min_ts", "max_ts")} if time else {}
    ranges |= {key: ("min_key", "max_key")} if key else {}
    stats = [c for pair in ranges.values() for c in pair]
    spans = materialize(chosen.select(*dict.fromkeys(["file", "first_row", "row_group", "n_rows", "n_nulls", *stats, *keep]), end))
    files = [r.file for r in spans.select("file").distinct().collect()]  # the list of files to scan, as in Spark's own listing
    at, row = "_metadata.file_path", "_metadata.row_index"
    picked = df.where(F.col(at).isin(files))
    for column, (low, high) in ranges.items():
        unknown = F.col(low).isNull() if column == key else F.coalesce(F.col("n_nulls") != 0, F.lit(True)) | F.col(low).isNull()
        within = _ranges(spans.where("n_rows > 0"), low, high, unknown)
        if within:
            picked = picked.where(reduce(or_, [F.col(column).between(*pair) for pair in within]))
    picked = picked.select("*", F.col(at).alias("_file"), F.col(row).alias("_row"))
    marks = spans.select(
        F.col("file").alias("_of"), F.col("first_row").alias("_first_row"), "_end_row", F.col("row_group").alias("_group"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    inside = (F.col("_row") >= F.col("_first_row")) & (F.col("_row") < F.col("_end_row"))
    on = (F.col("_file") == F.col("_of")) & ((F.col("_group") == UNREAD) | inside)
    return picked.join(marks, on).select(*df.columns, *[F.col(f"_keep_{c}").alias(c) for c in keep])
