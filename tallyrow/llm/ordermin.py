"""Order MinHash fingerprints from DataFrame expressions alone.

The k-mers of a text are runs of three words, numbered by occurrence: the second place of a k-mer is another element than
its first. The ``SIZE`` elements with the least hashes are selected in one permutation, put back into their text order, and
every two neighbours are hashed together. The set of these tuple hashes is the signature. An edit changes the elements
it touches, and a moved passage changes the neighbours at its borders, so the likeness of two signatures (intersection over
union) follows edit distance more closely than that of unordered shingles.

Everything is built-in functions: sorting, duplicates and set operations work on arrays of hashes, never on rows, so no text
is spread over rows and none is shuffled for its fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table
from tallyrow.session import materialize

SIZE = 32
MOST_BLOCKS = 1 << 20
ROWS_PER_BLOCK = 500
BLOCKS_PER_TASK, MOST_TASKS = 4, 1 << 15


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _kmers(text: Column) -> Column:
    """Hashes of the runs of three words; the last two are shorter, so every text has one at least."""
    return _let(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))


def _later(extra: Column) -> Column:
    """(key, hash, occurrence) of all places but the first of each k-mer, from their sorted hashes."""

    def of_runs(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda j: (j == 0) | (F.get(e, j) != F.get(e, j - 1)))

        def run(s: Column) -> Column:
            def one(at: Column, r: Column) -> Column:
                length = F.coalesce(F.get(s, r + 1), F.size(e)) - at
                return F.transform(F.slice(e, at + 1, length), lambda x, o: F.struct(F.xxhash64(x, o + 1).alias("key"), x.alias("hash"), (o + 1).alias("nth")))

            return F.flatten(F.transform(s, one))

        return _let(starts, run)

    empty = F.array().cast("array<struct<key:bigint,hash:bigint,nth:int>>")
    return F.when(F.size(extra) > 0, _let(extra, of_runs)).otherwise(empty)


def add_signature(rows: DataFrame, text: str, name: str, size: int = SIZE) -> DataFrame:
    """Adds the array ``name`` of tuple hashes of the column ``text`` (not null)."""
    kmer, least, once, extra, later, bound = (f"__{name}_{x}" for x in ("kmer", "least", "once", "extra", "later", "bound"))
    rows = rows.withColumn(kmer, _kmers(F.col(text)))
    rows = rows.withColumn(least, F.sort_array(kmer))
    repeated = _let(F.col(least), lambda v: F.filter(v, lambda x, i: x == F.get(v, i + 1)))
    rows = rows.withColumns({once: F.slice(F.array_distinct(least), 1, size), extra: repeated})
    rows = rows.withColumn(later, _later(F.col(extra)))
    keys = F.sort_array(F.concat(F.col(once), F.transform(later, lambda e: e["key"])))
    rows = rows.withColumn(bound, _let(keys, lambda k: F.get(k, F.least(F.size(k), F.lit(size)) - 1)))

    def selected(k: Column) -> Column:
        first = F.transform(F.filter(once, lambda x: x <= F.col(bound)), lambda x: F.struct(F.array_position(k, x).alias("at"), x.alias("key")))

        def place(e: Column) -> Column:
            places = F.filter(F.sequence(F.lit(1).cast("bigint"), F.size(k).cast("bigint")), lambda i: F.get(k, (i - 1).cast("int")) == e["hash"])
            return F.struct(F.get(places, e["nth"]).alias("at"), e["key"].alias("key"))

        return F.array_sort(F.concat(first, F.transform(F.filter(later, lambda e: e["key"] <= F.col(bound)), place)))

    def tuples(o: Column) -> Column:
        return F.transform(o, lambda x, i: F.when(F.size(o) == 1, F.xxhash64(x["key"])).when(i + 1 < F.size(o), F.xxhash64(x["key"], F.get(o, i + 1)["key"])))

    signature = _let(_let(F.col(kmer), selected), tuples)
    signature = F.array_distinct(F.filter(signature, lambda x: x.isNotNull()))
    return rows.withColumn(name, signature).drop(kmer, least, once, extra, later, bound)


def likeness(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def printed(signature: Column | str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "-")


def range_ends(keys: DataFrame, blocks: int) -> DataFrame:
    """One row (ends): the greatest key of each of ``blocks`` ranges with about as many keys, sorted. Spark samples the keys for them."""
    dealt = keys.repartitionByRange(blocks, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.max("key").alias("end"))
    return dealt.agg(F.array_sort(F.collect_set("end")).alias("ends"))


def with_next(rows: DataFrame, order: str, tie: Column, names: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds next_<name> for the row that follows in descending order of ``order`` and ``tie`` (nulls last; after the last row, the first).

    The rows are cut into ranges by sampled quantiles of (order, tie), a range for each ``rows_per_block`` rows, so neither outlying nor null or repeated ids
    make one large. The ranges' ends, MOST_BLOCKS at most, are the only thing broadcast; a binary search finds a row's range. The row
    at the end of a range is also copied to the range above it, behind that range's rows, so every window holds the follower of its last row: rows are
    shuffled once, to a number of tasks that grows with them, and no window spans the table. ``order`` may have any type that can be sorted.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", F.struct(F.col(order).alias("id"), tie.alias("tie")))
    n = rows.count()
    blocks = min(MOST_BLOCKS, -(-n // rows_per_block)) or 1
    # a single list, held by two rows of which each row finds one by an equi-join
    ends = materialize(range_ends(keyed.select(F.col("__key").alias("key")), blocks).select("ends", F.explode(F.array(F.lit(0), F.lit(1))).alias("__half")))
    most = ends.agg(F.max(F.size("ends"))).first()[0] or 1
    held = keyed.withColumn("__side", F.pmod("__key.tie", F.lit(2)).cast("int")).join(F.broadcast(ends), F.col("__side") == F.col("__half"))
    # ends below the key, halving the step
    held = held.withColumn("__block", F.lit(0))
    step = 1 << (most.bit_length() - 1)
    while step:
        probe = F.get(F.col("ends"), F.col("__block") + F.lit(step - 1))
        held = held.withColumn("__block", F.col("__block") + F.when(probe < F.col("__key"), F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    ended = F.col("__key") == F.get("ends", F.col("__block"))
    above = F.pmod(F.col("__block") + 1, F.size("ends"))
    own = F.struct(F.col("__block").alias("block"), F.lit(0).alias("copy"))
    copy = F.struct(above.alias("block"), F.lit(1).alias("copy"))
    dealt = held.withColumn("__place", F.explode(F.when(ended, F.array(own, copy)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, "__key", F.col("__place.block").alias("__at"), F.col("__place.copy").alias("__copy"))
    tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // BLOCKS_PER_TASK), MOST_TASKS)
    along = Window.partitionBy("__at").orderBy("__copy", F.col("__key").desc())
    dealt = dealt.repartition(tasks, "__at").withColumns({f"next_{x}": F.lead(x).over(along) for x in names})
    return dealt.where("__copy = 0").drop("__key", "__at", "__copy")


def fingerprint(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's, in descending order of the id, from the last one to the first. A null text is empty; an empty text has the
    signature of one empty word. Rows with one id follow each other by a hash of their texts, from the greatest down, null ids come last; a single
    row is its own successor. Ids may be numbers or strings. Equal texts have equal fingerprints. Other columns are ignored.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = add_signature(rows, "text", "signature", size)
    rows = with_next(rows, "doc_id", F.xxhash64("text"), ["text", "signature"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    rows = add_signature(rows, "edited", "edited_signature", size)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed("signature").alias("fingerprint"),
        printed("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )


@register("op8_order_minhash")
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
