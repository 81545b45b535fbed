"""Near-duplicate components with HyperMinHash sketches.

A shingle's hash picks a register by its first bits; the register keeps the smallest rest as a leading-zero count and
``MANTISSA`` bits after the leading one. Bands of ``ROWS`` of 128 registers give the candidates: at a linking
similarity of 0.85 a pair misses all bands with probability (1 - 0.85 ** 4) ** 32 = 6e-11, at 0.8 with 5e-8, so no pair
is lost in practice. Candidates get a finer sketch of 512 registers. A pair whose collision-corrected estimate is far below the
threshold (six standard errors and more) is dropped; the rest are confirmed on the full shingle sets, from the whole texts.

Documents with equal shingle sets form one class, and only classes are compared. Buckets are never expanded into all
pairs: each class is first tested against one centre (the class of its buckets that shares most buckets with others),
and components are formed. Then only pairs of a bucket that are still in different components are tested, all of
them, so the components are those of the whole link graph. A bucket of more than ``SMALL`` classes is cut into blocks
that meet two by two, in groups of bounded size that hand on only the pairs with a good estimate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import free, register, table
from tallyrow.llm.bytescan import LOWER, SPACED, U64, Words, as_long, mix, windows, words
from tallyrow.llm.components import components
from tallyrow.llm.repeats import row_key
from tallyrow.session import materialize

SHINGLE = 5
PERCENT = 85
COARSE, FINE = 7, 9  # sketches of 2 ** 7 and 2 ** 9 registers
MANTISSA = 10
ROWS = 4
BLOCK = 384  # classes in a block of a large bucket
SMALL = 16  # classes of a bucket that is joined with itself
ERRORS = 6.0


def shingle_sets(w: Words, size: int = SHINGLE):
    """Sorted distinct shingle hashes of each text."""
    h = w.hashes()
    runs = windows(h, size)
    for i in range(len(w.rows)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        else:
            yield windows(h[a:b], b - a) if b > a else np.zeros(0, U64)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return np.array([mix(shingles ^ U64(11)).sum(dtype=U64), mix(shingles ^ U64(13)).sum(dtype=U64)], U64).tobytes()


def sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """2 ** bits uint16 registers: (leading zeros + 1) and mantissa; 0 is an empty register."""
    x = np.sort(mix(shingles ^ U64(17)))
    index = np.arange(1 << bits, dtype=U64)
    at = np.searchsorted(x, index << U64(64 - bits))
    least = x[np.minimum(at, len(x) - 1)]
    filled = (at < len(x)) & (least >> U64(64 - bits) == index)
    below = U64((1 << (64 - bits)) - 1)
    rest = least & below
    # a double holds the first 53 bits of the rest
    drop = 64 - bits - 53
    zeros = 53 - np.frexp((rest >> U64(drop)).astype(np.float64))[1]
    mantissa = ((rest << (zeros + 1).astype(U64)) & below) >> U64(64 - bits - MANTISSA)
    return np.where(filled, ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16), 0).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band that has a filled register."""
    packed = registers.view(U64)
    band = np.flatnonzero(packed)
    return mix(packed[band] ^ mix(band.astype(U64)))


def promising(equal: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes n and m may be similar, by the equal ones of the registers that either of them fills.

    Equal registers without a shared minimum are expected in 0.1699 * 2 ** (p - r) * phi registers, with
    phi = 4 q / (1 + q) ** 2 for the ratio q of the sizes. A filled register is a draw without replacement from
    the union, whose size at the threshold p is (n + m) / (1 + p), which gives the standard error.
    """
    p = percent / 100
    q = np.minimum(n, m) / np.maximum(n, m)
    chance = 0.1699 * 2.0 ** (FINE - MANTISSA) * 4 * q / (1 + q) ** 2
    used = np.maximum(used, 1)
    jaccard = (equal - chance) / used
    left = np.maximum(1 - used * (1 + p) / (n + m), 0.0)
    return (jaccard >= p - ERRORS * np.sqrt(p * (1 - p) / used * left) - 3 / used) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Sorted distinct hashes: 100 * intersection >= percent * union."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketched(documents: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, cls, registers); ``key`` names the row, ``cls`` and registers are null for an empty set."""

    def scan(batches):
        for batch in batches:
            n, cls, registers = [], [], []
            for w in words(batch.column(2), SPACED, LOWER):
                for s in shingle_sets(w):
                    n.append(len(s))
                    cls.append(digest(s) if len(s) else None)
                    registers.append(sketch(s, COARSE).tobytes() if len(s) else None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "cls", "registers"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    return documents.select("doc_id", row_key(documents).alias("key"), text.alias("text")).mapInArrow(
        scan, f"doc_id {id_type}, key bigint, n_shingles bigint, cls binary, registers binary"
    )


def _finely(texts: DataFrame) -> DataFrame:
    """Adds ``fine``, the sketch of 512 registers, to (node, n, text, registers)."""

    def scan(batches):
        for batch in batches:
            fine = [sketch(s, FINE).tobytes() for w in words(batch.column(2), SPACED, LOWER) for s in shingle_sets(w)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fine, pa.binary())], [*batch.schema.names, "fine"])

    return texts.mapInArrow(scan, "node bigint, n bigint, text string, registers binary, fine binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node, n) for every band of every class."""

    def scan(batches):
        for batch in batches:
            keys = [band_keys(np.frombuffer(r.as_py(), np.uint16)) for r in batch.column(2)]
            times = [len(k) for k in keys]
            if sum(times):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(as_long(np.concatenate(keys))),
                        pa.array(np.repeat(np.asarray(batch.column(0)), times)),
                        pa.array(np.repeat(np.asarray(batch.column(1)), times)),
                    ],
                    ["bucket", "node", "n"],
                )

    return classes.select("node", "n_shingles", "registers").mapInArrow(scan, "bucket bigint, node bigint, n bigint")


def _fits(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _estimated(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose fine sketches leave them a chance."""

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, 1 << FINE) for i in (2, 3))
            filled = left > 0
            equal = ((left == right) & filled).sum(axis=1)
            used = (filled | (right > 0)).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(promising(equal, used, np.asarray(batch.column(4)), np.asarray(batch.column(5)), percent)))

    one = texts.select(F.col("node").alias("a"), F.col("fine").alias("fa"), F.col("n").alias("na"))
    two = texts.select(F.col("node").alias("b"), F.col("fine").alias("fb"), F.col("n").alias("nb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "fa", "fb", "na", "nb")
    return joined.mapInArrow(scan, "a bigint, b bigint")


def _meetings(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Promising pairs (a, b) of different roots in large buckets.

    The classes of a bucket are dealt to blocks by hash; every two blocks meet in one group. A pair is given only in
    the first of the bands that it shares.
    """

    def meet(key, part):
        here = key[0].as_py() & ((1 << 64) - 1)
        first, second = key[1].as_py(), key[2].as_py()
        node, root, n, block = (np.asarray(part.column(c)) for c in ("node", "root", "n", "block"))
        fine = np.frombuffer(b"".join(part.column("fine").to_pylist()), np.uint16).reshape(-1, 1 << FINE)
        coarse = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, 1 << COARSE)
        rows, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
        found = []
        if first != second or len(np.unique(root)) > 1:
            filled = fine > 0
            for i in rows:
                js = others[(root[others] != root[i]) & ((first != second) | (node[others] > node[i]))]
                js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
                if not len(js):
                    continue
                equal = ((fine[js] == fine[i]) & filled[i]).sum(axis=1)
                used = (filled[js] | filled[i]).sum(axis=1)
                for j in js[promising(equal, used, n[js], np.full(len(js), n[i]), percent)]:
                    a, b = coarse[i].view(U64), coarse[j].view(U64)
                    band = np.flatnonzero((a == b) & (a > 0))[:1]
                    if int(mix(a[band] ^ mix(band.astype(U64)))[0]) == here:
                        found.append((node[i], node[j]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.join(texts.select("node", "fine", "registers"), "node")
    dealt = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        "bucket", F.least("block", "partner").alias("first"), F.greatest("block", "partner").alias("second"), "node", "root", "n", "block", "fine", "registers"
    )
    return dealt.groupBy("bucket", "first", "second").applyInArrow(meet, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar."""

    def scan(batches):
        for batch in batches:
            sets = [[s for w in words(batch.column(i), SPACED, LOWER) for s in shingle_sets(w)] for i in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array([similar(x, y, percent) for x, y in zip(*sets)], pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(scan, "a bigint, b bigint")


def link_near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, key, root) for every row.

    Texts are compared as sets of distinct 5-word shingles after lower-casing A-Z; a text of fewer words is one shingle,
    and one without words, empty or null, has none and is linked with nothing: its component is its own id. Rows are
    linked when 100 * intersection >= percent * union; ``component_id`` is the smallest id reachable. Repeated rows have
    equal sets and share a component; a null id is no candidate for ``component_id``, which is null only if every id of
    the component is. ``kept`` marks rows whose id is the component's; other columns are ignored. ``key`` hashes id and text, ``root`` numbers
    the components and is null for rows without words.
    """
    rows = materialize(_sketched(documents))
    # null ids sort first, so they are set behind
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n_shingles", "registers")).alias("x")
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(first)
    classes = materialize(classes.select("cls", "x.doc_id", "x.key", "x.n_shingles", "x.registers", F.monotonically_increasing_id().alias("node")))

    buckets = _buckets(classes)
    # written, so that the join is of plain exchanges, of which Spark splits the hot ones
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = materialize(buckets.join(shared, "bucket"))

    # texts and fine sketches of the classes that share a bucket
    wanted = classes.join(members.select("node").distinct(), "node").select("key", "node", "registers", F.col("n_shingles").alias("n"))
    source = documents.select(row_key(documents).alias("key"), F.col("text").cast("string").alias("text"))
    matched = source.join(wanted, "key")
    texts = materialize(_finely(matched.select("node", "n", "text", "registers").dropDuplicates(["node"])))

    # one centre for each class: a base text shares more buckets than its variants do
    score = members.groupBy("node").agg((F.sum("size") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("score"))
    scored = materialize(members.join(score, "node"))
    centres = scored.groupBy("bucket").agg(F.max_by("node", "score").alias("centre"), F.max("score").alias("top"), F.max_by("n", "score").alias("nc"))
    offers = scored.join(centres, "bucket").where((F.col("node") != F.col("centre")) & _fits("n", "nc", percent))
    stars = offers.groupBy(F.col("node").alias("a")).agg(F.max_by("centre", "top").alias("b"))
    linked = materialize(_confirmed(_estimated(stars, texts, percent), texts, percent))

    # what is still apart inside a bucket, pair by pair
    roots = materialize(components(linked))
    labelled = materialize(scored.join(roots, "node", "left").select("bucket", "node", "n", "size", F.coalesce("root", "node").alias("root")))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    open_ = labelled.join(mixed, "bucket")
    small = open_.where(F.col("size") <= SMALL)
    left = small.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = small.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    apart = left.join(right, "bucket").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _fits("na", "nb", percent))
    close = _estimated(apart.select("a", "b").distinct(), texts, percent).union(_meetings(open_.where(F.col("size") > SMALL), texts, percent)).distinct()
    more = _confirmed(materialize(close), texts, percent)
    roots = materialize(components(materialize(linked.union(more))))

    by_node = classes.select("cls", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = by_node.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = by_node.join(smallest, "root").select(F.col("cls").alias("of"), "component_id", "root")
    found = rows.join(by_class, F.col("cls") == F.col("of"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key", "root")


def one_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows, unchanged, that stand for their component: one row each, with the component's id.

    Rows without words are components of their own; of rows equal in id and text one stays.
    """
    row, key = free(documents, "__row"), free(documents, "__key")
    linked = link_near_duplicates(documents, percent).where("kept")
    chosen = linked.groupBy(F.coalesce("root", "key").alias("of"), F.col("root").isNull()).agg(F.min("key").alias(key)).select(key)
    rows = documents.withColumn(row, row_key(documents))
    return rows.join(materialize(chosen), F.col(row) == F.col(key)).dropDuplicates([row]).select(*documents.columns)


@register("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(table(spark, sf_dir, "documents"), PERCENT).drop("key", "root")
