"""Supervised subword embeddings: a text is the mean of learned vectors of its hashed features.

Features are words, pairs of neighbouring words (a word that repeats its neighbour is one feature of its own,
whatever the word, since that marks generated text) and the 3- and 4-grams of the characters of each word. The mean feeds a softmax layer. Vectors and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows, of which the driver holds a part at a time.

After training a feature only matters through its product with the layer, so scoring needs one number per
feature and class. They are kept as integers: sums are then exact and a score does not depend on how rows are
batched. The model has a fixed size (``BUCKETS`` x classes), which bounds what is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.llm.bytescan import SPACED, Words, mix, words
from tallyrow.session import materialize

WORDS = 1 << 15
PAIRS = 1 << 15
GRAMS = 1 << 16
BUCKETS = WORDS + PAIRS + GRAMS
DIM = 8
EPOCHS = 6
LEAST_STEPS = 12_000  # small samples are seen more often
RATE = 0.4
SAMPLE_ROWS = 2_400  # labelled rows to learn from, the same number of each class
PARTS = 16  # the sample is learnt from part by part
HELD_BYTES = 1 << 27  # features of parts that are kept for the next epoch
FIXED = 1 << 20  # fixed-point scale of the scores
U64, U32 = np.uint64, np.uint32


#: Fixed-point weights, (classes, BUCKETS), and the classes' biases: plain arrays, as they are broadcast.
Model = tuple[np.ndarray, np.ndarray]


def _features(w: Words):
    """(bucket, first index of each text, of each text's end) for every kind of feature."""
    h = w.hashes()
    first, bounds = w.first, w.bounds
    yield (h & U64(WORDS - 1)).astype(np.int32), first[:-1], first[1:]
    if len(h) > 1:
        pair = (mix(h[:-1] * U64(3) + h[1:]) & U64(PAIRS - 1)).astype(np.int32)
        pair[h[:-1] == h[1:]] = 0
        yield pair + WORDS, first[:-1], np.maximum(first[1:] - 1, first[:-1])
    # characters: the first byte of each, their code points, and the text they are in
    starts = np.flatnonzero((w.data & 0xC0) != 0x80)
    code = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), U32)
    text = np.searchsorted(bounds, starts, side="right") - 1
    inside = SPACED[w.data[starts]]
    for n, seed in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        m = len(code) - n + 1
        if m <= 0:
            continue
        whole = text[:m] == text[n - 1 :]
        gram = np.zeros(m, U32)
        for i in range(n):
            whole &= inside[i : m + i]
            gram = (gram + code[i : m + i]) * U32(seed)
            gram ^= gram >> U32(15)
        gram *= U32(0x2C1B3C6D)
        own = text[:m][whole]
        places = np.searchsorted(own, np.arange(len(bounds)))
        yield (gram[whole] >> U32(16)).astype(np.int32) + (WORDS + PAIRS), places[:-1], places[1:]


def _sparse(column: pa.Array):
    """(buckets, counts) of each text."""
    for w in words(column, SPACED):
        kinds = list(_features(w))
        for i in range(len(w.rows)):
            found = np.concatenate([b[s[i] : e[i]] for b, s, e in kinds])
            yield np.unique(found, return_counts=True)


def sample(documents: DataFrame, labels: DataFrame, label: str, classes: tuple, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids, as many of each class, by a hash of the id; an id labelled twice takes its largest label."""
    spark = documents.sparkSession
    per_class = max(1, rows // len(classes))
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids: list[tuple] = []
    for i, value in enumerate(classes):
        chosen = marked.where(F.col("label") == F.lit(value)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids += [(r.doc_id, i) for r in chosen.collect()]
    id_type = labels.schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame(ids, f"doc_id {id_type}, label int")


def train(documents: DataFrame, chosen: DataFrame, shares: list[float], classes: tuple, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Fit on the chosen rows (bounded by ``sample``); ``shares`` are the classes' shares of all labelled rows."""

    def featurize(batches):
        for batch in batches:
            for label, part, (buckets, counts) in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _sparse(batch.column(0))):
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": pa.array([label], pa.int32()),
                        "part": pa.array([part], pa.int32()),
                        "buckets": pa.array([buckets.astype(np.int32).tobytes()], pa.binary()),
                        "counts": pa.array([counts.astype(np.min_scalar_type(counts.max(initial=0))).tobytes()], pa.binary()),
                    }
                )

    # one text for each id, and SAMPLE_ROWS ids at most, each of at most BUCKETS entries
    own = F.struct(F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    picked = documents.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(own).alias("own"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    stored = materialize(picked.select("own.text", "label", part).mapInArrow(featurize, "label int, part int, buckets binary, counts binary"))
    sizes = stored.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    held: dict[int, list] = {}

    def fetched(number: int) -> list:
        if number in held:
            return held[number]
        docs = []
        for r in stored.where(F.col("part") == number).select("label", "buckets", "counts").toLocalIterator():
            buckets = np.frombuffer(r.buckets, np.int32)
            # counts are as wide as the largest of the text needs
            docs.append((r.label, buckets, np.frombuffer(r.counts, f"u{len(r.counts) // max(1, len(buckets)) or 1}")))
        # an order that does not depend on how the rows were dealt
        docs.sort(key=lambda d: (d[0], len(d[1]), d[1].tobytes(), d[2].tobytes()))
        if sum(d[1].nbytes + d[2].nbytes for kept in [*held.values(), docs] for d in kept) <= HELD_BYTES:
            held[number] = docs
        return docs

    k = len(classes)
    total = sum(r.n for r in sizes)
    seen = np.maximum([sum(r.n for r in sizes if r.label == c) for c in range(k)], 1) if total else np.ones(k)
    importance = np.asarray(shares) / (seen / seen.sum())
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, k), np.float32)
    bias = np.log(np.maximum(np.asarray(shares), 1e-6)).astype(np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // max(1, total))) if total else 0
    steps, done = max(1, epochs * total), 0
    order = ((docs, i) for _ in range(epochs) for number in rng.permutation(PARTS) for docs in [fetched(int(number))] for i in rng.permutation(len(docs)))
    for docs, i in order:
        y, buckets, counts = docs[i]
        rate = RATE * (1 - done / steps)
        done += 1
        if not len(buckets):
            continue
        share = (counts / counts.sum(dtype=np.float64)).astype(np.float32)
        own = vectors[buckets]
        mean = share @ own
        logits = mean @ layer + bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[y] -= 1
        p *= min(float(importance[y]), 4.0)
        back = layer @ p
        layer -= rate * np.outer(mean, p)
        bias -= np.float32(0.1 * rate) * p
        # the gradient of a mean is tiny for each feature; the step is scaled up by their number
        scale = rate * min(len(buckets), 256)
        vectors[buckets] = own - scale * np.outer(share, back)
    weights = np.rint((vectors.astype(np.float64) @ layer).T * FIXED).astype(np.int64)
    return np.ascontiguousarray(weights), bias.astype(np.float64)


def posteriors(model: Model, column: pa.Array) -> np.ndarray:
    """Softmax output of every text, (rows, classes); an empty text gives the prior."""
    weights, bias = model
    k = len(bias)
    out = []
    for w in words(column, SPACED):
        total = np.zeros((len(w.rows), k), np.int64)
        n = np.zeros(len(w.rows), np.int64)
        for buckets, s, e in _features(w):
            # an empty text at the end may begin behind the last feature
            s, e = np.minimum(s, len(buckets)), np.minimum(e, len(buckets))
            n += e - s
            for c in range(k):
                run = np.zeros(len(buckets) + 1, np.int64)
                np.cumsum(weights[c][buckets], out=run[1:])
                total[:, c] += run[e] - run[s]
        out.append(total / FIXED / np.maximum(n, 1)[:, None] + bias)
    if not out:
        return np.zeros((0, k))
    logits = np.concatenate(out)
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label_shares(labels: DataFrame, label: str, classes: tuple) -> list[float]:
    """Shares of the classes in all labelled rows."""
    counts = {
        r.label: r.n
        for r in labels.where(F.col(label).isin(list(classes))).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()
    }
    total = sum(counts.values())
    return [counts.get(c, 0) / total if total else 1 / len(classes) for c in classes]


def fit(documents: DataFrame, labels: DataFrame, label: str, classes: tuple, rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``label`` from the text of the documents that ``labels`` names."""
    labels = labels.select("doc_id", label)
    return train(documents.select("doc_id", "text"), sample(documents, labels, label, classes, rows), label_shares(labels, label, classes), classes)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5
