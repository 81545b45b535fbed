"""Removal of long repeated word spans by compaction of a word De Bruijn graph.

The graph's nodes are runs of 34 words, its edges the windows of 35 words. What is wanted are the edges that occur
at two places or more; almost none need to be looked at one by one:

1. Every edge has a minimizer, the least hash among its runs of ``MINIMIZER`` words. Consecutive edges of a text
   with one minimizer at one place form a path piece, which is one row (hash of the minimizer, hash of the piece's words,
   place). Equal edges have equal minimizers, so edges of pieces without a common minimizer differ.
2. Pieces are counted by minimizer. A minimizer with a single piece is dropped. If all its pieces are equal, the path
   does not branch there, and its repeated edges are compacted to one piece that a join marks at all its places.
3. Only where different pieces share a minimizer, so where paths branch, is each distinct piece opened once into
   its edges, which are counted with the number of places of their pieces.
4. The marked pieces and edges come back to their texts by source coordinates, where neighbours grow together to
   maximal spans; no span is shorter than 35 words. The words under the spans are removed.

Counting is pre-aggregated before its shuffles. A hash of a minimizer together with one of the piece or edge has
128 bits. Texts are read whole. A row is named by a hash of its id and its text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import free, register, table
from tallyrow.llm.bytescan import SPACED, U64, Words, as_long, mix, windows, words
from tallyrow.session import materialize

WINDOW = 35
MINIMIZER = 8
PIECE = "mini bigint, piece bigint, row bigint, start int, n int"


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def pieces(w: Words, window: int = WINDOW, minimizer: int = MINIMIZER):
    """(text, first edge in the text, edges, minimizer, piece hash, edge hashes) of all path pieces of some texts.

    The edge hashes are of all places of the chunk; a piece's edges start at its first word.
    """
    h = w.hashes()
    sizes = np.diff(w.first) - window + 1
    if not len(h) or sizes.max(initial=0) <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U64), none.view(U64), none.view(U64), none
    minimizer = min(minimizer, window)
    runs = windows(h, minimizer, 3)
    least = sliding_least(runs, window - minimizer + 1)
    edges = windows(h, window, 5)
    # places where an edge lies inside one text
    count = np.maximum(sizes, 0)
    text = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][text]
    value = least[place]
    new = np.ones(len(place), bool)
    # a piece ends with the minimizer's (leftmost) place, so no edge occurs twice in a piece
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1]) | (runs[place[:-1]] == value[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(place)))
    start = place[begin]
    # the words of a piece are chained edges: its hash covers all of them
    chain = np.zeros(len(edges) + 1, U64)
    order = np.arange(1, len(edges) + 1, dtype=U64)
    np.cumsum(mix(edges), out=chain[1:])
    weighted = np.zeros(len(edges) + 1, U64)
    np.cumsum(mix(edges) * order, out=weighted[1:])
    plain = chain[start + n] - chain[start]
    piece = mix(plain + mix(weighted[start + n] - weighted[start] - plain * start.astype(U64)) + n.astype(U64))
    return text[begin], start - w.first[:-1][text[begin]], n, value[begin], piece, edges, start


def row_key(documents: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))


def _pieces_of(documents: DataFrame, window: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            row = np.asarray(batch.column(0))
            for w in words(batch.column(1), SPACED):
                text, first, n, mini, piece, _, _ = pieces(w, window)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(as_long(mini)),
                            pa.array(as_long(piece)),
                            pa.array(row[w.rows.start : w.rows.stop][text]),
                            pa.array(first.astype(np.int32)),
                            pa.array(n.astype(np.int32)),
                        ],
                        ["mini", "piece", "row", "start", "n"],
                    )

    return documents.select(row_key(documents).alias("row"), F.col("text").cast("string")).mapInArrow(scan, PIECE)


def _opened(documents: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(mini, piece, edges) of the wanted (row, mini, piece), each piece once."""

    def scan(batches):
        for batch in batches:
            asked = batch.column(1).to_pylist()
            for w in words(batch.column(0), SPACED):
                text, _, n, mini, piece, edges, start = pieces(w, window)
                mini, piece, edges = as_long(mini), as_long(piece), as_long(edges)
                border = np.searchsorted(text, np.arange(len(w.rows) + 1))
                out = []
                for i in range(len(w.rows)):
                    left = {(a["mini"], a["piece"]) for a in asked[w.rows.start + i]}
                    for j in range(border[i], border[i + 1]):
                        key = (int(mini[j]), int(piece[j]))
                        if key in left:
                            left.discard(key)
                            out.append((*key, edges[start[j] : start[j] + n[j]]))
                if out:
                    lengths = np.cumsum([0, *(len(o[2]) for o in out)])
                    lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([o[2] for o in out])))
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), lists], ["mini", "piece", "edges"])

    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("mini", "piece")).alias("asked"))
    texts = documents.select(row_key(documents).alias("row"), F.col("text").cast("string").alias("text"))
    found = texts.join(asked, "row").select("text", "asked").mapInArrow(scan, "mini bigint, piece bigint, edges array<bigint>")
    return found.dropDuplicates(["mini", "piece"])


def repeated_spans(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, spans): for each row with repeated edges, (first edge << 32 | edges) of runs of them, in any order."""
    places = materialize(_pieces_of(documents, window))
    counted = places.groupBy("mini").agg(F.count("*").alias("places"), F.min("piece").alias("low"), F.max("piece").alias("high"))
    # written, so that the joins below are of plain exchanges, of which Spark splits the hot ones
    shared = materialize(counted.where("places > 1").select("mini", (F.col("low") == F.col("high")).alias("straight")))
    repeated = materialize(places.join(shared, "mini"))

    branching = repeated.where("not straight")
    distinct = materialize(branching.groupBy("mini", "piece").agg(F.count("*").alias("places"), F.min("row").alias("row")))
    opened = _opened(documents, distinct.select("row", "mini", "piece"), window).join(distinct.select("mini", "piece", "places"), ["mini", "piece"])
    edges = materialize(opened.select("mini", "piece", "places", F.posexplode("edges").alias("at", "edge")))
    often = materialize(edges.groupBy("mini", "edge").agg(F.sum("places").alias("places")).where("places > 1").select("mini", "edge"))
    # a piece with several places is repeated as a whole; of the others, the edges that another piece has
    some = edges.where("places = 1").join(often, ["mini", "edge"]).groupBy("mini", "piece").agg(F.collect_list("at").alias("at"))
    parts = materialize(distinct.select("mini", "piece", "places").join(some, ["mini", "piece"], "left").where("places > 1 or at is not null"))
    branched = branching.join(parts, ["mini", "piece"]).select("row", "start", "n", "at")

    def span(first: Column, n: Column) -> Column:
        return F.shiftleft(first.cast("bigint"), 32) + n

    whole = repeated.where("straight").union(branched.where("at is null").select(F.lit(0), F.lit(0), "row", "start", "n", F.lit(False)))
    single = branched.where("at is not null").select("row", "start", F.explode("at").alias("at"))
    spans = whole.select("row", span(F.col("start"), F.col("n")).alias("span")).union(single.select("row", span(F.col("start") + F.col("at"), F.lit(1))))
    return spans.groupBy("row").agg(F.collect_set("span").alias("spans"))


def removed_words(spans: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Mask of the words under maximal runs of repeated edges."""
    change = np.zeros(n_words + 1, np.int64)
    first, n = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(first + n + window - 1, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _cleaned(batch_text: pa.Array, spans: list, window: int):
    """For each text: (words, removed words, mask or None, the chunk and index of the text)."""
    for w in words(batch_text, SPACED):
        for i in range(len(w.rows)):
            n = int(w.first[i + 1] - w.first[i])
            own = spans[w.rows.start + i]
            gone = removed_words(np.asarray(own, np.int64), n, window) if own else None
            yield n, int(gone.sum()) if gone is not None else 0, gone, w, i


def _joined(documents: DataFrame, window: int) -> DataFrame:
    row, key, found = (free(documents, n) for n in ("__row", "__key", "__spans"))
    rows = documents.withColumn(row, row_key(documents))
    spans = repeated_spans(documents, window).select(F.col("row").alias(key), F.col("spans").alias(found))
    return rows.join(spans, F.col(row) == F.col(key), "left").drop(row, key)


def repeat_report(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    Words are runs of anything but space and bytes 9-13, as they are. A word is removed when a window of ``window`` words
    over it occurs anywhere else, in its own text too. A null or empty text has no words and the digest of the empty text; so
    has one that is removed as a whole. Repeated rows are copies of each other and are removed where they are long enough.
    Null ids are kept, other columns are ignored.
    """

    def scan(batches):
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for n, removed, gone, w, i in _cleaned(batch.column(1), batch.column(2).to_pylist(), window):
                a, b = int(w.first[i]), int(w.first[i + 1])
                keep = np.arange(a, b) if gone is None else np.arange(a, b)[~gone]
                kept = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist()))
                n_words.append(n)
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = _joined(documents.select("doc_id", F.col("text").cast("string").alias("text")), window)
    return rows.mapInArrow(scan, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows without their repeated words; ``n_chars``, if there, is counted anew.

    A text without repeats stays as it is. Of the others the white space between two kept words stays, and one space
    stands for what was removed between them. Every row stays, also with an empty text.
    """
    names = documents.columns
    at = names.index("text")

    def scan(batches):
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            old = column.to_pylist()
            texts = []
            for j, (_, removed, gone, w, i) in enumerate(_cleaned(column, batch.column(len(names)).to_pylist(), window)):
                if not removed:
                    texts.append(old[j])
                    continue
                a = int(w.first[i])
                edge = np.diff(np.concatenate([[0], (~gone).astype(np.int8), [0]]))
                runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
                texts.append(b" ".join(w.data[w.starts[a + s] : w.ends[a + e - 1]].tobytes() for s, e in runs).decode("utf-8", "replace"))
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                counted = [c if t is o else len(t) for c, t, o in zip(columns[k].to_pylist(), texts, old)]
                columns[k] = pa.array(counted, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _joined(documents, window).mapInArrow(scan, documents.schema)


SQL = """
WITH w AS (
  SELECT doc_id, i, word FROM (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents))),
v AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER s = 35 THEN md5(string_agg(word, ' ') OVER s) END AS edge
  FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
often AS (SELECT edge FROM v WHERE edge IS NOT NULL GROUP BY edge HAVING count(*) > 1),
marked AS (SELECT v.doc_id, v.i, often.edge IS NOT NULL AS hit FROM v LEFT JOIN often USING (edge)),
gone AS (
  SELECT doc_id, i, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM marked),
per AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM w JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN per USING (doc_id)"""


@register("op1_repeats", SQL)
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
