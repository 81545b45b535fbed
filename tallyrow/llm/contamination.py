"""Benchmark decontamination with a stored positional inverted index of the training texts.

The index is written once, partitioned by documents: a row holds one segment of some consecutive texts, with its sorted terms and for each
the sorted list of its places. It does not depend on the benchmark. The benchmark's distinct phrases are dealt by hash to blocks of a bounded number and
searched one block at a time: a first pass adds up the sizes of the lists of the block's terms, a second one starts from each phrase's rarest
term, and intersects its list with those of the other terms, rarest first, each moved by the term's offset in the phrase. What is
left are exact places. A segment only looks at phrases whose rarest term it has, so phrases that do not occur cost nothing.

Proximity matches have every term within reach of a place of the rarest one, in any order. Which items a phrase belongs to is joined to the hits at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import free, register, table
from tallyrow.llm.bytescan import ALNUM, LOWER, U64, words
from tallyrow.session import materialize

WINDOW = 10
BLOCK_WORDS = 200_000  # phrases in a block, one a word of the benchmark
SEGMENT_WORDS = 1 << 15  # a segment ends with the text that reaches them
CANDIDATES = 1 << 18  # places intersected at once
SPANS = "array<struct<first:bigint,behind:bigint>>"
PHRASES = "array<struct<p1:bigint,p2:bigint>>"


# --- the index ----------------------------------------------------------------------------------


def row_ids() -> list[Column]:
    """128 bits that name a row by id and text."""
    text = F.col("text").cast("string")
    return [F.xxhash64("doc_id", text).alias("row1"), F.xxhash64(text, F.lit(31), "doc_id").alias("row2")]


def build_index(documents: DataFrame) -> DataFrame:
    """(segment, ids, row1, row2, first, terms, sizes, places): one row for each segment of some consecutive texts, stored.

    ``ids``, ``row1`` and ``row2`` are lists with one entry a text, ``first`` has one more, the segment's number of words. ``terms`` are
    sorted 64-bit hashes, ``sizes`` the lengths of their lists, and ``places`` the lists, one behind the other.
    """

    def scan(batches):
        for batch in batches:
            for w in words(batch.column(3), ALNUM, LOWER):
                hashes = w.hashes()
                a = 0
                while a < len(w.rows):
                    b = int(np.searchsorted(w.first, w.first[a] + SEGMENT_WORDS, side="left"))
                    b = min(max(b, a + 1), len(w.rows))
                    h = hashes[w.first[a] : w.first[b]]
                    order = np.argsort(h, kind="stable")
                    h = h[order]
                    begin = np.flatnonzero(np.append(len(h) > 0, h[1:] != h[:-1]))
                    lists = [batch.column(i).slice(w.rows.start + a, b - a) for i in range(3)]
                    packed = [h[begin], np.diff(np.append(begin, len(h))).astype(np.int32), order.astype(np.int32)]
                    columns = [pa.array([x.to_pylist()], pa.list_(x.type)) for x in lists]
                    columns += [pa.array([(w.first[a : b + 1] - w.first[a]).tolist()], pa.list_(pa.int64()))]
                    columns += [pa.array([x.tobytes()], pa.binary()) for x in packed]
                    yield pa.RecordBatch.from_arrays(columns, ["ids", "row1", "row2", "first", "terms", "sizes", "places"])
                    a = b

    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{id_type}>, row1 array<bigint>, row2 array<bigint>, first array<bigint>, terms binary, sizes binary, places binary"
    rows = documents.select("doc_id", *row_ids(), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(scan, schema).withColumn("segment", F.monotonically_increasing_id()))


class Segment:
    """The stored lists of one segment."""

    def __init__(self, first: list[int], terms: bytes, sizes: bytes, places: bytes) -> None:
        self.first = np.asarray(first)
        self.terms = np.frombuffer(terms, U64)
        self.sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.places = np.frombuffer(places, np.int32).astype(np.int64)
        self.n = int(self.first[-1])
        # term and place in one sorted number
        self.keys = np.repeat(np.arange(len(self.terms)), self.sizes) * max(self.n, 1) + self.places

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def present(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers in ``terms``, own numbers) of the terms that both have; both are sorted."""
        if not len(terms) or not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        own = np.flatnonzero(terms[at] == self.terms)
        return at[own], own

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term's list has a place from ``low`` to ``high``."""
        base = term * max(self.n, 1)
        at = np.searchsorted(self.keys, base + low)
        return (low <= high) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= base + high)


class Group(NamedTuple):
    """Phrases of one length: rows of term numbers of the block, their offsets rarest first, sorted by the rarest term."""

    phrases: np.ndarray
    offsets: np.ndarray
    anchors: np.ndarray
    keys: np.ndarray


class Block(NamedTuple):
    terms: np.ndarray
    groups: list[Group]


def _candidates(segment: Segment, group: Group, both: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase numbers, their terms' numbers in the segment, the phrase and the place of each of the rarest term's places), some places at a time.

    Only phrases whose terms the segment all has are among them.
    """
    known, own = both
    low, high = np.searchsorted(group.anchors, known), np.searchsorted(group.anchors, known, side="right")
    times = high - low
    alive = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    if not len(alive):
        return
    terms = group.phrases[alive]
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    whole = (known[at] == terms).all(axis=1)
    alive, local = alive[whole], own[at[whole]]
    if not len(alive):
        return
    rare = local[np.arange(len(alive)), group.offsets[alive, 0]]
    heavy = np.cumsum(segment.sizes[rare])
    for cut in np.split(np.arange(len(alive)), np.searchsorted(heavy, np.arange(CANDIDATES, heavy[-1], CANDIDATES))):
        if len(cut):
            n = segment.sizes[rare[cut]]
            which = np.repeat(cut, n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield alive, local, which, segment.places[segment.begin[rare[which]] + nth]


def exact_places(segment: Segment, group: Group, both: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, first word) of every exact occurrence inside one text."""
    length, found = group.phrases.shape[1], []
    for alive, local, which, place in _candidates(segment, group, both):
        offsets = group.offsets[alive]
        start = place - offsets[which, 0]
        ok = (start >= 0) & (start + length <= segment.n)
        which, start = which[ok], start[ok]
        ok = segment.text_of(start) == segment.text_of(start + length - 1)
        which, start = which[ok], start[ok]
        for j in range(1, length):
            offset = offsets[which, j]
            there = start + offset
            ok = segment.holds(local[which, offset], there, there)
            which, start = which[ok], start[ok]
        found.append((alive[which], start))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def near_places(segment: Segment, group: Group, both: tuple[np.ndarray, np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, place of its rarest term) where every term has a place of the same text in reach.

    In reach is less than the phrase's length plus ``slop`` words away from the rarest term, in any order.
    """
    length, found = group.phrases.shape[1], []
    reach = length + slop - 1
    for alive, local, which, place in _candidates(segment, group, both):
        text = segment.text_of(place)
        low, high = np.maximum(place - reach, segment.first[text]), np.minimum(place + reach, segment.first[text + 1] - 1)
        for j in range(1, length):
            ok = segment.holds(local[which, group.offsets[alive[which], j]], low, high)
            which, place, low, high = which[ok], place[ok], low[ok], high[ok]
        found.append((alive[which], place))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


# --- the benchmark ------------------------------------------------------------------------------


def item_phrases(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, phrase, p1, p2): the distinct phrases of each distinct item as bytes of word hashes; stored."""

    def scan(batches):
        for batch in batches:
            for w in words(batch.column(1), ALNUM, LOWER):
                h = w.hashes()
                for i in range(len(w.rows)):
                    own = h[w.first[i] : w.first[i + 1]]
                    size = min(window, len(own))
                    if not size:
                        continue
                    spans = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, size))
                    item = batch.column(0).slice(w.rows.start + i, 1)
                    for a in range(0, len(spans), 1 << 14):
                        part = spans[a : a + (1 << 14)]
                        ids = pa.array(item.to_pylist() * len(part), pa.string())
                        yield pa.RecordBatch.from_arrays([ids, pa.array([p.tobytes() for p in part], pa.binary())], ["item_id", "phrase"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    phrases = items.mapInArrow(scan, "item_id string, phrase binary").distinct()
    return materialize(phrases.select("*", F.xxhash64("phrase").alias("p1"), F.xxhash64("phrase", F.lit(37)).alias("p2")))


def _block(rows: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(sorted terms, by length (phrases as term numbers, keys)) of some distinct phrases."""
    raw = rows.column("phrase").to_pylist()
    keys = np.column_stack([np.asarray(rows.column(c)) for c in ("p1", "p2")])
    size = np.array([len(p) // 8 for p in raw])
    terms = np.unique(np.frombuffer(b"".join(raw), U64))
    groups = []
    for s in np.unique(size):
        chosen = np.flatnonzero(size == s)
        hashes = np.frombuffer(b"".join(raw[i] for i in chosen), U64).reshape(-1, s)
        groups.append((np.searchsorted(terms, hashes), keys[chosen]))
    return terms, groups


def _ranked(terms: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], totals: np.ndarray) -> Block:
    """The block's phrases that can occur, with their terms in the order of the whole index' list sizes."""
    out = []
    for phrases, keys in groups:
        there = (totals[phrases] > 0).all(axis=1)
        phrases, keys = phrases[there], keys[there]
        offsets = np.argsort(totals[phrases], axis=1, kind="stable")
        anchors = phrases[np.arange(len(phrases)), offsets[:, 0]]
        order = np.argsort(anchors, kind="stable")
        out.append(Group(phrases[order], offsets[order], anchors[order], keys[order]))
    return Block(terms, out)


def _list_sizes(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Sizes of the terms' lists in the whole index."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def scan(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, sizes in zip(*(batch.column(i).to_pylist() for i in range(2))):
                held = np.frombuffer(own, U64)
                at = np.minimum(np.searchsorted(shared.value, held), len(shared.value) - 1)
                ok = shared.value[at] == held
                total[at[ok]] += np.frombuffer(sizes, np.int32)[ok]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["at", "n"])

    found = index.select("terms", "sizes").mapInArrow(scan, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(len(terms), np.int64)
    totals[np.asarray(found.column(0))] = np.asarray(found.column(1))
    return totals


# --- search -------------------------------------------------------------------------------------


def covered(spans: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint (first, behind) pairs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def segment_hits(segment: Segment, block: Block, slop: int | None) -> Iterator[tuple[int, list, list, list]]:
    """(text, spans, keys of exact phrases, keys of near ones) of the segment's texts with a hit."""
    both = segment.present(block.terms)
    exact, near = [], []
    for group in block.groups:
        number, start = exact_places(segment, group, both)
        length = np.full(len(start), group.phrases.shape[1])
        exact.append(np.column_stack([segment.text_of(start), start, start + length, group.keys[number]]))
        if slop is not None:
            number, place = near_places(segment, group, both, slop)
            near.append(np.column_stack([segment.text_of(place), group.keys[number]]))
    exact = np.concatenate(exact) if exact else np.zeros((0, 5), np.int64)
    near = np.concatenate(near) if near else np.zeros((0, 3), np.int64)
    for text in np.union1d(exact[:, 0], near[:, 0]):
        own = exact[exact[:, 0] == text]
        spans = covered(own[:, 1:3] - segment.first[text])
        yield int(text), spans, np.unique(own[:, 3:], axis=0).tolist(), np.unique(near[near[:, 0] == text][:, 1:], axis=0).tolist()


def _hits(index: DataFrame, block: Block, slop: int | None) -> DataFrame:
    """(segment, at, spans, exact, near) of the texts with a hit; ``at`` is the text's place in its segment."""
    shared = index.sparkSession.sparkContext.broadcast(block)
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
    phrases_type = pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64())]))

    def scan(batches):
        for batch in batches:
            rows = []
            for name, first, terms, sizes, places in zip(*(batch.column(i).to_pylist() for i in range(5))):
                rows += [(name, *hit) for hit in segment_hits(Segment(first, terms, sizes, places), shared.value, slop)]
            pairs = lambda k, a, b: [[{a: x, b: y} for x, y in r[k]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array(pairs(2, "first", "behind"), spans_type),
                    pa.array(pairs(3, "p1", "p2"), phrases_type),
                    pa.array(pairs(4, "p1", "p2"), phrases_type),
                ],
                ["segment", "at", "spans", "exact", "near"],
            )

    return index.select("segment", "first", "terms", "sizes", "places").mapInArrow(scan, f"segment bigint, at int, spans {SPANS}, exact {PHRASES}, near {PHRASES}")


def all_hits(index: DataFrame, phrases: DataFrame, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The hits of all blocks, each searched and written before the next one is fetched; a text has a row for each block that hits it."""
    distinct = materialize(phrases.select("phrase", "p1", "p2").distinct())
    parts = max(1, -(-distinct.count() // block_words))
    found = []
    for part in range(parts):
        rows = distinct.where(F.pmod("p2", F.lit(parts)) == part).toArrow()
        if not rows.num_rows:
            continue
        terms, groups = _block(rows)
        found.append(materialize(_hits(index, _ranked(terms, groups, _list_sizes(index, terms)), slop)))
    if not found:
        return index.sparkSession.createDataFrame([], f"segment bigint, at int, spans {SPANS}, exact {PHRASES}, near {PHRASES}")
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def _merged_spans(hits: DataFrame) -> DataFrame:
    """(segment, at, spans) with the spans of all blocks put together."""
    grouped = hits.groupBy("segment", "at").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ordered = F.array_sort("spans")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["behind"], span["behind"]).alias("behind"))
        apart = (F.size(done) == 0) | (span["first"] > F.try_element_at(done, F.lit(-1))["behind"])
        return F.when(apart, F.concat(done, F.array(span))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))

    return grouped.select("segment", "at", F.when(F.size("spans") < 2, F.col("spans")).otherwise(F.aggregate(ordered, F.array().cast(SPANS), add)).alias("spans"))


def _items_of(hits: DataFrame, phrases: DataFrame, column: str, name: str) -> DataFrame:
    """(segment, at, name): the sorted ids of the items with one of the phrases; items without id are not listed."""
    asked = hits.select("segment", "at", F.explode(column).alias("p")).select("segment", "at", "p.p1", "p.p2")
    listed = asked.join(phrases.where("item_id is not null").select("p1", "p2", "item_id"), ["p1", "p2"])
    return listed.groupBy("segment", "at").agg(F.array_sort(F.collect_set("item_id")).alias(name))


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, item_ids, near_item_ids) for every row.

    ``spans`` are the disjoint runs of hit words as (first, behind), ``item_ids`` the sorted distinct ids of items
    with an exact phrase, ``near_item_ids`` those with a proximity match when ``slop`` is given: every word of a phrase less than its
    length plus ``slop`` words away from one of its word that is rarest in all documents (the first of those in the phrase). A null or empty
    text has no words and no hits, and a null or empty item no phrase; an item without id can hit, but is not
    listed. Repeated rows are searched one by one; items that repeat count once. Other columns are ignored.
    """
    index = build_index(documents)
    phrases = item_phrases(benchmark, window)
    hits = all_hits(index, phrases, slop, block_words)
    sizes = F.expr("transform(ids, (x, i) -> first[i + 1] - first[i])")
    texts = index.select("segment", F.posexplode(F.arrays_zip(F.col("ids").alias("doc_id"), sizes.alias("n_words"))).alias("at", "x"))
    texts = texts.select("segment", "at", "x.doc_id", "x.n_words")
    key = ["segment", "at"]
    parts = [_merged_spans(hits), _items_of(hits, phrases, "exact", "item_ids"), _items_of(hits, phrases, "near", "near_item_ids")]
    for part in parts:
        texts = texts.join(materialize(part), key, "left")
    empty = {"spans": SPANS, "item_ids": "array<string>", "near_item_ids": "array<string>"}
    return texts.select("doc_id", "n_words", *[F.coalesce(n, F.array().cast(kind)).alias(n) for n, kind in empty.items()])


def clean_rows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, unchanged, that hold no phrase of the benchmark.

    Texts and items are read as in :func:`find_matches`: rows with null or empty texts stay, a row that repeats stays or goes as a whole, and
    rows with null ids are judged by their texts. Columns may have any names. Empty documents, or a benchmark without words, change nothing.
    """
    index = build_index(documents)
    hits = all_hits(index, item_phrases(benchmark, window), None, block_words).select("segment", "at").distinct()
    named = index.select("segment", F.posexplode(F.arrays_zip("row1", "row2")).alias("at", "x")).select("segment", "at", "x.row1", "x.row2")
    one, two = free(documents, "__row1"), free(documents, "__row2")
    gone = materialize(named.join(hits, ["segment", "at"]).select(F.col("row1").alias(one), F.col("row2").alias(two)).distinct())
    first, second = row_ids()
    return documents.withColumns({one: first, two: second}).join(gone, [one, two], "left_anti").select(*documents.columns)


SQL = """
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
places AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM doc, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, item_id, i, places.size FROM places JOIN phrases USING (size, phrase)),
hit_words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS w FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


@register("op4_decontamination", SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["behind"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@register("benchmark_proximity")
def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose phrases a document has word by word, and those whose words it has close together, with five words in between at most."""
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=5)
    return found.select("doc_id", "n_words", *[F.array_join(c, ",").alias(c) for c in ("item_ids", "near_item_ids")])
