"""What each document filter costs in each order of the filters, by counting paths through the subset lattice.

A document is known by the set of filters it fails, so all that is needed of a part (a source) is how many documents
have each of the 2 ** k sets. A state of the lattice is the set of filters already applied, an edge applies one more.
The filter of an edge removes the documents that fail it and none of the state's filters. Counting forward gives
the orders that reach a state, counting backward those that leave it; their product for an edge is the number of orders that go through
it, which weighs what the edge removes in the Shapley sum. The steps of each order are read from the same edges.

The rows of a part are pre-aggregated to its sets before they are shuffled; what follows grows with the number of parts only.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table
from tallyrow.llm.bytescan import chunks
from tallyrow.session import materialize

LETTERS = "ABCDE"
MIN_WORDS = 200
UPPER = bytes(range(0x41, 0x5B))
MARKS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))
SLICE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded slice at a time; a slice ends at white space."""
    start = 0
    while start < len(text):
        end = start + SLICE
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[start:end].split()
        start = end


def failed_alone(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, seen = 0, set()
    for words in word_lists(text):
        n += len(words)
        seen.update(words)
    points = len(text.translate(None, CONTINUATION))
    upper = len(text) - len(text.translate(None, UPPER))
    marked = len(text.translate(None, MARKS)) < len(text)
    return (n < MIN_WORDS) | (100 * len(seen) < 50 * n) << 1 | (100 * upper > 2 * points) << 2 | marked << 3


def failed_sets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): the documents of each part by the filters they fail, bit 0 for A to bit 4 for E.

    ``part`` is the source, empty for null. A null text is empty: it fails A, and E where a smaller id is empty too.
    A row fails E when a smaller doc_id has the same text; a null id is smaller than none and fails E never, and rows that
    share id and text do not fail each other. A row is good (toxic) if any row of ``labels`` with its id has quality (toxic) 1. Rows
    that repeat are counted each; other columns are ignored. Empty documents give no rows.
    """

    def scan(batches):
        for batch in batches:
            mask, key = [], []
            for rows, data, bounds in chunks(batch.column(2)):
                for i in range(len(rows)):
                    text = data[bounds[i] : bounds[i + 1]].tobytes()
                    mask.append(failed_alone(text))
                    key.append(hashlib.sha256(text).digest())
            columns = [batch.column(0), batch.column(1), pa.array(mask, pa.int32()), pa.array(key, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "key"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    texts = documents.select("doc_id", part.alias("part"), F.col("text").cast("string").alias("text"))
    rows = materialize(texts.mapInArrow(scan, f"doc_id {id_type}, part string, mask int, key binary"))
    # both written, so that the joins are of plain exchanges, of which Spark splits the hot ones
    least = rows.groupBy(F.col("key").alias("same")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = materialize(least.where("least <> most").select("same", "least"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of"))
    marked = materialize(marked.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    joined = rows.join(least, F.col("key") == F.col("same"), "left").join(marked, F.col("doc_id") == F.col("of"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mask = F.when(copy, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask"))
    return joined.groupBy("part", mask.alias("mask")).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty one, and orders that lead from it to the full one."""
    states = range(1 << k)
    forward, backward = [0] * len(states), [0] * len(states)
    forward[0] = backward[-1] = 1
    for s in states:
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(states):
        for f in range(k):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def orders_through(letters: str) -> list[list[str]]:
    """The orders that use each edge; edge number = state * k + filter."""
    k = len(letters)
    through: list[list[str]] = [[] for _ in range((1 << k) * k)]
    for order in itertools.permutations(range(k)):
        state = 0
        for f in order:
            through[state * k + f].append("".join(letters[i] for i in order))
            state |= 1 << f
    return through


def lattice_edges(sets: DataFrame, k: int) -> DataFrame:
    """One row for each part, state and filter not in it: what the edge keeps and removes, and the orders through it."""
    at = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << k) * k - 1))).alias("edge"))
    state, f = F.floor(F.col("edge") / k).cast("int"), (F.col("edge") % k).cast("int")
    at = at.select("*", state.alias("state"), f.alias("f")).withColumn("bit", F.expr("shiftleft(1, f)")).where("(state & bit) = 0")

    def total(condition: str, what: str = "docs") -> Column:
        return F.sum(F.when(F.expr(condition), F.col(what)).otherwise(F.lit(0)))

    here = "(mask & state) = 0 AND (mask & bit) <> 0"
    forward, backward = (F.array(*map(F.lit, counts)) for counts in path_counts(k))
    edges = at.groupBy("part", "edge", "state", "f", "bit").agg(
        total("(mask & (state | bit)) = 0").alias("kept"),
        total(here).alias("removed"),
        total("(mask & bit) <> 0 AND (mask & state) <> 0").alias("redundant"),
        total("mask = bit").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    paths = forward[F.col("state")] * backward[F.col("state").bitwiseOR(F.col("bit"))]
    return edges.withColumn("paths", paths.cast("bigint"))


def audit_filters(sets: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step; see the contract's columns in the module text.

    ``sets`` is (part, mask, docs, good, toxic) with one bit a letter. ``kept`` and ``removed`` are of this step, ``redundant`` are documents
    that fail its filter and are gone before, ``unique_fails`` fail its filter alone; ``shapley`` is what its filter removes, summed over
    all orders. Parts without rows are absent.
    """
    k = len(letters)
    edges = lattice_edges(sets, k)
    shapley = edges.groupBy("part", "f").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    edges = edges.join(shapley, ["part", "f"])
    through = F.array(*[F.array(*map(F.lit, orders)) if orders else F.array().cast("array<string>") for orders in orders_through(letters)])
    return edges.select(
        "part",
        F.explode(through[F.col("edge")]).alias("filter_order"),
        (F.bit_count("state") + 1).cast("int").alias("step"),
        *[F.col(c).cast("bigint").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
    )


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws FROM d),
m AS (
  SELECT part,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM w),
c AS (
  SELECT part, mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, l.letter, l.bit,
    coalesce((SELECT sum(x.bit) FROM l x WHERE strpos(filter_order, x.letter) < step), 0)::INTEGER AS state
  FROM o, range(1, 6) r(step), l WHERE l.letter = substr(filter_order, step::INTEGER, 1)),
x AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (state | bit) = 0 THEN docs ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & state = 0 AND mask & bit <> 0 THEN docs ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & state <> 0 AND mask & bit <> 0 THEN docs ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN docs ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & state = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & state = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM x"""


@register("op12_filter_audit", SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(failed_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
