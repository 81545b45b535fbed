"""Token counts from a two-tier look-up of pre-tokens.

The tokenizer drops white space and never joins what stands on both sides of it, so the number of tokens
of a text is the sum over its pieces between ASCII white space. Tier one is a broadcast table with the
lengths of frequent pieces (``FREQUENT`` entries at most); tier two is a cache in each worker
(``CACHE`` entries at most) that is filled by encoding the pieces it lacks. Pieces are never shuffled:
only ``TOP_PER_TASK`` candidates of a task for the frequent table are.

The table is a speed-up taken from a sample of the documents; counts do not depend on it.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table

FREQUENT = 1 << 15
TOP_PER_TASK = 1 << 12
SAMPLE_ROWS = 4_000
CACHE = 1 << 18
LONGEST_CACHED = 64  # bytes of a piece
PART_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0d ]")


def load(serialized: str):
    """The library's tokenizer as the file gives it, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(serialized)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def lengths(tokenizer, pieces: list[bytes]) -> list[int]:
    texts = [p.decode("utf-8", "replace") for p in pieces]
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def parts(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space, so that the pieces of a very long text are never listed at once."""
    at = 0
    while len(raw) - at > PART_BYTES:
        cut = _SPACE.search(raw, at + PART_BYTES)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:] if at else raw


def frequent_pieces(documents: DataFrame, text: str = "text") -> list[bytes]:
    """The most frequent pieces of a sample of about ``SAMPLE_ROWS`` documents."""
    total = documents.count()
    if not total:
        return []
    sample = documents.select(text).sample(min(1.0, SAMPLE_ROWS / total), 7)

    def count(batches):
        found: Counter[bytes] = Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                if value.is_valid:
                    found.update(p for p in value.as_py().split() if len(p) <= LONGEST_CACHED)
        top = found.most_common(TOP_PER_TASK)
        if top:
            yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    rows = (
        sample.mapInArrow(count, "piece binary, n bigint")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(FREQUENT)
        .collect()
    )
    return [bytes(r.piece) for r in rows]


def count_tokens(documents: DataFrame, tokenizer_path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted one by one, null ids are
    kept, other columns are ignored. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:  # a file of the tokenizer package, on the driver
        serialized = file.read()
    pieces = frequent_pieces(documents, text)
    known = dict(zip(pieces, lengths(load(serialized), pieces)))
    shared = spark.sparkContext.broadcast((serialized, known))

    def scan(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        definition, frequent = shared.value
        tokenizer = load(definition)
        cache: dict[bytes, int] = {}
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1).cast(pa.binary()):
                raw = value.as_py() or b""
                n_bytes.append(len(raw))
                total = 0
                for part in parts(raw):
                    missing = []
                    for piece in part.split():
                        n = frequent.get(piece)
                        if n is None:
                            n = cache.get(piece)
                            if n is None:
                                missing.append(piece)
                                continue
                        total += n
                    if missing:
                        times = Counter(missing)
                        found = dict(zip(times, lengths(tokenizer, list(times))))
                        total += sum(n * times[p] for p, n in found.items())
                        if len(cache) + len(found) > CACHE:
                            cache.clear()
                        cache.update((p, n) for p, n in found.items() if len(p) <= LONGEST_CACHED)
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        scan, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())
