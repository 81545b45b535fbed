"""Soft-membership mixing of a corpus to target token shares.

A classifier trained on a labelled table gives every document its posteriors over the domains. A document with n tokens
and posteriors p adds rate * n * p to the expected token totals of the domains. The rates, none below ``least``, minimise
the squared distance of the totals from their targets by projected gradient descent: r <- max(least, r - p . g), where g is the residual of
each domain over the sum of n p ** 2 of that domain, so a domain moves as fast however rare it is, times a step
length that the domains' overlap bounds, with momentum that is dropped when it points uphill. All rates start at 1. Each round is one distributed sum over
(n, p): a document's rate is folded anew from the few numbers of the rounds so far, so no rate is stored or shuffled.

The fit ends at the targets, or where projected steps move nothing because the bound or the posteriors keep the targets out of reach.
What is lacking then is part of the fit and is logged.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallyrow.llm import subwords
from tallyrow.llm.base import free, register, table
from tallyrow.llm.bytescan import SPACED, words
from tallyrow.llm.repeats import row_key
from tallyrow.session import materialize

#: Target shares of the corpus' tokens by language, for the registered query and the pipeline.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
MOST_STEPS = 200
CLOSE = 1e-4  # the targets are met at a largest residual of this share of all tokens
MOST_ROOM = 1.5
STILL = 1e-8  # a projected step that moves less than this share of all tokens is none

log = logging.getLogger(__name__)


class Fit(NamedTuple):
    least: float
    #: rounds x (momentum, one number a domain), from which rates are folded
    steps: np.ndarray
    #: what each domain has above its target, as a share of all tokens aimed at
    residual: np.ndarray


def folded(p: np.ndarray, least: float, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with posteriors ``p`` after the steps, and before the last one."""
    now = before = np.full(len(p), max(1.0, least))
    for momentum, *g in steps:
        ahead = now + momentum * (now - before)
        now, before = np.maximum(least, ahead - p @ np.asarray(g)), now
    return now, before


def rates(p: np.ndarray, fit: Fit) -> np.ndarray:
    """Rates of documents with posteriors ``p``."""
    return folded(p, fit.least, fit.steps)[0]


def _profiles(documents: DataFrame, model: subwords.Model) -> DataFrame:
    """(doc_id, u, n_tokens, p) with p the posteriors as bytes of doubles and u a draw in [0, 1) by hash."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for batch in batches:
            p = subwords.posteriors(shared.value, batch.column(2))
            n = [np.diff(w.first) for w in words(batch.column(2), SPACED)]
            columns = [batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), pa.array([r.tobytes() for r in p], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "u", "n_tokens", "p"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", _draw(documents).alias("u"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, f"doc_id {id_type}, u double, n_tokens bigint, p binary")


def _draw(documents: DataFrame):
    return F.pmod(row_key(documents), F.lit(1 << 30)) / (1 << 30)


def _unpacked(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, k)


def _totals(profiles: DataFrame, steps: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over all rows after the steps: the domains' totals, the same one step ahead with full momentum, n p p', and the tokens the last step moved."""

    def scan(batches):
        out = np.zeros(2 * k + k * k + 1)
        for batch in batches:
            p, n = _unpacked(batch.column(1), k), np.asarray(batch.column(0)).astype(np.float64)
            now, before = folded(p, least, steps)
            out[:k] += (now * n) @ p
            out[k : 2 * k] += ((now - before) * n) @ p
            out[2 * k : -1] += ((p * n[:, None]).T @ p).ravel()
            out[-1] += n @ np.abs(now - before)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(out.size), pa.int32()), "x": pa.array(out)})

    rows = profiles.select("n_tokens", "p").mapInArrow(scan, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(2 * k + k * k + 1)
    for r in rows:
        out[r["at"]] = r["x"]
    return out[:k], out[k : 2 * k], out[2 * k : -1].reshape(k, k), float(out[-1])


def fit_rates(profiles: DataFrame, shares: np.ndarray, least: float = 0.0, most_steps: int = MOST_STEPS) -> Fit:
    """The rates with totals in the given shares, or as near to them as can be.

    The total aimed at is the smallest at which no domain has to shrink, so with ``least`` 1 every document stays. It is raised, by a factor of MOST_ROOM at
    most, to where the domains' overlap makes no document's best rate fall below ``least``.
    """
    k = len(shares)
    steps = np.zeros((0, 1 + k))
    total, drift, second, _ = _totals(profiles, steps, least, k)
    tokens = total.sum()
    if not tokens:
        return Fit(least, steps, np.zeros(k))
    wanted = shares > 0
    target = shares * (total[wanted] / shares[wanted]).max() if wanted.any() else total
    # best rates are p . (room * growth) as long as none falls below the bound
    growth = np.linalg.lstsq(second, target, rcond=None)[0].min()
    room = least / growth if growth > 0 else 1.0
    target = target * (room if 1 < room <= MOST_ROOM else 1.0)
    scale = target.sum() or 1.0
    own = np.maximum(np.diag(second), 1e-300)
    # the largest share of a step that overlapping domains cannot overshoot
    length = 1 / np.linalg.eigvalsh(second / np.sqrt(np.outer(own, own))).max()
    speed = 1.0
    for _ in range(most_steps):
        if np.abs(total - target).max() < CLOSE * scale:
            break
        grown = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        momentum = (speed - 1) / grown
        ahead = total + momentum * drift
        # momentum that leads away from the targets is dropped
        if momentum and ((total - target) * drift / own).sum() > 0:
            momentum, grown, ahead = 0.0, 1.0, total
        speed = grown
        steps = np.vstack([steps, np.concatenate([[momentum], length * (ahead - target) / own])])
        total, drift, _, moved = _totals(profiles, steps, least, k)
        if moved < STILL * scale:
            break
    return Fit(least, steps, (total - target) / scale)


def fit_mix(documents: DataFrame, labelled: DataFrame, targets: Mapping[str, float], least: float = 1.0) -> tuple[list[str], subwords.Model, Fit, DataFrame]:
    """Classifier and rates for ``targets``; ``labelled`` has (doc_id, domain), rows of other domains are left out."""
    domains = sorted(targets)
    model = subwords.fit(documents, labelled, "domain", tuple(domains))
    profiles = materialize(_profiles(documents, model))
    shares = np.array([max(float(targets[d]), 0.0) for d in domains])
    fit = fit_rates(profiles, shares / (shares.sum() or 1.0), least)
    if np.abs(fit.residual).max(initial=0.0) >= CLOSE:
        log.warning("targets not met; share of all tokens above the target: %s", dict(zip(domains, fit.residual.tolist())))
    return domains, model, fit, profiles


def mixing_rates(documents: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, least: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, domain, rate, copies, posteriors) for every row.

    ``n_tokens`` counts words between white space, ``domain`` is the likeliest one, ``rate`` the expected number of uses and
    ``copies`` that rate rounded up or down by a hash draw, so that its mean is the rate. A null or empty text has no tokens,
    the prior's posteriors and a rate that changes nothing. Repeated rows count one by one, null ids are kept, other columns
    are ignored. Without labelled rows all posteriors are equal, and a domain nobody resembles keeps a shortfall.
    """
    domains, _, fit, profiles = fit_mix(documents, labelled, targets, least)
    k = len(domains)

    def scan(batches):
        for batch in batches:
            p = _unpacked(batch.column(3), k)
            rate = rates(p, fit)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([domains[i] for i in p.argmax(axis=1)], pa.string()),
                    pa.array(rate),
                    pa.array(np.floor(rate + np.asarray(batch.column(1))).astype(np.int64)),
                    pa.array(p.tolist(), pa.list_(pa.float64())),
                ],
                ["doc_id", "n_tokens", "domain", "rate", "copies", "posteriors"],
            )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return profiles.mapInArrow(scan, f"doc_id {id_type}, n_tokens bigint, domain string, rate double, copies bigint, posteriors array<double>")


def mixed(documents: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, least: float = 1.0) -> DataFrame:
    """The rows with their ``rate`` and ``copies``; a row with no copies is dropped (none is with ``least`` 1).

    Columns of these names, in upper or lower case, are replaced. Null and empty texts, repeated rows and null ids are treated as
    in :func:`mixing_rates`; other columns stay as they are. No rows, no result.
    """
    spark = documents.sparkSession
    _, model, fit, _ = fit_mix(documents, labelled, targets, least)
    shared = spark.sparkContext.broadcast(model)
    names = [n for n in documents.columns if n.lower() not in ("rate", "copies")]
    documents = documents.select(*names)
    at = names.index("text")

    def scan(batches):
        for batch in batches:
            rate = rates(subwords.posteriors(shared.value, batch.column(at).cast(pa.string())), fit)
            copies = np.floor(rate + np.asarray(batch.column(len(names)))).astype(np.int64)
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rate), pa.array(copies)], [*names, "rate", "copies"])
            yield out.filter(pa.array(copies > 0))

    schema = StructType([*documents.schema.fields, StructField("rate", DoubleType()), StructField("copies", LongType())])
    return documents.withColumn(free(documents, "__u"), _draw(documents)).mapInArrow(scan, schema)


def by_column(documents: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """A labelled table: a column, such as the source, of the documents that ``labels`` covers."""
    return labels.select("doc_id").distinct().join(documents.select("doc_id", F.col(column).alias("domain")), "doc_id")


def by_language(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query and the pipeline."""
    return by_column(documents, labels, "lang")


@register("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing_rates(documents, by_language(documents, table(spark, sf_dir, "labels")))
