"""One linear model with two heads, fitted to a weighted sum of both losses.

The logit of a head is ``x · (shared + own) + bias``, so what both labels have in common is learned once. Every step of the
fit is one pass over the hashed rows: tasks sum loss and gradient over Arrow batches, the sums are added by feature number, and the driver, which
holds the coefficients only, takes an L-BFGS step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.session import materialize

HEADS = 2
MEMORY = 10


def hashed_rows(df: DataFrame, labels: Sequence[str], buckets: int, weight: str | None = None) -> DataFrame:
    """(idx, dense, y0, y1, w): token numbers below ``buckets``, dense values with null as 0, labels and weight; stored once.

    ``df`` has ``tokens`` and ``dense`` (see :func:`tallyrow.operators.scoring.model_inputs`). A token counts once a row. A null label is 0, a null weight 1.
    """
    tokens = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    dense = F.transform("dense", lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    value: Column = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    marks = [F.coalesce(F.col(label), F.lit(0)).cast("double").alias(f"y{h}") for h, label in enumerate(labels)]
    return materialize(df.select(F.array_distinct(tokens).alias("idx"), dense.alias("dense"), *marks, value.alias("w")))


@dataclass(frozen=True)
class JointModel:
    """Coefficients by head: of tokens (heads x buckets), of dense values and biases; ``scale`` divides the dense values."""

    tokens: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    loss: float
    steps: int


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a list column."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]]
    return np.repeat(np.arange(len(column)), np.diff(offsets)), values


def batch_sums(batch: pa.RecordBatch, point: np.ndarray, buckets: int, scale: np.ndarray, head_weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(loss, weight, gradient by head) of some rows; the point is heads x (buckets + dense + 1)."""
    n, wide = batch.num_rows, len(scale)
    row, idx = _lists(batch.column(0))
    x = _lists(batch.column(1))[1].reshape(n, wide) / scale
    w = np.asarray(batch.column(4))
    loss, grad = 0.0, np.zeros_like(point)
    for h in range(HEADS):
        y, at = np.asarray(batch.column(2 + h)), point[h]
        logit = np.bincount(row, at[idx], minlength=n) + x @ at[buckets:-1] + at[-1]
        loss += head_weights[h] * float(w @ (np.logaddexp(0.0, logit) - y * logit))
        pull = head_weights[h] * w * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y)
        grad[h, :buckets] = np.bincount(idx, pull[row], minlength=buckets)
        grad[h, buckets:-1] = pull @ x
        grad[h, -1] = pull.sum()
    return loss, float(w.sum()), grad


def packed_batches(rows: DataFrame) -> DataFrame:
    """The rows as serialized Arrow batches, stored once: every step of the fit reads them again, and lists are slow to turn into Arrow."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.schema.serialize().to_pybytes()]), pa.array([batch.serialize().to_pybytes()])], ["schema", "batch"])

    return materialize(rows.mapInArrow(pack, "schema binary, batch binary"))


def _unpacked(batches):
    for packed in batches:
        for schema, batch in zip(packed.column(0), packed.column(1)):
            yield pa.ipc.read_record_batch(batch.as_buffer(), pa.ipc.read_schema(schema.as_buffer()))


def _distributed_sums(packed: DataFrame, buckets: int, scale: np.ndarray, head_weights: np.ndarray) -> Callable:
    """The function from a point to the sums over all rows."""

    def at(point: np.ndarray) -> tuple[float, float, np.ndarray]:
        def sums(batches):
            loss, weight, grad = 0.0, 0.0, np.zeros_like(point)
            for batch in _unpacked(batches):
                more, heavy, pull = batch_sums(batch, point, buckets, scale, head_weights)
                loss, weight, grad = loss + more, weight + heavy, grad + pull
            flat = np.concatenate([[loss, weight], grad.ravel()])
            used = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["at", "v"])

        found = packed.mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(2 + point.size)
        flat[np.asarray(found.column(0))] = np.asarray(found.column(1))
        return flat[0], flat[1], flat[2:].reshape(point.shape)

    return at


def minimise(value_and_slope: Callable, start: np.ndarray, most_steps: int, close: float) -> tuple[np.ndarray, float, int]:
    """L-BFGS with step halving; ends when the largest slope is at most ``close``."""
    x = start
    value, slope = value_and_slope(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(most_steps):
        if np.abs(slope).max() <= close:
            return x, value, step
        way, used = slope.copy(), []
        for s, y in reversed(moves):
            a = (s @ way) / (s @ y)
            way -= a * y
            used.append(a)
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(used)):
            way += (a - (y @ way) / (s @ y)) * s
        length = 1.0 if moves else min(1.0, 1.0 / np.abs(slope).sum())
        while True:
            there, slope_there = value_and_slope(x - length * way)
            if there <= value - 1e-4 * length * (slope @ way) or length < 1e-12:
                break
            length /= 2
        s, y = -length * way, slope_there - slope
        if s @ y > 1e-14:
            moves = [*moves[-(MEMORY - 1) :], (s, y)]
        x, value, slope = x + s, there, slope_there
    return x, value, most_steps


def penalised(sums: Callable, width: int, l2: float) -> Callable:
    """Value and slope of the mean loss plus l2 / 2 times the squares of the shared and the own coefficients; biases are free.

    The flat parameter is (shared, own of each head, biases).
    """

    def at(flat: np.ndarray) -> tuple[float, np.ndarray]:
        parts = flat[: -HEADS].reshape(1 + HEADS, width)
        point = np.column_stack([parts[0] + parts[1:], flat[-HEADS:]])
        loss, weight, grad = sums(point)
        weight = max(weight, 1e-300)
        slope = np.concatenate([grad[:, :-1].sum(axis=0), grad[:, :-1].ravel(), grad[:, -1]]) / weight
        slope[:-HEADS] += l2 * flat[:-HEADS]
        return loss / weight + l2 / 2 * float(flat[:-HEADS] @ flat[:-HEADS]), slope

    return at


def fit_heads(rows: DataFrame, buckets: int, head_weights: Sequence[float] = (1.0, 2.0), l2: float = 1e-3, most_steps: int = 60, close: float = 1e-5) -> JointModel:
    """Fits both heads of :func:`hashed_rows` at once. Rows must have dense lists of one length; no rows give a model of zeros."""
    sizes = rows.agg(F.max(F.size("dense"))).first()[0] or 0
    top = [F.max(F.abs(F.get("dense", F.lit(i)))).alias(f"m{i}") for i in range(sizes)]
    scale = np.array([m or 1.0 for m in rows.agg(*top).first()]) if sizes else np.ones(0)
    width, weights = buckets + sizes, np.asarray(head_weights, float)
    start = np.zeros((1 + HEADS) * width + HEADS)
    flat, loss, steps = minimise(penalised(_distributed_sums(packed_batches(rows), buckets, scale, weights), width, l2), start, most_steps, close)
    parts = flat[:-HEADS].reshape(1 + HEADS, width)
    heads = parts[0] + parts[1:]
    return JointModel(heads[:, :buckets], heads[:, buckets:], flat[-HEADS:], scale, loss, steps)


def score_heads(df: DataFrame, model: JointModel, names: Sequence[str]) -> DataFrame:
    """``df`` with one logit for each head, computed in the JVM from ``tokens`` and ``dense``."""
    buckets = model.tokens.shape[1]
    spots = F.array_distinct(F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int")))

    def logit(h: int) -> Column:
        table = F.lit([float(v) for v in model.tokens[h]])
        tokens = F.aggregate(spots, F.lit(0.0), lambda a, i: a + F.get(table, i))
        weights = F.lit([float(v) for v in model.dense[h] / model.scale]) if len(model.scale) else F.array().cast("array<double>")
        products = F.zip_with("dense", weights, lambda x, c: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) * c)
        return F.aggregate(products, tokens + F.lit(float(model.bias[h])), lambda a, p: a + p)

    return df.select("*", *[logit(h).alias(name) for h, name in enumerate(names)])
