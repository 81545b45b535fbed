"""The two-head fit against a plain one in memory."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrow.operators import joint


def planted(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 7, n), rng.integers(0, 10, n)
    click = (a + b >= 8).astype(int)
    sale = (click & (b >= 7)).astype(int)
    x = rng.normal(size=n)
    rows = [([f"a={i}", f"b={j}", f"b={j}"], [float(v), None], int(c), int(s), float(w)) for i, j, v, c, s, w in zip(a, b, x, click, sale, rng.random(n) + 0.5)]
    return spark.createDataFrame(rows, "tokens array<string>, dense array<double>, click int, sale int, w double")


def plain_fit(rows, buckets, scale, weights, l2):
    """The same objective on a dense matrix, with a fixed step and many rounds."""
    n = len(rows)
    x = np.zeros((n, buckets + len(scale)))
    for i, r in enumerate(rows):
        x[i, r.idx] = 1
        x[i, buckets:] = np.array(r.dense) / scale
    y, w = np.array([[r.y0, r.y1] for r in rows]), np.array([r.w for r in rows])
    shared, own, bias = np.zeros(x.shape[1]), np.zeros((2, x.shape[1])), np.zeros(2)
    ahead = [shared.copy(), own.copy(), bias.copy()]
    step = 1 / (0.25 * 3 * (weights.max() * (x**2).sum(axis=1).max() + weights.max()) + l2)
    for k in range(20_000):
        p = 1 / (1 + np.exp(-(x @ (ahead[0] + ahead[1]).T + ahead[2])))
        pull = (p - y) * w[:, None] * weights / w.sum()
        g = x.T @ pull
        new = [ahead[0] - step * (g.sum(axis=1) + l2 * ahead[0]), ahead[1] - step * (g.T + l2 * ahead[1]), ahead[2] - step * pull.sum(axis=0)]
        ahead = [v + k / (k + 3) * (v - o) for v, o in zip(new, (shared, own, bias))]
        shared, own, bias = new
    return shared + own, bias


def test_coefficients_equal_a_plain_fit(spark):
    df = planted(spark)
    rows = joint.hashed_rows(df, ["click", "sale"], 64, "w")
    model = joint.fit_heads(rows, 64, (1.0, 2.0), 0.01, 300, 1e-8)
    coefficients, bias = plain_fit(rows.collect(), 64, model.scale, np.array([1.0, 2.0]), 0.01)
    assert np.abs(model.tokens - coefficients[:, :64]).max() < 1e-4
    assert np.abs(model.dense - coefficients[:, 64:]).max() < 1e-4 and np.abs(model.bias - bias).max() < 1e-4

    scored = joint.score_heads(df, model, ["c", "s"]).collect()
    stored = rows.select("*").collect()
    assert len(scored) == len(stored) == 900
    for name, label, h in (("c", "click", 0), ("s", "sale", 1)):
        logit, y, w = (np.array([r[k] for r in scored]) for k in (name, label, "w"))
        rate = (w * y).sum() / w.sum()
        loss = (w * (np.logaddexp(0, logit) - y * logit)).sum() / w.sum()
        assert loss < 0.6 * -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
        assert logit[y == 1].mean() > logit[y == 0].mean() + 1


def test_no_rows_null_tokens_and_one_class(spark):
    df = planted(spark, 20)
    none = joint.fit_heads(joint.hashed_rows(df.where("click > 5"), ["click", "sale"], 8), 8)
    assert not none.tokens.any() and none.loss == 0.0
    odd = df.withColumn("tokens", F.lit(None).cast("array<string>")).withColumn("click", F.lit(None).cast("int"))
    model = joint.fit_heads(joint.hashed_rows(odd, ["click", "sale"], 8), 8, most_steps=5)
    assert not model.tokens.any() and model.bias[0] < 0
    assert joint.score_heads(odd, model, ["c", "s"]).where("c is null or s is null").count() == 0


def test_slope_is_the_derivative():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    lists = [rng.integers(0, 6, rng.integers(0, 4)).tolist() for _ in range(30)]
    lists = [sorted(set(x)) for x in lists]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(lists, pa.list_(pa.int32())), pa.array(rng.normal(size=(30, 2)).tolist()), *[pa.array(rng.integers(0, 2, 30) * 1.0) for _ in range(2)], pa.array(rng.random(30))],
        ["idx", "dense", "y0", "y1", "w"],
    )
    at = joint.penalised(lambda p: joint.batch_sums(batch, p, 6, np.array([1.0, 2.0]), np.array([1.0, 3.0])), 8, 0.1)
    x = rng.normal(size=3 * 8 + 2)
    value, slope = at(x)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-6
        assert slope[i] == pytest.approx((at(x + step)[0] - value) / 1e-6, abs=1e-4)


def test_steps_read_packed_batches(spark):
    """All rows once, in batches and not one by one, with every value as it was."""
    rows = joint.hashed_rows(planted(spark), ["click", "sale"], 64, "w")
    packed = joint.packed_batches(rows)
    assert 0 < packed.count() < 50
    back = [tuple(r.values()) for b in joint._unpacked(packed.toArrow().to_batches()) for r in b.to_pylist()]
    assert sorted(map(repr, back)) == sorted(repr(tuple(r)) for r in rows.collect()) and len(back) == 900
