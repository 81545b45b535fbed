"""Streamed look-ups against the batch ones, on late, repeated and shuffled files, over restarts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyrow.operators import history
from tallyrow.streaming.lookup import LookupStream

COLUMNS = {7: "item"}


def rows_of(spark, n=1200, seed=5):
    rng = np.random.default_rng(seed)
    ts = np.sort(rng.integers(0, 6 * 86400, n))
    pdf = pd.DataFrame(
        {"event_id": np.arange(n), "timestamp": ts, "label_type": rng.choice([0, 1, 2], n), "label_time": ts + rng.integers(0, 90_000, n), "item": rng.integers(-1, 25, n)}
    )
    return spark.createDataFrame(pdf)


def test_answers_equal_the_batch_lookup(spark, tmp_path):
    df = rows_of(spark)
    when = lambda: history.available_time(F.col("timestamp"), F.col("label_type"), F.col("label_time"))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    columns = history.history_columns([7])

    def batch_answers(part):
        store = history.history_build(part, COLUMNS, "available")
        looked = history.history_lookup(part, store, COLUMNS, prior=0.3)
        return {r.event_id: tuple(round(v, 9) for v in r[1:]) for r in looked.select("event_id", *columns).collect()}

    def stream():
        return LookupStream(spark, source, df.schema, state, COLUMNS, when, 0.3, compact_every=2)

    def streamed(found):
        return {r.event_id: tuple(round(v, 9) for v in r[1:]) for r in found.select("event_id", *columns).collect()}

    # the later half first, in two files, and rows again within and between files
    late, early = df.where("event_id >= 600"), df.where("event_id < 600")
    late.where("event_id % 2 = 0").union(late.where("event_id % 50 = 0")).coalesce(1).write.parquet(source)
    late.coalesce(1).write.mode("append").parquet(source)
    first = streamed(stream().run(files_per_batch=1))
    assert first == batch_answers(late)

    # a restart with the earlier half: what was answered is corrected
    early.coalesce(1).write.mode("append").parquet(source)
    late.where("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(source)
    second = streamed(stream().run(files_per_batch=1))
    assert second == batch_answers(df) and any(second[k] != first[k] for k in first)

    # a batch that is replayed after a failure, and a start without new files
    replayed = stream()
    replayed.process(spark.read.schema(df.schema).parquet(source).where("event_id % 3 = 0 and event_id >= 600"), 3)
    assert streamed(replayed.answers()) == second == streamed(stream().run())
