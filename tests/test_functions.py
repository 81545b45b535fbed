"""Hand-computed edges of the column functions."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyrow.functions import cleaning as c
from tallyrow.functions import dense
from tallyrow.functions import sequences as s
from tallyrow.functions.clock import clock_text, date_text, daypart, hour_of_day, weekday
from tallyrow.plans.fixed import LOCAL_OFFSET, TIME_BUCKET_EDGES


def one(spark, schema, row, **columns):
    df = spark.createDataFrame([row], schema)
    return df.select(*[v.alias(k) for k, v in columns.items()]).first()


def test_lists_keep_order_and_blank_padding(spark):
    a = F.col("a")
    got = one(
        spark,
        "a array<bigint>",
        ([0, -1, 5, 7],),
        padded=c.pad_ints(a, 3),
        longer=c.pad_ints(a, 6, vocab=6),
        kept=c.kept_length(a, 3),
        null=c.list_is_null(a),
        slot=c.primary_first_slot(a),
        nonzero=c.primary_first_nonzero(a),
        none=c.pad_ints(a, 2, vocab=0),
        head=s.seq_head(a, 3, None),
    )
    assert got.padded == [0, 0, 5]
    assert got.longer == [0, 0, 5, 0, 0, 0]
    assert got.kept == 3 and got.null is False
    assert got.slot == 0 and got.nonzero == -1
    assert got.none == [0, 0] and got.head == [0, 0, 5]


@pytest.mark.parametrize("values", [None, [], [0, -1], [-3]])
def test_lists_without_positive_entry_are_null(spark, values):
    got = one(
        spark, "a array<bigint>", (values,), null=c.list_is_null(F.col("a")), padded=c.pad_ints(F.col("a"), 2)
    )
    assert got.null is True and got.padded == [0, 0]


def test_floats_are_not_clamped(spark):
    got = one(
        spark,
        "a array<double>",
        ([-1.5, 2.0],),
        padded=c.pad_floats(F.col("a"), 3),
        logged=c.log1p_list(c.pad_floats(F.col("a"), 3)),
    )
    assert got.padded == [-1.5, 2.0, 0.0]
    assert got.logged == pytest.approx([0.0, np.log(3.0), 0.0])


@pytest.mark.parametrize(
    "value,cleaned,routed,bucket,folded",
    [(None, 0, 5, 0, 0), (-2, 0, 5, 2, 2), (0, 0, 5, 0, 0), (4, 4, 4, 1, 1), (5, 0, 5, 2, 2), (6, 0, 0, 3, 1)],
)
def test_scalar_ids(spark, value, cleaned, routed, bucket, folded):
    """A raw id equal to the old vocab shares the slot of the missing ids."""
    v = F.col("v")
    got = one(
        spark,
        "v bigint",
        (value,),
        cleaned=c.clean_and_clip(v, 5),
        routed=c.route_missing(v, 5),
        bucket=c.hash_bucket(F.coalesce(F.abs(v), F.lit(0)), 4) if value is None or value >= 0 else F.lit(2),
        folded=c.hash_mod(v, 4) if value is None or value >= 0 else F.lit(2),
    )
    want_fold = 0 if not value else (2 if value < 0 else max(value % 4, 1))
    assert got.cleaned == cleaned and got.routed == routed
    assert got.folded == want_fold
    assert got.bucket == bucket


def test_three_primary_modes_on_zero_first_slot(spark):
    got = one(
        spark,
        "a array<bigint>",
        ([0, 3],),
        slot=c.primary_first_slot(F.col("a")),
        nonzero=c.primary_first_nonzero(F.col("a")),
    )
    assert (got.slot, got.nonzero) == (0, 3)


def test_hash_mod_vocab_only_above_threshold(spark):
    v = F.col("v")
    got = one(
        spark,
        "v bigint",
        (77,),
        high=c.hash_mod_vocab(v, 1000, 100, 10),
        low=c.hash_mod_vocab(v, 100, 100, 10),
        dropped=c.hash_mod_vocab(v, 1000, 100, 0),
        off=c.hash_mod_vocab(v, 1000, 0, 10),
    )
    assert (got.high, got.low, got.dropped, got.off) == (7, 77, 0, 77)


def test_lengths_differ(spark):
    side, ts = F.col("side"), F.col("ts")
    got = one(
        spark,
        "side array<bigint>, other array<bigint>, ts array<bigint>",
        ([0, 0, 0], [1], [0, 5, -1, 9, 9]),
        model=s.model_length([side, F.col("other")], 2),
        true_all=s.true_length(ts),
        true_head=s.true_length(ts, 2),
        clipped=s.clipped_length(ts, 4),
        spread=s.time_range(ts, 4),
        tail=s.seq_tail(ts, F.lit(4), 2),
        short=s.seq_tail(side, F.lit(1), 3),
    )
    assert (got.model, got.true_all, got.true_head, got.clipped, got.spread) == (2, 3, 1, 4, 4)
    assert got.tail == [-1, 9] and got.short == [0]


def test_time_buckets_equal_searchsorted(spark):
    now = 2_000_000_000
    rng = np.random.default_rng(3)
    ages = np.concatenate([TIME_BUCKET_EDGES, np.array(TIME_BUCKET_EDGES) + 1, [0, -50], rng.integers(0, 4e7, 200)])
    lists = [int(now - a) for a in ages] + [0, -7]
    got = one(
        spark,
        "ts bigint, l array<bigint>",
        (now, lists),
        b=s.time_buckets(F.col("ts"), F.col("l"), len(lists)),
    ).b
    age = np.maximum(now - np.array(lists), 0)
    want = np.minimum(np.searchsorted(TIME_BUCKET_EDGES, age), 62) + 1
    want[np.array(lists) == 0] = 0
    assert got == want.tolist()
    assert got[-1] == 63  # a negative timestamp is very old, not padding


def test_edges_are_checked():
    with pytest.raises(ValueError):
        s.check_edges([5, 10])
    with pytest.raises(ValueError):
        s.check_edges([5] * 63)
    with pytest.raises(ValueError):
        s.check_edges(range(63))


def test_mask_keeps_length_and_is_shared(spark):
    df = spark.range(50).select(
        "id", F.sequence(F.lit(1), F.lit(20)).cast("array<bigint>").alias("a"), F.array_repeat(F.lit(9).cast("bigint"), 20).alias("b")
    )
    draw = s.hashed_draw(F.col("id"), "seq_a", 11)
    rows = df.select(
        s.mask_positions(F.col("a"), draw, 0.3).alias("a"), s.mask_positions(F.col("b"), draw, 0.3).alias("b")
    ).collect()
    dropped = 0
    for row in rows:
        assert len(row.a) == len(row.b) == 20
        assert [x == 0 for x in row.a] == [x == 0 for x in row.b]
        dropped += sum(x == 0 for x in row.a)
    assert 200 < dropped < 400


def test_draw_is_the_chained_hash_of_row_domain_position_and_seed(spark):
    def chained(row):
        seed = 42
        for data in (row.to_bytes(8, "little"), b"seq_a", (3).to_bytes(4, "little"), (11).to_bytes(4, "little")):
            seed = xxhash.xxh64_intdigest(data, seed)
        return seed % (1 << 52) / (1 << 52)

    got = spark.range(20).select("id", s.hashed_draw(F.col("id"), "seq_a", 11)(F.lit(3)).alias("x")).collect()
    assert [r.x for r in got] == [chained(r.id) for r in got]


def test_clock_parts(spark):
    ts = 1_706_493_000  # 2024-01-29 01:50:00 UTC, a Monday; 09:50:00 local
    t = F.col("t")
    got = one(
        spark,
        "t bigint",
        (ts,),
        hour=hour_of_day(t),
        local=hour_of_day(t, LOCAL_OFFSET),
        day=weekday(t),
        part=daypart(t),
        text=clock_text(t, LOCAL_OFFSET),
        date=date_text(F.lit(19751)),
        night=daypart(t + 12 * 3600),
    )
    assert (got.hour, got.local, got.day, got.part, got.night) == (1, 9, 0, "09_14", "21_23")
    assert got.text == "2024-01-29 09:50:00" and got.date == "2024-01-29"


def test_local_time_v2_signs(spark):
    ts = 1_706_493_000
    cols = dense.local_time_v2_block(F.col("t"), 19751, 19750)
    got = one(spark, "t bigint", (ts,), v=F.array(*cols)).v
    assert got[0] == 0 and got[3] == 1 and got[13] == 1 and got[10] == 1
    assert got[7] == pytest.approx((9 - 11.5) / 12)
    early = one(spark, "t bigint", (ts - 9 * 3600,), v=F.array(*cols)).v  # local midnight
    assert early[6] == pytest.approx(9 / 12) and early[8] == 1
    assert early[7] == pytest.approx((((0 - 11.5 + 12) % 24) - 12) / 12)
