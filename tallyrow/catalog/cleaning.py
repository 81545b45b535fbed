"""Filters, id cleaning and list operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrow.catalog.base import PLAN, joined, per_domain, query, r6, rows, seqs, with_base, with_seqs
from tallyrow.catalog.features import BUCKET_LIST
from tallyrow.functions import cleaning as c
from tallyrow.functions import sequences as s
from tallyrow.operators import assemble
from tallyrow.operators.profile import primary_values
from tallyrow.operators.splits import filter_time
from tallyrow.plans.windows import local_epoch

_LO, _HI = local_epoch("2024-01-10"), local_epoch("2024-01-20")
_U3 = "user_int_feats_3"


@query(
    "filter_time_range",
    with_base(f'SELECT event_id, "timestamp" FROM impressions WHERE "timestamp" >= {_LO} AND "timestamp" < {_HI}'),
)
def _(spark, sf):
    return filter_time(rows(spark, sf, _LO, _HI), _LO, _HI).select("event_id", "timestamp")


@query(
    "binary_labels",
    with_base(
        """SELECT event_id, CAST(coalesce(label_type, 0) = 2 AS BIGINT) AS label,
  CAST(coalesce(label_type, 0) >= 1 AS BIGINT) AS label_click FROM impressions"""
    ),
)
def _(spark, sf):
    raw = F.col("label_type")
    return rows(spark, sf).select(
        "event_id", c.binary_label(raw).alias("label"), c.binary_label(raw, 1).alias("label_click")
    )


@query(
    "clean_scalar_ids",
    with_base(
        """SELECT event_id, CASE WHEN user_int_feats_1 > 0 THEN user_int_feats_1 ELSE 0 END AS u1,
  CASE WHEN user_int_feats_2 > 0 THEN user_int_feats_2 ELSE 0 END AS u2, CAST(0 AS BIGINT) AS u2_no_vocab FROM impressions"""
    ),
)
def _(spark, sf):
    u2 = F.col("user_int_feats_2")
    return rows(spark, sf).select(
        "event_id",
        c.clean_id(F.col("user_int_feats_1")).alias("u1"),
        c.clean_id(u2).alias("u2"),
        c.clean_id(u2, 0).alias("u2_no_vocab"),
    )


@query(
    "clip_oob",
    with_base(
        """SELECT event_id, CASE WHEN user_int_feats_2 > 0 AND user_int_feats_2 < 250 THEN user_int_feats_2 ELSE 0 END AS u2,
  CASE WHEN item_int_feats_11 > 0 AND item_int_feats_11 < 90 THEN item_int_feats_11 ELSE 0 END AS i11 FROM impressions"""
    ),
)
def _(spark, sf):
    return rows(spark, sf).select(
        "event_id",
        c.clean_and_clip(F.col("user_int_feats_2"), 250).alias("u2"),
        c.clean_and_clip(F.col("item_int_feats_11"), 90).alias("i11"),
    )


_OOB = """SELECT '{col}' AS column_name, count(*) AS oob_count, min(v) AS min_oob, max(v) AS max_oob,
  CAST({vocab} AS BIGINT) AS vocab FROM (SELECT {expr} AS v FROM seqs) WHERE v >= {vocab} HAVING count(*) > 0"""


@query(
    "oob_stats",
    with_seqs(
        " UNION ALL ".join(
            [
                _OOB.format(col=f.column, vocab=f.vocab, expr=f.column)
                for f in PLAN.int_features()
                if f.dim == 1
            ]
            + [_OOB.format(col=_U3, vocab=4, expr=f"unnest({_U3}[1:2])")]
            + [
                _OOB.format(col=d.column(fid), vocab=d.vocabs[fid], expr=f"unnest({d.column(fid)}[1:{d.max_len}])")
                for d in PLAN.domains
                for fid in d.side_fids
                if d.vocabs[fid] > 0
            ]
        )
    ),
)
def _(spark, sf):
    return assemble.oob_stats(seqs(spark, sf), PLAN)


@query(
    "pad_int_list",
    with_base(
        """, cut AS (SELECT event_id, coalesce(user_int_feats_3, CAST([] AS BIGINT[])) AS a FROM impressions)
SELECT event_id, CASE WHEN len(a) >= 1 AND a[1] > 0 THEN a[1] ELSE 0 END AS s0,
  CASE WHEN len(a) >= 2 AND a[2] > 0 THEN a[2] ELSE 0 END AS s1, CAST(least(len(a), 2) AS BIGINT) AS kept,
  array_to_string(list_resize(list_transform(a, lambda v: CASE WHEN v > 0 THEN v ELSE 0 END), 5, CAST(0 AS BIGINT)), ',') AS padded
FROM cut"""
    ),
)
def _(spark, sf):
    narrow = c.pad_ints(F.col(_U3), 2)
    return rows(spark, sf).select(
        "event_id",
        narrow[0].alias("s0"),
        narrow[1].alias("s1"),
        c.kept_length(F.col(_U3), 2).alias("kept"),
        joined(c.pad_ints(F.col(_U3), 5)).alias("padded"),
    )


@query(
    "pad_float_list",
    with_base(
        """SELECT event_id, round(user_dense_feats_61[1], 6) AS s0, round(user_dense_feats_61[2], 6) AS s1,
  0.0::DOUBLE AS s2 FROM impressions"""
    ),
)
def _(spark, sf):
    padded = c.pad_floats(F.col("user_dense_feats_61"), 3)
    return rows(spark, sf).select("event_id", *[r6(padded[i]).alias(f"s{i}") for i in range(3)])


@query(
    "log1p_dense",
    with_base(
        """SELECT event_id, round(ln(1 + greatest(user_dense_feats_62[1], 0)), 6) AS d62,
  round(ln(1 + greatest(user_dense_feats_61[2], 0)), 6) AS negative_61 FROM impressions"""
    ),
)
def _(spark, sf):
    return rows(spark, sf).select(
        "event_id",
        r6(c.log1p_list(F.col("user_dense_feats_62"))[0]).alias("d62"),
        r6(c.log1p_list(F.col("user_dense_feats_61"))[1]).alias("negative_61"),
    )


@query(
    "list_is_null",
    with_base(
        """SELECT event_id, coalesce(len(list_filter(user_int_feats_3, lambda v: v > 0)), 0) = 0 AS is_null FROM impressions"""
    ),
)
def _(spark, sf):
    return rows(spark, sf).select("event_id", c.list_is_null(F.col(_U3)).alias("is_null"))


@query(
    "primary_value",
    with_base(
        """, p AS (SELECT event_id, list_filter(user_int_feats_3, lambda v: v <> 0) AS nz, user_int_feats_3 AS a FROM impressions),
q AS (SELECT event_id, CASE WHEN len(nz) > 0 THEN a[1] END AS fs, CASE WHEN len(nz) > 0 THEN nz[1] END AS fn FROM p)
SELECT event_id, 'first_slot' AS mode, fs AS v FROM q WHERE fs IS NOT NULL
UNION ALL SELECT event_id, 'first_nonzero', fn FROM q WHERE fn IS NOT NULL
UNION ALL SELECT event_id, 'zero_filled', coalesce(fs, 0) FROM q"""
    ),
)
def _(spark, sf):
    feature = [f for f in PLAN.user_int if f.fid == 3]
    parts = [
        primary_values(rows(spark, sf), feature, mode, "event_id").select(
            "event_id", F.lit(mode).alias("mode"), "v"
        )
        for mode in ("first_slot", "first_nonzero", "zero_filled")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ROUTED = assemble.routed_fids(PLAN)


@query(
    "missing_route",
    with_base(
        """SELECT event_id,
  CASE WHEN coalesce(user_int_feats_1, 0) <= 0 THEN 7 WHEN user_int_feats_1 < 8 THEN user_int_feats_1 ELSE 0 END AS u1,
  CASE WHEN coalesce(user_int_feats_2, 0) <= 0 THEN 250 WHEN user_int_feats_2 < 251 THEN user_int_feats_2 ELSE 0 END AS u2,
  CASE WHEN item_int_feats_12 > 0 AND item_int_feats_12 < 10 THEN item_int_feats_12 ELSE 0 END AS i12 FROM impressions"""
    ),
)
def _(spark, sf):
    cleaned = assemble.clean_ids(rows(spark, sf), PLAN, _ROUTED)
    return cleaned.select(
        "event_id",
        F.col("user_int_feats_1").alias("u1"),
        F.col("user_int_feats_2").alias("u2"),
        F.col("item_int_feats_12").alias("i12"),
    )


@query(
    "missing_bitmap",
    with_base(
        """SELECT event_id, CAST(coalesce(user_int_feats_1, 0) <= 0 AS DOUBLE) AS m0,
  CAST(coalesce(user_int_feats_2, 0) <= 0 AS DOUBLE) AS m1, CAST(coalesce(item_int_feats_12, 0) <= 0 AS DOUBLE) AS m2
FROM impressions"""
    ),
)
def _(spark, sf):
    flags = assemble.missing_bitmap(assemble.routed_fids(PLAN, None, [12]))
    return rows(spark, sf).select("event_id", *[f.alias(f"m{i}") for i, f in enumerate(flags)])


@query(
    "hash_bucket",
    with_base(
        """, v AS (SELECT event_id, CASE WHEN user_int_feats_2 > 0 THEN user_int_feats_2 ELSE 0 END AS v FROM impressions)
SELECT event_id, CASE WHEN v = 0 THEN 0 ELSE (v - 1) % 63 + 1 END AS bucket FROM v"""
    ),
)
def _(spark, sf):
    return rows(spark, sf).select(
        "event_id", c.hash_bucket(c.clean_id(F.col("user_int_feats_2")), 64).alias("bucket")
    )


@query(
    "hash_mod_vocab",
    with_seqs(
        """SELECT event_id, array_to_string(list_transform(domain_a_seq_40, lambda v: CASE WHEN v > 0 THEN greatest(v % 32, 1) ELSE 0 END), ',') AS folded,
  array_to_string(list_transform(domain_a_seq_40, lambda v: CASE WHEN v > 0 THEN v ELSE 0 END), ',') AS small,
  array_to_string(list_transform(domain_a_seq_40, lambda v: 0), ',') AS dropped FROM seqs"""
    ),
)
def _(spark, sf):
    ids = c.clean_list(F.col("domain_a_seq_40"))

    def fold(threshold: int, size: int):
        return joined(F.transform(ids, lambda x: c.hash_mod_vocab(x, 101, threshold, size)))

    return seqs(spark, sf).select(
        "event_id", fold(50, 32).alias("folded"), fold(200, 32).alias("small"), fold(50, 0).alias("dropped")
    )


@query(
    "dense_remap",
    with_base(
        """SELECT event_id, dense_rank() OVER (ORDER BY item_int_feats_11) - 1 AS i11,
  CASE WHEN user_int_feats_2 > 0 THEN (user_int_feats_2 - 1) % 127 + 1 ELSE 0 END AS u2 FROM impressions"""
    ),
)
def _(spark, sf):
    columns = ["item_int_feats_11", "user_int_feats_2"]
    table = rows(spark, sf).withColumns({x: c.clean_id(F.col(x)) for x in columns})
    codes = assemble.code_tables(table, columns, 128)
    return table.select(
        "event_id",
        assemble.encode(columns[0], codes.get(columns[0]), 128).alias("i11"),
        assemble.encode(columns[1], codes.get(columns[1]), 128).alias("u2"),
    )


_CLEAN = "CASE WHEN v > 0 AND v < {v} THEN v ELSE 0 END"
_HEAD = "array_to_string(list_transform({item}[1:{L}], lambda v: " + _CLEAN + "), ',') AS head_{d}"


@query("seq_head", with_seqs("SELECT event_id, " + per_domain(_HEAD, ", ") + " FROM seqs"))
def _(spark, sf):
    cleaned = assemble.clean_sequences(seqs(spark, sf), PLAN)
    return cleaned.select(
        "event_id", *[joined(F.col(d.column(d.side_fids[0]))).alias(f"head_{d.letter}") for d in PLAN.domains]
    )


@query(
    "seq_tail",
    with_seqs(
        "SELECT event_id, "
        + per_domain("array_to_string(({item}[1:{L}])[-3:], ',') AS tail_{d}", ", ")
        + " FROM seqs"
    ),
)
def _(spark, sf):
    columns = []
    for d in PLAN.domains:
        side = F.col(d.column(d.side_fids[0]))
        length = s.model_length([side], d.max_len)
        columns.append(joined(s.seq_tail(side, length, 3)).alias(f"tail_{d.letter}"))
    return seqs(spark, sf).select("event_id", *columns)


@query(
    "disable_seq_fids",
    with_seqs(
        """SELECT event_id, array_to_string(list_transform(domain_a_seq_40[1:8], lambda v: 0), ',') AS a,
  array_to_string(list_transform(domain_b_seq_68[1:4], lambda v: CASE WHEN v > 0 AND v < 90 THEN v ELSE 0 END), ',') AS b,
  CAST(least(len(domain_a_seq_40), 8) AS BIGINT) AS len_a FROM seqs"""
    ),
)
def _(spark, sf):
    cleaned = assemble.clean_sequences(seqs(spark, sf), PLAN, disabled=[40])
    return cleaned.select(
        "event_id",
        joined(F.col("domain_a_seq_40")).alias("a"),
        joined(F.col("domain_b_seq_68")).alias("b"),
        s.model_length([F.col("domain_a_seq_40")], 8).alias("len_a"),
    )


_DRAW = "((event_id * 7919 + (i - 1) * 104729 + ascii('{d}') * 31) % 10007) / 10007.0::DOUBLE < 0.25"
_MASKED = (
    "array_to_string(list_transform({values}, lambda v, i: CASE WHEN " + _DRAW + " THEN 0 ELSE v END), ',') AS {name}_{d}"
)


@query(
    "id_mask",
    with_seqs(
        "SELECT event_id, "
        + per_domain(_MASKED.replace("{values}", "{item}[1:{L}]").replace("{name}", "ids"), ", ")
        + ", "
        + per_domain(_MASKED.replace("{values}", BUCKET_LIST).replace("{name}", "tb"), ", ")
        + " FROM seqs"
    ),
)
def _(spark, sf):
    """Ids and recency buckets of every domain, masked alike; SQL cannot repeat the default draw, which a unit test covers."""
    columns = []
    for d in PLAN.domains:

        def draw(position, letter=d.letter):
            mixed = F.col("event_id") * 7919 + position.cast("bigint") * 104729 + ord(letter) * 31
            return (mixed % 10007).cast("double") / F.lit(10007.0)

        ids = c.head(F.col(d.column(d.side_fids[0])), d.max_len)
        buckets = s.time_buckets(F.col("timestamp"), F.col(d.ts_column), d.max_len)
        columns += [
            joined(s.mask_positions(values, draw, 0.25)).alias(f"{name}_{d.letter}")
            for name, values in (("ids", ids), ("tb", buckets))
        ]
    return seqs(spark, sf).select("event_id", *columns)
