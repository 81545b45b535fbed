"""The model-ready table: labels, id vectors, dense vector and sequences in one projection.

Except for the optional history lookup, which joins, everything is row-local, so Spark reads,
filters and writes it without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.functions import dense
from tallyrow.functions import sequences as s
from tallyrow.functions.cleaning import binary_label, clean_and_clip
from tallyrow.operators import assemble
from tallyrow.operators.history import history_columns, history_lookup
from tallyrow.plans import fixed
from tallyrow.plans.features import FeaturePlan, SequenceDomain, is_list


@dataclass(frozen=True)
class HistoryOptions:
    """A stored history table and how to look it up."""

    store: DataFrame
    columns: dict[int, str]
    cutoff: int = fixed.DAY
    strength: float = 20.0
    prior: float | None = None
    bin_sec: int = fixed.HOUR


@dataclass(frozen=True)
class TableOptions:
    """Which optional parts the table has. ``routed_*`` None means: no missing slots."""

    routed_user: Sequence[int] | None = None
    routed_item: Sequence[int] = ()
    disabled_seq: Sequence[int] = ()
    edges: dict[str, list[int]] | None = None
    mask_probability: float = 0.0
    mask_domains: Sequence[str] | None = None
    mask_seed: int = 0
    count_features: bool = False
    seq_stats: bool = False
    history: HistoryOptions | None = None
    time_of_day: bool = False
    local_time: bool = False
    local_time_v2: tuple[int, int] | None = None
    hour_only: bool = False
    log1p_fids: Sequence[int] = fixed.LOG1P_DENSE_FIDS


def nonzero_slots(df: DataFrame, features) -> Column:
    """Non-zero slots over the cleaned columns of one side."""
    lists = [f.column for f in features if is_list(df, f.column)]
    scalars = [f.column for f in features if f.column not in lists]
    return dense.nonzero_count([F.col(c) for c in scalars], [F.col(c) for c in lists])


def _sequence_columns(df: DataFrame, domain: SequenceDomain, options: TableOptions, row_key: str) -> dict[str, Column]:
    """Side lists, length and recency buckets of one domain, masked alike."""
    off = set(options.disabled_seq)
    present = [fid for fid in domain.side_fids if domain.column(fid) in df.columns]
    columns = {
        domain.column(fid): s.seq_head(
            F.col(domain.column(fid)), domain.max_len, 0 if fid in off else domain.vocabs[fid]
        )
        for fid in present
    }
    length = s.model_length([F.col(domain.column(fid)) for fid in present], domain.max_len)
    buckets = f"{domain.name}_time_bucket"
    if domain.ts_column:
        edges = (options.edges or {}).get(domain.name, fixed.TIME_BUCKET_EDGES)
        columns[buckets] = s.time_buckets(F.col("timestamp"), F.col(domain.ts_column), domain.max_len, edges)
    chosen = options.mask_domains is None or domain.letter in s.domain_letters(options.mask_domains)
    if options.mask_probability > 0 and chosen:
        draw = s.hashed_draw(F.col(row_key), domain.name, options.mask_seed)
        columns = {name: s.mask_positions(value, draw, options.mask_probability) for name, value in columns.items()}
    return {**columns, f"{domain.name}_len": length}


def training_table(
    df: DataFrame,
    plan: FeaturePlan,
    row_key: str,
    options: TableOptions = TableOptions(),
    weight: Column | None = None,
    labelled: bool = True,
) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The table and the (fid, offset, length) layout of its ``user_dense`` vector.

    Columns: row key, user_id, timestamp, label, label_click (0 when not ``labelled``),
    user_int, item_int, user_dense, per domain the side lists, ``_len`` and ``_time_bucket``,
    the slice inputs, and ``sample_weight`` when given.
    """
    routed = []
    if options.routed_user is not None:
        routed = assemble.routed_fids(plan, options.routed_user, options.routed_item)
    table = df
    if options.history:
        h = options.history
        # the look-up sees the ids the model sees: one out of range has no history of its own
        vocabs = {f.column: f.vocab for f in (*plan.user_int, *plan.item_int)}
        ids = {fid: f"_history_{fid}" for fid in h.columns}
        table = table.withColumns(
            {ids[fid]: clean_and_clip(F.col(c), vocabs[c]) if vocabs.get(c) else F.col(c) for fid, c in h.columns.items()}
        )
        table = history_lookup(table, h.store, ids, h.cutoff, h.strength, h.prior, h.bin_sec).drop(*ids.values())
    raw = F.col("label_type") if labelled else F.lit(0)
    prepared = {
        "label": binary_label(raw),
        "label_click": binary_label(raw, 1),
        "_label_type": F.coalesce(raw, F.lit(0)).cast("bigint"),
    }
    if routed:
        prepared["_missing"] = F.array(*assemble.missing_bitmap(routed))
    for domain in plan.domains:
        prepared[f"_{domain.name}_stats"] = F.array(
            *dense.seq_stats_block(
                s.model_length([F.col(domain.column(f)) for f in domain.side_fids], domain.max_len),
                F.col(domain.ts_column) if domain.ts_column else None,
                domain.max_len,
            )
        )
    sequences: dict[str, Column] = {}
    for domain in plan.domains:
        sequences |= _sequence_columns(table, domain, options, row_key)
    if weight is not None:
        prepared["sample_weight"] = weight
    # One projection reads the raw columns; only then do cleaned ones take their names.
    cleaned = assemble.clean_ids(table.withColumns({**prepared, **sequences}), plan, routed)

    ts = F.col("timestamp")
    user_slots, item_slots = nonzero_slots(cleaned, plan.user_int), nonzero_slots(cleaned, plan.item_int)
    parts = assemble.raw_dense_blocks(plan, options.log1p_fids)
    if options.count_features:
        parts.append(assemble.block(fixed.COUNT_FID, dense.count_block(user_slots, item_slots)))
    if options.seq_stats:
        values = F.concat(*[F.col(f"_{d.name}_stats") for d in plan.domains])
        parts.append((fixed.SEQ_STATS_FID, 2 * len(plan.domains), values))
    if options.history:
        names = history_columns(list(options.history.columns))
        parts.append(assemble.block(fixed.HISTORY_FID, [F.col(n) for n in names]))
    if options.time_of_day:
        parts.append(assemble.block(fixed.TIME_OF_DAY_FID, dense.time_of_day_block(ts)))
    if options.local_time:
        parts.append(assemble.block(fixed.LOCAL_TIME_FID, dense.local_time_block(ts)))
    if options.local_time_v2:
        parts.append(assemble.block(fixed.LOCAL_TIME_V2_FID, dense.local_time_v2_block(ts, *options.local_time_v2)))
    if options.hour_only:
        parts.append(assemble.block(fixed.HOUR_ONLY_FID, dense.hour_block(ts)))
    if routed:
        parts.append((fixed.MISSING_FID, len(routed), F.col("_missing")))
    vector, layout = assemble.assemble_dense(parts) if parts else (F.array().cast("array<double>"), [])

    total = F.lit(0).cast("bigint")
    for domain in plan.domains:
        total = total + F.col(f"{domain.name}_len")
    return (
        cleaned.select(
            row_key,
            "user_id",
            "timestamp",
            "label",
            "label_click",
            assemble.assemble_ints(cleaned, plan.user_int).alias("user_int"),
            assemble.assemble_ints(cleaned, plan.item_int).alias("item_int"),
            vector.alias("user_dense"),
            *sequences,
            user_slots.alias("user_nonzero"),
            item_slots.alias("item_nonzero"),
            total.alias("seq_total_len"),
            F.col("_label_type").alias("label_type_raw"),
            *(["sample_weight"] if weight is not None else []),
        ),
        layout,
    )
