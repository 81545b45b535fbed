"""A trie of the conversations' turn prefixes, in balanced parentheses, shard by shard.

A turn is 128 bits of a hash of role and text, a conversation the string of its turns, cut into bands of ``BAND`` turns so that no
row grows with a conversation. A band hangs below its root, the node where the band before ends, which is known by a hash of
all that leads to it. Equal strings below equal roots are counted before they are shuffled, then dealt by range to shards of a bounded number of strings.

A shard writes its sorted strings as one sequence of parentheses, an open one for each turn that the string does not share with the one before.
``findclose`` over blocks with their least excess delimits the subtree of every node, the rank of leaf pairs counts its leaves, and
cumulative arrays over the nodes in order give members and savings. The nodes on the border of two shards, a spine, are known from the number of turns
that the last string of one and the first of the other share. A spine node counts as new in its first shard only, so its parts are simply added.

Deeper bands are summed up first: a band's total goes to all roots above it by pointer doubling, and hangs at the end of the string it continues.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table
from tallyrow.operators.ordered import number_rows
from tallyrow.session import materialize

BAND = 1024  # turns in a string
SHARD_TURNS = 200_000
BLOCK = 256  # parentheses in a block
SPLICE_EVERY, SPLICE_MOST = 20, 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, words): the turns of each conversation from 1 on, by turn with null first.

    Turns with equal numbers follow the SHA-256 of ``role length : role text``, so repeated rows are adjacent turns. A null role or text
    is empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.substring(digest, 1, 32).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    return number_rows(turns, "conv_id", "turn", ["turn_hash"], "pos", slot_sec=4096).drop("turn")


def spliced(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, words, total): each conversation c with its first h turns replaced.

    They give way to the first h turns of conversation c - c % 20, all if it has fewer, none if there is none; h is crc32 of c in decimal, modulo 4.
    ``total`` is the new number of turns; a conversation that is left without any has one row with pos 0 and an empty hash.
    """
    turns = materialize(turns)
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = sizes.select(
        "conv_id",
        "n",
        (F.col("conv_id") - F.col("conv_id") % SPLICE_EVERY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % SPLICE_MOST).alias("h"),
    )
    bases = sizes.where(F.col("conv_id") % SPLICE_EVERY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "given", "total"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "turn_hash", "words", "total")
    heads = turns.where((F.col("pos") < SPLICE_MOST) & (F.col("conv_id") % SPLICE_EVERY == 0))
    heads = heads.select(F.col("conv_id").alias("base"), "pos", "turn_hash", "words")
    taken = heads.join(convs.select("base", "conv_id", "h", "total"), "base").where("pos <= h").select("conv_id", "pos", "turn_hash", "words", "total")
    bare = convs.where("total = 0").select("conv_id", F.lit(0).cast("bigint"), F.lit(""), F.lit(0).cast("bigint"), "total")
    return own.union(taken).union(bare)


def _half(hexed: Column, first: int) -> Column:
    return F.conv(F.substring(hexed, first, 16), 16, -10).cast("bigint")


def _segments(turns: DataFrame, band: int) -> DataFrame:
    """(conv_id, band, path, words, r1, r2, e1, e2, last): the strings of a conversation with the keys of their root and end."""
    at = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / band).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("pos", "turn_hash", "words"))).alias("rows")
    cut = turns.groupBy("conv_id", at.alias("band")).agg(rows, F.max("total").alias("total"))
    path = F.unhex(F.array_join(F.col("rows.turn_hash"), ""))
    last = F.col("band") == F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / band)
    cut = cut.select("conv_id", "band", path.alias("path"), F.expr("filter(rows, r -> r.pos > 0).words").alias("words"), last.alias("last"))
    hexed = F.sha2(F.concat(F.unhex(F.lpad(F.hex("band"), 8, "0")), F.col("path")), 256)
    step = F.octet_length("path") > 0
    cut = cut.withColumns({n: F.when(step, _half(hexed, f)).otherwise(F.lit(0)) for n, f in (("h1", 1), ("h2", 17))})
    before = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumns({r: F.coalesce(F.bit_xor(h).over(before), F.lit(0)) for r, h in (("r1", "h1"), ("r2", "h2"))})
    return cut.withColumns({"e1": F.col("r1").bitwiseXOR(F.col("h1")), "e2": F.col("r2").bitwiseXOR(F.col("h2"))}).drop("h1", "h2")


def end_digests(ends: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256) of (e1, e2, conv_id).

    SHA-256 reads its input in order, so a node's ids end in one task; they come to it as joined runs of sorted ids, one run a batch, and are
    not held there.
    """

    def join_runs(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            e1, e2, ids = (np.asarray(batch.column(i)) for i in range(3))
            new = np.flatnonzero(np.append(True, (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])))
            text = ids.astype(str).tolist()
            joined = [",".join(text[a:b]) for a, b in zip(new, np.append(new[1:], len(ids)))]
            yield pa.RecordBatch.from_arrays([pa.array(e1[new]), pa.array(e2[new]), pa.array(ids[new]), pa.array(joined)], ["e1", "e2", "first", "ids"])

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            done = []
            for e1, e2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (e1, e2) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = (e1, e2), hashlib.sha256(ids.encode())
            yield _digest_batch(done)
        if key is not None:
            yield _digest_batch([(*key, sha.hexdigest())])

    dealt = ends.select("e1", "e2", "conv_id").repartitionByRange("e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id")
    runs = dealt.mapInArrow(join_runs, "e1 bigint, e2 bigint, first bigint, ids string")
    return runs.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(digest, "e1 bigint, e2 bigint, ends_sha256 string")


def _digest_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["e1", "e2", "ends_sha256"])


class Parens:
    """A balanced sequence of parentheses with the least excess of its blocks in a binary tree."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = max(1, -(-len(bits) // block))
        self.width = 1 << (blocks - 1).bit_length()
        padded = np.full(self.width * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(self.width, block)
        tree = np.empty(2 * self.width, np.int64)
        tree[self.width :] = self.rows.min(axis=1)
        for level in range(self.width.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[a : 2 * a] = np.minimum(tree[2 * a : 4 * a : 2], tree[2 * a + 1 : 4 * a : 2])
        self.tree = tree

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place of a block behind ``after`` with excess at most ``target``, else -1."""
        out = np.empty(len(block), np.int64)
        for a in range(0, len(block), 2048):
            part = slice(a, a + 2048)
            low = (self.rows[block[part]] <= target[part, None]) & (np.arange(self.block) > after[part, None])
            first = low.argmax(axis=1)
            out[part] = np.where(low[np.arange(len(first)), first], first, -1)
        return out

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those at ``at``."""
        target, block = self.excess[at] - 1, at // self.block
        found = self._in_block(block, at % self.block, target)
        close = block * self.block + found
        far = np.flatnonzero(found < 0)
        if len(far):
            t, node = target[far], block[far] + self.width
            # up to the first subtree on the right that goes as low, then down to its first such block
            rising = np.ones(len(far), bool)
            while rising.any():
                right = (node & 1) == 0
                hit = rising & right & (self.tree[np.minimum(node + 1, len(self.tree) - 1)] <= t)
                node = np.where(hit, node + 1, np.where(rising, node >> 1, node))
                rising &= ~hit
            while (inner := node < self.width).any():
                left = 2 * node
                goes = self.tree[np.where(inner, left, 0)] <= t
                node = np.where(inner, np.where(goes, left, left + 1), node)
            b = node - self.width
            close[far] = b * self.block + self._in_block(b, np.full(len(b), -1), t)
        return close

    def leaf_rank(self) -> np.ndarray:
        """Number of leaf pairs that begin before each place."""
        pair = np.append(self.bits[:-1] & ~self.bits[1:], False)
        return np.concatenate([[0], np.cumsum(pair)])


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two strings share."""
    low, high = 0, min(len(a), len(b)) // 16
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: 16 * mid] == b[: 16 * mid] else (low, mid - 1)
    return low


NODE = (
    "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, spine boolean"
)


def shard_nodes(part: pa.Table, band_turns: int, totals: bool) -> pa.Table:
    """The nodes of one shard, or with ``totals`` only the sums below the roots of its deeper bands."""
    part = part.sort_by([(c, "ascending") for c in ("band", "r1", "r2", "path")])
    band, r1, r2, members, least, deeper, more_leaves, more_saved = (
        np.asarray(part.column(c)) for c in ("band", "r1", "r2", "members", "least", "deeper", "more_leaves", "more_saved")
    )
    paths = part.column("path").to_pylist()
    before, after = part.column("before")[0].as_py(), part.column("after")[0].as_py()
    m = len(paths)
    length = np.array([len(p) // 16 for p in paths])
    words = part.column("words").combine_chunks()
    offsets, words = np.asarray(words.offsets), np.asarray(words.values)

    # the nodes in order
    stack: list[int] = []
    shas: list = []
    of, depth, parent, k1, k2, shared = [], [], [], [], [], [-1]
    for i, path in enumerate(paths):
        tree = (int(band[i]), int(r1[i]), int(r2[i]))
        if i:
            same = band[i] == band[i - 1] and r1[i] == r1[i - 1] and r2[i] == r2[i - 1]
            shared.append(shared_turns(paths[i - 1], path) if same else -1)
        del stack[shared[i] + 1 :], shas[shared[i] + 1 :]
        for d in range(shared[i] + 1, len(path) // 16 + 1):
            if d:
                sha = shas[-1].copy()
                sha.update(path[16 * d - 16 : 16 * d])
                digest = sha.digest()
                k1.append(tree[1] ^ int.from_bytes(digest[:8], "big", signed=True))
                k2.append(tree[2] ^ int.from_bytes(digest[8:16], "big", signed=True))
            else:
                sha = hashlib.sha256(tree[0].to_bytes(4, "big"))
                k1.append(tree[1])
                k2.append(tree[2])
            parent.append(stack[-1] if stack else -1)
            stack.append(len(of))
            shas.append(sha)
            of.append(i)
            depth.append(d)
    of, depth, parent, shared = (np.array(x) for x in (of, depth, parent, shared))
    k1, k2 = np.array(k1, np.int64), np.array(k2, np.int64)
    n = len(of)
    end = np.append(np.flatnonzero(of[1:] != of[:-1]), n - 1)  # of each string

    # parentheses: before a string those of the last one close that it does not share
    counts = np.empty(2 * m + 1, np.int64)
    counts[0], counts[1::2] = 0, length - shared
    counts[2:-1:2], counts[-1] = length[:-1] - shared[1:], length[-1] + 1
    parens = Parens(np.repeat(np.arange(2 * m + 1) % 2 == 1, counts))
    at = np.flatnonzero(parens.bits)
    close = parens.findclose(at)
    behind = np.arange(n) + (close - at + 1) // 2

    def summed(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[behind] - total[:n]

    at_end = np.zeros(n, np.int64)
    at_end[end] = members
    n_convs = summed(at_end)
    known = (of == 0) & (depth <= before)
    value = np.where(depth > 0, words[np.minimum(offsets[of] + np.maximum(depth, 1) - 1, max(len(words) - 1, 0))] if len(words) else 0, 0)
    saved = (n_convs - ~known) * value
    saved[end] += more_saved
    saved = summed(saved)
    rank = parens.leaf_rank()
    pairs = np.flatnonzero(parens.bits & ~np.append(parens.bits[1:], True))
    ends_at = of[np.searchsorted(at, pairs)]
    weight = np.where(deeper[ends_at], more_leaves[ends_at], 1)
    if after >= length[-1]:
        weight[-1] = 0  # the next shard goes on below it
    heavy = np.concatenate([[0], np.cumsum(weight)])
    leaves = heavy[rank[close]] - heavy[rank[at]]
    if totals:
        roots = (depth == 0) & (band[of] > 0)
        return pa.table({"k1": k1[roots], "k2": k2[roots], "n_leaves": leaves[roots], "saved_tokens": saved[roots]})

    children = np.bincount(parent[(parent >= 0) & ~known], minlength=n)
    first, last = np.searchsorted(end, np.arange(n)), np.searchsorted(end, behind)
    cuts = np.stack([first, last], axis=1).ravel()
    smallest = np.minimum.reduceat(np.append(least, np.iinfo(np.int64).max), cuts)[::2]
    spine = known.copy()
    spine[[v for d, v in enumerate(stack) if d <= after]] = True
    spine[end[deeper]] = True
    below = (depth == 0) & (band[of] > 0)
    spine |= below
    for x in (n_convs, saved, leaves):
        x[below] = 0  # counted where the band before ends
    top = parent < 0
    up = np.where(top, 0, parent)
    hidden = top | spine[up]
    columns = [
        pa.array(k1),
        pa.array(k2),
        pa.array(k1[up], mask=top),
        pa.array(k2[up], mask=top),
        pa.array(depth + band[of].astype(np.int64) * band_turns),
        pa.array(smallest),
        pa.array(smallest[up], mask=hidden),
        pa.array(n_convs),
        pa.array(children),
        pa.array(leaves),
        pa.array(saved),
        pa.array(spine),
    ]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in NODE.split(", ")])


def _sharded(strings: DataFrame, shard_turns: int) -> DataFrame:
    """``strings`` in shards by range, with the turns that a shard's first and last string share with the neighbouring shards (-1: other trees)."""
    spark = strings.sparkSession
    turns = strings.agg(F.sum(F.octet_length("path") / 16 + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(turns // shard_turns) + 1)
    order = ["band", "r1", "r2", "path"]
    dealt = strings.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    dealt = materialize(dealt)
    place = F.struct(*order)
    borders = dealt.groupBy("shard").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    borders = borders.withColumn("prior", F.lag("high").over(W.orderBy("shard")))  # one row a shard

    def compare(batches):
        for batch in batches:
            before = []
            for low, prior in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                same = prior is not None and all(low[c] == prior[c] for c in order[:3])
                before.append(shared_turns(low["path"], prior["path"]) if same else -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int32())], ["shard", "before"])

    borders = borders.select("shard", "low", "prior").mapInArrow(compare, "shard int, before int")
    borders = borders.withColumn("after", F.coalesce(F.lead("before").over(W.orderBy("shard")), F.lit(-1)))
    return materialize(dealt.join(materialize(borders), "shard"))


def _built(shards: DataFrame, band: int, totals: bool) -> DataFrame:
    schema = "k1 bigint, k2 bigint, n_leaves bigint, saved_tokens bigint" if totals else NODE
    return shards.groupBy("shard").applyInArrow(lambda part: shard_nodes(part, band, totals), schema)


def _totals(shards: DataFrame, band: int) -> DataFrame:
    """(k1, k2, more_leaves, more_saved): sums over all bands below each root of a deeper band."""
    own = _built(shards, band, True).groupBy("k1", "k2").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ups = shards.where("deeper").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "band", "r1", "r2")
    root = F.col("band") > 0
    sums = materialize(own.join(ups, ["k1", "k2"]).select("k1", "k2", "leaves", "saved", F.when(root, F.col("r1")).alias("j1"), F.when(root, F.col("r2")).alias("j2")))
    while not sums.where("j1 is not null").isEmpty():
        given = sums.where("j1 is not null").groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.sum("leaves").alias("add_leaves"), F.sum("saved").alias("add_saved"))
        next_up = sums.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
        sums = materialize(
            sums.join(given, ["k1", "k2"], "left")
            .join(next_up, ["j1", "j2"], "left")
            .select(
                "k1",
                "k2",
                (F.col("leaves") + F.coalesce("add_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("add_saved", F.lit(0))).alias("saved"),
                F.col("n1").alias("j1"),
                F.col("n2").alias("j2"),
            )
        )
    return sums.select("k1", "k2", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))


def prefix_trie(turns: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct prefix of the conversations' turns, the empty one included.

    ``turns`` has conv_id, pos (1 to total), turn_hash (32 hex digits), words and total; a conversation without turns has one row with pos 0.
    Columns: conv_id, the smallest member; depth; parent_conv_id, the smallest member of the parent, null for the root; n_convs, members;
    n_children; n_leaves, childless nodes in the subtree; saved_tokens, (members - 1) times the words of the last turn, summed over the subtree; and
    ends_sha256 of the ascending ids, comma-joined, of the conversations that end there. No turns, no rows.
    """
    segments = materialize(_segments(turns, band))
    ends = end_digests(segments.where("last"))
    strings = segments.groupBy("band", "r1", "r2", "path").agg(
        F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), F.any_value("words").alias("words"), F.any_value("e1").alias("e1"), F.any_value("e2").alias("e2")
    )
    roots = materialize(segments.where("band > 0").select(F.col("r1").alias("e1"), F.col("r2").alias("e2"), F.lit(True).alias("more")).distinct())
    none = F.lit(0).cast("bigint")
    if roots.isEmpty():
        shards = _sharded(materialize(strings).withColumns({"deeper": F.lit(False), "more_leaves": none, "more_saved": none}), shard_turns)
    else:
        marked = materialize(strings).join(roots, ["e1", "e2"], "left").withColumn("deeper", F.col("more").isNotNull()).drop("more")
        shards = _sharded(marked.withColumns({"more_leaves": none, "more_saved": none}), shard_turns)
        totals = materialize(_totals(shards, band).withColumnsRenamed({"k1": "e1", "k2": "e2"}))
        plain = shards.drop("more_leaves", "more_saved").join(totals, ["e1", "e2"], "left")
        shards = plain.fillna(0, ["more_leaves", "more_saved"])
    nodes = materialize(_built(shards.drop("e1", "e2"), band, False))
    spine = nodes.where("spine").groupBy("k1", "k2").agg(
        *[F.max(c).alias(c) for c in ("p1", "p2", "depth")],
        F.min("conv_id").alias("conv_id"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    spine = materialize(spine)
    every = materialize(nodes.where("not spine").drop("spine").unionByName(spine))
    parents = spine.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("of_spine"))
    found = every.join(parents, ["p1", "p2"], "left").join(materialize(ends).withColumnsRenamed({"e1": "k1", "e2": "k2"}), ["k1", "k2"], "left")
    return found.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "of_spine").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_hash,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, turn_hash, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_hash) AS pos FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(
      flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch)::BIGINT >> i::INTEGER) & 1))),
      lambda crc, bit: xor(xor(crc, bit) >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM n)),
r AS (
  SELECT c.conv_id, n.pos, 0 AS own, turn_hash, words FROM c JOIN n ON n.conv_id = c.base WHERE n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, n.pos, 1, turn_hash, words FROM c JOIN n ON n.conv_id = c.conv_id WHERE n.pos > c.h),
p AS (
  SELECT conv_id, words, row_number() OVER w AS depth, string_agg(turn_hash, '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
full_path AS (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id),
node AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY path),
kids AS (SELECT substr(path, 1, length(path) - 64) AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
every AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
up AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
  FROM every a JOIN every b ON starts_with(b.path, a.path) GROUP BY a.path),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM full_path GROUP BY path)
SELECT e.conv_id, e.depth, q.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM every e JOIN up USING (path) LEFT JOIN ends USING (path)
LEFT JOIN node q ON e.depth > 0 AND q.path = substr(e.path, 1, length(e.path) - 64)"""


@register("op13_prefix_trie", SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(numbered_turns(table(spark, sf_dir, "conversations"))))
