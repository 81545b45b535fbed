"""A set similarity join on word shingles with prefixes of token combinations.

Tokens are put in one order, rare ones first. If x and y are linked, x has at most t = n - ceil(p n) tokens that y lacks, so among
any t + 1 tokens of x one is shared; with the order, it is found in the prefixes of both. A frequent token alone is a poor key, so frequent tokens
are dealt by hash to classes, and combinations of k tokens of a class are indexed: t missing tokens leave a combination intact as soon as
the prefix has t + 1 tokens besides k - 1 of each class. The prefix is extended by that much.

How frequent a token is comes from a table of counters of fixed size, in which each token has its slot (fewer than one counter a document, 2 ** 24
at most). Sharing a slot makes tokens look more frequent, which costs some speed and no link. Texts with equal sets form one node before anything is indexed.

Candidates are never expanded into all pairs of a key's nodes. Each node is first verified against one centre, and components are formed. A
key whose nodes are all in one component is done. Elsewhere three exact bounds cut what is left: the sizes, the rare tokens that a node shares
with no other prefix (they can't be in the partner), and parity bitmaps (equal bits in both cancel, so the bits that differ bound the
tokens that do). What passes is verified on the full sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.base import register, table
from tallyrow.llm.bytescan import LOWER, SPACED, U64, as_long, mix, words
from tallyrow.llm.components import components
from tallyrow.llm.neardup import digest, shingle_sets, similar
from tallyrow.session import materialize

SHINGLE = 4
PERCENT = 85
LEAST_PERCENT = 80  # below, the classes could lose more tokens than a set has
SMALL = 24  # nodes of a key that is joined with itself
BLOCK = 256  # nodes in a block of a larger key, fewer of long texts
TRIPLES = 1 << 13  # excess count from which combinations have three tokens
FEWEST, MOST = 16, 24  # the counters are 2 ** 16 to 2 ** 24
#: Frequency groups: combination size, and the share of a level's tokens in one class.
SIZE = (1, 2, 3)
PER_CLASS = (0, 4, 8)
_SINGLE, _JOINT = U64(101), U64(103)
_MARK = U64(1)  # the last bit of a key tells single rare tokens from combinations


def missing(n, percent: int):
    """Most tokens of a set of n that a linked set can lack."""
    return n - -(-percent * n // 100)


def _ids(table_: DataFrame) -> list[Column]:
    """128 bits that name a row by id and text."""
    text = F.col("text").cast("string")
    return [F.xxhash64("doc_id", text).alias("row1"), F.xxhash64(text, F.lit(29), "doc_id").alias("row2")]


def frequency_groups(documents: DataFrame, triples: int = TRIPLES, most: int = MOST) -> np.ndarray:
    """Group 0 (rare), 1 or 2 for each slot of the counters.

    A slot is frequent when it stands out from the mean load by more than chance does; the driver gets one byte a slot, 2 ** ``most`` at most.
    """
    rows = documents.count()
    bits = min(max(FEWEST, int(rows).bit_length() - 1), most)
    slots = 1 << bits

    def count(batches):
        total = np.zeros(slots, np.int64)
        pending, held = [], 0
        for batch in batches:
            for w in words(batch.column(0), SPACED, LOWER):
                for s in shingle_sets(w, SHINGLE):
                    pending.append((s >> U64(64 - bits)).astype(np.int32))
                    held += len(s)
                if held >= slots:
                    total += np.bincount(np.concatenate(pending), minlength=slots)
                    pending, held = [], 0
        if held:
            total += np.bincount(np.concatenate(pending), minlength=slots)
        used = np.flatnonzero(total)
        for a in range(0, len(used), 1 << 16):
            part = used[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["slot", "n"])

    counted = materialize(documents.select(F.col("text").cast("string")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")))
    mean = (counted.agg(F.sum("n")).first()[0] or 0) / slots
    excess = F.col("n") - mean
    group = F.when(excess <= 6 * mean**0.5 + 8, 0).when(excess < triples, 1).otherwise(2)
    found = counted.select("slot", group.cast("tinyint").alias("g")).where("g > 0").toArrow()
    groups = np.zeros(slots, np.uint8)
    groups[np.asarray(found.column(0))] = np.asarray(found.column(1))
    return groups


def class_combinations(tokens: np.ndarray, size: int) -> np.ndarray:
    """One hash for each combination of ``size`` of some sorted tokens."""
    if size == 1:
        return tokens
    if size == 2:
        picks = np.triu_indices(len(tokens), 1)
    else:
        picks = np.array(list(combinations(range(len(tokens)), size)), np.int64).T
    out = mix(tokens[picks[0]])
    for other in picks[1:]:
        out = mix(out ^ tokens[other])
    return out


def signatures(tokens: np.ndarray, groups: np.ndarray, percent: int) -> tuple[np.ndarray, int, bool]:
    """(keys, how many of them are single rare tokens, whether all rare tokens are in the prefix) of a sorted set.

    The classes depend on the set's size only by its level, a power of two; linked sets share the larger one's level, so a set is indexed
    on its own and on that of the largest partner.
    """
    n = len(tokens)
    need = missing(n, percent) + 1
    if 100 * n < percent * (n + 1) and need == 1:
        return np.zeros(0, U64), 0, True  # linked with equal sets only
    group = groups[(tokens >> U64(65 - len(groups).bit_length())).astype(np.int64)]
    rare = tokens[group == 0]
    single = mix(rare[:need] ^ _SINGLE) | _MARK
    if len(rare) >= need:
        return single, len(single), len(rare) == need
    keys = [single]
    for level in sorted({n.bit_length() - 1, (100 * n // percent).bit_length() - 1}):
        left = need - len(rare)
        for g in (1, 2):
            own = tokens[group == g]
            if not len(own) or left <= 0:
                continue
            classes = max(1, (1 << level) // PER_CLASS[g])
            at = (mix(own ^ U64(g)) % U64(classes)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            own, at = own[order], at[order]
            edges = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            salt = mix(np.array([level << 40 | g << 32], U64) ^ _JOINT)
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(own)).tolist()):
                gain = b - a - SIZE[g] + 1
                if gain <= 0:
                    continue
                if gain > left:
                    b -= gain - left
                keys.append(mix(class_combinations(own[a:b], SIZE[g]) ^ salt) & ~_MARK)
                left -= min(gain, left)
                if left <= 0:
                    break
        if left > 0:
            raise ValueError(f"the prefix of a set of {n} can't be extended far enough at {percent} %")
    return np.unique(np.concatenate(keys)) if len(keys) > 1 else single, len(single), True


def parity(tokens: np.ndarray) -> bytes:
    """Bitmap of at least 2 n bits; a bit tells whether an odd number of tokens falls on it."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens ^ U64(107)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: np.ndarray, words_: int) -> np.ndarray:
    """The bitmap at a smaller size; works on rows too."""
    while bitmap.shape[-1] > words_:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def may_link(differ: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Sets of sizes n and m with at least ``differ`` tokens in only one of them may still be linked."""
    most = (n + m - differ) // 2
    return 100 * most >= percent * (n + m - most)


def _nodes(documents: DataFrame, groups: np.ndarray, percent: int) -> DataFrame:
    """(doc_id, row1, row2, n, cls, singles, whole, keys); the last four are null for an empty set."""
    shared = documents.sparkSession.sparkContext.broadcast(groups)

    def scan(batches):
        for batch in batches:
            n, cls, singles, whole, keys = [], [], [], [], []
            for w in words(batch.column(3), SPACED, LOWER):
                for s in shingle_sets(w, SHINGLE):
                    n.append(len(s))
                    found = signatures(s, shared.value, percent) if len(s) else (None,) * 3
                    cls.append(digest(s) if len(s) else None)
                    keys.append(found[0].tobytes() if len(s) else None)
                    singles.append(found[1])
                    whole.append(found[2])
            columns = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(singles, pa.int64()), pa.array(whole, pa.bool_()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row1", "row2", "n", "cls", "singles", "whole", "keys"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row1 bigint, row2 bigint, n bigint, cls binary, singles bigint, whole boolean, keys binary"
    return documents.select("doc_id", *_ids(documents), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, n) for each key of each node."""

    def scan(batches):
        for batch in batches:
            node, n = (np.asarray(batch.column(i)) for i in range(2))
            keys = [np.frombuffer(k, U64) for k in batch.column(2).to_pylist()]
            times = np.array([len(k) for k in keys])
            if times.sum():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.concatenate(keys))), pa.array(np.repeat(node, times)), pa.array(np.repeat(n, times))],
                    ["key", "node", "n"],
                )

    return nodes.select("node", "n", "keys").mapInArrow(scan, "key bigint, node bigint, n bigint")


def _with_parity(texts: DataFrame) -> DataFrame:
    """Adds ``bits``, the parity bitmap, to (node, n, text)."""

    def scan(batches):
        for batch in batches:
            bits = [parity(s) for w in words(batch.column(2), SPACED, LOWER) for s in shingle_sets(w, SHINGLE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary())], [*batch.schema.names, "bits"])

    return texts.mapInArrow(scan, "node bigint, n bigint, text string, bits binary")


def _both(pairs: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the columns of both nodes."""
    sides = [texts.select(F.col("node").alias(s), *[F.col(c).alias(c + s) for c in columns]) for s in ("a", "b")]
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", *[c + s for c in columns for s in ("a", "b")])


def _differ(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def _possible(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps leave open."""

    def scan(batches):
        for batch in batches:
            differ = np.array([_differ(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], np.int64)
            open_ = may_link(differ, np.asarray(batch.column(4)), np.asarray(batch.column(5)), percent)
            yield batch.select([0, 1]).filter(pa.array(open_, pa.bool_()))

    return _both(pairs, texts, "bits", "n").mapInArrow(scan, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are linked."""

    def scan(batches):
        for batch in batches:
            sides = [(s for w in words(batch.column(c), SPACED, LOWER) for s in shingle_sets(w, SHINGLE)) for c in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array([similar(x, y, percent) for x, y in zip(*sides)], pa.bool_()))

    return _both(pairs, texts, "text").mapInArrow(scan, "a bigint, b bigint")


def _compatible(percent: int) -> Column:
    """Sizes fit, and neither has so many tokens of its own that the other is out of reach (``reach`` holds if the other's rare ones are all indexed)."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sizes & (~F.col("wb") | (F.col("nb") <= F.col("ha"))) & (~F.col("wa") | (F.col("na") <= F.col("hb")))


def _blockwise(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The open pairs (a, b) of different roots in keys of many nodes.

    The nodes of a key are dealt to blocks by hash, and every two blocks meet in one group of bounded size.
    """

    def meet(key, part):
        first, second = key[1].as_py(), key[2].as_py()
        node, root, n, reach, whole, block = (np.asarray(part.column(c)) for c in ("node", "root", "n", "reach", "whole", "block"))
        bits = [np.frombuffer(b, U64) for b in part.column("bits").to_pylist()]
        size = np.array([len(b) for b in bits])
        found = []
        rows, others = np.flatnonzero(block == first), np.flatnonzero(block == second)
        # others by bitmap size, each a matrix; folded once for each smaller size
        same = {int(s): others[size[others] == s] for s in np.unique(size[others])}
        stacked = {s: np.stack([bits[j] for j in js]) for s, js in same.items()}
        at = {}
        for i in rows:
            for s, js in same.items():
                ok = (root[js] != root[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))
                ok &= (~whole[js] | (n[js] <= reach[i])) & (not whole[i] or n[i] <= reach[js])
                if first == second:
                    ok &= node[js] > node[i]
                picked = np.flatnonzero(ok)
                if not len(picked):
                    continue
                small = min(s, int(size[i]))
                if (s, small) not in at:
                    at[s, small] = folded(stacked[s], small)
                differ = np.bitwise_count(at[s, small][picked] ^ folded(bits[i], small)).sum(axis=1).astype(np.int64)
                for j in js[picked[may_link(differ, n[js[picked]], n[i], percent)]]:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    blocks = F.ceil(F.col("weight") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).join(texts.select("node", "bits"), "node")
    dealt = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        "key", F.least("block", "partner").alias("first"), F.greatest("block", "partner").alias("second"), "node", "root", "n", "reach", "whole", "block", "bits"
    )
    return dealt.groupBy("key", "first", "second").applyInArrow(meet, "a bigint, b bigint")


def _scored(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, size, score, whole, reach) of the members.

    ``score`` says how many others a node meets in all its keys. ``reach`` is the greatest size of a partner all of whose rare tokens are indexed (``whole``):
    a rare token whose key has one node is in no such partner, which bounds what the two share.
    """
    tie = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    sums = members.groupBy("node").agg((F.sum(F.col("size") * F.col("times")) * (1 << 20) + tie).alias("score"), F.sum("ones").alias("seen"))
    known = nodes.select("node", "n", "singles", "whole").join(sums, "node").withColumn("most", F.col("n") - F.col("singles") + F.col("seen"))
    known = known.withColumn("reach", F.expr(f"most * {100 + percent} div {percent} - n")).select("node", "score", "whole", "reach")
    return members.drop("times", "ones").join(materialize(known), "node")


def _open_keys(members: DataFrame, percent: int) -> DataFrame:
    """The members that can still have a partner in their key, with the key's new ``size`` and ``weight``; keys of one component are gone.

    A node needs a smaller or equal partner within its reach, or is itself such a one: it is compared with the least size and the
    greatest reach in its key.
    """
    ends = members.groupBy("key").agg(
        F.min("n").alias("least"), F.max("reach").alias("far"), F.min("root").alias("low"), F.max("root").alias("high"), F.bool_and("whole").alias("all_whole")
    )
    ends = materialize(ends.where("low <> high").drop("low", "high"))
    alive = members.join(ends, "key").where(~F.col("all_whole") | ((F.col("least") <= F.col("reach")) & (F.col("n") <= F.col("far"))))
    alive = materialize(alive.drop("least", "far", "all_whole"))
    weight = F.sum(1 + F.floor(F.col("n") / 2048)).alias("weight")
    sizes = alive.groupBy("key").agg(F.count(F.lit(1)).alias("size"), weight, F.min("root").alias("low"), F.max("root").alias("high"))
    return alive.join(materialize(sizes.where("low <> high").select("key", "size", "weight")), "key")


def link_similar(documents: DataFrame, percent: int = PERCENT, groups: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Texts are compared as sets of distinct 4-word shingles after lower-casing A-Z; a text of fewer words is one shingle, and one without words, empty
    or null, has none and is linked with nothing: its component is its own id. Rows are linked when 100 * intersection >= percent * union, for
    percent from 80 to 100; ``component_id`` is the smallest id reachable. Repeated rows have equal sets and share a component; a null id is no candidate
    for ``component_id``, which is null only if every id of the component is. Other columns are ignored.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be in [{LEAST_PERCENT}, 100], got {percent}")
    rows = materialize(_nodes(documents, frequency_groups(documents) if groups is None else groups, percent))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row1", "row2")).alias("x")
    nodes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(one, *[F.any_value(c).alias(c) for c in ("n", "singles", "whole", "keys")])
    nodes = materialize(nodes.select("cls", "x.doc_id", "x.row1", "x.row2", "n", "singles", "whole", "keys", F.monotonically_increasing_id().alias("node")))

    members = _members(nodes)
    # of keys with the same nodes, known by 128 bits, one is enough
    found = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *[F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"of{seed}") for seed in (1, 2)])
    found = found.where("size > 1").groupBy("size", "of1", "of2")
    # written, so that the joins are of plain exchanges, of which Spark splits the hot ones
    shared = materialize(found.agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times"), F.sum(F.col("key").bitwiseAND(1)).alias("ones")).drop("of1", "of2"))
    members = materialize(members.join(shared, "key"))

    wanted = nodes.join(members.select("node").distinct(), "node").select("row1", "row2", "node", "n")
    source = documents.select(*_ids(documents), F.col("text").cast("string").alias("text"))
    texts = source.join(materialize(wanted), ["row1", "row2"]).select("node", "n", "text").dropDuplicates(["node"])
    texts = materialize(_with_parity(texts))

    # one centre for each node: what shares the most keys with others is likest to be the base of its variants
    scored = materialize(_scored(members, nodes, percent))
    centres = scored.groupBy("key").agg(F.max_by("node", "score").alias("centre"), F.max("score").alias("top"), F.max_by("n", "score").alias("nc"))
    fits = 100 * F.least("n", "nc") >= percent * F.greatest("n", "nc")
    offers = scored.join(materialize(centres), "key").where((F.col("node") != F.col("centre")) & fits)
    stars = offers.groupBy(F.col("node").alias("a")).agg(F.max_by("centre", "top").alias("b"))
    linked = materialize(_verified(materialize(_possible(stars, texts, percent)), texts, percent))

    roots = materialize(components(linked))
    labelled = scored.drop("size", "score").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = materialize(_open_keys(materialize(labelled), percent))
    small = open_.where(F.col("size") <= SMALL)
    sides = [small.select("key", *[F.col(c).alias(s + x) for c, s in (("node", ""), ("n", "n"), ("root", "r"), ("reach", "h"), ("whole", "w"))]) for x in ("a", "b")]
    apart = sides[0].join(sides[1], "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _compatible(percent))
    close = _possible(apart.select("a", "b").distinct(), texts, percent).union(_blockwise(open_.where(F.col("size") > SMALL), texts, percent)).distinct()
    more = _verified(materialize(close), texts, percent)
    roots = materialize(components(materialize(linked.union(more))))

    by_node = nodes.select("cls", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = by_node.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = materialize(by_node.join(smallest, "root").select(F.col("cls").alias("of"), "component_id"))
    found = rows.join(by_class, F.col("cls") == F.col("of"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


@register("op11_combination_join")
def op11_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_similar(table(spark, sf_dir, "documents"), PERCENT)
