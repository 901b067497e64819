"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits wide. All distinct fingerprints form a binary trie; the join traverses pairs of trie nodes together,
adds up the bits in which their paths differ and drops a pair as soon as it exceeds the budget.

The upper part of the trie is traversed as Spark joins, four bits a step: a node that holds more than ``leaf`` fingerprints is
replaced by its children, a smaller one is a leaf and stays. So a crowded region is cut deeper than a sparse one, and a leaf
never holds more than ``leaf`` fingerprints (at 64 bits a node is one fingerprint). Each surviving pair of leaves is one row
that carries both leaves' fingerprints; a task walks the rest of the two subtrees bit by bit on sorted arrays, in slices of
bounded size. A pair of leaves gives back a spanning forest of its links (closest links first), at most one link per
fingerprint, never all pairs of a group.

Connected components over these links: every round joins each vertex to the smallest vertex it knows, as aggregations and joins
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fresh, in_slices, words_of

BITS, STEP = 64, 4
#: Node pairs that a task holds at once, and size of a pair of ranges that is compared directly.
SLICE, DIRECT = 200_000, 256


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def majority(parts: list[bytes], seed: int = 42) -> int:
    """The fingerprint of shingles: a bit is set if over half of the hashes have it; no shingle, no bit."""
    if not parts:
        return 0
    ones, n = np.zeros(BITS, dtype=np.int64), len(parts)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        own = parts[k:k + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in own), dtype=np.uint64, count=len(own))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(size: int = 3, distinct: bool = False, seed: int = 42):
    """Column function text -> signed 64-bit fingerprint of word shingles, ASCII letters in lower case."""
    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> int:
            parts = shingles([w.lower() for w in words_of(t)], size)
            return majority(list(set(parts)) if distinct else parts, seed)
        return pd.Series(np.array([one(t) for t in text], dtype=np.uint64).view(np.int64))
    return of


# ---- the trie join -------------------------------------------------------------------------------------------------------


def _linked(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``budget`` bits of two sorted arrays of fingerprints, from bit ``depth`` down. ``same``: a is
    b, and each pair is met once. Ranges of the sorted arrays are the trie nodes."""
    def cut(values, low, high, at):
        """Where a node's right child starts."""
        if at >= BITS:
            return high
        # The first value whose bit ``at`` is set: within a node all higher bits are equal.
        bit = np.uint64(1) << np.uint64(BITS - 1 - at)
        some = high > low
        head = np.where(some, values[np.minimum(low, len(values) - 1)], 0).astype(np.uint64)
        upper = np.uint64(0xFFFFFFFFFFFFFFFF) ^ (bit | (bit - np.uint64(1)))
        return np.clip(np.searchsorted(values, (head & upper) | bit), low, high)

    stack = [(depth, *(np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        at, al, ah, bl, bh, diff = stack.pop()
        if len(al) > SLICE:
            for k in range(0, len(al), SLICE):
                stack.append((at, *(x[k:k + SLICE] for x in (al, ah, bl, bh, diff))))
            continue
        done = (ah - al) * (bh - bl) <= DIRECT if at < BITS else np.ones(len(al), dtype=bool)
        if done.any():
            n, m = (ah - al)[done], (bh - bl)[done]
            total = n * m
            first = np.cumsum(total) - total
            for k in np.array_split(np.arange(len(total)), max(1, int(total.sum()) // (SLICE * 8))):
                if not len(k):
                    continue
                owner = np.repeat(k, total[k])
                inner = np.arange(len(owner)) - (first[owner] - first[k[0]])
                i, j = al[done][owner] + inner // m[owner], bl[done][owner] + inner % m[owner]
                if same:
                    i, j = i[i < j], j[i < j]
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if near.any():
                    yield i[near], j[near]
        go = ~done
        if go.any():
            al, ah, bl, bh, diff = (x[go] for x in (al, ah, bl, bh, diff))
            ac, bc = cut(a, al, ah, at), cut(b, bl, bh, at)
            own = (al == bl) & (ah == bh) if same else np.zeros(len(al), dtype=bool)
            parts = [(al, ac, bl, bc, diff, None), (ac, ah, bc, bh, diff, None), (al, ac, bc, bh, diff + 1, None), (ac, ah, bl, bc, diff + 1, ~own)]
            kept = []
            for p in parts:
                ok = (p[1] > p[0]) & (p[3] > p[2]) & (p[4] <= budget)
                kept.append([x[ok if p[5] is None else ok & p[5]] for x in p[:5]])
            merged = [np.concatenate(x) for x in zip(*kept)]
            if len(merged[0]):
                stack.append((at + 1, *merged))


def _forest(values: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links, closest first."""
    if not pairs:
        return []
    i, j = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(np.bitwise_count(values[i] ^ values[j]), kind="stable")
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def leaf_links(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int) -> list[tuple[int, int]]:
    """Forest of links inside one leaf (b is None) or between two."""
    a = np.sort(a)
    if b is None:
        values, shift, pairs, buffered, held = a, 0, _linked(a, a, depth, budget, True), [], 0
    else:
        b = np.sort(b)
        values, shift, pairs, buffered, held = np.concatenate([a, b]), len(a), _linked(a, b, depth, budget, False), [], 0
    for i, j in pairs:
        buffered.append((i, j + shift))
        held += len(i)
        if held > 4 * SLICE:  # links that a forest already holds need not wait for the rest
            kept = _forest(values, buffered)
            buffered, held = [(np.array([x for x, _ in kept], dtype=np.int64), np.array([y for _, y in kept], dtype=np.int64))], 0
    return [(int(values[x]), int(values[y])) for x, y in _forest(values, buffered)]


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth) if depth < BITS else fp


def trie_links(fps: DataFrame, budget: int, leaf: int = 65_536) -> DataFrame:
    """fps: one row per distinct fingerprint ``fp``. Rows (a, b): links of at most ``budget`` bits that connect whatever all links
    connect."""
    fps = durable(fps.select("fp"), "fingerprints")
    depth, leaves, rest, pairs = 0, [], fps.withColumn("node", F.lit("")), None
    # Pairs of nodes by name ("depth:prefix"), with the bits in which the known parts of their paths differ.
    pairs = fps.sparkSession.createDataFrame([("", "", 0)], "a string, b string, diff int")
    while True:
        depth += STEP
        nodes = durable(rest.withColumn("child", F.concat_ws(":", F.lit(str(depth)), _prefix(F.col("fp"), depth).cast("string")))
                        .groupBy("node", "child", _prefix(F.col("fp"), depth).alias("prefix")).agg(F.count("*").alias("n")), "trie-nodes")
        # Children stand for their parent on either side of a pair; a leaf stands for itself.
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("child").alias(x + "c"), F.col("prefix").alias(x + "p"))
        grown = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        low = F.lit((1 << STEP) - 1).cast("long")
        both = F.col("ac").isNotNull() & F.col("bc").isNotNull()
        bits = F.when(both, F.bit_count((F.col("ap").bitwiseXOR(F.col("bp"))).bitwiseAND(low))).otherwise(F.lit(0))
        grown = grown.select(F.coalesce("ac", "a").alias("x"), F.coalesce("bc", "b").alias("y"), (F.col("diff") + bits).cast("int").alias("diff")).where(F.col("diff") <= budget)
        pairs = durable(grown.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "diff").distinct(), "node-pairs")
        big = nodes.where((F.col("n") > leaf) & F.lit(depth < BITS)).select(F.col("child").alias("node"))
        named = rest.select("fp", F.concat_ws(":", F.lit(str(depth)), _prefix(F.col("fp"), depth).cast("string")).alias("node"))
        if big.isEmpty():
            leaves.append(named)
            break
        leaves.append(named.join(big, "node", "left_anti").select("fp", "node"))
        rest = durable(named.join(big, "node", "left_semi").select("fp", "node"), "crowded")
    held = reduce(DataFrame.unionByName, leaves).groupBy("node").agg(F.collect_list("fp").alias("fps"))
    held = durable(held, "leaves")
    rows = (pairs.join(held.select(F.col("node").alias("a"), F.col("fps").alias("left")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("fps").alias("right")), "b")
            .select(F.when(F.col("a") == F.col("b"), F.lit(None)).otherwise(F.col("right")).alias("right"), "left"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for right, left in zip(frame["right"], frame["left"]):
                own = np.asarray(left, dtype=np.int64).view(np.uint64)
                other = None if right is None else np.asarray(right, dtype=np.int64).view(np.uint64)
                links = leaf_links(own, other, 0, budget)
                if links:
                    yield pd.DataFrame(np.array(links, dtype=np.uint64).view(np.int64), columns=["a", "b"])

    # Pairs of leaves go one by one to any task: few, but each a large piece of work.
    return rows.repartition(max(fps.sparkSession.sparkContext.defaultParallelism * 4, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(walk, "a long, b long")


# ---- components ----------------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): the smallest node of each connected component, for every node that has a link. Large and small
    stars alternate until only stars are left; each step is an aggregation and a join, never a gathered neighbourhood."""
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        # One row per edge, without an aggregation behind the join, so that a star of very many edges is split among tasks.
        large = durable(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large-stars")
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(low, "u")
        moved = durable(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        edges = moved
        # Done when only stars are left: every vertex points to one other, which points to none.
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 AND out > 0").isEmpty():
            break
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 2, leaf: int = 65_536) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over fingerprints that differ in at most ``budget``
    bits); one row per row of docs.

    Null and empty texts have fingerprint zero and link like any other; of repeated ids each row counts; a null id is never the
    smallest, unless a component has no other. Copies meet only as one row per fingerprint, built by partial aggregation."""
    marked = durable(docs.select("doc_id", fingerprint(size)("text").alias("fp")), "marked")
    first = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "first-ids")
    group = durable(components(trie_links(first, budget, leaf)), "groups")
    rooted = durable(first.join(group, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    ids = durable(rooted.join(smallest, "root").select("fp", "component_id"), "component-ids")
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- one document of each group of near copies ---------------------------------------------------------------------------

SHINGLE = 5
#: A shingle that this many texts of the sample have is common; the sample is at least one text in ``SAMPLED``; at most ``COMMON`` are broadcast.
COMMON_FROM, SAMPLED, COMMON = 3, 16, 200_000
#: Shingles of a text that look for its hub.
HEAD = 12
#: Numbers of 64 bits that say of a text's shingles whether an odd number fall on each bit.
PARITY = 8


def _ranks(words: list[bytes]) -> np.ndarray:
    """Distinct five-word shingles as sorted 62-bit hashes."""
    parts = set(shingles(words, SHINGLE))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), dtype=np.uint64, count=len(parts)) >> np.uint64(2)).astype(np.int64)


def _rest(n, similarity: float):
    """How many of a text's n shingles come after its prefix. Two texts of this similarity share a shingle of both prefixes, whatever the
    order of shingles is, as long as it is one order for all."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64) - 1


@F.arrow_udf(T.StringType())
def _digest(text: pa.Array) -> pa.Array:
    """The text's words as one digest."""
    return in_slices(text, 64, lambda part: [xxhash.xxh3_128_hexdigest(b" ".join(w.lower() for w in words_of(t))) for t in part], pa.string())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _all_ranks(text: pa.Array) -> pa.Array:
    return in_slices(text, 64, lambda part: [_ranks([w.lower() for w in words_of(t)]) for t in part], pa.list_(pa.int64()))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts have. They only decide the order of shingles, and so the work, never the result."""
    rate = min(SAMPLED, max(1, docs.count() // 20_000))
    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rate)) == 0).select(F.explode(_all_ranks("text")).alias("sh")).groupBy("sh").count()
    rows = rows.where(F.col("count") >= (COMMON_FROM if rate == SAMPLED else max(COMMON_FROM, 16 // rate))).orderBy(F.col("count").desc(), "sh").limit(COMMON)
    return np.array(sorted(r["sh"] for r in rows.select("sh").collect()), dtype=np.int64)


def _parity(s: np.ndarray) -> np.ndarray:
    """One bit per class of shingles: whether the text has an odd number of them. Two texts differ in at least as many shingles as in bits."""
    odd = np.bincount(s & (PARITY * 64 - 1), minlength=PARITY * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _marks(common: np.ndarray, similarity: float):
    """Column function text -> digest, number of shingles, prefix (the first shingles in the order of hashes, common ones last), fingerprint as
    ``fingerprint()`` has it, and parity bits."""
    def one(t: str | None) -> dict:
        words = [w.lower() for w in words_of(t)]
        s = _ranks(words)
        bits, fp = _parity(s), np.array([majority(shingles(words, 3))], dtype=np.uint64).view(np.int64)[0]
        if len(common) and len(s):
            hot = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
            s = np.concatenate([s[~hot], s[hot] + (1 << 62)])
        return {"node": xxhash.xxh3_128_hexdigest(b" ".join(words)), "n": len(s), "prefix": s[:len(s) - int(_rest(np.array(len(s)), similarity))] if len(s) else s,
                "fp": int(fp), "bits": bits}

    kind = pa.struct([("node", pa.string()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("fp", pa.int64()), ("bits", pa.list_(pa.int64()))])

    @F.arrow_udf("node string, n long, prefix array<long>, fp long, bits array<long>")
    def of(text: pa.Array) -> pa.Array:
        return in_slices(text, 64, lambda part: [one(t) for t in part], kind)
    return of


def _possible(similarity: float) -> Column:
    """Of texts (n_x, bits_x) and (n_y, bits_y): whether they may be this similar, which allows them only so many shingles that one of them lacks."""
    apart = reduce(Column.__add__, [F.bit_count(F.get("bits_x", F.lit(k)).bitwiseXOR(F.get("bits_y", F.lit(k)))) for k in range(PARITY)])
    return apart <= (1 - similarity) / (1 + similarity) * (F.col("n_x") + F.col("n_y")) + 1e-6


def text_similarity(x: str | None, y: str | None) -> float:
    """Share of common five-word shingles among all of both texts; 1 for two texts without words."""
    s, t = (set(shingles([w.lower() for w in words_of(z)], SHINGLE)) for z in (x, y))
    return len(s & t) / len(s | t) if s or t else 1.0


@F.arrow_udf(T.DoubleType())
def shingle_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((text_similarity(a[i].as_py(), b[i].as_py()) for i in range(len(a))), pa.float64(), size=len(a))


def _verified(docs: DataFrame, nodes: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Those of the links (a, b, any more columns) whose whole texts are alike."""
    wanted = durable(links.select(F.col("a").alias("node")).unionAll(links.select("b")).distinct().join(nodes, "node").select("node", F.col("first").alias("doc_id")), "wanted")
    # A text comes with its smallest id; the digest is taken again, as an id may have several texts.
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("doc_id").alias("_first")).distinct(), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").select(_digest("text").alias("node"), "text")
    texts = durable(texts.join(wanted.select("node"), "node").groupBy("node").agg(F.min("text").alias("text")), "linked-texts")
    pairs = links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return durable(pairs.select(*links.columns, shingle_similarity("left", "right").alias("alike")).where(F.col("alike") >= similarity).select(*links.columns), "verified")


def _jump(tree: DataFrame, what: str) -> DataFrame:
    """(node, root) with each root replaced by its own root, if it has one. The rows of one root are split among tasks, as nothing follows the join."""
    up = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return durable(tree.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), what)


def fingerprint_links(nodes: DataFrame, budget: int = 2, leaf: int = 65_536) -> DataFrame:
    """Links (a, b) of keys: every text to the first text of its fingerprint, and the first texts of fingerprints that the trie join links."""
    hubs = durable(nodes.groupBy("fp").agg(F.min("key").alias("hub")), "fingerprint-hubs")
    equal = nodes.select("fp", "key").join(hubs, "fp").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    near = trie_links(hubs, budget, leaf).join(hubs.toDF("a", "x"), "a").join(hubs.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return equal.unionByName(near)


def similar_groups(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes: one row per distinct text (node, key, first, n, prefix, fp, bits). (node, root) for every text with words: texts that pairs of this
    similarity connect have one root.

    Fingerprints come first: the links of the trie join are verified on the whole texts, and their components are the first groups. Pairs of this
    similarity whose fingerprints are further apart, or whose link the trie's forest left to others, are found by an exact way among texts of
    different groups. There each text is first compared with one other: of the texts that share one of the first ``HEAD`` shingles of both
    prefixes, the most central is the shingle's hub, and a text goes to the more central hub that it shares most with; a group goes where most of
    its texts go, and two jumps up bring nearly every group to its top. Then every pair of a shared prefix shingle whose tops differ is counted,
    unless lengths or parity bits rule it out, and verified unless its common prefix shingles and what follows the shorter prefix cannot reach the
    similarity. Components are those of the tops.

    Postings move as two numbers, a shingle's and a text's; what a text brings (length, end of its prefix, root, bits) is joined to those that are left."""
    nodes = nodes.where("n > 0")
    found = fingerprint_links(nodes).withColumn("by_trie", F.lit(True)).unionByName(_stars(nodes, similarity).withColumn("by_trie", F.lit(False)))
    side = lambda k, node, z: nodes.select(F.col("key").alias(k), F.col("node").alias(node), F.col("n").alias("n" + z), F.col("bits").alias("bits" + z))
    found = found.toDF("key_a", "key_b", "by_trie").join(side("key_a", "a", "_x"), "key_a").join(side("key_b", "b", "_y"), "key_b").where(_possible(similarity))
    first = _verified(docs, nodes, durable(found.groupBy("a", "b").agg(F.max("by_trie").alias("by_trie")), "first-links"), similarity)
    group = durable(components(first.where("by_trie").select("a", "b")), "trie-groups")
    ends = first.where("NOT by_trie").join(group.toDF("a", "ra"), "a", "left").join(group.toDF("b", "rb"), "b", "left")
    ends = ends.select(F.coalesce("ra", "a").alias("node"), F.coalesce("rb", "b").alias("up")).where("node <> up").groupBy("node", "up").agg(F.count("*").alias("c"))
    ends = ends.groupBy("node").agg(F.max(F.struct("c", "up")).alias("m")).select("node", F.col("m.up").alias("root"))
    tree = _jump(_jump(durable(ends, "parents"), "parents"), "tops")
    member = group.unionByName(tree.join(group, "node", "left_anti").select("node", F.col("node").alias("root")))
    tree = durable(member.join(tree.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "tops")
    rooted = durable(nodes.select("node", "key", "n", "prefix", "bits").join(tree, "node", "left").select(
        "key", "node", F.col("n").cast("int").alias("n"), F.element_at("prefix", -1).alias("end"), F.coalesce("root", "node").alias("top"), "prefix", "bits"), "roots")
    rooted = rooted.withColumn("root", F.xxhash64("top"))
    # Shingles of several roots, by partial aggregation: a shingle of very many texts is one row a task.
    apart = rooted.select(F.explode("prefix").alias("sh"), "root").groupBy("sh").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    apart = durable(apart.where("low <> high").select("sh"), "apart")
    left = durable(rooted.select("key", F.explode("prefix").alias("sh")).join(apart, "sh", "left_semi"), "postings")
    left = durable(left.join(rooted.select("key", "n", "end", "root", "bits"), "key"), "placed")
    x, y = (left.select("sh", *[F.col(c).alias(c + s) for c in ("key", "n", "end", "root", "bits")]) for s in ("_x", "_y"))
    alike = (F.col("n_x") >= similarity * F.col("n_y") - 1e-6) & (F.col("n_y") >= similarity * F.col("n_x") - 1e-6)
    pairs = x.join(y, (x["sh"] == y["sh"]) & (F.col("key_x") < F.col("key_y")) & (F.col("root_x") != F.col("root_y")) & alike & _possible(similarity))
    pairs = pairs.groupBy("key_x", "key_y", "n_x", "n_y", "end_x", "end_y").agg(F.count("*").alias("c"))
    # Whatever is common and not counted comes after the prefix that ends first.
    rest = F.ceil(similarity * F.when(F.col("end_x") <= F.col("end_y"), F.col("n_x")).otherwise(F.col("n_y")) - 1e-9) - 1
    near = durable(pairs.where(F.col("c") + rest >= similarity / (1 + similarity) * (F.col("n_x") + F.col("n_y")) - 1e-6).select("key_x", "key_y"), "candidates")
    names = rooted.select("key", "node")
    named = near.join(names.toDF("key_x", "a"), "key_x").join(names.toDF("key_y", "b"), "key_y").select("a", "b")
    # A link of the first ones joins two tops only where a text lies deeper than the jumps reach.
    links = _verified(docs, nodes, durable(named, "named"), similarity).unionAll(first.select("a", "b"))
    tops = rooted.select("node", "top")
    crossing = links.join(tops.toDF("a", "top_a"), "a").join(tops.toDF("b", "top_b"), "b").where("top_a <> top_b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
    group = durable(components(crossing).toDF("top", "root"), "groups-of-tops")
    return tops.join(group, "top", "left").select("node", F.coalesce("root", "top").alias("root"))


def _stars(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of a text's key to one more central hub, at most one per text. They only save pairs later, so a few shingles of each text will do."""
    heads = durable(nodes.select("key", "n", F.explode(F.slice("prefix", 1, HEAD)).alias("sh")), "heads")
    # The written counts and hubs let a shingle of very many texts be split among tasks when they are joined back.
    counts = durable(heads.groupBy("sh").agg(F.count("*").alias("many")).where("many > 1"), "counts")
    shared = heads.join(counts, "sh")
    central = shared.groupBy("key").agg(F.sum("many").alias("central"))
    posted = durable(shared.select("sh", "key", "n").join(central, "key"), "posted")
    hubs = durable(posted.groupBy("sh").agg(F.max(F.struct("central", "n", "key")).alias("hub")).select("sh", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    # A shingle's hub is its most central text, so each link goes up in one order and no links form a circle.
    near = posted.join(hubs, "sh").where((F.col("key") != F.col("hub")) & (F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")))
    stars = near.groupBy("key", "hub").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "hub")).alias("m"))
    return durable(stars.select(F.col("key").alias("a"), F.col("m.hub").alias("b")), "stars")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, of which each group of near copies keeps the one with the smallest doc_id.

    Texts of the same words, in order, are one group. Other texts are linked if at least ``similarity`` of their five-word shingles are
    common; groups are the connected components. Candidates come from the trie join over fingerprints, as in ``near_duplicates``; for pairs whose
    fingerprints are too far apart, an exact prefix filter over the shingles, common ones last, follows among texts that the verified links do not
    connect yet: no pair of this similarity is missed.

    Cases: null and empty texts are one group; of repeated rows one stays; a null id goes before all others only if its group has
    no other; an empty table gives an empty table."""
    key = fresh(docs, "_marks")
    marks = _marks(common_shingles(docs), similarity)
    marked = docs.select("doc_id", marks("text").alias("m")).select("doc_id", "m.*")
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "prefix", "fp", "bits")])
    nodes = durable(nodes.withColumn("key", F.xxhash64("node")), "texts")
    group = durable(similar_groups(docs, nodes, similarity), "text-groups")
    rooted = durable(nodes.select("node", "first").join(group, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    stays = durable(rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("n"), "first", "node")).alias("best")).select(F.col("best.node").alias("node"), F.col("best.first").alias("first")), "stays")
    # Words and id as one key, so that repeated rows are already together after the join.
    id_key = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    own = docs.withColumn(key, F.concat(_digest("text"), id_key("doc_id")))
    kept = own.join(stays.select(F.concat("node", id_key("first")).alias(key)), key)
    return kept.dropDuplicates([key]).select(*docs.columns)
