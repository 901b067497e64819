"""Trie of conversation prefixes, by fingerprints that compose.

A sequence of turns has the fingerprint (number of turns, sum of t_i * w^i modulo a prime), four times over with different w. Fingerprints form a monoid: (m, x) followed by
(n, y) is (m + n, x + w^m * y), and what follows the first m turns of (n, y) is w^-m * (y - x). So the prefixes of a conversation that takes over the head of another and goes on
with its own turns come from stored prefixes of both; no text is put together. Prefixes of equal length and fingerprint are one node of the trie, named by its smallest
member and its depth. Every prefix keeps the reference of its last turn; where references of one node differ, the texts behind them are compared, and if
any two differ all is done again with other weights. Equal last turns at every depth make equal prefixes, so nodes are exact.

Sums over subtrees need no walk. A member that is not the smallest of its node is so down to the depth where it parts from all smaller ones; from there on its nodes are its
own. With ``part`` the characters of a member up to there, the characters of all members below a node less those of all distinct nodes below it are the sum of
``part - before`` over its other members, where ``before`` are the characters above the node. Leaves are counted by the conversations that own them.

Turns are ordered by one range exchange whose last key is random, and running sums are taken inside its partitions and moved on, so a conversation of any length, or with any number
of equal turns, is spread over tasks. Ids that end in a node are hashed in order as a stream of short joined stretches.

Cases: null turns come first, equal ones in the order of role and text; null roles and texts are empty; rows without conv_id are left out; repeated rows are repeated turns; further columns are left out,
whatever their names; very long texts are hashed and compared as they are; an empty table gives no row, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable

PRIME = (1 << 31) - 1
LANES = 4
G = [f"g{k}" for k in range(LANES)]
#: Ids that are joined before they are hashed.
STRETCH = 1024


def _power(base: int, exponent: np.ndarray, prime: int) -> np.ndarray:
    out, e, b = np.ones(len(exponent), dtype=np.int64), exponent % (prime - 1), base % prime
    while e.any():
        out = np.where(e & 1, out * b % prime, out)
        e, b = e >> 1, b * b % prime
    return out


def _mover(prime: int, attempt: int):
    """Column function (n, x0..x3) -> w^n * x modulo the prime, for any whole n."""
    weights = np.random.default_rng(attempt).integers(2, 1 << 31, LANES).tolist() if prime > 100 else [prime - 1] * LANES

    @F.pandas_udf("struct<g0:long,g1:long,g2:long,g3:long>")
    def move(n: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        places = n.to_numpy().astype(np.int64)
        return pd.DataFrame({g: _power(w, places, prime) * x.to_numpy().astype(np.int64) % prime for g, w, x in zip(G, weights, (a, b, c, d))})

    return lambda n, xs: move(n, *xs)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, row_ (a number that grows in the order of turns), part_ (the stretch of rows it was numbered in), written."""
    own = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie_"]
    rows = own.withColumn("tie_", F.rand(3)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return durable(rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("row_")).withColumn("part_", F.shiftright("row_", 33)), "turns")


def prefixes(turns: DataFrame, prime: int, attempt: int) -> DataFrame:
    """conv_id, pos (from 1), g0..g3 and total (characters) of the prefix up to pos, chars and row_ of its last turn."""
    move = _mover(prime, attempt)
    h = [F.xxhash64(F.lit(2 * attempt + k), "role", "text") for k in (0, 1)]
    lanes = [F.pmod(x, F.lit(prime)) for k in (0, 1) for x in (h[k].bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h[k], 33))]
    base = turns.select("conv_id", "part_", "row_", F.length("text").cast("long").alias("chars"), *[x.alias(g) for g, x in zip(G, lanes)])
    w = W.partitionBy("conv_id", "part_").orderBy("row_")
    rows = base.withColumn("k", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("m", move(F.col("k"), G)).select("conv_id", "part_", "row_", "chars", "k", *[F.col(f"m.{g}").alias(g) for g in G])
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumns({**{g: F.sum(g).over(upto) % prime for g in G}, "total": F.sum("chars").over(upto)})
    # What the parts of a conversation carry: their turns, characters and, moved to their place, their sums.
    parts = local.groupBy("conv_id", "part_").agg(F.max("k").alias("n"), F.max("total").alias("chars_"), F.max_by(F.struct(*G), "k").alias("s"))
    before = W.partitionBy("conv_id").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"n_": F.coalesce(F.sum("n").over(before), F.lit(0)), "c_": F.coalesce(F.sum("chars_").over(before), F.lit(0))})
    parts = parts.withColumn("s", move(F.col("n_"), [F.col(f"s.{g}") for g in G]))
    parts = parts.select("conv_id", "part_", "n_", "c_", *[(F.coalesce(F.sum(f"s.{g}").over(before), F.lit(0)) % prime).alias(f"{g}_") for g in G])
    out = local.join(parts, ["conv_id", "part_"]).withColumn("m", move(F.col("n_"), G))
    return durable(out.select("conv_id", (F.col("k") + F.col("n_")).alias("pos"), *[((F.col(f"m.{g}") + F.col(f"{g}_")) % prime).alias(g) for g in G],
                              (F.col("total") + F.col("c_")).alias("total"), "chars", "row_"), "prefixes")


def rebuilt(own: DataFrame, base: Column, head: Column, max_head: int, prime: int, attempt: int) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt length, their prefixes): member, depth, g0..g3, total, chars, row_."""
    move = _mover(prime, attempt)
    entry = F.struct("pos", *G, "total", "chars", "row_")
    stored = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") <= max_head, entry))).alias("first"))
    stored = durable(stored, "heads")
    bases = stored.select(F.col("conv_id").alias("base_"), F.col("n").alias("n_base"), F.col("first").alias("first_base"))
    convs = stored.withColumns({"base_": base, "h": F.least(head, F.lit(max_head)).cast("long")}).join(bases, "base_", "left")
    convs = convs.withColumn("hb", F.least("h", F.coalesce("n_base", F.lit(0))))
    at = lambda array, k: F.get(array, (F.col(k) - 1).cast("int"))
    convs = convs.select("conv_id", "h", "hb", (F.col("hb") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"), F.slice(F.coalesce("first_base", F.array().cast(stored.schema["first"].dataType)), F.lit(1), F.col("hb").cast("int")).alias("taken"),
                         at("first_base", "hb").alias("a"), at("first", "h").alias("b"))
    convs = durable(convs, "rebuilt")
    heads = convs.select(F.col("conv_id").alias("member"), F.inline("taken")).withColumnRenamed("pos", "depth")
    tail = own.join(convs.select("conv_id", "h", "hb", "a", "b"), "conv_id").where("pos > h")
    zero = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(0))
    # Own sum after the first h turns, moved from place h to place hb, behind the sum of the head that was taken over.
    tail = tail.withColumn("m", move(F.col("hb") - F.col("h"), [(F.col(g) - zero("b", g) + prime) % prime for g in G]))
    tail = tail.select(F.col("conv_id").alias("member"), (F.col("hb") + F.col("pos") - F.col("h")).alias("depth"), *[((F.col(f"m.{g}") + zero("a", g)) % prime).alias(g) for g in G],
                       (zero("a", "total") + F.col("total") - zero("b", "total")).alias("total"), "chars", "row_")
    return convs.select("conv_id", "length"), durable(heads.select(*tail.columns).unionByName(tail), "members")


def grouped(members: DataFrame) -> DataFrame:
    """member, depth, total, chars, row_, owner (smallest member of the node), n_convs and whether the node has several references."""
    nodes = durable(members.groupBy("depth", *G).agg(F.min("member").alias("owner"), F.count("*").alias("n_convs"), (F.min("row_") != F.max("row_")).alias("several")), "nodes")
    return durable(members.join(nodes, ["depth", *G]).select("member", "depth", "total", "chars", "row_", "owner", "n_convs", "several"), "placed")


def differing(placed: DataFrame, turns: DataFrame) -> int:
    """Number of nodes whose members do not all end in the same role and text."""
    refs = placed.where("several").select("owner", "depth", "row_").distinct()
    ends = refs.join(turns.select("row_", F.struct("role", "text").alias("turn")), "row_").groupBy("owner", "depth")
    return ends.agg(F.min("turn").alias("low"), F.max("turn").alias("high")).where("low <> high").count()


def hashed_ids(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 from (conv_id, depth, member): the ids in order, joined by commas."""
    stretches = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / STRETCH).alias("stretch")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def out():
            rows = list(zip(*done)) or [(), (), ()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if key != (conv, depth):
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out()
        if key:
            done.append((*key, state.hexdigest()))
        yield out()

    return stretches.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "stretch").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, max_head: int = 0, primes: tuple[int, ...] = (PRIME,) * 4) -> DataFrame:
    """One row per node (conv_id, depth): parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``base`` and ``head`` are columns over conv_id: each
    conversation takes over the first ``head`` turns, ``max_head`` at most, of conversation ``base`` and goes on with its own turns after as many. conv_id is a whole
    number. ``primes`` are the moduli of one attempt after the other."""
    spark = conversations.sparkSession
    turns = ordered_turns(conversations.withColumn("conv_id", F.col("conv_id").cast("long")))
    base, head = F.col("conv_id") if base is None else base, F.lit(0) if head is None else head
    for attempt, prime in enumerate(primes):
        convs, members = rebuilt(prefixes(turns, prime, attempt), base, head, max_head, prime, attempt)
        placed = grouped(members)
        if not differing(placed, turns):
            break
    else:
        raise ValueError("prefixes with equal fingerprints differ under every weight")
    top = convs.agg(F.min("conv_id")).first()[0]
    if top is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    # Per conversation: the depth from which it owns its nodes, the owner of the node above, the characters up to there.
    other = placed.where("owner <> member")
    shared = other.groupBy("member").agg(F.max("depth").alias("last"), F.max_by("owner", "depth").alias("above"), F.max("total").alias("part"))
    is_top = F.col("conv_id") == top
    each = convs.join(shared.withColumnRenamed("member", "conv_id"), "conv_id", "left").select(
        "conv_id", "length", F.when(is_top, 0).otherwise(F.coalesce("last", F.lit(0)) + 1).cast("long").alias("from"),
        F.when(~is_top, F.coalesce("above", F.lit(top))).alias("above"), F.coalesce("part", F.lit(0)).alias("part"))
    each = durable(each, "each")
    kids = each.where(F.col("from") <= F.col("length")).where(~is_top).groupBy(F.col("above").alias("conv_id"), (F.col("from") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    kids = durable(kids, "kids")
    childless = each.where(F.col("from") <= F.col("length")).select("conv_id", F.col("length").alias("depth")).join(kids, ["conv_id", "depth"], "left_anti")
    each = durable(each.join(childless.select("conv_id", F.lit(1).alias("leaf")), "conv_id", "left").fillna(0, "leaf"), "each-leaf")

    sums = other.select("member", "owner", "depth").join(each.select(F.col("conv_id").alias("member"), "part", "leaf"), "member")
    sums = sums.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("part").alias("parts"), F.sum("leaf").alias("leaves"))
    nodes = placed.where("owner = member").select(F.col("member").alias("conv_id"), "depth", "n_convs", (F.col("total") - F.col("chars")).alias("before"))
    nodes = nodes.join(sums, ["conv_id", "depth"], "left").fillna(0, ["parts", "leaves"])
    root = each.agg(F.count("*").alias("n_convs"), F.coalesce(F.sum(F.when(~is_top, F.col("part"))), F.lit(0)).alias("parts"), F.coalesce(F.sum(F.when(~is_top, F.col("leaf"))), F.lit(0)).alias("leaves"))
    root = root.select(F.lit(top).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("before"), "parts", "leaves")
    ends = each.select(F.when(F.col("from") <= F.col("length"), F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    out = nodes.unionByName(root).join(each, "conv_id").join(kids, ["conv_id", "depth"], "left").join(hashed_ids(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("above"))).alias("parent_conv_id"), "n_convs",
        (F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"), (F.col("leaves") + F.col("leaf")).cast("long").alias("n_leaves"),
        (F.col("parts") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
