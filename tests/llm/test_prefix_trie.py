"""The prefix trie against a trie built from the rebuilt turns themselves."""
import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from docweave.llm import prefix_trie as P
from docweave.llm.queries import hundreds

DATA = "/root/testdata/sf0.001"


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    new = {}
    for c, turns in own.items():
        base = c - int(abs(c) % 100 * (1 if c > 0 else -1)) if rebuild else c
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        new[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    kids = defaultdict(set)
    for key in members:
        if key:
            kids[key[:-1]].add(key)
    out = set()
    below = {}
    for key in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in kids[key]) or 1
        saved = sum(below[k][1] for k in kids[key]) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
        below[key] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[key] if len(new[c]) == len(key))))
        out.add((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(kids[key]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(frame):
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, member string")


def test_trie_of_conversations(spark):
    data = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in data.collect()]
    assert rows_of(P.prefix_trie(data, *hundreds())) == plain(rows)


def test_shared_heads_and_odd_rows(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(100, 160), 205, 999, -5, -300, -301, 70_000]:
        for turn in range(rng.choice([0, 1, 2, 5, 8, 9])):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["u", "a", None, ""]), rng.choice(["x", "yy", None, "", "é" * 3])))
    rows += [(400, t, "u", "same") for t in range(50)] + [(401, t, "u", "same") for t in range(50)] + [(402, None, None, None)] * 40 + [(None, 1, "u", "lost"), (500, 1, "u", "z" * 200_000), (501, 1, "u", "z" * 200_000)]
    rows += rows[:30]
    got = frame(spark, rows)
    assert rows_of(P.prefix_trie(got, *hundreds())) == plain(rows)
    # A modulus of three makes prefixes collide; the comparison of turns finds out and the next one is taken.
    assert P.differing(P.grouped(P.rebuilt(P.prefixes(P.ordered_turns(got), 3, 0), *hundreds(), 3, 0)[1]), P.ordered_turns(got)) > 0
    assert rows_of(P.prefix_trie(got, primes=(3, P.PRIME))) == plain(rows, rebuild=False)


def test_trie_of_nothing(spark):
    empty = frame(spark, [(1, 1, "u", "x")]).limit(0)
    out = P.prefix_trie(empty, *hundreds())
    assert out.columns[:2] == ["conv_id", "depth"] and out.count() == 0
    only = rows_of(P.prefix_trie(frame(spark, [(7, 0, "u", "x")]), hundreds()[0], F.lit(5), 5))
    assert only == {(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())}


def test_long_conversation_over_partitions(spark):
    """One conversation holds almost all rows; its prefix sums cross partitions."""
    rows = [(1, t, "u", f"t{t % 7}") for t in range(3000)] + [(c, t, "u", f"t{t % 7}") for c in range(2, 9) for t in range(c * 20)] + [(9, t, "u", f"t{t % 5}") for t in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = P.ordered_turns(frame(spark, rows).repartition(8))
        assert turns.where("conv_id = 1").select("part_").distinct().count() > 1
        assert rows_of(P.prefix_trie(frame(spark, rows))) == plain(rows, rebuild=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
