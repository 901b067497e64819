"""Trie join and components against all pairs."""
import random
import re

import numpy as np
import pytest
import xxhash

from docweave.llm import simhash as M

DATA = "/root/testdata/sf0.001"


def find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def grouped(nodes, links):
    up = {n: n for n in nodes}
    for x, y in links:
        p, q = find(up, x), find(up, y)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {n: find(up, n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    values = np.array(distinct, dtype=np.uint64)
    links = [(distinct[i], distinct[j]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2) if i < j]
    root = grouped(distinct, links)
    smallest = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            smallest[root[f]] = min(d, smallest.get(root[f], d))
    return sorted((str(d), f"{f:016x}", str(smallest.get(root[f]))) for (d, _), f in zip(rows, fps))


def ours(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("leaf", [65_536, 8])
def test_documents_against_all_pairs(spark, leaf):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ours(M.near_duplicates(docs, leaf=leaf)) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(300)]
    rows = [(5, None), (4, ""), (9, " \n"), (5, "One two"), (5, "one TWO"), (None, "one two"), (7, "É é"), (8, "x" * 300_000)]
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(300)] = f"w{i % 7}"
        rows.append((100 + i, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, fp string")
    assert ours(M.near_duplicates(docs, leaf=4)) == brute(rows)
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_leaf_pairs_keep_every_component():
    rng = np.random.default_rng(1)
    for direct in (1, 16, 256):
        M.DIRECT = direct
        values = []
        for b in rng.integers(0, 2**64, size=20, dtype=np.uint64):
            for _ in range(30):
                x = int(b)
                for k in rng.integers(0, 64, size=rng.integers(0, 4)):
                    x ^= 1 << int(k)
                values.append(x)
        v = np.unique(np.array(values, dtype=np.uint64))
        want = grouped(v.tolist(), [(int(a), int(b)) for i, a in enumerate(v) for b in v[i + 1:] if int(a ^ b).bit_count() <= 2])
        p, h = rng.permutation(v), len(v) // 2
        got = M.leaf_links(p[:h], None, 0, 2) + M.leaf_links(p[h:], None, 0, 2) + M.leaf_links(p[:h], p[h:], 0, 2)
        assert grouped(v.tolist(), got) == want


def test_components_of_a_long_chain(spark):
    chain = list(range(200))
    random.Random(2).shuffle(chain)
    links = spark.createDataFrame(list(zip(chain, chain[1:])) + [(900, 901)], "a long, b long")
    got = {r["node"]: r["root"] for r in M.components(links).collect()}
    assert got == {**{n: 0 for n in chain}, 900: 900, 901: 900}


def test_near_copies_go_through_the_trie(spark, monkeypatch):
    """The pipeline's groups start from the trie join of fingerprints, in which only whole-text checks take links away."""
    rng, calls, join = random.Random(21), [], M.trie_links
    own = [f"w{rng.randrange(9000)}" for _ in range(800)]
    edited = (" ".join(own[:300 + k] + ["new"] + own[300 + k:]) for k in range(400))
    edited = next(t for t in edited if 0 < (plain_fingerprint(t) ^ plain_fingerprint(" ".join(own))).bit_count() <= 2)
    texts = [" ".join(own), edited, " ".join(rng.sample(own, 800)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def spy(fps, *more):
        out = join(fps, *more).collect()
        calls.append(({r["fp"] for r in fps.collect()}, {frozenset((r["a"], r["b"])) for r in out}))
        return spark.createDataFrame(out, "a long, b long")

    monkeypatch.setattr(M, "trie_links", spy)
    assert {r["doc_id"] for r in M.drop_near_duplicates(docs).collect()} == {0, 2, 3}
    fps = np.array([plain_fingerprint(t) for t in texts[:3]], dtype=np.uint64).view(np.int64).tolist()
    assert calls[0][0] == set(fps) and calls[0][1] == {frozenset(fps[:2])} and len(calls) == 1


def test_parity_bits_only_rule_out_what_is_unlike(spark):
    """Texts that share a passage are no pair before they are counted; pairs at the limit stay."""
    rng = random.Random(22)
    rows, alike = [], []
    passage = [f"p{i}" for i in range(60)]
    for k in range(40):
        own = passage + [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 900))]
        cut = list(own) if k % 2 else [f"w{rng.randrange(5000)}" for _ in own]
        for _ in range(len(own) // 60 if k % 2 else 0):
            cut[rng.randrange(len(cut))] = "new"
        sets = [M._ranks([w.encode() for w in x]) for x in (own, passage + cut[60:])]
        both = len(np.intersect1d(*sets))
        alike.append(both / (len(sets[0]) + len(sets[1]) - both) >= 0.8)
        rows.append((k, *(len(s) for s in sets), *(M._parity(s).tolist() for s in sets)))
    got = {r["k"] for r in spark.createDataFrame(rows, "k long, n_x long, n_y long, bits_x array<long>, bits_y array<long>").where(M._possible(0.8)).collect()}
    assert {k for k, a in enumerate(alike) if a} <= got and any(alike)
    assert not got & {k for k in range(0, 40, 2)}
