"""Line dedup, packing, decontamination and the pipeline against plain Python."""
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from docweave.llm import decontaminate as D
from docweave.llm import line_dedup as L
from docweave.llm import packing as K
from docweave.llm import simhash as S

DATA = "/root/testdata/sf0.001"
SPACES = r"[\x20\x09-\x0D]+"


def plain_lines(rows, min_sites=3, long_words=50, long_sites=2):
    """rows: (doc_id, text, source) with different ids."""
    sites, first, size = defaultdict(set), {}, {}
    places = []
    for doc, text, source in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for pos, raw in enumerate([] if text is None else text.split("\n")):
            line = re.sub(SPACES, " ", raw).strip(" ").lower()
            if line:
                sites[line].add(source)
                first.setdefault(line, (doc, pos))
                places.append((doc, pos, line))
                size[line] = line.count(" ") + 1
    gone = {(d, p) for d, p, line in places if first[line] != (d, p) and len(sites[line]) >= (long_sites if size[line] >= long_words else min_sites)}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t, _ in rows}


def test_lines_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_lines([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    out = L.without_boilerplate(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_line_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{passage}\nOne  line\nown", "a"), (2, f"x\n{passage.upper()}", "b"), (3, "one line\n\n \nother", "b"), (4, "ONE LINE ", None), (5, None, "c"), (6, "", "c"), (7, "z" * 200_000, "c"),
            (None, "one line\nlast", "d"), (8, "x\nx", "b"), (9, "é" * 9, "a"), (10, "É" * 9, "b"), (11, "é" * 9, "c")]
    docs = spark.createDataFrame([(d, t, s, "k", 5, 7) for d, t, s in rows], "doc_id long, text string, source string, line string, sites int, places int")
    out = L.without_boilerplate(docs)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == plain_lines(rows)
    twice = docs.unionAll(docs)
    texts = Counter((r["doc_id"], r["text"]) for r in L.without_boilerplate(twice).collect())
    assert texts == Counter({k: 2 for k in plain_lines(rows).items()})
    assert L.without_boilerplate(docs.limit(0)).count() == 0


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        histogram = {x: rng.randint(1, 20) for x in rng.sample(range(1, 40), rng.randint(1, 9))}
        lengths, k = sorted(histogram), rng.randint(1, 4)

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= x) - x) for x, c in histogram.items())

        best = min(padding((*inner, lengths[-1])) for n in range(k) for inner in itertools.combinations(lengths[:-1], n))
        ends = K.boundaries(histogram, k)
        assert len(ends) <= k and ends[-1] == lengths[-1] and padding(ends) == best
    assert K.boundaries({}, 4) == []


def check_packing(rows, texts, max_len, budget):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc, text in texts.items():
        own, n = sorted(by_doc.pop(doc), key=lambda r: r["chunk"]), len((text or "").encode().split())
        assert [r["start"] for r in own] == list(range(0, max(n, 1), max_len)) and sum(r["n_tokens"] for r in own) == n
    assert not by_doc
    batches = defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            assert r["padding"] == r["bucket"] - r["n_tokens"] >= 0
            batches[r["bucket"], r["batch"]].append(r["slot"])
        else:
            assert r["bucket"] is None and r["batch"] is None
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * bucket <= max(budget, bucket)
        if (bucket, batch + 1) in batches:
            assert len(slots) == max(1, budget // bucket)


def test_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packing(K.pack(docs, max_len=256, buckets=5, token_budget=2048, shard=16).collect(), texts, 256, 2048)
    odd = {1: None, 2: "", 3: "a " * 5000, 4: "b", 5: "c d", 6: " \n"}
    frame = spark.createDataFrame([(d, t, 1) for d, t in odd.items()], "doc_id long, text string, bucket int")
    check_packing(K.pack(frame, max_len=256).collect(), odd, 256, 65_536)
    assert K.pack(frame.limit(0)).count() == 0
    assert K.pack(frame.unionAll(frame)).count() == 2 * K.pack(frame).count()


def test_tokenizer_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = "/opt/tokenizers/byte_bpe_50k.json"
    docs = spark.createDataFrame([(1, "Hello there, world"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["n_tokens"] for r in K.pack(docs, K.bpe_count(path)).collect()}
    assert rows == {1: len(tokenizers.Tokenizer.from_file(path).encode("Hello there, world").ids), 2: 0}


def plain_matches(text, items, radius=15, least=0.8):
    """All windows of an item's length against it."""
    words, out = D.tokens(text), {}
    for item, own in items:
        target = D.tokens(own)
        if not target:
            continue
        size, n = min(5, len(target)), len(target)
        cut = lambda w: Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
        fp = lambda w: int(D._packed(D._bits(D.hashes(w, size)).sum(axis=0)[None], len(w) - size + 1)[0])
        a = cut(target)
        for i in range(len(words) - n + 1):
            b = cut(words[i:i + n])
            common = (a & b).total()
            if common and (fp(target) ^ fp(words[i:i + n])).bit_count() <= radius and common / (a | b).total() >= least:
                out[item] = max(out.get(item, 0), common / (a | b).total())
    return out


def test_decontamination_against_all_windows(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + rng.choice("12345")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 8, 20, 40, 60])))) for k in range(12)] + [(50, None), (51, ""), (52, "same words here again and again"), (53, "same words here again and again")]
    texts = [None, "", "x"]
    for _ in range(60):
        own = D.tokens(rng.choice(items)[1]) or [b"y"]
        own = [w.decode() for w in own]
        for _ in range(rng.randint(0, 2)):
            own[rng.choice([0, -1, rng.randrange(len(own))])] = word()
        texts.append(" ".join(word() for _ in range(30)) + ", " + " ".join(own).upper() + ". " + " ".join(word() for _ in range(30)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, m string")
    want = {(i, k): round(s, 9) for i, t in enumerate(texts) for k, s in plain_matches(t, items).items()}
    for block in (200_000, 20):
        assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in D.contaminated(docs, bench, block=block).collect()} == want
        left = {r["doc_id"] for r in D.without_contaminated(docs, bench, block=block).collect()}
        assert left == set(range(len(texts))) - {d for d, _ in want}
    assert want and D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0


def test_documents_that_are_shortened_items(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(n))) for k, n in enumerate((59, 50, 40, 30))]
    texts = {}
    for k, text in items:
        own = text.split()
        for j, cut in enumerate((own[:-1], own[1:], own[:-3], own[2:-1], own[:len(own) // 2])):
            texts[10 * k + j] = " ".join(cut)
    docs, bench = (spark.createDataFrame(rows, f"{c} long, text string") for rows, c in ((list(texts.items()), "doc_id"), (items, "item_id")))
    found = {r["doc_id"]: r for r in D.contaminated(docs, bench).collect()}
    assert set(found) == {d for d in texts if d % 10 < 4}
    for d, r in found.items():
        n, m = len(items[d // 10][1].split()) - 4, len(texts[d].split()) - 4
        assert (r["item_id"], r["start"], r["stop"]) == (d // 10, 0, m + 4) and r["similarity"] == pytest.approx(m / n)
    assert {r["doc_id"] for r in D.without_contaminated(docs, bench).collect()} == {d for d in texts if d % 10 == 4}


def test_index_finds_every_item_within_the_radius():
    rng = np.random.default_rng(2)
    items = D.Items([(k, " ".join(map(str, rng.integers(0, 50, 12)))) for k in range(300)])
    for fp in [int(x) for x in rng.integers(0, 2**64, 20, dtype=np.uint64)] + [items.items[3][1] ^ 0b1011]:
        assert {k for k, _ in items.near((5, 12), fp, 15)} == {k for k, x in enumerate(items.items) if (x[1] ^ fp).bit_count() <= 15}


def test_near_copies_leave_one(spark):
    rng = random.Random(4)
    base = [[f"{rng.choice('abcdefghij')}{rng.randint(0, 400)}" for _ in range(400)] for _ in range(8)]
    rows, copy_of = [], {}
    for i in range(64):
        words = list(base[i % 8])
        if i >= 16:
            words[rng.randrange(400)] = f"new{i}"
        rows.append((1000 - i, " ".join(words).upper() if i % 3 else " ".join(words)))
        copy_of[1000 - i] = i % 8
    rows += [(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "alone"), (4, "short text"), (4, "short text"), (5, "short TEXT"), (6, "another short text")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, node string")
    out = S.drop_near_duplicates(docs)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == len(set(kept))
    groups = Counter(copy_of[d] for d in kept if d in copy_of)
    assert set(groups) == set(range(8)) and sum(groups.values()) <= 9
    assert sorted((d for d in kept if d not in copy_of), key=str) == [1, 4, 6, None]
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0


def alike(x, y):
    s, t = (set(S.shingles(z.encode().lower().split(), 5)) for z in (x, y))
    return len(s & t) / len(s | t)


def kept_by_all_pairs(texts):
    """Smallest id of each group over all pairs of similarity 0.8 or more."""
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(texts[i], texts[j]) >= 0.8:
            p, q = top(i), top(j)
            up[max(p, q)] = min(p, q)
    return {i for i in range(len(texts)) if top(i) == i}


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in S.drop_near_duplicates(docs).collect()}


def test_star_groups_of_edited_copies(spark):
    """Copies edited independently are alike to their original, not to each other."""
    rng, texts = random.Random(11), []
    for _ in range(3):
        own = [f"w{rng.randrange(3000)}" for _ in range(400)]
        texts += [" ".join(rng.choice(own) if rng.random() < 1 / 80 else w for w in own) for _ in range(40)]
        texts.append(" ".join(own))
    want = kept_by_all_pairs(texts)
    assert len(want) < 10 and kept(spark, texts) == want


def test_shortened_and_lengthened_copies(spark):
    """Copies that lack or add up to 15 % of the words are far apart as fingerprints, but alike."""
    rng, texts = random.Random(12), []
    for k in range(30):
        own = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 500))]
        cut = len(own) * (85 + k % 3 * 5) // 100
        texts += [" ".join(own), " ".join(own[:cut]), " ".join(own[len(own) - cut:]), " ".join(own + [f"n{i}" for i in range(len(own) // 8)])]
    want = kept_by_all_pairs(texts)
    assert kept(spark, texts) == want and len(want) <= 35


def test_pipeline_stages(spark):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        out = P.durable(stage(spark, docs, DATA), "t")
        assert out.columns == docs.columns, name
        assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        kept.append(out.count())
        docs = out
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] > 0 and kept[0] == kept[1]
    check_packing(P.STAGES[-1][1](spark, docs, DATA).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, 2048, 65_536)
