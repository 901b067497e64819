"""Minimum bin slack against an exhaustive search, and the packed pieces against the tokenizer."""
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokens
from tokenizers import Tokenizer

from docweave.llm import bin_slack as P

DATA = "/root/testdata/sf0.001"
VOCABULARY = tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN


def test_fullest_combination():
    rng = random.Random(5)
    for _ in range(200):
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(1, 20), rng.randint(1, 5))}
        capacity = rng.randint(19, 40)
        items = [x for x, c in counts.items() for _ in range(c)]
        best = max(s for n in range(len(items) + 1) for s in map(sum, itertools.combinations(items, n)) if s <= capacity)
        own = P.fullest(counts, capacity)
        assert sum(x * n for x, n in own.items()) == best and all(n <= counts[x] for x, n in own.items())
        assert sum(x * n for x, n in P.fullest(counts, capacity, 3).items()) >= min(best, capacity - 3)


def best_fit_decreasing(histogram, capacity):
    room = []
    for x in sorted((x for x, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(capacity - x)
    return len(room)


def test_bins_hold_everything():
    rng = random.Random(6)
    assert P.combinations({}, 64) == [] and P.shares([]).shape == (0, 5)
    for _ in range(25):
        histogram = dict(Counter(min(64, max(1, int(rng.gauss(rng.choice([8, 20, 40]), 12)))) for _ in range(rng.randint(1, 400))))
        bins = P.combinations(histogram, 64)
        held = Counter()
        for own, times in bins:
            assert times > 0 and sum(x * n for x, n in own.items()) <= 64
            held.update({x: n * times for x, n in own.items()})
        assert held == Counter(histogram)
        assert sum(times for _, times in bins) <= best_fit_decreasing(histogram, 64)


def check(rows, docs, max_len=1024):
    """Pieces are the documents' ids, each of its own length; sequences are filled without gaps."""
    plain = Tokenizer.from_file(VOCABULARY[0])
    plain.encode_special_tokens = True
    want = Counter()
    for doc, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % max_len + 1
        cuts = [0, *range(first, len(ids) + 1, max_len)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= max_len
    return filled


def test_packed_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = P.pack(P.pieces(docs, *VOCABULARY)).collect()
    filled = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(filled) <= best_fit_decreasing(Counter(r["length"] for r in rows), 1024)


def test_packed_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, ""), (None, "a b"), (None, "a b"), (3, " \n" * 3000), (4, "x" * 50_000), (5, "<|endoftext|> word"), (6, "é  ß\U0001f600 1234 don't"), (7, "one two " * 4000)] + [(k, "w " * (k % 50)) for k in range(10, 300)]
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, length int, part_ string")
    for ranks in (VOCABULARY, VOCABULARY[:1]):
        cut = P.pieces(frame, *ranks, max_len=256, with_ids=True)
        packed = P.pack(cut, 256)
        check(packed.collect(), docs, 256)
    texts = Tokenizer.from_file(VOCABULARY[0])
    whole = {r["sequence_id"]: r["ids"] for r in P.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(len(texts.encode(t or "", add_special_tokens=False).ids) if d != 5 else 0 for d, t in docs) + len(docs) + len(P.Encoder(*VOCABULARY).ids(docs[7][1]))
    assert P.pack(P.pieces(frame.limit(0), *VOCABULARY)).count() == 0


def test_both_encoders_agree():
    rng, encoder = random.Random(8), P.Encoder(*VOCABULARY)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", " ", "\n", "1", "é", "ß", "'s", " ", "　", "中", "\U0001f600", "́", "_", "<|endoftext|>", "\x00", "²", "ـ"]) for _ in range(rng.randint(0, 60)))
        assert encoder.ids(t) == encoder.plain(t)
