"""Periodic runs against a scan of every period, and their digests against plain Python."""
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from docweave.llm import periodic_runs as P

DATA = "/root/testdata/sf0.001"


def plain(w, min_words=24, min_periods=3):
    """Stretches of equal distance q, the smallest q of each stretch first."""
    n, out = len(w), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(min_words, min_periods * q):
                    out.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def words(rng, alphabet, parts):
    out = []
    for _ in range(parts):
        unit = [rng.randrange(alphabet) for _ in range(rng.randint(1, 15))]
        out += (unit * rng.randint(1, 9))[:rng.randint(1, 100)] if rng.random() < 0.6 else [rng.randrange(alphabet) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.1:
            out *= 2
    return out[:500]


def test_runs_equal_every_period(monkeypatch):
    rng, seen = random.Random(1), 0
    for turn in range(150):
        if turn == 100:
            monkeypatch.setattr(P, "PAIRS", 7)
        texts = [words(rng, rng.choice([1, 2, 3, 30]), rng.randint(0, 7)) for _ in range(rng.randint(1, 5))]
        want = [plain(t) for t in texts]
        assert P.find_runs([np.array(t, dtype=np.int64) for t in texts]) == want
        seen += sum(map(len, want))
    assert seen > 300
    for min_words, min_periods in ((1, 2), (10, 2), (6, 4)):
        t = words(rng, 2, 6)
        assert P.find_runs([np.array(t, dtype=np.int64)], min_words, min_periods) == [plain(t, min_words, min_periods)]


def test_grammar_answers_extensions():
    rng = random.Random(2)
    for _ in range(40):
        t = words(rng, rng.choice([1, 2, 5]), 5) or [0]
        g = P.Grammar(np.array([90, *t, 91]))
        i, j = zip(*[(a, b) for a in range(1, len(t) + 1) for b in range(a + 1, len(t) + 1, 7)] or [(1, len(t) + 1)])
        s = [90, *t, 91]

        def equal(a, b, step):
            n = 0
            while s[a] == s[b] and 0 < a < len(s) - 1 and 0 < b < len(s) - 1:
                a, b, n = a + step, b + step, n + 1
            return n

        assert g.agree(np.array(i), np.array(j)).tolist() == [equal(a, b, 1) for a, b in zip(i, j)]
        assert g.agree(np.array(i), np.array(j), True).tolist() == [equal(a, b, -1) for a, b in zip(i, j)]


def plain_digest(doc, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_digests(spark):
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    odd = [(None, "a " * 40), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "x\x0b" * 30), (1004, "é b " * 25), (1005, "w" * 300_000), (1005, "w" * 300_000)]
    odd += [(2000 + i, " ".join(map(str, words(rng, 3, 6)))) for i in range(60)]
    rows = docs + odd
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_words int, runs string")
    got = [tuple(r) for r in P.digest(P.periodic_runs(P.planted(frame))).collect()]
    want = [plain_digest(d, t) for d, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[2] for r in want) > 100
    assert P.digest(P.periodic_runs(P.planted(frame.limit(0)))).count() == 0
    full = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in P.periodic_runs(frame).collect()}
    assert full[None][1] == "a" and full[1000] == ([], None) and full[1003][1] == "x"
