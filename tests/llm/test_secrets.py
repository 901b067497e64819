"""Spans against Python's re; the battery on made tokens; odd rows."""
import base64
import hashlib
import random
import re

from docweave.llm import secrets_scan as S

DATA = "/root/testdata/sf0.001"
PATTERNS = [re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
FITS = [lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24]


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text or "") if FITS[k](m))
    listed = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in found)
    return [sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(listed.encode()).hexdigest(), listed


def check(rows, texts):
    for r in rows:
        counts, sha, listed = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts, (texts[r["doc_id"]], r)
        assert r["base_sha256"] == sha and set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_base_spans_on_whole_table_and_odd_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(S.digest(S.secret_spans(docs)).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    rng = random.Random(3)
    pieces = ["password", "SECRET", "token", "=", ":", " ", '"', "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\U0001f600", "\x01", "\x02", "\n", "api_key", "ApiKey", "."]
    texts = dict(enumerate([None, "", "secret=token:abcdefgh", "x" * 30, ("token=abcdef " * 3000), *["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(300)]]))
    odd = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, spans string")
    rows = S.digest(S.secret_spans(odd)).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_random_tokens_are_added_and_words_are_not(spark):
    rng = random.Random(5)
    secrets = [base64.urlsafe_b64encode(rng.randbytes(30)).decode().strip("=") for _ in range(60)]
    words = ["keitlichenlichkeitbe", "internationalizationandlocalization", "20260101123456789012345", "z" * 40, "/usr/local/share/documentation/reference", "AbAbAbAbAbAbAbAbAbAbAbAb"] * 20
    texts = [f"see {w} here" for w in secrets + words]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionAll(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: r["spans"] for r in S.digest(S.secret_spans(odd)).collect()}
    flagged = sum(rows[i] == f"random:4:{4 + len(s)}" for i, s in enumerate(secrets))
    assert flagged >= 54
    assert all(not rows[i] for i in range(len(secrets), len(texts)))


def test_empty_table(spark):
    assert S.digest(S.secret_spans(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_limit_is_benjamini_hochberg():
    tokens = [0] * 90 + [20] * 4 + [60] * 6
    order = sorted((2.0 ** (-b / 4) for b in tokens))
    passed = max((k for k, p in enumerate(order, 1) if p <= 0.01 * k / len(order)), default=0)
    limit = S.evidence_limit([(0, 90), (20, 4), (60, 6)], 0.01)
    assert sum(b >= limit for b in tokens) == passed
