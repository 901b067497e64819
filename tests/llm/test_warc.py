"""Round trip, brute-force digests, and damaged archives."""
import hashlib
import random

from docweave.llm import warc as M

DATA = "/root/testdata/sf0.001"


def expected(rows):
    first = {}
    for page, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, html in rows:
        body = (html or "").encode()
        to = first.get(body) if page is not None and first.get(body, page) != page else None
        out.append((str(page), len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", str(to)))
    return sorted(out)


def got(df):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in df.collect())


def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert got(M.round_trip(pages)) == expected([(r["page_id"], r["html"]) for r in pages.collect()])


def test_odd_rows(spark):
    big = "ä" * 200_000 + "\r\n\r\nWARC/1.1\r\n\x1f\x8b"
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (9, "y" * 100), (8, "y" * 100), (8, "y" * 100), (None, "z" * 200), (None, "y" * 100), (5, big), (6, big), (7, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]
    pages = spark.createDataFrame([(p, f"http://a/{i}\r\nX: y", h, "clash") for i, (p, h) in enumerate(rows)], "page_id long, url string, html string, digest string")
    assert got(M.round_trip(pages)) == expected(rows)
    assert M.round_trip(pages.limit(0)).count() == 0


def records(n, seed=1):
    rng = random.Random(seed)
    return [M.record_bytes(i, f"http://x/{i}", b := rng.randbytes(rng.randint(0, 3000)), hashlib.sha256(b).hexdigest(), None, False) for i in range(n)]


def names(data):
    return [r["warc-record-id"] for _, _, r, _ in M.salvage(data) if r]


def test_salvage_recovers_what_is_whole():
    for packed in (False, True):
        parts = [M.member(r) if packed else r for r in records(12)]
        # Cut one short, break one, put noise between two, and end in the middle of a record.
        parts[2] = parts[2][: len(parts[2]) // 2]
        spoiled = bytearray(parts[5])
        spoiled[len(spoiled) // 2] ^= 0xFF
        parts[5] = bytes(spoiled)
        parts.insert(9, b"noise WARC/1.1 \x1f\x8b\x08 more noise")
        parts[-1] = parts[-1][:-20]
        data = b"".join(parts)
        found = names(data)
        assert found == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 6, 7, 8, 9, 10)]
        spans = sorted({(a, n) for a, n, _, _ in M.salvage(data)})
        assert sum(n for _, n in spans) == len(data) and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert all(reason for _, _, r, reason in M.salvage(data) if r is None)


def test_empty_and_mixed_archives():
    a, b = records(2, 4)
    assert list(M.salvage(b"")) == []
    assert [r for _, _, r, _ in M.salvage(b"nothing here")] == [None]
    assert len(names(a + M.member(b))) == 2 and len(names(M.member(a + b))) == 2


def test_gaps_are_rows(spark, tmp_path):
    a, b = records(2, 5)
    (tmp_path / "x.warc").write_bytes(a[:-1] + b)
    rows = sorted(M.read_archives(spark, str(tmp_path)).collect(), key=lambda r: r["offset"])
    assert [r["kind"] for r in rows] == ["gap", "record"] and rows[0]["length"] == len(a) - 1 and rows[0]["reason"]
