"""The split scan against a plain loop: several chunks, null keys, ties of keys in text, both directions."""
import random

from pyspark.sql import functions as F

from docweave.operators import scan as S


def test_chunks_and_null_keys(spark):
    rng = random.Random(6)
    rows = [(k, p * (S.CHUNK // 3), rng.randint(0, 4)) for k in (None, "", "a") for p in range(20)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    out = S.scan(df, ["k"], ["p"], {"total": S.running_sum(F.col("v")), "since": S.count_since(F.col("v") > 1, F.col("v") == 0),
                                     "last": S.last_value(F.when(F.col("v") == 3, F.col("p")), inclusive=False), "top": S.running_max(F.col("v"))})
    want = []
    for key in (None, "", "a"):
        total, since, last, top = 0, 0, None, None
        for _, p, v in sorted(r for r in rows if r[0] == key) if key is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            total += v
            since = 0 if v == 0 else since + (v > 1)
            top = v if top is None else max(top, v)
            want.append((str(key), p, total, since, str(last), top))
            last = p if v == 3 else last
    got = [(str(r["k"]), r["p"], r["total"], r["since"], str(r["last"]), r["top"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
