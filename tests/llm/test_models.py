"""Quality voting, toxicity, rules and licences: held-out rows, brute force, odd rows, and the DuckDB texts."""
import zlib

import duckdb
import numpy as np
import pytest

from docweave.llm import licenses as C
from docweave.llm import quality_knn as Q
from docweave.llm import quality_rules as R
from docweave.llm import toxicity_fm as T
from docweave.llm.common import crc_rest
from docweave.llm.queries import ORACLES, QUERIES

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held_out(spark, name, column, divisor, rest):
    rows = QUERIES[name](spark, DATA).collect()
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest) and 0 <= r["score"] <= 1 for r in rows)
    return [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def rank_share(pairs):
    good, bad = [s for s, y, _ in pairs if y], [s for s, y, _ in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_on_held_out_rows(spark):
    pairs = held_out(spark, "op5_quality_knn", "quality", 3, 1)
    assert rank_share(pairs) > 0.95 and np.mean([p == y for _, y, p in pairs]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    pairs = held_out(spark, "op7_toxicity_fm", "toxic", 4, 2)
    assert rank_share(pairs) > 0.75 and not any(p and not y for _, y, p in pairs)


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    rows = [{int(k): float(rng.integers(1, 5)) for k in rng.integers(0, Q.STRUCTURE + Q.WORDS, 20)} for _ in range(80)]
    labels = rng.integers(0, 2, 60).tolist()
    voters = Q.fit(rows[:60], labels, rank=10, neighbours=7)
    own = Q.weigh(rows[60:], voters.idf) @ voters.projection
    for x, got in zip(own, voters.score(rows[60:])):
        alike = sorted(((float(x @ v / max(np.linalg.norm(x), 1e-12)), y) for v, y in zip(voters.vectors, labels)), reverse=True)[:7]
        weights = [max(s, 0) ** 4 for s, _ in alike]
        assert got == pytest.approx(sum(w * y for w, (_, y) in zip(weights, alike)) / sum(weights), abs=1e-4)


def test_machine_learns_pairs():
    """Neither of two terms alone is toxic; both together are."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.unique(np.concatenate([[10] * a, [20] * b, rng.integers(1000, 9000, 10)])).astype(np.int64))
        labels.append(int(a and b))
    machine = T.fit(rows, labels, epochs=60)
    alone, both = machine.score([np.array([10]), np.array([20]), np.array([10, 20])])[:2], machine.score([np.array([10, 20])])[0]
    assert both > 0.5 > max(alone)
    assert float(machine.vectors[10] @ machine.vectors[20]) > 0
    text = machine.score([np.array([], dtype=np.int64), np.array([10, 20])])
    linear = machine.bias + machine.weights[[10, 20]].sum() + machine.vectors[10] @ machine.vectors[20]
    assert text[1] == pytest.approx(1 / (1 + np.exp(-linear)), abs=1e-5)


def test_scores_do_not_depend_on_the_bound(spark):
    """A bound that cuts the larger label only leaves scores where they are."""
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 5 == 0), " ".join(["alpha" if rng.random() < (0.7 if i % 5 == 0 else 0.2) else "beta", *(f"n{k}" for k in rng.integers(0, 40, 8))])) for i in range(2000)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, y, _ in rows], "doc_id long, quality int, toxic int")
    for module, column in ((T, "toxic"), (Q, "quality")):
        mean = []
        for bound in (400, 4000):
            score = module.scorer(spark, module.learn(docs, labels, crc_rest(1) == 0, column, bound=bound))
            mean.append([np.mean([r[0] for r in docs.where(f"text LIKE '{w}%'").select(score("text")).collect()]) for w in ("alpha", "beta")])
        assert np.abs(np.array(mean[0]) - np.array(mean[1])).max() < 0.1, (module.__name__, mean)


def test_scorers_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "words " * 100_000, 1), (3, "a b c", 1), (3, "a b c", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 0, 0), (3, 1, 0), (3, 0, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    everything = crc_rest(1) == 0
    for module, column in ((Q, "quality"), (T, "toxic")):
        for own in (labels, labels.limit(0)):
            score = module.scorer(spark, module.learn(docs, own, everything, column))
            scores = [r[0] for r in docs.select(score("text")).collect()]
            assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
            assert docs.limit(0).select(score("text")).count() == 0


def test_rules(spark):
    import re
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in R.quality_rules(docs, labels).collect():
        text, w = texts[r["doc_id"]], re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        windows, covered = {}, set()
        for i in range(len(w) - 4):
            windows.setdefault(tuple(w[i:i + 5]), []).append(i)
        for at in windows.values():
            if len(at) > 1:
                covered.update(i + k for i in at for k in range(5))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r["kept"] == (not r["base_failed"] and not r["broken_rules"])


def test_cutoffs_keep_the_promise():
    rng = np.random.default_rng(5)
    n = 5000
    steps = np.ceil(rng.beta(1, 12, n) * R.STEPS).astype(int)
    counts = {(0, "symbols", int(k)): int((steps == k).sum()) for k in set(steps)}
    cuts = R.choose_cutoffs(counts, 0.08, 0.05)
    cut = round(cuts[0, "symbols"] * R.STEPS)
    level, share = 0.05 / (len(R.BANDS) * len(R.RULES)), 0.08 / len(R.RULES)
    assert R.upper_bound(int((steps > cut).sum()), n, level) <= share < R.upper_bound(int((steps > cut - 1).sum()), n, level)
    assert set(cuts) == {(0, "symbols")}
    # Exact bound: the binomial tail at the bound is the error level.
    from math import comb
    p = R.upper_bound(3, 40, 0.05)
    assert sum(comb(40, k) * p**k * (1 - p) ** (40 - k) for k in range(4)) == pytest.approx(0.05, rel=1e-6)


def test_joint_cutoffs_keep_the_promise(spark):
    """Cutoffs learnt from half of the labels, counted on the other half; every stratum with 86 good holdout rows has cutoffs."""
    for sf, strata in ((DATA, 1), ("/root/testdata/sf0.1", 3)):
        measured = R.durable(R.with_metrics(spark.read.parquet(f"{sf}/documents.parquet")), "t").cache()
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        assert len({s for s, _ in R.joint_cutoffs(measured, labels)}) >= strata
        half = R.F.xxhash64("doc_id", R.F.lit("half")) % 2 == 0
        cuts = R.joint_cutoffs(measured, labels.where(half), risk=0.1)
        rows = R.judge(measured, cuts).join(labels.where(~half).where("quality = 1"), "doc_id").select(R.stratum(R.F.col("n_words")).alias("s"), R.F.size("broken_rules").alias("b")).collect()
        for s in {s for s, _ in cuts}:
            own = [r["b"] > 0 for r in rows if r["s"] == s]
            assert sum(own) <= 0.1 * len(own) + 3 * (0.1 * 0.9 * len(own)) ** 0.5


def test_family_is_nested_and_tested_in_order():
    rng = np.random.default_rng(6)
    counts = {}
    for rule in R.RULES:
        for k in np.ceil(rng.beta(1, 9, 200) * R.STEPS).astype(int):
            counts[0, rule, int(k)] = counts.get((0, rule, int(k)), 0) + 1
    for (s, rule), cuts in R.family(counts, 0.05).items():
        assert len(cuts) == 2 * R.LEVELS + 1 and cuts[0] == R.STEPS and all(x >= y for x, y in zip(cuts, cuts[1:]))
        assert sum(n for (z, r, k), n in counts.items() if (z, r) == (s, rule) and k > cuts[R.LEVELS]) == 0
    assert R.strictest_level([0, 0, 1], 86, 0.05, 0.0125) == 1 and R.strictest_level([0], 85, 0.05, 0.0125) is None
    assert R.strictest_level([9, 0], 100, 0.05, 0.0125) is None and R.strictest_level([], 0, 0.05, 0.0125) is None


def test_rules_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b c d e f g h i j k", 1), (3, "x " * 100_000, 1), (3, "x " * 100_000, 1)], "doc_id long, text string, m int")
    labels = spark.createDataFrame([(1, 1), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = R.quality_rules(docs, labels).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in rows) == [("1", 0, False), ("2", 0, False), ("3", 100_000, False), ("3", 100_000, False), ("None", 11, True)]
    assert R.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_licences_inherit_from_the_nearest(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [("LICENSE", apache), ("a/x.py", "code"), ("a/b/COPYING", mit), ("a/b/y.py", None), ("a/b/c/d/z.py", ""), ("a/w.py", f"# {mit}\ncode"), ("a/LICENSE.md", "Our License is secret and unlike all others in the world"),
            (None, "code"), (None, mit), ("e/f", "copyright"), ("a/b/y.py", None), ("q/LICENSE", "no " * 50_000 + "license")]
    files = spark.createDataFrame([(i, p, t, "k") for i, (p, t) in enumerate(rows)], "i int, path string, text string, term string")
    got = {r["i"]: (r["own_license"], r["license"], r["inherited_from"]) for r in C.licences(files).collect()}
    up = (None, "Apache-2.0", "")
    assert got == {0: ("Apache-2.0", "Apache-2.0", None), 1: up, 2: ("MIT", "MIT", None), 3: (None, "MIT", "a/b"), 4: (None, "MIT", "a/b"), 5: ("MIT", "MIT", None), 6: up, 7: (None, None, None), 8: ("MIT", "MIT", None),
                   9: up, 10: (None, "MIT", "a/b"), 11: up}
    assert C.licences(files.limit(0)).count() == 0


def test_templates_find_themselves(spark):
    files = spark.createDataFrame([(k, "f", t) for k, t in C.TEMPLATES], "k string, path string, text string")
    rows = [r for r in C.licences(files).collect() if r["own_license"]]
    assert len(rows) >= len(C.TEMPLATES) - 1 and all(r["own_license"] == r["k"] and r["similarity"] == 1000 for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    assert sorted(tuple(str(r[c]) for c in key) for r in df.collect()) == sorted(tuple(str(dict(zip(names, r))[c]) for c in key) for r in cur.fetchall())
