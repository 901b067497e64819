"""Rule metrics of a text and risk-controlled cutoffs.

Every rule is a share between 0 and 1, higher is worse. The good labelled rows are dealt by a hash of their id: a quarter gives each stratum a
nested family of cutoffs, in which all rules tighten together from level to level, and the other three quarters are the holdout. On the
holdout the levels are tested from lenient to strict for as long as the exact (Clopper-Pearson) upper bound of the share of good documents
that any rule rejects stays within ``risk``. Testing along a fixed order needs no correction for the levels, and the rules are
tested as one; the error level is divided by the strata (Bonferroni). So with probability ``1 - error`` no stratum loses more than ``risk`` of
its good documents. A value on a grid step counts as the step above; a document is rejected only beyond its cutoff, so ties stay.

``choose_cutoffs`` is the separate form: every rule by itself, error and risk divided by the rules as well.

Cases: a null or empty text has no words and fails the base rules; strata without enough labels get no cutoff; rows that
repeat are judged one by one; labels of unknown ids count for nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, one_label, words_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbols", "dup_lines", "repeats", "capitals", "one_word", "few_kinds", "marks", "long_words"]
#: Lower ends of the strata by number of words: a fixed, small number of strata.
BANDS = [0, 50, 200, 1000]
STEPS = 50
#: One good row in LEARN shapes the family of cutoffs; it has 2 * LEVELS + 1 levels.
LEARN, LEVELS = 4, 10
SPACE, SYMBOLS, MARKS = " \t\n\r\x0b\x0c", "#*$%&|<>", "!?~^"
_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(r, T.DoubleType()) for r in RULES])


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    key, kinds = ids[:n], len(known)
    for j in range(1, size):
        if key.max() >= (1 << 62) // kinds:  # exact numbers again before they could overflow
            key = np.unique(key, return_inverse=True)[1]
        key = key * kinds + ids[j:j + n]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[at] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple:
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeated = repeat_words(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    d, c = max(n, 1), max(chars, 1)
    share = (symbols / c, dups / max(lines, 1), repeated / d, sum(w.isupper() and len(w) > 1 for w in words) / d,
             max(counts.values(), default=0) / d, 1 - (len(counts) / d) ** 0.5 if n else 0.0, sum(map(text.count, MARKS)) / d / 2,
             sum(len(w) > 30 for w in words) / d)
    return (n, chars, symbols, dups, repeated, *[min(1.0, x) for x in share])


@F.pandas_udf(_SCHEMA)
def metrics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=COUNTS + RULES)


def upper_bound(failures: int, n: int, error: float) -> float:
    """Exact one-sided Clopper-Pearson bound: the share at which ``failures`` or fewer have probability ``error``."""
    if n == 0 or failures >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(failures + 1)]

    def tail(p: float) -> float:
        return sum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(logs))

    low, high = failures / n, 1.0 - 1e-15
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid > 0 and tail(mid) > error else (low, mid)
    return high


def stratum(n_words: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(BANDS[1:], 1):
        out = F.when(n_words >= least, k).otherwise(out)
    return out


def choose_cutoffs(counts: dict[tuple[int, str, int], int], risk: float, error: float) -> dict[tuple[int, str], float]:
    """counts: good labelled documents by (stratum, rule, grid step ``ceil(value * STEPS)``). A document is rejected above its
    cutoff, that is, with a grid step over ``cutoff * STEPS``."""
    level, share, out = error / (len(BANDS) * len(RULES)), risk / len(RULES), {}
    for s in range(len(BANDS)):
        for rule in RULES:
            steps = [counts.get((s, rule, k), 0) for k in range(STEPS + 1)]
            n, rejected = sum(steps), 0
            for k in range(STEPS - 1, -1, -1):
                rejected += steps[k + 1]
                if rejected > share * n or upper_bound(rejected, n, level) > share:
                    break
                out[s, rule] = k / STEPS
    return out


def with_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the rule values of every row."""
    return docs.select("doc_id", metrics("text").alias("m")).select("doc_id", "m.*")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, rule) learnt from all rows whose quality label is 1. At most strata x rules x (steps + 1) numbers
    reach the driver."""
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * STEPS).cast("int").alias("step")) for r in RULES])
    good = measured.join(one_label(labels, "quality").where("label = 1"), "doc_id", "left_semi")
    rows = (good.select(stratum(F.col("n_words")).alias("stratum"), F.inline(steps)).groupBy("stratum", "rule", "step").count()).collect()
    return choose_cutoffs({(r["stratum"], r["rule"], r["step"]): r["count"] for r in rows}, risk, error)


def family(counts: dict[tuple[int, str, int], int], risk: float) -> dict[tuple[int, str], list[int]]:
    """counts: good rows of the learning part by (stratum, rule, grid step). Cutoffs as grid steps, level by level, never rising: first from the
    end of the grid down to the largest value seen, then rejecting up to ``risk`` of the learning part by each rule."""
    out = {}
    for s in range(len(BANDS)):
        for rule in RULES:
            steps = np.array([counts.get((s, rule, k), 0) for k in range(STEPS + 1)])
            beyond = steps.sum() - np.cumsum(steps)  # rows over each step
            top = int(np.flatnonzero(steps).max(initial=0))
            wide = [top + math.ceil((STEPS - top) * (LEVELS - t) / LEVELS) for t in range(LEVELS)]
            out[s, rule] = wide + [int(np.argmax(beyond <= risk * t / LEVELS * steps.sum())) for t in range(LEVELS + 1)]
    return out


def strictest_level(rejected: list[int], n: int, risk: float, error: float) -> int | None:
    """rejected: good holdout rows of n that each level rejects, never falling. The last level before the first that fails its test."""
    best = None
    for t, r in enumerate(rejected):
        if r > risk * n or upper_bound(r, n, error) > risk:
            break
        best = t
    return best


def joint_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, rule) from all rows whose quality label is 1. At most strata x rules x (steps + 1) numbers of the learning part and
    strata x (levels + 1) of the holdout reach the driver."""
    good = measured.join(one_label(labels, "quality").where("label = 1"), "doc_id", "left_semi").withColumn("_s", stratum(F.col("n_words")))
    good = good.select("doc_id", "_s", *[F.ceil(F.col(r) * STEPS).cast("int").alias(r) for r in RULES])
    learns = F.pmod(F.xxhash64("doc_id"), F.lit(LEARN)) == 0
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])
    rows = good.where(learns).select("_s", F.inline(steps)).groupBy("_s", "rule", "step").count().collect()
    nested = family({(r["_s"], r["rule"], r["step"]): r["count"] for r in rows}, risk)

    def first_rejecting(rule: str) -> Column:
        """How many levels keep the row; cutoffs never rise, so these are the first ones."""
        own = F.element_at(F.array(*[F.array(*map(F.lit, nested[s, rule])) for s in range(len(BANDS))]), F.col("_s") + 1)
        return F.size(F.filter(own, lambda cut: cut >= F.col(rule)))

    held = good.where(~learns).groupBy("_s", F.least(*map(first_rejecting, RULES)).alias("level")).count().collect()
    out, levels = {}, 2 * LEVELS + 1
    for s in range(len(BANDS)):
        count = np.zeros(levels + 1, dtype=np.int64)
        for r in held:
            if r["_s"] == s:
                count[r["level"]] += r["count"]
        best = strictest_level(np.cumsum(count)[:levels].tolist(), int(count.sum()), risk, error / len(BANDS))
        if best is not None:
            out |= {(s, rule): nested[s, rule][best] / STEPS for rule in RULES}
    return out


def judge(measured: DataFrame, cuts: dict[tuple[int, str], float]) -> DataFrame:
    """Adds base_failed, kept, and the names of the rules that reject the row."""
    s = stratum(F.col("n_words"))
    broken = []
    for rule in RULES:
        limit = F.lit(None).cast("double")
        for (k, r), cut in cuts.items():
            if r == rule:
                limit = F.when(s == k, F.lit(cut)).otherwise(limit)
        broken.append(F.when(F.ceil(F.col(rule) * STEPS) > F.round(limit * STEPS), F.lit(rule)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.withColumn("base_failed", base).withColumn("broken_rules", F.array_compact(F.array(*broken)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """One row per document row: doc_id, counts, base_failed, kept, broken_rules. The metrics are written once to the shared
    folder, since the cutoffs and the verdicts both read them."""
    measured = durable(with_metrics(docs), "rule-metrics")
    return judge(measured, joint_cutoffs(measured, labels, risk, error)).select("doc_id", *COUNTS, "base_failed", "kept", "broken_rules")
