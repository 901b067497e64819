"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (lower case, punctuation cut off at the ends) and, so that inflected forms and compounds of a stem
meet, the first four and five letters of longer words; each is hashed into ``DIMS`` places. Besides a weight per term the
machine learns a short vector per term; the products of two terms' vectors are the weights of pairs, such as an insult next to
the name of a group, which a linear model cannot tell from either alone.

Fitted on at most ``bound`` labelled rows of each label (a documented parameter), on the driver, by AdaGrad. Where the bound cuts
the labels unequally, the bias is moved back by the log of the sampling rates, so that a score means the same share of label 1
for samples of any size; terms that fewer
than three of these rows have, or whose chi-squared with the label is under ``least``, are not learnt and stay zero. The model has a fixed size, DIMS x (1 + factors) numbers, and is
broadcast; every row is then scored where it lies.

Cases: null and empty texts get the score of a text without terms; repeated rows are scored one by one; without labelled rows of both
labels every score is the share of label 1 (0 if there are none); very long texts are read whole; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, labelled_sample, sampling_rates

DIMS = 1 << 18
TRIM = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Words whose places a task remembers, about 250 bytes each.
_CACHE = 50_000


def term_ids(word: bytes) -> tuple[int, ...]:
    """Places of the terms of one word, given in lower case."""
    word = word.strip(TRIM)
    if not word:
        return ()
    letters = word.decode("utf-8", "replace")
    terms = [b"w" + word] + [b"p%d" % n + letters[:n].encode() for n in (4, 5) if len(letters) > n]
    return tuple(zlib.crc32(t) % DIMS for t in terms)


def terms_of(text: str | None, cache: dict) -> np.ndarray:
    """Distinct places of a text's terms, sorted. ``cache`` keeps places by word up to a bound."""
    out: set[int] = set()
    for w in set((text or "").lower().encode("utf-8", "surrogatepass").split()):
        ids = cache.get(w)
        if ids is None:
            if len(cache) >= _CACHE:
                cache.clear()
            ids = cache[w] = term_ids(w)
        out.update(ids)
    return np.fromiter(sorted(out), dtype=np.int64, count=len(out))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over the rows' stretches; empty stretches give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def raw(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        v = self.vectors[ids].astype(np.float64)
        s = _sums(v, offsets)
        return self.bias + _sums(self.weights[ids], offsets) + 0.5 * (s * s - _sums(v * v, offsets)).sum(axis=1)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return 1 / (1 + np.exp(-np.clip(self.raw(np.concatenate(rows).astype(np.int64), offsets), -30, 30)))


def fit(rows: list[np.ndarray], labels: list[int], factors: int = 4, epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, least: float = 25.0, seed: int = 7) -> Machine:
    y = np.array(labels, dtype=np.float64)
    weights, vectors = np.zeros(DIMS, dtype=np.float32), np.zeros((DIMS, factors), dtype=np.float32)
    share = y.mean() if len(y) else 0.0
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6))) if len(y) else -30.0
    if not 0 < share < 1:
        return Machine(bias, weights, vectors)
    rng = np.random.default_rng(seed)
    # Rows with the same terms count once, so that copies are no evidence; then terms by their chi-squared with the label.
    first = sorted({r.tobytes(): i for i, r in reversed(list(enumerate(rows)))}.values())
    rows, y = [rows[i] for i in first], y[first]
    total, bad = len(rows), y.sum()
    seen = np.bincount(np.concatenate(rows).astype(np.int64), minlength=DIMS).astype(np.float64)
    hit = np.bincount(np.concatenate([r for r, label in zip(rows, y) if label] or [np.zeros(0)]).astype(np.int64), minlength=DIMS)
    chi = total * (hit * total - seen * bad) ** 2 / np.maximum(seen * (total - seen) * bad * (total - bad), 1)
    known = np.flatnonzero((seen >= 3) & (chi >= least))
    place = np.full(DIMS, -1, dtype=np.int64)
    place[known] = np.arange(len(known))
    own = [p[p >= 0] for p in (place[r] for r in rows)]
    w, v = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), factors))
    gw, gv, gb = np.full(len(known), 1e-4), np.full(v.shape, 1e-4), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(own))
        for k in range(0, len(order), 64):
            part = order[k:k + 64]
            sizes = np.array([len(own[i]) for i in part])
            ids, offsets = np.concatenate([own[i] for i in part]), np.concatenate([[0], np.cumsum(sizes)])
            s = _sums(v[ids], offsets)
            raw = bias + _sums(w[ids], offsets) + 0.5 * (s * s - _sums(v[ids] ** 2, offsets)).sum(axis=1)
            miss = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            each = np.repeat(miss, sizes)
            places, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, each, len(places)) + decay * w[places]
            pair = each[:, None] * (np.repeat(s, sizes, axis=0) - v[ids])
            dv = np.stack([np.bincount(inverse, pair[:, f], len(places)) for f in range(factors)], axis=1) + decay * v[places]
            gw[places] += dw * dw
            gv[places] += dv * dv
            gb += miss.sum() ** 2
            w[places] -= rate * dw / np.sqrt(gw[places])
            v[places] -= rate * 0.2 * dv / np.sqrt(gv[places])
            bias -= rate * miss.sum() / np.sqrt(gb)
    weights[known], vectors[known] = w, v
    return Machine(float(bias), weights, vectors)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, column: str = "toxic", bound: int = 4000, **options) -> Machine:
    """Machine fitted on the bounded sample; only places of terms come to the driver."""
    @F.arrow_udf("binary")
    def places(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for text in texts:
            yield in_slices(text, 64, lambda part: [terms_of(t, cache).astype(np.int32).tobytes() for t in part], pa.binary())

    rows = labelled_sample(docs, labels, column, learn_from, bound).select("doc_id", "label", places("text").alias("terms")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    machine = fit([np.frombuffer(r["terms"], dtype=np.int32).astype(np.int64) for r in rows], [int(r["label"]) for r in rows], **options)
    rates = sampling_rates(labels, column, learn_from, bound)
    machine.bias += float(np.log(rates[0] / rates[1]))
    return machine


def scorer(spark: SparkSession, machine: Machine):
    """Column function text -> score. The broadcast model has a fixed size."""
    model = spark.sparkContext.broadcast((machine.bias, machine.weights, machine.vectors))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, cache = Machine(*model.value), {}
        for text in texts:
            yield in_slices(text, 64, lambda part: own.score([terms_of(t, cache) for t in part]), pa.float64())

    return score.asNondeterministic()
