"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of two kinds of terms. Structure terms: the shapes of its words, how large a share its words and lines take by
repetition, its variety and length. Word terms: its words, hashed. Each kind has TF-IDF weights and unit length of its own. A
singular value decomposition of the labelled sample gives the latent space; the sample's vectors, at most ``2 * bound`` rows of ``rank``
numbers (a documented bound), are broadcast. For every document the exact cosine to all of them is computed as matrix products, block
by block; the ``neighbours`` closest vote with their labels, weighted by similarity and by how many labelled rows each stands for,
as the bound may cut one label more than the other.

Term weights are part of the fitted model and come from the sample. Cases: null and empty texts have their own structure terms
and are scored like any other; without labelled rows every score is 0.5; repeated rows are scored one by one; very long
texts are read whole; an empty table gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, labelled_sample, sampling_rates, words_of

STRUCTURE, WORDS = 1 << 10, 1 << 12
#: Words whose places a task remembers, about 250 bytes each.
_CACHE = 50_000


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each, other characters as they are, eight signs at most."""
    out: list[str] = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
        if len(out) == 8:
            break
    return "".join(out)


def _place(term: str, dims: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % dims


def features(text: str | None, cache: dict) -> dict[int, float]:
    """Places of terms with their counts; word terms come after the structure terms."""
    words = words_of(text)
    counts, n, out = Counter(words), len(words), Counter()
    for w, c in counts.items():
        ids = cache.get(w)
        if ids is None:
            if len(cache) >= _CACHE:
                cache.clear()
            plain = w.decode("utf-8", "replace")
            ids = cache[w] = (_place("shape " + shape(plain), STRUCTURE), STRUCTURE + _place(plain.lower(), WORDS), _place(f"long {min(len(plain), 40) // 4}", STRUCTURE))
        for k in ids:
            out[k] += c
        if c > 1:
            out[_place(f"share {min(12, int(math.log2(n / c)))}", STRUCTURE)] += c
    lines = Counter(x for x in (text or "").split("\n") if x.strip())
    m = max(1, sum(lines.values()))
    # These stand for the whole text, so they weigh as much as its words together.
    whole = [f"variety {round(10 * len(counts) / max(n, 1))}", f"length {int(math.log2(n + 1))}", f"lines {round(10 * len(lines) / m)}", f"line words {min(12, int(math.log2(1 + n / m)))}"]
    for term in whole:
        out[_place(term, STRUCTURE)] += max(1, n)
    return dict(out)


def weigh(rows: list[dict[int, float]], idf: np.ndarray) -> np.ndarray:
    """Rows of a matrix: each kind of terms has unit length, words count half."""
    x = np.zeros((len(rows), STRUCTURE + WORDS), dtype=np.float32)
    for i, row in enumerate(rows):
        x[i, np.fromiter(row, dtype=np.int64, count=len(row))] = np.log1p(np.fromiter(row.values(), dtype=np.float64, count=len(row)))
    x *= idf
    for part, scale in ((slice(0, STRUCTURE), 1.0), (slice(STRUCTURE, None), 0.5)):
        norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= scale / np.where(norm > 0, norm, 1)
    return x


class Voters:
    """idf, projection (terms x rank), unit vectors of the labelled rows, their labels, and the weights of votes for 0 and 1."""

    def __init__(self, idf, projection, vectors, labels, neighbours: int, votes: tuple[float, float] = (1.0, 1.0)):
        self.idf, self.projection, self.vectors, self.labels, self.neighbours, self.votes = idf, projection, vectors, labels, neighbours, votes

    def score(self, rows: list[dict[int, float]]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        own = weigh(rows, self.idf) @ self.projection
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        alike = own @ self.vectors.T
        k = min(self.neighbours, alike.shape[1])
        at = np.argpartition(-alike, k - 1, axis=1)[:, :k]
        votes = np.where(self.labels > 0, self.votes[1], self.votes[0])
        near = np.maximum(np.take_along_axis(alike, at, axis=1), 0.0) ** 4 * votes[at]
        total = near.sum(axis=1)
        return np.where(total > 0, (near * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1), np.average(self.labels, weights=votes))


def fit(rows: list[dict[int, float]], labels: list[int], rank: int = 48, neighbours: int = 25) -> Voters:
    dims = STRUCTURE + WORDS
    if not rows:
        return Voters(np.ones(dims, dtype=np.float32), np.zeros((dims, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), np.zeros(0), neighbours)
    seen = np.bincount(np.concatenate([np.fromiter(r, dtype=np.int64, count=len(r)) for r in rows]), minlength=dims)
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    x = weigh(rows, idf)
    # Leading right singular vectors by subspace iteration.
    basis = np.random.default_rng(7).normal(size=(dims, min(rank + 16, len(rows))))
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ turn.T)[:, :rank]
    vectors = x @ projection
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Voters(idf, projection.astype(np.float32), vectors.astype(np.float32), np.array(labels, dtype=np.float64), neighbours)


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, column: str = "quality", bound: int = 1500, **options) -> Voters:
    @F.arrow_udf("map<int,float>")
    def terms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict = {}
        for text in texts:
            yield in_slices(text, 256, lambda part: [list(features(t, cache).items()) for t in part], pa.map_(pa.int32(), pa.float32()))

    rows = labelled_sample(docs, labels, column, learn_from, bound).select("doc_id", "label", terms("text").alias("terms")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    voters = fit([r["terms"] for r in rows], [int(r["label"]) for r in rows], **options)
    rates = sampling_rates(labels, column, learn_from, bound)
    voters.votes = (1 / rates[0], 1 / rates[1])
    return voters


def scorer(spark: SparkSession, voters: Voters):
    """Column function text -> score between 0 and 1."""
    model = spark.sparkContext.broadcast((voters.idf, voters.projection, voters.vectors, voters.labels, voters.neighbours, voters.votes))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, cache = Voters(*model.value), {}
        for text in texts:
            yield in_slices(text, 256, lambda part: np.clip(own.score([features(t, cache) for t in part]), 0, 1), pa.float64())

    return score.asNondeterministic()
