"""Benchmark passages in documents.

Every item has a SimHash over its shingles of five words. For each document, windows as long as an item get a SimHash of the
same kind; windows are taken wherever they share a shingle with an item of their length, since without one the similarity
is zero. A document shorter than an item, but with at least ``similarity`` times its number of shingles, is one window as a whole.
A multi-index finds the items near a window: fingerprints are cut into eight blocks, and two that differ in at most
``radius`` bits (15 at most) agree up to one bit in some block, so looking up each block and its one-bit neighbours finds every
item within the radius. Candidates are verified with the exact weighted similarity of their shingles, the sum of the smaller
counts over the sum of the larger counts.

The items are taken in blocks of ``block`` shingles at most, and one block at a time is broadcast: its size is bounded whatever
the benchmark holds; a larger benchmark takes more rounds over the documents.

Cases: null and empty texts match nothing, and neither do items without words; an item of fewer than five words is one shingle
of all its words; repeated items each match; repeated rows are searched one by one; empty tables give no match. Words are
compared in lower case without punctuation at their ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_slices

SIZE, BLOCKS = 5, 8
_TRIM = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
                                  T.StructField("bits", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))


def tokens(text: str | None) -> list[bytes]:
    if text is None:
        return []
    return [w for w in (raw.strip(_TRIM) for raw in text.lower().encode("utf-8", "surrogatepass").split()) if w]


def hashes(words: list[bytes], size: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + size])) for i in range(len(words) - size + 1)), dtype=np.uint64)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _packed(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """One block of the benchmark, as tasks use it."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.items: list[tuple] = []
        self.words: set[bytes] = set()
        self.owners: dict[int, set[tuple[int, int]]] = {}
        self.index: dict[tuple[int, int, int], dict[int, list[int]]] = {}
        for item, text in rows:
            words = tokens(text)
            if not words:
                continue
            size = min(SIZE, len(words))
            h = hashes(words, size)
            fp = int(_packed(_bits(h).sum(axis=0)[None], len(h))[0])
            kind, k = (size, len(words)), len(self.items)
            self.items.append((item, fp, Counter(h.tolist()), len(h)))
            self.words.update(words)
            for x in h.tolist():
                self.owners.setdefault(x, set()).add(kind)
            for b in range(BLOCKS):
                self.index.setdefault((*kind, b), {}).setdefault(fp >> 8 * b & 255, []).append(k)
        self.sizes = sorted({min(SIZE, n) for _, n in {o for s in self.owners.values() for o in s}})

    def near(self, kind: tuple[int, int], fp: int, radius: int) -> Iterator[tuple[int, int]]:
        """Items of a length within ``radius`` bits of a fingerprint."""
        reach = radius // BLOCKS
        assert reach <= 1, "a radius over 15 needs more neighbours per block"
        seen: set[int] = set()
        for b in range(BLOCKS):
            table, own = self.index[*kind, b], fp >> 8 * b & 255
            for value in [own, *([own ^ 1 << k for k in range(8)] if reach else [])]:
                for k in table.get(value, ()):
                    if k not in seen:
                        seen.add(k)
                        bits = (fp ^ self.items[k][1]).bit_count()
                        if bits <= radius:
                            yield k, bits

    def search(self, text: str | None, radius: int, similarity: float) -> list[tuple]:
        """The best window of each matching item: item, first word, word after the last, differing bits, similarity. Places count
        words that have a letter or digit."""
        words = tokens(text)
        known = np.fromiter((w in self.words for w in words), dtype=bool, count=len(words))
        best: dict[int, tuple] = {}
        for size in self.sizes:
            if len(words) < size:
                continue
            # Shingles of known words only can be an item's.
            runs = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(runs[size:] - runs[:-size] == size)
            spots: dict[tuple[int, int], list[int]] = {}
            for p in at.tolist():
                for kind in self.owners.get(xxhash.xxh64_intdigest(b" ".join(words[p:p + size])), ()):
                    if kind[0] == size:
                        spots.setdefault(kind, []).append(p)
            for kind, hits in spots.items():
                n, marks = kind[1] - size + 1, np.array(hits)
                if len(words) < kind[1]:
                    if len(words) - size + 1 >= similarity * n - 1e-9:
                        self._windows(words, kind, len(words) - size + 1, 0, 1, radius, similarity, best)
                    continue
                starts = np.unique((marks[:, None] - np.arange(n)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts + kind[1] <= len(words))]
                for stretch in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    for part in np.array_split(stretch, max(1, len(stretch) // 4096)):
                        if len(part):
                            self._windows(words, kind, n, int(part[0]), len(part), radius, similarity, best)
        return [(self.items[k][0], *found) for k, found in sorted(best.items())]

    def _windows(self, words, kind, n, first, count, radius, similarity, best) -> None:
        """``count`` windows of n shingles each, the first one at word ``first``."""
        long = n + kind[0] - 1
        h = hashes(words[first:first + count - 1 + long], kind[0])
        sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(_bits(h), axis=0, dtype=np.int32)])
        fps = _packed(sums[n:n + count] - sums[:count], n)
        for w, fp in enumerate(fps.tolist()):
            own = None
            for k, bits in self.near(kind, fp, radius):
                own = own or Counter(h[w:w + n].tolist())
                other, m = self.items[k][2], self.items[k][3]
                common = sum(min(c, other[x]) for x, c in own.items() if x in other)
                alike = common / (n + m - common)
                if alike >= similarity and (k not in best or alike > best[k][3]):
                    best[k] = (first + w, first + w + long, bits, alike)


def item_blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block`` words, one at a time: the driver never holds more than two."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") // 4 + 1
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(text: Column, items: list[tuple], radius: int = 15, similarity: float = 0.8) -> Column:
    """Array of matches of a text with one block of items."""
    made: dict = {}

    names = MATCH.elementType.names
    kind = to_arrow_type(MATCH)

    @F.arrow_udf(MATCH)
    def search(texts: pa.Array) -> pa.Array:
        if not made:
            made[0] = Items(items)
        return in_slices(texts, 64, lambda part: [[dict(zip(names, m)) for m in made[0].search(t, radius, similarity)] for t in part], kind)

    return search.asNondeterministic()(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = 15, similarity: float = 0.8, block: int = 200_000) -> DataFrame:
    """doc_id, item_id, start, stop, bits, similarity: for each row of docs, its best window for each matching item."""
    out = None
    for items in item_blocks(benchmark, block):
        part = docs.select("doc_id", matches(F.col("text"), items, radius, similarity).alias("m")).select("doc_id", F.inline("m"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = T.StructType([docs.schema["doc_id"], *MATCH.elementType.fields])
        return docs.sparkSession.createDataFrame([], schema)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = 15, similarity: float = 0.8, block: int = 200_000) -> DataFrame:
    """The rows of docs without any match, all columns as they are."""
    out = docs
    for items in item_blocks(benchmark, block):
        out = out.where(F.size(matches(F.col("text"), items, radius, similarity)) == 0)
    return out
