"""Runs of words that repeat with a period, by recompression.

A run is a stretch of consecutive words with a smallest period q (words q apart are identical) that is at least ``min_words`` and ``min_periods`` periods long and
that no neighbouring word extends. The words of a slice of documents, with a separator of its own after each, are compressed in turns: blocks of one
symbol become one symbol with a count, then pairs of neighbours, one of a left and one of a right half of the alphabet, become one symbol, until a
single symbol is left. That is a run-length grammar; equal symbols of one level stand for equal words. How far two places agree, forwards or backwards, is read off by walking up the two parses while their
symbols are equal and down where they differ, O(log n) steps each, all pairs of a slice at once.

Which pairs: a run of period q holds, of every grid with step ``max(min_words - q, (min_periods - 1) * q)``, a place a with a + q. For all q together these are harmonically
many, n log n, pairs. Pairs are left out whose neighbourhood of a few words, by hash, differs on both sides, as they cannot be long enough; equal hashes prove nothing and the grammar
decides. Of the periods of one stretch the smallest holds: all others that fit three times are its multiples.

Work is done document by document inside a task, slices bound the memory at some 200 bytes a word of the longest document.

Cases: null and empty texts have no word and no run, and stay null or become empty; repeated rows, null ids and clashing further columns (which are left out) change
nothing, as every row stands alone; runs that overlap are all given; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, let

#: Words, and pairs of places, that are worked on together.
SLICE, PAIRS = 200_000, 1_000_000
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Grammar:
    """Parse of a sequence whose first and last letters occur once. Nodes of all levels lie one after the other, the letters first."""

    def __init__(self, letters: np.ndarray):
        self.letters = len(letters)
        level, rng, start, rounds = letters.astype(np.int64), np.random.default_rng(11), 0, 0
        size = np.ones(len(level), dtype=np.int64)
        syms, sizes, parents, edges, inner, rests = [level], [size], [], [], [(np.full(len(level), -1), np.full(len(level), -1))], [self._rest(level)]
        while len(level) > 1 and rounds < 200:
            head = self._blocks(level) if rounds % 2 == 0 else self._pairs(level, rng)
            rounds += 1
            at = np.flatnonzero(head)
            if len(at) == len(level):
                continue
            last = np.append(at[1:], len(level)) - 1
            # Block: symbol and count. Pair: both symbols, or one and none.
            second = last - at if rounds % 2 else np.where(last > at, level[last], -1)
            _, name = np.unique(level[at] * (second.max() + 2) + second + 1, return_inverse=True)
            parents.append(start + len(level) + np.cumsum(head) - 1)
            edges.append((head, np.append(head[1:], True)))
            inner.append((start + at, start + last))
            size = np.add.reduceat(size, at)
            start += len(level)
            level = name.astype(np.int64)
            syms.append(level)
            sizes.append(size)
            rests.append(self._rest(level))
        parents.append(np.full(len(level), -1))
        edges.append((np.zeros(len(level), dtype=bool),) * 2)
        self.sym, self.size, self.parent = np.concatenate(syms), np.concatenate(sizes), np.concatenate(parents)
        self.edge = [np.concatenate([e[k] for e in edges]) for k in (0, 1)]
        self.inner = [np.concatenate([e[k] for e in inner]) for k in (0, 1)]
        self.rest = [np.concatenate([e[k] for e in rests]) for k in (0, 1)]

    @classmethod
    def _rest(cls, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node how many nodes of its block there are from it on, and up to it."""
        head = np.append(np.flatnonzero(cls._blocks(level)), len(level))
        n, here = np.diff(head), np.arange(len(level))
        return np.repeat(head[1:], n) - here, here - np.repeat(head[:-1], n) + 1

    @staticmethod
    def _blocks(level: np.ndarray) -> np.ndarray:
        return np.append(True, level[1:] != level[:-1])

    @staticmethod
    def _pairs(level: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        left = (rng.random(level.max() + 1) < 0.5)[level]
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        return np.append(True, ~(one if one.sum() >= other.sum() else other))

    def agree(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Number of letters that are equal from the different places i and j on, or up to and including them if ``back``."""
        edge, inner, rest, step = self.edge[back], self.inner[back], self.rest[back], -1 if back else 1
        out, live, u, v = np.zeros(len(i), dtype=np.int64), np.arange(len(i)), i.copy(), j.copy()
        while len(live):
            same = self.sym[u] == self.sym[v]
            pu, pv = self.parent[u], self.parent[v]
            up = same & edge[u] & edge[v] & (pu >= 0)
            up[up] = self.sym[pu[up]] == self.sym[pv[up]]
            on = same & ~up
            n = np.minimum(rest[u], rest[v])  # equal symbols of two blocks go at once
            out[live[on]] += (n * self.size[u])[on]
            u = np.where(up, pu, np.where(on, u + step * n, inner[u]))
            v = np.where(up, pv, np.where(on, v + step * n, inner[v]))
            more = (u >= 0) & (v >= 0)  # letters have nothing below them
            if not more.all():
                live, u, v = live[more], u[more], v[more]
        return out


def _grid(starts: np.ndarray, lengths: np.ndarray, min_words: int, min_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, place, period) of all pairs of places, a bounded number at a time."""
    periods = lengths // min_periods
    text = np.repeat(np.arange(len(starts)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(min_words - q, (min_periods - 1) * q)
    count = (lengths[text] - 1 - q) // step + 1
    ends = np.cumsum(count)
    low = 0
    while low < len(text):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        own = slice(low, high)
        n = count[own]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(text[own], n), np.repeat(starts[text[own]], n) + k * np.repeat(step[own], n), np.repeat(q[own], n)
        low = high


def find_runs(texts: list[np.ndarray], min_words: int = 24, min_periods: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    long = [i for i, t in enumerate(texts) if len(t) >= max(min_words, min_periods)]
    if not long:
        return out
    separator = max(int(texts[i].max()) for i in long) + 1
    parts, starts, at = [np.array([separator])], [], 1
    for k, i in enumerate(long):
        starts.append(at)
        parts += [texts[i], np.array([separator + k + 1])]
        at += len(texts[i]) + 1
    letters, starts, lengths = np.concatenate(parts).astype(np.int64), np.array(starts), np.array([len(texts[i]) for i in long])
    # A run reaches over max(min_words - q, (min_periods - 1) * q) places besides its period, half of them on one side of a.
    near = (min(max(min_words - q, (min_periods - 1) * q) for q in range(1, min_words + 1)) + 1) // 2
    value = np.random.default_rng(5).integers(1, 1 << 62, int(letters.max()) + 1)[letters]
    mixed = np.zeros(len(letters) + near, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(near):
            mixed[:len(letters) - k] += value[k:] * (2 * k + 1) * 0x1000193
    grammar, found = None, []
    for text, place, q in _grid(starts, lengths, min_words, min_periods):
        behind = np.maximum(place - near, 0)
        hit = (mixed[place] == mixed[place + q]) | (mixed[behind] == mixed[behind + q])
        text, place, q = text[hit], place[hit], q[hit]
        if not len(text):
            continue
        if grammar is None:
            grammar = Grammar(letters)
        forward, backward = grammar.agree(place, place + q), grammar.agree(place - 1, place + q - 1, True)
        size = forward + backward + q
        good = size >= np.maximum(min_words, min_periods * q)
        found.append(np.stack([text[good], place[good] - backward[good], size[good], q[good]], axis=1))
    if not found:
        return out
    rows = np.unique(np.concatenate(found), axis=0)
    # Of the periods of one stretch the smallest comes first.
    first = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)) if len(rows) else np.zeros(0, dtype=bool)
    rows = rows[first]
    for text, start, size, q in rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].tolist():
        out[long[text]].append((start - int(starts[text]), size, q))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, min_words: int = 24, min_periods: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period) and collapsed: the words without the repetitions, joined by a space."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes] | None]]]:
        texts, low, held, words = batch.column(1), 0, [], 0
        for i in range(len(batch)):
            text = texts[i].as_py()
            held.append(None if text is None else text.encode().split())
            words += len(held[-1] or ())
            if words >= SLICE or i + 1 == len(batch):
                yield low, held
                low, held, words = i + 1, [], 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in slices(batch):
                flat = np.array([w for t in texts for w in t or ()], dtype=object)
                numbers, _ = pd.factorize(flat)
                cuts = np.cumsum([len(t or ()) for t in texts])[:-1]
                found = find_runs(np.split(numbers, cuts), min_words, min_periods)
                joined = []
                for words, runs in zip(texts, found):
                    if words and runs:
                        words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
                    joined.append(None if words is None else b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, len(texts)), pa.array([len(t or ()) for t in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], runs_type), pa.array(joined, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the words of each document whose id's crc32 ends in 0 repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        a = g % F.greatest(F.size(words), F.lit(1))
        p = F.floor((F.size(words) - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    return docs.select("doc_id", F.when(h % 10 == 0, let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), repeat)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the one with the greatest exponent, and hashes of the runs and of the collapsed text."""
    better = lambda best, r: best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", F.lit(None).cast(RUNS.elementType), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_words", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
