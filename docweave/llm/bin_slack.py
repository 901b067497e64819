"""Packing into as few sequences as possible by minimum bin slack.

A document is its token ids and an end id. Documents longer than a sequence, and only those, are cut: the pieces hold ``max_len`` ids each but the first, which
holds what is left over. For one bin after the other a subset-sum dynamic program over the available lengths, on bitsets, finds the fullest
combination that there still is; of equally full ones that with the longest pieces. The combination is then taken out. As lengths only run out, a
combination stays the fullest for as long as its lengths last, so it is taken as often as they allow at once. The known variants of the search are tried, and the fewest bins
hold: whether a bin must take the longest piece that is left, and how much slack is small enough to leave shorter pieces for later bins. The program needs the histogram of
lengths alone, ``max_len`` numbers whatever the corpus, and ends after at most ``max_len * (1 + 1/2 + ... + 1/max_len)`` combinations, as each one lowers how
often some length fits.

Pieces take their places by rank: the n-th piece of a length belongs to the combination whose share of that length holds n. Ranks are counted per
length and partition of the written pieces and moved on by the sizes of the partitions before, so no length is ordered in one task.

Cases: null and empty texts are the end id alone; a very long text is as many pieces as it needs; rows with a null id and repeated rows are packed one by one,
equal rows in any order among themselves; further columns are left out, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import durable

#: The end of a document.
END_ID = 2
_ENCODERS: dict = {}


class Encoder:
    """Ids of a byte-level tokenizer file. The same vocabulary as ranks, if there is a file of it, gives the same ids several times faster; a text at which its
    pattern engine would give up goes through the tokenizer file."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.slow, self.fast = path, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def plain(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode_ordinary(text)
            except ValueError:  # the pattern engine's own limit
                pass
        return self.plain(text)


def pieces(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, max_len: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids. ``path`` names the tokenizer file on every worker."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, ranks, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*key)
        encoder = _ENCODERS[key]
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, len(batch), 512):
                rows: list[tuple] = []
                for i in range(low, min(low + 512, len(batch))):
                    ids = np.array(encoder.ids(texts[i].as_py() or "") + [END_ID], dtype="<u4")
                    start, first = 0, (len(ids) - 1) % max_len + 1
                    for piece, end in enumerate(range(first, len(ids) + 1, max_len)):
                        own = ids[start:end]
                        rows.append((i, piece, start, end - start, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if with_ids else [])))
                        start = end
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(rest[0], pa.int32()), *[pa.array(c, pa.int64()) for c in rest[1:4]], *[pa.array(c, pa.list_(pa.int32())) for c in rest[4:]]], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def fullest(counts: dict[int, int], capacity: int, slack: int = 0) -> dict[int, int]:
    """Length -> how often, of the fullest combination within the capacity. Lengths come in from the longest down until a combination leaves at most
    ``slack``; the longest pieces first among equals."""
    mask, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:  # 1, 2, 4, ... pieces of a length reach every number of them
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << part * length & mask
            left, part = left - part, part * 2
        if reach >> max(0, capacity - slack):
            break
    total, out = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + part
            total -= part * length
    return out


def _bins(histogram: dict[int, int], capacity: int, slack: int, longest_first: bool) -> list[tuple[dict[int, int], int]]:
    left, out = {x: c for x, c in histogram.items() if c}, []
    while left:
        if longest_first:
            top = max(left)
            own = fullest({x: c - (x == top) for x, c in left.items()}, capacity - top, slack)
            own[top] = own.get(top, 0) + 1
        else:
            own = fullest(left, capacity, slack)
        times = min(left[x] // n for x, n in own.items())
        for x, n in own.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((own, times))
    return out


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The bins: (length -> how often, number of such bins), in the order in which they are taken; of the twelve ways to take them that with the
    fewest bins."""
    best, least = [], None
    bound = -(-sum(x * c for x, c in histogram.items()) // capacity)
    for slack in [0, *(capacity >> k for k in (10, 8, 6, 5, 4))]:
        for longest_first in (True, False):
            own = _bins(histogram, capacity, slack, longest_first)
            n = sum(times for _, times in own)
            if least is None or n < least:
                best, least = own, n
            if least == bound:
                return best
    return best


def shares(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset) by length and first rank."""
    taken, number, rows = {}, 0, []
    for own, times in bins:
        offset = 0
        for length in sorted(own, reverse=True):
            rank = taken.get(length, 0)
            rows.append((length, rank, own[length], number, offset))
            taken[length] = rank + own[length] * times
            offset += own[length] * length
        number += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


_RANKS = 1 << 48


def pack(cut: DataFrame, max_len: int = 1024) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset."""
    columns = cut.columns
    rows = durable(cut.withColumn("row_", F.monotonically_increasing_id()), "pieces").withColumn("part_", F.shiftright("row_", 33))
    # At most max_len numbers.
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    plan = cut.sparkSession.sparkContext.broadcast(shares(combinations(histogram, max_len)))
    sizes = rows.groupBy("length", "part_").agg(F.count("*").alias("size_"))
    before = F.coalesce(F.sum("size_").over(W.partitionBy("length").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = sizes.select("length", "part_", before.alias("before_"))
    inner = F.row_number().over(W.partitionBy("length", "part_").orderBy("row_")) - 1
    ranked = rows.withColumn("inner_", inner).join(offsets, ["length", "part_"]).withColumn("rank_", F.col("before_") + F.col("inner_"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, first, per, number, offset = plan.value.T
        at = np.searchsorted(size * _RANKS + first, length.to_numpy() * _RANKS + rank.to_numpy(), side="right") - 1
        k = rank.to_numpy() - first[at]
        return pd.DataFrame({"sequence_id": number[at] + k // per[at], "offset": offset[at] + k % per[at] * size[at]})

    return ranked.withColumn("place_", place("length", "rank_")).select(*columns, "place_.sequence_id", "place_.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of each sequence, from packed pieces with ids. A sequence holds at most ``max_len`` ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda p: p["ids"])).alias("ids"))
