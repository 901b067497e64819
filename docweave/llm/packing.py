"""Packing into length buckets whose boundaries are optimal.

A text's tokens are cut into sequences of at most ``max_len``. A dynamic program over the histogram of all sequence lengths
(``max_len`` numbers, whatever the corpus) chooses at most ``buckets`` boundaries with the least padding, exactly. Inside a
bucket sequences are dealt in a fixed order into batches of ``token_budget`` tokens, padding included; all batches of a bucket
but its last are full.

The running number of a sequence in its bucket comes from two small steps instead of one ordering of the whole bucket:
sequences are dealt by hash into shards of about ``shard`` rows, numbered inside each, and the shards' sizes are added up.

Cases: null and empty texts have no token and give one row with no bucket and no batch; a long text gives as many sequences as
it needs; repeated rows are packed one by one, equal rows in no order among themselves; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, durable


def word_count(text: Column) -> Column:
    """Tokens as words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bpe_count(path: str) -> Callable[[Column], Column]:
    """Tokens of a public tokenizer file (Hugging Face JSON) that every worker finds at ``path``."""
    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if path not in _LOADED:
            _LOADED[path] = Tokenizer.from_file(path)
            _LOADED[path].encode_special_tokens = True
        return pd.Series([len(_LOADED[path].encode(t, add_special_tokens=False).ids) if t else 0 for t in text], dtype="int64")
    return count


_LOADED: dict = {}


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding, the last one being the longest length. Of equal
    solutions the one with fewer buckets and lower ends holds."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.float64)
    before = np.concatenate([[0], np.cumsum(counts)])
    mass = np.concatenate([[0], np.cumsum(counts * lengths)])
    m = len(lengths)
    # cost[j]: least padding of the first j lengths; a bucket of lengths i..j-1 pads to lengths[j-1].
    cost = np.concatenate([[0.0], np.full(m, np.inf)])
    best, choice, steps = None, [], []
    for k in range(min(buckets, m)):
        new, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            option = cost[:j] + (before[j] - before[:j]) * lengths[j - 1] - (mass[j] - mass[:j])
            back[j] = int(np.argmin(option))
            new[j] = option[back[j]]
        steps.append(back)
        cost = new
        if best is None or cost[m] < best:
            best, choice = cost[m], list(steps)
    ends, j = [], m
    for back in reversed(choice):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(back[j])
    return sorted(ends)


def sequences(docs: DataFrame, count: Callable[[Column], Column] = word_count, max_len: int = 2048) -> DataFrame:
    """doc_id, chunk, start, n_tokens, order (a hash that settles ties)."""
    own = docs.select("doc_id", count(F.col("text")).alias("total"), F.xxhash64("text").alias("order"))
    chunks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("total") / max_len) - 1))
    return own.select("doc_id", "order", "total", F.explode(chunks).alias("chunk")).select(
        "doc_id", "chunk", (F.col("chunk") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), F.col("total") - F.col("chunk") * max_len).alias("n_tokens"), "order")


def pack(docs: DataFrame, count: Callable[[Column], Column] = word_count, max_len: int = 2048, buckets: int = 16, token_budget: int = 65_536, shard: int = 2_000) -> DataFrame:
    """doc_id, chunk, start, n_tokens, bucket (padded length), batch (number in its bucket), slot (place in the batch), padding."""
    rows = durable(sequences(docs, count, max_len), "sequences")
    # At most max_len numbers.
    histogram = {r["n_tokens"]: r["count"] for r in rows.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    ends = boundaries(histogram, buckets)
    sizes = {e: sum(c for x, c in histogram.items() if low < x <= e) for low, e in zip([0, *ends], ends)}
    bucket, shards = F.lit(None).cast("long"), F.lit(1)
    for e in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= e, F.lit(e).cast("long")).otherwise(bucket)
        shards = F.when(F.col("n_tokens") <= e, -(-sizes[e] // shard)).otherwise(shards)
    bucket = F.when(F.col("n_tokens") > 0, bucket)
    dealt = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("doc_id", "chunk", "order"), shards.cast("long")))
    full, none = dealt.where("bucket IS NOT NULL"), dealt.where("bucket IS NULL")
    per = full.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = per.select("bucket", "shard", before.alias("before"))
    inner = F.row_number().over(W.partitionBy("bucket", "shard").orderBy("doc_id", "chunk", "n_tokens", "order")) - 1
    numbered = full.withColumn("inner", inner).join(offsets, ["bucket", "shard"]).withColumn("number", F.col("before") + F.col("inner"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket")))
    out = numbered.select("doc_id", "chunk", "start", "n_tokens", "bucket", F.floor(F.col("number") / room).alias("batch"), (F.col("number") % room).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
    null = F.lit(None).cast("long")
    return out.unionByName(none.select("doc_id", "chunk", "start", "n_tokens", "bucket", null.alias("batch"), null.alias("slot"), null.alias("padding")))
