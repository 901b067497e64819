"""Heading and content search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .scan import row_number, scan


def _top(hits: DataFrame, order: list[str], k: int) -> DataFrame:
    """First k matches of each document and query, in document order, with match totals."""
    ranked = scan(hits, ["doc_id", "query"], order, {"rank": row_number()})
    totals = hits.groupBy("doc_id", "query").agg(F.count("*").alias("total"))
    return ranked.where(F.col("rank") <= k).join(totals, ["doc_id", "query"])


def _match(df: DataFrame, queries: list[str], text: Column) -> DataFrame:
    qs = F.array(*[F.lit(q.lower().strip()) for q in queries if q.strip()])
    return df.withColumn("_s", F.lower(text)).withColumn(
        "query", F.explode(F.filter(qs, lambda q: F.contains(F.col("_s"), q)))).drop("_s")


def search_headings(headings: DataFrame, queries: list[str], k: int = 8) -> DataFrame:
    """Headings whose title (leading number stripped) contains the query."""
    title = L.strip("text")
    df = headings.select("doc_id", "ord", title.alias("title"))
    clean = F.regexp_replace("title", r"^\d+(\.\d+)*\s*", "")
    return _top(_match(df, queries, clean), ["ord"], k).select("doc_id", "query", "rank", "total", "ord", "title")


def search_content(blocks: DataFrame, queries: list[str], k: int = 10) -> DataFrame:
    """Blocks of more than 10 characters that contain the query, with a snippet."""
    df = blocks.select("doc_id", "block_idx", L.strip("text").alias("text")).where(F.length("text") > 10)
    out = _top(_match(df, queries, F.col("text")), ["block_idx"], k)
    return out.select("doc_id", "query", "rank", "total", "block_idx", snippet("text", "query").alias("snippet"))


def snippet(text, query, max_length: int = 120) -> Column:
    """40 characters on each side of the first match."""
    t, q = L._c(text), L._c(query)
    at = F.position(F.lower(q), F.lower(t))
    start = F.greatest(F.lit(0), at - 41)
    end = F.least(F.length(t), at - 1 + F.length(q) + 40)
    found = F.concat(F.when(start > 0, "...").otherwise(""), F.substr(t, start + 1, end - start),
                     F.when(end < F.length(t), "...").otherwise(""))
    return (F.when((t == "") | (q == ""), "").when(at == 0, F.concat(F.substring(t, 1, max_length), F.lit("...")))
            .otherwise(found))


def highlight_spans(text, query) -> Column:
    """array<struct(label, start, end)> of every occurrence, case-insensitive."""
    from .references import find_all

    quoted = F.regexp_replace(F.lower(L._c(query)), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return find_all(F.lower(L._c(text)), quoted)
