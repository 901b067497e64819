"""Cross-site boilerplate lines, in Spark expressions only.

Each line with a word is known by the MD5 of its words, lower-cased and single-spaced. Per line one HyperLogLog sketch of the sites that carry it is
built; sketches merge by aggregation, so a line that half of all documents carry is one sketch per task. Where the estimate
is within ``margin`` of a threshold, the line's distinct sites are counted exactly, from its (line, site) pairs; elsewhere the
estimate decides. A line is boilerplate if it is spread over ``min_sites`` sites, a line of ``long_words`` words and more
already over ``long_sites``.

Boilerplate lines are taken out of every document but the one where they come first (smallest id, then place), so that what
they say stays in the corpus once.

Cases: null texts stay null and empty texts empty; lines without a word are never touched; a null site counts as one site of
its own; repeated rows (same id and text) are treated alike, and a first line stays in each of them; a null id comes after all
others; an empty table gives an empty table; other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, let

_WORDS = r"[^\x20\x09-\x0D]+"


def _norm(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _row(docs: DataFrame) -> list[Column]:
    """What stands for a row: its id and its text, so that equal ids of different texts stay apart."""
    return [F.col("doc_id"), F.xxhash64("text").alias("row_hash")]


def spread_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, site, pos, line (16 bytes), n_words of every line with a word."""
    lines = docs.where("text IS NOT NULL").select(*_row(docs), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).withColumn("norm", _norm(F.col("raw")))
    words = F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1
    return lines.select("doc_id", "row_hash", "site", "pos", F.unhex(F.md5("norm")).alias("line"), words.alias("n_words"))


def boilerplate(docs: DataFrame, min_sites: int = 3, long_words: int = 50, long_sites: int = 2, precision: int = 10, margin: float = 0.2) -> DataFrame:
    """line, sites (exact near the threshold, else estimated) and its first place (doc_id, row_hash, pos)."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("pos"), F.col("row_hash"))
    # One row per line and site; the sketches and the exact counts both read these, so a line on many documents weighs no more than its sites.
    sites = durable(spread_lines(docs).groupBy("line", "site").agg(F.min(place).alias("first"), F.max("n_words").alias("n_words"), F.count("*").alias("n")), "line-sites")
    found = sites.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(precision)).alias("sketch"), F.min("first").alias("first"), F.max("n_words").alias("n_words"), F.sum("n").alias("n"))
    limit = F.when(F.col("n_words") >= long_words, long_sites).otherwise(min_sites)
    found = found.where(F.col("n") >= limit).select("line", "first", limit.alias("limit"), F.hll_sketch_estimate("sketch").cast("double").alias("estimate"))
    found = durable(found.where(F.col("estimate") >= F.col("limit") * (1 - margin) - 0.5), "spread")
    near = found.where(F.col("estimate") <= F.col("limit") * (1 + margin) + 0.5)
    exact = sites.select("line").join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("exact"))
    out = found.join(exact, "line", "left").withColumn("sites", F.coalesce(F.col("exact").cast("double"), "estimate"))
    return out.where(F.col("sites") >= F.col("limit")).select("line", "sites", "first")


def removed_places(docs: DataFrame, **options) -> DataFrame:
    """doc_id, row_hash and the places (from 0) of the lines to take out, for rows that lose a line."""
    marked = durable(boilerplate(docs, **options), "boilerplate")
    lines = spread_lines(docs).select("doc_id", "row_hash", "pos", "line")
    hits = lines.join(marked.select("line", "first"), "line").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_hash") == F.col("first.row_hash")) & (F.col("pos") == F.col("first.pos"))))
    return hits.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("places"))


def without_boilerplate(docs: DataFrame, count_as: str | None = None, **options) -> DataFrame:
    """The rows and columns of docs, with the lines taken out of text and n_chars (if there) counted anew. count_as: name of an
    added column with the number of lines taken out."""
    mine = removed_places(docs.select("doc_id", "text", "source"), **options)
    a, b, c = fresh(docs, "_own_id"), fresh(docs, "_own_hash"), fresh(docs, "_places")
    mine = durable(mine.toDF(a, b, c), "places")
    out = docs.join(mine, F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b)), "left")
    # The places that stay, by a hashed difference, so that a text of many lines takes linear time.
    kept = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(c)), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col(c).isNull(), F.col("text")).otherwise(kept)
    cols = {"text": text} | ({"n_chars": F.when(F.col(c).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    if count_as:
        cols[count_as] = F.coalesce(F.size(c), F.lit(0))
    return out.withColumns(cols).select(*docs.columns, *([count_as] if count_as else []))
