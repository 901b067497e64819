"""Crosswalk building and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import labels as L
from .references import find_heading_by_full, lookup_titles


def crosswalk_from_map(heading_map: DataFrame, manual_type: str = "chapter") -> DataFrame:
    """Proposed old-to-new labels of the numbered headings; the first use of a label wins.
    The label word is added before normalising so that "One" and "Chapter One" meet."""
    mt = F.lit(manual_type)
    df = heading_map.where(~F.col("ref_key").startswith("_h")).withColumn(
        "old_ref", L.normalize_heading_ref(L.ensure_prefixed("ref_key", mt))).where("old_ref <> ''")
    df = df.groupBy("doc_id", "old_ref").agg(F.min("ord").alias("ord"))
    return df.select("doc_id", "old_ref", L.ensure_prefixed(
        L.normalize_heading_ref(L.convert_numbering("old_ref")), mt).alias("new_ref"), "ord")


def identity_crosswalk(refs: DataFrame, cited_only: bool = True) -> DataFrame:
    """Every label maps to itself; ``cited_only`` keeps Chapter/Section labels."""
    df = refs.where(L.has("label", K.CITED_LABEL, True)) if cited_only else refs
    return df.select("doc_id", F.col("label").alias("old_ref"), F.col("label").alias("new_ref")).distinct()


def heading_order(heading_map: DataFrame, manual_type: str = "chapter") -> DataFrame:
    """Position of each label; a repeated label keeps its last position."""
    n = L.normalize_heading_ref("ref_key")
    return (heading_map.where(n != "").groupBy("doc_id", L.ensure_prefixed(n, F.lit(manual_type)).alias("label"))
            .agg(F.max("ord").alias("ord")))


def normalize_crosswalk(cw: DataFrame, manual_type: str = "chapter") -> DataFrame:
    mt = F.lit(manual_type)
    out = cw.select("doc_id", L.canonical_label("old_ref", mt).alias("old_ref"), L.canonical_label("new_ref", mt).alias("new_ref"), "ord")
    return out.where("old_ref <> '' AND new_ref <> ''").groupBy("doc_id", "old_ref").agg(
        F.max_by("new_ref", "ord").alias("new_ref"), F.min("ord").alias("ord"))


def effective_crosswalk(approved: DataFrame, from_map: DataFrame, counters: DataFrame, auto: DataFrame) -> DataFrame:
    """Per document the first source that has any rows: approved, heading map, counters, auto."""
    parts = [d.select("doc_id", "old_ref", "new_ref", F.lit(n).alias("source"), F.lit(i).alias("_r"))
             for i, (n, d) in enumerate((("approved", approved), ("map", from_map), ("counters", counters), ("auto", auto)))]
    rows = reduce(DataFrame.unionByName, parts)
    best = rows.groupBy("doc_id").agg(F.min("_r").alias("_r"))
    return rows.join(best, ["doc_id", "_r"], "left_semi").drop("_r")


def sort_crosswalk(cw: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """By label number, then by document position (unknown positions last)."""
    if order is not None:
        cw = cw.join(order.select("doc_id", F.col("label").alias("old_ref"), F.col("ord").alias("_o")), ["doc_id", "old_ref"], "left")
    else:
        cw = cw.withColumn("_o", F.col("ord"))
    return cw.orderBy("doc_id", L.heading_sort_key("old_ref"), F.col("_o").asc_nulls_last(), "old_ref").drop("_o")


def auto_match_status(refs: DataFrame, index: DataFrame, crosswalk: DataFrame, keep_old: bool = False) -> DataFrame:
    """Whether each reference was matched, matched exactly, and is valid by default."""
    cw = crosswalk.select("doc_id", F.col("old_ref").alias("label"), "new_ref")
    hit = index.select("doc_id", F.col("key").alias("new_ref"), F.col("full").alias("target_full"), F.lit(True).alias("_f"))
    df = refs.join(cw, ["doc_id", "label"], "left").join(hit, ["doc_id", "new_ref"], "left")
    unwrap = lambda c: F.regexp_replace(F.regexp_replace(L.normalize_heading_ref(c), L.U + r"^[\(\[]\s*", ""), L.U + r"\s*[\)\]]$", "")
    old, new = unwrap(F.col("label")), unwrap(F.coalesce("new_ref", F.lit("")))
    found = F.coalesce("_f", F.lit(False))
    exact = found & (old != "") & ((old == new) | (L.drop_label_word(old) == L.drop_label_word(new)))
    return df.select("doc_id", "para_idx", "start", "label", F.coalesce("new_ref", F.lit("")).alias("new_ref"),
                     F.coalesce("target_full", F.lit("")).alias("target_full"), found.alias("found"), exact.alias("exact"),
                     (exact if keep_old else found).alias("default_valid"))


def crosswalk_review(heading_map: DataFrame, crosswalk: DataFrame, index: DataFrame, manual_type: str = "chapter") -> DataFrame:
    """Review rows: suggested target per old label (un-numbered headings by their text), and
    old and new titles that fall back to each other."""
    mt = F.lit(manual_type)
    hm = heading_map.withColumns({"_norm": L.canonical_label("ref_key", mt)})
    cw = crosswalk.where("lower(old_ref) NOT IN ('', 'none')").select("doc_id", "old_ref", "new_ref")
    syn = hm.where("is_synthetic")
    match = find_heading_by_full(syn.select("doc_id", F.col("title").alias("target")), index).select(
        "doc_id", F.col("target").alias("title"), F.col("key").alias("new_ref"))
    srow = syn.join(match, ["doc_id", "title"], "left").select(
        "doc_id", "ord", "ref_key", F.coalesce("new_ref", F.lit("")).alias("new_ref"), F.col("title").alias("old_title"), "is_synthetic")
    num = hm.where("NOT is_synthetic AND _norm <> ''")
    a = cw.select("doc_id", F.col("old_ref").alias("_norm"), F.col("new_ref").alias("_a"))
    b = cw.select("doc_id", F.col("old_ref").alias("ref_key"), F.col("new_ref").alias("_b"))
    nrow = num.join(a, ["doc_id", "_norm"], "left").join(b, ["doc_id", "ref_key"], "left")
    nrow = nrow.withColumn("new_ref", F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")), F.col("ref_key")))
    titles = lookup_titles(nrow.select("doc_id", F.col("ref_key").alias("label")), heading_map)
    nrow = nrow.drop("title").join(titles.withColumnRenamed("label", "ref_key"), ["doc_id", "ref_key"], "left").select(
        "doc_id", "ord", "ref_key", "new_ref", F.coalesce("title", F.lit("")).alias("old_title"), "is_synthetic")
    rows = srow.unionByName(nrow).withColumn("_alt", L.canonical_label("new_ref", mt))
    k = index.select("doc_id", F.col("key").alias("new_ref"), F.col("text").alias("_t1"))
    k2 = index.select("doc_id", F.col("key").alias("_alt"), F.col("text").alias("_t2"))
    rows = rows.join(k, ["doc_id", "new_ref"], "left").join(k2, ["doc_id", "_alt"], "left")
    new_title = F.coalesce(F.nullif("_t1", F.lit("")), F.nullif("_t2", F.lit("")), F.col("old_title"))
    old_title = F.when(F.col("old_title") != "", F.col("old_title")).otherwise(new_title)
    return rows.select("doc_id", "ord", "ref_key", "new_ref", old_title.alias("old_title"), new_title.alias("new_title"),
                       (~F.col("is_synthetic")).alias("checked"))


def apply_crosswalk_review(review: DataFrame, fallback: DataFrame, manual_type: str = "chapter") -> DataFrame:
    """Approved crosswalk of the reviewed rows (the last row of a label wins); documents
    without any approved pair take the fallback crosswalk.

    review(doc_id, ord, included, old_ref, new_ref)
    """
    rows = review.where("included AND old_ref <> '' AND new_ref <> ''")
    approved = normalize_crosswalk(rows, manual_type).select("doc_id", "old_ref", "new_ref")
    rest = fallback.select("doc_id", "old_ref", "new_ref").join(approved.select("doc_id").distinct(), "doc_id", "left_anti")
    return approved.withColumn("source", F.lit("review")).unionByName(rest.withColumn("source", F.lit("fallback")))


def upsert_titles(index: DataFrame, review: DataFrame, manual_type: str = "chapter") -> DataFrame:
    """Headings with reviewed titles; unknown labels become new headings without an id."""
    mt = F.lit(manual_type)
    t = (review.where("included AND old_ref <> '' AND new_ref <> '' AND new_title <> ''")
         .withColumn("key", L.canonical_label("new_ref", mt)).where((F.col("key") != "") & (L.canonical_label("old_ref", mt) != ""))
         .groupBy("doc_id", "key").agg(F.max_by("new_title", "ord").alias("_title")))
    h = index.select("doc_id", "key", F.concat(F.lit("h"), F.col("level").cast("string")).alias("level"), "text", "full", "id")
    j = h.join(t, ["doc_id", "key"], "full_outer")
    full = F.concat("key", F.lit(" - "), "_title")
    return j.select("doc_id", "key", F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("_title", "text").alias("text"),
                    F.coalesce(full, "full").alias("full"), F.coalesce("id", F.lit("")).alias("id"))
