"""Heading operators: numbering, anchors, keys, order checks, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import labels as L
from ..session import durable
from .binding import bind
from .scan import count_since, last_value, row_number, running_sum, scan

DOC = ["doc_id"]


def number_headings(headings: DataFrame, manual_type: str = "chapter", preserve: bool = False) -> DataFrame:
    """Hierarchical numbers in document order. Headings that already carry a number keep
    it and leave every counter alone; a skipped level prints 0."""
    txt = L.strip("text")
    if preserve:
        return headings.select("*", F.lit(None).cast("string").alias("number"), txt.alias("numbered_text"))
    headings, names = bind(headings, {"_txt": txt}), headings.columns
    txt = F.col("_txt")
    headings = bind(headings, {"_active": ~(L.has(txt, K.ALREADY_NUMBERED, True) | L.has(txt, K.ALREADY_DECIMAL))})
    active, level = F.col("_active"), F.col("level")
    specs = {f"_n{k}": count_since(active & (level == k), active & (level < k)) for k in range(1, 7)}
    out = scan(headings, DOC, ["ord"], specs)
    number = F.array_join(F.slice(F.array(*[F.col(f"_n{k}").cast("string") for k in range(1, 7)]), 1, level), ".")
    number = F.when(active, number)
    new = (F.when(~active, txt)
           .when(level == 1, F.concat(L.manual_prefix(F.lit(manual_type)), F.lit(" "), number, F.lit(" - "), txt))
           .otherwise(F.concat(number, F.lit(" "), txt)))
    return out.select(*names, number.alias("number"), new.alias("numbered_text"))


def stable_map(headings: DataFrame) -> DataFrame:
    """Nth id of every heading signature, one row per heading that carries an id."""
    rows = (bind(headings.select("doc_id", "ord", "text", "id"), {
        "signature": L.heading_signature("text"), "id": L.strip(F.coalesce("id", F.lit("")))})
            .select("doc_id", "ord", "signature", "id").where((F.col("signature") != "") & (F.col("id") != "")))
    return scan(rows, ["doc_id", "signature"], ["ord"], {"nth": row_number()}).select(
        "doc_id", "signature", F.col("nth").cast("long").alias("nth"), "id", "ord")


def apply_stable_map(headings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nth heading of a signature takes the Nth recorded id; the rest stay null."""
    rows = headings.withColumn("signature", L.heading_signature("text"))
    rows = scan(rows, ["doc_id", "signature"], ["ord"], {"nth": row_number()})
    ids = mapping.select("doc_id", "signature", "nth", F.col("id").alias("mapped_id"))
    return rows.join(ids.hint("merge"), ["doc_id", "signature", "nth"], "left")


_FAMILY_OUT = "base string, shifts array<long>"


def _resolve_family(pdf):
    """Walk the contested suffixes of one base slug family (one small row per distinct slug)."""
    import pandas as pd

    taken, shifts = set(), {}
    for parent in sorted(pdf["parent"].unique(), key=len):
        rows = pdf[pdf["parent"] == parent].sort_values("n")
        marks = [0] if parent in taken else []
        blocked = len(marks)
        for n, child, before in zip(rows["n"], rows["child"], rows["before"]):
            if n - blocked >= before:
                marks.append(int(n - blocked))
                blocked += 1
            else:
                taken.add(child)
        shifts[parent] = marks
    for child in taken:
        shifts.setdefault(child, [0])
    doc = pdf["doc_id"].iloc[0]
    rows = [(doc, b, m) for b, m in shifts.items() if m]
    return pd.DataFrame(rows, columns=["doc_id", "base", "shifts"])


def unique_ids(df: DataFrame) -> DataFrame:
    """Give every row of (doc_id, ord, base) a unique ``id``: base, base-1, base-2, ...

    The first free suffix in document order wins. The k-th copy of a base normally takes
    suffix k. A suffix is lost only to a heading whose own slug is literally ``base-n``, so
    those contested slugs are found by an equi-join, reduced to one row each (how many
    copies came first), and only that summary is walked in order.
    """
    keys = ["doc_id", "base"]
    df = durable(df)
    rows = scan(df, keys, ["ord"], {"_k": row_number()}).withColumn("_k", F.col("_k") - 1)
    bases = df.groupBy(*keys).agg(F.count("*").alias("cnt"), F.min("ord").alias("first_ord"))
    pat = r"^(.+)-([1-9]\d{0,17})$"
    kids = bases.where(F.col("base").rlike(pat)).select(
        "doc_id", F.regexp_extract("base", pat, 1).alias("parent"), F.col("base").alias("child"),
        F.regexp_extract("base", pat, 2).cast("long").alias("n"), "first_ord")
    # Repetitive texts are short when compressed, and so Spark would broadcast tables as long as the headings; merge joins keep them out of
    # the driver.
    contested = kids.join(bases.select("doc_id", F.col("base").alias("parent"), "cnt").hint("merge"), ["doc_id", "parent"])
    contested = contested.withColumn("root", F.regexp_replace("parent", r"(?:-[1-9]\d*)+$", ""))
    live = contested.groupBy("doc_id", "root").agg(F.max("cnt").alias("top"), F.count("*").alias("size")).where("top > 1")
    # A suffix beyond copies + contested slugs can never be reached.
    contested = contested.join(live.hint("merge"), ["doc_id", "root"]).where(F.col("n") <= F.col("cnt") + F.col("size") + 1)

    parents = contested.select("doc_id", F.col("parent").alias("base")).distinct()
    copies = df.join(parents.hint("merge"), keys, "left_semi").select(
        "doc_id", F.col("base").alias("parent"), "ord", F.lit(1).alias("copy"),
        F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("n"), F.lit("").alias("root"))
    marks = contested.select("doc_id", "parent", F.col("first_ord").alias("ord"), F.lit(0).alias("copy"), "child", "n", "root")
    before = scan(copies.unionByName(marks), ["doc_id", "parent"], ["ord"], {"before": running_sum(F.col("copy"))})
    before = before.where("child IS NOT NULL").select("doc_id", "root", "parent", "child", "n", "before")
    shifts = before.groupBy("doc_id", "root").applyInPandas(
        _resolve_family, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {_FAMILY_OUT}")

    out = rows.join(shifts.hint("merge"), keys, "left")
    idx = F.col("_k") + F.coalesce(F.size(F.filter("shifts", lambda t: t <= F.col("_k"))), F.lit(0))
    idx = F.when(F.col("shifts").isNull(), F.col("_k")).otherwise(idx)
    return out.select(*df.columns, F.when(idx == 0, F.col("base")).otherwise(
        F.concat("base", F.lit("-"), idx.cast("string"))).alias("id"))


def assign_ids(headings: DataFrame, mapping: DataFrame | None = None, keep_existing: bool = False) -> DataFrame:
    """Ids by priority: kept id, recorded id of the signature, slug of the text."""
    df = headings if "existing_id" in headings.columns else headings.withColumn("existing_id", F.lit(""))
    df = df.withColumn("existing_id", L.strip(F.coalesce("existing_id", F.lit(""))))
    df = df.withColumn("_text", L.strip("text"))
    kept = (F.col("existing_id") != "") & F.lit(keep_existing)
    df = bind(df, {"_slug": L.heading_slug("_text")})
    slug = F.when(F.col("_slug") == "", "heading").otherwise(F.col("_slug"))
    if mapping is not None:
        sig = F.when(~kept, L.heading_signature("_text")).otherwise("")
        df = df.withColumn("signature", sig)
        df = scan(df, ["doc_id", "signature"], ["ord"], {"nth": row_number()})
        ids = mapping.where("signature <> ''").select("doc_id", "signature", "nth", F.col("id").alias("_mid"))
        df = df.join(ids.hint("merge"), ["doc_id", "signature", "nth"], "left")
        source = F.when(kept, "kept").when(F.coalesce("_mid", F.lit("")) != "", "map").otherwise("slug")
        base = F.when(kept, F.col("existing_id")).when(F.coalesce("_mid", F.lit("")) != "", F.col("_mid")).otherwise(slug)
    else:
        source = F.when(kept, "kept").otherwise("slug")
        base = F.when(kept, F.col("existing_id")).otherwise(slug)
    cols = [c for c in headings.columns if c != "existing_id"]
    df = bind(df, {"id_source": source, "base": base}).select(*cols, "existing_id", "id_source", "base")
    return unique_ids(df)


def id_remap(assigned: DataFrame) -> DataFrame:
    """Old id to new id where it changed; the last heading that carried the old id wins."""
    return (assigned.where((F.col("existing_id") != "") & (F.col("existing_id") != F.col("id")))
            .groupBy("doc_id", F.col("existing_id").alias("old_id"))
            .agg(F.max_by("id", "ord").alias("new_id")))


def permalink_stability(old: DataFrame, new: DataFrame) -> DataFrame:
    """Kept, changed, lost and new anchors between two versions of a map."""
    a = old.select("doc_id", "signature", "nth", F.col("id").alias("old_id"))
    b = new.select("doc_id", "signature", "nth", F.col("id").alias("new_id"))
    state = (F.when(F.col("old_id").isNull(), "new").when(F.col("new_id").isNull(), "lost")
             .when(F.col("old_id") == F.col("new_id"), "kept").otherwise("changed"))
    return a.join(b, ["doc_id", "signature", "nth"], "full_outer").withColumn("state", state)


def heading_order_issues(headings: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before them."""
    out = scan(headings, DOC, ["ord"], {"prev_level": last_value(F.col("level"), inclusive=False)})
    return out.where(F.col("level") > F.col("prev_level") + 1)


def heading_audit(headings: DataFrame) -> DataFrame:
    """Order issues plus first-heading and missing-H1 findings."""
    out = scan(headings, DOC, ["ord"], {"prev_level": last_value(F.col("level"), inclusive=False)})
    lvl, prev = F.col("level").cast("string"), F.col("prev_level")
    issue = (F.when(prev.isNull() & (F.col("level") != 1),
                    F.concat(F.lit("First heading is H"), lvl, F.lit(" (expected H1).")))
             .when(F.col("level") > prev + 1,
                   F.concat(F.lit("Heading level skipped from H"), prev.cast("string"), F.lit(" to H"), lvl, F.lit("."))))
    found = out.select("doc_id", "ord", "level", prev, issue.alias("issue")).where("issue IS NOT NULL")
    no_h1 = (headings.groupBy("doc_id").agg(F.min("level").alias("lo")).where("lo > 1")
             .select("doc_id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("int").alias("level"),
                     F.lit(None).cast("int").alias("prev_level"), F.lit("No H1 headings detected.").alias("issue")))
    return found.unionByName(no_h1)


def heading_levels(headings: DataFrame) -> DataFrame:
    return headings.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels_used"),
        F.coalesce(F.max("level"), F.lit(2)).alias("toc_depth"))


def shift_levels(headings: DataFrame, offset: int) -> DataFrame:
    return headings.withColumn("level", F.greatest(F.lit(1), F.least(F.lit(6), F.col("level") + offset)))


def apply_heading_edits(headings: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviewed level (1-6) and non-blank text replace the parsed ones, by heading id."""
    e = edits.select("doc_id", "id", F.col("level").alias("_lvl"), F.col("text").alias("_txt"))
    new_text = L.strip(F.coalesce("_txt", F.lit("")))
    return headings.join(e, ["doc_id", "id"], "left").select(
        *[c for c in headings.columns if c not in ("level", "text")],
        F.when(F.col("_lvl").between(1, 6), F.col("_lvl")).otherwise(F.col("level")).alias("level"),
        F.when(new_text != "", new_text).otherwise(F.col("text")).alias("text"))


def infer_levels(headings: DataFrame, style_map: dict[str, int] | None = None) -> DataFrame:
    """Level from the number in front of the text, never shallower than the current one
    unless a style map says so."""
    cur = F.col("level")
    tokens = L.style_tokens("text") if style_map else L.heading_tokens("text")
    df = headings.withColumn("_t", tokens)
    n = F.size("_t")
    first = F.get("_t", F.lit(0))
    numeric_or_roman = first.rlike(r"(?U)^\d+$") | first.rlike("(?i)^[IVXLCDM]+$")
    eff = F.when((cur > 1) & (n > 1) & numeric_or_roman, n - 1).otherwise(n)
    target = F.when(n > 0, F.least(F.lit(6), F.greatest(cur, eff + 1)))
    if style_map:
        m = F.create_map(*[F.lit(x) for kv in style_map.items() for x in kv])
        t = L.styled_token_type(F.try_element_at("_t", F.lit(-1)), n, m,
                                L.has("text", r"^\s*(?:Chapter|Section)\b", True))
        mapped = F.when(n > 0, F.try_element_at(m, t))
        target = F.coalesce(F.nullif(mapped, F.lit(0)), target)
    return df.withColumn("new_level", F.coalesce(target, cur)).drop("_t")


def heading_keys(headings: DataFrame) -> DataFrame:
    """Label key of every heading.

    A full "Chapter/Section n - title" sets the numbering context; a partial number extends
    it. Each of the six context slots is the last value written to it, so the context is an
    ordered scan per slot rather than a loop over the document.
    """
    has_id = "id" in headings.columns
    df = headings.select("doc_id", "ord", "level", L.strip("text").alias("text"),
                         (L.strip(F.coalesce("id", F.lit(""))) if has_id else F.lit("")).alias("_eid"))
    df = df.where("text <> ''")
    ex = lambda c, p, g, ic=True: F.regexp_extract(c, (L.IU if ic else L.U) + p, g)
    t = F.col("text")
    df = bind(df, {
        "_fp": ex(t, K.FULL_HEADING, 1), "_fn": ex(t, K.FULL_HEADING, 2), "_ft": L.strip(ex(t, K.FULL_HEADING, 3)),
        "_pn": F.rtrim(F.upper(ex(t, K.PARTIAL_HEADING, 1, False)), F.lit(".")),
        "_pt": L.strip(ex(t, K.PARTIAL_HEADING, 2, False))})
    df = df.withColumn("_full", F.col("_fp") != "")
    df = scan(df, DOC, ["ord"], {
        "_prev": last_value(F.when(F.col("_full"), F.col("_fp")), inclusive=False), "_pos": row_number()})
    level = F.col("level")
    partial = ~F.col("_full") & F.col("_prev").isNotNull() & (F.col("_pn") != "") & ~F.col("_pn").isin(*K.NOT_A_NUMBER)
    parts = F.when(F.col("_full"), F.filter(F.split(F.col("_fn"), r"\."), lambda p: p != "")).otherwise(F.split("_pn", r"\."))
    df = bind(df, {"_part": partial, "_p": parts})
    n = F.size("_p")
    sub = F.col("_part") & (n > 1) & (n <= level - 1) & (ex(F.col("_pt"), K.SUB_NUMBER, 1) != "")
    df = bind(df, {"_sub": sub})
    values = (F.when(F.col("_full"), F.col("_p"))
              .when(F.col("_sub"), F.concat("_p", F.array(F.upper(ex(F.col("_pt"), K.SUB_NUMBER, 1)))))
              .otherwise(F.col("_p")))
    title = (F.when(F.col("_full"), F.col("_ft"))
             .when(F.col("_sub"), L.strip(ex(F.col("_pt"), K.SUB_NUMBER, 2)))
             .when(F.col("_part"), F.col("_pt")).otherwise(t))
    df = bind(df, {"_v": values, "_title": title})
    single = F.col("_part") & (n == 1)
    depth = F.when(single, level).otherwise(F.least(F.size("_v"), F.lit(6)))
    df = bind(df, {"_single": single, "_depth": depth})
    slots = {}
    for i in range(6):
        own = F.when(F.col("_single"), F.when(level == i + 1, F.get("_v", F.lit(0)))).otherwise(F.get("_v", F.lit(i)))
        writes = (F.col("_full") | F.col("_part")) & (own.isNotNull() | (F.col("_depth") <= i))
        slots[f"_s{i}"] = last_value(F.when(writes, F.struct(own.alias("x"))))
    df = scan(df, DOC, ["ord"], slots)
    context = F.slice(F.array(*[F.coalesce(F.col(f"_s{i}")["x"], F.lit("?")) for i in range(6)]), 1, F.col("_depth"))
    key = (F.when(F.col("_full"), F.concat("_fp", F.lit(" "), "_fn"))
           .when(F.col("_part"), F.concat("_prev", F.lit(" "), F.array_join(context, ".")))
           .otherwise(F.concat(F.lit("H"), level.cast("string"), F.lit(": "), F.substring(t, 1, 50))))
    df = bind(df, {"_key": key})
    key = F.col("_key")
    full = F.when(F.col("_part"), F.concat(key, F.lit(" - "), F.col("_title"))).otherwise(t)
    slug = F.when(F.col("_eid") != "", F.col("_eid")).when(
        F.col("_full"), L.scrape_slug("_title", drop_digits=True)).otherwise(L.scrape_slug("_title"))
    return df.select("doc_id", "ord", "level", key.alias("key"), F.col("_title").alias("text"), full.alias("full"),
                     slug.alias("id"), (F.col("_pos") - 1).cast("long").alias("order_idx"))


def heading_index(keyed: DataFrame) -> DataFrame:
    """One row per key: position of its first use, content of its last use."""
    return keyed.groupBy("doc_id", "key").agg(
        F.min("ord").alias("first_ord"),
        F.max_by(F.struct("ord", "level", "text", "full", "id", "order_idx"), "ord").alias("v"),
    ).select("doc_id", "key", "first_ord", F.col("v.ord").alias("ord"), F.col("v.level").alias("level"),
             F.col("v.text").alias("text"), F.col("v.full").alias("full"), F.col("v.id").alias("id"),
             F.col("v.order_idx").alias("order_idx"))


def heading_picklist(index: DataFrame) -> DataFrame:
    """Numbered headings in document order, then short un-numbered ones alphabetically."""
    numbered = L.looks_numbered_heading("full")
    short = L.words("text") <= 15
    name = F.lower(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("full")))
    return (index.withColumn("numbered", numbered).where(F.col("numbered") | short)
            .withColumn("sort_text", F.when(F.col("numbered"), "").otherwise(name))
            .orderBy("doc_id", F.col("numbered").desc(), "sort_text", "order_idx"))


def table_of_contents(headings: DataFrame, depth: int = 2, offset: int = 0, manual_type: str = "chapter",
                      numbering_mode: str = "css-counters", leading_entries: bool = False) -> DataFrame:
    """Contents entries: chapter ordinal, parent chapter and displayed text. leading_entries: keep entries in front of the first
    level-1 heading, as the generated list does; the list built in a page leaves them out."""
    eff = F.greatest(F.lit(1), F.least(F.lit(6), F.col("level") - offset))
    df = headings.withColumns({"eff_level": eff, "title": L.strip("text")}).where(F.col("eff_level") <= depth)
    first = headings.where("level = 1").groupBy("doc_id").agg(F.min_by("text", "ord").alias("_h1"))
    df = scan(df, DOC, ["ord"], {
        "chapter_no": running_sum(F.when(F.col("eff_level") == 1, 1).otherwise(0)),
        "chapter_ord": last_value(F.when(F.col("eff_level") == 1, F.col("ord")))})
    df = df.join(first, "doc_id", "left")
    label = F.when(L.has(L.strip(F.coalesce("_h1", F.lit(""))), r"^Section\s+", True), "Section").otherwise(
        F.lit("Section" if manual_type == "section" else "Chapter"))
    t = F.col("title")
    labelled = (F.lower(t).startswith(F.lower(label)) | L.has(t, r"^(?:Chapter|Section)(?:\s|[.:-]|$)", True)
                | L.has(t, r"^\d+\.?\s") | L.has(t, r"^[IVXLCDM]+\.?\s"))
    shown = F.when((F.col("eff_level") == 1) & F.lit(numbering_mode == "css-counters") & ~labelled,
                   F.concat(label, F.lit(" "), F.col("chapter_no").cast("string"), F.lit(". "), t)).otherwise(t)
    return df.where(F.lit(leading_entries) | (F.col("eff_level") == 1) | F.col("chapter_ord").isNotNull()).select(
        "doc_id", "ord", "eff_level", F.col("chapter_no").cast("long").alias("chapter_no"), "chapter_ord",
        shown.alias("display"))


def html_escape(c) -> Column:
    out = L._c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def toc_lines(headings: DataFrame, depth: int) -> DataFrame:
    """Contents list as one markup line per entry, in order. The closing of a chapter is
    part of the next chapter's line; each document starts and ends with a list tag."""
    df = headings.where(F.col("level") <= depth)
    df = scan(df, DOC, ["ord"], {"_ch": running_sum(F.when(F.col("level") == 1, 1).otherwise(0))})
    link = F.concat(F.lit('"><a href="#'), html_escape("id"), F.lit('">'), html_escape(L.strip("text")), F.lit("</a>"))
    chapter = F.concat(F.when(F.col("_ch") > 1, "</ul></li>").otherwise(""),
                       F.lit('<li class="toc-chapter toc-item toc-level-1'), link,
                       F.lit('<ul class="toc-subsections toc-collapsed">'))
    section = F.concat(F.lit('<li class="toc-section toc-item toc-level-'), F.col("level").cast("string"), link, F.lit("</li>"))
    lines = df.select("doc_id", F.lit(1).alias("part"), "ord",
                      F.when(F.col("level") == 1, chapter).otherwise(section).alias("line"))
    docs = headings.groupBy("doc_id").agg(F.max(F.when(F.lit(depth >= 1), F.col("level") == 1)).alias("open"))
    start = docs.select("doc_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("ord"),
                        F.lit('<ul class="toc-list" aria-labelledby="toc-heading">').alias("line"))
    end = docs.select("doc_id", F.lit(2).alias("part"), F.lit(None).cast("long").alias("ord"),
                      F.when(F.col("open"), "</ul></li></ul>").otherwise("</ul>").alias("line"))
    return lines.unionByName(start).unionByName(end)


def infer_maps(headings: DataFrame) -> DataFrame:
    """(doc_id, kind, key, level): level of the first heading per last token type and per
    full token sequence."""
    tokens = F.when(F.size(L.style_tokens("text")) > 0, L.style_tokens("text")).otherwise(L.heading_tokens("text"))
    df = bind(headings.select("doc_id", "ord", "level", "text"), {"types": L.token_types(tokens)})
    df = df.where((F.size("types") > 0) & ~F.array_contains("types", "") & (F.col("level") > 0))
    rows = df.select("doc_id", "ord", "level", F.inline(F.array(
        F.struct(F.lit("style").alias("kind"), F.element_at("types", -1).alias("key")),
        F.struct(F.lit("sequence").alias("kind"), F.array_join("types", ">").alias("key")))))
    return rows.groupBy("doc_id", "kind", "key").agg(F.min_by("level", "ord").alias("level"))


def marked_style_map(paragraphs: DataFrame) -> DataFrame:
    """Maps read from example headings between the two marker paragraphs of a document."""
    txt = L.strip(F.coalesce("text", F.lit("")))
    start, end = L.has(txt, r"converter\s+style\s+map", True), L.has(txt, r"end\s+style\s+map", True)
    df = paragraphs.withColumn("text", txt).where("text <> ''")
    df = scan(df, DOC, ["para_idx"], {"_in": running_sum(F.when(start, 1).otherwise(0))})
    # Only the first region counts: reading stops at the first end marker inside it.
    df = scan(df, DOC, ["para_idx"], {"_out": running_sum(F.when(end & ~start & (F.col("_in") > 0), 1).otherwise(0))})
    rows = df.where((F.col("_in") > 0) & (F.col("_out") == 0) & ~start)
    rows = rows.select("doc_id", F.col("para_idx").alias("ord"), F.col("level"), "text",
                       L.token_types(L.style_tokens("text")).alias("types"))
    rows = rows.where((F.size("types") > 0) & ~F.array_contains("types", "") & (F.col("level") > 0))
    rows = rows.select("doc_id", "ord", "level", F.inline(F.array(
        F.struct(F.lit("style").alias("kind"), F.element_at("types", -1).alias("key")),
        F.struct(F.lit("sequence").alias("kind"), F.array_join("types", ">").alias("key")))))
    return rows.groupBy("doc_id", "kind", "key").agg(F.min_by("level", "ord").alias("level"))


def merge_sequence_maps(template: DataFrame, source: DataFrame) -> DataFrame:
    """Template map with source entries merged in.

    Single-token entries up to level 3 override the template for root token types and are
    otherwise ignored; every other source entry is added only when missing.
    """
    s = source.where("sequence <> '' AND level IS NOT NULL").select(
        "doc_id", "sequence", F.col("level").alias("src"))
    root_like = ~F.col("sequence").contains(">") & (F.col("src") <= 3)
    override = root_like & F.col("sequence").isin("alpha_upper", "decimal", "roman_upper")
    both = template.select("doc_id", "sequence", F.col("level").alias("tpl")).join(s, ["doc_id", "sequence"], "full_outer")
    level = (F.when(override, F.col("src")).when(F.col("tpl").isNotNull(), F.col("tpl"))
             .when(~root_like, F.col("src")))
    return both.select("doc_id", "sequence", level.alias("level")).where("level IS NOT NULL")
