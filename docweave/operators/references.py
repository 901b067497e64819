"""Citation operators: extraction, matching, anchor resolution, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import labels as L
from ..functions import urls as U
from ..session import durable
from .binding import bind
from .paragraphs import likely_level

PATTERN = L.IU + "(" + K.CITATION + ")"


def find_all(text, pattern: str | Column) -> Column:
    """array<struct(label, start, end)> of all matches with character offsets."""
    t = L._c(text)
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.split(t, pat, -1)
    hits = F.regexp_extract_all(t, pat, F.lit(0))
    empty = F.array().cast("array<struct<label:string,start:int,end:int>>")
    init = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i"), empty.alias("out"))

    def step(a, m):
        start = a["pos"] + F.length(F.get(gaps, a["i"]))
        end = start + F.length(m)
        return F.struct(end.alias("pos"), (a["i"] + 1).alias("i"), F.concat(
            a["out"], F.array(F.struct(m.alias("label"), start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(hits, init, step, lambda a: a["out"])


def extract_references(blocks: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Every citation of every block with offsets, and whether it overlaps a linked segment."""
    refs = (blocks.where(F.col("text").rlike(PATTERN))
            .select("doc_id", F.col("block_idx").alias("para_idx"), F.col("text").alias("para_text"),
                    F.inline(find_all("text", PATTERN)))
            .where(L.is_reference_label("label")))
    if segments is None:
        return refs
    linked = linked_references(refs, segments).select("doc_id", "para_idx", "start", F.lit(True).alias("_l"))
    return refs.join(linked, ["doc_id", "para_idx", "start"], "left").withColumn(
        "is_linked", F.coalesce("_l", F.lit(False))).drop("_l")


def linked_references(refs: DataFrame, segments: DataFrame) -> DataFrame:
    """Citations that overlap a linked segment of their block (interval semi-join)."""
    s = segments.where("in_link").alias("s")
    r = refs.alias("r")
    return r.join(s, (F.col("r.doc_id") == F.col("s.doc_id")) & (F.col("r.para_idx") == F.col("s.block_idx"))
                  & (F.col("r.start") < F.col("s.end")) & (F.col("r.end") > F.col("s.start")), "left_semi")


def extract_references_docx(paragraphs: DataFrame) -> DataFrame:
    """Citations of body paragraphs. Headings, dot leaders and page-number lines are
    skipped, and so is a leading label that reads as a heading title."""
    t = F.col("text")
    df = bind(paragraphs, {"text": L.strip(F.coalesce("text", F.lit("")))}).where("text <> ''")
    df = bind(df, {"_lvl": likely_level("text")}).where("_lvl = 0")
    df = df.where(~L.has("text", r"\.{3,}|\t+\d+$") & t.rlike(PATTERN))
    df = df.select("doc_id", "para_idx", F.col("text").alias("para_text"), F.inline(find_all("text", PATTERN)))
    df = df.where(L.is_reference_label("label"))
    rest = F.regexp_replace(L.strip(F.substr("para_text", F.col("end") + 1)), L.U + r"^[\s\.\-:–—]+", "")
    before = F.split(rest, L.U + r"\.\s+[A-Z]", 2).getItem(0)
    reads_as_title = ((F.col("start") == 0) & rest.rlike(r"^\p{Lu}") & (L.words(before) <= 15) & (F.length(before) < 100))
    return df.where(~reads_as_title)


def with_ref_ids(refs: DataFrame) -> DataFrame:
    return refs.withColumn("ref_id", L.ref_id("para_idx", "start", "label"))


def occurrence_index(refs: DataFrame) -> DataFrame:
    """Ordinal among equal labels of one paragraph (a paragraph is one text cell)."""
    w = Window.partitionBy("doc_id", "para_idx", F.lower(L.collapse_ws("label"))).orderBy("start")
    return refs.withColumn("occurrence", (F.rank().over(w) - 1).cast("int"))


def candidate_labels(label, manual_type: str = "chapter") -> Column:
    """Ordered, de-duplicated candidate keys of a label."""
    return _candidates(L.convert_numbering(label), L.full_roman_numbering(label), manual_type)


def _candidates(pred: Column, roman: Column, manual_type: str) -> Column:
    low = F.lower(pred)
    swap = (F.when(low.startswith("chapter "), F.regexp_replace(pred, "^Chapter ", "Section "))
            .when(low.startswith("section "), F.regexp_replace(pred, "^Section ", "Chapter ")))
    cands = F.filter(F.array(pred, swap, roman), lambda c: c.isNotNull())
    if manual_type not in K.SECTION_TYPES:
        cands = F.flatten(F.transform(cands, lambda c: F.when(
            F.lower(c).startswith("section "),
            F.array(F.regexp_replace(c, "^Section ", "Chapter "), c)).otherwise(F.array(c))))
    return F.array_distinct(cands)


def match_references(refs: DataFrame, keys: DataFrame, manual_type: str = "chapter") -> DataFrame:
    """Old label to heading key. Works on distinct labels per document."""
    first = F.split(F.regexp_extract("label", L.IU + r"^(?:Chapter|Section)\s+([^\s]+)", 1), r"\.").getItem(0)
    lead = F.coalesce(first.try_cast("long"), L.roman_to_int(first).cast("long"))
    labels = (refs.where(L.has("label", K.CITED_LABEL, True))
              .groupBy("doc_id", F.col("label").alias("old_ref"))
              .agg(F.min(F.struct("para_idx", "start")).alias("_at")))
    labels = bind(labels.withColumn("label", F.col("old_ref")), {"_lead": lead}).where("NOT coalesce(_lead > 50, false)")
    labels = bind(labels, {"predicted": L.convert_numbering("label"), "_rom": L.full_roman_numbering("label")})
    labels = bind(labels, {"cands": _candidates(F.col("predicted"), F.col("_rom"), manual_type)})
    probes = labels.select("doc_id", "old_ref", "predicted", "_at", F.posexplode("cands").alias("rank", "key"))
    known = keys.select("doc_id", "key").distinct().withColumn("_hit", F.lit(1))
    best = (probes.join(known.hint("merge"), ["doc_id", "key"], "left").groupBy("doc_id", "old_ref", "predicted", "_at")
            .agg(F.min(F.when(F.col("_hit") == 1, F.struct("rank", "key")))["key"].alias("matched")))
    parts = F.split(F.regexp_extract("predicted", L.IU + r"^(?:Chapter|Section)\s+(.+)$", 1), r"\.")
    usable = ~F.coalesce(F.exists(parts, lambda p: p.try_cast("long") > 50), F.lit(False))
    return (best.where(F.col("matched").isNotNull() | usable)
            .select("doc_id", "old_ref", F.coalesce("matched", "predicted").alias("new_ref"),
                    F.col("matched").isNotNull().alias("matched"),
                    F.col("_at.para_idx").alias("first_para"), F.col("_at.start").alias("first_start")))


def _lookup(probes: DataFrame, lookups: DataFrame) -> DataFrame:
    """(_id, answer): earliest step with a usable answer; inside a step the first heading in order. Both sides are as long as the corpus but short when
    compressed, so Spark would take them into the driver: merge joins do not. What is asked for goes by its number, its texts are not moved again."""
    hits = probes.join(lookups.hint("merge"), ["doc_id", "kind", "value"]).select("_id", "step", "answer", "lord").repartition("_id")
    per_step = hits.groupBy("_id", "step").agg(F.min_by("answer", "lord").alias("answer"))
    return per_step.where("answer <> ''").groupBy("_id").agg(F.min_by("answer", "step").alias("answer"))


def _asked(df: DataFrame) -> DataFrame:
    """Distinct rows, numbered; written, so that the numbers hold."""
    return durable(df.distinct().withColumn("_id", F.monotonically_increasing_id()))


def _lookup_table(headings: DataFrame, answer, *pairs) -> DataFrame:
    rows = headings.select("doc_id", F.col("ord").alias("lord"), answer.alias("answer"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in pairs])))
    return rows.where("value <> ''").groupBy("doc_id", "kind", "value").agg(
        F.min_by("answer", "lord").alias("answer"), F.min("lord").alias("lord"))


def _probes(df: DataFrame, items) -> DataFrame:
    rows = df.select("doc_id", "_id", F.inline(F.array(*[
        F.struct(F.lit(step).alias("step"), F.lit(k).alias("kind"), v.alias("value")) for step, k, v in items])))
    return rows.where("value IS NOT NULL AND value <> ''")


def find_heading_by_full(targets: DataFrame, index: DataFrame) -> DataFrame:
    """First heading in order equal to a text: raw, normalised, or by its title."""
    table = _lookup_table(index, F.col("key"), ("full", F.col("full")),
                          ("norm", L.fulltext_key("full")), ("norm", L.fulltext_key("text")))
    t = _asked(targets.select("doc_id", "target"))
    probes = _probes(t, [(0, "full", F.col("target")), (0, "norm", L.fulltext_key("target"))])
    found = _lookup(probes, table)
    return t.join(found.withColumnRenamed("answer", "key").hint("merge"), "_id", "left").drop("_id")


def lookup_titles(refs: DataFrame, heading_map: DataFrame) -> DataFrame:
    """Title of a label: exact key, normalised key, key without its word, then the first
    key in order that normalises to the same label."""
    hm = heading_map.where("title <> ''")
    nk = L.normalize_heading_ref("ref_key")
    table = _lookup_table(hm, F.col("title"), ("key", F.col("ref_key")), ("scan", nk), ("scan", L.drop_label_word(nk)))
    r = _asked(refs.select("doc_id", "label"))
    n = L.normalize_heading_ref("label")
    bare = L.drop_label_word(n)
    probes = _probes(r, [
        (0, "key", F.col("label")), (1, "key", n), (2, "key", bare), (3, "scan", n), (3, "scan", bare)])
    found = _lookup(probes, table)
    return r.join(found.withColumnRenamed("answer", "title").hint("merge"), "_id", "left").drop("_id")


def resolve_anchors(decisions: DataFrame, index: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """Heading id of each (label, display, target): candidates in the order target,
    crosswalk, display; per candidate key, full text, stripped label, title; at the end a
    slug that equals a live id."""
    d = _asked(decisions.select("doc_id", "label", F.coalesce("display", F.lit("")).alias("display"),
                                F.coalesce("target", F.lit("")).alias("target")))
    if crosswalk is not None:
        cw = crosswalk.select("doc_id", F.col("old_ref").alias("label"), L.strip("new_ref").alias("cross"))
        d = d.join(cw.hint("merge"), ["doc_id", "label"], "left")
    else:
        d = d.withColumn("cross", F.lit(None).cast("string"))
    # Both are written before anything is built on them.
    d, index = durable(d), durable(index)
    hid = L.strip(F.coalesce("id", F.lit("")))
    table = _lookup_table(index, hid, ("key", F.col("key")), ("full", F.col("full")),
                          ("norm", L.fulltext_key("full")), ("norm", L.fulltext_key("text")),
                          ("title", F.lower(L.strip("text"))), ("id", hid))
    names = ("target", "cross", "display")
    items, probe_rows = [], bind(d.where("label IS NOT NULL"), {f"_s_{n}": L.strip_label_prefix(F.col(n)) for n in names})
    for i, name in enumerate(names):
        c = F.col(name)
        stripped = F.nullif(F.col(f"_s_{name}"), c)
        items += [(10 * i, "key", c), (10 * i + 1, "full", c), (10 * i + 1, "norm", L.fulltext_key(c)),
                  (10 * i + 2, "full", stripped), (10 * i + 2, "norm", L.fulltext_key(stripped)),
                  (10 * i + 3, "title", F.lower(stripped)),
                  (100 + 2 * i, "id", L.heading_slug(c)), (101 + 2 * i, "id", L.heading_slug(F.col(f"_s_{name}")))]
    found = _lookup(_probes(probe_rows, items), table)
    return d.join(found.withColumnRenamed("answer", "anchor").hint("merge"), "_id", "left").drop("_id")


def locate_blocks(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block of each reference: same paragraph index when it holds the label, else equal
    text, else the first block (grouped by tag, then in order) that holds the label.

    blocks(doc_id, block_idx, tag, text, p_idx): p_idx counts paragraphs outside tables.
    """
    tag_rank = F.array_position(F.array(*[F.lit(t) for t in K.LOCATE_TAGS]), F.col("tag"))
    b = (blocks.where(F.col("tag").isin(*K.LOCATE_TAGS)).select(
        "doc_id", F.col("block_idx").alias("b_idx"), "p_idx", L.collapse_ws("text").alias("norm"),
        F.struct(tag_rank.alias("t"), F.col("block_idx").alias("i")).alias("place")))
    r = refs.select("doc_id", "ref_id", "para_idx", "para_text", "label")
    need = r.select("doc_id", "label").distinct()
    step1 = (r.join(b.where("p_idx IS NOT NULL").withColumnRenamed("p_idx", "para_idx").hint("merge"), ["doc_id", "para_idx"])
             .where(L.contains_label("norm", "label")).select("doc_id", "ref_id", F.lit(1).alias("step"), "b_idx"))
    by_text = b.groupBy("doc_id", "norm").agg(F.min_by("b_idx", "place").alias("b_idx"))
    step2 = (r.withColumn("norm", L.collapse_ws("para_text")).where("norm <> ''")
             .join(by_text.hint("merge"), ["doc_id", "norm"]).select("doc_id", "ref_id", F.lit(2).alias("step"), "b_idx"))
    # A guarded label ends in a whole dotted token, so labels meet only blocks that hold
    # that token instead of every block of the document.
    token = lambda c: F.regexp_extract(F.lower(c), L.U + r"(\S+)$", 1)
    tokens = b.select("doc_id", "b_idx", "norm", "place", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("norm"), F.lit(L.U + r"\w+(?:\.\w+)*"), F.lit(0)))).alias("tok"))
    step3 = (need.withColumn("tok", token(L.collapse_ws("label"))).join(tokens.hint("merge"), ["doc_id", "tok"])
             .where(L.contains_label("norm", "label"))
             .groupBy("doc_id", "label").agg(F.min_by("b_idx", "place").alias("b_idx"))
             .join(r.select("doc_id", "label", "ref_id").hint("merge"), ["doc_id", "label"])
             .select("doc_id", "ref_id", F.lit(3).alias("step"), "b_idx"))
    found = step1.unionByName(step2).unionByName(step3).groupBy("doc_id", "ref_id").agg(
        F.min(F.struct("step", "b_idx")).alias("m"))
    return r.join(found.hint("merge"), ["doc_id", "ref_id"], "left").select(
        "doc_id", "ref_id", F.col("m.b_idx").alias("block_idx"), F.col("m.step").alias("step"))


def nearest_heading(blocks: DataFrame, headings: DataFrame) -> DataFrame:
    """Last heading at or before each block; "Introduction" when there is none.
    Both sides carry ``pos``, the document position."""
    from .scan import last_value, scan

    h = headings.select("doc_id", "pos", F.lit(0).alias("_b"), F.col("text").alias("_h"), F.lit(None).cast("long").alias("block_idx"))
    b = blocks.select("doc_id", "pos", F.lit(1).alias("_b"), F.lit(None).cast("string").alias("_h"), F.col("block_idx").cast("long"))
    out = scan(h.unionByName(b), ["doc_id"], ["pos", "_b"], {"_last": last_value(F.col("_h"))})
    return out.where("_b = 1").select("doc_id", "block_idx", "pos", F.coalesce("_last", F.lit("Introduction")).alias("heading"))


def live_ids(headings: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    ids = headings.select("doc_id", L.strip("id").alias("id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("doc_id", L.strip("id").alias("id")))
    docs = headings.select("doc_id").distinct()
    reserved = docs.select("doc_id", F.explode(F.array(*[F.lit(x) for x in K.RESERVED_IDS])).alias("id"))
    return ids.where("id <> ''").unionByName(reserved).distinct()


def dead_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """In-page links whose target id does not exist."""
    h = L.strip("href")
    target = F.substr(h, F.lit(2))
    inner = links.where(h.startswith("#") & (h != "#")).withColumn("target", target)
    inner = inner.where(~F.col("target").isin(*K.RESERVED_IDS))
    return inner.join(ids.select("doc_id", F.col("id").alias("target")), ["doc_id", "target"], "left_anti")


def rewrite_internal_hrefs(links: DataFrame, remap: DataFrame) -> DataFrame:
    h = L.strip("href")
    key = F.when(h.startswith("#") & (F.length(h) > 1), F.substr(h, F.lit(2)))
    m = remap.select("doc_id", F.col("old_id").alias("_old"), "new_id")
    return (links.withColumn("_old", key).join(m, ["doc_id", "_old"], "left")
            .withColumn("new_href", F.coalesce(F.concat(F.lit("#"), "new_id"), F.col("href")))
            .drop("_old", "new_id"))


def drop_rebuildable_links(links: DataFrame) -> DataFrame:
    """Links kept when links are rebuilt: in-page links that show a citation go away."""
    return links.where(~(F.col("href").startswith("#") & L.normalize_nbsp("text").rlike(PATTERN)))


def external_links(links: DataFrame) -> DataFrame:
    """Distinct absolute web links per block."""
    h = L.strip("href")
    return (links.where(F.col("block_idx").isNotNull() & h.rlike("^(?i)https?://"))
            .select("doc_id", "block_idx", h.alias("href")).distinct())


def external_links_in_text(refs: DataFrame) -> DataFrame:
    return refs.select("doc_id", "para_idx", F.explode(
        F.regexp_extract_all("para_text", F.lit(L.U + K.TEXT_URL), F.lit(0))).alias("href")).distinct()


def link_decisions(refs: DataFrame, edits: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """What happens to each reference. Ignored wins; otherwise any saved decision applies."""
    kinds = {k: k.replace("reference_", "") for k in K.EDIT_KINDS}
    wide = edits.groupBy("doc_id", "ref_id").agg(*[
        F.max(F.when(F.col("kind") == k, L.strip("value"))).alias(n) for k, n in kinds.items()])
    truthy = lambda c: F.coalesce(F.lower(c).isin("1", "true", "yes", "on"), F.lit(False))
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    cw = crosswalk.select("doc_id", F.col("old_ref").alias("label"), F.col("new_ref").alias("_cw"))
    df = refs.join(wide, ["doc_id", "ref_id"], "left").join(cw, ["doc_id", "label"], "left")
    ignored = truthy(F.col("ignored"))
    acted = truthy(F.col("validations")) | filled("edits") | filled("link_targets") | filled("external_urls")
    display = F.coalesce(F.nullif("edits", F.lit("")), F.nullif("_cw", F.lit("")), F.col("label"))
    return df.select("doc_id", "ref_id", "para_idx", "start", "label",
                     F.when(ignored, "ignored").when(acted, "link").otherwise("none").alias("decision"),
                     display.alias("display"), F.coalesce("link_targets", F.lit("")).alias("target"),
                     F.coalesce("external_urls", F.lit("")).alias("url"))


def stale_anchor_fallback(decisions: DataFrame, ids: DataFrame) -> DataFrame:
    """A saved in-page url whose id is gone falls back to the resolved anchor."""
    u = F.col("url")
    d = decisions.withColumn("_t", F.when(u.startswith("#"), F.substr(u, F.lit(2))))
    live = ids.select("doc_id", F.col("id").alias("_t"), F.lit(True).alias("_live"))
    d = d.join(live, ["doc_id", "_t"], "left")
    stale = u.startswith("#") & F.col("_live").isNull()
    safe = U.sanitize_external_href(F.when(stale, "").otherwise(u))
    href = F.when(safe != "", safe).when(F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit("#"), "anchor")).otherwise("")
    return d.select(*decisions.columns, stale.alias("stale"), href.alias("href"))


def absorb_citation_prefixes(segments: DataFrame) -> DataFrame:
    """Move a citation word standing right before a link into the link text."""
    w = Window.partitionBy("doc_id", "block_idx").orderBy("seg_idx")
    df = segments.withColumns({"_prev": F.lag(F.when(~F.col("in_link"), F.col("text"))).over(w),
                               "_next": F.lead("in_link").over(w)})
    into = F.col("in_link") & F.col("_prev").isNotNull()
    prefix = L.citation_prefix("_prev")["prefix"]
    cut = ~F.col("in_link") & F.coalesce("_next", F.lit(False))
    text = (F.when(into, F.concat(prefix, F.col("text")))
            .when(cut, L.citation_prefix("text")["head"]).otherwise(F.col("text")))
    return df.select("doc_id", "block_idx", "seg_idx", "in_link", text.alias("text"))


def split_anchor_repair(segments: DataFrame, refs: DataFrame, heading_ids: DataFrame) -> DataFrame:
    """Links that hold only the front part of a label whose rest follows as plain text."""
    w = Window.partitionBy("doc_id", "block_idx").orderBy("seg_idx")
    s = segments.withColumns({
        "_tail": F.lead(F.when(~F.col("in_link"), F.col("text"))).over(w), "_a": L.collapse_ws("text")})
    s = s.where(F.col("in_link") & F.col("href").startswith("#") & F.col("_tail").isNotNull() & (F.col("_a") != ""))
    s = s.withColumn("id", F.substr("href", F.lit(2))).join(heading_ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")
    r = refs.select("doc_id", F.col("para_idx").alias("block_idx"), "label", L.collapse_ws("label").alias("_w")).distinct()
    j = s.join(r, ["doc_id", "block_idx"]).where(F.col("_w").startswith(F.col("_a")) & (F.col("_w") != F.col("_a")))
    rest = F.substr("_w", F.length("_a") + 1)
    follow = F.substr("_tail", F.length(rest) + 1, F.lit(2))
    j = j.where(F.col("_tail").startswith(rest) & ~follow.rlike(L.U + r"^[.\-‐‑–—]?\w"))
    best = j.groupBy("doc_id", "block_idx", "label").agg(F.min(F.struct(
        F.col("seg_idx"), F.col("href"), rest.alias("moved"),
        F.substr("_tail", F.length(rest) + 1).alias("tail"))).alias("m"))
    return best.select("doc_id", "block_idx", "label", "m.seg_idx", "m.href", "m.moved", "m.tail")


def place_links(decisions: DataFrame, segments: DataFrame, skip_linked: bool = False) -> DataFrame:
    """Placement of each decided reference: segment and offsets of its Nth occurrence.

    decisions(doc_id, block_idx, label, display, href, occurrence);
    segments(doc_id, block_idx, seg_idx, text, in_link, href) with raw text.
    """
    d = decisions.select("doc_id", "block_idx", "label", "display", F.col("href").alias("new_href"), "occurrence")
    labels = d.select("doc_id", "block_idx", "label").distinct()
    hits = (segments.join(labels, ["doc_id", "block_idx"]).select(
        "doc_id", "block_idx", "seg_idx", "in_link", "text", "label", F.inline(
            F.transform(find_all("text", L.guarded_pattern("label")),
                        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))))
    w = Window.partitionBy("doc_id", "block_idx", "label").orderBy("seg_idx", "start")
    hits = hits.withColumn("occurrence", (F.row_number().over(w) - 1).cast("int"))
    out = d.join(hits, ["doc_id", "block_idx", "label", "occurrence"])
    if skip_linked:
        out = out.where(~F.col("in_link"))
    action = F.when(F.col("in_link"), "update").when(F.col("new_href") != "", "insert").otherwise("text")
    return out.withColumn("action", action)


def rebuild_text(placements: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments with their placements applied, as markup. Offsets refer to the original
    text, so the order of placements does not matter."""
    p = placements.groupBy("doc_id", "block_idx", "seg_idx").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "display", "new_href", "action"))).alias("ps"))
    j = segments.join(p, ["doc_id", "block_idx", "seg_idx"], "left")
    t = F.col("text")
    init = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a, x):
        link = F.when(x["action"] == "insert", F.concat(
            F.lit('<a href="'), x["new_href"], F.lit('">'), x["display"], F.lit("</a>"))).otherwise(x["display"])
        gap = F.substr(t, a["pos"] + 1, F.greatest(x["start"] - a["pos"], F.lit(0)))
        return F.struct(x["end"].alias("pos"), F.concat(a["out"], gap, link).alias("out"))

    built = F.aggregate("ps", init, step, lambda a: F.concat(a["out"], F.substr(t, a["pos"] + 1)))
    return j.select("doc_id", "block_idx", "seg_idx", F.coalesce(built, t).alias("text"))


def label_frequency(refs: DataFrame, k: int = 20) -> DataFrame:
    """Most cited labels (top-k report)."""
    return refs.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(k)


def unmatched_labels(refs: DataFrame, crosswalk: DataFrame) -> DataFrame:
    cw = crosswalk.select("doc_id", F.col("old_ref").alias("label"))
    return refs.join(cw, ["doc_id", "label"], "left_anti").groupBy("label").agg(F.count("*").alias("n"))
