"""Passes of a conversion over live node rows. Each adds its edits to the script and returns its findings as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import labels as L
from ..operators import lists as Li, references as R, tables as T
from ..operators.edit_script import EditScript, numbers, outside, place, word_of, words_of_range
from ..operators.scan import last_value, row_number, scan
from ..session import durable
from ..sources import html as S

HEADING = "^h[1-6]$"
SIBLINGS = ["doc_id", "parent"]


def _words(value) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda x: x != "")


def _without(style, name: str) -> Column:
    """An inline style without one property, ready for another one to follow."""
    rest = L.strip(F.regexp_replace(F.coalesce(style, F.lit("")), rf"(?i){name}\s*:\s*[^;]+\s*(!important)?\s*;?", ""))
    return F.when((rest != "") & ~rest.endswith(";"), F.concat(rest, F.lit(";"))).otherwise(rest)


def front_matter(live: DataFrame, roots: DataFrame, ahead: int = 5, least_text: int = 20, listed_text: int = 100) -> DataFrame:
    """(doc_id, start, end, reason) of what stands in front of the text: a contents heading with the siblings up to the next heading, and
    all siblings before the first chapter heading that content follows. roots(doc_id, root_idx, root_end)."""
    # What the text says is taken from it once; only these answers are ordered and joined, not the texts.
    inner = F.coalesce("inner", F.lit(""))
    is_heading, t = F.col("tag").rlike(HEADING), L.strip(inner)
    entry = t.contains("\t") | (L.has(t, r"\s+\d+\s*$") & (F.length(t) < listed_text))
    rich = F.col("tag").isin("h2", "h3", "h4", "h5", "h6", "table") | ((F.col("tag") == "p") & (F.length(t) > least_text))
    elements = durable(live.where("kind = 'tag'").select(
        "doc_id", F.coalesce("parent_idx", F.lit(-1)).alias("parent"), "node_idx", "end_idx", "tag", F.when(is_heading, L.has(inner, K.TOC_TITLE, True)).alias("contents"),
        F.when(F.col("tag") == "h1", L.has(t, K.LABEL_WORD, True) & ~entry).alias("opens"), rich.alias("rich")))
    groups = elements.where("contents").select(*SIBLINGS).distinct()
    # Only headings are ordered; where a contents heading's part ends, its siblings are looked up by the sixty-fours of nodes it reaches into.
    heads = scan(elements.where("contents IS NOT NULL").select(*SIBLINGS, "node_idx", "contents").join(groups, SIBLINGS, "left_semi"), SIBLINGS, ["node_idx"],
                 {"_next": last_value(F.col("node_idx"), inclusive=False)}, descending=True)
    last = elements.groupBy("doc_id").agg(F.max("node_idx").alias("_last"))
    parts = heads.where("contents").join(last, "doc_id").select(*SIBLINGS, F.col("node_idx").alias("_s"), F.coalesce(F.col("_next") - 1, "_last").alias("_e"))
    parts = numbers(parts.select(*SIBLINGS, "_s", "_e", words_of_range("_s", "_e").alias("_word")))
    near = elements.withColumn("_word", word_of("node_idx")).join(parts, [*SIBLINGS, "_word"]).where("node_idx BETWEEN _s AND _e")
    listed = durable(near.select("doc_id", F.col("node_idx").alias("start"), F.col("end_idx").alias("end"), F.lit("contents").alias("reason")))
    rest = outside(elements.drop("contents"), listed)

    inside = rest.where("opens").join(roots.select("doc_id", "root_idx", "root_end"), "doc_id").where("node_idx > root_idx AND node_idx <= root_end")
    chapters = durable(inside.select(*SIBLINGS, F.col("node_idx").alias("chapter")))
    rows = durable(scan(rest.drop("opens").join(numbers(chapters.select(*SIBLINGS).distinct()), SIBLINGS, "left_semi"), SIBLINGS, ["node_idx"], {"n": row_number()}))
    at = chapters.join(rows.select(*SIBLINGS, F.col("node_idx").alias("chapter"), "n"), [*SIBLINGS, "chapter"])
    follow = at.select(*SIBLINGS, "chapter", F.posexplode(F.sequence(F.col("n") + 1, F.col("n") + ahead)).alias("d", "n"))
    look = follow.join(rows.select(*SIBLINGS, "n", "tag", "rich"), [*SIBLINGS, "n"]).groupBy(*SIBLINGS, "chapter").agg(
        F.min(F.when(F.col("rich"), F.col("d"))).alias("hit"), F.min(F.when(F.col("tag") == "h1", F.col("d"))).alias("stop"))
    first = look.where("hit IS NOT NULL AND (stop IS NULL OR hit < stop)").groupBy("doc_id").agg(F.min(F.struct("chapter", "parent")).alias("f"))
    before = rows.join(first.select("doc_id", F.col("f.parent").alias("parent"), F.col("f.chapter").alias("chapter")), SIBLINGS).where("node_idx < chapter")
    return listed.unionByName(before.select("doc_id", F.col("node_idx").alias("start"), F.col("end_idx").alias("end"), F.lit("before the first chapter").alias("reason")))


def typed_lists(script: EditScript, live: DataFrame, roots: DataFrame) -> DataFrame:
    """Consecutive paragraphs with typed markers become list elements. Returns (doc_id, start, end, type, items, first_value) per list."""
    child = live.join(roots.select("doc_id", "root_idx"), "doc_id").where(F.coalesce("parent_idx", F.lit(-1)) == F.col("root_idx"))
    text = F.when(F.col("tag").isNull(), F.col("text")).otherwise(F.coalesce("inner", F.lit("")))
    children = child.select("doc_id", F.col("node_idx").alias("child_idx"), "tag", text.alias("text"))
    runs = Li.list_runs(children)
    marker = F.coalesce(*[F.nullif(F.length(F.regexp_extract("inner", L.U + p, 0)), F.lit(0)) for p in (K.LIST_ROMAN, K.LIST_ALPHA, K.LIST_DECIMAL)])
    items = durable(runs.join(live.where("tag = 'p'").select("doc_id", F.col("node_idx").alias("child_idx"), "end_idx", marker.alias("n"), "attrs"), ["doc_id", "child_idx"]).withColumnRenamed("child_idx", "node_idx"))
    script.cut(items.select("doc_id", "node_idx", "end_idx", "n"))
    script.rename(items.select("doc_id", "node_idx", F.lit("li").alias("tag")))
    script.attribute(items.select("doc_id", "node_idx", F.explode(F.map_keys("attrs")).alias("name"), F.lit(None).cast("string").alias("value")))
    return items.groupBy("doc_id", "run_id", "type").agg(F.min("node_idx").alias("start"), F.max("end_idx").alias("end"), F.count("*").alias("items"), F.min_by("value", "node_idx").alias("first_value"))


def list_styles(script: EditScript, live: DataFrame, typed: DataFrame) -> DataFrame:
    """Class and marker style of every ordered list, found or typed. Returns (doc_id, position, depth, list_style)."""
    up = F.filter("path", lambda p: p["tag"] == "ol")
    attr = lambda n: F.coalesce(F.col("attrs")[n], F.lit(""))
    found = live.where("tag = 'ol'").select(
        "doc_id", (2 * F.col("node_idx")).alias("list_idx"), (2 * F.try_element_at(up, F.lit(-1))["idx"]).alias("parent_list_idx"), F.size(up).alias("depth"),
        attr("type").alias("type"), _words(F.col("attrs")["class"]).alias("classes"), attr("style").alias("style"))
    made = typed.select("doc_id", (2 * F.col("start") - 1).cast("int").alias("list_idx"), F.lit(None).cast("int").alias("parent_list_idx"), F.lit(0).alias("depth"), "type",
                        F.array(L.list_class("type")).alias("classes"), F.lit("").alias("style"))
    lists = durable(found.unionByName(made))
    styled = durable(Li.list_styles(lists))
    # The style's own type names the class where the list has none.
    own_type = (F.when(F.col("list_style") == "lower-alpha", "a").when(F.col("list_style") == "upper-alpha", "A").when(F.col("list_style") == "lower-roman", "i")
                .when(F.col("list_style") == "upper-roman", "I").otherwise("1"))
    j = lists.join(styled.select("doc_id", "list_idx", "list_style"), ["doc_id", "list_idx"]).withColumn("_class", L.list_class(F.when(F.col("type") != "", F.col("type")).otherwise(own_type)))
    classes = F.array_join(F.array_union("classes", F.array("_class")), " ")
    style = F.concat(_without(F.col("style"), "list-style-type"), F.lit("list-style-type: "), F.col("list_style"), F.lit(" !important;"))
    j = j.where("list_style IS NOT NULL").select("doc_id", "list_idx", F.array(
        F.struct(F.lit("class").alias("name"), classes.alias("value")), F.struct(F.lit("data-list-style").alias("name"), F.col("list_style").alias("value")),
        F.struct(F.lit("style").alias("name"), style.alias("value"))).alias("a"))
    script.attribute(j.where("list_idx % 2 = 0").select("doc_id", (F.col("list_idx") / 2).cast("int").alias("node_idx"), F.inline("a")))
    new = typed.join(j.where("abs(list_idx) % 2 = 1").select("doc_id", ((F.col("list_idx") + 1) / 2).cast("int").alias("start"), F.col("a").alias("styles")), ["doc_id", "start"])
    start = F.when(F.col("first_value") > 1, F.map_from_arrays(F.array(F.lit("start")), F.array(F.col("first_value").cast("string")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    attrs = F.map_concat(F.map_from_arrays(F.array(F.lit("type")), F.array("type")), F.map_from_entries("styles"), start)
    script.wrap(new.select("doc_id", "start", "end", F.lit("ol").alias("tag"), attrs.alias("attrs")))
    return styled.select("doc_id", F.col("list_idx").alias("position"), "depth", "list_style")


def table_parts(live: DataFrame) -> dict[str, DataFrame]:
    """Cells with tables numbered among those that are left, the tables, rows and row groups behind them."""
    live = T.long(live)
    tables = live.where("tag = 'table'").select("doc_id", F.col("ord").alias("old"), "node_idx", "end_idx", "attrs")
    tables = durable(scan(tables, ["doc_id"], ["node_idx"], {"n": row_number()}).select("doc_id", "old", (F.col("n") - 1).cast("int").alias("table_idx"), "node_idx", "end_idx", "attrs"))
    cells = S.html_cells(live).withColumnRenamed("table_idx", "old").join(tables.select("doc_id", "old", "table_idx"), ["doc_id", "old"]).drop("old")
    group = F.try_element_at(F.filter("path", lambda p: p["tag"].isin("thead", "tbody", "table")), F.lit(-1))
    rows = live.where("tag = 'tr'").select("doc_id", F.col("ord").alias("row_idx"), "node_idx", "end_idx", group["idx"].alias("group_idx"), group["tag"].alias("group_tag"))
    inner = F.try_element_at(F.filter("path", lambda p: p["tag"] == "table"), F.lit(-1))["ord"]
    of_table = lambda tag: live.where(F.col("tag") == tag).groupBy("doc_id", inner.alias("old")).agg(F.min_by(F.struct("node_idx", "end_idx"), "node_idx").alias(tag))
    tables = tables.join(of_table("thead"), ["doc_id", "old"], "left").join(of_table("tbody"), ["doc_id", "old"], "left").join(of_table("caption"), ["doc_id", "old"], "left")
    return {"cells": durable(cells), "tables": durable(tables.drop("old")), "rows": durable(rows)}


def table_headers(script: EditScript, parts: dict[str, DataFrame], overrides: DataFrame | None = None) -> DataFrame:
    """Title rows become captions, rows are promoted to or demoted from headers. Returns the cells with their new roles and the title rows."""
    cells, tables, rows = (T.long(parts[name]) for name in ("cells", "tables", "rows"))
    fixed = durable(T.repair_table_headers(cells, overrides))
    by_row = fixed.groupBy("doc_id", "table_idx", "row_idx").agg(F.max("role").alias("role"), F.max(F.when(F.col("role") == "caption", L.strip("text"))).alias("title"))
    r = durable(by_row.join(rows, ["doc_id", "row_idx"]).join(tables.select("doc_id", "table_idx", F.col("node_idx").alias("t_idx"), "thead", "tbody", "caption"), ["doc_id", "table_idx"]))
    titles = r.where("role = 'caption'")
    script.delete(titles.select("doc_id", F.col("node_idx").alias("start"), F.col("end_idx").alias("end")))
    script.first(titles.where("caption IS NULL").select("doc_id", F.col("t_idx").alias("node_idx"), F.lit("caption").alias("tag"), F.col("title").alias("text")))
    promoted, demoted = r.where("role = 'header'"), r.where("role = 'body' AND group_tag = 'thead' AND tbody IS NOT NULL")
    # A promoted row goes behind the rows of the head, or into a head of its own in front of the table.
    script.move(promoted.where("thead IS NOT NULL").select("doc_id", F.col("node_idx").alias("start"), F.col("end_idx").alias("end"), script.back(F.col("thead.node_idx"), F.col("thead.end_idx"), 0).alias("at")))
    alone = promoted.where("thead IS NULL")
    script.move(alone.select("doc_id", F.col("node_idx").alias("start"), F.col("end_idx").alias("end"), place(2 * F.col("t_idx"), 3, 1).alias("at")))
    script.write(alone.select("doc_id", place(2 * F.col("t_idx"), 3, 0).alias("at"), F.lit("<thead>").alias("markup")))
    script.write(alone.select("doc_id", place(2 * F.col("t_idx"), 3, 2).alias("at"), F.lit("</thead>").alias("markup")))
    # Each demoted row is put in front of the body, so the last one comes first.
    script.move(demoted.select("doc_id", F.col("node_idx").alias("start"), F.col("end_idx").alias("end"), script.front(F.col("tbody.node_idx"), -F.col("node_idx")).alias("at")))
    heads = r.where("thead IS NOT NULL").groupBy("doc_id", "table_idx", F.col("thead.node_idx").alias("node_idx")).agg(
        F.count_if((F.col("group_tag") == "thead") & (F.col("role") != "caption") & ~((F.col("role") == "body") & F.col("tbody").isNotNull())).alias("kept"), F.count_if(F.col("role") == "header").alias("new"))
    script.unwrap(heads.where("kept = 0 AND new = 0").select("doc_id", "node_idx"))
    changed = fixed.where("role IN ('header', 'body')").join(cells.select("doc_id", "table_idx", "row_idx", "cell_idx", F.col("in_thead").alias("was")), ["doc_id", "table_idx", "row_idx", "cell_idx"]).where("role = 'header' OR was")
    script.rename(changed.select("doc_id", F.col("cell_idx").alias("node_idx"), "tag"))
    script.attribute(changed.select("doc_id", F.col("cell_idx").alias("node_idx"), F.lit("scope").alias("name"), F.when(F.col("role") == "header", "col").alias("value")))
    return fixed


def table_layout(script: EditScript, live: DataFrame, parts: dict[str, DataFrame], fixed: DataFrame, settings, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Alignment, scope and placement of what the header repair left. settings has align_mode, col1 to col3, coln and header."""
    key = ["doc_id", "table_idx", "row_idx", "cell_idx"]
    live, parts = T.long(live), {name: T.long(df) for name, df in parts.items()}
    now = fixed.where("role <> 'caption'").select(*key, "tag", "in_thead", "scope", "text").join(parts["cells"].select(*key, "colspan", "rowspan"), key)
    grid = durable(T.table_grid(now))
    own = live.where("tag IN ('td', 'th')").select("doc_id", F.col("node_idx").alias("cell_idx"), "attrs")
    aligned = durable(T.align_cells(grid, settings.align_mode, settings.col1, settings.col2, settings.col3, settings.coln, settings.header, overrides))
    # A cell of a nested table has an alignment in each table around it; the innermost comes last.
    innermost = aligned.groupBy("doc_id", "cell_idx").agg(F.max_by("align", "table_idx").alias("align"))
    a = innermost.join(own, ["doc_id", "cell_idx"])
    classes = F.filter(_words(F.col("attrs")["class"]), lambda c: ~c.startswith("manual-align-"))
    style = lambda attrs, align: F.concat(_without(attrs["style"], "text-align"), F.lit(" text-align: "), align, F.lit(" !important;"))
    script.attribute(a.select("doc_id", F.col("cell_idx").alias("node_idx"), F.inline(F.array(
        F.struct(F.lit("class").alias("name"), F.array_join(F.concat(classes, F.array(F.concat(F.lit("manual-align-"), "align"))), " ").alias("value")),
        F.struct(F.lit("style").alias("name"), style(F.col("attrs"), F.col("align")).alias("value"))))))
    cell = F.try_element_at(F.filter("path", lambda p: p["tag"].isin("td", "th")), F.lit(-1))["idx"]
    inside = live.where("tag IN ('p', 'span')").select("doc_id", "node_idx", "attrs", cell.alias("cell_idx")).where("cell_idx IS NOT NULL").join(innermost, ["doc_id", "cell_idx"])
    script.attribute(inside.select("doc_id", "node_idx", F.lit("style").alias("name"), style(F.col("attrs"), F.col("align")).alias("value")))
    scope = T.header_scope(grid)
    script.attribute(scope.groupBy("doc_id", F.col("cell_idx").alias("node_idx")).agg(F.min_by("scope", "table_idx").alias("value")).select("doc_id", "node_idx", F.lit("scope").alias("name"), "value"))
    tables = parts["tables"].select("doc_id", "table_idx", "node_idx", _words(F.col("attrs")["class"]).alias("classes"), F.col("attrs")["class"].isNotNull().alias("had"))
    none = live.sparkSession.createDataFrame([], f"doc_id {live.schema['doc_id'].dataType.simpleString()}, table_idx int, kind string, mode string")
    placed = durable(T.place_tables(tables.drop("had"), none if overrides is None else overrides))
    j = tables.select("doc_id", "table_idx", "node_idx", "had").join(placed, ["doc_id", "table_idx"]).where("had OR size(classes) > 0")
    script.attribute(j.select("doc_id", "node_idx", F.lit("class").alias("name"), F.when(F.size("classes") > 0, F.array_join("classes", " ")).alias("value")))
    return {"alignment": aligned, "scope": scope, "placement": placed}


def citations(script: EditScript, live: DataFrame, segments: DataFrame, refs: DataFrame, decisions: DataFrame, skip_linked: bool = False) -> DataFrame:
    """Decided citations become links at their Nth place in their block; a citation inside a link gets the link's new target. Returns the placements.
    decisions(doc_id, ref_id, label, display, decision, href)."""
    nth = R.occurrence_index(refs).select("doc_id", "ref_id", F.col("para_idx").alias("block_idx"), "occurrence")
    wanted = decisions.where("decision = 'link'").join(nth, ["doc_id", "ref_id"]).select("doc_id", "block_idx", "label", "display", "href", "occurrence")
    raw = segments.select("doc_id", "block_idx", "seg_idx", "in_link", F.col("raw").alias("text"), "href")
    placed = durable(R.place_links(wanted, raw, skip_linked).join(segments.select("doc_id", "block_idx", "seg_idx", "node_idx"), ["doc_id", "block_idx", "seg_idx"]))
    # A text in nested blocks was found in each of them.
    at = placed.groupBy("doc_id", "node_idx", "start").agg(F.max_by(F.struct("end", "display", "new_href", "action"), F.struct("end", "block_idx")).alias("m")).select("doc_id", "node_idx", "start", "m.*")
    script.links(at.select("doc_id", "node_idx", "start", "end", "display", F.when(F.col("action") == "insert", F.col("new_href")).otherwise("").alias("href")))
    inside = at.where("action = 'update' AND new_href <> ''").join(live.select("doc_id", "node_idx", "link_idx"), ["doc_id", "node_idx"])
    script.attribute(inside.groupBy("doc_id", F.col("link_idx").alias("node_idx")).agg(F.max_by("new_href", "start").alias("value")).select("doc_id", "node_idx", F.lit("href").alias("name"), "value"))
    return placed


def sanitize(script: EditScript, live: DataFrame) -> DataFrame:
    """Only allowed elements, attributes and address schemes stay; underlines inside or around links go. Returns what goes: (doc_id, node_idx, finding, name)."""
    from ..operators.audit import external_scheme

    tags = live.where("kind = 'tag'")
    bad = tags.where(~F.col("tag").isin(*K.ALLOWED_TAGS)).select("doc_id", "node_idx", F.lit("tag").alias("finding"), F.col("tag").alias("name"))
    linked = tags.where("tag = 'u' AND link_idx IS NOT NULL").select("doc_id", "node_idx")
    around = tags.where("tag = 'a'").select("doc_id", F.explode(F.filter("path", lambda p: p["tag"] == "u")).alias("u")).select("doc_id", F.col("u.idx").alias("node_idx"))
    lines = linked.unionByName(around).distinct().select("doc_id", "node_idx", F.lit("underline").alias("finding"), F.lit("u").alias("name"))
    allowed = F.create_map(*[F.lit(x) for tag, names in K.ALLOWED_ATTRS.items() for x in (tag, " " + names + " ")])
    a = tags.select("doc_id", "node_idx", "tag", F.explode("attrs").alias("name", "value"))
    ok = lambda names: F.coalesce(F.contains(names, F.concat(F.lit(" "), "name", F.lit(" "))), F.lit(False))
    scheme = external_scheme("value")
    unsafe = F.col("name").isin("href", "src") & (scheme != "") & ~scheme.isin(*K.ALLOWED_SCHEMES)
    known = ok(F.try_element_at(allowed, F.lit("*"))) | ok(F.try_element_at(allowed, F.col("tag")))
    drop = a.where(~known | unsafe).select("doc_id", "node_idx", F.when(~known, "attribute").otherwise("scheme").alias("finding"), "name")
    script.unwrap(bad.unionByName(lines).select("doc_id", "node_idx").distinct())
    script.attribute(drop.select("doc_id", "node_idx", "name", F.lit(None).cast("string").alias("value")))
    return bad.unionByName(lines).unionByName(drop)
