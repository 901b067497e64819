"""HTML pages as node rows, and the block, heading, link, cell and list tables on top."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import labels as L
from ..session import durable

_NODE = ("node_idx int, parent_idx int, depth int, end_idx int, kind string, tag string, ord int, text string, "
         "attrs map<string,string>, path array<struct<idx:int,tag:string,ord:int>>, link_idx int, href string, "
         "inner string, spaced string")
NAMES = "node_idx parent_idx depth end_idx kind tag ord text attrs path link_idx href inner spaced".split()
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_GROUP = {**{t: "block" for t in K.BLOCK_TAGS}, **{t: "heading" for t in _HEADINGS}, "table": "table", "ol": "list",
          "tr": "row"}
_INNER = frozenset((*K.BLOCK_TAGS, *_HEADINGS, "a", "th", "caption"))
_SPACED = frozenset(("td", "th", "caption"))


#: Node rows that leave the parser together; a page is never split.
BATCH_ROWS = 20_000
#: Markup that reads the same in every parser: plain elements with quoted or simple values and text up to the next element. From anything else on, a page goes through HTMLParser.
_PLAIN = re.compile(r'''<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9-]*=(?:"[^"<>&]*"|[a-zA-Z0-9_.-]+(?=[ \t\n>])))*)[ \t\n]*>|([^<]+)''')
_PLAIN_ATTR = re.compile(r'''([a-zA-Z][a-zA-Z0-9-]*)=(?:"([^"]*)"|([a-zA-Z0-9_.-]+))''')
#: Content of scripts and styles, which reads the same in every parser if nothing in it looks like markup.
_RAW_END = {t: re.compile(rf"([^<]*)</{t}>", re.I) for t in ("script", "style")}
#: Elements whose content is not markup.
_OPAQUE = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())


class _Reader(HTMLParser):
    """Open-element stack of one page after the other; the rows of all of them are held as columns, in document order."""

    def __init__(self, tags=None, ancestors=None):
        super().__init__(convert_charrefs=True)
        self.tags, self.ancestors = tags, ancestors
        self.clear()

    def clear(self):
        self.node, self.parent, self.depth, self.end, self.kind, self.tag, self.ord, self.text = [], [], [], [], [], [], [], []
        self.link, self.href, self.inner, self.spaced = [], [], [], []
        # Attributes and ancestors of all rows in a line, with the end of each row's part.
        self.names, self.values, self.attrs_end = [], [], [0]
        self.up_idx, self.up_tag, self.up_ord, self.path_end = [], [], [], [0]

    def read(self, html):
        """Add the rows of one page; how many there were."""
        held = len(self.node)
        self.reset()
        self.n, self.texts, self.pending, self.ords = 0, [], [], {}
        # The tags of open elements, and those of them that rows name as ancestors.
        self.open, self.s_tag, self.p_idx, self.p_tag, self.p_ord = [], [], [], [], []
        at, match, ends = 0, _PLAIN.match, len(html)
        while at < ends:
            m = match(html, at)
            if m is None:
                break
            closing, tag, attrs, text = m.groups()
            if text is not None:
                self.pending.append(unescape(text) if "&" in text else text)
            else:
                tag = tag.lower()
                if closing and attrs:
                    break
                if tag in _OPAQUE:
                    raw = None if closing or tag not in _RAW_END else _RAW_END[tag].match(html, m.end())
                    if raw is None:
                        break
                    self.handle_starttag(tag, [(k.lower(), v or w) for k, v, w in _PLAIN_ATTR.findall(attrs)] if attrs else ())
                    if raw[1]:
                        self.pending.append(raw[1])
                    self.handle_endtag(tag)
                    at = raw.end()
                    continue
                if closing:
                    self.handle_endtag(tag)
                else:
                    self.handle_starttag(tag, [(k.lower(), v or w) for k, v, w in _PLAIN_ATTR.findall(attrs)] if attrs else ())
            at = m.end()
        if at < ends:
            self.feed(html[at:])
        self.close()
        self.flush()
        while self.open:
            self._close(self._pop())
        return len(self.node) - held

    def _add(self, kind, tag, text, attrs):
        """(node, tag, link, href, texts before, row or -1) of a new node."""
        idx, up = self.n, self.open[-1] if self.open else None
        self.n += 1
        group = _GROUP.get(tag) if tag else None
        ordinal = None
        if group:
            ordinal = self.ords.get(group, 0)
            self.ords[group] = ordinal + 1
        link, href = (up[2], up[3]) if up else (None, None)
        if tag == "a":
            link, href = idx, attrs.get("href")
        row = -1
        if self.tags is None or tag in self.tags:
            row = len(self.node)
            self.node.append(idx)
            self.parent.append(up[0] if up else None)
            self.depth.append(len(self.open))
            self.end.append(idx)
            self.kind.append(kind)
            self.tag.append(tag)
            self.ord.append(ordinal)
            self.text.append(text)
            if attrs:
                self.names += attrs
                self.values += attrs.values()
            self.attrs_end.append(len(self.names))
            self.up_idx += self.p_idx
            self.up_tag += self.p_tag
            self.up_ord += self.p_ord
            self.path_end.append(len(self.up_idx))
            self.link.append(link)
            self.href.append(href)
            self.inner.append(None)
            self.spaced.append(None)
        return idx, tag, link, href, len(self.texts), row, ordinal

    def flush(self):
        if self.pending:
            text = "".join(self.pending)
            self.pending = []
            raw = bool(self.s_tag) and self.s_tag[-1] in ("script", "style")
            self._add("raw" if raw else "text", None, text, None)
            if not raw:
                self.texts.append(text)

    def _pop(self):
        tag = self.s_tag.pop()
        if self.ancestors is None or tag in self.ancestors:
            self.p_idx.pop()
            self.p_tag.pop()
            self.p_ord.pop()
        return self.open.pop()

    def _close(self, node):
        _, tag, _, _, before, row, _ = node
        if row < 0:
            return
        self.end[row] = self.n - 1
        if tag in _INNER:
            mine = self.texts[before:]
            self.inner[row] = "".join(mine)
            if tag in _SPACED:
                self.spaced[row] = " ".join(t.strip() for t in mine if t.strip())

    def handle_starttag(self, tag, attrs):
        if self.pending:
            self.flush()
        node = self._add("tag", tag, None, {k: v or "" for k, v in attrs})
        if tag in _VOID:
            self._close(node)
        else:
            self.open.append(node)
            self.s_tag.append(tag)
            if self.ancestors is None or tag in self.ancestors:
                self.p_idx.append(node[0])
                self.p_tag.append(tag)
                self.p_ord.append(node[6])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.pending:
            self.flush()
        if tag in self.s_tag:
            while True:
                node = self._pop()
                self._close(node)
                if node[1] == tag:
                    return

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush()
        self._add("comment", None, data, {})

    def columns(self):
        """Arrow columns of the rows held, in the order of NAMES."""
        import pyarrow as pa

        ints, strings = (lambda v: pa.array(v, pa.int32())), (lambda v: pa.array(v, pa.string()))
        attrs = pa.MapArray.from_arrays(ints(self.attrs_end), strings(self.names), strings(self.values))
        up = pa.StructArray.from_arrays([ints(self.up_idx), strings(self.up_tag), ints(self.up_ord)], ["idx", "tag", "ord"])
        return [ints(self.node), ints(self.parent), ints(self.depth), ints(self.end), strings(self.kind), strings(self.tag), ints(self.ord), strings(self.text), attrs,
                pa.ListArray.from_arrays(ints(self.path_end), up), ints(self.link), strings(self.href), strings(self.inner), strings(self.spaced)]


def html_nodes(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html", tags: tuple[str, ...] | None = None,
               ancestors: tuple[str, ...] | None = None) -> DataFrame:
    """Tag, text and comment rows of every page with order, depth, parent and ancestors.
    Unclosed tags stay open until an enclosing tag ends. tags: only rows of these elements, with the numbers they have among all;
    ancestors and inner text are then built for them alone. ancestors: only elements of these tags are in ``path``."""
    wanted, above = None if tags is None else frozenset(tags), None if ancestors is None else frozenset(ancestors)

    def parse(batches):
        import pyarrow as pa

        reader = _Reader(wanted, above)
        for batch in batches:
            keys, html, page = batch.column(0), batch.column(1), []
            for i in range(batch.num_rows):
                page += [i] * reader.read(html[i].as_py() or "")
                if len(page) >= BATCH_ROWS or (page and i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(page, pa.int32())), *reader.columns()], ["doc_id", *NAMES])
                    reader.clear()
                    page = []

    id_type = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html"))
    return src.mapInArrow(parse, f"doc_id {id_type}, {_NODE}")


def html_segments(nodes: DataFrame) -> DataFrame:
    """Non-empty text nodes of every block with offsets into the block text. A text inside
    nested blocks belongs to each of them. Windows run inside one block of one page cell."""
    t = nodes.where("kind <> 'tag'").select(
        "doc_id", "node_idx", F.col("text").alias("raw"),
        L.strip(F.regexp_replace("text", L.U + r"\s+", " ")).alias("text"),
        F.col("link_idx").isNotNull().alias("in_link"), "href",
        F.explode(F.filter("path", lambda p: p["tag"].isin(*K.BLOCK_TAGS))).alias("b"))
    t = t.where("text <> ''").withColumn("block_idx", F.col("b.ord"))
    w = Window.partitionBy("doc_id", "block_idx").orderBy("node_idx")
    end = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return t.select("doc_id", "block_idx", (F.row_number().over(w) - 1).alias("seg_idx"),
                    (end - F.length("text")).alias("start"), end.alias("end"), "text", "in_link", "href", "raw", "node_idx")


def html_blocks(nodes: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Text of every block: its trimmed text nodes joined without a separator."""
    s = html_segments(nodes) if segments is None else segments
    text = s.groupBy("doc_id", "block_idx").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "").alias("text"))
    tags = nodes.where(F.col("tag").isin(*K.BLOCK_TAGS)).select(
        "doc_id", F.col("ord").alias("block_idx"), "tag", F.exists("path", lambda p: p["tag"] == "table").alias("in_table"))
    return tags.join(text, ["doc_id", "block_idx"])


def html_headings(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tag").rlike("^h[1-6]$")).select(
        "doc_id", F.col("ord"), F.substring("tag", 2, 1).cast("int").alias("level"), L.strip("inner").alias("text"),
        F.coalesce(F.col("attrs")["id"], F.lit("")).alias("existing_id"), F.col("node_idx").alias("pos"))


def html_links(nodes: DataFrame) -> DataFrame:
    """Every anchor with an href, per enclosing block (one row without block when there is none)."""
    a = nodes.where("tag = 'a' AND attrs['href'] IS NOT NULL")
    blocks = F.filter("path", lambda p: p["tag"].isin(*K.BLOCK_TAGS))
    return a.select("doc_id", "node_idx", F.explode_outer(blocks).alias("b"), F.col("attrs")["href"].alias("href"),
                    L.strip("inner").alias("text")).select("doc_id", "node_idx", F.col("b.ord").alias("block_idx"), "href", "text")


def html_cells(nodes: DataFrame) -> DataFrame:
    """Cells of every table; a cell of a nested table belongs to each table around it."""
    c = nodes.where("tag IN ('td', 'th')").withColumns({
        "_rows": F.filter("path", lambda p: p["tag"] == "tr"), "_head": F.exists("path", lambda p: p["tag"] == "thead")})
    span = lambda n: F.when(F.trim(F.col("attrs")[n]).rlike(r"^\d+$"), F.greatest(
        F.lit(1), F.trim(F.col("attrs")[n]).try_cast("int"))).otherwise(1)
    c = c.where(F.size("_rows") > 0).select(
        "doc_id", F.explode(F.filter("path", lambda p: p["tag"] == "table")).alias("t"),
        F.element_at("_rows", -1)["ord"].alias("row_idx"), F.col("node_idx").alias("cell_idx"), "tag",
        F.col("_head").alias("in_thead"), span("colspan").alias("colspan"), span("rowspan").alias("rowspan"),
        F.coalesce("spaced", F.lit("")).alias("text"), F.col("attrs")["scope"].alias("scope"))
    return c.select("doc_id", F.col("t.ord").alias("table_idx"), "row_idx", "cell_idx", "tag", "in_thead", "colspan",
                    "rowspan", "text", "scope")


def html_lists(nodes: DataFrame) -> DataFrame:
    up = F.filter("path", lambda p: p["tag"] == "ol")
    return nodes.where("tag = 'ol'").select(
        "doc_id", F.col("ord").alias("list_idx"), F.try_element_at(up, F.lit(-1))["ord"].alias("parent_list_idx"),
        F.size(up).alias("depth"), F.coalesce(F.col("attrs")["type"], F.lit("")).alias("type"),
        F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda x: x != "").alias("classes"),
        F.coalesce(F.col("attrs")["style"], F.lit("")).alias("style"))


def _has_class(name):
    return F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name)


def manual_roots(nodes: DataFrame) -> DataFrame:
    """Content root of every page (grid content, then div or main "manual", then body, then the whole page) with
    the settings the grid carries; the type falls back to the first h1."""
    pages = nodes.groupBy("doc_id").agg(F.max("node_idx").alias("_last"))
    # Elements that may count are read once.
    tags = nodes = durable(nodes.where("kind = 'tag' AND tag IN ('div', 'main', 'body', 'h1')").select("doc_id", "node_idx", "end_idx", "tag", "attrs", F.when(F.col("tag") == "h1", F.col("inner")).alias("inner")))
    manual = F.col("tag").isin("div", "main") & _has_class("manual")
    grid = tags.where((F.col("tag") == "div") & _has_class("manual-grid"))
    # Grids are found on the node itself, so membership needs no path join.
    g = grid.groupBy("doc_id").agg(F.min_by(F.struct("node_idx", "end_idx", "attrs"), "node_idx").alias("g"))
    c = tags.where(manual | (F.col("tag") == "body")).join(g, "doc_id", "left")
    inside = (F.col("node_idx") > F.col("g.node_idx")) & (F.col("node_idx") <= F.col("g.end_idx"))
    rank = (F.when(manual & (F.col("tag") == "div"), 1).when(manual, 2).otherwise(3))
    c = c.where(F.col("g").isNull() | (inside & manual))
    found = c.groupBy("doc_id").agg(F.min_by(F.struct("node_idx", "end_idx", "tag"), F.struct(rank, "node_idx")).alias("r"),
                                    F.first("g").alias("g"))
    # A page without container and body, such as a bare fragment, is its own root.
    whole = pages.select("doc_id", F.struct(F.lit(-1).alias("node_idx"), F.col("_last").alias("end_idx"), F.lit(None).cast("string").alias("tag")).alias("_all"))
    root = whole.join(found, "doc_id", "left").join(g.withColumnRenamed("g", "_grid"), "doc_id", "left").where(F.col("r").isNotNull() | F.col("_grid").isNull()).select(
        "doc_id", F.coalesce("r", "_all").alias("r"), "g")
    h1 = nodes.where("tag = 'h1'").join(root.select("doc_id", F.col("r.node_idx").alias("_a"), F.col("r.end_idx").alias("_b")), "doc_id")
    h1 = h1.where("node_idx >= _a AND node_idx <= _b").groupBy("doc_id").agg(F.min_by("inner", "node_idx").alias("_h1"))
    a = lambda n: F.col("g.attrs")[n]
    inferred = F.when(L.has(L.strip(F.coalesce("_h1", F.lit(""))), r"^Section\s+", True), "section").otherwise("chapter")
    return root.join(h1, "doc_id", "left").select(
        "doc_id", F.col("r.node_idx").alias("root_idx"), F.col("r.end_idx").alias("root_end"), F.col("r.tag").alias("root_tag"),
        F.coalesce(F.nullif(a("data-manual-type"), F.lit("")), inferred).alias("manual_type"),
        a("data-toc-depth").try_cast("int").alias("toc_depth"), a("data-numbering-mode").alias("numbering_mode"),
        a("data-heading-offset").try_cast("int").alias("heading_offset"), a("data-theme").alias("theme_id"))


#: Ancestors that the tables below look for in ``path``.
ASKED_FOR = (*K.BLOCK_TAGS, "table", "thead", "tbody", "tr", "td", "th", "ol", "u", "style", "script", "header", "img", "figure", "figcaption")
ASSETS = ("style", "script", "header", "img", "figure", "figcaption")


def in_asset(kinds: tuple[str, ...] = ASSETS):
    """Whether a node is one of these elements or inside of one. Ancestors ride on each row, so this needs no join."""
    inside = F.exists("path", lambda p: p["tag"].isin(*kinds))
    sheet = (F.col("tag") == "link") & F.array_contains(F.split(F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), r"\s+"), "stylesheet")
    return inside | F.coalesce(F.col("tag").isin(*kinds), F.lit(False)) | F.coalesce(sheet, F.lit(False))


def drop_nodes(nodes: DataFrame, kinds: tuple[str, ...] = ASSETS) -> DataFrame:
    """Remove elements with everything inside them."""
    return nodes.where(~in_asset(kinds))


def asset_ranges(nodes: DataFrame, kinds: tuple[str, ...] = ASSETS) -> DataFrame:
    """(doc_id, start, end) of the elements that ``drop_nodes`` removes."""
    sheet = (F.col("tag") == "link") & F.array_contains(F.split(F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), r"\s+"), "stylesheet")
    return nodes.where(F.col("tag").isin(*kinds) | sheet).select("doc_id", F.col("node_idx").alias("start"), F.col("end_idx").alias("end"))


def body_ranges(nodes: DataFrame) -> DataFrame:
    """(doc_id, start, end, last): the content of the first body element, or the whole page where there is none, and the last node of the page."""
    body = F.when(F.col("tag") == "body", F.struct("node_idx", (F.col("node_idx") + 1).alias("start"), F.col("end_idx").alias("end")))
    pages = nodes.groupBy("doc_id").agg(F.min(body).alias("b"), F.max("node_idx").alias("last"))
    return pages.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("b.start", F.lit(0)).alias("start"), F.coalesce("b.end", "last").alias("end"), "last")


def unwrap_inline(nodes: DataFrame, tags: tuple[str, ...] = K.INLINE_TAGS) -> DataFrame:
    """Inline formatting elements go, their content moves up to the next kept ancestor."""
    kept = F.filter("path", lambda p: ~p["tag"].isin(*tags))
    return nodes.where(F.col("tag").isNull() | ~F.col("tag").isin(*tags)).withColumns({
        "path": kept, "depth": F.size(kept), "parent_idx": F.try_element_at(kept, F.lit(-1))["idx"]})
