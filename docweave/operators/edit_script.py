"""Edits of nested node rows by node range, composed once.

Every pass of a conversion reads the same parsed nodes and adds edits to a script: ranges to delete, elements to unwrap, rename or move, attributes, new text, characters to
cut, links inside a text, elements around or in front of a range. Nothing is applied until ``rendered`` puts the markup of each document together, in one ordered step.

A node opens at place 2 * node_idx and closes at 2 * end_idx + 1. A place is an array of numbers, compared from the left, so that whatever an edit adds can stand
between two places, and a moved range keeps its own places behind those of its target. Of edits that touch the same attribute, tag or text the latest pass holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import durable
from .scan import Spec, last_value, scan

DOC = ["doc_id"]
#: Rows of a few numbers that are sent to all tasks instead of moving what they are joined to.
FEW = 300_000
#: Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def escape_text(c) -> Column:
    out = L._c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_attribute(c) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))


def place(*numbers) -> Column:
    return F.array(*[(F.lit(n) if isinstance(n, int) else n).cast("long") for n in numbers])


def numbers(df: DataFrame) -> DataFrame:
    """A short table of numbers, written once: sent to all tasks if it has few rows, else a hashed side of an exchange."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= FEW else df.hint("shuffle_hash")


def word_of(node_idx) -> Column:
    """Which 64 nodes of its document a node is among."""
    return F.shiftright(F.col(node_idx).cast("long"), 6)


def words_of_range(start, end) -> Column:
    """The sixty-fours that a range, both ends included, reaches into."""
    return F.explode(F.sequence(word_of(start), word_of(end)))


def outside(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes that lie in none of the ranges (doc_id, start, end); a null id has no ranges. Nothing is ordered: ranges become one bit per node, 64 to a row, so
    that nodes which are narrowed down later are narrowed down before they meet them."""
    # One bit from the first node of the range in these 64 to the last.
    low, high = F.greatest(F.col("start") - F.col("_word") * 64, F.lit(0)), F.least(F.col("end") - F.col("_word") * 64, F.lit(63))
    bits = F.call_function("shiftleft", F.lit(-1).cast("long"), low.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (63 - high).cast("int")))
    reached = ranges.where("doc_id IS NOT NULL AND start <= end").select("doc_id", "start", "end", words_of_range("start", "end").alias("_word"))
    gone = numbers(reached.groupBy(F.col("doc_id").alias("_of"), "_word").agg(F.bit_or(bits).alias("_bits")))
    bit = F.getbit("_bits", F.col("node_idx").cast("long").bitwiseAND(F.lit(63)).cast("int"))
    return nodes.join(gone, (F.col("doc_id") == F.col("_of")) & (word_of("node_idx") == F.col("_word")), "left").where(F.col("_bits").isNull() | (bit == 0)).select(*nodes.columns)


class EditScript:
    """The edits of all passes over ``nodes`` (doc_id, node_idx, end_idx, kind, tag, text, attrs). Each method adds one kind of edit and returns the script."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self.rank = 0
        self._parts: dict[str, list[DataFrame]] = {}

    def _add(self, kind: str, df: DataFrame, *columns) -> EditScript:
        self.rank += 1
        self._parts.setdefault(kind, []).append(df.select("doc_id", *columns, F.lit(self.rank).alias("rank")))
        return self

    def extend(self, other: EditScript) -> EditScript:
        """The edits of a later script behind these."""
        for kind, parts in other._parts.items():
            self._parts.setdefault(kind, []).extend(p.withColumn("rank", F.col("rank") + self.rank) for p in parts)
        self.rank += other.rank
        return self

    def _all(self, kind: str) -> DataFrame | None:
        own = self._parts.get(kind)
        # Edits are as many as the corpus is long but short when compressed: merge joins keep them out of the driver.
        return reduce(DataFrame.unionByName, own).hint("merge") if own else None

    def delete(self, df: DataFrame) -> EditScript:
        """df(doc_id, start, end)"""
        return self._add("delete", df, "start", "end")

    def unwrap(self, df: DataFrame) -> EditScript:
        """df(doc_id, node_idx): the element goes, its content stays."""
        return self._add("unwrap", df, "node_idx")

    def rename(self, df: DataFrame) -> EditScript:
        """df(doc_id, node_idx, tag)"""
        return self._add("rename", df, "node_idx", "tag")

    def attribute(self, df: DataFrame) -> EditScript:
        """df(doc_id, node_idx, name, value): a null value takes the attribute away."""
        return self._add("attribute", df, "node_idx", "name", "value")

    def text(self, df: DataFrame) -> EditScript:
        """df(doc_id, node_idx, end_idx, text): the content of an element becomes this text."""
        return self._add("text", df, "node_idx", "end_idx", F.col("text").alias("content"))

    def cut(self, df: DataFrame) -> EditScript:
        """df(doc_id, node_idx, end_idx, n): the first n characters of the element's text go."""
        return self._add("cut", df, F.col("node_idx").alias("start"), F.col("end_idx").alias("end"), "n")

    def links(self, df: DataFrame) -> EditScript:
        """df(doc_id, node_idx, start, end, display, href): part of a text node is replaced, by a link unless href is blank."""
        return self._add("links", df, "node_idx", "start", "end", "display", "href")

    def first(self, df: DataFrame) -> EditScript:
        """df(doc_id, node_idx, tag, text): a new element with this text comes first in the element."""
        return self._add("first", df, "node_idx", "tag", "text")

    def wrap(self, df: DataFrame) -> EditScript:
        """df(doc_id, start, end, tag, attrs): a new element around whole neighbouring nodes."""
        return self._add("wrap", df, "start", "end", "tag", "attrs")

    def move(self, df: DataFrame) -> EditScript:
        """df(doc_id, start, end, at): the nodes go to a place; see ``front`` and ``back``."""
        return self._add("move", df, "start", "end", "at")

    def write(self, df: DataFrame) -> EditScript:
        """df(doc_id, at, markup): markup at a place of its own."""
        return self._add("write", df, "at", "markup")

    @staticmethod
    def front(node_idx, order) -> Column:
        """Place in front of the content of an element; ``order`` among all that are put there."""
        return place(2 * node_idx, 3, order)

    @staticmethod
    def back(node_idx, end_idx, order) -> Column:
        """Place behind the content of an element."""
        return place(2 * end_idx + 1, -2 * node_idx - 1, order)

    def live(self) -> DataFrame:
        """Nodes that no pass has deleted so far."""
        gone = self._all("delete")
        return self.nodes if gone is None else outside(self.nodes, gone)

    def _reached(self, nodes: DataFrame) -> DataFrame:
        """Nodes with the last cut and the last move that start at or before them and reach over them, and the characters of text since that cut began;
        all in one ordered scan."""
        start = lambda kind, columns: self._all(kind).groupBy("doc_id", F.col("start").alias("node_idx")).agg(F.max_by(F.struct("start", "end", *columns), "rank").alias(f"_{kind}"))
        for kind, columns, empty in (("cut", ["n"], "struct<start:int,end:int,n:int>"), ("move", ["at"], "struct<start:int,end:int,at:array<bigint>>")):
            nodes = nodes.join(start(kind, columns), ["doc_id", "node_idx"], "left") if self._all(kind) is not None else nodes.withColumn(f"_{kind}", F.lit(None).cast(empty))
        size = F.when(F.col("kind") == "text", F.length("text")).otherwise(0)
        out = scan(nodes, DOC, ["node_idx"], {"_c": last_value(F.col("_cut")), "_m": last_value(F.col("_move")), "_upto": Spec("since", size, F.col("_cut").isNotNull())})
        over = lambda c: F.when(F.col(f"{c}.end") >= F.col("node_idx"), F.col(c))
        # The row at which a cut begins counts nothing, and is an element.
        return durable(out.withColumns({"_cut": over("_c"), "_move": over("_m")}).drop("_c", "_m"))

    def _merged_attributes(self, nodes: DataFrame) -> DataFrame:
        edits = self._all("attribute")
        if edits is None:
            return nodes
        latest = edits.groupBy("doc_id", "node_idx", "name").agg(F.max_by(F.struct("value"), "rank").alias("v"))
        new = latest.groupBy("doc_id", "node_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("v.value").alias("value"))))).alias("_new"))
        out = nodes.join(new, ["doc_id", "node_idx"], "left")
        # Kept attributes stay where they are, new ones come after them by name.
        old = F.map_filter("attrs", lambda k, v: F.lit(True))
        kept = F.transform_values(old, lambda k, v: F.when(F.map_contains_key("_new", k), F.element_at("_new", k)).otherwise(v))
        added = F.map_filter("_new", lambda k, v: ~F.map_contains_key("attrs", k))
        both = F.map_filter(F.map_concat(kept, added), lambda k, v: v.isNotNull())
        return out.withColumn("attrs", F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(both)).drop("_new")

    def _node_text(self, nodes: DataFrame) -> DataFrame:
        """Column ``shown``: the markup of each text node, cut and linked. Elements whose text is cut as a whole go with it."""
        gone = F.greatest(F.lit(0), F.least(F.length("text"), F.col("_cut.n") - (F.col("_upto") - F.length("text"))))
        text = nodes.withColumn("_from", F.when(F.col("_cut").isNull(), 0).otherwise(gone))
        if self._all("cut") is not None:
            seen = text.where((F.col("kind") == "text") & F.col("_cut").isNotNull() & (F.col("_from") < F.length("text")))
            seen = seen.groupBy("doc_id", F.col("_cut.start").alias("_start")).agg(F.min("node_idx").alias("_seen"))
            text = text.withColumn("_start", F.col("_cut.start")).join(seen, ["doc_id", "_start"], "left")
            emptied = (F.col("kind") == "tag") & (F.col("node_idx") > F.col("_start")) & (F.col("_upto") < F.col("_cut.n")) & (F.col("_seen").isNull() | (F.col("end_idx") < F.col("_seen")))
            text = text.where(~F.coalesce(emptied, F.lit(False)))
        links = self._all("links")
        if links is None:
            return text.withColumn("shown", escape_text(F.substr("text", F.col("_from") + 1)))
        own = links.groupBy("doc_id", "node_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", "display", "href"))).alias("_links"))
        text = text.join(own, ["doc_id", "node_idx"], "left")
        init = F.struct(F.col("_from").cast("int").alias("at"), F.lit("").alias("out"))

        def step(a, x):
            gap = escape_text(F.substr("text", a["at"] + 1, F.greatest(F.lit(0), x["start"] - a["at"])))
            link = F.when(x["href"] != "", F.concat(F.lit('<a href="'), escape_attribute(x["href"]), F.lit('">'), escape_text(x["display"]), F.lit("</a>"))).otherwise(escape_text(x["display"]))
            # Of overlapping links the first holds.
            return F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].cast("int").alias("at"), F.concat(a["out"], gap, link).alias("out")))

        linked = F.aggregate("_links", init, step, lambda a: F.concat(a["out"], escape_text(F.substr("text", a["at"] + 1))))
        return text.withColumn("shown", F.coalesce(linked, escape_text(F.substr("text", F.col("_from") + 1))))

    def edited(self) -> DataFrame:
        """Nodes as they will be shown: doc_id, node_idx, end_idx, kind, tag, attrs, shown, at (the place that moved nodes come behind, else empty)."""
        nodes = self.nodes.select("doc_id", "node_idx", "end_idx", "kind", "tag", "text", "attrs")
        texts = self._all("text")
        gone = self._all("delete")
        if texts is not None:
            texts = texts.groupBy("doc_id", "node_idx", "end_idx").agg(F.max_by("content", "rank").alias("content"))
            inner = texts.select("doc_id", (F.col("node_idx") + 1).alias("start"), F.col("end_idx").alias("end"), F.lit(0).alias("rank")).where("start <= end")
            gone = inner if gone is None else gone.unionByName(inner)
        if gone is not None:
            nodes = durable(outside(nodes, gone))
        nodes = self._node_text(self._reached(nodes))
        nodes = self._merged_attributes(nodes)
        renamed = self._all("rename")
        if renamed is not None:
            new = renamed.groupBy("doc_id", "node_idx").agg(F.max_by("tag", "rank").alias("_tag"))
            nodes = nodes.join(new, ["doc_id", "node_idx"], "left").withColumn("tag", F.coalesce("_tag", "tag"))
        flat = self._all("unwrap")
        if flat is not None:
            nodes = nodes.join(flat.select("doc_id", "node_idx", F.lit(True).alias("_flat")).distinct(), ["doc_id", "node_idx"], "left").where("_flat IS NULL")
        nodes = nodes.withColumn("at", F.coalesce("_move.at", F.array().cast("array<bigint>")))
        if texts is not None:
            nodes = nodes.join(texts.select("doc_id", "node_idx", "content"), ["doc_id", "node_idx"], "left")
        else:
            nodes = nodes.withColumn("content", F.lit(None).cast("string"))
        return durable(nodes.select("doc_id", "node_idx", "end_idx", "kind", "tag", "attrs", "shown", "at", "content"))

    def marks(self, nodes: DataFrame | None = None) -> DataFrame:
        """doc_id, at, markup: what is written at which place. Comments and raw text are left out."""
        n = self.edited() if nodes is None else nodes
        i, e = F.col("node_idx"), F.col("end_idx")
        attributes = F.array_join(F.transform(F.map_entries("attrs"), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), escape_attribute(a["value"]), F.lit('"'))), "")
        opening = F.concat(F.lit("<"), F.col("tag"), attributes, F.lit(">"))
        mark = lambda at, s: F.struct(F.concat("at", at).alias("at"), s.alias("markup"))
        none = F.lit(None).cast("struct<at:array<bigint>,markup:string>")
        element = F.col("kind") == "tag"
        each = F.array(
            F.when(element, mark(place(2 * i), opening)).when(F.col("kind") == "text", mark(place(2 * i), F.col("shown"))).otherwise(none),
            F.when(element & F.col("content").isNotNull(), mark(place(2 * i, 1), escape_text("content"))).otherwise(none),
            F.when(element & ~F.col("tag").isin(*VOID), mark(place(2 * e + 1, -2 * i), F.concat(F.lit("</"), F.col("tag"), F.lit(">")))).otherwise(none))
        out = [n.select("doc_id", F.inline(F.filter(each, lambda m: m.isNotNull())))]
        first = self._all("first")
        if first is not None:
            # Where the element itself is shown.
            shown = first.join(n.select("doc_id", "node_idx", "at"), ["doc_id", "node_idx"])
            out.append(shown.select("doc_id", F.concat("at", place(2 * F.col("node_idx"), 2)).alias("at"), F.concat(F.lit("<"), F.col("tag"), F.lit(">"), escape_text(F.col("text")), F.lit("</"), F.col("tag"), F.lit(">")).alias("markup")))
        wraps = self._all("wrap")
        if wraps is not None:
            s, t = F.col("start"), F.col("end")
            out.append(wraps.select("doc_id", F.inline(F.array(
                F.struct(place(2 * s - 1, 1, -t).alias("at"), F.concat(F.lit("<"), F.col("tag"), attributes, F.lit(">")).alias("markup")),
                F.struct(place(2 * t + 1, -2 * s + 1).alias("at"), F.concat(F.lit("</"), F.col("tag"), F.lit(">")).alias("markup"))))))
        own = self._all("write")
        if own is not None:
            out.append(own.select("doc_id", "at", "markup"))
        return reduce(DataFrame.unionByName, out)

    def rendered(self, roots: DataFrame | None = None) -> DataFrame:
        """doc_id, html of every document; with roots (doc_id, start, end) only what lies in the range. A document is one value, as it was in the input."""
        nodes = self.edited()
        if roots is not None:
            nodes = nodes.join(roots.select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_t")), "doc_id").where((F.col("node_idx") >= F.col("_s")) & (F.col("node_idx") <= F.col("_t"))).drop("_s", "_t")
        ordered = F.array_sort(F.collect_list(F.struct("at", "markup")))
        return self.marks(nodes).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda m: m["markup"]), "").alias("html"))
