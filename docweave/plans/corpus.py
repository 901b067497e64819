"""Corpus jobs: the operators composed in the order the results depend on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import audit, edits as E, headings as H, references as R
from ..operators.edit_script import EditScript, outside
from ..operators.review import identity_crosswalk
from ..session import durable
from ..sources import html as S
from . import passes as P


@dataclass
class Settings:
    manual_type: str = "chapter"
    toc_depth: int = 2
    preserve_numbers: bool = False
    infer_depth: bool = False
    style_map: dict[str, int] = field(default_factory=dict)
    align_mode: str = "auto"
    col1: str | None = None
    col2: str | None = None
    col3: str | None = None
    coln: str | None = None
    header: str | None = None
    skip_linked: bool = False


def _inside(df: DataFrame, roots: DataFrame, idx: str) -> DataFrame:
    """Rows of the content root of each page."""
    r = roots.select("doc_id", F.col("root_idx").alias("_a"), F.col("root_end").alias("_b"))
    return df.join(r, "doc_id").where((F.col(idx) > F.col("_a")) & (F.col(idx) <= F.col("_b"))).drop("_a", "_b")


class Conversion(Mapping):
    """The tables of one conversion by name, each worked out when it is asked for."""

    NAMES = ("html", "front_matter", "headings", "toc", "toc_lines", "links", "typed_lists", "lists", "cells", "alignment", "scope", "placement", "references", "crosswalk",
             "stable_map", "decisions", "placed_links", "dead_links", "sanitized")

    def __init__(self, pages, settings=None, stable=None, heading_edits=None, edits=None, table_overrides=None):
        self.pages, self.cfg, self.stable, self.heading_edits, self.edits, self.overrides = pages, settings or Settings(), stable, heading_edits, edits, table_overrides

    def __iter__(self):
        return iter(n for n in self.NAMES if self.edits is not None or n not in ("decisions", "placed_links"))

    def __len__(self):
        return len(list(iter(self)))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in list(self):
            raise KeyError(name)
        return getattr(self, name)

    # ---- what the passes read
    @cached_property
    def nodes(self) -> DataFrame:
        return durable(S.html_nodes(self.pages, ancestors=S.ASKED_FOR).withColumn("asset", S.in_asset()))

    @cached_property
    def roots(self) -> DataFrame:
        return durable(S.manual_roots(self.nodes))

    @cached_property
    def body(self) -> DataFrame:
        return durable(S.body_ranges(self.nodes))

    @cached_property
    def kept(self) -> DataFrame:
        """Nodes without assets."""
        return self.nodes.where("NOT asset")

    @cached_property
    def front_matter(self) -> DataFrame:
        return durable(P.front_matter(self.kept, self.roots))

    @cached_property
    def live(self) -> DataFrame:
        """Nodes of the body without assets and front matter. Not written: each pass takes few of the rows and columns."""
        body = self.body.withColumnsRenamed({"start": "_s", "end": "_e"})
        ranges = self.front_matter.join(body, "doc_id").where("start >= _s AND start <= _e").select("doc_id", "start", "end")
        around = self.body.select("doc_id", F.inline(F.array(
            F.struct(F.lit(0).alias("start"), (F.col("start") - 1).alias("end")), F.struct((F.col("end") + 1).alias("start"), F.col("last").alias("end")))))
        return outside(self.kept.where("doc_id IS NOT NULL"), ranges.unionByName(around))

    @cached_property
    def segments(self) -> DataFrame:
        return durable(S.html_segments(self.live))

    def _script(self) -> EditScript:
        return EditScript(self.kept)

    # ---- passes: (their edits, what they found)
    @cached_property
    def _headings(self):
        cfg, script = self.cfg, self._script()
        heads = S.html_headings(self.live)
        if cfg.infer_depth:
            heads = H.infer_levels(heads, cfg.style_map or None)
            script.rename(heads.where("new_level <> level").select("doc_id", F.col("pos").alias("node_idx"), F.concat(F.lit("h"), F.col("new_level").cast("string")).alias("tag")))
            heads = heads.withColumn("level", F.col("new_level")).drop("new_level")
        if not cfg.preserve_numbers:
            heads = durable(heads.withColumn("title", L.strip_heading_prefix("text")["title"]))
            lead = F.length(F.regexp_extract("inner", L.U + r"^\s*", 0)).alias("lead")
            ends = self.live.where(F.col("tag").rlike("^h[1-6]$")).select("doc_id", F.col("node_idx").alias("pos"), "end_idx", lead)
            cut = heads.where("title <> text").join(ends, ["doc_id", "pos"]).withColumn("n", F.col("lead") + F.length("text") - F.length("title"))
            script.cut(cut.select("doc_id", F.col("pos").alias("node_idx"), "end_idx", "n"))
            heads = heads.withColumn("text", F.col("title")).drop("title")
        heads = durable(H.assign_ids(heads, self.stable))
        script.attribute(heads.select("doc_id", F.col("pos").alias("node_idx"), F.lit("id").alias("name"), F.col("id").alias("value")))
        return script, heads

    @cached_property
    def _links(self):
        script, old = self._script(), S.html_links(self.live)
        links = R.rewrite_internal_hrefs(old, H.id_remap(self._headings[1]))
        script.attribute(links.where("new_href <> href").select("doc_id", "node_idx", F.lit("href").alias("name"), F.col("new_href").alias("value")).distinct())
        return script, links.withColumn("href", F.col("new_href")).drop("new_href")

    @cached_property
    def _heading_edits(self):
        script, heads = self._script(), self._headings[1]
        if self.heading_edits is None:
            return script, heads
        final = durable(H.apply_heading_edits(heads, self.heading_edits))
        changed = final.join(heads.select("doc_id", "pos", F.col("level").alias("_l"), F.col("text").alias("_t")), ["doc_id", "pos"])
        script.rename(changed.where("level <> _l").select("doc_id", F.col("pos").alias("node_idx"), F.concat(F.lit("h"), F.col("level").cast("string")).alias("tag")))
        ends = self.live.select("doc_id", F.col("node_idx").alias("pos"), "end_idx")
        script.text(changed.where("text <> _t").join(ends, ["doc_id", "pos"]).select("doc_id", F.col("pos").alias("node_idx"), "end_idx", "text"))
        return script, final

    @cached_property
    def _typed_lists(self):
        script = self._script()
        return script, durable(P.typed_lists(script, self.live, self.roots))

    @cached_property
    def _lists(self):
        script = self._script()
        return script, P.list_styles(script, self.live, self._typed_lists[1])

    @cached_property
    def _parts(self):
        return P.table_parts(self.live)

    @cached_property
    def _cells(self):
        script = self._script()
        return script, P.table_headers(script, self._parts, self.overrides)

    @cached_property
    def _layout(self):
        script = self._script()
        return script, P.table_layout(script, self.live, self._parts, self._cells[1], self.cfg, self.overrides)

    @cached_property
    def _citations(self):
        script = self._script()
        return script, P.citations(script, self.live, self.segments, self.references, self.decisions, self.cfg.skip_linked)

    @cached_property
    def _sanitized(self):
        script = self._script()
        return script, P.sanitize(script, self.live)

    # ---- results
    @cached_property
    def headings(self) -> DataFrame:
        return H.number_headings(self._heading_edits[1].select("doc_id", "ord", "level", "text", "id", "pos"), self.cfg.manual_type, self.cfg.preserve_numbers)

    @cached_property
    def toc(self) -> DataFrame:
        return H.table_of_contents(self._heading_edits[1], self.cfg.toc_depth, manual_type=self.cfg.manual_type, leading_entries=True)

    @cached_property
    def toc_lines(self) -> DataFrame:
        return H.toc_lines(self._heading_edits[1], self.cfg.toc_depth)

    @cached_property
    def stable_map(self) -> DataFrame:
        return H.stable_map(self._heading_edits[1])

    links = property(lambda self: self._links[1])
    typed_lists = property(lambda self: self._typed_lists[1])
    lists = property(lambda self: self._lists[1])
    cells = property(lambda self: self._cells[1])
    alignment = property(lambda self: self._layout[1]["alignment"])
    scope = property(lambda self: self._layout[1]["scope"])
    placement = property(lambda self: self._layout[1]["placement"])
    placed_links = property(lambda self: self._citations[1])
    sanitized = property(lambda self: self._sanitized[1])

    @cached_property
    def references(self) -> DataFrame:
        return R.with_ref_ids(R.extract_references(S.html_blocks(self.live, self.segments), self.segments))

    @cached_property
    def _index(self) -> DataFrame:
        return H.heading_index(H.heading_keys(self.headings.select("doc_id", "ord", "level", F.col("numbered_text").alias("text"), "id")))

    @cached_property
    def crosswalk(self) -> DataFrame:
        return R.match_references(self.references, self._index, self.cfg.manual_type)

    @cached_property
    def _ids(self) -> DataFrame:
        other = self.live.where("kind = 'tag' AND attrs['id'] IS NOT NULL AND NOT tag RLIKE '^h[1-6]$'")
        return R.live_ids(self._heading_edits[1], other.select("doc_id", F.col("attrs")["id"].alias("id")))

    @cached_property
    def decisions(self) -> DataFrame:
        found = R.link_decisions(self.references, self.edits, self.crosswalk)
        anchors = R.resolve_anchors(found, self._index, self.crosswalk).select("doc_id", "label", "display", "target", "anchor")
        return durable(R.stale_anchor_fallback(found.join(anchors, ["doc_id", "label", "display", "target"], "left"), self._ids))

    @cached_property
    def dead_links(self) -> DataFrame:
        return R.dead_links(self.links, self._ids)

    @cached_property
    def html(self) -> DataFrame:
        """(doc_id, html): all edits in the order of the passes, applied at once."""
        script = self._script().delete(self.front_matter)
        order = [self._headings, self._links, self._heading_edits, self._typed_lists, self._lists, self._cells, self._layout, *([self._citations] if self.edits is not None else [])]
        for edits, _ in order:
            script.extend(edits)
        script.unwrap(self.dead_links.select("doc_id", "node_idx").distinct()).extend(self._sanitized[0])
        return script.rendered(self.body)


def convert_corpus(pages: DataFrame, settings: Settings | None = None, stable: DataFrame | None = None,
                   heading_edits: DataFrame | None = None, edits: DataFrame | None = None,
                   table_overrides: DataFrame | None = None) -> Conversion:
    """Pages (doc_id, html) to the converted markup and every table on the way to it, by name.

    Pages are parsed once into a written node table. Then in order: assets, front matter, levels, numbers off, ids, link targets, heading
    edits, typed lists, list styles, table headers before alignment, scope and placement, citations against the final ids, dead links, allowlist. Each pass
    adds to an edit script over the parsed nodes, and ``html`` applies them all at once. ``front_matter`` and ``typed_lists`` hold node ranges,
    ``lists`` positions (twice the node, less one for a list that was typed), ``sanitized`` what the allowlist takes out. A citation that an edit decides
    on is in ``decisions``, and in ``placed_links`` if its label is found.
    """
    return Conversion(pages, settings, stable, heading_edits, edits, table_overrides)


def import_pages(pages: DataFrame, keep_old: bool = False) -> dict[str, DataFrame]:
    """Published pages back into tables: content root and its settings, heading offset
    undone, existing ids kept, citations and crosswalk."""
    nodes = durable(S.drop_nodes(S.html_nodes(pages), ("style", "script")))
    roots = S.manual_roots(nodes)
    heads = _inside(S.html_headings(nodes), roots, "pos").join(
        roots.select("doc_id", F.coalesce("heading_offset", F.lit(0)).alias("_off"), F.col("manual_type").alias("_mt")), "doc_id")
    heads = heads.withColumn("level", F.greatest(F.lit(1), F.least(F.lit(6), F.col("level") - F.col("_off")))).drop("_off", "_mt")
    heads = H.assign_ids(heads, keep_existing=True)
    segments = S.html_segments(_inside(nodes, roots, "node_idx"))
    refs = R.extract_references(S.html_blocks(nodes, segments), segments)
    index = H.heading_keys(heads.select("doc_id", "ord", "level", "text", "id"))
    crosswalk = identity_crosswalk(refs, cited_only=False) if keep_old else R.match_references(refs, index)
    return {"settings": roots, "headings": heads, "references": refs, "index": index, "crosswalk": crosswalk}


def reimport_revision(old_docs: DataFrame, new_docs: DataFrame, parts: DataFrame, refs: DataFrame, edits: DataFrame,
                      old_map: DataFrame, new_map: DataFrame) -> dict[str, DataFrame]:
    """A revised document replaces its source: pending changes are refused, saved edits are
    re-attached (ids are trusted only for documents whose content hash is unchanged), and
    anchors are compared. docs(doc_id, content); parts and refs of the new documents. Edits of documents that are refused or not part
    of the revision are in ``untouched_edits``, with the reason."""
    clean, refused = audit.quarantine_tracked_changes(new_docs, parts)
    before = old_docs.select("doc_id", L.content_hash("content").alias("_a"))
    # One written row per document; every later step reads this small table.
    state = durable(clean.select("doc_id", L.content_hash("content").alias("_b")).join(before, "doc_id", "left")
                    .select("doc_id", (F.col("_a") == F.col("_b")).alias("same")))
    same = state.where("same").select("doc_id")
    changed = state.where("NOT coalesce(same, false)").select("doc_id")
    kept = E.reattach_edits(refs.join(same, "doc_id", "left_semi"), edits.join(same, "doc_id", "left_semi"), trust_exact=True)
    moved = E.reattach_edits(refs.join(changed, "doc_id", "left_semi"), edits.join(changed, "doc_id", "left_semi"))
    # Edits of refused documents and of documents that are not in the revision come back as they were.
    rest = edits.join(state, "doc_id", "left_anti").join(refused.select("doc_id").distinct().withColumn("_refused", F.lit(True)), "doc_id", "left")
    rest = rest.withColumn("status", F.when(F.col("_refused"), "refused").otherwise("absent")).drop("_refused")
    done = kept.unionByName(moved, allowMissingColumns=True)
    return {"refused": refused, "edits": done, "untouched_edits": rest, "anchors": H.permalink_stability(old_map, new_map)}
