"""Word archives as tables. Archives are opened inside tasks, one file row at a time."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import urls as U
from ..operators.paragraphs import style_level

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PARTS = ("word/document.xml", "word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/endnotes.xml",
         "word/_rels/document.xml.rels", "manifest.json", "edits.json", "stable_heading_map.json")


def read_archives(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """path, content of every archive file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(
        path).select("path", "content")


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, size, is_dir) of every readable archive."""
    import pandas as pd

    def list_members(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(path, i.filename, i.file_size, i.filename.endswith("/")) for i in z.infolist()]
                except (zipfile.BadZipFile, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "size", "is_dir"])

    return files.mapInPandas(list_members, "path string, member string, size long, is_dir boolean")


def archive_parts(files: DataFrame, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """(doc_id, part, content): the wanted members of every archive, whatever its size. ``doc_id`` is the path.

    Wanted are the named parts, nested Word files, and every member that the archive's manifest names. Limits are reported by
    ``archive_audit``, archives that cannot be read by ``unreadable_archives``.
    """
    import pandas as pd

    def named(archive):
        """Members that a bundle's manifest lists under its files."""
        try:
            listed = json.loads(archive.read("manifest.json")).get("files") or {}
            return {v for v in listed.values() if isinstance(v, str)}
        except (KeyError, ValueError, AttributeError):
            return set()

    def unzip(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        wanted = named(z) | set(parts)
                        for i in z.infolist():
                            if not i.is_dir() and (i.filename in wanted or i.filename.endswith((".docx", "edits.json"))):
                                yield pd.DataFrame([(path, i.filename, z.read(i))], columns=["doc_id", "part", "content"])
                except _UNREADABLE:
                    continue

    return files.mapInPandas(unzip, "doc_id string, part string, content binary")


_UNREADABLE = (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError)


def unreadable_archives(files: DataFrame) -> DataFrame:
    """(doc_id, reason) of every archive that ``archive_parts`` cannot read to its end."""
    import pandas as pd

    def test(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        broken = z.testzip()
                    if broken:
                        rows.append((path, f"damaged member {broken}"))
                except _UNREADABLE as reason:
                    rows.append((path, str(reason)))
            yield pd.DataFrame(rows, columns=["doc_id", "reason"])

    return files.mapInPandas(test, "doc_id string, reason string")


def read_docx_parts(spark: SparkSession, path: str) -> DataFrame:
    return archive_parts(read_archives(spark, path))


#: Rows that leave the parser together; a document is never split.
BATCH_ROWS = 20_000


def _parse(parts: DataFrame, part: str, fn, columns: list[str], schema: str) -> DataFrame:
    """Rows that ``fn(root)`` reads from one XML part of every document."""
    id_type = parts.schema["doc_id"].dataType.simpleString()
    kinds = [c.split()[1] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
        for batch in batches:
            docs, content, held, doc = batch.column(0), batch.column(1), [], []
            for i in range(batch.num_rows):
                data = content[i].as_py()
                try:
                    rows = fn(ET.fromstring(data))
                except ET.ParseError:
                    rows = []
                held += rows
                doc += [i] * len(rows)
                if len(held) >= BATCH_ROWS or (held and i == batch.num_rows - 1):
                    values = [pa.array(v, types[k]) for v, k in zip(zip(*held), kinds)]
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(doc, pa.int32())), *values], ["doc_id", *columns])
                    held, doc = [], []

    return parts.where(F.col("part") == part).select("doc_id", "content").mapInArrow(run, f"doc_id {id_type}, {schema}")


def _val(el, path, attr="val"):
    node = el.find(path) if el is not None else None
    return node.get(_W + attr) if node is not None else None


def _int(v):
    try:
        return int(v)
    except (TypeError, ValueError):
        return None


def _run_text(run):
    text = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n",
            "noBreakHyphen": lambda e: "-"}
    return "".join(text[k](e) for e in run if (k := e.tag.removeprefix(_W)) in text)


def _body_paragraphs(root):
    body = root.find(_W + "body")
    return [] if body is None else body.findall(_W + "p")


def _paragraph_rows(root):
    rows = []
    for i, p in enumerate(_body_paragraphs(root)):
        text = "".join(_run_text(e) if e.tag == _W + "r" else "".join(_run_text(r) for r in e.findall(_W + "r"))
                       for e in p if e.tag in (_W + "r", _W + "hyperlink"))
        ppr = p.find(_W + "pPr")
        num = ppr.find(_W + "numPr") if ppr is not None else None
        outline = _int(_val(ppr, _W + "outlineLvl"))
        rows.append((i, text, _val(ppr, _W + "pStyle"), outline + 1 if outline is not None else 0, num is not None,
                     _int(_val(num, _W + "numId")), _int(_val(num, _W + "ilvl"))))
    return rows


def _style_rows(root):
    rows = []
    for s in root.findall(_W + "style"):
        ppr, rpr = s.find(_W + "pPr"), s.find(_W + "rPr")
        num = ppr.find(_W + "numPr") if ppr is not None else None
        outline = _int(_val(ppr, _W + "outlineLvl"))
        size = _int(_val(rpr, _W + "sz"))
        flag = lambda n: None if rpr is None or rpr.find(_W + n) is None else (_val(rpr, _W + n) or "1") not in ("0", "false", "none")
        twips = lambda path, attr: (lambda v: None if v is None else v / 20.0)(_int(_val(ppr, path, attr)))
        rows.append((s.get(_W + "styleId"), _val(s, _W + "name"), _val(s, _W + "basedOn"), s.get(_W + "type"),
                     s.get(_W + "default") in ("1", "true"), outline + 1 if outline is not None else 0,
                     _val(rpr, _W + "rFonts", "ascii"), size / 2.0 if size is not None else None, _val(rpr, _W + "color"),
                     flag("b"), flag("i"), flag("u"), _val(ppr, _W + "jc"), twips(_W + "ind", "left"), twips(_W + "ind", "right"),
                     twips(_W + "spacing", "before"), twips(_W + "spacing", "after"),
                     num is not None, _int(_val(num, _W + "numId")), _int(_val(num, _W + "ilvl"))))
    return rows


def docx_styles(parts: DataFrame) -> DataFrame:
    cols = ("style_id style_name based_on style_type is_default style_outline_lvl font_name font_size_pt color bold italic "
            "underline alignment left_indent_pt right_indent_pt space_before_pt space_after_pt has_num num_id ilvl").split()
    types = ("string string string string boolean int string double string boolean boolean boolean string double double "
             "double double boolean int int").split()
    return _parse(parts, "word/styles.xml", _style_rows, cols, ", ".join(f"{c} {t}" for c, t in zip(cols, types)))


def docx_paragraphs(parts: DataFrame) -> DataFrame:
    """Body paragraphs in order. Numbering is the paragraph's own, else its style's."""
    cols = ["para_idx", "text", "style_id", "outline_lvl", "own_num", "num_id", "ilvl"]
    p = _parse(parts, "word/document.xml", _paragraph_rows, cols,
               "para_idx int, text string, style_id string, outline_lvl int, own_num boolean, num_id int, ilvl int")
    styles = docx_styles(parts)
    default = styles.where("is_default AND style_type = 'paragraph'").groupBy("doc_id").agg(F.min("style_id").alias("_dflt"))
    s = styles.select("doc_id", "style_id", "style_name", "style_outline_lvl", F.col("num_id").alias("_sn"), F.col("ilvl").alias("_sl"))
    p = p.join(default, "doc_id", "left").withColumn("style_id", F.coalesce("style_id", "_dflt")).drop("_dflt")
    p = p.join(s, ["doc_id", "style_id"], "left")
    own = F.col("own_num")
    p = p.withColumns({"num_id": F.when(own, F.col("num_id")).otherwise(F.col("_sn")),
                       "ilvl": F.when(own, F.col("ilvl")).otherwise(F.col("_sl"))})
    level = F.coalesce(F.nullif(style_level("style_name"), F.lit(0)), F.nullif("outline_lvl", F.lit(0)), "style_outline_lvl", F.lit(0))
    return p.select("doc_id", "para_idx", "text", "style_id", "style_name", "outline_lvl",
                    F.coalesce("style_outline_lvl", F.lit(0)).alias("style_outline_lvl"), "num_id", "ilvl", level.alias("heading_level"))


def _link_rows(root):
    rows = []
    for i, p in enumerate(_body_paragraphs(root)):
        for j, a in enumerate(p.iter(_W + "hyperlink")):
            text = "".join(t.text or "" for t in a.iter(_W + "t")).strip()
            rows.append((i, j, a.get(_R + "id"), a.get(_W + "anchor"), text))
    return rows


def docx_hyperlinks(parts: DataFrame) -> DataFrame:
    """Links per paragraph: relationship target, else ``#anchor``; empty ones are skipped."""
    links = _parse(parts, "word/document.xml", _link_rows, ["para_idx", "link_idx", "rel_id", "anchor", "text"],
                   "para_idx int, link_idx int, rel_id string, anchor string, text string")
    rels = _parse(parts, "word/_rels/document.xml.rels", lambda r: [(e.get("Id"), e.get("Target")) for e in r],
                  ["rel_id", "target"], "rel_id string, target string")
    j = links.join(rels, ["doc_id", "rel_id"], "left")
    href = F.when(F.col("target").isNotNull(), F.col("target")).when(
        F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit("#"), "anchor")).otherwise("")
    j = j.withColumn("href", href).where((F.col("href") != "") | (F.col("text") != ""))
    return j.select("doc_id", "para_idx", "link_idx", "text", "href", U.is_bad_docx_link("href").alias("bad"))


def _level_rows(root):
    rows = []
    for a in root.findall(_W + "abstractNum"):
        for lvl in a.findall(_W + "lvl"):
            ilvl = _int(lvl.get(_W + "ilvl"))
            if ilvl is not None and a.get(_W + "abstractNumId") is not None:
                rows.append((a.get(_W + "abstractNumId"), ilvl, _val(lvl, _W + "numFmt"), _val(lvl, _W + "lvlText"),
                             _int(_val(lvl, _W + "start")), _val(lvl, _W + "pStyle")))
    return rows


def docx_numbering(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nums, levels) with the defaults decimal, "%n." and 1."""
    levels = _parse(parts, "word/numbering.xml", _level_rows, ["abs_id", "ilvl", "num_fmt", "lvl_text", "start", "p_style"],
                    "abs_id string, ilvl int, num_fmt string, lvl_text string, start int, p_style string")
    levels = levels.withColumns({
        "num_fmt": F.coalesce("num_fmt", F.lit("decimal")), "start": F.coalesce("start", F.lit(1)),
        "lvl_text": F.coalesce("lvl_text", F.concat(F.lit("%"), (F.col("ilvl") + 1).cast("string"), F.lit(".")))})
    nums = _parse(parts, "word/numbering.xml", lambda r: [
        (_int(n.get(_W + "numId")), _val(n, _W + "abstractNumId")) for n in r.findall(_W + "num")],
        ["num_id", "abs_id"], "num_id int, abs_id string").where("num_id IS NOT NULL AND abs_id IS NOT NULL")
    return nums, levels


def style_uses(parts: DataFrame) -> DataFrame:
    """Distinct paragraph and run styles named in the body."""
    xml = F.col("content").cast("string")
    p = parts.where(F.col("part") == "word/document.xml").select("doc_id", F.inline(F.array(
        *[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(xml, F.lit(f'<w:{k}Style w:val="([^"]+)"'), F.lit(1)).alias("ids"))
          for k in ("p", "r")])))
    return p.select("doc_id", "kind", F.explode("ids").alias("style_id")).distinct()


def docx_cells(parts: DataFrame) -> DataFrame:
    """Cells of body tables with their column span."""
    def rows(root):
        out = []
        body = root.find(_W + "body")
        for t, tbl in enumerate([] if body is None else body.findall(_W + "tbl")):
            for r, tr in enumerate(tbl.findall(_W + "tr")):
                head = tr.find(f"{_W}trPr/{_W}tblHeader") is not None
                for c, tc in enumerate(tr.findall(_W + "tc")):
                    span = _int(_val(tc, f"{_W}tcPr/{_W}gridSpan")) or 1
                    out.append((t, r, c, "th" if head else "td", head, span, 1, "".join(x.text or "" for x in tc.iter(_W + "t")), None))
        return out

    return _parse(parts, "word/document.xml", rows,
                  "table_idx row_idx cell_idx tag in_thead colspan rowspan text scope".split(),
                  "table_idx int, row_idx int, cell_idx int, tag string, in_thead boolean, colspan int, rowspan int, text string, scope string")


_BRACKETS = {"ins": "[[NEW: ", "del": "[[OLD: "}


def _change_text(paragraph):
    """Text of a paragraph in document order. The walk keeps a list of what is still to come; the end of a change waits there as
    plain text. Inside a deletion only deleted text counts."""
    pieces, ahead = [], [(False, child) for child in reversed(paragraph)]
    while ahead:
        deleted, item = ahead.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        name = item.tag.rpartition("}")[2]
        if name == "delText" or (name == "t" and not deleted):
            pieces.append(item.text or "")
            continue
        if name in _BRACKETS and not deleted:
            pieces.append(_BRACKETS[name])
            ahead.append((False, "]]"))
        ahead.extend((deleted or name == "del", child) for child in reversed(item))
    return "".join(pieces)


def tracked_change_text(parts: DataFrame) -> DataFrame:
    """Paragraphs with pending changes, shown as [[NEW: ...]] and [[OLD: ...]]."""
    def rows(root):
        return [(i, _change_text(p)) for i, p in enumerate(_body_paragraphs(root))
                if next(p.iter(_W + "ins"), None) is not None or next(p.iter(_W + "del"), None) is not None]

    return _parse(parts, "word/document.xml", rows, ["para_idx", "text"], "para_idx int, text string")
