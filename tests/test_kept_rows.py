"""Cases that must not be dropped, and the rewritten placement of spanned cells."""
import io
import json
import random
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import functions as F

from docweave.functions import labels as L
from docweave.operators import headings as H
from docweave.operators import paragraphs as P
from docweave.operators import review as R
from docweave.operators import tables as T
from docweave.plans import corpus as C
from docweave.session import durable
from docweave.sources import docx as D
from docweave.sources import html as S
from docweave.sources import maps as M
from docweave.streaming import jobs as J


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_large_and_broken_archives_stay(spark):
    many = packed(**{f"f{i}": "" for i in range(5001)}, **{"word/document.xml": "<a/>"})
    files = spark.createDataFrame([("big", bytearray(many)), ("bad", bytearray(b"no zip"))], "path string, content binary")
    rows = {(r["doc_id"], r["part"]) for r in D.archive_parts(files).collect()}
    assert rows == {("big", "word/document.xml")}
    assert [r["doc_id"] for r in D.unreadable_archives(files).collect()] == ["bad"]


def test_bundle_edits_under_another_name(spark):
    manifest = json.dumps({"document": "d", "files": {"docx": "s.docx", "edits": "review/changes.json"}, "stable_heading_map": {}})
    data = packed(**{"manifest.json": manifest, "review/changes.json": json.dumps({"reference_edits": {"ref_1": "New"}})})
    parts = D.archive_parts(spark.createDataFrame([("b", bytearray(data))], "path string, content binary"))
    assert [(r["ref_id"], r["value"]) for r in M.read_bundles(parts)["edits"].collect()] == [("ref_1", "New")]


def test_fragment_is_its_own_root(spark):
    pages = spark.createDataFrame([(1, "<h1>Leave</h1><p>See Chapter 1.A</p>"), (2, "<body><h1>A</h1></body>"), (3, '<div class="manual-grid"><p>x</p></div>'),
                                   (4, '<div class="manual-grid"><main class="manual"><h1>M</h1></main></div>')], "doc_id long, html string")
    roots = {r["doc_id"]: (r["root_idx"], r["root_tag"]) for r in S.manual_roots(S.html_nodes(pages)).collect()}
    assert roots == {1: (-1, None), 2: (0, "body"), 4: (1, "main")}
    heads = {r["doc_id"] for r in C.import_pages(pages)["headings"].collect()}
    assert heads == {1, 2, 4}


def test_edits_of_other_documents_come_back(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "old")], "doc_id long, content string")
    new = spark.createDataFrame([(1, "same"), (2, "new"), (3, "changed")], "doc_id long, content string")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    parts = spark.createDataFrame([(3, "word/document.xml", bytearray(f"<w:document {w}><w:body><w:p><w:ins><w:r><w:t>x</w:t></w:r></w:ins></w:p></w:body></w:document>".encode()))],
                                  "doc_id long, part string, content binary")
    refs = spark.createDataFrame([], "doc_id long, para_idx int, para_text string, label string, start int, end int")
    edits = spark.createDataFrame([(d, f"ref_{d}", "reference_edits", "v") for d in (1, 2, 3, 9)], "doc_id long, ref_id string, kind string, value string")
    maps = spark.createDataFrame([], "doc_id long, signature string, nth int, id string")
    out = C.reimport_revision(docs, new, parts, refs, edits, maps, maps)
    assert {r["doc_id"]: r["status"] for r in out["untouched_edits"].select("doc_id", "status").collect()} == {3: "refused", 9: "absent"}


def test_bare_text_is_neither_counted_nor_removed(spark):
    rows = [("p", "cover"), (None, "\n"), ("h1", "Chapter 1 Rules")] + [(None, " ")] * 6 + [("p", "long enough to be real content")]
    children = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, child_idx int, tag string, text string")
    assert sorted(r["child_idx"] for r in P.strip_front_matter(children).collect()) == list(range(1, len(rows)))
    toc = spark.createDataFrame([(1, 0, "h2", "Table of Contents"), (1, 1, "p", "a ... 3"), (1, 2, None, "text"), (1, 3, "h2", "Next")], "doc_id long, child_idx int, tag string, text string")
    assert sorted(r["child_idx"] for r in P.strip_front_matter(toc).collect()) == [2, 3]


def test_positions_over_a_million_sort_before_unknown_ones(spark):
    cw = spark.createDataFrame([(1, "a.1", 2_000_000), (1, "a.1", None)], "doc_id long, old_ref string, ord int")
    assert [r["ord"] for r in R.sort_crosswalk(cw).collect()] == [2_000_000, None]


def test_entries_before_the_first_chapter(spark):
    heads = spark.createDataFrame([(1, 0, 2, "Preface"), (1, 1, 1, "Rules")], "doc_id long, ord int, level int, text string")
    assert H.table_of_contents(heads).count() == 1 and H.table_of_contents(heads, leading_entries=True).count() == 2


def test_state_of_another_kind_is_an_error_not_a_first_batch(spark, tmp_path):
    assert not J._exists(spark, str(tmp_path / "none")) and J._exists(spark, str(tmp_path))


def test_changes_in_document_order():
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    p = ET.fromstring(f'<p xmlns:w="{w[1:-1]}"><w:r><w:t>keep </w:t></w:r><w:ins><w:r><w:t>one</w:t></w:r><w:del><w:r><w:delText>two</w:delText><w:t>x</w:t></w:r></w:del></w:ins><w:del><w:ins><w:r><w:delText>three</w:delText></w:r></w:ins></w:del><w:r><w:t>.</w:t></w:r></p>')
    assert D._change_text(p) == "keep [[NEW: one[[OLD: two]]]][[OLD: three]]."


def painted(cells):
    """Columns by painting a sheet: a cell goes to the first unpainted place at or after the one before it."""
    sheet, out = {}, {}
    for r in sorted({c[0] for c in cells}):
        col, new = 0, {}
        for _, k, width, height in sorted(c for c in cells if c[0] == r):
            while sheet.get(col, -1) >= r:
                col += 1
            out[r, k] = col
            if height > 1:
                new.update(dict.fromkeys(range(col, col + width), r + height - 1))
            col += width
        sheet.update(new)
    return out


def test_spanned_cells_against_a_painted_sheet(spark):
    rng = random.Random(2)
    tables = {t: [(r, c, rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for r in range(rng.randint(1, 12)) for c in range(rng.randint(1, 5))] for t in range(25)}
    cells = spark.createDataFrame([(1, t, *c) for t, own in tables.items() for c in own], "doc_id long, table_idx int, row_idx int, cell_idx int, colspan int, rowspan int")
    got = {(r["table_idx"], r["row_idx"], r["cell_idx"]): r["col_idx"] for r in T.table_grid(cells).collect()}
    assert got == {(t, r, k): col for t, own in tables.items() for (r, k), col in painted(own).items()}


def test_edits_as_many_as_the_corpus_are_not_broadcast(spark):
    from docweave.operators import edits as E

    refs = durable(spark.range(3000).select((F.col("id") % 30).alias("doc_id"), F.col("id").cast("int").alias("para_idx"), F.lit(15).alias("start"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("Section "), F.col("id") % 40)).alias("label")))
    ids = refs.select("doc_id", L.ref_id("para_idx", "start", "label").alias("ref_id"), F.lit("reference_edits").alias("kind"), F.lit("x").alias("value"))
    saved = durable(ids.where("doc_id % 2 = 0").unionByName(ids.limit(50)).unionByName(spark.createDataFrame([(0, "ref_007_15_0a1b2c3d", "reference_edits", "y"), (None, None, "reference_edits", "z")], ids.schema)))
    for df in (E.edited_ids(saved, refs), E.reattach_edits(refs, saved), E.reattach_edits(refs, saved, trust_exact=True)):
        df.count()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    both = {tuple(r) for r in saved.select("doc_id", "ref_id").collect()} & {tuple(r) for r in ids.select("doc_id", "ref_id").collect()}
    assert sorted(map(tuple, E.edited_ids(saved, refs).collect()), key=str) == sorted(both, key=str)
    # Numbers that are no whole type keep the id as it was written.
    other = refs.withColumn("start", F.col("start").cast("string"))
    rows = lambda r: sorted(map(str, E.reattach_edits(r, saved, trust_exact=True).collect()))
    assert rows(refs) == rows(other)


def test_what_is_looked_up_goes_by_its_number(spark):
    from docweave.operators import references as R

    index = durable(spark.createDataFrame([(1, "Chapter 1", 1, "Go", "Chapter 1 - Go", "go"), (1, "Chapter 2", 2, "Stay", "Chapter 2 - Stay", ""), (2, "Chapter 1", 1, "Go", "Chapter 1 - Go", "go")],
                                          "doc_id long, key string, ord int, text string, full string, id string"))
    wanted = spark.createDataFrame([(1, "Chapter 1", None, None), (1, "Chapter 1", None, "stay"), (1, "Chapter 9", "Go", ""), (1, None, "Go", ""), (None, "Chapter 1", "Go", ""), (1, "Chapter 1", None, None)],
                                   "doc_id long, label string, display string, target string")
    cross = spark.createDataFrame([(1, "Chapter 9", "Chapter 1"), (1, "Chapter 9", "nothing")], "doc_id long, old_ref string, new_ref string")
    out = R.resolve_anchors(wanted, index, cross)
    got = sorted((tuple(r[c] for c in ("doc_id", "label", "display", "target", "cross", "anchor")) for r in out.collect()), key=str)
    assert got == sorted([(1, "Chapter 1", "", "", None, None), (1, "Chapter 1", "", "stay", None, None), (1, "Chapter 9", "Go", "", "Chapter 1", "go"), (1, "Chapter 9", "Go", "", "nothing", "go"),
                          (1, None, "Go", "", None, None), (None, "Chapter 1", "Go", "", None, None)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "display" in x]
