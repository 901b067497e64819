import io
import zipfile

from pyspark.sql import functions as F

from docweave.operators import audit as A
from docweave.plans import corpus as C
from docweave.sources import docx as D
from docweave.sources import html as S
from docweave.sources import maps as M
from docweave.streaming import jobs as J

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body, extra=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
                                      f'<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
        for name, data in extra:
            z.writestr(name, data)


def test_docx_reading(spark, tmp_path):
    docx(tmp_path / "a.docx", '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Chapter One - Admin</w:t></w:r></w:p><w:p><w:r><w:t>See Chapter 1.A</w:t></w:r></w:p>'
                              '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Term</w:t></w:r></w:p></w:tc></w:tr></w:tbl>')
    docx(tmp_path / "b.docx", '<w:p><w:ins><w:r><w:t>n</w:t></w:r></w:ins><w:del><w:r><w:delText>o</w:delText></w:r></w:del></w:p>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    parts = D.read_docx_parts(spark, str(tmp_path))
    p = [(r.text, r.style_name, r.heading_level) for r in D.docx_paragraphs(parts).orderBy("doc_id", "para_idx").collect()]
    assert p == [("Chapter One - Admin", "Heading 1", 1), ("See Chapter 1.A", "Normal", 0), ("", "Normal", 0)]
    assert sorted(r.marks for r in A.tracked_change_counts(parts).collect()) == [0, 2]
    assert [r.text for r in D.tracked_change_text(parts).collect()] == ["[[NEW: n]][[OLD: o]]"]
    assert D.docx_cells(parts).count() == 1
    clean, refused = A.quarantine_tracked_changes(parts.select("doc_id").distinct(), parts)
    assert clean.count() == 1 and refused.count() == 1


def test_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("manifest.json", '{"document": "d.docx", "doc_hash": "h", "toc_depth": 3, "files": {"docx": "d.docx", "edits": "edits.json"}, "stable_heading_map": {"old": "o"}}')
        z.writestr("edits.json", '{"reference_edits": {"ref_1_2_aaaaaaaa": "New"}, "reference_ignored": {"ref_1_2_aaaaaaaa": true}}')
        z.writestr("stable_heading_map.json", '{"Overview": ["a", "b"]}')
    files = D.read_archives(spark, str(tmp_path), "*.zip")
    out = M.read_bundles(D.archive_parts(files))
    assert out["manifests"].first().toc_depth == 3
    assert sorted((r.kind, r.value) for r in out["edits"].collect()) == [("reference_edits", "New"), ("reference_ignored", "true")]
    assert [r.id for r in out["stable_map"].orderBy("nth").collect()] == ["a", "b"]
    assert D.archive_members(files).count() == 3


def test_nested_blocks_count_twice(spark):
    df = spark.createDataFrame([(1, '<ul><li><p>See <a href="#x">Section 1.A.2</a> &amp; <b>more</b></p></li></ul><p>open<p>inner</p>')], "doc_id long, html string")
    nodes = S.html_nodes(df)
    blocks = {r.block_idx: r.text for r in S.html_blocks(nodes).collect()}
    assert blocks == {0: "SeeSection 1.A.2&more", 1: "SeeSection 1.A.2&more", 2: "openinner", 3: "inner"}
    segs = S.html_segments(nodes).where("in_link").collect()
    assert {(s.block_idx, s.start, s.end, s.href) for s in segs} == {(0, 3, 16, "#x"), (1, 3, 16, "#x")}


def test_roots_and_cells(spark):
    html = ('<body><div class="manual-grid" data-manual-type="section" data-heading-offset="1"><main class="manual"><h2 id="a">One</h2>'
            '<table><thead><tr><th colspan="2">T</th></tr></thead><tr><td>1</td><td>2</td></tr></table></main></div></body>')
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    r = S.manual_roots(S.html_nodes(df)).first()
    assert (r.root_tag, r.manual_type, r.heading_offset) == ("main", "section", 1)
    out = C.import_pages(df)["headings"].first()
    assert (out.level, out.id) == (1, "a")
    assert S.html_cells(S.html_nodes(df)).where("in_thead").first().colspan == 2


def test_convert_corpus_with_edits(spark):
    html = '<h1>Chapter 1 - Rules</h1><h2>1.1 Leave</h2><p>See Section 1.A for leave, and <a href="#gone">x</a>.</p>'
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    from docweave.functions import labels as L
    edits = spark.createDataFrame([(1, "Section 1.A", 4)], "doc_id long, label string, start int").select(
        "doc_id", L.ref_id(F.lit(0), "start", "label").alias("ref_id"), F.lit("reference_validations").alias("kind"), F.lit("true").alias("value"))
    out = C.convert_corpus(df, edits=edits)
    assert [r.numbered_text for r in out["headings"].orderBy("ord").collect()] == ["Chapter 1 - Rules", "1.1 Leave"]
    assert out["dead_links"].first().target == "gone"
    d = out["decisions"].first()
    assert (d.decision, d.href) == ("link", "#leave")


def test_incremental_ingest(spark, tmp_path):
    src, work = tmp_path / "in", tmp_path / "w"
    schema = "doc_id long, content string, config_hash string"
    put = lambda rows, n: spark.createDataFrame(rows, schema).write.parquet(str(src / n))
    put([(1, "a", "c"), (2, "b", "c")], "x")
    run = lambda: J.stream_ingest(spark, spark.readStream.schema(schema).parquet(str(src) + "/*"), str(work), lambda df: df.select("doc_id", "content"))
    run()
    put([(1, "a", "c"), (2, "b2", "c"), (3, "d", "c")], "y")
    run()
    rows = spark.read.parquet(str(work / "out")).collect()
    assert sorted((r.doc_id, r.content, r.batch) for r in rows) == [(1, "a", 0), (2, "b", 0), (2, "b2", 1), (3, "d", 1)]


def test_map_sinks_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(1, "overview", 1, "a"), (1, "overview", 2, "b")], "doc_id long, signature string, nth long, id string")
    M.write_stable_map(m, str(tmp_path / "m"))
    assert sorted(map(tuple, M.read_stable_map(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, m.collect()))
    lines = spark.createDataFrame([(1, 0, None, "<ul>"), (1, 1, 5, "<li>"), (1, 2, None, "</ul>")], "doc_id long, part int, ord long, line string")
    M.write_toc(lines, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 3


def test_scripts_and_styles_do_not_send_a_page_to_the_general_parser(monkeypatch):
    page = '<style>p {a: "&amp;"}</style><p onclick="go()">a &amp; b<script src="x">if (a &amp;&amp; b) go()</script><SCRIPT></SCRIPT> c</p><h1>t</h1>'
    odd = page + "<script>a < b</script><p>d</p>"
    general = [S._Reader(), S._Reader()]
    for reader, html in zip(general, (page, odd)):
        reader.read("<!-- -->" + html)
    mixed = S._Reader()
    mixed.read(odd)
    assert mixed.text == general[1].text[1:] and mixed.inner == general[1].inner[1:]
    monkeypatch.setattr(S._Reader, "feed", lambda self, data: (_ for _ in ()).throw(AssertionError("HTMLParser was asked")))
    plain = S._Reader()
    plain.read(page)
    for name in ("kind", "tag", "text", "inner", "names", "values"):
        assert getattr(plain, name) == getattr(general[0], name)[(0 if name in ("names", "values") else 1):]


def test_plain_markup_is_read_without_the_general_parser(spark, monkeypatch):
    page = '<div class="m"><table><tr><th colspan=2>A &amp; B</th></tr><tr><td id="x">1</td><td>2</td></tr></table><ol type="a"><li>x<ol><li>y</li></ol></li></ol></div>'
    general = S._Reader()
    general.read("<!-- -->" + page)  # a comment in front sends the page through HTMLParser
    monkeypatch.setattr(S._Reader, "feed", lambda self, data: (_ for _ in ()).throw(AssertionError("HTMLParser was asked")))
    plain = S._Reader()
    assert plain.read(page) == plain.read(page) == len(general.node) - 1
    for name in ("kind", "tag", "ord", "text", "inner", "spaced", "names", "values", "up_tag"):
        have = getattr(plain, name)
        skip = 1 if len(getattr(general, name)) * 2 > len(have) else 0
        assert have == getattr(general, name)[skip:] * 2, name
    some = S._Reader(frozenset(("td", "th")))
    assert some.read(page) == 3 and some.spaced == ["A & B", "1", "2"] and some.up_tag == ["div", "table", "tr"] * 3


def test_parsed_rows_keep_long_ids_next_to_a_null_id(spark):
    big = 2 ** 53 + 1
    pages = spark.createDataFrame([(big, "<p>a</p>"), (None, "<p>b</p>"), (7, None)], "doc_id long, html string").coalesce(1)
    assert {r.doc_id for r in S.html_nodes(pages).collect()} == {big, None}
    xml = f"<w:document {W}><w:body><w:p><w:r><w:t>t</w:t></w:r></w:p></w:body></w:document>".encode()
    parts = spark.createDataFrame([(big, "word/document.xml", bytearray(xml)), (None, "word/document.xml", bytearray(xml)), (8, "word/document.xml", bytearray(b"<broken"))],
                                  "doc_id long, part string, content binary").coalesce(1)
    assert {(r.doc_id, r.text) for r in D.docx_paragraphs(parts).select("doc_id", "text").collect()} == {(big, "t"), (None, "t")}
