"""The full conversion on one page that shows every pass, edit scripts on small nodes, and table functions in SQL."""
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.functions.table_functions import register_tables
from docweave.operators import edit_script, tables as T
from docweave.operators.edit_script import EditScript
from docweave.plans import corpus as C, passes as P
from docweave.session import durable
from docweave.sources import html as S

PAGE = '''<html><head><style>x</style></head><body><p>Cover</p><h1>Table of Contents</h1><p>Chapter 1 .... 3</p><ul><li>x</li></ul><h1>Chapter 1 - Rules</h1>
<p id="k">Some long text that is content &amp; more, see <a href="#gone">x</a> and <a href="javascript:alert(1)" onclick="x">j</a> Section 9.Z here.</p>
<h2 id="old">1.1 <b>Leave</b> now</h2><p class="c">a. first</p><p>b. sec<i>ond</i></p><p><b>3.</b> third</p><p><a href="#old">to</a><script>bad()</script><img src="x.png"></p>
<table class="grid manual-table-left"><thead><tr><th colspan="2">Title</th></tr></thead><tbody><tr><td>Name</td><td style="color: red">12</td></tr><tr><td>B</td><td><p>7</p></td></tr></tbody></table>
<table><thead><tr><th>h</th></tr><tr><th>i</th></tr></thead><tbody><tr><td>z</td></tr></tbody></table>
<ol type="A"><li>x<ol><li>y</li></ol></li></ol><font>f</font><u><a href="https://a.b/">l</a></u></body></html>'''.replace("\n", "")


def test_page_through_every_pass(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "doc_id long, html string")
    modes = spark.createDataFrame([(1, 0, "table_headers", "title_row"), (1, 1, "table_headers", "none"), (1, 0, "table_blocks", "center")], "doc_id long, table_idx int, kind string, mode string")
    titles = spark.createDataFrame([(1, "leave-now", 3, "Leave & <Pay>")], "doc_id long, id string, level int, text string")
    out = C.convert_corpus(pages, C.Settings(header="right"), table_overrides=modes, heading_edits=titles)
    refs = out["references"].select("doc_id", "ref_id").distinct()
    out.edits = refs.select("doc_id", "ref_id", F.lit("reference_external_urls").alias("kind"), F.lit("https://x.example/?a=1&b").alias("value"))
    left = 'class="manual-align-left" style=" text-align: left !important;"'
    head = 'class="manual-align-right" scope="col"'
    style = lambda kind: f'data-list-style="{kind}" style="list-style-type: {kind} !important;"'
    want = ('<h1 id="rules">Rules</h1><p id="k">Some long text that is content &amp; more, see x and <a>j</a> <a href="https://x.example/?a=1&amp;b">Section 9.26</a> here.</p>'
            '<h3 id="leave-now">Leave &amp; &lt;Pay&gt;</h3>'
            f'<ol type="a" class="list-alpha-lower" {style("lower-alpha")}><li>first</li><li>sec<i>ond</i></li></ol><ol type="" class="list-decimal" {style("decimal")} start="3"><li>third</li></ol>'
            '<p><a href="#leave-now">to</a></p><table class="grid manual-table-center"><caption>Title</caption><thead><tr>'
            f'<th {head} style=" text-align: right !important;">Name</th><th style="color: red; text-align: right !important;" {head}>12</th></tr></thead>'
            f'<tbody><tr><td {left}>B</td><td class="manual-align-center" style=" text-align: center !important;"><p style=" text-align: center !important;">7</p></td></tr></tbody></table>'
            f'<table><tbody><tr><td {left}>i</td></tr><tr><td {left}>h</td></tr><tr><td {left}>z</td></tr></tbody></table>'
            f'<ol type="A" class="list-alpha-upper" {style("upper-alpha")}><li>x<ol class="list-decimal" {style("decimal")}><li>y</li></ol></li></ol>f<a href="https://a.b/">l</a>')
    assert {r.doc_id: r.html for r in out["html"].collect()} == {1: want}
    assert sorted((r.finding, r.name) for r in out["sanitized"].collect()) == [("attribute", "onclick"), ("scheme", "href"), ("tag", "font"), ("underline", "u")]
    assert "html" in out and len(out) == len(C.Conversion.NAMES)
    with pytest.raises(KeyError):
        out["nothing"]


def test_nodes_outside_of_ranges_are_not_ordered(spark, monkeypatch):
    nodes = spark.createDataFrame([(d, i, f"t{i}") for d in (1, 2, None) for i in range(8)] + [(1, 3, "again")], "doc_id long, node_idx int, text string")
    ranges = spark.createDataFrame([(1, 2, 4), (1, 3, 3), (1, 6, 6), (2, 0, 7), (None, 0, 7)], "doc_id long, start int, end int")
    want = sorted([(None, i) for i in range(8)] + [(1, i) for i in (0, 1, 5, 7)], key=str)
    for few in (edit_script.FEW, 0):
        monkeypatch.setattr(edit_script, "FEW", few)
        out = edit_script.outside(nodes, ranges)
        assert sorted(((r.doc_id, r.node_idx) for r in out.collect()), key=str) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan
    assert edit_script.outside(nodes, ranges.limit(0)).count() == 25


def test_tables_as_long_as_the_corpus_are_not_broadcast(spark):
    cells = durable(spark.range(4000).select(
        F.floor(F.col("id") / 40).alias("doc_id"), F.floor(F.col("id") % 40 / 20).cast("int").alias("table_idx"), F.floor(F.col("id") % 20 / 4).cast("int").alias("row_idx"),
        (F.col("id") % 4).cast("int").alias("cell_idx"), F.lit("td").alias("tag"), F.lit(False).alias("in_thead"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"),
        F.lit("7").alias("text"), F.lit(None).cast("string").alias("scope")))
    modes = cells.select("doc_id", "table_idx", F.lit("table_aligns").alias("kind"), F.lit("auto").alias("mode")).distinct()
    grid = durable(T.table_grid(cells))
    for df in (T.table_grid(cells), T.align_cells(grid, overrides=modes), T.repair_table_headers(cells, modes)):
        assert df.count() == 4000
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_edits_of_one_document(spark):
    nodes = S.html_nodes(spark.createDataFrame([(1, "<div a='1' b='2'><p>one <b>two</b> three</p><i>x</i></div><p>end</p>")], "doc_id long, html string"))
    at = {r.tag or r.text: (r.node_idx, r.end_idx) for r in nodes.collect()}
    row = lambda schema, *values: spark.createDataFrame([(1, *values)], "doc_id long, " + schema)
    (div, div_end), (b, _), (i, i_end) = at["div"], at["b"], at["i"]
    p, p_end = div + 1, i - 1
    shown = lambda script: script.rendered().first().html
    assert shown(EditScript(nodes)) == '<div a="1" b="2"><p>one <b>two</b> three</p><i>x</i></div><p>end</p>'
    script = EditScript(nodes).cut(row("node_idx int, end_idx int, n int", p, p_end, 9)).attribute(row("node_idx int, name string, value string", div, "a", None))
    later = EditScript(nodes).attribute(row("node_idx int, name string, value string", div, "b", "<\"")).wrap(
        row("start int, end int, tag string", p, i_end, "q").withColumn("attrs", F.create_map(F.lit("k"), F.lit("v")))).first(row("node_idx int, tag string, text string", div, "em", "&"))
    assert shown(script.extend(later)) == '<div b="&lt;&quot;"><em>&amp;</em><q k="v"><p>hree</p><i>x</i></q></div><p>end</p>'
    moved = EditScript(nodes).move(row("start int, end int", i, i_end).withColumn("at", EditScript.front(F.lit(div), 0))).rename(row("node_idx int, tag string", b, "u"))
    assert shown(moved) == '<div a="1" b="2"><i>x</i><p>one <u>two</u> three</p></div><p>end</p>'


def test_table_functions(spark):
    assert register_tables(spark) == ["html_nodes", "archive_members"]
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "doc_id long, html string")
    pages.createOrReplaceTempView("docs_of_test")
    names = "node_idx parent_idx depth end_idx kind tag ord text attrs link_idx href".split()
    rows = spark.sql("SELECT d.doc_id, n.* FROM docs_of_test d, LATERAL html_nodes(d.html) n")
    assert rows.columns == ["doc_id", *names]
    plain = S.html_nodes(pages).select("doc_id", *names)
    ordered = lambda df: sorted(str(r) for r in df.withColumn("attrs", F.array_sort(F.map_entries("attrs"))).collect())
    assert ordered(rows) == ordered(plain)
    some = spark.sql("SELECT n.tag, n.inner FROM docs_of_test d, LATERAL html_nodes(d.html, 'H1 h2') n").collect()
    assert [tuple(r) for r in some] == [("h1", "Table of Contents"), ("h1", "Chapter 1 - Rules"), ("h2", "1.1 Leave now")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("b.txt", "two" * 50)
    broken = data.getvalue().replace(b"two" * 50, b"twx" + b"two" * 49)
    spark.createDataFrame([(1, data.getvalue()), (2, broken), (3, b"no zip"), (4, None)], "doc_id long, content binary").createOrReplaceTempView("zips_of_test")
    got = {(r.doc_id, r.part): (r.error is None, r.content) for r in spark.sql("SELECT d.doc_id, m.* FROM zips_of_test d, LATERAL archive_members(d.content, true) m").collect()}
    assert got == {(1, "a.txt"): (True, b"one"), (1, "b.txt"): (True, b"two" * 50), (2, "a.txt"): (True, b"one"), (2, "b.txt"): (False, None), (3, None): (False, None), (4, None): (False, None)}


def test_ranges_are_written_as_one_row_for_64_nodes(spark, monkeypatch):
    written = []
    monkeypatch.setattr(edit_script, "durable", lambda df: written.append(durable(df)) or written[-1])
    nodes = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("node_idx"))
    ranges = spark.createDataFrame([(1, 3, 900), (1, 63, 64), (1, 950, 950), (1, 960, 959)], "doc_id long, start int, end int")
    out = edit_script.outside(nodes, ranges)
    assert sorted(r.node_idx for r in out.collect()) == [i for i in range(1000) if not (3 <= i <= 900 or i == 950)]
    assert sum(df.count() for df in written) == 15
    # What a pass does not take of the nodes never meets the ranges.
    plan = out.where("node_idx = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("= 3)")


def test_contents_end_at_the_next_heading_of_the_same_parent(spark):
    html = ("<body>0<p>cover</p>1<div><h2>Table of Contents</h2>x<p>a</p><p>b</p></div><h1>Table of Contents</h1><p>c</p>2<ul><li>d<h2>inner</h2></li></ul><h1>Chapter 1 - Go</h1>"
            "<p>short</p><p>long enough to be the text</p><h2>Table of Contents</h2><p>e</p></body>")
    nodes = durable(S.html_nodes(spark.createDataFrame([(1, html), (2, "<p>no heading</p>")], "doc_id long, html string")))
    shown = {r.node_idx: r.inner if r.tag in ("p", "h1", "h2") else r.tag for r in nodes.where("doc_id = 1 AND kind = 'tag'").collect()}
    rows = P.front_matter(S.drop_nodes(nodes), S.manual_roots(nodes)).collect()
    got = sorted((r.doc_id, r.reason, shown[r.start]) for r in rows)
    assert got == sorted([(1, "contents", x) for x in ("Table of Contents", "a", "b", "Table of Contents", "c", "ul", "Table of Contents", "e")] + [(1, "before the first chapter", x) for x in ("cover", "div")])


def test_nodes_of_a_conversion_name_the_ancestors_that_passes_ask_for(spark):
    out = C.convert_corpus(spark.createDataFrame([(1, "<html><body><div><p><b>x</b><i>y</i></p></div></body></html>")], "doc_id long, html string"))
    path = {r.text: [p.tag for p in r.path] for r in out.nodes.where("kind = 'text'").collect()}
    assert path == {"x": ["p"], "y": ["p"]}
    assert [r.seg_idx for r in out.segments.orderBy("seg_idx").collect()] == [0, 1]
