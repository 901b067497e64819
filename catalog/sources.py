"""Queries over parsed pages, Word parts, JSON maps, streams and corpus jobs."""

from pyspark.sql import functions as F

from docweave.functions import fixed as K
from docweave.functions import labels as L
from docweave.operators import audit as A
from docweave.operators import headings as H
from docweave.operators import numbering as N
from docweave.operators import references as R
from docweave.plans import corpus as C
from docweave.sources import docx as D
from docweave.sources import html as S
from docweave.sources import maps as M
from docweave.streaming import jobs as J

from . import sqlx as X
from .registry import ORACLES, query

pages = lambda s: s("pages").select(F.col("page_id").alias("doc_id"), "html")
nodes = lambda s: S.html_nodes(pages(s))

query("html_nodes")(lambda s: nodes(s).select("doc_id", "node_idx", "parent_idx", "depth", "kind", "tag", "text"))
query("html_segments")(lambda s: S.html_segments(nodes(s)).drop("raw", "node_idx"))
query("html_blocks")(lambda s: S.html_blocks(nodes(s)))
UNESC = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
query("html_headings", f"""SELECT page_id AS doc_id, 1 AS level, {X.strip(UNESC.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS text FROM pages WHERE contains(html, '<h1>')""")(
    lambda s: S.html_headings(S.html_nodes(pages(s), tags=("h1", "h2", "h3", "h4", "h5", "h6"))).select("doc_id", "level", "text"))
query("html_links", """SELECT page_id AS doc_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) z GROUP BY ALL""")(
    lambda s: S.html_links(S.html_nodes(pages(s), tags=("a",))).groupBy("doc_id", "href").agg(F.countDistinct("node_idx").alias("n")))
query("html_cells")(lambda s: S.html_cells(S.html_nodes(table_pages(s), tags=("td", "th"))))
query("html_cell_texts", """WITH r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS row_idx, ln, f, CAST(qty AS VARCHAR) AS q FROM fx_lines)
SELECT doc_id, 0 AS table_idx, row_idx, 'th' AS tag, 2 AS colspan, f AS text FROM r WHERE ln = 1
UNION ALL SELECT doc_id, 0, row_idx, 'td', 1, unnest([f, q]) FROM r WHERE ln <> 1""")(
    lambda s: S.html_cells(S.html_nodes(table_pages(s), tags=("td", "th"))).select("doc_id", "table_idx", "row_idx", "tag", "colspan", "text"))
query("convert_corpus_cell_texts", """WITH r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS row_idx, ln, f, CAST(qty AS VARCHAR) AS q FROM fx_lines)
SELECT doc_id, row_idx, f AS text FROM r WHERE ln = 1 UNION ALL SELECT doc_id, row_idx, unnest([f, q]) FROM r WHERE ln <> 1""")(
    lambda s: C.convert_corpus(table_pages(s))["cells"].select("doc_id", "row_idx", "text"))
query("html_lists")(lambda s: S.html_lists(S.html_nodes(table_pages(s), tags=("ol",))))
query("manual_roots", "SELECT page_id AS doc_id, 'body' AS root_tag, 'chapter' AS manual_type FROM pages WHERE contains(html, '<body')")(
    lambda s: S.manual_roots(nodes(s)).select("doc_id", "root_tag", "manual_type"))
query("drop_nodes", "SELECT page_id AS doc_id, 0::BIGINT AS raw_nodes FROM pages")(
    lambda s: S.drop_nodes(nodes(s)).groupBy("doc_id").agg(F.count_if(F.col("kind") == "raw").alias("raw_nodes")))
query("unwrap_inline")(lambda s: S.unwrap_inline(nodes(s)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth")))
query("markup_audit")(lambda s: A.markup_audit(nodes(s)))
query("external_links")(lambda s: R.external_links(S.html_links(S.html_nodes(pages(s), tags=("a",)))))


def table_pages(s):
    """Pages with one table and one list per order block, rendered by Spark from line items."""
    rows = s("fx_lines").groupBy("doc_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(
        F.when(F.col("ln") == 1, "<tr><th colspan=2>").otherwise("<tr><td>"), F.col("f"),
        F.when(F.col("ln") == 1, "</th></tr>").otherwise(F.concat(F.lit("</td><td>"), F.col("qty").cast("string"), F.lit("</td></tr>")))).alias("h")))),
        lambda x: x["h"])).alias("body"))
    return rows.select("doc_id", F.concat(F.lit('<div class="manual-grid" data-toc-depth="3" data-heading-offset="1"><div class="manual"><h1>Chapter 1 - Rules</h1><h2>1.1 Tables</h2><h2>1.1 Tables</h2><table>'),
                                          "body", F.lit('</table><ol type="a"><li>x<ol><li>y</li></ol></li></ol></div></div>')).alias("html"))


# JSON maps
query("read_heading_map", """SELECT doc_id, sig AS signature, row_number() OVER (PARTITION BY doc_id, sig ORDER BY o) AS nth, id FROM (
  SELECT doc_id, 'order ' || ck sig, 1 o, 'id-' || ck id FROM fx_maps WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'order ' || ck, 1, 'a' FROM fx_maps WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, 'order ' || ck, 2, 'b' FROM fx_maps WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, 'order ' || ck, i, ['x', 'y', 'z'][i] FROM fx_maps, (SELECT unnest([1, 2, 3]) i) q WHERE doc_id % 5 = 2 UNION ALL SELECT doc_id, 'order ' || ck, 1, 'x' FROM fx_maps WHERE doc_id % 5 = 3) z""")(
    lambda s: M.read_heading_map(s("fx_maps")))
query("read_sequence_map", """SELECT doc_id, 'decimal>alpha_upper' AS sequence, CAST(1 + ck % 5 AS INT) AS level FROM fx_maps WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'decimal', 1 FROM fx_maps WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'roman_upper>decimal', CAST(1 + ck % 5 AS INT) FROM fx_maps WHERE doc_id % 3 = 1""")(lambda s: M.read_sequence_map(s("fx_maps"), "seq_raw"))
SEQ_ENTRY = """'{"sequence":[' || {} || '],"level":' || CAST({} AS INT) || '}'"""
query("sequence_map_json", f"""SELECT doc_id, 'roman_upper>decimal' AS sequence, {SEQ_ENTRY.replace('{}', chr(39) + '"roman_upper","decimal"' + chr(39), 1).replace('{}', '1 + ck % 5')} AS entry FROM fx_maps WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'decimal>alpha_upper', {SEQ_ENTRY.replace('{}', chr(39) + '"decimal","alpha_upper"' + chr(39), 1).replace('{}', '1 + ck % 5')} FROM fx_maps WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'decimal', {SEQ_ENTRY.replace('{}', chr(39) + '"decimal"' + chr(39), 1).replace('{}', '1')} FROM fx_maps WHERE doc_id % 3 = 0""")(
    lambda s: M.sequence_map_json(M.read_sequence_map(s("fx_maps"), "seq_raw")))
query("stable_map_json", f"""SELECT doc_id, signature, row_number() OVER (PARTITION BY doc_id, signature ORDER BY ord) AS nth, '{{"signature":"' || signature || '","id":"' || id || '"}}' AS entry
FROM (SELECT doc_id, ord, {X.sig('text')} AS signature, id FROM fx_anchored) z WHERE signature <> ''""")(lambda s: M.stable_map_json(H.stable_map(s("fx_anchored"))))
query("manifest_json", """SELECT o_orderkey AS doc_id, '{"document":"d' || o_orderkey || '.docx","doc_hash":"' || sha256(CAST(o_orderkey AS VARCHAR)) || '","toc_depth":' || (1 + o_custkey % 3) || '}' AS manifest FROM orders""")(
    lambda s: M.manifest_json(s("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".docx")).alias("document"),
                                                 L.content_hash(F.col("o_orderkey").cast("string")).alias("doc_hash"), (1 + F.col("o_custkey") % 3).alias("toc_depth"))))

# Word parts rendered from the paragraph view, so that parsing covers every row.
W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def parts(s, changed="true"):
    esc = H.html_escape
    p = s("fx_paras").withColumn("x", F.concat(
        F.lit("<w:p><w:pPr>"), F.concat(F.lit('<w:pStyle w:val="'), "style_id", F.lit('"/>')),
        F.when(F.col("num_id").isNotNull(), F.concat(F.lit("<w:numPr>"), F.coalesce(F.concat(F.lit('<w:ilvl w:val="'), F.col("ilvl").cast("string"), F.lit('"/>')), F.lit("")),
                                                     F.lit('<w:numId w:val="'), F.col("num_id").cast("string"), F.lit('"/></w:numPr>'))).otherwise(""),
        F.when(F.col("outline_lvl") > 0, F.concat(F.lit('<w:outlineLvl w:val="'), (F.col("outline_lvl") - 1).cast("string"), F.lit('"/>'))).otherwise(""),
        F.lit("</w:pPr>"), F.when((F.col("para_idx") % 19 == 0) & F.expr(changed), '<w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del>').otherwise(""),
        F.when(F.col("para_idx") % 7 == 0, F.lit('<w:hyperlink w:anchor="xref"><w:r><w:t>go</w:t></w:r></w:hyperlink><w:hyperlink r:id="rId1"><w:r><w:t>web</w:t></w:r></w:hyperlink>')).otherwise(""),
        F.lit('<w:r><w:t xml:space="preserve">'), esc("text"), F.lit("</w:t></w:r></w:p>")))
    body = p.groupBy("doc_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "x"))), lambda z: z["x"])).alias("b"))
    doc = F.concat(F.lit(f"<w:document {W_NS}><w:body>"), "b", F.lit("</w:body></w:document>"))
    styles = (f'<w:styles {W_NS}>' + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/>{b}</w:style>' for i, n, b in (
        ("Heading1", "Heading 1", ""), ("Heading2", "heading 2", '<w:basedOn w:val="Heading1"/>'), ("Normal", "Normal", "<w:rPr><w:b/></w:rPr>"))) + "</w:styles>")
    numbering = (f'<w:numbering {W_NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="upperRoman"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="3"/></w:lvl></w:abstractNum>'
                 '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num></w:numbering>')
    rels = '<Relationships><Relationship Id="rId1" Target="https://x.example/a"/></Relationships>'
    return body.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.encode(c, "UTF-8").alias("content")) for n, c in (
        ("word/document.xml", doc), ("word/styles.xml", F.lit(styles)), ("word/numbering.xml", F.lit(numbering)), ("word/_rels/document.xml.rels", F.lit(rels)))])))


RN = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS INT)"
query("docx_paragraphs", f"""SELECT doc_id, {RN} AS para_idx, CASE WHEN para_idx % 7 = 0 THEN 'goweb' ELSE '' END || text AS text, style_id, CASE WHEN style_id = 'ListItem' THEN NULL ELSE style_name END AS style_name, outline_lvl, num_id,
CASE WHEN num_id IS NOT NULL THEN ilvl END AS ilvl, heading_level FROM fx_paras""")(
    lambda s: D.docx_paragraphs(parts(s)).drop("style_outline_lvl"))
query("docx_hyperlinks", f"""SELECT doc_id, p AS para_idx, i AS link_idx, ['go', 'web'][i + 1] AS text, ['#xref', 'https://x.example/a'][i + 1] AS href, i = 0 AS bad FROM (SELECT doc_id, para_idx o, {RN} AS p FROM fx_paras) z, (SELECT unnest([0, 1]) i) q WHERE o % 7 = 0""")(
    lambda s: D.docx_hyperlinks(parts(s)))
query("docx_numbering", """SELECT doc_id, 0 AS ilvl, 'upperRoman' AS num_fmt, '%1.' AS lvl_text, 1 AS start FROM fx_docs UNION ALL SELECT doc_id, 1, 'decimal', '%2.', 3 FROM fx_docs""")(
    lambda s: D.docx_numbering(parts(s))[1].select("doc_id", "ilvl", "num_fmt", "lvl_text", "start"))
query("docx_styles", """SELECT doc_id, i AS style_id, n AS style_name, b AS based_on FROM fx_docs, (SELECT * FROM (VALUES ('Heading1', 'Heading 1', NULL), ('Heading2', 'heading 2', 'Heading1'), ('Normal', 'Normal', NULL)) v(i, n, b)) q""")(
    lambda s: D.docx_styles(parts(s)).select("doc_id", "style_id", "style_name", "based_on"))
query("docx_style_uses", "SELECT DISTINCT doc_id, 'p' AS kind, style_id FROM fx_paras")(lambda s: D.style_uses(parts(s)))
query("docx_orphan_numbering", "SELECT doc_id, 2 AS num_id FROM fx_docs")(lambda s: N.orphan_numbering(*D.docx_numbering(parts(s))).select("doc_id", "num_id"))
query("tracked_change_counts", "SELECT doc_id, 2 * count(*) FILTER (para_idx % 19 = 0) AS marks, count(*) FILTER (para_idx % 19 = 0) AS insertions, count(*) FILTER (para_idx % 19 = 0) AS deletions FROM fx_paras GROUP BY doc_id")(
    lambda s: A.tracked_change_counts(parts(s)))
query("tracked_change_text", f"""SELECT doc_id, p AS para_idx, '[[NEW: new]][[OLD: old]]' || CASE WHEN o % 7 = 0 THEN 'goweb' ELSE '' END || text AS text FROM (SELECT doc_id, para_idx o, text, {RN} AS p FROM fx_paras) z WHERE o % 19 = 0""")(
    lambda s: D.tracked_change_text(parts(s)))
query("quarantine_tracked_changes", "SELECT doc_id, 2 * count(*) AS marks FROM fx_paras WHERE para_idx % 19 = 0 GROUP BY doc_id")(
    lambda s: A.quarantine_tracked_changes(s("fx_docs"), parts(s))[1])

# Streams
LAST = "SELECT user_id AS ref_id, event_type AS kind, arg_max(ts, event_id) AS ts, arg_max(v, event_id) AS value FROM (SELECT *, CASE WHEN value < 5 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END v FROM events) z GROUP BY ALL"
LASTV = """SELECT ref_id, kind, value FROM (SELECT user_id AS ref_id, event_type AS kind, CASE WHEN value < 5 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) r FROM events) z WHERE r = 1 AND value <> ''"""


def event_stream(s):
    ev = J.read_events(s.spark, s.dir, s.table("events").schema, "events.parquet")
    value = F.when(F.col("value") < 5, "").otherwise(F.floor("value").cast("string"))
    return ev.select(F.col("user_id"), F.col("user_id").alias("ref_id"), F.col("event_type").alias("kind"), value.alias("value"),
                     F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


query("latest_edits", LASTV)(lambda s: J.latest_edits(s("fx_events").withColumn("ts", F.col("ts").cast("timestamp"))).where("NOT deleted").select("ref_id", "kind", "value"))
query("stream_edits", LASTV)(lambda s: J.stream_edits(s.spark, event_stream(s)).select("ref_id", "kind", "value"))
SESS = """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) sid FROM g), z AS (SELECT user_id, count(*) AS n_events, max(ts) mx, min(ts) mn FROM i GROUP BY user_id, sid)
SELECT user_id, n_events, CAST(epoch_us(mn) AS BIGINT) AS start_us FROM z"""
query("sessions", SESS)(lambda s: J.sessions(s("events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours").select("user_id", "n_events", F.unix_micros("start_ts").alias("start_us")))
query("stream_sessions", SESS + " WHERE mx + INTERVAL 12 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)")(
    lambda s: J.stream_sessions(s.spark, event_stream(s), "12 hours").select("user_id", "n_events", F.unix_micros("start_ts").alias("start_us")))
query("expired_runs", """SELECT o_orderkey AS doc_id, o_orderdate + INTERVAL 48 HOUR < TIMESTAMP '1998-08-01' AS expired, CAST(greatest(0, (epoch(o_orderdate) + 172800 - epoch(TIMESTAMP '1998-08-01')) // 3600) AS BIGINT) AS hours_left FROM orders""")(
    lambda s: J.expired_runs(s("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("last_activity")),
                             "1998-08-01 00:00:00").select("doc_id", "expired", "hours_left"))
query("changed_documents", "SELECT doc_id, sha256(text) AS doc_hash FROM documents WHERE doc_id % 3 <> 0")(
    lambda s: J.changed_documents(s("documents").select("doc_id", F.col("text").alias("content"), F.lit("c1").alias("config_hash")),
                                  s("documents").where("doc_id % 3 = 0").select("doc_id", L.content_hash("text").alias("doc_hash"), F.lit("c1").alias("config_hash"))).select("doc_id", "doc_hash"))

# Corpus jobs
query("convert_corpus_headings")(lambda s: C.convert_corpus(pages(s))["headings"].select("doc_id", "ord", "level", "number", "numbered_text", "id"))
query("convert_corpus_toc")(lambda s: C.convert_corpus(table_pages(s))["toc"])
query("convert_corpus_cells")(lambda s: C.convert_corpus(table_pages(s))["cells"])
query("import_pages")(lambda s: C.import_pages(table_pages(s))["headings"].select("doc_id", "ord", "level", "text", "id"))


# Every fifth document has pending changes and is refused; even ones are unchanged, so their ids are trusted; odd ones are revised.
@query("reimport_revision", f"""SELECT * FROM ({ORACLES['reattach_edits_trusted']}) a WHERE doc_id % 5 <> 0 AND doc_id % 2 = 0
UNION ALL SELECT * FROM ({ORACLES['reattach_edits']}) b WHERE doc_id % 5 <> 0 AND doc_id % 2 = 1
UNION ALL SELECT doc_id, ref_id, kind, value, NULL, 'refused' FROM fx_edits WHERE doc_id % 5 = 0""")
def _(s):
    old = s("fx_refs").groupBy("doc_id").agg(F.count("*").cast("string").alias("content"))
    new = old.withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise("revised"))
    out = C.reimport_revision(old, new, parts(s, changed="doc_id % 5 = 0"), s("fx_cites"), s("fx_edits"), H.stable_map(s("fx_anchored_old")), H.stable_map(s("fx_anchored")))
    return out["edits"].unionByName(out["untouched_edits"], allowMissingColumns=True)
