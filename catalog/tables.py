"""Table, list, archive and fingerprint queries."""

from pyspark.sql import functions as F

from docweave.functions import fixed as K
from docweave.operators import audit as A
from docweave.operators import headings as H
from docweave.operators import lists as Li
from docweave.operators import references as R
from docweave.operators import tables as T

from . import sqlx as X
from .headings import HK
from .refs import MATCH
from .registry import query

NUMERIC = r"regexp_matches(regexp_replace(trim(text), '[\s$,% –—]', '', 'g'), '^-?[\d,.]+$')"
GRID = "SELECT *, CAST(coalesce(sum(greatest(1, colspan)) OVER (PARTITION BY doc_id, table_idx, row_idx ORDER BY cell_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col_idx FROM fx_cells"
NUMCOL = f"SELECT doc_id, table_idx, col_idx, count(*) AS seen, count(*) FILTER ({NUMERIC}) AS numeric FROM ({GRID}) g WHERE NOT in_thead AND trim(text) <> '' GROUP BY ALL"
grid = lambda s: T.plain_grid(s("fx_cells"))

query("plain_grid", f"SELECT doc_id, table_idx, row_idx, cell_idx, col_idx FROM ({GRID}) g")(lambda s: grid(s).select("doc_id", "table_idx", "row_idx", "cell_idx", "col_idx"))
query("table_grid_without_row_spans", f"SELECT doc_id, table_idx, row_idx, cell_idx, col_idx FROM ({GRID}) g")(
    lambda s: T.table_grid(s("fx_cells")).select("doc_id", "table_idx", "row_idx", "cell_idx", "col_idx"))
query("table_grid")(lambda s: T.table_grid(s("fx_cells").withColumn("rowspan", F.expr(
    "CASE WHEN cell_idx = 0 AND row_idx % 4 = 0 THEN 3 WHEN cell_idx = 2 AND row_idx % 5 = 0 THEN 2 ELSE 1 END")))
    .select("doc_id", "table_idx", "row_idx", "cell_idx", "col_idx"))
query("classify_numeric_columns", f"SELECT *, numeric > 0 AND numeric * 2 >= seen AS is_numeric FROM ({NUMCOL}) z")(lambda s: T.classify_numeric_columns(grid(s)))
WIDTH = "SELECT doc_id, table_idx, max(w) AS columns, max(n) AS max_cells FROM (SELECT doc_id, table_idx, row_idx, CAST(sum(greatest(1, colspan)) AS BIGINT) w, count(*) n FROM fx_cells GROUP BY ALL) z GROUP BY ALL"
query("table_widths", WIDTH)(lambda s: T.table_widths(s("fx_cells")))
query("first_table_cells", "WITH f AS (SELECT doc_id, min(table_idx) t FROM fx_cells GROUP BY ALL) SELECT doc_id, max(n) AS max_cells FROM (SELECT c.doc_id, row_idx, count(*) n FROM fx_cells c JOIN f ON f.doc_id = c.doc_id AND f.t = c.table_idx GROUP BY ALL) z GROUP BY doc_id")(
    lambda s: T.first_table_cells(s("fx_cells").join(s("fx_cells").groupBy("doc_id").agg(F.min("table_idx").alias("_t")), "doc_id").withColumn("table_idx", F.col("table_idx") - F.col("_t"))))
query("has_tables", "SELECT doc_id, n > 0 AS has_tables FROM (SELECT d.doc_id, count(c.doc_id) AS n FROM (SELECT doc_id FROM fx_docs UNION ALL SELECT -1 - doc_id FROM fx_docs) d LEFT JOIN fx_cells c ON c.doc_id = d.doc_id GROUP BY d.doc_id) z")(
    lambda s: T.has_tables(s.sql("SELECT doc_id FROM fx_docs UNION ALL SELECT -1 - doc_id FROM fx_docs"), s("fx_cells")))
INFO = f"""wd AS ({WIDTH}), hd AS (SELECT doc_id, table_idx, min(row_idx) AS head_row FROM fx_cells WHERE in_thead GROUP BY ALL),
hc AS (SELECT c.doc_id, c.table_idx, count(*) n, max(colspan) sp, max(trim(text)) AS head_text FROM fx_cells c JOIN hd ON hd.doc_id = c.doc_id AND hd.table_idx = c.table_idx AND hd.head_row = c.row_idx GROUP BY ALL),
ro AS (SELECT DISTINCT c.doc_id, c.table_idx, c.row_idx FROM fx_cells c LEFT JOIN hd ON hd.doc_id = c.doc_id AND hd.table_idx = c.table_idx WHERE head_row IS NULL OR c.row_idx <> head_row),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY row_idx) n FROM ro),
inf AS (SELECT wd.doc_id, wd.table_idx, columns, head_row, a.row_idx AS first_row, b.row_idx AS second_row, head_text, coalesce(hc.n = 1 AND columns >= 2 AND sp >= columns AND head_text <> '', false) AS title_row
  FROM wd LEFT JOIN hd USING (doc_id, table_idx) LEFT JOIN hc USING (doc_id, table_idx) LEFT JOIN (SELECT * FROM rn WHERE n = 1) a USING (doc_id, table_idx) LEFT JOIN (SELECT * FROM rn WHERE n = 2) b USING (doc_id, table_idx))"""
TXT = "(SELECT string_agg(substr(trim(c.text), 1, 60), ' | ' ORDER BY c.cell_idx) FROM fx_cells c WHERE c.doc_id = inf.doc_id AND c.table_idx = inf.table_idx AND c.row_idx = inf.{})"
MODE = "coalesce((SELECT max(m.mode) FROM fx_modes m WHERE m.doc_id = inf.doc_id AND m.table_idx = inf.table_idx AND m.kind = '{}'), 'auto')"
query("describe_tables", f"""WITH {INFO} SELECT doc_id, table_idx, {MODE.format('table_headers')} AS mode, {MODE.format('table_aligns')} AS align_mode, {MODE.format('table_blocks')} AS block_mode, columns,
 (SELECT count(DISTINCT row_idx) FROM fx_cells c WHERE c.doc_id = inf.doc_id AND c.table_idx = inf.table_idx) AS row_count, '' AS caption, coalesce({TXT.format('head_row')}, '') AS head_cells, coalesce({TXT.format('first_row')}, '') AS first_cells,
 coalesce({TXT.format('second_row')}, '') AS second_cells, title_row AS looks_like_title_row, head_row IS NOT NULL AS has_header FROM inf""")(
    lambda s: T.describe_tables(s("fx_cells"), s("fx_modes")))
query("repair_table_headers", f"""WITH {INFO}, j AS (SELECT c.*, head_row, first_row, title_row, CASE WHEN m.mode IN ('auto', 'first_row', 'title_row', 'none') THEN m.mode ELSE 'auto' END AS md FROM fx_cells c JOIN inf USING (doc_id, table_idx)
  LEFT JOIN fx_modes m ON m.doc_id = c.doc_id AND m.table_idx = c.table_idx AND m.kind = 'table_headers'),
k AS (SELECT *, CASE WHEN md = 'none' THEN 'body' WHEN md IN ('auto', 'title_row') AND title_row AND row_idx = head_row THEN 'caption' WHEN md = 'title_row' AND title_row AND row_idx = first_row THEN 'header'
  WHEN md = 'first_row' AND head_row IS NULL AND row_idx = first_row THEN 'header' WHEN in_thead THEN 'kept_header' ELSE 'kept_body' END AS role FROM j)
SELECT doc_id, table_idx, row_idx, cell_idx, role, CASE WHEN role = 'header' THEN 'th' WHEN role = 'body' AND in_thead THEN 'td' ELSE tag END AS tag, role IN ('header', 'kept_header') AS in_thead,
  CASE WHEN role = 'header' THEN 'col' WHEN role = 'body' AND in_thead THEN NULL ELSE scope END AS scope, text FROM k""")(
    lambda s: T.repair_table_headers(s("fx_cells"), s("fx_modes")))
query("header_scope", """WITH w AS (SELECT *, min(CASE WHEN tag = 'th' THEN cell_idx END) OVER x f, bool_or(tag = 'td') OVER x td FROM fx_cells WINDOW x AS (PARTITION BY doc_id, table_idx, row_idx))
SELECT doc_id, table_idx, row_idx, cell_idx, CASE WHEN coalesce(scope, '') <> '' THEN scope WHEN in_thead THEN 'col' WHEN cell_idx = f AND td THEN 'row' ELSE 'col' END AS scope FROM w WHERE tag = 'th'""")(
    lambda s: T.header_scope(s("fx_cells")))
query("align_cells", f"""WITH n AS (SELECT doc_id, table_idx, col_idx, numeric > 0 AND numeric * 2 >= seen AS isn FROM ({NUMCOL}) z), j AS (SELECT g.*, coalesce(isn, false) num, coalesce(m.mode, 'auto') md FROM ({GRID}) g LEFT JOIN n USING (doc_id, table_idx, col_idx)
  LEFT JOIN fx_modes m ON m.doc_id = g.doc_id AND m.table_idx = g.table_idx AND m.kind = 'table_aligns')
SELECT doc_id, table_idx, row_idx, cell_idx, col_idx, CASE WHEN in_thead AND tag = 'th' THEN 'center' WHEN col_idx = 1 THEN 'right' WHEN md = 'left_all' THEN 'left' WHEN md = 'center_all' THEN 'center' WHEN md = 'right_all' THEN 'right'
  WHEN md = 'right_numeric' THEN CASE WHEN num THEN 'right' ELSE 'left' END WHEN md = 'auto_skip_first' AND col_idx = 0 THEN 'left' WHEN num THEN 'center' ELSE 'left' END AS align FROM j""")(
    lambda s: T.align_cells(grid(s), col2="Right", header="center", overrides=s("fx_modes")))
TB = "SELECT doc_id, k table_idx, {} classes FROM fx_lines GROUP BY doc_id, k"
query("place_tables", f"""WITH t AS (SELECT doc_id, k table_idx, CASE WHEN k % 2 = 0 THEN ['grid', 'manual-table-left'] ELSE ['manual-table-full'] END classes FROM fx_lines GROUP BY doc_id, k)
SELECT t.doc_id, t.table_idx, array_to_string(list_concat(list_filter(classes, lambda c: c NOT LIKE 'manual-table-%'), CASE WHEN mode <> 'auto' THEN ['manual-table-' || mode] ELSE [] END), ' ') AS classes
FROM t LEFT JOIN fx_modes m ON m.doc_id = t.doc_id AND m.table_idx = t.table_idx AND m.kind = 'table_blocks'""")(
    lambda s: T.place_tables(s.sql("SELECT doc_id, k table_idx, CASE WHEN k % 2 = 0 THEN array('grid', 'manual-table-left') ELSE array('manual-table-full') END classes FROM fx_lines GROUP BY doc_id, k"), s("fx_modes"))
    .withColumn("classes", F.array_join("classes", " ")))
OV = "SELECT doc_id, CASE k % 3 WHEN 0 THEN 'table_headers' WHEN 1 THEN 'table_aligns' ELSE 'table_blocks' END kind, CASE WHEN pk % 6 = 0 THEN concat('x', CAST(k AS STRING)) ELSE concat(' ', CAST(k AS STRING)) END table_idx, CASE sk % 6 WHEN 0 THEN 'AUTO' WHEN 1 THEN ' First_Row' WHEN 2 THEN 'left_all' WHEN 3 THEN 'full ' WHEN 4 THEN 'none' ELSE 'odd' END mode FROM fx_lines"
query("validate_table_overrides", f"""SELECT doc_id, kind, trim(table_idx) AS table_idx, lower(trim(mode)) AS mode FROM ({OV}) z WHERE regexp_matches(trim(table_idx), '^\\d+$') AND lower(trim(mode)) <> 'auto'
AND CASE kind WHEN 'table_headers' THEN lower(trim(mode)) IN ('first_row', 'title_row', 'none') WHEN 'table_aligns' THEN lower(trim(mode)) IN ('left_all', 'center_all', 'right_all', 'right_numeric', 'auto_skip_first') ELSE lower(trim(mode)) IN ('full', 'center', 'left', 'right') END""")(
    lambda s: T.validate_table_overrides(s.sql(OV)))
TH = """SELECT o_orderkey doc_id, CASE o_orderkey % 4 WHEN 0 THEN '#abc' WHEN 1 THEN 'A1B2C3' WHEN 2 THEN 'red' END primary_color, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 100 AS STRING) END base_font_size,
  CASE WHEN o_orderkey % 5 > 0 THEN concat('1.', CAST(o_custkey % 50 AS STRING), CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE '' END) END line_height, CASE o_orderkey % 4 WHEN 0 THEN ' Left' WHEN 1 THEN 'auto' WHEN 2 THEN 'middle' END table_coln_align,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' END table_header_bold, CASE o_orderkey % 3 WHEN 0 THEN 'Dashed' WHEN 1 THEN 'wavy' END table_border_style, CASE WHEN o_orderkey % 3 = 1 THEN 'Arial;}x{, serif,' END font_family, CASE WHEN o_orderkey % 2 = 1 THEN 'My Theme!' END theme_id FROM orders"""
query("coerce_theme_settings", rf"""SELECT doc_id, CASE WHEN primary_color = 'red' OR primary_color IS NULL THEN '#8d0a0a' WHEN primary_color = '#abc' THEN '#AABBCC' ELSE '#A1B2C3' END AS primary_color,
  CASE WHEN try_cast(base_font_size AS DOUBLE) IS NULL THEN 16.0 ELSE floor(least(72, greatest(8, try_cast(base_font_size AS DOUBLE)))) END AS base_font_size, CASE WHEN try_cast(line_height AS DOUBLE) IS NULL THEN 1.6::DOUBLE ELSE least(3.0::DOUBLE, greatest(1.0::DOUBLE, try_cast(line_height AS DOUBLE))) END AS line_height,
  CASE WHEN lower(trim(table_coln_align)) = 'left' THEN 'left' END AS table_coln_align, CASE WHEN lower(trim(table_coln_align)) = 'left' THEN 'left' END AS table_col2_align, coalesce(lower(table_header_bold) = 'yes', false) AS table_header_bold,
  CASE WHEN lower(table_border_style) = 'dashed' THEN 'dashed' ELSE 'solid' END AS table_border_style, CASE WHEN font_family IS NULL THEN 'system-ui, -apple-system, sans-serif' ELSE 'Arialx, serif' END AS font_family,
  CASE WHEN theme_id IS NULL THEN 'manual' ELSE 'mytheme' END AS theme_id, CASE WHEN table_coln_align = 'middle' THEN 'Ignored invalid table alignment for table_coln_align.' ELSE '' END AS warnings FROM ({TH}) z""")(
    lambda s: T.coerce_theme_settings(s.sql(TH)).select("doc_id", "primary_color", "base_font_size", "line_height", "table_coln_align", "table_col2_align", "table_header_bold", "table_border_style", "font_family", "theme_id", "warnings"))

# Lists
MT = f"CASE WHEN tag = 'p' THEN CASE WHEN regexp_matches(text, {X.q(K.LIST_ROMAN)}) THEN CASE WHEN lower(regexp_extract(text, {X.q(K.LIST_ROMAN)}, 1)) = regexp_extract(text, {X.q(K.LIST_ROMAN)}, 1) THEN 'i' ELSE 'I' END WHEN regexp_matches(text, {X.q(K.LIST_ALPHA)}) THEN CASE WHEN lower(regexp_extract(text, {X.q(K.LIST_ALPHA)}, 1)) = regexp_extract(text, {X.q(K.LIST_ALPHA)}, 1) THEN 'a' ELSE 'A' END WHEN regexp_matches(text, {X.q(K.LIST_DECIMAL)}) THEN '' END END"
RUNS = f"""r0 AS (SELECT *, {MT} AS ty FROM fx_children), r1 AS (SELECT *, lag(ty) OVER (PARTITION BY doc_id ORDER BY child_idx) pt FROM r0),
r2 AS (SELECT *, CAST(sum(CASE WHEN ty IS NOT NULL AND ty IS DISTINCT FROM pt THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY child_idx) AS BIGINT) AS run_id FROM r1)"""
query("list_runs", f"WITH {RUNS} SELECT doc_id, child_idx, run_id, ty AS type FROM r2 WHERE ty IS NOT NULL")(lambda s: Li.list_runs(s("fx_children")).select("doc_id", "child_idx", "run_id", "type"))
VAL = f"CASE WHEN ty IN ('i', 'I') THEN {X.roman('regexp_extract(text, ' + X.q(K.LIST_ROMAN) + ', 1)')} WHEN ty IN ('a', 'A') THEN ascii(lower(regexp_extract(text, {X.q(K.LIST_ALPHA)}, 1))) - 96 ELSE CAST(regexp_extract(text, {X.q(K.LIST_DECIMAL)}, 1) AS INT) END"
query("list_run_summary", f"""WITH {RUNS}, v AS (SELECT *, {VAL} AS val FROM r2 WHERE ty IS NOT NULL) SELECT doc_id, run_id, ty AS type, count(*) AS items, min(child_idx) AS first_child, CASE WHEN arg_min(val, child_idx) > 1 THEN arg_min(val, child_idx) END AS start,
  CASE ty WHEN 'a' THEN 'list-alpha-lower' WHEN 'A' THEN 'list-alpha-upper' WHEN 'i' THEN 'list-roman-lower' WHEN 'I' THEN 'list-roman-upper' ELSE 'list-decimal' END AS class FROM v GROUP BY doc_id, run_id, ty""")(
    lambda s: Li.list_run_summary(Li.list_runs(s("fx_children"))))
ORDERS = ["dar", "dra", "adr", "ard", "rda", "rad"]
_case = " ".join(f"WHEN NOT ({' OR '.join(f'list_contains(es, {X.q(o[j] + o[i])})' for i in range(3) for j in range(i + 1, 3))}) THEN '{o}'" for o in ORDERS)
query("list_kind_order", f"""WITH k AS (SELECT *, CASE WHEN type IN ('a', 'A') THEN 'a' WHEN type IN ('i', 'I') THEN 'r' ELSE 'd' END kd FROM fx_lists), e AS (SELECT DISTINCT c.doc_id, p.kd || c.kd AS e FROM k c JOIN k p ON p.doc_id = c.doc_id AND p.list_idx = c.parent_list_idx AND p.kd <> c.kd),
g AS (SELECT doc_id, list(e) es FROM e GROUP BY doc_id), o AS (SELECT d.doc_id, CASE WHEN es IS NULL THEN 'dar' {_case} ELSE 'dar' END AS o FROM (SELECT DISTINCT doc_id FROM fx_lists) d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(strpos(o, 'd') - 1 AS INT) AS decimal, CAST(strpos(o, 'a') - 1 AS INT) AS alpha, CAST(strpos(o, 'r') - 1 AS INT) AS roman FROM o""")(lambda s: Li.list_kind_order(s("fx_lists")))
query("list_styles")(lambda s: Li.list_styles(s.sql(
    "SELECT doc_id, list_idx, CASE WHEN list_idx % 4 > 0 THEN CAST(list_idx - 1 AS INT) END parent_list_idx, CAST(list_idx % 4 AS INT) depth, CASE WHEN list_idx % 5 = 0 THEN type ELSE '' END type, "
    "CASE WHEN list_idx % 9 = 0 THEN array('list-roman-upper') ELSE CAST(array() AS array<string>) END classes, '' style FROM fx_lists")))

# Archives
ESC = r"(starts_with(replace(member, '\', '/'), '/') OR list_contains(string_split(replace(member, '\', '/'), '/'), '..'))"
query("archive_audit", f"""SELECT path, files, bytes, escaping, CASE WHEN escaping > 0 THEN 'escapes' WHEN files > 215 THEN 'files' WHEN bytes > 40000000000 THEN 'bytes' END AS refused FROM (
  SELECT path, count(*) FILTER (NOT is_dir) AS files, CAST(coalesce(sum(size) FILTER (NOT is_dir), 0) AS BIGINT) AS bytes, count(*) FILTER ({ESC}) AS escaping FROM fx_members GROUP BY path) z""")(
    lambda s: A.archive_audit(s("fx_members"), max_bytes=40_000_000_000, max_files=215))
query("manifest_audit", r"""WITH k AS (SELECT DISTINCT path, regexp_extract(regexp_replace(replace(member, '\', '/'), '/+$', ''), '([^/]*)$', 1) AS name FROM fx_members WHERE NOT is_dir)
SELECT DISTINCT path, name, role FROM fx_manifests m WHERE name IN ('', '.', '..') OR contains(name, '/') OR NOT EXISTS (SELECT 1 FROM k WHERE k.path = m.path AND k.name = m.name)""")(
    lambda s: A.manifest_audit(s("fx_manifests"), s("fx_members")))
query("unexpected_members", r"""WITH m AS (SELECT path, member, regexp_replace(replace(member, '\', '/'), '^/+|/+$', '', 'g') n FROM fx_members WHERE NOT is_dir)
SELECT path, member FROM m WHERE n NOT IN ('manifest.json', 'stable_heading_map.json') AND NOT EXISTS (SELECT 1 FROM fx_manifests f WHERE f.path = m.path AND f.name = m.n AND NOT contains(f.name, '/'))""")(
    lambda s: A.unexpected_members(s("fx_members"), s("fx_manifests")))

# Fingerprint
LINKS = "SELECT doc_id, href, para_idx % 4 = 0 bad FROM (SELECT doc_id, para_idx, concat('#h-', CAST(para_idx AS STRING)) href FROM fx_refs) q"
query("document_fingerprint", f"""WITH keyed AS ({HK}), {MATCH}
SELECT doc_id, CAST(sum(p) AS BIGINT) AS paragraphs, CAST(sum(ne) AS BIGINT) AS nonempty, CAST(sum(t) AS BIGINT) AS tables, CAST(sum(h) AS BIGINT) AS headings, CAST(sum(r) AS BIGINT) AS refs, CAST(sum(u) AS BIGINT) AS unmatched, CAST(sum(l) AS BIGINT) AS links, CAST(sum(b) AS BIGINT) AS bad_links, 0::BIGINT AS dead FROM (
  SELECT doc_id, 1 p, CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END ne, 0 t, 0 h, 0 r, 0 u, 0 l, 0 b FROM fx_paras UNION ALL SELECT DISTINCT doc_id, 0, 0, 1, 0, 0, 0, 0, table_idx * 0 FROM (SELECT DISTINCT doc_id, table_idx FROM fx_cells) c WHERE false
  UNION ALL SELECT doc_id, 0, 0, count(DISTINCT table_idx), 0, 0, 0, 0, 0 FROM fx_cells GROUP BY doc_id UNION ALL SELECT doc_id, 0, 0, 0, 1, 0, 0, 0, 0 FROM fx_headings
  UNION ALL SELECT c.doc_id, 0, 0, 0, 0, 1, CASE WHEN EXISTS (SELECT 1 FROM cw WHERE cw.doc_id = c.doc_id AND cw.old_ref = c.label) THEN 0 ELSE 1 END, 0, 0 FROM fx_cites c
  UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0, 1, CASE WHEN para_idx % 4 = 0 THEN 1 ELSE 0 END FROM fx_refs) z GROUP BY doc_id""")(
    lambda s: A.document_fingerprint(s("fx_paras"), s("fx_headings"), s("fx_cites"), s.sql(LINKS),
                                     R.match_references(s("fx_cites"), H.heading_keys(s("fx_numbered"))), s("fx_cells")))
FP = "SELECT doc_id, count(*) AS headings, count(DISTINCT text) AS texts FROM {} GROUP BY doc_id"
query("fingerprint_drift", f"""WITH a AS ({FP.format('fx_anchored_old')}), b AS ({FP.format('fx_anchored')}) SELECT doc_id, 'headings' AS measure, a.headings AS before, b.headings AS after FROM a JOIN b USING (doc_id) WHERE a.headings <> b.headings
UNION ALL SELECT doc_id, 'texts', a.texts, b.texts FROM a JOIN b USING (doc_id) WHERE a.texts <> b.texts""")(
    lambda s: A.fingerprint_drift(s.sql(FP.format("fx_anchored_old")), s.sql(FP.format("fx_anchored"))))
