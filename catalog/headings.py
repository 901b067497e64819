"""Heading queries."""

from pyspark.sql import functions as F

from docweave.functions import fixed as K
from docweave.operators import headings as H
from docweave.operators import numbering as N
from docweave.operators import paragraphs as P

from . import sqlx as X
from .registry import query


def counters(rel, order, active, key="doc_id", upto=6):
    """DuckDB counters of a hierarchy: rows of a level since the last shallower row."""
    grp = ", ".join(f"sum(CASE WHEN {active} AND level < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY {order}) g{k}" for k in range(1, upto + 1))
    cnt = ", ".join(f"CAST(sum(CASE WHEN {active} AND level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, g{k} ORDER BY {order}) AS BIGINT) n{k}" for k in range(1, upto + 1))
    return f"SELECT *, {cnt} FROM (SELECT *, {grp} FROM {rel}) _g"


def num(upto=6):
    cases = " ".join(f"WHEN {k} THEN concat_ws('.', {', '.join(f'n{i}' for i in range(1, k + 1))})" for k in range(1, upto + 1))
    return f"CASE level {cases} END"


ACTIVE = f"NOT (regexp_matches({X.strip('text')}, {X.q(K.ALREADY_NUMBERED)}, 'i') OR regexp_matches({X.strip('text')}, {X.q(K.ALREADY_DECIMAL)}))"


def number_sql(rel, word):
    t = X.strip("text")
    return f"""SELECT doc_id, ord, level, text, CASE WHEN {ACTIVE} THEN {num()} END AS number,
  CASE WHEN NOT ({ACTIVE}) THEN {t} WHEN level = 1 THEN '{word} ' || {num()} || ' - ' || {t} ELSE {num()} || ' ' || {t} END AS numbered_text
FROM ({counters(rel, 'ord', ACTIVE)}) c"""


query("number_headings", number_sql("fx_headings", "Chapter"))(lambda s: H.number_headings(s("fx_headings")))
query("number_mixed_headings", number_sql("(SELECT doc_id, ord, level, text FROM fx_numbered)", "Section"))(
    lambda s: H.number_headings(s("fx_numbered").drop("existing_id"), "section"))

NTH = "row_number() OVER (PARTITION BY doc_id, signature ORDER BY ord)"
SMAP = f"SELECT doc_id, signature, {NTH} AS nth, id, ord FROM (SELECT doc_id, ord, {X.sig('text')} AS signature, id FROM {{}}) z WHERE signature <> ''"
query("build_stable_map", SMAP.format("fx_anchored"))(lambda s: H.stable_map(s("fx_anchored")))
query("apply_stable_map", f"""WITH m AS ({SMAP.format('fx_anchored_old')}), h AS (SELECT *, {NTH} AS nth FROM (SELECT doc_id, ord, {X.sig('text')} AS signature FROM fx_headings) z)
SELECT h.doc_id, h.ord, h.signature, h.nth, m.id AS mapped_id FROM h LEFT JOIN m USING (doc_id, signature, nth)""")(
    lambda s: H.apply_stable_map(s("fx_headings"), H.stable_map(s("fx_anchored_old"))).select("doc_id", "ord", "signature", "nth", "mapped_id"))
query("permalink_stability", f"""WITH a AS ({SMAP.format('fx_anchored_old')}), b AS ({SMAP.format('fx_anchored')})
SELECT doc_id, signature, nth, a.id AS old_id, b.id AS new_id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'lost' WHEN a.id = b.id THEN 'kept' ELSE 'changed' END AS state
FROM a FULL JOIN b USING (doc_id, signature, nth)""")(
    lambda s: H.permalink_stability(H.stable_map(s("fx_anchored_old")), H.stable_map(s("fx_anchored"))))

# Greedy ids: in document order a heading takes its slug, or the slug with the first free number. Headings meet only inside a
# family, slugs that are equal but for numbers at the end, so the recursion runs over families.
GREEDY = f"""h AS (SELECT *, regexp_replace(base, '(-[0-9]+)+$', '') AS fam, row_number() OVER (PARTITION BY doc_id, regexp_replace(base, '(-[0-9]+)+$', '') ORDER BY ord) AS n
  FROM (SELECT doc_id, ord, text, coalesce(nullif({X.slug(X.strip('text'))}, ''), 'heading') AS base FROM fx_headings) z),
g AS (SELECT doc_id, fam, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS INTEGER) AS ord, CAST(NULL AS VARCHAR) AS base, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS id
  FROM (SELECT DISTINCT doc_id, fam FROM h) f
  UNION ALL SELECT doc_id, fam, n, list_append(used, id), ord, base, text, id FROM (
    SELECT g.doc_id, g.fam, h.n, used, h.ord, h.base, h.text, CASE WHEN NOT list_contains(used, h.base) THEN h.base
      ELSE h.base || '-' || list_filter(range(1, len(used) + 2), lambda k: NOT list_contains(used, h.base || '-' || k))[1] END AS id
    FROM g JOIN h ON g.doc_id = h.doc_id AND g.fam = h.fam AND h.n = g.n + 1) y)"""
query("assign_ids", f"WITH RECURSIVE {GREEDY} SELECT doc_id, ord, base, id FROM g WHERE ord IS NOT NULL")(
    lambda s: H.assign_ids(s("fx_headings").withColumn("existing_id", F.lit(""))).select("doc_id", "ord", "base", "id"))
query("assign_ids_plain", f"""SELECT doc_id, ord, base, base || '-' || CAST(ord AS VARCHAR) AS id FROM (
  SELECT doc_id, ord, coalesce(nullif({X.slug(X.strip('text'))}, ''), 'heading') AS base FROM (SELECT doc_id, ord, text || ' ' || CAST(ord AS VARCHAR) AS text FROM fx_headings) t) b""".replace(
    "base || '-' || CAST(ord AS VARCHAR) AS id", "base AS id"))(
    lambda s: H.assign_ids(s("fx_headings").withColumn("text", F.concat_ws(" ", "text", F.col("ord").cast("string")))).select("doc_id", "ord", "base", "id"))
query("assign_ids_with_map")(lambda s: H.assign_ids(
    s("fx_numbered").select("doc_id", "ord", "text", "existing_id"), H.stable_map(s("fx_anchored_old")), keep_existing=True)
    .select("doc_id", "ord", "id_source", "base", "id"))
query("id_remap", """SELECT doc_id, old_id, count(*) AS n FROM (SELECT doc_id, existing_id AS old_id FROM fx_numbered WHERE existing_id <> '') x GROUP BY ALL""")(
    lambda s: H.id_remap(H.assign_ids(s("fx_numbered"))).join(
        s("fx_numbered").where("existing_id <> ''").groupBy("doc_id", F.col("existing_id").alias("old_id")).agg(F.count("*").alias("n")),
        ["doc_id", "old_id"]).select("doc_id", "old_id", "n"))

LAG = "lag(level) OVER (PARTITION BY doc_id ORDER BY ord)"
query("heading_order_issues", f"SELECT * FROM (SELECT doc_id, ord, level, text, {LAG} AS prev_level FROM fx_headings) z WHERE level > prev_level + 1")(
    lambda s: H.heading_order_issues(s("fx_headings")))
query("heading_audit", f"""WITH p AS (SELECT doc_id, ord, level, {LAG} AS prev_level FROM fx_numbered)
SELECT doc_id, ord, level, prev_level, issue FROM (SELECT *, CASE WHEN prev_level IS NULL AND level <> 1 THEN 'First heading is H' || level || ' (expected H1).'
  WHEN level > prev_level + 1 THEN 'Heading level skipped from H' || prev_level || ' to H' || level || '.' END issue FROM p) z WHERE issue IS NOT NULL
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'No H1 headings detected.' FROM fx_numbered GROUP BY doc_id HAVING min(level) > 1""")(
    lambda s: H.heading_audit(s("fx_numbered")))
query("heading_levels", "SELECT doc_id, array_to_string(list_sort(list(DISTINCT level)), ',') AS levels_used, max(level) AS toc_depth FROM fx_numbered GROUP BY doc_id")(
    lambda s: H.heading_levels(s("fx_numbered")))
query("shift_levels", "SELECT doc_id, ord, greatest(1, least(6, level - 1)) AS level FROM fx_headings")(
    lambda s: H.shift_levels(s("fx_headings"), -1).select("doc_id", "ord", "level"))
query("apply_heading_edits", """SELECT doc_id, ord, id, CASE WHEN ord % 5 = 0 AND ord % 9 BETWEEN 1 AND 6 THEN ord % 9 ELSE level END AS level,
  CASE WHEN ord % 5 = 0 AND ord % 3 = 0 THEN 'Edited ' || text ELSE text END AS text FROM fx_anchored""")(
    lambda s: H.apply_heading_edits(s("fx_anchored"), s.sql(
        "SELECT doc_id, id, CAST(ord % 9 AS INT) level, CASE WHEN ord % 3 = 0 THEN concat(' Edited ', text, ' ') ELSE ' ' END text FROM fx_anchored WHERE ord % 5 = 0")))
TOK = X.heading_tokens("text")
query("infer_levels", f"""SELECT doc_id, ord, level, CASE WHEN len(t) > 0 THEN least(6, greatest(level, 1 + CASE WHEN level > 1 AND len(t) > 1
  AND (regexp_matches(t[1], '^\\d+$') OR regexp_matches(t[1], '^[IVXLCDM]+$', 'i')) THEN len(t) - 1 ELSE len(t) END)) ELSE level END AS new_level
FROM (SELECT doc_id, ord, level, {TOK} AS t FROM fx_numbered) z""")(
    lambda s: H.infer_levels(s("fx_numbered")).select("doc_id", "ord", "level", "new_level"))
STYLE = {"decimal": 1, "alpha_upper": 2, "roman_upper": 3, "alpha_lower": 4}
ST = X.style_tokens("text")
query("infer_levels_styled", f"""SELECT doc_id, ord, level, CASE WHEN len(t) = 0 THEN level ELSE coalesce(CASE ty WHEN 'decimal' THEN 1 WHEN 'alpha_upper' THEN 2 WHEN 'roman_upper' THEN 3 WHEN 'alpha_lower' THEN 4 END,
  least(6, greatest(level, 1 + CASE WHEN level > 1 AND len(t) > 1 AND (regexp_matches(t[1], '^\\d+$') OR regexp_matches(t[1], '^[IVXLCDM]+$', 'i')) THEN len(t) - 1 ELSE len(t) END))) END AS new_level
FROM (SELECT *, CASE WHEN regexp_matches(t[-1], '^\\d+$') THEN 'decimal' WHEN NOT regexp_matches(t[-1], '^[a-z]+$', 'i') THEN ''
   WHEN (lab OR len(t) >= 5) AND regexp_matches(t[-1], '^[ivxlcdm]+$', 'i') THEN CASE WHEN lower(t[-1]) = t[-1] THEN 'roman_lower' ELSE 'roman_upper' END
   WHEN length(t[-1]) = 1 THEN CASE WHEN lower(t[-1]) = t[-1] THEN 'alpha_lower' ELSE 'alpha_upper' END
   ELSE CASE WHEN lower(t[-1]) = t[-1] THEN 'roman_lower' ELSE 'roman_upper' END END ty
 FROM (SELECT doc_id, ord, level, {ST} AS t, regexp_matches(text, '^\\s*(?:Chapter|Section)\\b', 'i') AS lab FROM fx_numbered) y) z""")(
    lambda s: H.infer_levels(s("fx_numbered"), STYLE).select("doc_id", "ord", "level", "new_level"))

# Keys: context slots as the last value written to each slot.
FULL, PART = X.q(K.FULL_HEADING), X.q(K.PARTIAL_HEADING)
STOP = ", ".join(X.q(w) for w in K.NOT_A_NUMBER)
KEYS = f"""
base AS (SELECT doc_id, ord, level, {X.strip('text')} AS t FROM fx_numbered WHERE {X.strip('text')} <> ''),
m AS (SELECT *, regexp_extract(t, {FULL}, 1, 'i') fp, regexp_extract(t, {FULL}, 2, 'i') fn, trim(regexp_extract(t, {FULL}, 3, 'i')) ft,
  rtrim(upper(regexp_extract(t, {PART}, 1)), '.') pn, trim(regexp_extract(t, {PART}, 2)) pt FROM base),
m1 AS (SELECT *, fp <> '' AS isf, last_value(nullif(fp, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prev FROM m),
m2 AS (SELECT *, NOT isf AND prev IS NOT NULL AND pn <> '' AND pn NOT IN ({STOP}) AS isp,
  CASE WHEN isf THEN list_filter(string_split(fn, '.'), lambda z: z <> '') ELSE string_split(pn, '.') END p FROM m1),
m3 AS (SELECT *, isp AND len(p) > 1 AND len(p) <= level - 1 AND regexp_matches(pt, {X.q(K.SUB_NUMBER)}, 'i') AS sub FROM m2),
m4 AS (SELECT *, CASE WHEN sub THEN list_append(p, upper(regexp_extract(pt, {X.q(K.SUB_NUMBER)}, 1, 'i'))) ELSE p END v,
  CASE WHEN isf THEN ft WHEN sub THEN trim(regexp_extract(pt, {X.q(K.SUB_NUMBER)}, 2, 'i')) WHEN isp THEN pt ELSE t END title FROM m3),
m5 AS (SELECT *, isp AND len(p) = 1 AS one, CASE WHEN isp AND len(p) = 1 THEN level ELSE least(len(v), 6) END dep FROM m4),
m6 AS (SELECT *, {', '.join(f"CASE WHEN (isf OR isp) AND ((one AND level = {i + 1}) OR (NOT one AND len(v) > {i}) OR dep <= {i}) THEN coalesce(CASE WHEN one THEN CASE WHEN level = {i + 1} THEN v[1] END ELSE v[{i + 1}] END, '?') END w{i}" for i in range(6))} FROM m5),
m7 AS (SELECT *, {', '.join(f"coalesce(last_value(w{i} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), '?') s{i}" for i in range(6))} FROM m6),
hk AS (SELECT doc_id, ord, level, CASE WHEN isf THEN fp || ' ' || fn WHEN isp THEN prev || ' ' || array_to_string(list_slice([s0, s1, s2, s3, s4, s5], 1, dep), '.')
  ELSE 'H' || level || ': ' || substr(t, 1, 50) END AS key, title AS text, t, isp,
  row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS order_idx FROM m7)"""
HK = f"WITH {KEYS} SELECT doc_id, ord, level, key, text, CASE WHEN isp THEN key || ' - ' || text ELSE t END AS \"full\", order_idx FROM hk"
query("heading_keys", HK)(lambda s: H.heading_keys(s("fx_numbered")).drop("id"))
query("heading_index", f"""WITH k AS ({HK}) SELECT doc_id, key, min(ord) AS first_ord, max(ord) AS ord, arg_max(level, ord) AS level, arg_max(text, ord) AS text,
  arg_max("full", ord) AS "full", max(order_idx) AS order_idx FROM k GROUP BY doc_id, key""")(
    lambda s: H.heading_index(H.heading_keys(s("fx_numbered"))).drop("id"))
query("heading_picklist", f"""WITH k AS ({HK}), i AS (SELECT doc_id, key, arg_max(text, ord) AS text, arg_max("full", ord) AS "full", max(order_idx) AS order_idx FROM k GROUP BY doc_id, key)
SELECT doc_id, "full", {X.looks_numbered('"full"')} AS numbered, order_idx FROM i WHERE {X.looks_numbered('"full"')} OR {X.words('text')} <= 15""")(
    lambda s: H.heading_picklist(H.heading_index(H.heading_keys(s("fx_numbered")))).select("doc_id", "full", "numbered", "order_idx"))

query("table_of_contents", """WITH e AS (SELECT doc_id, ord, greatest(1, least(6, level)) AS eff_level, trim(text) AS t FROM fx_headings),
f AS (SELECT *, CAST(sum(CASE WHEN eff_level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) chapter_no,
  last_value(CASE WHEN eff_level = 1 THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) chapter_ord FROM e WHERE eff_level <= 3)
SELECT doc_id, ord, eff_level, chapter_no, chapter_ord, CASE WHEN eff_level = 1 THEN 'Chapter ' || chapter_no || '. ' || t ELSE t END AS display FROM f WHERE chapter_ord IS NOT NULL""")(
    lambda s: H.table_of_contents(s("fx_headings"), depth=3))
ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
query("toc_lines", f"""WITH h AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) ch FROM fx_anchored WHERE level <= 2)
SELECT doc_id, 1 AS part, CAST(ord AS BIGINT) AS ord, CASE WHEN level = 1 THEN CASE WHEN ch > 1 THEN '</ul></li>' ELSE '' END || '<li class="toc-chapter toc-item toc-level-1"><a href="#' || id || '">' || {ESC.format('trim(text)')} || '</a><ul class="toc-subsections toc-collapsed">'
  ELSE '<li class="toc-section toc-item toc-level-' || level || '"><a href="#' || id || '">' || {ESC.format('trim(text)')} || '</a></li>' END AS line FROM h
UNION ALL SELECT doc_id, 0, NULL, '<ul class="toc-list" aria-labelledby="toc-heading">' FROM fx_anchored GROUP BY doc_id
UNION ALL SELECT doc_id, 2, NULL, CASE WHEN bool_or(level = 1) THEN '</ul></li></ul>' ELSE '</ul>' END FROM fx_anchored GROUP BY doc_id""")(
    lambda s: H.toc_lines(s("fx_anchored"), 2))

TYPES = f"(SELECT doc_id, ord, level, {X.types(f'CASE WHEN len({ST}) > 0 THEN {ST} ELSE {TOK} END')} AS ty FROM fx_numbered)"
query("infer_style_and_sequence_maps", f"""WITH t AS (SELECT * FROM {TYPES} z WHERE len(ty) > 0 AND NOT list_contains(ty, ''))
SELECT doc_id, 'style' AS kind, ty[-1] AS key, arg_min(level, ord) AS level FROM t GROUP BY ALL
UNION ALL SELECT doc_id, 'sequence', array_to_string(ty, '>'), arg_min(level, ord) FROM t GROUP BY 1, 2, 3""".replace("GROUP BY ALL", "GROUP BY doc_id, ty[-1]"))(
    lambda s: H.infer_maps(s("fx_numbered")))
MARKED = """SELECT doc_id, para_idx, CASE WHEN para_idx % 4096 = 2 AND para_idx < 9000 THEN 'The Converter  Style Map' WHEN para_idx % 4096 = 6 AND para_idx > 9000 THEN 'End style map.' ELSE text END text,
  CAST(1 + para_idx % 3 AS INT) level FROM fx_paras"""
query("marked_style_map", f"""WITH p AS (SELECT doc_id, para_idx, level, {X.strip('text')} AS text FROM ({MARKED}) q WHERE {X.strip('text')} <> ''),
s AS (SELECT *, regexp_matches(text, 'converter\\s+style\\s+map', 'i') st, regexp_matches(text, 'end\\s+style\\s+map', 'i') en FROM p),
a AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_idx) i FROM s),
b AS (SELECT *, sum(CASE WHEN en AND NOT st AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_idx) o FROM a),
t AS (SELECT *, {X.types(ST)} AS ty FROM b WHERE i > 0 AND o = 0 AND NOT st), u AS (SELECT * FROM t WHERE len(ty) > 0 AND NOT list_contains(ty, ''))
SELECT doc_id, 'style' AS kind, ty[-1] AS key, arg_min(level, para_idx) AS level FROM u GROUP BY doc_id, ty[-1]
UNION ALL SELECT doc_id, 'sequence', array_to_string(ty, '>'), arg_min(level, para_idx) FROM u GROUP BY doc_id, array_to_string(ty, '>')""")(
    lambda s: H.marked_style_map(s.sql(MARKED)))
TPL = "SELECT doc_id, sequence, CAST(1 + doc_id % 3 AS INT) level FROM fx_docs CROSS JOIN (VALUES ('decimal', 1), ('alpha_lower', 2), ('decimal>decimal', 3)) v(sequence, x)"
SRC = "SELECT doc_id, sequence, CAST(x + doc_id % 2 AS INT) level FROM fx_docs CROSS JOIN (VALUES ('decimal', 2), ('alpha_lower', 3), ('roman_lower', 3), ('decimal>decimal', 5), ('roman_upper>decimal', 4)) v(sequence, x)"
query("merge_sequence_maps", f"""WITH t AS ({TPL}), s AS ({SRC})
SELECT * FROM (SELECT doc_id, sequence, CASE WHEN NOT contains(sequence, '>') AND s.level <= 3 AND sequence IN ('alpha_upper', 'decimal', 'roman_upper') THEN s.level
  WHEN t.level IS NOT NULL THEN t.level WHEN NOT (NOT contains(sequence, '>') AND s.level <= 3) THEN s.level END AS level FROM t FULL JOIN s USING (doc_id, sequence)) z WHERE level IS NOT NULL""")(
    lambda s: H.merge_sequence_maps(s.sql(TPL), s.sql(SRC)))

# Paragraph structure
LIKELY = X.likely()
query("promote_headings", f"SELECT doc_id, para_idx, CASE WHEN {X.strip('text')} <> '' AND {LIKELY} BETWEEN 1 AND 4 THEN {LIKELY} END AS promoted_level FROM fx_paras")(
    lambda s: P.promote_headings(s("fx_paras")).select("doc_id", "para_idx", "promoted_level"))
LVL = f"coalesce(nullif({X.style_level('style_name')}, 0), nullif(outline_lvl, 0), nullif(style_outline_lvl, 0), {X.guess('text')})"
TYP = f"""SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(t, '^chapter\\s+', 'i') AND (lv = 1 OR length(t) <= 120) THEN 1 ELSE 0 END) AS BIGINT) AS chapter_hits,
  CAST(sum(CASE WHEN regexp_matches(t, '^section\\s+', 'i') AND (lv = 1 OR length(t) <= 120) THEN 1 ELSE 0 END) AS BIGINT) AS section_hits
  FROM (SELECT doc_id, {X.strip('text')} AS t, {LVL} AS lv FROM fx_paras) p GROUP BY doc_id"""
query("detect_manual_type", f"SELECT *, CASE WHEN section_hits > chapter_hits THEN 'section' ELSE 'chapter' END AS manual_type FROM ({TYP}) z")(
    lambda s: P.detect_manual_type(s("fx_paras")))
WHOLE, NUMBER = X.number_match("t")
CUT = "CASE WHEN regexp_matches({0}, '\\.\\s+[A-Z]') THEN substr({0}, 1, length(regexp_extract({0}, '(?s)^(.*?)\\.\\s+[A-Z]', 1)) + 1) ELSE {0} END"
HMAP = f"""SELECT doc_id, ref_key, min(ord) AS ord, arg_max(title, ord) AS title, bool_or(syn) AS is_synthetic FROM (
  SELECT doc_id, para_idx AS ord, w = '' AS syn, CASE WHEN w <> '' THEN CASE WHEN regexp_matches(w, '^(Chapter|Section)') THEN regexp_extract(w, '^(\\S+)', 1) || ' ' || n ELSE n END
      ELSE '_h' || para_idx || '_' || substr(t, 1, 30) END AS ref_key, CASE WHEN w <> '' THEN tn ELSE ts END AS title
  FROM (SELECT *, {X.strip('substr(' + CUT.format('r') + ', 1, 200)')} AS tn, {CUT.format('trim(substr(t, 1, 200))')} AS ts
    FROM (SELECT *, regexp_replace({X.strip('substr(t, length(w) + 1)')}, '^[\\s\\-:\\.–—]+', '') AS r
      FROM (SELECT doc_id, para_idx, t, {WHOLE} AS w, {X.norm_ref(NUMBER)} AS n, lk FROM (SELECT doc_id, para_idx, {X.strip('text')} AS t, {LIKELY} AS lk FROM fx_paras) a WHERE t <> '') b) c) d
  WHERE (w <> '' AND n <> '' AND tn <> '' AND (lk > 0 OR {X.words('t')} <= 20)) OR (w = '' AND lk > 0 AND ts <> '' AND {X.words('ts')} <= 20)) e GROUP BY doc_id, ref_key"""
query("extract_heading_map", HMAP)(lambda s: P.extract_heading_map(s("fx_paras")))
CC = f"(SELECT doc_id, para_idx, w, n, lk AS level FROM (SELECT doc_id, para_idx, {WHOLE} AS w, {NUMBER} AS n, lk FROM (SELECT doc_id, para_idx, {X.strip('text')} AS t, {LIKELY} AS lk FROM fx_paras) a) b WHERE n <> '' AND lk BETWEEN 1 AND 5)"
query("counter_crosswalk", f"""WITH c AS ({counters(CC, 'para_idx', 'true', upto=5)}), k AS (SELECT *, {num(5)} AS bare FROM c)
SELECT doc_id, old_ref, arg_max(new_ref, para_idx * 2 + sub) AS new_ref, min(para_idx) AS ord FROM (
  SELECT doc_id, para_idx, 0 AS sub, w AS old_ref, CASE WHEN level = 1 THEN 'Chapter ' || bare ELSE bare END AS new_ref FROM k
  UNION ALL SELECT doc_id, para_idx, 1, n, bare FROM k) z GROUP BY doc_id, old_ref""")(
    lambda s: P.counter_crosswalk(s("fx_paras")))
TT = "t"
CH = "(" + " OR ".join(f"regexp_matches(t, {X.q(p)}, 'i')" for p in K.TOC_CHAPTER) + ")"
NE = r"regexp_matches(t, '\d+\s*$')"
LAB = r"regexp_matches(t, '^(?:Chapter|Section)\s+', 'i')"
ENT = rf"(t = '' OR regexp_matches(t, '^(?:\.{{3,}}|\d+)$') OR (regexp_matches(t, '^[A-Z0-9]+\.\s+') AND NOT {LAB}) OR (length(t) < 120 AND {NE} AND NOT {LAB}))"
query("strip_toc_paragraphs", f"""WITH p AS (SELECT doc_id, para_idx, {X.strip('text')} AS t FROM fx_paras),
a AS (SELECT *, regexp_matches(t, {X.q(K.TOC_YEAR)}) OR regexp_matches(t, {X.q(K.TOC_COVER)}, 'i') AS plain, regexp_matches(t, 'Table of Contents', 'i') AS mk FROM p),
b AS (SELECT *, last_value(CASE WHEN mk AND NOT plain THEN para_idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_idx) AS mat FROM a),
c AS (SELECT *, NOT plain AND NOT mk AND mat IS NOT NULL AND CASE WHEN {CH} THEN NOT (length(t) < 120 AND {NE}) WHEN length(t) > 120 AND NOT {NE} THEN true WHEN {ENT} THEN false ELSE para_idx - mat > 10 END AS cl,
   CASE WHEN {CH} THEN length(t) < 120 AND {NE} WHEN length(t) > 120 AND NOT {NE} THEN false ELSE {ENT} END AS dr FROM b),
d AS (SELECT *, max(CASE WHEN cl THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, mat ORDER BY para_idx) AS closed FROM c)
SELECT doc_id, para_idx, plain OR mk OR (mat IS NOT NULL AND closed = 0 AND dr) AS removed FROM d""")(
    lambda s: P.strip_toc_paragraphs(s("fx_paras")).select("doc_id", "para_idx", "removed"))
RICH = f"(tag IN ('h2','h3','h4','h5','h6','table') OR (tag = 'p' AND length({X.strip('text')}) > 20))"
query("strip_front_matter", f"""WITH a AS (SELECT *, last_value(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN regexp_matches(text, 'Table of Contents', 'i') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY child_idx) it FROM fx_children),
b AS (SELECT doc_id, child_idx, tag, text, row_number() OVER (PARTITION BY doc_id ORDER BY child_idx) p FROM a WHERE tag IS NOT NULL AND NOT coalesce(it, false)),
c AS (SELECT *, min(CASE WHEN {RICH} THEN p END) OVER w hit, min(CASE WHEN tag = 'h1' THEN p END) OVER w st FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY child_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
d AS (SELECT doc_id, min(child_idx) s FROM c WHERE tag = 'h1' AND regexp_matches({X.strip('text')}, '^(?:Chapter|Section)\\s+', 'i') AND NOT (contains(text, chr(9)) OR (regexp_matches({X.strip('text')}, '\\s+\\d+\\s*$') AND length({X.strip('text')}) < 100))
  AND hit IS NOT NULL AND (st IS NULL OR hit < st) GROUP BY doc_id)
SELECT a.doc_id, child_idx, tag, text FROM a LEFT JOIN d USING (doc_id) WHERE tag IS NULL OR (NOT coalesce(it, false) AND (s IS NULL OR child_idx >= s))""")(
    lambda s: P.strip_front_matter(s("fx_children")))
SLOT = f"CASE WHEN {X.style_level('style_name')} > 0 THEN 'heading' || {X.style_level('style_name')} WHEN style_name = 'Normal' THEN 'body' END"
query("style_samples", f"""SELECT doc_id, slot, min(para_idx) AS para_idx, arg_min(sample, para_idx) AS sample FROM (SELECT doc_id, para_idx, {SLOT} AS slot, substr({X.strip('text')}, 1, 240) AS sample FROM fx_paras) z
WHERE slot IS NOT NULL AND sample <> '' GROUP BY doc_id, slot""")(lambda s: P.style_samples(s("fx_paras")))
query("most_complex_heading", "SELECT doc_id, arg_max(ord, x) AS ord, arg_max(level, x) AS level, arg_max(text, x) AS text FROM (SELECT *, length(text) * 1e9 + level * 1e7 - ord AS x FROM fx_headings) z GROUP BY doc_id")(
    lambda s: P.most_complex_heading(s("fx_headings").withColumns({"font_name": F.lit(None).cast("string"), "color": F.lit(None).cast("string")})))

# Word numbering
LINKED = "(SELECT doc_id, abs_id, lower(p_style) st, min(ilvl) lk FROM fx_levels WHERE p_style IS NOT NULL GROUP BY ALL)"
NP = f"""SELECT p.doc_id, para_idx, p.text, p.style_id, heading_level, p.num_id, n.abs_id, coalesce(p.ilvl, CASE WHEN heading_level > 0 THEN coalesce(l.lk, heading_level - 1) END) AS ilvl
FROM fx_paras p JOIN fx_nums n USING (doc_id, num_id) LEFT JOIN {LINKED} l ON l.doc_id = p.doc_id AND l.abs_id = n.abs_id AND l.st = lower(p.style_id)
WHERE n.abs_id IN (SELECT abs_id FROM fx_levels)"""
NPF = f"SELECT * FROM ({NP}) z WHERE ilvl IS NOT NULL"
npf = lambda s: N.numbered_paragraphs(s("fx_paras"), s("fx_nums"), s("fx_levels"))
query("numbered_paragraphs", f"SELECT doc_id, para_idx, num_id, abs_id, ilvl FROM ({NPF}) z")(lambda s: npf(s).select("doc_id", "para_idx", "num_id", "abs_id", "ilvl"))


def _fmt(v, f):
    rom = "['','I','II','III','IV','V','VI','VII','VIII','IX'][({v}) % 10 + 1]".format(v=v)
    tens = f"['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(({v}) // 10) % 10 + 1]"
    hund = f"['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(({v}) // 100) % 10 + 1]"
    r = f"({hund} || {tens} || {rom})"
    let = f"((CASE WHEN ({v}) > 26 THEN chr(CAST(64 + (({v}) - 1) // 26 AS INT)) ELSE '' END) || chr(CAST(65 + (({v}) - 1) % 26 AS INT)))"
    return f"CASE {f} WHEN 'lowerLetter' THEN lower({let}) WHEN 'upperLetter' THEN {let} WHEN 'lowerRoman' THEN lower({r}) WHEN 'upperRoman' THEN {r} ELSE CAST({v} AS VARCHAR) END"


_rep = "t0"
for _k in range(4):
    _rep = f"replace({_rep}, '%{_k + 1}', coalesce(CASE WHEN c{_k} > 0 THEN {_fmt(f'c{_k} - 1 + coalesce(st{_k}, 1)', f'coalesce(fm{_k}, $$decimal$$)')} END, ''))".replace("$$", "'")
_lv = ", ".join(f"max(CASE WHEN ilvl = {k} THEN num_fmt END) fm{k}, max(CASE WHEN ilvl = {k} THEN start END) st{k}" for k in range(4))
_g = ", ".join(f"sum(CASE WHEN ilvl < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, num_id ORDER BY para_idx) g{k}" for k in range(4))
_c = ", ".join(f"CAST(sum(CASE WHEN ilvl = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, num_id, g{k} ORDER BY para_idx) AS BIGINT) c{k}" for k in range(4))
query("list_numbers", f"""WITH n AS ({NPF}), g AS (SELECT *, {_g} FROM n), c AS (SELECT *, {_c} FROM g), d AS (SELECT doc_id, abs_id, {_lv} FROM fx_levels GROUP BY ALL),
e AS (SELECT c.*, d.* EXCLUDE (doc_id, abs_id), l.lvl_text t0 FROM c JOIN d USING (doc_id, abs_id) LEFT JOIN fx_levels l ON l.doc_id = c.doc_id AND l.abs_id = c.abs_id AND l.ilvl = c.ilvl),
f AS (SELECT doc_id, para_idx, num_id, ilvl, heading_level, text, coalesce({X.strip(_rep)}, '') AS num_text FROM e)
SELECT doc_id, para_idx, num_id, ilvl, num_text, CASE WHEN num_text <> '' AND heading_level > 0 AND {X.strip('text')} <> '' AND NOT {X.has_number('text')} AND NOT starts_with(lower({X.strip('text')}), lower(num_text))
  THEN num_text || ' ' || text ELSE text END AS text FROM f""")(lambda s: N.list_numbers(npf(s), s("fx_levels")))
TYPEOF = "CASE lower({}) WHEN 'decimal' THEN 'decimal' WHEN 'upperroman' THEN 'roman_upper' WHEN 'lowerroman' THEN 'roman_lower' WHEN 'upperletter' THEN 'alpha_upper' WHEN 'lowerletter' THEN 'alpha_lower' ELSE '' END"
SEQ = f"""(SELECT a.doc_id, a.abs_id, a.ilvl, {TYPEOF.format('a.num_fmt')} own, coalesce(nullif((SELECT string_agg({TYPEOF.format('b.num_fmt')}, '>' ORDER BY strpos(a.lvl_text, '%' || (b.ilvl + 1))) FROM fx_levels b
  WHERE b.doc_id = a.doc_id AND b.abs_id = a.abs_id AND contains(a.lvl_text, '%' || (b.ilvl + 1)) AND {TYPEOF.format('b.num_fmt')} <> ''), ''), {TYPEOF.format('a.num_fmt')}) AS sequence FROM fx_levels a)"""
query("level_sequences", f"SELECT doc_id, abs_id, ilvl, sequence, own AS own_type FROM {SEQ} z")(lambda s: N.level_sequences(s("fx_levels")))
query("sequence_map_from_numbering", f"""WITH n AS ({NPF}) SELECT n.doc_id, q.sequence, arg_min(n.heading_level, n.para_idx) AS level FROM n JOIN {SEQ} q ON q.doc_id = n.doc_id AND q.abs_id = n.abs_id AND q.ilvl = n.ilvl
WHERE n.heading_level > 0 AND q.sequence <> '' GROUP BY 1, 2""")(lambda s: N.sequence_map_from_numbering(npf(s), s("fx_levels")))
SM = "SELECT doc_id, sequence, x level FROM fx_docs CROSS JOIN (VALUES ('decimal>alpha_upper', 2), ('roman_lower', 7), ('roman_upper', 3)) v(sequence, x)"
TM = "SELECT doc_id, key, x level FROM fx_docs CROSS JOIN (VALUES ('alpha_upper', 4), ('decimal', 1), ('alpha_lower', 6)) v(key, x)"
query("levels_from_numbering", f"""WITH n AS ({NPF}), s AS ({SM}), t AS ({TM}), j AS (SELECT n.doc_id, para_idx, heading_level, coalesce(q.sequence, '') sequence, coalesce(nullif(string_split(coalesce(q.sequence, ''), '>')[-1], ''), q.own, '') tok
  FROM n LEFT JOIN {SEQ} q ON q.doc_id = n.doc_id AND q.abs_id = n.abs_id AND q.ilvl = n.ilvl WHERE heading_level > 0)
SELECT j.doc_id, para_idx, heading_level, CASE WHEN coalesce(s.level, t.level) BETWEEN 1 AND 6 THEN coalesce(s.level, t.level) ELSE heading_level END AS new_level
FROM j LEFT JOIN s ON s.doc_id = j.doc_id AND s.sequence = j.sequence LEFT JOIN t ON t.doc_id = j.doc_id AND t.key = j.tok""")(
    lambda s: N.levels_from_numbering(npf(s), s("fx_levels"), s.sql(SM), s.sql(TM)))
query("list_formats", f"""WITH n AS ({NPF}), j AS (SELECT n.doc_id, n.para_idx, n.ilvl, l.num_fmt, l.lvl_text, l.start FROM n JOIN fx_levels l ON l.doc_id = n.doc_id AND l.abs_id = n.abs_id AND l.ilvl = n.ilvl),
f AS (SELECT doc_id, num_fmt = 'bullet' b, ilvl, arg_min(num_fmt, para_idx) fm, arg_min(lvl_text, para_idx) tx, arg_min(start, para_idx) st FROM j GROUP BY 1, 2, 3),
lead AS (SELECT d.doc_id, coalesce(arg_min(fm, ilvl), 'decimal') ld FROM (SELECT DISTINCT doc_id FROM n) d LEFT JOIN (SELECT * FROM f WHERE NOT b) o USING (doc_id) GROUP BY d.doc_id),
g AS (SELECT doc_id, CASE ld WHEN 'lowerLetter' THEN ['lowerLetter','lowerRoman','decimal'] WHEN 'upperLetter' THEN ['upperLetter','upperRoman','decimal'] WHEN 'lowerRoman' THEN ['lowerRoman','decimal','lowerLetter']
  WHEN 'upperRoman' THEN ['upperRoman','decimal','upperLetter'] ELSE ['decimal','lowerLetter','lowerRoman'] END sq, CAST(unnest(range(6)) AS INT) il FROM lead)
SELECT g.doc_id, 'ordered' AS kind, il AS ilvl, coalesce(fm, sq[il % 3 + 1]) AS format, coalesce(nullif(tx, ''), '%' || (il + 1) || '.') AS lvl_text, coalesce(st, 1) AS start FROM g LEFT JOIN (SELECT * FROM f WHERE NOT b) o ON o.doc_id = g.doc_id AND o.ilvl = il
UNION ALL SELECT g.doc_id, 'unordered', il, CASE WHEN tx IS NULL THEN ['disc','circle','square','dash','disc'][il % 5 + 1] WHEN tx = 'o' THEN 'circle' ELSE 'disc' END, '', 1 FROM g LEFT JOIN (SELECT * FROM f WHERE b) o ON o.doc_id = g.doc_id AND o.ilvl = il""")(
    lambda s: N.list_formats(npf(s), s("fx_levels")))
query("list_examples", f"""WITH n AS ({NPF}) SELECT doc_id, ilvl, nth, substr({X.strip('text')}, 1, 150) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ilvl ORDER BY para_idx) AS nth FROM n) z WHERE nth <= 3""")(
    lambda s: N.list_examples(npf(s)))
query("dangling_styles", "SELECT DISTINCT doc_id, style_id, kind, CASE kind WHEN 'p' THEN 'Normal' ELSE 'DefaultParagraphFont' END AS replacement FROM fx_style_uses u WHERE NOT EXISTS (SELECT 1 FROM fx_styles t WHERE t.doc_id = u.doc_id AND t.style_id = u.style_id)")(
    lambda s: N.dangling_styles(s("fx_style_uses"), s("fx_styles")))
query("style_id_diff", "SELECT doc_id, style_id FROM fx_style_uses EXCEPT SELECT doc_id, style_id FROM fx_styles")(
    lambda s: N.style_id_diff(s("fx_style_uses"), s("fx_styles")))
query("orphan_numbering", "SELECT doc_id, num_id, abs_id FROM fx_nums n WHERE NOT EXISTS (SELECT 1 FROM fx_levels l WHERE l.doc_id = n.doc_id AND l.abs_id = n.abs_id)")(
    lambda s: N.orphan_numbering(s("fx_nums"), s("fx_levels")).select("doc_id", "num_id", "abs_id"))
query("resolve_styles", """WITH RECURSIVE base AS (SELECT * FROM fx_styles), ch AS (
  SELECT doc_id, style_id, based_on nxt, [style_id] seen, font_name, font_size, color FROM base
  UNION ALL SELECT ch.doc_id, ch.style_id, b.based_on, list_append(seen, b.style_id), coalesce(ch.font_name, b.font_name), coalesce(ch.font_size, b.font_size), coalesce(ch.color, b.color)
  FROM ch JOIN base b ON b.doc_id = ch.doc_id AND b.style_id = ch.nxt WHERE NOT list_contains(seen, ch.nxt))
SELECT doc_id, style_id, array_to_string(arg_max(seen, len(seen)), '>') AS chain, arg_max_null(font_name, len(seen)) AS font_name, arg_max_null(font_size, len(seen)) AS font_size, arg_max_null(color, len(seen)) AS color FROM ch GROUP BY doc_id, style_id""")(
    lambda s: N.resolve_styles(s("fx_styles"), ["font_name", "font_size", "color"]).withColumn("chain", F.array_join("chain", ">")))

query("permalink_flow", f"""WITH RECURSIVE {GREEDY}, c AS (SELECT doc_id, ord, id, {X.sig('text')} AS signature FROM g WHERE ord IS NOT NULL)
SELECT doc_id, signature, row_number() OVER (PARTITION BY doc_id, signature ORDER BY ord) AS nth, id FROM c WHERE signature <> ''""")(
    lambda s: H.stable_map(H.assign_ids(H.number_headings(s("fx_headings")))).drop("ord"))
