"""Seeded views over the given tables, in SQL that Spark and DuckDB both accept.

A document is a block of 50 consecutive orders. Positions are arithmetic (order within the
block, line within the order); only the line-within-order number needs an order, which both
engines do with row_number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators.binding import bind

NOUN = ("CASE pk % 11 WHEN 0 THEN 'Faculty' WHEN 1 THEN 'Students' WHEN 2 THEN 'Leave' WHEN 3 THEN 'Travel' "
        "WHEN 4 THEN 'Grants' WHEN 5 THEN 'Safety' WHEN 6 THEN 'Records' WHEN 7 THEN 'Committees' WHEN 8 THEN 'Appeals' "
        "WHEN 9 THEN 'Hiring' ELSE 'Duties' END")
ROMAN = "CASE sk % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'IV' WHEN 3 THEN '7' ELSE '12' END"
LETTER = "chr(CAST(65 + pk % 4 AS INT))"
A = "CAST(sk % 9 + 1 AS STRING)"
C = "CAST(1 + ln % 3 AS STRING)"
WORDS = {"noun_": NOUN, "roman_": ROMAN, "letter_": LETTER}
# Texts that the operators read many times over.
BOUND = {"fx_headings": "text", "fx_numbered": "text", "fx_paras": "text", "fx_refs": "label"}

LINES = """
SELECT CAST(floor(l_orderkey / 50) AS BIGINT) doc_id, CAST((l_orderkey % 50) * 4096 + n AS INT) pos, l_orderkey k,
       l_linenumber ln, l_partkey pk, l_suppkey sk, l_quantity qty, l_extendedprice price, l_returnflag f, l_linestatus s
FROM (SELECT *, {n} FROM lineitem) t"""
DUCK_N = ("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, "
          "l_extendedprice, l_returnflag, l_linestatus) n")

SQL = {
    "fx_headings": f"""
SELECT CAST(floor(o_orderkey / 50) AS BIGINT) doc_id, CAST((o_orderkey % 50) * 4096 AS INT) ord, 1 level,
       concat('Order Class ', substr(o_orderpriority, 3)) text FROM orders
UNION ALL
SELECT doc_id, pos, 2 + ((ln * 7 + CAST(pk % 5 AS INT)) % 3),
       CASE pk % 8 WHEN 0 THEN concat('Item ', CAST(sk % 7 AS STRING)) WHEN 1 THEN 'Item'
            WHEN 2 THEN concat('Policy on ', {NOUN}) WHEN 3 THEN 'Scope & Purpose' ELSE concat('Item ', {NOUN}) END
FROM fx_lines""",
    "fx_anchored": "SELECT doc_id, ord, level, text, concat('h-', CAST(ord AS STRING)) id FROM fx_headings",
    "fx_anchored_old": "SELECT doc_id, ord, level, text, concat('h-', CAST(ord - ord % 2 AS STRING)) id FROM fx_headings WHERE ord % 7 <> 3",
    "fx_numbered": f"""
SELECT doc_id, pos ord, CAST(1 + (ln + CAST(pk % 3 AS INT)) % 4 AS INT) level,
       CASE pk % 16 WHEN 0 THEN concat('Chapter ', {A}, ' - ', {NOUN}) WHEN 1 THEN concat('Section ', {ROMAN}, '.', {LETTER}, ': ', {NOUN}, ' Rules')
            WHEN 2 THEN concat({A}, '.', {C}, ' ', {NOUN}) WHEN 3 THEN concat({LETTER}, '. ', {NOUN}, ' Duties')
            WHEN 4 THEN concat({ROMAN}, '.', {LETTER}, ' ', {NOUN}) WHEN 5 THEN concat('Chapter One - ', {NOUN})
            WHEN 6 THEN concat(upper({NOUN}), ' GENERAL') WHEN 7 THEN concat('I.A.2.b ', {NOUN}) WHEN 8 THEN {NOUN}
            WHEN 9 THEN concat({A}, '.2.', {C}, ' ', lower({NOUN})) WHEN 10 THEN 'Table of Contents'
            WHEN 11 THEN concat('Section ', {A}, ' : ', {NOUN}) WHEN 12 THEN concat('IN ', {NOUN})
            WHEN 13 THEN concat('Chapter ', {ROMAN}, '.', {LETTER}, '.', {C}, ' - ', {NOUN}, '. See More')
            WHEN 14 THEN concat('  ', {A}, ') ', {NOUN}, '  and   more ') ELSE concat({LETTER}, '.', {C}, ' ', {C}, '. ', {NOUN}) END text,
       CASE WHEN sk % 4 = 0 THEN concat('old-', CAST(pk % 20 AS STRING)) ELSE '' END existing_id
FROM fx_lines""",
    "fx_paras": f"""
SELECT doc_id, ord para_idx, CASE WHEN ord % 11 = 0 THEN '2024-2025' WHEN ord % 13 = 0 THEN 'Faculty Manual'
         WHEN ord % 5 = 0 THEN concat(text, ' .... ', CAST(ord % 90 AS STRING)) WHEN ord % 17 = 0 THEN '' ELSE text END text,
       CASE ord % 6 WHEN 0 THEN 'Heading1' WHEN 1 THEN 'Heading2' WHEN 2 THEN 'ListItem' ELSE 'Normal' END style_id,
       CASE ord % 6 WHEN 0 THEN 'Heading 1' WHEN 1 THEN 'heading 2' WHEN 2 THEN 'List Item' ELSE 'Normal' END style_name,
       CASE WHEN ord % 10 = 3 THEN 2 ELSE 0 END outline_lvl, 0 style_outline_lvl,
       CASE ord % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN ord % 10 = 3 THEN 2 ELSE 0 END END heading_level,
       CASE WHEN ord % 3 = 2 THEN NULL ELSE CAST(1 + level % 3 AS INT) END num_id,
       CASE WHEN ord % 4 = 1 THEN NULL ELSE level - 1 END ilvl
FROM fx_numbered""",
    "fx_docs": "SELECT DISTINCT doc_id FROM fx_lines",
    "fx_nums": """
SELECT doc_id, n num_id, concat('a', CAST((n + doc_id) % 4 AS STRING)) abs_id FROM fx_docs CROSS JOIN (VALUES (1), (2), (3)) v(n)""",
    "fx_levels": """
SELECT doc_id, abs_id, ilvl, num_fmt, lvl_text, start, p_style FROM fx_docs CROSS JOIN (VALUES
  ('a0', 0, 'decimal', '%1.', 1, 'Heading1'), ('a0', 1, 'upperLetter', '%1.%2', 1, 'Heading2'), ('a0', 2, 'lowerRoman', '(%3)', 3, NULL),
  ('a1', 0, 'upperRoman', '%1', 2, NULL), ('a1', 1, 'lowerLetter', '%1.%2.', 1, 'ListItem'), ('a1', 2, 'bullet', 'o', 1, NULL),
  ('a2', 0, 'upperLetter', '%1)', 1, NULL), ('a2', 3, 'decimal', '%1.%4', 5, NULL)) v(abs_id, ilvl, num_fmt, lvl_text, start, p_style)""",
    "fx_refs": f"""
SELECT doc_id, para_idx, concat('As required by ', label, ', see also ', label, ' and RCW 42.52.040.') text, label
FROM (SELECT doc_id, pos para_idx, concat(CASE WHEN pk % 2 = 0 THEN 'Section' ELSE 'Chapter' END, ' ', {ROMAN}, '.', {LETTER}, '.', {C}) label
      FROM fx_lines) q""",
    "fx_cites": """
SELECT doc_id, para_idx, text para_text, CASE WHEN i = 2 THEN '42.52.040' ELSE label END label,
       CAST(CASE i WHEN 0 THEN 15 WHEN 1 THEN 26 + length(label) ELSE 35 + 2 * length(label) END AS INT) start,
       CAST(CASE i WHEN 0 THEN 15 + length(label) WHEN 1 THEN 26 + 2 * length(label) ELSE 44 + 2 * length(label) END AS INT) "end"
FROM fx_refs CROSS JOIN (VALUES (0, 0), (1, 0), (2, 0)) v(i, z)""",
    "fx_edits": """
SELECT doc_id, concat('ref_', CAST(para_idx + doc_id % 4 AS STRING), '_15_', substr(md5(label), 1, 8)) ref_id,
       'reference_external_urls' kind, concat('https://x.example/', CAST(para_idx AS STRING)) value
FROM fx_refs WHERE NOT (doc_id % 3 = 0 AND para_idx % 9 = 0)""",
    "fx_decided": """
SELECT doc_id, concat('ref_', CAST(para_idx AS STRING), '_15_', substr(md5(label), 1, 8)) ref_id, kind,
       CASE kind WHEN 'reference_edits' THEN CASE WHEN para_idx % 5 = 0 THEN ' ' ELSE concat('New ', label) END
                 WHEN 'reference_link_targets' THEN concat(label, ' - Target')
                 WHEN 'reference_external_urls' THEN CASE WHEN para_idx % 2 = 0 THEN concat('#h-', CAST(para_idx AS STRING)) ELSE 'https://x.example/a' END
                 ELSE CASE WHEN para_idx % 2 = 0 THEN 'true' ELSE 'false' END END value
FROM fx_refs CROSS JOIN (VALUES ('reference_edits', 0), ('reference_validations', 1), ('reference_reviewed', 2),
  ('reference_link_targets', 3), ('reference_ignored', 4), ('reference_external_urls', 5)) v(kind, i)
WHERE (para_idx + i) % 6 < 2""",
    "fx_cells": """
SELECT doc_id, k table_idx, pos row_idx, c cell_idx, CASE WHEN ln = 1 THEN 'th' WHEN c = 0 AND pk % 5 = 0 THEN 'th' ELSE 'td' END tag,
       ln = 1 in_thead, CASE WHEN ln = 1 AND pk % 3 = 0 THEN 4 WHEN c = 1 AND pk % 7 = 0 THEN 2 ELSE 1 END colspan, 1 rowspan,
       CASE c WHEN 0 THEN f WHEN 1 THEN concat(CAST(CAST(floor(qty) AS BIGINT) AS STRING), CASE WHEN ln % 3 = 0 THEN '*' ELSE '' END)
              WHEN 2 THEN concat('$', CAST(CAST(floor(price) AS BIGINT) AS STRING)) ELSE CASE WHEN ln % 2 = 0 THEN '3 or more' ELSE s END END text,
       CASE WHEN pk % 13 = 0 THEN 'colgroup' ELSE CAST(NULL AS STRING) END scope
FROM fx_lines CROSS JOIN (VALUES (0), (1), (2), (3)) v(c) WHERE NOT (ln = 1 AND pk % 3 = 0 AND c > 0)""",
    "fx_modes": """
SELECT doc_id, k table_idx, kind, max(mode) mode FROM (
  SELECT doc_id, k, 'table_headers' kind, CASE k % 5 WHEN 0 THEN 'first_row' WHEN 1 THEN 'title_row' WHEN 2 THEN 'none' ELSE 'auto' END mode FROM fx_lines
  UNION ALL SELECT doc_id, k, 'table_aligns', CASE k % 7 WHEN 0 THEN 'left_all' WHEN 1 THEN 'center_all' WHEN 2 THEN 'right_all' WHEN 3 THEN 'right_numeric' WHEN 4 THEN 'auto_skip_first' ELSE 'auto' END FROM fx_lines
  UNION ALL SELECT doc_id, k, 'table_blocks', CASE k % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'center' WHEN 2 THEN 'left' WHEN 3 THEN 'right' ELSE 'auto' END FROM fx_lines) m
GROUP BY doc_id, k, kind""",
    "fx_links": """
SELECT page_id doc_id, url href FROM pages
UNION ALL SELECT page_id, regexp_replace(url, '^https?://', '') FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, concat('#', CAST(page_id % 40 AS STRING)) FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, concat('javascript:', url) FROM pages WHERE page_id % 7 = 0
UNION ALL SELECT page_id, concat('https://a.example@', substr(url, 9)) FROM pages WHERE page_id % 11 = 0
UNION ALL SELECT page_id, concat('//', substr(url, 9)) FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id, concat('mailto:', regexp_replace(url, '^https?://', ''), '@x.example') FROM pages WHERE page_id % 6 = 0
UNION ALL SELECT page_id, concat(' #x', CAST(page_id AS STRING)) FROM pages WHERE page_id % 9 = 0
UNION ALL SELECT page_id, '' FROM pages WHERE page_id % 10 = 0""",
    "fx_segs": """
SELECT doc_id, para_idx block_idx, i seg_idx, CASE i WHEN 0 THEN 'As required by ' WHEN 1 THEN label WHEN 2 THEN concat(', see also ', label, ' and RCW ') WHEN 3 THEN '42.52.040' ELSE '.' END text,
       i = 3 OR (i = 1 AND para_idx % 2 = 0) in_link, CASE WHEN i = 3 THEN 'https://app.example/rcw' WHEN i = 1 AND para_idx % 2 = 0 THEN concat('#h-', CAST(para_idx AS STRING)) END href,
       CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 15 + length(label) WHEN 3 THEN 35 + 2 * length(label) ELSE 44 + 2 * length(label) END AS INT) start,
       CAST(CASE i WHEN 0 THEN 15 WHEN 1 THEN 15 + length(label) WHEN 2 THEN 35 + 2 * length(label) WHEN 3 THEN 44 + 2 * length(label) ELSE 45 + 2 * length(label) END AS INT) "end"
FROM fx_refs CROSS JOIN (VALUES (0, 0), (1, 0), (2, 0), (3, 0), (4, 0)) v(i, z)""",
    "fx_split": """
SELECT doc_id, para_idx block_idx, i seg_idx, CASE i WHEN 0 THEN 'See ' WHEN 1 THEN substr(label, 1, length(label) - 2)
         ELSE concat(substr(label, length(label) - 1), CASE WHEN para_idx % 5 = 0 THEN '.9 on' ELSE ' on.' END) END text, i = 1 in_link,
       CASE WHEN i = 1 THEN CASE WHEN para_idx % 3 = 0 THEN 'https://o.example' ELSE concat('#h-', CAST(para_idx - para_idx % 2 AS STRING)) END END href
FROM fx_refs CROSS JOIN (VALUES (0, 0), (1, 0), (2, 0)) v(i, z)""",
    "fx_lists": f"""
SELECT doc_id, pos list_idx, CASE WHEN (ln % 3 = 0 OR pos % 4096 = 1) THEN CAST(NULL AS INT) ELSE pos - 1 END parent_list_idx,
       CASE sk % 6 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'i' WHEN 3 THEN 'A' WHEN 4 THEN '1' ELSE 'I' END type FROM fx_lines""",
    "fx_children": f"""
SELECT doc_id, ord child_idx, CASE WHEN ord % 4096 = 0 THEN 'h1' WHEN ord % 9 = 0 THEN 'h2' WHEN ord % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'p' END tag,
       CASE WHEN ord % 4096 = 0 THEN CASE WHEN ord % 5 = 0 THEN concat('Chapter ', CAST(ord % 30 AS STRING), ' Rules') ELSE text END
            WHEN ord % 9 = 0 THEN CASE WHEN ord % 4 = 0 THEN 'Table of Contents' ELSE text END
            WHEN ord % 3 = 0 THEN concat(CASE ord % 5 WHEN 0 THEN 'a. ' WHEN 1 THEN 'iv) ' WHEN 2 THEN '3. ' WHEN 3 THEN 'B. ' ELSE '' END, text) ELSE text END text
FROM fx_headings""",
    "fx_events": """
SELECT event_id seq, ts, user_id ref_id, event_type kind, CASE WHEN value < 5 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END value FROM events""",
    "fx_lines_text": "SELECT doc_id, text FROM documents",
    "fx_styles": """
SELECT nation_id doc_id, style_id, based_on, font_name, font_size, color FROM (
  SELECT c_nationkey nation_id, concat('s', CAST(c_custkey AS STRING)) style_id,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 31 = 1 THEN concat('s', CAST(c_custkey AS STRING)) ELSE concat('s', CAST(p AS STRING)) END based_on,
    CASE WHEN c_custkey % 4 = 0 THEN concat('Font', CAST(c_custkey % 10 AS STRING)) END font_name,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(8 + c_custkey % 20 AS DOUBLE) END font_size,
    CASE WHEN c_custkey % 5 = 0 THEN '#' || lpad(CAST(c_custkey % 1000 AS STRING), 6, '0') END color
  FROM (SELECT c.c_nationkey, c.c_custkey, max(d.c_custkey) p FROM (SELECT c_nationkey, c_custkey, explode(sequence(c_custkey - 60, c_custkey - 1)) AS near FROM customer) c
        LEFT JOIN customer d ON d.c_nationkey = c.c_nationkey AND d.c_custkey = c.near GROUP BY c.c_nationkey, c.c_custkey) x) y""",
    "fx_style_uses": """
SELECT CAST(c_nationkey AS BIGINT) doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'r' END kind,
       concat('s', CAST(o_custkey + o_orderkey % 3 AS STRING)) style_id FROM orders JOIN customer ON c_custkey = o_custkey""",
    "fx_members": """
SELECT concat('bundle-', CAST(doc_id AS STRING)) path, member, CAST(floor(price * 10000) AS BIGINT) size, member LIKE '%/' is_dir FROM (
  SELECT doc_id, price, CASE pk % 9 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'edits.json' WHEN 2 THEN 'source.docx'
    WHEN 3 THEN CASE WHEN doc_id % 10 = 0 THEN '../evil.txt' ELSE 'notes.txt' END WHEN 4 THEN 'sub/' WHEN 5 THEN 'sub/edits.json'
    WHEN 6 THEN CASE WHEN doc_id % 15 = 0 THEN '/abs.txt' ELSE 'stable_heading_map.json' END WHEN 7 THEN concat('a', chr(92), 'b.txt') ELSE concat('x', CAST(pk AS STRING)) END member
  FROM fx_lines) m""",
    "fx_manifests": """
SELECT concat('bundle-', CAST(doc_id AS STRING)) path, role, CASE WHEN role = 'docx' THEN CASE doc_id % 4 WHEN 0 THEN 'source.docx' WHEN 1 THEN '../source.docx' WHEN 2 THEN 'absent.docx' ELSE 'source.docx' END
  ELSE CASE doc_id % 3 WHEN 0 THEN 'edits.json' WHEN 1 THEN '' ELSE 'edits.json' END END name
FROM fx_docs CROSS JOIN (VALUES ('docx'), ('edits')) v(role)""",
    "fx_maps": """
SELECT o_orderkey doc_id, CASE o_orderkey % 5
  WHEN 0 THEN concat('{"Order ', CAST(o_custkey AS STRING), '!": "id-', CAST(o_custkey AS STRING), '", "Other": ""}')
  WHEN 1 THEN concat('{"Order  ', CAST(o_custkey AS STRING), '": ["a", " b ", ""]}')
  WHEN 2 THEN concat('{"version": 1, "entries": [{"signature": "Order ', CAST(o_custkey AS STRING), '", "id": "x"}, {"signature": "ORDER ', CAST(o_custkey AS STRING), '", "ids": ["y", "z"]}]}')
  WHEN 3 THEN concat('[{"signature": "Order ', CAST(o_custkey AS STRING), '", "id": "x"}, {"id": "lost"}, 7]')
  ELSE '{broken' END raw,
  CASE o_orderkey % 3 WHEN 0 THEN concat('{"decimal>alpha_upper": ', CAST(1 + o_custkey % 5 AS STRING), ', "decimal": 1, ">": 4, "x": "no"}')
  WHEN 1 THEN concat('[{"sequence": ["roman_upper", "decimal"], "level": ', CAST(1 + o_custkey % 5 AS STRING), '}, {"sequence": [], "level": 1}, {"level": 2}]') ELSE '' END seq_raw,
  o_custkey ck FROM orders""",
}


def _uses(sql: str) -> list[str]:
    return [n for n in ["fx_lines", *SQL] if re.search(rf"\b{n}\b", sql)]


def with_fixtures(sql: str) -> str:
    """DuckDB text of a query: the fixtures it needs in front, in dependency order."""
    order: list[str] = []

    def add(text):
        for n in _uses(text):
            if n not in order:
                add(LINES.format(n=DUCK_N) if n == "fx_lines" else SQL[n])
                if n not in order:
                    order.append(n)

    add(sql)
    body = {n: (LINES.format(n=DUCK_N) if n == "fx_lines" else duck_text(SQL[n])) for n in order}
    ctes = ", ".join(f"{n} AS ({body[n]})" for n in order)
    if not ctes:
        return sql
    sql = sql.strip()
    if sql[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes} {sql}"


def duck_text(sql: str) -> str:
    return sql.replace("explode(sequence(c_custkey - 60, c_custkey - 1))", "unnest(range(c_custkey - 60, c_custkey))")


def spark_text(sql: str) -> str:
    """Constant row expansion as LATERAL VIEW inline, and Spark's quoting of "end"."""
    def expand(m):
        rows = re.sub(r"(?<![\w'])\((?=['0-9])", "struct(", m.group(1))
        return f"LATERAL VIEW inline(array({rows})) v AS {m.group(2)}"

    # Words of a line that a text names in many places are worked out once; each place would carry the code of all of them.
    used = {name: text for name, text in WORDS.items() if text in sql}
    for name, text in used.items():
        sql = sql.replace(text, name)
    if used:
        sql = sql.replace("FROM fx_lines", f"FROM fx_lines LATERAL VIEW inline(array(struct({', '.join(used.values())}))) w AS {', '.join(used)}")
    return re.sub(r"CROSS JOIN \(VALUES\s+(.*?)\) v\(([\w, ]+)\)", expand, sql, flags=re.S).replace('"end"', "`end`")


class Source:
    """Tables and fixtures of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for t in ("lineitem", "orders", "customer", "part", "pages", "events", "documents"):
            if re.search(rf"\b{t}\b", text):
                self.table(t).createOrReplaceTempView(t)
        for n in _uses(text):
            self(n).createOrReplaceTempView(n)
        return self.spark.sql(spark_text(text))

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            df = self._lines() if name == "fx_lines" else self.sql(SQL[name]) if name in SQL else self.table(name)
            self._made[name] = bind(df, {BOUND[name]: F.col(BOUND[name])}).select(*df.columns) if name in BOUND else df
        return self._made[name]

    def _lines(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                           "l_extendedprice", "l_returnflag", "l_linestatus")
        # An order is short by the positions above, so a window per order does; it needs one exchange, which is the same wherever the
        # lines are read, and no join.
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
        li.withColumn("n", F.row_number().over(w)).createOrReplaceTempView("numbered_lines")
        return self.spark.sql(LINES.format(n="1 AS _u").replace("(SELECT *, 1 AS _u FROM lineitem) t", "numbered_lines"))
