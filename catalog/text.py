"""Text, label and URL functions over whole columns."""

from pyspark.sql import functions as F

from docweave.functions import fixed as K
from docweave.functions import labels as L
from docweave.functions import urls as U

from . import sqlx as X
from .registry import query

T = "fx_numbered"
KEY = "doc_id, ord"


def over(fx, key, exprs):
    return lambda s: s(fx).select(*[k.strip() for k in key.split(",")], *[c().alias(n) for n, (c, _) in exprs.items()])


def simple(name, fx, key, exprs):
    """Register a projection: {column: (spark column, duckdb text)}."""
    sql = f"SELECT {key}, " + ", ".join(f"{t} AS {n}" for n, (_, t) in exprs.items()) + f" FROM {fx}"
    query(name, sql)(over(fx, key, exprs))


H = "href"
simple("is_safe_href", "fx_links", "doc_id, href", {"safe": (lambda: U.is_safe_href(H), X.safe_href(H))})
simple("normalize_external_href", "fx_links", "doc_id, href", {"url": (lambda: U.normalize_external_href(H), X.normalize_href(H))})
simple("sanitize_external_href", "fx_links", "doc_id, href", {"url": (lambda: U.sanitize_external_href(H), X.sanitize_href(H))})
V, LOW = X.strip(H), f"lower({X.strip(H)})"
simple("is_bad_docx_link", "fx_links", "doc_id, href", {"bad": (lambda: U.is_bad_docx_link(H), (
    f"CASE WHEN href = '' THEN true WHEN starts_with({LOW}, '#x') OR starts_with({LOW}, 'file:') THEN true "
    rf"WHEN regexp_matches({V}, '^[a-zA-Z]:\\\\') OR regexp_matches({V}, '^[a-zA-Z]:/') OR starts_with({V}, '\\') THEN true "
    f"WHEN starts_with({LOW}, '#') THEN false WHEN starts_with({LOW}, 'mailto:') THEN NOT contains(substr({V}, 8, 73), '@') "
    f"WHEN {X.web(V)} THEN false ELSE true END"))})

query("is_reference_label", rf"""
SELECT label, count(*) AS n, bool_and(CASE WHEN regexp_matches(label, '^(?:Chapter|Section)\s+', 'i') THEN true
  ELSE NOT (regexp_matches(label, {X.q(K.DEGREE)}, 'i') OR (NOT regexp_matches(label, '\d') AND regexp_matches(label, {X.q(K.LETTERS_DOTTED)}))) END) AS ok
FROM (SELECT label FROM fx_cites UNION ALL SELECT split_part(label, ' ', 2) FROM fx_refs
      UNION ALL SELECT replace(replace(label, 'Section 7.', 'M.'), 'Chapter 12.', 'Ph.') FROM fx_refs) x GROUP BY label""")(
    lambda s: s.sql("""SELECT label FROM fx_cites UNION ALL SELECT split_part(label, ' ', 2) FROM fx_refs
      UNION ALL SELECT replace(replace(label, 'Section 7.', 'M.'), 'Chapter 12.', 'Ph.') FROM fx_refs""")
    .withColumn("ok", L.is_reference_label("label")).groupBy("label").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok")))

simple("looks_numbered_heading", T, KEY, {"numbered": (lambda: L.looks_numbered_heading("text"), X.looks_numbered("text"))})
simple("normalize_ws", "documents", "doc_id", {
    "n": (lambda: F.length(L.normalize_ws("text")), rf"length(regexp_replace(text, '[\x{{200b}}\x{{200c}}\x{{200d}}]', '', 'g'))"),
    "collapsed": (lambda: F.md5(L.collapse_ws("text")), f"md5({X.collapse('text')})")})
simple("heading_signature", T, KEY, {"signature": (lambda: L.heading_signature("text"), X.sig("text"))})
simple("normalize_heading_ref", T, KEY, {"ref": (lambda: L.normalize_heading_ref("text"), X.norm_ref("text"))})
simple("ensure_prefixed", T, KEY, {
    "as_chapter": (lambda: L.ensure_prefixed("text", F.lit("chapter")), X.prefixed("text")),
    "as_section": (lambda: L.ensure_prefixed("text", F.lit("policy")), X.prefixed("text", "Section"))})
R = "regexp_extract(label, ' ([^.]+)', 1)"
simple("roman_to_int", "fx_refs", "doc_id, para_idx", {"value": (lambda: L.roman_to_int(F.regexp_extract("label", " ([^.]+)", 1)), X.roman(R))})
N = "CAST(1 + l_partkey % 3999 AS INT)"
ROM = ("substr(repeat('M', {n} // 1000), 1) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][({n} // 100) % 10 + 1] || "
       "['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][({n} // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][{n} % 10 + 1]").format(n="v")
LET = ("(CASE WHEN v > 702 THEN chr(64 + (v - 703) // 676 + 1) ELSE '' END) || (CASE WHEN v > 26 THEN chr(65 + ((v - 27) // 26) % 26) ELSE '' END) || chr(65 + (v - 1) % 26)")
query("format_number", f"""SELECT v, n, {ROM} AS roman, {LET} AS letters, lower({LET}) AS lower_letters, CAST(v AS VARCHAR) AS plain
FROM (SELECT {N} v, count(*) n FROM lineitem GROUP BY 1) t""")(
    lambda s: s("lineitem").groupBy((F.lit(1) + F.col("l_partkey") % 3999).cast("int").alias("v")).agg(F.count("*").alias("n")).select(
        "v", "n", L.format_number("v", F.lit("upperRoman")).alias("roman"), L.format_number("v", F.lit("upperLetter")).alias("letters"),
        L.format_number("v", F.lit("lowerLetter")).alias("lower_letters"), L.format_number("v", F.lit("decimal")).alias("plain")))
simple("convert_numbering", "fx_refs", "doc_id, para_idx", {"new_label": (lambda: L.convert_numbering("label"), X.convert("label"))})
simple("convert_heading_numbering", T, KEY, {"new_text": (lambda: L.convert_numbering("text"), X.convert("text"))})
simple("heading_slug", T, KEY, {
    "slug": (lambda: L.heading_slug(L.strip("text")), X.slug(X.strip("text"))),
    "scraped": (lambda: L.scrape_slug("text", True), X.slug_tail(r"regexp_replace(text, '^[\d\.\s]+', '')")),
    "client": (lambda: L.client_slug("text"),
               r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '^(.*?)chapter\s+\w+\s*[–—-]\s*', '\1'), "
               r"'[^\w\s.-]', '', 'g')), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')")})
PRE = f"regexp_extract(text, {X.q('(' + K.HEADING_PREFIX + ')')}, 1)"
simple("strip_heading_prefix", T, KEY, {
    "title": (lambda: L.strip_heading_prefix("text")["title"], f"substr(text, length({PRE}) + 1)"),
    "prefix": (lambda: L.strip_heading_prefix("text")["prefix"], X.strip(PRE))})
simple("strip_label_prefix", T, KEY, {"title": (lambda: L.strip_label_prefix("text"), X.strip_label("text"))})
simple("heading_tokens", T, KEY, {
    "tokens": (lambda: F.array_join(L.heading_tokens("text"), "|"), f"array_to_string({X.heading_tokens('text')}, '|')"),
    "style_tokens": (lambda: F.array_join(L.style_tokens("text"), "|"), f"array_to_string({X.style_tokens('text')}, '|')"),
    "types": (lambda: F.array_join(L.token_types(L.style_tokens("text")), ">"), f"array_to_string({X.types(X.style_tokens('text'))}, '>')")})
simple("has_number_prefix", T, KEY, {"numbered": (lambda: L.has_number_prefix("text"), X.has_number("text"))})
simple("bookmark_id", T, KEY, {
    "bookmark": (lambda: L.bookmark_id("text"), "CASE WHEN text = '' THEN 'b_1' WHEN regexp_matches(text, '^[A-Za-z]') THEN regexp_replace(text, '[^A-Za-z0-9_]', '_', 'g') "
                 "ELSE 'b_' || regexp_replace(text, '[^A-Za-z0-9_]', '_', 'g') END"),
    "anchor": (lambda: L.export_anchor_id("text"), r"CASE WHEN regexp_matches(text, '^\d') THEN 'h_' ELSE '' END || substr(regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g'), 1, 40)")})
simple("ref_id", "fx_cites", "doc_id, para_idx, label, start", {
    "ref_id": (lambda: L.ref_id("para_idx", "start", "label"), "concat('ref_', CAST(para_idx AS VARCHAR), '_', CAST(start AS VARCHAR), '_', substr(md5(label), 1, 8))")})
simple("content_hash", "documents", "doc_id", {
    "doc_hash": (lambda: L.content_hash("text"), "sha256(text)"),
    "config_hash": (lambda: L.config_hash(source=F.col("source"), lang=F.col("lang")),
                    """sha256('{"lang":' || to_json(coalesce(lang, '')) || ',"source":' || to_json(coalesce(source, '')) || '}')""")})
DOC_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"
query("guess_heading_level", f"SELECT doc_id, lvl, count(*) AS n FROM (SELECT doc_id, {X.guess('line')} AS lvl FROM ({DOC_LINES}) d) e GROUP BY doc_id, lvl")(
    lambda s: s("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    .groupBy("doc_id", L.guess_heading_level("line").alias("lvl")).agg(F.count("*").alias("n")))
simple("guess_heading_level_titles", T, KEY, {"lvl": (lambda: L.guess_heading_level("text"), X.guess("text"))})
RM, AL, DE = (f"regexp_extract(text, {X.q(p)}, 1)" for p in (K.LIST_ROMAN, K.LIST_ALPHA, K.LIST_DECIMAL))
simple("list_marker", "fx_children", "doc_id, child_idx", {
    "kind": (lambda: L.list_marker("text")["kind"], f"CASE WHEN {RM} <> '' THEN 'roman' WHEN {AL} <> '' THEN 'alpha' WHEN {DE} <> '' THEN 'decimal' END"),
    "value": (lambda: L.list_marker("text")["value"], f"CASE WHEN {RM} <> '' THEN {X.roman(RM)} WHEN {AL} <> '' THEN ascii(lower({AL})) - 96 WHEN {DE} <> '' THEN CAST({DE} AS INT) END"),
    "type": (lambda: L.list_marker("text")["type"], f"CASE WHEN {RM} <> '' THEN CASE WHEN lower({RM}) = {RM} THEN 'i' ELSE 'I' END WHEN {AL} <> '' THEN CASE WHEN lower({AL}) = {AL} THEN 'a' ELSE 'A' END WHEN {DE} <> '' THEN '' END")})
CP = r"regexp_extract(text, '(^|[\s(\[])((?:RCW|WAC|BPPM)\s+)$', 2)"
simple("citation_prefix", "fx_segs", "doc_id, block_idx, seg_idx", {
    "head": (lambda: L.citation_prefix("text")["head"], f"substr(text, 1, length(text) - length({CP}))"),
    "prefix": (lambda: L.citation_prefix("text")["prefix"], CP)})


@query("heading_sort_key", f"""
WITH labels AS (SELECT DISTINCT label FROM fx_cites),
parts AS (SELECT label, list_transform(list_filter(string_split(replace({X.no_word('label')}, '-', '.'), '.'), lambda p: p <> ''),
  lambda p: CASE WHEN ({X.roman('p')}) > 0 THEN '0:' || lpad(CAST({X.roman('p')} AS VARCHAR), 9, '0') WHEN regexp_matches(p, '^\\d+$') THEN '0:' || lpad(p, 9, '0')
    WHEN regexp_matches(p, '^[A-Za-z]$') THEN '0:' || lpad(CAST(ascii(upper(p)) - 64 AS VARCHAR), 9, '0') ELSE '1:' || lower(p) END) ks FROM labels)
SELECT label, row_number() OVER (ORDER BY ks, label) AS rank FROM parts""")
def _(s):
    from docweave.operators.scan import row_number, scan
    keyed = s("fx_cites").select("label").distinct().withColumn("k", L.heading_sort_key("label"))
    keyed = keyed.withColumn("g", F.lit(0))
    return scan(keyed, ["g"], ["k", "label"], {"rank": row_number()}, chunk=F.slice("k", 1, 1)).select("label", "rank")


# Scans whose whole point is a row filter.
query("paragraph_slice", "SELECT doc_id, para_idx, text FROM fx_paras WHERE para_idx >= 4096 AND para_idx < 90000")(
    lambda s: __import__("docweave.operators.paragraphs", fromlist=["x"]).paragraph_slice(s("fx_paras"), 4096, 90000))


@query("contrast_audit", """
WITH c AS (SELECT o_orderkey doc_id, '#' || lpad(printf('%x', o_custkey * 7919 % 16777216), 6, '0') fg, '#' || lpad(printf('%x', o_orderkey * 104729 % 16777216), 6, '0') bg FROM orders),
ch AS (SELECT *, list_transform([substr(fg,2,2), substr(fg,4,2), substr(fg,6,2)], lambda h: ('0x' || h)::INT / 255.0) f, list_transform([substr(bg,2,2), substr(bg,4,2), substr(bg,6,2)], lambda h: ('0x' || h)::INT / 255.0) b FROM c),
l AS (SELECT *, list_transform(f, lambda x: CASE WHEN x <= 0.03928 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) lf,
  list_transform(b, lambda x: CASE WHEN x <= 0.03928 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) lb FROM ch),
r AS (SELECT doc_id, fg, bg, 0.2126 * lf[1] + 0.7152 * lf[2] + 0.0722 * lf[3] a, 0.2126 * lb[1] + 0.7152 * lb[2] + 0.0722 * lb[3] b FROM l)
SELECT doc_id, fg, bg, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS ratio FROM r""")
def _(s):
    from docweave.operators.tables import contrast_ratio
    color = lambda c, m: F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col(c) * m % 16777216).cast("long"))), 6, "0"))
    df = s("orders").select(F.col("o_orderkey").alias("doc_id"), color("o_custkey", 7919).alias("fg"), color("o_orderkey", 104729).alias("bg"))
    return df.withColumn("ratio", F.round(contrast_ratio("fg", "bg"), 6))
