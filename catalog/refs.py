"""Citation, edit and review queries."""

from pyspark.sql import functions as F

from docweave.functions import fixed as K
from docweave.functions import labels as L
from docweave.operators import edits as E
from docweave.operators import headings as H
from docweave.operators import paragraphs as P
from docweave.operators import references as R
from docweave.operators import review as V
from docweave.operators import search as S
from docweave.session import durable

from . import sqlx as X
from .headings import HK, HMAP
from .registry import query

blocks = lambda s: s("fx_refs").select("doc_id", F.col("para_idx").alias("block_idx"), "text")

query("extract_references", """SELECT c.doc_id, c.para_idx, c.label, c.start, c."end", EXISTS (SELECT 1 FROM fx_segs s WHERE s.doc_id = c.doc_id AND s.block_idx = c.para_idx AND s.in_link
  AND c.start < s."end" AND c."end" > s.start) AS is_linked FROM fx_cites c""")(
    lambda s: R.extract_references(blocks(s), s("fx_segs")).select("doc_id", "para_idx", "label", "start", "end", "is_linked"))
query("linked_references", """SELECT doc_id, para_idx, label, start FROM fx_cites c WHERE EXISTS (SELECT 1 FROM fx_segs s WHERE s.doc_id = c.doc_id AND s.block_idx = c.para_idx AND s.in_link
  AND c.start < s."end" AND c."end" > s.start)""")(lambda s: R.linked_references(s("fx_cites"), s("fx_segs")).select("doc_id", "para_idx", "label", "start"))
CITE = X.q(K.CITATION.replace(r"(?<![\p{L}\p{N}_])", "").replace(r"(?![\p{L}\p{N}_])", ""))
query("extract_references_documents", f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {CITE}, 0, 'i')) AS l FROM fx_refs) x GROUP BY doc_id""")(
    lambda s: R.extract_references(blocks(s)).groupBy("doc_id").agg(F.count("*").alias("n")))
query("citations_in_documents")(lambda s: R.extract_references(s("documents").select("doc_id", F.lit(0).alias("block_idx"), "text")))
query("extract_references_docx")(lambda s: R.extract_references_docx(s.sql(
    "SELECT doc_id, para_idx, concat(text, CASE WHEN para_idx % 3 = 0 THEN ' See Section II.A.4 or 1.2.3.' ELSE '' END) text, style_name, outline_lvl FROM fx_paras"))
    .select("doc_id", "para_idx", "label", "start", "end"))
query("occurrence_index", "SELECT doc_id, para_idx, label, start, CAST(rank() OVER (PARTITION BY doc_id, para_idx, lower(label) ORDER BY start) - 1 AS INT) AS occurrence FROM fx_cites")(
    lambda s: R.occurrence_index(s("fx_cites")).select("doc_id", "para_idx", "label", "start", "occurrence"))

PRED, FR = X.convert("label"), X.full_roman("label")
# Ordered candidates for the chapter form: chapter variant in front of every section variant.
_c = "list_filter([{p}, CASE WHEN starts_with(lower({p}), 'chapter ') THEN regexp_replace({p}, '^Chapter ', 'Section ') ELSE regexp_replace({p}, '^Section ', 'Chapter ') END, {r}], lambda z: z IS NOT NULL)"
_flat = "flatten(list_transform({c}, lambda z: CASE WHEN starts_with(lower(z), 'section ') THEN [regexp_replace(z, '^Section ', 'Chapter '), z] ELSE [z] END))"
MATCH = f"""
lab AS (SELECT doc_id, label, min(CAST(para_idx AS BIGINT) * 100000 + start) at_ FROM fx_cites WHERE regexp_matches(label, {X.q(K.CITED_LABEL)}, 'i') GROUP BY ALL),
pr AS (SELECT *, {PRED} AS p, {FR} AS r FROM lab),
ca AS (SELECT *, {_flat.format(c=_c.format(p='p', r='r'))} AS cands FROM pr),
ex AS (SELECT doc_id, label, p, at_, unnest(cands) AS c, generate_subscripts(cands, 1) AS rk FROM ca),
ke AS (SELECT DISTINCT doc_id, key FROM keyed),
mt AS (SELECT ex.doc_id, ex.label AS old_ref, ex.p, ex.at_, arg_min(CASE WHEN ke.key IS NOT NULL THEN ex.c END, CASE WHEN ke.key IS NOT NULL THEN rk END) AS hit FROM ex LEFT JOIN ke ON ke.doc_id = ex.doc_id AND ke.key = ex.c GROUP BY ALL),
cw AS (SELECT doc_id, old_ref, coalesce(hit, p) AS new_ref, hit IS NOT NULL AS matched FROM mt)"""
query("candidate_labels", f"WITH z AS (SELECT DISTINCT label FROM fx_refs), y AS (SELECT label, {PRED} AS p, {FR} AS r FROM z), w AS (SELECT label, {_flat.format(c=_c.format(p='p', r='r'))} AS c FROM y), "
      "u AS (SELECT label, x, min(i) i FROM (SELECT label, unnest(c) x, generate_subscripts(c, 1) i FROM w) q GROUP BY ALL) SELECT label, string_agg(x, '|' ORDER BY i) AS candidates FROM u GROUP BY label")(
    lambda s: s("fx_refs").select("label").distinct().select("label", F.array_join(R.candidate_labels("label"), "|").alias("candidates")))
keyed = lambda s: H.heading_keys(s("fx_numbered"))
index = lambda s: H.heading_index(keyed(s))
KEYED = f"WITH keyed AS ({HK})"
query("match_references", f"{KEYED}, {MATCH} SELECT * FROM cw")(
    lambda s: R.match_references(s("fx_cites"), keyed(s)).select("doc_id", "old_ref", "new_ref", "matched"))
IDX = f"""idx AS (SELECT doc_id, key, min(ord) AS first_ord, max(ord) AS ord, arg_max(text, ord) AS text, arg_max("full", ord) AS "full" FROM keyed GROUP BY doc_id, key)"""
TARGETS = f"SELECT DISTINCT doc_id, CASE WHEN ord % 3 = 0 THEN upper(text) WHEN ord % 3 = 1 THEN trim(text) ELSE concat(text, ' none') END target FROM fx_numbered"
query("find_heading_by_full", f"""{KEYED}, {IDX}, t AS (SELECT DISTINCT doc_id, CASE WHEN ord % 3 = 0 THEN upper(text) WHEN ord % 3 = 1 THEN trim(text) ELSE concat(text, ' none') END target FROM fx_numbered)
SELECT t.doc_id, t.target, arg_min(idx.key, idx.ord) AS key FROM t LEFT JOIN idx ON idx.doc_id = t.doc_id AND (idx."full" = t.target OR ({X.fulltext('t.target')} <> '' AND ({X.fulltext('idx."full"')} = {X.fulltext('t.target')} OR {X.fulltext('idx.text')} = {X.fulltext('t.target')}))) GROUP BY t.doc_id, t.target""")(
    lambda s: R.find_heading_by_full(s.sql(TARGETS), index(s)))
hmap = lambda s: P.extract_heading_map(s("fx_paras"))
NK = X.norm_ref("ref_key")
NL = X.norm_ref("label")
query("lookup_titles", f"""WITH hm AS ({HMAP}), k AS (SELECT *, {NK} AS nk FROM hm WHERE title <> ''), k2 AS (SELECT *, {X.no_word('nk')} AS bk FROM k),
l AS (SELECT DISTINCT doc_id, label FROM fx_refs UNION SELECT DISTINCT doc_id, regexp_replace(label, '\\.[^.]+$', '') FROM fx_refs UNION SELECT doc_id, 'Chapter One' FROM fx_docs), n AS (SELECT *, {NL} AS nl FROM l), m AS (SELECT *, {X.no_word('nl')} AS bl FROM n),
h AS (SELECT m.doc_id, m.label, k2.title, CASE WHEN ref_key = m.label THEN 0 WHEN ref_key = nl THEN 1 WHEN ref_key = bl THEN 2 ELSE 3 END st, k2.ord FROM m JOIN k2 ON k2.doc_id = m.doc_id AND (ref_key IN (m.label, nl, bl) OR nk IN (nl, bl) OR bk IN (nl, bl)))
SELECT m.doc_id, m.label, x.title FROM m LEFT JOIN (SELECT doc_id, label, arg_min(title, CAST(st AS BIGINT) * 1000000000 + ord) AS title FROM h GROUP BY ALL) x USING (doc_id, label)""")(
    lambda s: R.lookup_titles(s.sql("SELECT doc_id, label FROM fx_refs UNION SELECT doc_id, regexp_replace(label, '\\\\.[^.]+$', '') FROM fx_refs UNION SELECT doc_id, 'Chapter One' FROM fx_docs"), hmap(s)))

DEC = """SELECT DISTINCT doc_id, label, CASE WHEN para_idx % 3 = 0 THEN 'Faculty' WHEN para_idx % 3 = 1 THEN label ELSE concat('1.2 - ', 'Duties') END display,
  CASE WHEN para_idx % 4 = 0 THEN '2.1 - Leave' WHEN para_idx % 4 = 1 THEN 'travel duties' ELSE '' END target FROM fx_refs"""
_probe = []
for _i, _n in enumerate(("target", "cr", "display")):
    _st = f"nullif({X.strip_label(_n)}, {_n})"
    _probe += [f"SELECT doc_id, label, display, target, {10 * _i} st, 'key' k, {_n} v FROM d", f"SELECT doc_id, label, display, target, {10 * _i + 1}, 'full', {_n} FROM d",
               f"SELECT doc_id, label, display, target, {10 * _i + 1}, 'norm', {X.fulltext(_n)} FROM d", f"SELECT doc_id, label, display, target, {10 * _i + 2}, 'full', {_st} FROM d",
               f"SELECT doc_id, label, display, target, {10 * _i + 2}, 'norm', {X.fulltext(_st)} FROM d", f"SELECT doc_id, label, display, target, {10 * _i + 3}, 'title', lower({_st}) FROM d",
               f"SELECT doc_id, label, display, target, {100 + 2 * _i}, 'id', {X.slug(_n)} FROM d", f"SELECT doc_id, label, display, target, {101 + 2 * _i}, 'id', {X.slug(X.strip_label(_n))} FROM d"]
query("resolve_anchors", f"""{KEYED}, {MATCH}, {IDX}, ix AS (SELECT *, {X.slug_tail('text')} AS id FROM idx),
d AS (SELECT q.*, cw.new_ref AS cr FROM ({DEC}) q LEFT JOIN cw ON cw.doc_id = q.doc_id AND cw.old_ref = q.label),
pb AS ({' UNION ALL '.join(_probe)}),
lk AS (SELECT doc_id, ord, id, 'key' k, key v FROM ix UNION ALL SELECT doc_id, ord, id, 'full', "full" FROM ix UNION ALL SELECT doc_id, ord, id, 'norm', {X.fulltext('"full"')} FROM ix
  UNION ALL SELECT doc_id, ord, id, 'norm', {X.fulltext('text')} FROM ix UNION ALL SELECT doc_id, ord, id, 'title', lower(trim(text)) FROM ix UNION ALL SELECT doc_id, ord, id, 'id', id FROM ix),
st AS (SELECT pb.doc_id, label, display, target, st, arg_min(id, ord) id FROM pb JOIN lk ON lk.doc_id = pb.doc_id AND lk.k = pb.k AND lk.v = pb.v WHERE pb.v <> '' GROUP BY ALL),
bt AS (SELECT doc_id, label, display, target, arg_min(id, st) anchor FROM st WHERE id <> '' GROUP BY ALL)
SELECT d.doc_id, d.label, d.display, d.target, bt.anchor FROM d LEFT JOIN bt USING (doc_id, label, display, target)""")(
    lambda s: R.resolve_anchors(s.sql(DEC), index(s).withColumn("id", L.scrape_slug("text")), R.match_references(s("fx_cites"), keyed(s)))
    .select("doc_id", "label", "display", "target", "anchor"))
query("nearest_heading", """SELECT doc_id, block_idx, pos, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, b), 'Introduction') AS heading FROM (
  SELECT doc_id, ord AS pos, 0 b, text h, NULL AS block_idx FROM fx_headings UNION ALL SELECT doc_id, para_idx, 1, NULL, CAST(para_idx AS BIGINT) FROM fx_refs) z QUALIFY b = 1""")(
    lambda s: R.nearest_heading(s("fx_refs").select("doc_id", F.col("para_idx").alias("pos"), F.col("para_idx").alias("block_idx")),
                                s("fx_headings").withColumnRenamed("ord", "pos")))
query("live_ids", f"SELECT doc_id, id FROM fx_anchored UNION SELECT doc_id, unnest(['main-content', 'toc-heading', 'search-help']) FROM fx_docs")(
    lambda s: R.live_ids(s("fx_anchored")))
LK = "SELECT doc_id, para_idx AS link_idx, CASE para_idx % 5 WHEN 0 THEN '#' WHEN 1 THEN '#toc-heading' ELSE concat('#h-', CAST(para_idx - para_idx % 3 AS STRING)) END href FROM fx_refs"
query("dead_links", f"WITH l AS ({LK}) SELECT doc_id, link_idx, href, substr(href, 2) AS target FROM l WHERE href <> '#' AND substr(href, 2) NOT IN ('main-content', 'toc-heading', 'search-help') AND NOT EXISTS (SELECT 1 FROM fx_anchored_old h WHERE h.doc_id = l.doc_id AND h.id = substr(l.href, 2))")(
    lambda s: R.dead_links(s.sql(LK), s("fx_anchored_old")))
RM = "SELECT doc_id, concat('h-', CAST(ord AS STRING)) old_id, concat('n-', CAST(ord AS STRING)) new_id FROM fx_headings WHERE ord % 2 = 0"
query("rewrite_internal_hrefs", f"WITH l AS ({LK}), r AS ({RM}) SELECT l.doc_id, link_idx, href, coalesce('#' || r.new_id, href) AS new_href FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.old_id = substr(l.href, 2)")(
    lambda s: R.rewrite_internal_hrefs(s.sql(LK), s.sql(RM)))
query("drop_rebuildable_links", f"SELECT doc_id, block_idx, seg_idx, text, href FROM fx_segs WHERE in_link AND NOT (starts_with(href, '#') AND regexp_matches(text, {CITE}, 'i'))")(
    lambda s: R.drop_rebuildable_links(s("fx_segs").where("in_link")).select("doc_id", "block_idx", "seg_idx", "text", "href"))
query("external_links_in_text", r"""SELECT DISTINCT doc_id, para_idx, unnest(regexp_extract_all(t, 'https?://[^\s\)\]\}>"'']+')) AS href FROM (SELECT doc_id, para_idx, concat(text, ' (see https://x.example/', label, ') or http://y.example/"q"') t FROM fx_refs) z""")(
    lambda s: R.external_links_in_text(s("fx_refs").select("doc_id", "para_idx", F.expr("""concat(text, ' (see https://x.example/', label, ') or http://y.example/"q"')""").alias("para_text"))))

first_cites = "(SELECT doc_id, para_idx, label, start, concat('ref_', CAST(para_idx AS VARCHAR), '_', CAST(start AS VARCHAR), '_', substr(md5(label), 1, 8)) AS ref_id FROM fx_cites)"
WIDE = "SELECT doc_id, ref_id, " + ", ".join(f"max(CASE WHEN kind = '{k}' THEN trim(value) END) {k.replace('reference_', '')}" for k in K.EDIT_KINDS) + " FROM fx_decided GROUP BY doc_id, ref_id"
DECISION = f"""WITH w AS ({WIDE}), c AS (SELECT doc_id, label old_ref, 'X ' || label new_ref FROM (SELECT DISTINCT doc_id, label FROM fx_refs) q WHERE doc_id % 2 = 0), r AS {first_cites}
SELECT r.doc_id, r.ref_id, r.para_idx, r.start, r.label, CASE WHEN ignored = 'true' THEN 'ignored' WHEN validations = 'true' OR edits <> '' OR link_targets <> '' OR external_urls <> '' THEN 'link' ELSE 'none' END AS decision,
  coalesce(nullif(edits, ''), nullif(new_ref, ''), r.label) AS display, coalesce(link_targets, '') AS target, coalesce(external_urls, '') AS url
FROM r LEFT JOIN w USING (doc_id, ref_id) LEFT JOIN c ON c.doc_id = r.doc_id AND c.old_ref = r.label"""
cw_half = lambda s: s.sql("SELECT DISTINCT doc_id, label old_ref, concat('X ', label) new_ref FROM fx_refs WHERE doc_id % 2 = 0")
decided = lambda s: R.link_decisions(R.with_ref_ids(s("fx_cites")), s("fx_decided"), cw_half(s))
query("link_decisions", DECISION)(decided)
query("stale_anchor_fallback", f"""WITH d AS ({DECISION.replace('WITH w', 'WITH w', 1)}), e AS (SELECT *, CASE WHEN para_idx % 3 = 0 THEN 'anchor-' || para_idx ELSE '' END anchor FROM d),
f AS (SELECT e.*, starts_with(url, '#') AND NOT EXISTS (SELECT 1 FROM fx_anchored_old a WHERE a.doc_id = e.doc_id AND a.id = substr(e.url, 2)) AS stale FROM e)
SELECT doc_id, ref_id, stale, CASE WHEN NOT stale AND url <> '' THEN url WHEN anchor <> '' THEN '#' || anchor ELSE '' END AS href FROM f""")(
    lambda s: R.stale_anchor_fallback(decided(s).withColumn("anchor", F.expr("CASE WHEN para_idx % 3 = 0 THEN concat('anchor-', para_idx) ELSE '' END")),
                                      s("fx_anchored_old").select("doc_id", "id").distinct()).select("doc_id", "ref_id", "stale", "href"))
query("absorb_citation_prefixes", r"""WITH w AS (SELECT *, lag(CASE WHEN NOT in_link THEN text END) OVER x p, lead(in_link) OVER x n FROM fx_segs WINDOW x AS (PARTITION BY doc_id, block_idx ORDER BY seg_idx))
SELECT doc_id, block_idx, seg_idx, in_link, CASE WHEN in_link AND p IS NOT NULL THEN regexp_extract(p, '(^|[\s(\[])((?:RCW|WAC|BPPM)\s+)$', 2) || text
  WHEN NOT in_link AND n THEN substr(text, 1, length(text) - length(regexp_extract(text, '(^|[\s(\[])((?:RCW|WAC|BPPM)\s+)$', 2))) ELSE text END AS text FROM w""")(
    lambda s: R.absorb_citation_prefixes(s("fx_segs")))
query("split_anchor_repair", r"""WITH w AS (SELECT *, lead(CASE WHEN NOT in_link THEN text END) OVER (PARTITION BY doc_id, block_idx ORDER BY seg_idx) tl FROM fx_split),
j AS (SELECT w.doc_id, w.block_idx, r.label, w.seg_idx, w.href, w.text a, w.tl FROM w JOIN fx_refs r ON r.doc_id = w.doc_id AND r.para_idx = w.block_idx
  WHERE in_link AND starts_with(href, '#') AND tl IS NOT NULL AND EXISTS (SELECT 1 FROM fx_anchored h WHERE h.doc_id = w.doc_id AND h.id = substr(w.href, 2)) AND starts_with(r.label, w.text) AND r.label <> w.text)
SELECT doc_id, block_idx, label, seg_idx, href, substr(label, length(a) + 1) AS moved, substr(tl, length(label) - length(a) + 1) AS tail FROM j
WHERE starts_with(tl, substr(label, length(a) + 1)) AND NOT regexp_matches(substr(tl, length(label) - length(a) + 1, 2), '^[.\-–—]?\w')""")(
    lambda s: R.split_anchor_repair(s("fx_split"), s("fx_refs"), s("fx_anchored")))


def placed(s):
    d = R.occurrence_index(R.with_ref_ids(s("fx_cites"))).join(decided(s).where("decision = 'link'").select("doc_id", "ref_id", "display", "url"), ["doc_id", "ref_id"])
    return R.place_links(d.select("doc_id", F.col("para_idx").alias("block_idx"), "label", "display", F.col("url").alias("href"), "occurrence"), s("fx_segs"))


query("place_links")(lambda s: placed(s).select("doc_id", "block_idx", "label", "occurrence", "seg_idx", "start", "end", "action", "new_href"))
query("rebuild_linked_text")(lambda s: R.rebuild_text(placed(s), s("fx_segs")))
query("locate_blocks")(lambda s: R.locate_blocks(
    s.sql("SELECT doc_id, concat('r', CAST(para_idx AS STRING)) ref_id, para_idx + CAST(doc_id % 3 AS INT) para_idx, CASE WHEN para_idx % 2 = 0 THEN text ELSE '' END para_text, label FROM fx_refs"),
    s.sql("SELECT doc_id, para_idx block_idx, CASE para_idx % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'li' ELSE 'td' END tag, text, CASE WHEN para_idx % 3 = 0 THEN para_idx END p_idx FROM fx_refs")))
query("label_frequency", "SELECT label, count(*) AS n FROM fx_cites GROUP BY label ORDER BY n DESC, label LIMIT 20")(lambda s: R.label_frequency(s("fx_cites")))
query("unmatched_labels", f"{KEYED}, {MATCH} SELECT label, count(*) AS n FROM fx_cites c WHERE NOT EXISTS (SELECT 1 FROM cw WHERE cw.doc_id = c.doc_id AND cw.old_ref = c.label) GROUP BY label")(
    lambda s: R.unmatched_labels(s("fx_cites"), R.match_references(s("fx_cites"), keyed(s))))

# Edits
all_cites = lambda s: s("fx_cites")
PAIR = r"""cur AS (SELECT doc_id, para_idx para, start, substr(md5(label), 1, 8) h, 'ref_' || para_idx || '_' || start || '_' || substr(md5(label), 1, 8) id FROM fx_cites),
sto AS (SELECT DISTINCT doc_id, ref_id, CAST(split_part(ref_id, '_', 2) AS BIGINT) para, CAST(split_part(ref_id, '_', 3) AS BIGINT) start, split_part(ref_id, '_', 4) h FROM fx_edits)"""
REATT = """SELECT e.doc_id, e.ref_id, e.kind, e.value, CASE WHEN g.ok THEN c.id ELSE e.ref_id END AS new_ref_id, CASE WHEN NOT g.ok THEN 'orphaned' WHEN c.id = e.ref_id THEN 'kept' ELSE 'moved' END AS status
FROM fx_edits e JOIN sn s ON s.doc_id = e.doc_id AND s.ref_id = e.ref_id JOIN g ON g.doc_id = e.doc_id AND g.h = s.h LEFT JOIN cn c ON c.doc_id = e.doc_id AND c.h = s.h AND c.n = s.n"""
GRP = "g AS (SELECT a.doc_id, a.h, a.n = coalesce(b.n, 0) ok FROM (SELECT doc_id, h, count(*) n FROM {s} GROUP BY ALL) a LEFT JOIN (SELECT doc_id, h, count(*) n FROM {c} GROUP BY ALL) b USING (doc_id, h)), sn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY para, start) n FROM {s}), cn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY para, start) n FROM {c})"
query("reattach_edits", f"WITH {PAIR}, {GRP.format(s='sto', c='cur')} {REATT}")(lambda s: E.reattach_edits(all_cites(s), s("fx_edits")))
query("reattach_edits_trusted", f"""WITH {PAIR}, s2 AS (SELECT * FROM sto WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.doc_id = sto.doc_id AND cur.id = sto.ref_id)), c2 AS (SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM sto WHERE cur.doc_id = sto.doc_id AND cur.id = sto.ref_id)),
{GRP.format(s='s2', c='c2')} {REATT} UNION ALL SELECT e.doc_id, e.ref_id, e.kind, e.value, e.ref_id, 'kept' FROM fx_edits e WHERE EXISTS (SELECT 1 FROM cur WHERE cur.doc_id = e.doc_id AND cur.id = e.ref_id)""")(
    lambda s: E.reattach_edits(all_cites(s), s("fx_edits"), trust_exact=True))
query("reattach_summary", f"WITH {PAIR}, {GRP.format(s='sto', c='cur')}, r AS ({REATT}) SELECT doc_id, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'orphaned') AS orphaned FROM r GROUP BY doc_id")(
    lambda s: E.reattach_summary(E.reattach_edits(all_cites(s), s("fx_edits"))))
query("review_status", """WITH r AS (SELECT doc_id, ref_id, max(CASE WHEN kind = 'reference_validations' THEN value = 'true' END) v, max(CASE WHEN kind = 'reference_ignored' THEN true END) i, max(CASE WHEN kind = 'reference_reviewed' THEN value = 'true' END) w FROM fx_decided GROUP BY ALL)
SELECT doc_id, count(*) FILTER (v) AS valid, count(*) FILTER (i) AS skipped, count(*) FILTER (NOT v AND i IS NULL) AS not_link, count(*) FILTER (w) AS reviewed FROM r GROUP BY doc_id""")(
    lambda s: E.review_status(s("fx_decided")))
query("edited_ids", f"SELECT doc_id, ref_id FROM fx_decided INTERSECT SELECT doc_id, ref_id FROM {first_cites} z")(lambda s: E.edited_ids(s("fx_decided"), s("fx_cites")))
BL = "SELECT doc_id, para_idx block_idx, CASE WHEN para_idx % 3 = 0 THEN 'https://b.example' WHEN para_idx % 3 = 1 THEN 'ftp://c' ELSE 'http://a.example' END href FROM fx_refs WHERE para_idx % 2 = 0"
DL = "SELECT doc_id, para_idx, para_idx % 2 link_idx, 'https://d.example' href, para_idx % 7 = 0 bad FROM fx_refs"
query("prefill_external_url", f"""WITH r AS (SELECT * FROM {first_cites} q), b AS ({BL}), d AS ({DL})
SELECT r.doc_id, r.ref_id, r.para_idx, coalesce((SELECT max(value) FROM fx_decided f WHERE f.doc_id = r.doc_id AND f.ref_id = r.ref_id AND kind = 'reference_external_urls' AND value <> ''),
  (SELECT min(href) FROM b WHERE b.doc_id = r.doc_id AND b.block_idx = r.para_idx AND href LIKE 'http%'), (SELECT min(href) FROM d WHERE d.doc_id = r.doc_id AND d.para_idx = r.para_idx AND NOT bad), '') AS url FROM r""")(
    lambda s: E.prefill_external_url(R.with_ref_ids(all_cites(s)), s("fx_decided"), s.sql(BL), s.sql(DL)))

# Crosswalk review
PO = X.norm_ref(f"({X.prefixed('ref_key')})")
CWM = f"""cm0 AS (SELECT doc_id, {PO} AS old_ref, min(ord) AS ord FROM hm WHERE NOT starts_with(ref_key, '_h') GROUP BY 1, 2), cm1 AS (SELECT *, {X.convert('old_ref')} AS cv FROM cm0 WHERE old_ref <> ''),
cm AS (SELECT doc_id, old_ref, {X.canonical('cv')} AS new_ref, ord FROM cm1)"""
query("crosswalk_from_map", f"WITH hm AS ({HMAP}), {CWM} SELECT * FROM cm")(lambda s: V.crosswalk_from_map(hmap(s)))
query("identity_crosswalk", f"SELECT DISTINCT doc_id, label AS old_ref, label AS new_ref FROM fx_cites WHERE regexp_matches(label, {X.q(K.CITED_LABEL)}, 'i')")(lambda s: V.identity_crosswalk(s("fx_cites")))
query("heading_order", f"WITH hm AS ({HMAP}) SELECT doc_id, {X.canonical('ref_key')} AS label, max(ord) AS ord FROM hm WHERE {NK} <> '' GROUP BY 1, 2")(lambda s: V.heading_order(hmap(s)))
AP = "SELECT DISTINCT doc_id, label old_ref, concat('A ', label) new_ref FROM fx_refs WHERE doc_id % 4 = 0"
CT = "SELECT DISTINCT doc_id, label old_ref, concat('C ', label) new_ref FROM fx_refs WHERE doc_id % 4 <= 1"
AU = "SELECT DISTINCT doc_id, label old_ref, label new_ref FROM fx_refs"
query("effective_crosswalk", f"""WITH a AS ({AP}), c AS ({CT}), u AS ({AU}), n AS (SELECT doc_id, old_ref, 'M' AS new_ref FROM u WHERE doc_id % 4 = 2)
SELECT doc_id, old_ref, new_ref, 'approved' AS source FROM a UNION ALL SELECT doc_id, old_ref, new_ref, 'map' FROM n WHERE doc_id NOT IN (SELECT doc_id FROM a)
UNION ALL SELECT doc_id, old_ref, new_ref, 'counters' FROM c WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM n)
UNION ALL SELECT doc_id, old_ref, new_ref, 'auto' FROM u WHERE doc_id % 4 = 3""")(
    lambda s: V.effective_crosswalk(s.sql(AP), s.sql(AU).where("doc_id % 4 = 2").withColumn("new_ref", F.lit("M")), s.sql(CT), s.sql(AU)))


@query("sort_crosswalk", f"WITH hm AS ({HMAP}), {CWM} SELECT doc_id, old_ref, new_ref, ord FROM cm")
def _(s):
    hm = durable(hmap(s))
    return V.sort_crosswalk(V.crosswalk_from_map(hm), V.heading_order(hm))


NO, NW = X.norm_ref("label"), X.norm_ref("coalesce(new_ref, '')")
query("auto_match_status", f"""{KEYED}, {MATCH}, {IDX}, j AS (SELECT c.doc_id, c.para_idx, c.start, c.label, cw.new_ref, idx."full" AS tf FROM fx_cites c LEFT JOIN cw ON cw.doc_id = c.doc_id AND cw.old_ref = c.label LEFT JOIN idx ON idx.doc_id = c.doc_id AND idx.key = cw.new_ref),
k AS (SELECT *, {NO} AS o, {NW} AS w FROM j)
SELECT doc_id, para_idx, start, label, coalesce(new_ref, '') AS new_ref, coalesce(tf, '') AS target_full, tf IS NOT NULL AS found, tf IS NOT NULL AND o <> '' AND (o = w OR {X.no_word('o')} = {X.no_word('w')}) AS exact, tf IS NOT NULL AS default_valid FROM k""")(
    lambda s: V.auto_match_status(s("fx_cites"), index(s), R.match_references(s("fx_cites"), keyed(s))))


@query("crosswalk_review")
def _(s):
    hm = durable(hmap(s))
    return V.crosswalk_review(hm, V.crosswalk_from_map(hm), durable(index(s)))


RV = """SELECT doc_id, para_idx ord, para_idx % 3 <> 0 AND doc_id % 5 <> 2 included, concat(label, CASE WHEN para_idx % 2 = 0 THEN ' - ' ELSE '' END) old_ref,
  CASE WHEN para_idx % 7 = 0 THEN '' ELSE concat('1.', CAST(para_idx % 9 AS STRING)) END new_ref, CASE WHEN para_idx % 4 = 0 THEN concat('Title ', CAST(para_idx AS STRING)) ELSE '' END new_title FROM fx_refs"""
query("apply_crosswalk_review", f"""WITH r AS ({RV}), n AS (SELECT doc_id, ord, {X.canonical('old_ref')} AS o, {X.canonical('new_ref')} AS w FROM r WHERE included AND old_ref <> '' AND new_ref <> ''),
a AS (SELECT doc_id, o AS old_ref, arg_max(w, ord) AS new_ref FROM n WHERE o <> '' AND w <> '' GROUP BY 1, 2)
SELECT *, 'review' AS source FROM a UNION ALL SELECT doc_id, old_ref, new_ref, 'fallback' FROM ({AU}) f WHERE doc_id NOT IN (SELECT doc_id FROM a)""")(
    lambda s: V.apply_crosswalk_review(s.sql(RV), s.sql(AU)))
query("upsert_titles", f"""{KEYED}, {IDX}, lv AS (SELECT doc_id, key, arg_max(level, ord) AS level FROM keyed GROUP BY 1, 2), r AS ({RV}),
t AS (SELECT doc_id, {X.canonical('new_ref')} AS key, arg_max(new_title, ord) AS tt FROM r WHERE included AND old_ref <> '' AND new_ref <> '' AND new_title <> '' GROUP BY 1, 2)
SELECT doc_id, key, coalesce('h' || lv.level, 'unknown') AS level, coalesce(tt, idx.text) AS text, coalesce(key || ' - ' || tt, idx."full") AS "full" FROM idx JOIN lv USING (doc_id, key) FULL JOIN t USING (doc_id, key)""")(
    lambda s: V.upsert_titles(index(s), s.sql(RV)).drop("id"))

# Search
QH = ["duties", "Item", "class urgent"]
query("search_headings", f"""WITH q AS (SELECT unnest(['duties', 'item', 'class urgent']) AS query), h AS (SELECT doc_id, ord, {X.strip('text')} AS title FROM fx_headings),
m AS (SELECT doc_id, query, ord, title FROM h JOIN q ON contains(lower(regexp_replace(title, '^\\d+(\\.\\d+)*\\s*', '')), query))
SELECT * FROM (SELECT doc_id, query, row_number() OVER (PARTITION BY doc_id, query ORDER BY ord) AS rank, count(*) OVER (PARTITION BY doc_id, query) AS total, ord, title FROM m) z WHERE rank <= 8""")(
    lambda s: S.search_headings(s("fx_headings"), QH))
SNIP = "CASE WHEN strpos(lower(t), query) = 0 THEN substr(t, 1, 120) || '...' ELSE CASE WHEN strpos(lower(t), query) > 41 THEN '...' ELSE '' END || substr(t, CAST(greatest(0, strpos(lower(t), query) - 41) + 1 AS BIGINT), CAST(least(length(t), strpos(lower(t), query) - 1 + length(query) + 40) - greatest(0, strpos(lower(t), query) - 41) AS BIGINT)) || CASE WHEN strpos(lower(t), query) - 1 + length(query) + 40 < length(t) THEN '...' ELSE '' END END"
query("search_content", f"""WITH q AS (SELECT unnest(['the', 'see also', 'ung']) AS query), b AS (SELECT doc_id, i AS block_idx, {X.strip('x')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) y),
m AS (SELECT * FROM b JOIN q ON length(t) > 10 AND contains(lower(t), query))
SELECT doc_id, query, rank, total, block_idx, {SNIP} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY block_idx) AS rank, count(*) OVER (PARTITION BY doc_id, query) AS total FROM m) z WHERE rank <= 10""")(
    lambda s: S.search_content(s("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text")), ["the", "see also", "ung"]))
query("highlight_spans", """SELECT doc_id, para_idx, CAST(len(regexp_extract_all(lower(text), 'see also')) AS INT) AS n, CAST(strpos(lower(text), 'see also') - 1 AS INT) AS first_start FROM fx_refs""")(
    lambda s: s("fx_refs").select("doc_id", "para_idx", S.highlight_spans("text", F.lit("See also")).alias("h")).select("doc_id", "para_idx", F.size("h").alias("n"), F.col("h")[0]["start"].alias("first_start")))
