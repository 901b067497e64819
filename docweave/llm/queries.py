"""The queries of the numbered operators, with production parameters, and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bin_slack, periodic_runs, prefix_trie, quality_knn, toxicity_fm
from .common import crc_rest, table
from .decontaminate import contaminated
from .licenses import CUE, OTHER_TERM, TERM, document_paths, licences, template_weights
from .line_dedup import without_boilerplate
from .packing import pack
from .quality_rules import quality_rules
from .secrets_scan import digest, secret_spans
from .simhash import near_duplicates
from .warc import round_trip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


@query("op1_warc_salvage", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""")
def op1(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages")).drop("archive", "offset")


@query("op2_simhash_trie")
def op2(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_line_spread", r"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, coalesce('s' || source, '-') AS site, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS pos FROM d),
n AS (SELECT *, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM l),
w AS (SELECT *, regexp_matches(raw, '[^\x20\x09-\x0D]') AS has_word, length(norm) - length(replace(norm, ' ', '')) + 1 AS n_words FROM n),
s AS (SELECT norm FROM w WHERE has_word GROUP BY norm HAVING count(DISTINCT site) >= CASE WHEN max(n_words) >= 50 THEN 2 ELSE 3 END),
r AS (SELECT w.*, s.norm IS NOT NULL AND row_number() OVER (PARTITION BY w.norm ORDER BY doc_id, pos) > 1 AS gone
      FROM w LEFT JOIN s ON w.norm = s.norm AND w.has_word)
SELECT doc_id, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM r GROUP BY doc_id""")
def op3(spark, sf_dir):
    return without_boilerplate(table(spark, sf_dir, "documents"), "n_removed").select("doc_id", "n_removed", "text")


@query("op4_length_buckets")
def op4(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


@query("op5_quality_knn")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    score = quality_knn.scorer(spark, quality_knn.learn(docs, table(spark, sf_dir, "labels"), crc_rest(3) != 1))
    out = docs.select("doc_id", (crc_rest(3) == 1).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_WEIGHTS = ", ".join(f"({k}, '{n}', '{t}', {w!r}::DOUBLE, {i!r}::DOUBLE)" for k, n, t, w, i in template_weights())


@query("op6_license_scan", rf"""
WITH w(template, license, term, weight, idf) AS (VALUES {_WEIGHTS}),
f AS (SELECT doc_id, text, coalesce(regexp_matches(text, '{CUE}'), false) AS marked, source || '/' || (doc_id // 4096) AS up, doc_id // 64 AS leaf FROM documents),
p AS (SELECT doc_id, text, marked, CASE WHEN marked AND leaf % 4 = 0 THEN up ELSE up || '/' || leaf END AS dir,
             CASE WHEN marked THEN 'LICENSE-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS name, up FROM f),
g AS (SELECT doc_id, unnest(list_append(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CUE}')), text)) AS passage FROM p WHERE marked),
n AS (SELECT doc_id, row_number() OVER () AS pid, regexp_extract_all(lower(passage), '{TERM}') AS terms FROM g),
t AS (SELECT doc_id, pid, unnest(terms) AS term FROM n),
i AS (SELECT term, max(idf) AS idf FROM w GROUP BY 1),
c AS (SELECT doc_id, pid, t.term, count(*) * max(i.idf) AS own, count(*) AS k FROM t LEFT JOIN i ON t.term = i.term GROUP BY ALL),
m AS (SELECT pid, sqrt(sum(CASE WHEN own IS NULL THEN k * {OTHER_TERM} * {OTHER_TERM} ELSE own * own END)) AS norm FROM c GROUP BY 1),
s AS (SELECT doc_id, c.pid, template, license, CAST(round(1000 * sum(own * weight) / max(norm)) AS INTEGER) AS similarity
      FROM c JOIN w ON c.term = w.term JOIN m ON m.pid = c.pid GROUP BY ALL),
o AS (SELECT doc_id, min_by(license, (-similarity, license)) AS own_license, max(similarity) AS similarity FROM s WHERE similarity >= 500 GROUP BY 1),
d AS (SELECT p.dir, min_by(own_license, (-o.similarity, own_license)) AS inherited FROM p JOIN o ON p.doc_id = o.doc_id GROUP BY 1)
SELECT p.doc_id, p.dir || '/' || name AS path, own_license, o.similarity,
       coalesce(own_license, d1.inherited, d2.inherited) AS license,
       CASE WHEN own_license IS NULL THEN CASE WHEN d1.inherited IS NOT NULL THEN p.dir WHEN d2.inherited IS NOT NULL THEN p.up END END AS inherited_from
FROM p LEFT JOIN o ON p.doc_id = o.doc_id LEFT JOIN d d1 ON d1.dir = p.dir LEFT JOIN d d2 ON d2.dir = p.up""")
def op6(spark, sf_dir):
    return licences(document_paths(table(spark, sf_dir, "documents")))


@query("op7_toxicity_fm")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    score = toxicity_fm.scorer(spark, toxicity_fm.learn(docs, table(spark, sf_dir, "labels"), crc_rest(4) != 2))
    out = docs.select("doc_id", (crc_rest(4) == 2).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op8_decontaminate")
def op8(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_risk_rules")
def op9(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_secret_randomness")
def op10(spark, sf_dir):
    return digest(secret_spans(table(spark, sf_dir, "documents")))


@query("op11_recompression")
def op11(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def hundreds():
    """Every conversation takes over up to five turns of the first one of its hundred."""
    return F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, 5


_BYTES = "[ascii(s)::BIGINT FOR s IN string_split(conv_id::VARCHAR, '')]"
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
v AS MATERIALIZED (SELECT conv_id, pos, dense_rank() OVER (ORDER BY role, text) AS turn, length(text) AS chars FROM t),
c AS MATERIALIZED (SELECT conv_id, max(pos) AS n, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM v GROUP BY conv_id),
b AS (SELECT c.conv_id, n, base, h, least(h, coalesce((SELECT max(pos) FROM v WHERE v.conv_id = c.base), 0)) AS hb FROM c),
r AS (SELECT b.conv_id, pos AS depth, turn, chars FROM b JOIN v ON v.conv_id = base AND pos <= hb
      UNION ALL SELECT b.conv_id, hb + pos - h, turn, chars FROM b JOIN v ON v.conv_id = b.conv_id AND pos > h),
p AS MATERIALIZED (SELECT conv_id, depth, chars, list(turn) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key FROM r
      UNION ALL SELECT conv_id, 0, 0, [] FROM b),
l AS (SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id),
g AS MATERIALIZED (SELECT key, min(conv_id) AS owner, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY key),
k AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n_children, min(owner) AS owner FROM g WHERE depth > 0 GROUP BY 1),
f AS (SELECT g.owner, g.depth, g.key, g.n_convs, g.chars, coalesce(k.n_children, 0) AS n_children FROM g LEFT JOIN k ON g.key = k.key),
s AS (SELECT p.key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
      FROM f JOIN p ON p.conv_id = f.owner AND p.depth <= f.depth GROUP BY p.key),
e AS (SELECT key, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids FROM p JOIN l ON p.conv_id = l.conv_id AND depth = length GROUP BY key)
SELECT f.owner AS conv_id, f.depth::BIGINT AS depth, u.owner AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM f JOIN s ON s.key = f.key LEFT JOIN e ON e.key = f.key LEFT JOIN g u ON f.depth > 0 AND u.key = list_slice(f.key, 1, f.depth - 1)""")
def op12(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), *hundreds())


@query("op13_min_slack")
def op13(spark, sf_dir):
    import public_tokenizers as tokens

    cut = bin_slack.pieces(table(spark, sf_dir, "documents"), tokens.path("byte_bpe_50k.json"), tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN)
    return bin_slack.pack(cut)
