"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceframe.llm import collocations, fingerprints, licenses, metric_tree, mixing, near_dedup, pieces, substring_dedup, toxicity, url_filter, vector_search, warc, whitening
from spliceframe.llm.common import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(F.regexp_extract_all("text", F.lit(f"({WORD})")), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(F.coalesce(kept, F.lit("")), "utf-8"), 256).alias("kept_sha256"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"), "offending")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    places = F.array_join(F.transform(F.array_sort(F.transform("matches", lambda m: F.struct(m["license"].alias("license"), m["line"].alias("line")))), lambda m: F.concat(m["license"], F.lit("@"), m["line"].cast("string"))), ",")
    return out.select("doc_id", "license", "score", "line", "n_matches", places.alias("places"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.exact_top_k(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_url_filter, op4_vector_search, op5_mixing, op6_warc, op7_licenses, op8_near_dedup, op9_fingerprints, op10_substring_dedup, op11_whitening, op12_collocations, op13_exact_top_k)}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HOST = r"coalesce(translate(regexp_extract({}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_REST = r"coalesce(regexp_extract({}, '^.*?://[^/?#]*([^#]*)', 1, 's'), '')"


def _node(url: str) -> str:
    return f"CASE WHEN {_HOST.format(url)} <> '' THEN {_HOST.format(url)} || CASE WHEN {_REST.format(url)} = '' THEN '/' ELSE {_REST.format(url)} END END"


def _rules_sql(host: str, path: str, value: int) -> str:
    """The first rule that fits, longest first. value 0: its text, 1: its verdict."""
    when = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[value]}'" for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))]
    return "CASE " + " ".join(when) + " END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _attribute_sql(parts: str, name: str) -> str:
    raw = f"regexp_extract(list_filter({parts}, lambda x: lower(regexp_extract(x, {_quoted(url_filter.NAME)}, 1)) = '{name}')[1], {_quoted(url_filter.VALUE)}, 1)"
    bare = f"CASE WHEN regexp_matches({raw}, {_quoted('^[\x22\x27]')}) THEN substr({raw}, 2, greatest(length({raw}) - 2, 0)) ELSE {raw} END"
    for entity, char in url_filter.ENTITIES:
        bare = f"regexp_replace({bare}, '{entity}', {_quoted(char)}, 'g')"
    return rf"nullif(regexp_replace({bare}, '^\s+|\s+$', '', 'g'), '')"


def _resolved_sql(to: str, url: str) -> str:
    path = rf"coalesce(nullif(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), ''), '/')"
    way, rest, origin = rf"regexp_extract({to}, '^([^?#]*)', 1, 's')", rf"regexp_extract({to}, '^[^?#]*(.*)$', 1, 's')", f"'http://' || {_HOST.format(url)}"

    def without_dots(p: str) -> str:
        folded = rf"list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda acc, x: CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END)"
        return rf"CASE WHEN regexp_matches({p}, '/\.\.?$') THEN {folded} || '/' ELSE {folded} END"

    folder = rf"regexp_extract({path}, '^(.*/)', 1, 's')"
    return rf"""CASE WHEN regexp_matches({to}, '(?i)^https?://') THEN {to} WHEN starts_with({to}, '//') THEN 'http:' || {to} WHEN regexp_matches({to}, '(?i)^[a-z][a-z0-9+.-]*:') OR {_HOST.format(url)} = '' THEN NULL
 WHEN starts_with({to}, '/') THEN {origin} || {without_dots(way)} || {rest} WHEN starts_with({to}, '?') THEN {origin} || {path} || {to}
 WHEN starts_with({to}, '#') THEN {origin} || {path} || regexp_extract({url}, '^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1, 's') || {to} ELSE {origin} || {without_dots(f"({folder} || {way})")} || {rest} END"""


def _license_templates() -> str:
    rows = [f"('{name}', [{', '.join(f"'{g}'" for g in grams)}])" for name, grams in licenses.template_bigrams()]
    return "(VALUES " + ", ".join(rows) + ") t(license, grams)"


ORACLES = {
    "op3_url_filter": f"""
WITH RECURSIVE p AS (SELECT page_id, {_HOST.format('url')} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, {_node('url')} AS node, url, html FROM pages),
h AS (SELECT node, url, row_number() OVER () AS r, list_filter(regexp_extract_all(html, {_quoted(url_filter.TAGS)}), lambda t: regexp_matches(t, '(?i)^<(?:link|meta|base)')) AS tags FROM p),
u AS (SELECT node, url, r, unnest(tags) AS tag, generate_subscripts(tags, 1) AS nr FROM h),
k AS (SELECT node, url, r, nr, lower(substr(tag, 2, 4)) AS kind, regexp_extract_all(tag, {_quoted(url_filter.ATTRIBUTES)}) AS parts FROM u),
v AS (SELECT node, url, r, nr, kind, {_attribute_sql('parts', 'href')} AS href, regexp_split_to_array(lower({_attribute_sql('parts', 'rel')}), '\\s+') AS rel, lower({_attribute_sql('parts', 'http-equiv')}) AS equiv, {_attribute_sql('parts', 'content')} AS content FROM k),
b AS (SELECT r, arg_min(href, nr) AS base FROM v WHERE kind = 'base' AND href IS NOT NULL GROUP BY 1),
l AS (SELECT node, r, url, CASE WHEN kind = 'link' AND list_contains(rel, 'canonical') THEN href
  WHEN kind = 'meta' AND equiv = 'refresh' THEN nullif(regexp_replace({' || '.join(f'regexp_extract(content, {_quoted(url_filter.REFRESH)}, {i})' for i in (1, 2, 3))}, '^\\s+|\\s+$', '', 'g'), '') END AS t FROM v),
w AS (SELECT node, t, coalesce({_resolved_sql('base', 'url')}, url) AS base FROM l LEFT JOIN b USING (r) WHERE t IS NOT NULL),
a AS (SELECT node, {_resolved_sql('t', 'base')} AS t FROM w),
g AS (SELECT node AS x, {_node('t')} AS y FROM a WHERE node IS NOT NULL AND t IS NOT NULL),
e AS (SELECT x, y FROM g WHERE x <> y UNION SELECT y, x FROM g WHERE x <> y),
n AS (SELECT DISTINCT x AS node FROM e),
r AS (SELECT node, node AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(root) AS comp FROM r GROUP BY 1),
o AS (SELECT node, comp, {_HOST.format("'http://' || node")} AS h, coalesce(regexp_extract('http://' || node, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS q FROM c),
s AS (SELECT comp, min({_rules_sql('h', 'q', 1)}) AS spread FROM o GROUP BY 1)
SELECT page_id, host, path, {_rules_sql('host', 'path', 0)} AS rule, coalesce({_rules_sql('host', 'path', 1)}, spread, 'allow') AS verdict
FROM p LEFT JOIN c ON c.node = p.node LEFT JOIN s ON s.comp = c.comp""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f""",
    "op7_licenses": f"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT r, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM l UNION ALL SELECT r, 0, text FROM l WHERE len(ls) > 1),
w AS (SELECT r, line, string_split(trim(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM u),
b AS (SELECT r, line, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS g FROM w),
m AS (SELECT r, line, license, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams))::DOUBLE AS score FROM b, {_license_templates()}
  WHERE len(g) > 0 AND 200 * len(list_intersect(g, grams)) >= 75 * (len(g) + len(grams))),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, license, line) AS n, count(*) OVER (PARTITION BY r) AS n_matches, string_agg(license || '@' || line, ',' ORDER BY license, line) OVER (PARTITION BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS places FROM m)
SELECT doc_id, license, score, line, coalesce(n_matches, 0) AS n_matches, coalesce(places, '') AS places FROM l LEFT JOIN k ON k.r = l.r AND k.n = 1""",
    "op8_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 75 * (i.n + j.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(coalesce({_LOWER}, ''), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i+k-1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
h AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, ws FROM c),
t AS (SELECT *, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut+1:], ' ') AS rp FROM h),
s AS (SELECT t.lang, t.phrase, t.a, cut, x.a AS l, y.a AS r, (1000000 * t.a * t.a) // (x.a * y.a) AS score FROM t JOIN f x ON x.lang = t.lang AND x.phrase = lp JOIN f y ON y.lang = t.lang AND y.phrase = rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s),
i AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
d AS (SELECT lang, phrase, max(a) AS within FROM i GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN d USING (lang, phrase) WHERE o = 1 AND NOT coalesce(100 * within >= 50 * b.a, false)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i+49], ' ')) AS k FROM x),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY 1),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM h JOIN f USING (k), range(50) t(o) WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE [ws[j] for j in range(1, len(ws) + 1) if NOT list_contains(ps, j)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)""",
}
