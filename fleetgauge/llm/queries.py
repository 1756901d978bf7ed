"""The operators over the given tables, with production parameters, and the same questions in SQL where SQL can ask them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import contamination, divergence, edit_counts, html_text, language, license_scan, packing
from fleetgauge.llm import personal_data, shingle_join, substrings, token_links, url_filter, vectors
from fleetgauge.llm.shared import table
from fleetgauge.llm.url_filter import Rule

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def derived_edits(rows: DataFrame) -> DataFrame:
    """Adds three edits to each document, made from its own text and id: a cut, a copied phrase and a new word."""
    size = "length(text)"
    at = "pmod(crc32(cast(doc_id AS string)), {0} + 1)"
    place = at.format(size)
    return rows.withColumn(
        "edits",
        F.expr(
            f"""array(
                struct(bigint({place}) AS start, bigint({place}) + 40 AS stop, '' AS replacement),
                struct({size} DIV 2 AS start, {size} DIV 2 + 5 AS stop, substring(text, 1, 30) AS replacement),
                struct({size} DIV 3 AS start, {size} DIV 3 AS stop, concat(' edited', doc_id) AS replacement))"""
        ),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = edit_counts.with_trees(table(spark, sf_dir, "documents"))
    edited = edit_counts.apply_edits(derived_edits(trees))
    return edited.select("doc_id", "n_before", "n_tokens", "n_encoded", F.length("text").alias("n_chars"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents")).drop("clean_text")


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_components(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align_tokens(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_vectors,
        op2_url_filter,
        op3_token_counts,
        op4_language_id,
        op5_personal_data,
        op6_benchmark_leaks,
        op7_substring_dedup,
        op8_main_text,
        op9_best_fit,
        op10_shingle_join,
        op11_license_scan,
        op12_token_links,
        op13_source_divergence,
    )
}

_COMPONENTS = """
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
    smallest AS (SELECT node, min(other) AS other FROM reach GROUP BY node)"""

ORACLES = {
    "op1_near_vectors": f"""
WITH RECURSIVE units AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM units x JOIN units y ON x.label = y.label AND x.vec_id <> y.vec_id
    WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),{_COMPONENTS}
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(least(s.other, e.vec_id), e.vec_id) AS component_id,
       coalesce(least(s.other, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN smallest s ON s.node = e.vec_id""",
    "op2_url_filter": r"""
WITH rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
parts AS (
    SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts q LEFT JOIN fits f ON q.page_id = f.page_id""",
    "op10_shingle_join": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * o >= 90 * (x.n + y.n - o)),{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(s.other, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN smallest s ON s.node = d.doc_id""",
    "op13_source_divergence": r"""
WITH rows AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
hits AS (SELECT id, lang, source, unnest(terms) AS term FROM rows),
kept AS (SELECT lang, term, count(*) AS n FROM hits GROUP BY ALL HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM hits SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
members AS (
    SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(s.v, 0) AS v
    FROM (SELECT DISTINCT lang, source FROM rows) g LEFT JOIN totals t USING (lang, source) LEFT JOIN sizes s ON s.lang = g.lang),
shares AS (
    SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n,
           1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (m.total + 5 * m.v) AS p
    FROM members m JOIN kept k ON k.lang = m.lang LEFT JOIN cells c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
pairs AS (
    SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(p.p - q.p)), 0) AS value
    FROM members x JOIN members y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN shares p ON p.lang = x.lang AND p.source = x.source
    LEFT JOIN shares q ON q.lang = y.lang AND q.source = y.source AND q.term = p.term GROUP BY ALL),
terms AS (
    SELECT p.lang, p.source, p.term AS item, p.p - (1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (s.total + 5 * s.v)) AS value
    FROM shares p JOIN kept k ON k.lang = p.lang AND k.term = p.term JOIN sizes s ON s.lang = p.lang WHERE p.n > 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', item, value FROM terms WHERE value > 0))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
