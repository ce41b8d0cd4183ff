"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stakeperf.llm import bpe, conversations, crosspoly, langid, minhash, packing, periodic, phrases, pii, quality, topk, toxicity, urls
from stakeperf.llm.common import table

#: Fixed values of the URL rules: (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE)


def op6_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed: the canonical URLs that more than one page has."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(pages, rules, urls.repeated_urls(pages))


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE))


def op11_branch_and_bound_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def looped_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of one document in ten (by the crc32 of its id) the words from place a on are
    taken from the p words there, over and over; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op12_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents", "doc_id", "text"), looped_places)


def op13_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_cross_parsing, op2_cross_polytope, op3_phrase_automata, op4_classifier_chain, op5_forced_boundary_bpe, op6_bloom_url_filter, op7_semi_markov_pii, op8_uniform_threshold, op9_superminhash, op10_best_fit_packing, op11_branch_and_bound_repair, op12_grammar_runs, op13_line_first_quality)}

_URL_PARTS = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)"""

_EMBEDDED = "FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0"

ORACLE_SQL: dict[str, str] = {
    "op3_phrase_automata": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id), range(0, 50) r(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS line FROM each e ANTI JOIN gone g USING (doc_id, i) GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_bloom_url_filter": _URL_PARTS + """,
rules(rule_host, rule_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT n, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
listed AS (SELECT host, path FROM parts WHERE host <> '' GROUP BY host, path HAVING count(*) > 1)
SELECT page_id, p.host, p.path, rule, CASE WHEN action IS NOT NULL THEN action WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND k = 1 LEFT JOIN listed l ON l.host = p.host AND l.path = p.path""",
    "op8_uniform_threshold": f"""
WITH v AS (SELECT vec_id, [floor(256 * CAST(e AS DOUBLE)) for e in embedding] AS x {_EMBEDDED}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op9_superminhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op13_line_first_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
line AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, trim(lower(line), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS low,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[!?]')) AS shouts, len(regexp_extract_all(line, '[|»›•·]')) AS separators
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (
  SELECT r, line, n,
         NOT regexp_matches(line, '[.!?…]["''”’»)\]]*([\x20\x09-\x0D]|$)') OR symbols >= n OR (shouts >= 2 AND 2 * shouts > n) OR separators >= 2
         OR low IN ('home', 'menu', 'login', 'log in', 'sign in', 'sign up', 'next', 'previous', 'back to top', 'read more', 'skip to content', 'share', 'search', 'contact', 'about us')
         OR regexp_matches(low, 'all rights reserved|licensed under|released under the|privacy policy|terms of service|terms of use|cookie policy|accept cookies|copyright ©|\(c\) copyright|enable javascript|subscribe to our|lorem ipsum') AS fails
  FROM line WHERE n > 0),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count_if(fails) AS bad, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM windows, range(0, 3) x(j) WHERE k > 1 GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(bad, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(lost, 0) AS BIGINT) AS n_words_removed
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered c USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_removed <= 40 * n_words AS kept
FROM f""",
}
