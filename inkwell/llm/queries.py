"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontamination, fingerprints, jaccard_join, language_id, mixing, secret_scan, sentence_spans, suffix_dedup, token_files, urls
from inkwell.llm.common import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = language_id.label(docs.select("doc_id", "text"), language_id.fit(docs))
    return labelled.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_report(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentence_spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("span_sentences").alias("n_sentences"), F.col("span_removed").alias("n_removed"), F.col("span_cuts").alias("cuts"), "text")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).drop("source", "key")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_sentence_spans": op8_sentence_spans,
    "op9_url_filters": op9_url_filters,
    "op10_source_mix": op10_source_mix,
}

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END) AS shingles FROM w
), c AS (
  SELECT shingles, len(shingles) AS n, count(*) AS copies, min(doc_id) AS low, row_number() OVER (ORDER BY min(doc_id)) AS class
  FROM s WHERE len(shingles) > 0 GROUP BY shingles
), e AS (SELECT class, n, unnest(shingles) AS shingle FROM c
), common AS (
  SELECT a.class AS a, b.class AS b, any_value(a.n) AS a_n, any_value(b.n) AS b_n, count(*) AS shared
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.class <> b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), link AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (a_n + b_n - shared)
), reach(a, b) AS (SELECT class, class FROM c UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), component AS (SELECT r.a AS class, min(low) AS component FROM reach r JOIN c ON r.b = c.class GROUP BY r.a
), far AS (SELECT a AS class, sum(copies) AS others FROM link JOIN c ON link.b = c.class GROUP BY a
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(component, s.doc_id) AS component_id,
       coalesce(copies - 1 + coalesce(others, 0), 0)::BIGINT AS n_links
FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN component USING (class) LEFT JOIN far USING (class)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, hex(encode(coalesce(text, ''))) AS data FROM documents
), n AS (SELECT *, length(data) // 2 AS n_bytes FROM d
), p AS (SELECT k, doc, data, unnest(range(0, n_bytes - 49)) AS place FROM n
), strings AS (SELECT k, doc, place, substr(data, 2 * place + 1, 100) AS string FROM p
), least AS (SELECT string, min(doc) AS first FROM strings GROUP BY string HAVING count(*) > 1
), gone AS (SELECT k, place FROM strings JOIN least USING (string) WHERE doc > first
), marked AS (SELECT k, place, CASE WHEN place <= lag(place) OVER (PARTITION BY k ORDER BY place) + 50 THEN 0 ELSE 1 END AS new FROM gone
), numbered AS (SELECT k, place, sum(new) OVER (PARTITION BY k ORDER BY place) AS run FROM marked
), runs AS (SELECT k, run, min(place) AS start, max(place) + 50 AS stop FROM numbered GROUP BY k, run
), totals AS (SELECT k, sum(stop - start) AS removed, count(*) AS n_spans FROM runs GROUP BY k
), pieces AS (
  SELECT k, coalesce(lag(stop) OVER (PARTITION BY k ORDER BY start), 0) AS start, start AS stop FROM runs
  UNION ALL SELECT n.k, coalesce(max(stop), 0), any_value(n_bytes) FROM n LEFT JOIN runs ON n.k = runs.k GROUP BY n.k
), kept AS (SELECT k, string_agg(substr(data, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start, stop) AS data FROM pieces JOIN n USING (k) GROUP BY k
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.data)) AS kept_sha256
FROM n JOIN kept USING (k) LEFT JOIN totals USING (k)
"""

OP9_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), rules(verdict, h, q) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), numbered AS (SELECT *, row_number() OVER () AS k FROM p
), fit AS (
  SELECT k, h || q AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(h || q) DESC, length(h) DESC) AS n
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fit WHERE n = 1) f USING (k)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source
), u AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS unit,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS rank
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, min(CASE WHEN weight * unit <= 3 * source_size THEN rank END) OVER () AS from_rank FROM u
), t AS (
  SELECT source, source_size, CASE WHEN rank >= from_rank THEN weight * max(CASE WHEN rank = from_rank THEN unit END) OVER () ELSE (3 * source_size)::DOUBLE END AS target FROM f
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before)))::BIGINT AS taken
FROM c
"""

ORACLES = {"op1_jaccard_join": OP1_SQL, "op6_suffix_dedup": OP6_SQL, "op9_url_filters": OP9_SQL, "op10_source_mix": OP10_SQL}
