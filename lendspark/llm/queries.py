"""The registered queries of the operators, with production parameters over
whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.llm import (decontaminate, exact_topk, filter_audit, gru_lm, licences, ngram_join, packing, secret_scan,
                           sharding, spelling, suffix_dedup, toxicity, url_filter)
from lendspark.llm.common import read_table

URL_RULES = [url_filter.site_rule("block", "net/"), url_filter.site_rule("allow", "example.net/en/"),
             url_filter.site_rule("block", "example.com/de/"), url_filter.site_rule("allow", "org/fr/")]


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(remainder(4) != 2)
    model = toxicity.train(docs.where(remainder(4) != 2), labels)
    return (toxicity.classify(docs, model)
            .select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic"))


def tokenizer_path() -> str:
    """The public tokenizer file of the packing query."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read_table(spark, sf_dir, "pages"), URL_RULES, unwanted=url_filter.UNWANTED)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"),
                                    read_table(spark, sf_dir, "benchmark"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.shingle_join(read_table(spark, sf_dir, "documents")).drop("n_links")


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.find_secrets(read_table(spark, sf_dir, "documents")))


def op8_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return (gru_lm.score_documents(docs, remainder(5) != 1)
            .select("doc_id", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"),
                    "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_digest(licences.find_licences(read_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_url_verdicts, op4_benchmark_leaks, op5_exact_topk,
                                    op6_ngram_join, op7_secret_spans, op8_balanced_shards, op9_suffix_dedup,
                                    op10_lm_scores, op11_spelling_variants, op12_filter_audit, op13_licence_scan)}


def _glob_sql(glob: str) -> str:
    """A glob over ``.`` + host + path as a condition."""
    text = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", glob))
    return f"regexp_full_match('.' || host || path, '{text}', 's')"


OP3_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, coalesce(r, '') AS r FROM u)),
m AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
      THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NULL AND unwanted IS NOT NULL THEN 'block'
            ELSE 'allow' END AS verdict, unwanted
FROM (SELECT *, CASE """ + " ".join(f"WHEN {_glob_sql(g)} THEN '{g}'" for g in url_filter.UNWANTED) + """ END AS unwanted
      FROM m)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, least(len(q.w), len(c.w)) + 1)])
                       AS BIGINT), 0) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
      FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT b, root FROM reach JOIN both_ways ON a = reach.doc_id)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM reach JOIN n USING (doc_id) GROUP BY doc_id
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INTEGER)) AS good,
             max(CAST(coalesce(toxic, 0) = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id, part, list_filter([
           CASE WHEN len(w) < 50 THEN 'A' END,
           CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
           CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' END,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
           CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM d),
m AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN k USING (doc_id) GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x,
         string_split(substr(filter_order, 1, step - 1), '') AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, x, n, good, toxic, len(fails) AS j, list_contains(fails, x) AS hit,
         step > 1 AND list_has_any(fails, before) AS gone
  FROM s, m)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (hit AND j = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(sum(n) FILTER (hit AND NOT gone)) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step, x
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_verdicts": OP3_SQL, "op5_exact_topk": OP5_SQL, "op6_ngram_join": OP6_SQL,
            "op12_filter_audit": OP12_SQL}
