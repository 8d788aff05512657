"""Queries over whole tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqspark.llm import chat, lattice, leaks, lmscore, mixing, simhash, tokens, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_duplicates(_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), r AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
), c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"), "verbatim")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=512)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM d
), digits AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS twenty FROM f
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(twenty, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM digits
"""

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


OP9_SQL = r"""
WITH r(r_host, r_path, r_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), p AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT n, page_id, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), h AS (
  SELECT n, page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM q
), m AS (
  SELECT h.*, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(r_host) + length(r_path) DESC NULLS LAST, length(r_host) DESC) AS k
  FROM h LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


CONTROL_TALK = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame(CONTROL_TALK, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.union(more)))


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
), n AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '\\|</?s>|<</?SYS>>|\[/?INST\]')) + 20 AS size FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are documents labelled as of high quality, the background all documents."""
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_weights(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_duplicates": op1_lattice_duplicates,
    "op2_template_leaks": op2_template_leaks,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_toxicity": op5_toxicity,
    "op6_chat_paths": op6_chat_paths,
    "op7_lm_scores": op7_lm_scores,
    "op8_source_mix": op8_source_mix,
    "op9_url_rules": op9_url_rules,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op1_lattice_duplicates": OP1_SQL,
    "op4_warc_revisits": OP4_SQL,
    "op6_chat_paths": OP6_SQL,
    "op8_source_mix": mixing.mix_sql(),
    "op9_url_rules": OP9_SQL,
}
