"""Registered queries of the corpus operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    chat, conversation_repair, decontaminate, embedding_dedup, exact_dedup, licenses, mixing, pii, quality, secret_scan, simhash, warc, whitening,
)
from tracewell.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


#: Key of the registered query; users pass their own.
PSEUDONYM_KEY = "registered query, not a secret"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_scan(table(spark, sf_dir, "documents"))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


OP2_SQL = chat.oracle()


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    name = lambda c: F.coalesce(f"document.{c}", F.lit("")).alias(c)
    return mixed.select("document.doc_id", "domain", name("lang"), name("source"), "n_tokens", "epoch")


OP3_SQL = mixing.oracle()


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


OP4_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  o AS (SELECT payload_digest, payload_bytes, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM p LEFT JOIN o USING (payload_digest, payload_bytes)"""


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
  bw AS (SELECT item, least(13, len(words)) AS width, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS pos FROM b WHERE len(words) > 0),
  grams AS (SELECT DISTINCT item, width, array_to_string(words[pos:pos + width - 1], ' ') AS gram FROM bw),
  dw AS (SELECT doc_id, width, words, unnest(range(1, len(words) - width + 2)) AS pos FROM d JOIN (SELECT DISTINCT width FROM grams) ON len(words) >= width),
  hits AS (SELECT doc_id, item, pos, width FROM (SELECT doc_id, width, pos, array_to_string(words[pos:pos + width - 1], ' ') AS gram FROM dw) JOIN grams USING (width, gram)),
  covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS w FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
  g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)"""


def op9_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op10_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


OP11_SQL = conversation_repair.oracle()


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """WITH RECURSIVE e AS (SELECT row_number() OVER () AS node, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  u AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0),
  l AS (SELECT x.node AS a, y.node AS b FROM u x JOIN u y ON x.label = y.label AND x.node <> y.node AND len(x.v) = len(y.v)
    WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.98),
  r AS (SELECT node AS start, node AS reached FROM e UNION SELECT start, b FROM r JOIN l ON reached = a),
  c AS (SELECT start, min(vec_id) AS component_id FROM r JOIN e ON reached = node GROUP BY start),
  n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c ON start = node LEFT JOIN n ON a = node"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_chat_perspectives, op3_source_mixing, op4_warc_revisits, op5_pii_pseudonyms,
        op6_decontamination, op7_quality_ranking, op8_exact_dedup, op9_secret_entropy, op10_simhash_variants,
        op11_conversation_repair, op12_embedding_whitening, op13_embedding_near_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op2_chat_perspectives": OP2_SQL,
    "op3_source_mixing": OP3_SQL,
    "op4_warc_revisits": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_embedding_near_dedup": OP13_SQL,
}
