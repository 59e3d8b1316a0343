"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, media, packing, pii, repeats, url_trie, warc
from .common import table

#: Fixed rules of the URL query: (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, "page_id", "url")


OP1_SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, "doc_id", "text", "lang", ~_held_out())
    return langid.identify(docs, model, "doc_id", "text").withColumn("held_out", F.coalesce(_held_out(), F.lit(False)))


def tokenizer_path() -> str:
    """Where the public vocabulary is on this machine; executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", jaccard.Rule(k=4, num=85, den=100))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text").drop("redacted")


def op3_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", 400, passage_words=50).drop("kept")


def op4_media_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspect(media.store_as_samples(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def op6_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_warc(warc.convert_to_warc(pages, "page_id", "url", "html")).withColumnRenamed("id", "page_id")


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id AS c, speaker AS participant FROM t WHERE speaker <> 'system'),
r AS (SELECT conv_id, participant, turn, speaker, text,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user' END AS rendered_role
      FROM t JOIN who ON conv_id IS NOT DISTINCT FROM c),
h AS (SELECT *, '<|' || rendered_role || CASE WHEN rendered_role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
w AS (SELECT *, CAST(coalesce(sum(length(segment)) OVER o, 0) AS BIGINT) AS char_start, count(*) OVER o AS position
      FROM s WINDOW o AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, participant, position, turn, speaker, rendered_role, segment, char_start, char_start + length(segment) AS char_end,
       CASE WHEN speaker = participant THEN char_start + length(head) END AS mask_start,
       CASE WHEN speaker = participant THEN char_start + length(segment) - 1 END AS mask_end FROM w
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_mixture": op2_language_mixture,
    "op3_longest_previous_factors": op3_longest_previous_factors,
    "op4_media_samples": op4_media_samples,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_warc_convert": op6_warc_convert,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_pii_boosting": op8_pii_boosting,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_spaced_seeds": op10_spaced_seeds,
}
SQL = {"op1_url_filter": OP1_SQL, "op5_chat_perspectives": OP5_SQL}
