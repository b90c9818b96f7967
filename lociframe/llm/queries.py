"""Registered queries of this folder over the supplied tables, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import shared_folder
from . import alignment, archives, conversations, decontamination, language_model, licenses, line_dedup, quality, repeats, sentence_pieces, simhash, token_counts, toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, folder, "documents")))


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return language_model.score(table(spark, folder, "documents"), held_out)


def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encode_documents(table(spark, folder, "documents"), piece_model()))


def op5_archives(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    target = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_archives(archives.plan_records(pages), target)
    return archives.digests(archives.read_archives(spark.read.parquet(target)), pages.schema["page_id"].dataType.simpleString())


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.summary(table(spark, folder, "documents"), links=True)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("row_key")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, folder, "labels")))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, folder, "documents")))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), piece_model())


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    held = alignment.Vocabularies.read(public_tokenizers.path("byte_bpe_50k.json"), piece_model())
    return alignment.align_documents(table(spark, folder, "documents"), held)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damage and repair of every conversation. By crc32(``conv_id:turn``) % 20 a turn is dropped (0), emptied (1), loses its .!? (2),
    stands twice (3) or becomes the user's (4)."""
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.score(docs, toxicity.fit(docs, labels, held_out), held_out)


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_repeats": op2_repeats,
    "op3_language_model": op3_language_model,
    "op4_pieces": op4_pieces,
    "op5_archives": op5_archives,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_toxicity": op13_toxicity,
}

# Base32 of a SHA-1: five hexadecimal digits at a time are four symbols.
ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
    d AS (SELECT digest, max(page_id) AS newest FROM p GROUP BY digest)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
      list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(p.digest, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> newest THEN newest END AS refers_to, 'verified' AS status
    FROM p JOIN d USING (digest)"""

LINES = r"""WITH d AS (SELECT DISTINCT doc_id, coalesce(text,'') AS text FROM documents),
 s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d),
 l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM s),
 w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM l),
 f AS (SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM w WHERE worded GROUP BY line),
 k AS (SELECT a.line AS one, count(*) AS links, bool_or(b.first < a.first) AS later FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line
   WHERE greatest(a.n, b.n) >= 5 AND least(a.n, b.n) >= 4 AND levenshtein(a.line, b.line) <= CASE WHEN greatest(a.n, b.n) < 10 THEN 1 ELSE 2 END GROUP BY a.line)
 SELECT doc_id, count(*) AS n_lines, sum((worded AND (coalesce(later, false) OR first <> {'d': doc_id, 'l': line_no}))::BIGINT)::BIGINT AS n_removed,
   sum((worded AND coalesce(later, false))::BIGINT)::BIGINT AS n_near, sum(CASE WHEN worded THEN coalesce(links, 0) ELSE 0 END)::BIGINT AS n_links
 FROM w LEFT JOIN f USING (line) LEFT JOIN k ON w.line = k.one GROUP BY doc_id"""

ORACLES: dict[str, str] = {
    "op5_archives": ARCHIVES,
    "op6_line_dedup": LINES,
}
