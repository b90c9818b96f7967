"""Clean a corpus: each stage reads what its predecessor kept, written as Parquet in the shared folder.

Stages, in order: quality rules, line dedup, SimHash near-dedup (one document of each class stays), benchmark decontamination and
piece encoding. All but the last return the columns of ``documents``. NULL texts count as empty; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import decontamination, line_dedup, quality, sentence_pieces, simhash
from lociframe.llm.queries import piece_model, table
from lociframe.scale import shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encode_documents(docs, piece_model()))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", first_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("pieces", pieces),
]

# The classifier and the piece encoder have no SQL form; the tests hold each stage's operator against brute force, not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
