"""Interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.intervals import normalize_interval, parse_interval
from . import bindings as b
from .bindings import with_views


def interval_genes(spark, folder):
    return b.candidates(spark, folder).select("case_id", "gene_id", "symbol", "chrom", "start", "end")


def interval_overlap_class(spark, folder):
    return b.candidates(spark, folder).select("case_id", "gene_id", "interval_start", "interval_end", "interval_overlap")


def interval_string_normalize(spark, folder):
    nation = F.col("s_nationkey")
    name = (F.when(nation == 22, "X").when(nation == 23, "Y").when(nation == 24, "99")
            .otherwise((nation + 1).cast("string")))
    raw = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("case_id"),
        F.concat(F.when(F.col("s_suppkey") % 2 == 0, "chr").otherwise(""), name).alias("chrom"),
        (F.col("s_suppkey") * 1500).cast("string").alias("start"),
        F.concat((F.col("s_suppkey") * 1500 + 60000).cast("string"),
                 F.when(F.col("s_acctbal") < 0, ".5").otherwise("")).alias("end"),
        F.when(nation % 2 == 0, "0-based-half-open").otherwise("1-based-inclusive").alias("coordinates"))
    done = normalize_interval(raw, "coordinates").withColumn("parsed", parse_interval("interval"))
    return done.select("case_id", "interval", "reject_reason", F.col("parsed.chrom").alias("parsed_chrom"),
                       F.col("parsed.start").alias("parsed_start"), F.col("parsed.end").alias("parsed_end"))


QUERIES = {"interval_genes": interval_genes, "interval_overlap_class": interval_overlap_class,
           "interval_string_normalize": interval_string_normalize}

ORACLES = {
    "interval_genes": with_views("candidates", """SELECT case_id, gene_id, symbol, chrom, g_start AS start, g_end AS "end"
        FROM candidates"""),
    "interval_overlap_class": with_views("candidates", """SELECT case_id, gene_id, i_start AS interval_start,
        i_end AS interval_end, interval_overlap FROM candidates"""),
    "interval_string_normalize": """
        WITH raw AS (SELECT s_suppkey AS case_id,
            CASE s_nationkey WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN '99' ELSE (s_nationkey + 1)::VARCHAR END AS name,
            s_suppkey * 1500 + CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 0 END AS s,
            s_suppkey * 1500 + 60000 AS e, s_acctbal < 0 AS broken FROM supplier),
        judged AS (SELECT *, CASE WHEN name = '99' THEN 'unsupported_chromosome' WHEN broken THEN 'non_integer_coordinates'
            WHEN s < 1 OR s > e THEN 'empty_or_reversed' END AS reject_reason FROM raw)
        SELECT case_id, reject_reason,
          CASE WHEN reject_reason IS NULL THEN 'chr' || name || ':' || s || '-' || e END AS interval,
          CASE WHEN reject_reason IS NULL THEN 'chr' || name END AS parsed_chrom,
          CASE WHEN reject_reason IS NULL THEN s END AS parsed_start,
          CASE WHEN reject_reason IS NULL THEN e END AS parsed_end FROM judged""",
}
