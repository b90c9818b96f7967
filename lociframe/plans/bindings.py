"""Domain views derived from the supplied star-schema tables.

Each view exists twice, as a DataFrame for Spark and as SQL text for the DuckDB twin, written
independently so that one checks the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Bin width of the range joins over the small synthetic genome.
BIN = 1 << 14


def genes(spark, folder) -> DataFrame:
    part = table(spark, folder, "part")
    start = F.col("p_partkey") * 100
    return part.select(
        F.col("p_partkey").alias("gene_id"), F.concat(F.lit("HGNC:"), "p_partkey").alias("hgnc_id"),
        F.concat(F.lit("S"), "p_partkey").alias("symbol"), F.col("p_brand").alias("chrom"), start.alias("start"),
        (start + F.col("p_size") * 10).alias("end"))


def cases(spark, folder) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.alias("case_id"), F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("chrom"),
        (key * 1500).alias("start"), (key * 1500 + 60000).alias("end"))


def evidence(spark, folder) -> DataFrame:
    key = F.col("p_partkey")
    codes = F.array(*[F.lit(x).cast("double") for x in (0, 1, 2, 3, 30, 40, -1, None)])
    return table(spark, folder, "part").select(
        key.alias("gene_id"),
        F.element_at(codes, (key % 8 + 1).cast("int")).alias("clinGen_hi_score"),
        F.when(key % 11 != 0, (F.col("p_retailprice") - 900) / 50).alias("gnomad_LOEUF"),
        F.when(key % 7 != 0, F.col("p_size") / 50).alias("gnomad_pLI"),
        (key % 13 == 0).alias("recessive"))


def controls(spark, folder) -> DataFrame:
    """Positive controls: symbols of the largest parts."""
    return table(spark, folder, "part").where("p_size > 42").select(
        F.concat(F.lit("S"), "p_partkey").alias("symbol"))


def candidates(spark, folder) -> DataFrame:
    from ..operators.intervals import genes_in_intervals
    return genes_in_intervals(genes(spark, folder), cases(spark, folder), BIN)


def panel(spark, folder) -> DataFrame:
    """Candidate genes of every case with their evidence."""
    from ..operators.evidence import join_evidence
    return join_evidence(candidates(spark, folder), evidence(spark, folder), "gene_id")


def tissue_long(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("gene_id"), F.concat("l_returnflag", "l_linestatus").alias("tissue"),
        F.col("l_extendedprice").alias("ntpm"))


def counts(spark, folder) -> DataFrame:
    """Long sparse counts: customers are cells, suppliers are genes."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_suppkey").alias("gene_id"))
            .agg(F.sum("l_quantity").alias("count")))


def cells(spark, folder) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
            .select(F.col("c_custkey").alias("cell_id"), F.col("n_regionkey").alias("sample_id"),
                    F.when(F.col("c_nationkey") % 2 == 1, "patient").otherwise("reference").alias("group"),
                    F.col("c_mktsegment").alias("cell_type")))


def cell_genes(spark, folder) -> DataFrame:
    """Gene dimension of the count matrix, positioned on five chromosomes."""
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    names = F.array(*[F.lit(x) for x in ("chr1", "chr2", "chr3", "chr4", "chrX")])
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(F.col("s_suppkey").alias("gene_id"),
                    F.concat(F.when(F.col("s_nationkey") == 3, "MT-").otherwise("G"), F.col("s_suppkey")).alias("symbol"),
                    F.element_at(names, F.col("n_regionkey") + 1).alias("chrom"),
                    (F.col("s_suppkey") * 1000).alias("start"), (F.col("s_suppkey") * 1000 + 900).alias("end")))


def embeddings(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


VIEWS = {
    "genes": """SELECT p_partkey AS gene_id, 'HGNC:' || p_partkey AS hgnc_id, 'S' || p_partkey AS symbol, p_brand AS chrom,
        p_partkey * 100 AS g_start, p_partkey * 100 + p_size * 10 AS g_end FROM part""",
    "cases": """SELECT s_suppkey AS case_id, 'Brand#' || (s_suppkey % 25 + 1) AS chrom, s_suppkey * 1500 AS i_start,
        s_suppkey * 1500 + 60000 AS i_end FROM supplier""",
    "evidence": """SELECT p_partkey AS gene_id,
        CASE p_partkey % 8 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE WHEN 3 THEN 3.0::DOUBLE
          WHEN 4 THEN 30.0::DOUBLE WHEN 5 THEN 40.0::DOUBLE WHEN 6 THEN -1.0::DOUBLE END AS hi,
        CASE WHEN p_partkey % 11 <> 0 THEN (p_retailprice - 900) / 50 END AS loeuf,
        CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE / 50 END AS pli,
        p_partkey % 13 = 0 AS recessive FROM part""",
    "controls": "SELECT 'S' || p_partkey AS symbol FROM part WHERE p_size > 42",
    "candidates": """SELECT c.case_id, g.*, c.i_start, c.i_end,
        CASE WHEN c.i_start <= g.g_start AND g.g_end <= c.i_end THEN 'full' ELSE 'partial' END AS interval_overlap
        FROM cases c JOIN genes g ON c.chrom = g.chrom AND g.g_end >= c.i_start AND g.g_start <= c.i_end""",
    "panel": "SELECT c.*, e.hi, e.loeuf, e.pli, e.recessive FROM candidates c LEFT JOIN evidence e USING (gene_id)",
    "tissue_long": """SELECT l_partkey AS gene_id, l_returnflag || l_linestatus AS tissue, l_extendedprice AS ntpm
        FROM lineitem""",
    "counts": """SELECT o_custkey AS cell_id, l_suppkey AS gene_id, sum(l_quantity) AS n FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "cells": """SELECT c_custkey AS cell_id, n_regionkey AS sample_id,
        CASE WHEN c_nationkey % 2 = 1 THEN 'patient' ELSE 'reference' END AS grp, c_mktsegment AS cell_type
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "cell_genes": """SELECT s_suppkey AS gene_id, CASE WHEN s_nationkey = 3 THEN 'MT-' ELSE 'G' END || s_suppkey AS symbol,
        CASE n_regionkey WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' WHEN 2 THEN 'chr3' WHEN 3 THEN 'chr4' ELSE 'chrX' END AS chrom,
        s_suppkey * 1000 AS g_start, s_suppkey * 1000 + 900 AS g_end FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "vecs": "SELECT vec_id AS cell_id, embedding::DOUBLE[] AS embedding, label FROM embeddings",
    # score of the three-source panel with raw normalisation (weights 3, 2, 2)
    "bounds": """SELECT case_id, min(loeuf) AS l0, max(loeuf) AS l1, min(pli) AS p0, max(pli) AS p1, count(*) AS n,
        count(loeuf) AS nl, count(pli) AS np, count(*) FILTER (hi IN (0, 1, 2, 3)) AS nh FROM panel GROUP BY case_id""",
    "normed": """SELECT p.*, b.n, b.nl, b.np, b.nh, CASE WHEN hi IN (0, 1, 2, 3) THEN hi / 3 END AS n_hi,
        CASE WHEN loeuf IS NOT NULL THEN 1 - (CASE WHEN l1 > l0 THEN (loeuf - l0) / (l1 - l0) ELSE 0.5 END) END AS n_loeuf,
        CASE WHEN pli IS NOT NULL THEN CASE WHEN p1 > p0 THEN (pli - p0) / (p1 - p0) ELSE 0.5 END END AS n_pli
        FROM panel p JOIN bounds b USING (case_id)""",
    "scored": """SELECT *, coalesce(n_hi, 0) * 3 + coalesce(n_loeuf, 0) * 2 + coalesce(n_pli, 0) * 2 AS score FROM normed""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, hgnc_id ASC NULLS LAST) AS rnk
        FROM scored""",
    "libs": "SELECT cell_id, sum(n) AS lib FROM counts GROUP BY cell_id",
    "expr": "SELECT cell_id, gene_id, n, lib, ln(1 + n / lib * 10000) AS x FROM counts JOIN libs USING (cell_id)",
}

NEEDS = {"candidates": ("cases", "genes"), "panel": ("candidates", "evidence"), "bounds": ("panel",),
         "normed": ("bounds",), "scored": ("normed",), "ranked": ("scored",), "libs": ("counts",), "expr": ("libs",)}


def with_views(names: str, body: str) -> str:
    """SQL text with the listed views (and what they need) as leading common table expressions."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    body = body.strip()
    joiner = ",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body
    return f"WITH {views}{joiner}"
