"""Expectation queries: violations of every contract over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SCREENING
from ..operators import consensus as consensus_op
from ..operators import expectations as op
from . import bindings as b
from .bindings import with_views


def expectation_violations(spark, folder):
    """Number of offending keys and rows per rule over order lines."""
    lines = b.table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.concat(F.lit("HGNC:"), "l_partkey", F.when(
            F.col("l_discount") == 0, "!").otherwise("")).alias("gene"),
        "l_returnflag", F.when(F.col("l_tax") == 0, " ").otherwise("x").alias("note"), F.col("l_discount").alias("score"),
        (F.col("l_quantity") / 2).alias("count"), F.lit("chr1").alias("chrom"), F.col("l_partkey").alias("start"),
        F.col("l_suppkey").alias("end"))
    rules = [op.unique("key"), op.gene_id_syntax("gene"), op.one_of("l_returnflag", ["A", "N"]), *op.non_empty("note"),
             op.in_range("score", 0, 0.08), op.whole_count("count"), op.coordinates()]
    found = op.violations(lines, rules, "key")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


def ranking_invariants(spark, folder):
    """Offending rows of the ranking invariants; every count must be zero."""
    panel = b.panel(spark, folder).drop("recessive")
    ranked = consensus_op.consensus_rank(panel, SCREENING)
    parts = [f"contrib_{s.column}" for s in SCREENING.evidence] + ["hpa_penalty"]
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("rule"), "n_bad")
    rules = [op.unique("case_id", "gene_id"), op.sums_to(parts, "consensus_score")]
    return (count(op.ranks_complete(ranked), "ranks_complete")
            .unionByName(count(op.violations(ranked, rules, "gene_id"), "rows"))
            .unionByName(count(op.candidate_difference(panel, ranked, ["case_id", "gene_id"]), "candidates_preserved")))


def groups_present(spark, folder):
    done = op.groups_present(b.table(spark, folder, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY", "ABSENT"])
    return done


QUERIES = {"expectation_violations": expectation_violations, "ranking_invariants": ranking_invariants,
           "groups_present": groups_present}

ORACLES = {
    "expectation_violations": """WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS key, * FROM lineitem),
        v AS (SELECT 'unique(key)' AS rule, key, count(*) AS n FROM l GROUP BY key HAVING count(*) > 1
          UNION ALL SELECT 'syntax(gene)', key, count(*) FROM l WHERE l_discount = 0 GROUP BY key
          UNION ALL SELECT 'enum(l_returnflag)', key, count(*) FROM l WHERE l_returnflag NOT IN ('A', 'N') GROUP BY key
          UNION ALL SELECT 'non_empty(note)', key, count(*) FROM l WHERE l_tax = 0 GROUP BY key
          UNION ALL SELECT 'range(score)', key, count(*) FROM l WHERE l_discount > 0.08::DOUBLE GROUP BY key
          UNION ALL SELECT 'count(count)', key, count(*) FROM l WHERE l_quantity / 2 <> floor(l_quantity / 2) GROUP BY key
          UNION ALL SELECT 'coordinates(chrom,start,end)', key, count(*) FROM l WHERE l_suppkey < l_partkey GROUP BY key)
        SELECT rule, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM v GROUP BY rule""",
    "ranking_invariants": with_views("ranked", """WITH r AS (SELECT case_id, count(*) AS n, count(DISTINCT rnk) AS d, min(rnk) AS lo, max(rnk) AS hi FROM ranked GROUP BY 1)
        SELECT 'ranks_complete' AS rule, count(*) AS n_bad FROM r WHERE NOT (lo = 1 AND hi = n AND d = n)
        UNION ALL SELECT 'rows', count(*) FROM (SELECT case_id, gene_id FROM ranked GROUP BY 1, 2 HAVING count(*) > 1)
        UNION ALL SELECT 'candidates_preserved', count(*) FROM (SELECT case_id, gene_id FROM candidates EXCEPT SELECT case_id, gene_id FROM ranked)"""),
    "groups_present": """SELECT g AS c_mktsegment, count(c_custkey) AS n, count(c_custkey) = 0 AS missing
        FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'ABSENT']) AS g) LEFT JOIN customer ON c_mktsegment = g GROUP BY g""",
}
