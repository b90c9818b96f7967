"""Identity queries over a nomenclature derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..operators import identity as op
from . import bindings as b


def _key():
    return F.col("p_partkey").cast("string")


def nomenclature(spark, folder):
    return b.table(spark, folder, "part").select(
        F.concat(F.lit("HGNC:"), _key()).alias("hgnc_id"), F.concat(F.lit(" S"), _key()).alias("symbol"),
        F.when(F.col("p_type") == "PROMO", "Withdrawn").otherwise("Approved").alias("status"),
        F.when(F.col("p_size") == 1, "").otherwise(F.concat(F.lit("ENSG"), _key())).alias("ensembl_gene_id"),
        F.concat(F.lit("OLD"), _key(), F.lit("; S"), (F.col("p_partkey") + 1).cast("string")).alias("prev_symbol"),
        F.concat(F.lit('"'), F.regexp_replace("p_name", " ", "|"), F.lit('"')).alias("alias_symbol"))


def alias_table(spark, folder):
    return op.build_alias_map(nomenclature(spark, folder))


def resolve_symbols(spark, folder):
    flag = F.col("l_returnflag")
    part = F.col("l_partkey").cast("string")
    label = (F.when(flag == "A", F.concat(F.lit("S"), part)).when(flag == "N", F.concat(F.lit(" old"), part, F.lit(" ")))
             .when(F.col("l_linestatus") == "F", F.lit("")).otherwise(F.concat(F.lit("UNKNOWN"), part)))
    labels = b.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("case_id"), label.alias("gene_symbol"))
    rated = op.unresolved_rate(op.resolve_symbols(labels, alias_table(spark, folder)))
    return rated.select("case_id", "n_genes", "n_unresolved", fixed("unresolved_rate").alias("unresolved_rate"), "failed")


def resolve_ids(spark, folder):
    part = b.table(spark, folder, "part")
    size = F.col("p_size") % 4
    label = (F.when(size == 0, F.concat(F.lit("ENSG"), _key(), F.lit(".3"))).when(size == 1, F.concat(F.lit("HGNC:"), _key()))
             .when(size == 2, F.concat(F.lit("S"), _key())).otherwise(F.concat(F.lit("OLD"), _key())))
    labels = part.select(F.col("p_brand").alias("case_id"), label.alias("label")).unionByName(
        part.where("p_size = 50").select(F.col("p_brand").alias("case_id"), F.concat(F.lit("s"), _key()).alias("label")))
    positions = part.where("p_size > 2").select(
        F.concat(F.lit("ENSG"), _key()).alias("gene_id"), F.col("p_brand").alias("chrom"),
        (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size") * 10).alias("end"))
    done = op.resolve_gene_ids(labels, nomenclature(spark, folder), alias_table(spark, folder), positions)
    return done.select("case_id", "label", "hgnc_id", "gene_id", "start", "status")


def _crosswalked(spark, folder):
    lines, part = b.table(spark, folder, "lineitem"), b.table(spark, folder, "part")
    key = F.col("l_partkey")
    symbol = (F.when(F.col("l_returnflag") == "A", F.concat(F.lit("S"), key.cast("string")))
              .when(F.col("l_returnflag") == "N", F.concat(F.lit("OLD"), key.cast("string")))
              .otherwise(F.concat(F.lit("S"), (key + 2).cast("string"))))
    shift = F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0), 0.001).otherwise(0.0)
    scores = lines.join(part, key == part.p_partkey).select(
        F.concat(F.lit("ENSG"), key.cast("string")).alias("ensembl"), symbol.alias("gene_symbol"),
        (F.col("p_size") / 60 + shift).alias("score"))
    return op.crosswalk_scores(scores, nomenclature(spark, folder), alias_table(spark, folder))


def score_crosswalk(spark, folder):
    done = op.collapse_scores(_crosswalked(spark, folder), "score")
    return done.select("hgnc_id", "n_records", "conflict", fixed("score").alias("score"))


def score_crosswalk_audit(spark, folder):
    return op.crosswalk_audit(_crosswalked(spark, folder))


def legacy_constraint(spark, folder):
    part = b.table(spark, folder, "part")
    old = part.select(F.concat(F.lit("old"), _key()).alias("gene_symbol"),
                      F.when(F.col("p_size") > 40, "NA").otherwise((F.col("p_size") / 50).cast("string")).alias("pli"),
                      F.lit("0.25").alias("oe_lof_upper"), (F.col("p_partkey") * 2).alias("source_line"))
    new = part.where("p_size % 2 = 0").select(
        F.concat(F.lit("S"), _key()).alias("gene_symbol"), F.lit("0.5").alias("pli"), F.lit("inf").alias("oe_lof_upper"),
        (F.col("p_partkey") * 2 + F.when(F.col("p_size") > 25, 1).otherwise(-1)).alias("source_line"))
    genes = b.genes(spark, folder).select("gene_id", "hgnc_id")
    done = op.legacy_constraint(genes, old.unionByName(new), alias_table(spark, folder))
    return done.select("gene_id", fixed("gnomad_pLI").alias("gnomad_pLI"), fixed("gnomad_LOEUF").alias("gnomad_LOEUF"))


QUERIES = {"alias_map": alias_table, "resolve_symbols": resolve_symbols, "resolve_ids": resolve_ids,
           "score_crosswalk": score_crosswalk, "score_crosswalk_audit": score_crosswalk_audit,
           "legacy_constraint": legacy_constraint}

ALIAS = """nomen AS (SELECT p_partkey AS k, 'HGNC:' || p_partkey AS hgnc_id, lower('S' || p_partkey) AS symbol,
    p_type <> 'PROMO' AS approved, CASE WHEN p_size > 1 THEN 'ENSG' || p_partkey END AS ensembl, p_name FROM part),
  words AS (SELECT hgnc_id, 'old' || k AS alias FROM nomen UNION ALL SELECT hgnc_id, 's' || (k + 1) FROM nomen
    UNION ALL SELECT hgnc_id, unnest(string_split(lower(p_name), ' ')) FROM nomen),
  approved AS (SELECT symbol AS alias, min(hgnc_id) AS hgnc_id FROM nomen GROUP BY 1 HAVING count(DISTINCT hgnc_id) = 1),
  amap AS (SELECT alias, hgnc_id, 'approved' AS kind FROM approved UNION ALL
    SELECT alias, min(hgnc_id), 'alias' FROM words WHERE alias NOT IN (SELECT symbol FROM nomen)
    GROUP BY alias HAVING count(DISTINCT hgnc_id) = 1)"""

MAPPED = f"""WITH {ALIAS}, rows AS (SELECT l_partkey AS k, CASE l_returnflag WHEN 'A' THEN 's' || l_partkey
      WHEN 'N' THEN 'old' || l_partkey ELSE 's' || (l_partkey + 2) END AS alias,
      p_size / 60 + CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN 0.001::DOUBLE ELSE 0 END AS score
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    mapped AS (SELECT r.*, n.hgnc_id AS eid, CASE WHEN n.hgnc_id IS NULL THEN 'not_in_crosswalk'
      WHEN a.hgnc_id <> n.hgnc_id THEN 'symbol_disagreement' ELSE 'mapped' END AS mapping_status
      FROM rows r LEFT JOIN nomen n ON n.ensembl = 'ENSG' || r.k LEFT JOIN amap a ON a.alias = r.alias)"""

ORACLES = {
    "alias_map": f"WITH {ALIAS} SELECT * FROM amap",
    "resolve_symbols": f"""WITH {ALIAS}, labels AS (SELECT l_suppkey AS case_id, CASE l_returnflag WHEN 'A' THEN 's' || l_partkey
          WHEN 'N' THEN 'old' || l_partkey ELSE CASE WHEN l_linestatus = 'F' THEN '' ELSE 'unknown' || l_partkey END END AS alias
          FROM lineitem),
        agg AS (SELECT case_id, count(*) AS n_genes, count(*) FILTER (hgnc_id IS NULL) AS n_unresolved
          FROM labels LEFT JOIN amap USING (alias) GROUP BY case_id)
        SELECT *, round(n_unresolved / n_genes, 6) AS unresolved_rate, n_unresolved / n_genes > 0.1 AS failed FROM agg""",
    "resolve_ids": f"""WITH {ALIAS}, labels AS (SELECT p_brand AS case_id, p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 'ENSG' || p_partkey || '.3'
            WHEN 1 THEN 'HGNC:' || p_partkey WHEN 2 THEN 'S' || p_partkey ELSE 'OLD' || p_partkey END AS label FROM part
          UNION ALL SELECT p_brand, p_partkey, 's' || p_partkey FROM part WHERE p_size = 50),
        ids AS (SELECT l.*, CASE WHEN label LIKE 'ENSG%' THEN e.hgnc_id WHEN label LIKE 'HGNC:%' THEN h.hgnc_id ELSE a.hgnc_id END AS hid
          FROM labels l LEFT JOIN nomen e ON e.approved AND e.ensembl = string_split(label, '.')[1]
          LEFT JOIN nomen h ON h.approved AND h.hgnc_id = label LEFT JOIN amap a ON a.alias = lower(label)),
        genes AS (SELECT i.case_id, i.label, n.hgnc_id, n.ensembl AS gene_id, p.p_partkey * 100 AS start
          FROM ids i LEFT JOIN nomen n ON n.approved AND n.hgnc_id = i.hid
          LEFT JOIN part p ON n.ensembl IS NOT NULL AND p.p_partkey = n.k AND p.p_size > 2)
        SELECT *, CASE WHEN gene_id IS NULL THEN 'unresolved_identity' WHEN start IS NULL THEN 'no_unique_position'
          WHEN count(*) OVER (PARTITION BY case_id, hgnc_id) > 1 THEN 'duplicate_identity' ELSE 'ok' END AS status FROM genes""",
    "score_crosswalk": MAPPED + """ SELECT eid AS hgnc_id, count(*) AS n_records, min(score) <> max(score) AS conflict,
        CASE WHEN min(score) = max(score) THEN round(min(score), 6) END AS score FROM mapped
        WHERE mapping_status = 'mapped' GROUP BY eid""",
    "score_crosswalk_audit": MAPPED + " SELECT mapping_status, count(*) AS n_records FROM mapped GROUP BY 1",
    "legacy_constraint": """WITH rows AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN NULL ELSE p_size / 50 END AS pli,
          0.25::DOUBLE AS loeuf, p_partkey * 2 AS line FROM part
        UNION ALL SELECT p_partkey, 0.5::DOUBLE, NULL, p_partkey * 2 + CASE WHEN p_size > 25 THEN 1 ELSE -1 END
          FROM part WHERE p_size % 2 = 0)
        SELECT k AS gene_id, round(arg_min_null(pli, line), 6) AS "gnomad_pLI", round(arg_min_null(loeuf, line), 6) AS "gnomad_LOEUF"
        FROM rows GROUP BY k""",
}
