"""Single-cell queries: customers are cells, suppliers are genes, summed quantities are counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..operators import cells as op
from . import bindings as b
from .bindings import with_views


def expression(spark, folder):
    """Log-normalised long matrix."""
    counts, cells = b.counts(spark, folder), b.cells(spark, folder)
    return op.lognorm(counts, op.library_size(counts, cells))


def cell_qc(spark, folder):
    metrics = op.cell_metrics(b.counts(spark, folder), b.cell_genes(spark, folder), b.cells(spark, folder))
    return op.cell_qc(metrics, 30, 5.0).select("cell_id", "n_genes", "total_counts", fixed("mito_pct").alias("mito_pct"), "keep")


def library_size(spark, folder):
    priced = b.cells(spark, folder).join(
        b.table(spark, folder, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal")), "cell_id")
    done = op.library_size(b.counts(spark, folder), priced, "c_acctbal")
    return done.select("cell_id", fixed("library").alias("library"), "library_status")


def lognorm(spark, folder):
    return expression(spark, folder).select("cell_id", "gene_id", fixed("value").alias("value"))


def gene_moments(spark, folder):
    done = op.gene_moments(expression(spark, folder), b.cells(spark, folder), b.cell_genes(spark, folder))
    return done.select("gene_id", "n_cells", fixed("mean").alias("mean"), fixed("variance").alias("variance"))


def gene_max(spark, folder):
    return op.gene_max(b.counts(spark, folder), b.cell_genes(spark, folder), "count")


def hvg_topk(spark, folder):
    done = op.gene_moments(expression(spark, folder), b.cells(spark, folder), b.cell_genes(spark, folder))
    return op.hvg(done, 25).select("gene_id", fixed("variance").alias("variance"))


def downsample_cells(spark, folder):
    return op.downsample_cells(b.cells(spark, folder), 40, 7).select("cell_id", "sample_id")


def _qc(spark, folder):
    """Genes asked for include parts that no supplier row covers, so some are not found."""
    wanted = b.table(spark, folder, "part").select(F.col("p_partkey").alias("gene_id"))
    return op.interval_gene_qc(b.counts(spark, folder), b.cells(spark, folder), wanted, b.cell_genes(spark, folder))


QC_COLUMNS = ("mean_counts_patient", "mean_counts_ref", "pct_expr_patient", "pct_expr_ref", "log2fc_patient_vs_ref")


def interval_expression_qc(spark, folder):
    return _qc(spark, folder).select("gene_id", "found", *[fixed(c).alias(c) for c in QC_COLUMNS])


def low_expression_flag(spark, folder):
    done = op.low_expression_flag(_qc(spark, folder), 0.32)
    return done.select("gene_id", F.coalesce("low_expression", F.lit(False)).alias("low_expression"))


def compensation_class(spark, folder):
    counts, cells = b.counts(spark, folder), b.cells(spark, folder)
    wanted = b.cell_genes(spark, folder).select("gene_id")
    libraries = op.library_size(counts, cells)
    usable = op.keep_cells(cells, libraries.where("library_status = 'ok'"))
    return op.compensation(counts, usable, libraries, wanted)


def expression_by_group(spark, folder):
    done = op.expression_by_group(b.counts(spark, folder), b.cells(spark, folder), b.cell_genes(spark, folder), value="count")
    return done.select("gene_id", "cell_type", "n_cells", fixed("mean").alias("mean"), fixed("pct_expressing").alias("pct_expressing"))


def group_gene_means(spark, folder):
    done = op.group_gene_means(b.counts(spark, folder), b.cells(spark, folder), value="count")
    return done.select("cell_type", "gene_id", "n_cells", fixed("mean").alias("mean"))


def expression_lookup(spark, folder):
    keys = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_custkey").alias("gene_id"))
    return op.expression_lookup(keys, b.counts(spark, folder), b.cell_genes(spark, folder), "count")


def metadata_alignment(spark, folder):
    cells = b.counts(spark, folder).select("cell_id").distinct()
    customer = b.table(spark, folder, "customer")
    labels = customer.where("c_acctbal > 0").unionByName(customer.where("c_acctbal > 9500")).select(F.col("c_custkey").alias("cell_id"))
    return op.align_metadata(cells, labels)


def gene_space_overlap(spark, folder):
    space = b.table(spark, folder, "part").where("p_size > 5").select(F.col("p_partkey").alias("gene_id"))
    return op.gene_space_overlap(b.cell_genes(spark, folder), space, 50)


def aligned_gene_space(spark, folder):
    space = b.table(spark, folder, "part").where("p_size > 25").select(F.col("p_partkey").alias("gene_id"))
    aligned = op.align_gene_space(b.counts(spark, folder), b.cell_genes(spark, folder), space)
    return aligned.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


def disease_labels(spark, folder):
    text = F.when(F.col("c_mktsegment") == "BUILDING", "Multiple Sclerosis").when(
        F.col("c_mktsegment") == "MACHINERY", "Healthy Control").otherwise(F.col("c_mktsegment"))
    return (b.table(spark, folder, "customer").select(op.disease_label(text).alias("label"))
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def condition_text():
    nation = F.col("c_nationkey")
    name = F.concat(F.lit("G"), nation.cast("string"))
    return (F.when(nation % 4 == 0, "ctrl").when(nation % 4 == 1, F.concat(name, F.lit("+ctrl")))
            .when(nation % 4 == 2, F.concat(F.lit("ctrl+"), name)).otherwise(F.concat(name, F.lit("+G1"))))


def perturbed_genes(spark, folder):
    return (b.table(spark, folder, "customer").select(condition_text().alias("condition"))
            .withColumn("perturbed", op.perturbed_gene("condition")).groupBy("condition", "perturbed")
            .agg(F.count(F.lit(1)).alias("n_cells")))


QUERIES = {f.__name__: f for f in (
    cell_qc, library_size, lognorm, gene_moments, gene_max, hvg_topk, downsample_cells, interval_expression_qc,
    low_expression_flag, compensation_class, expression_by_group, group_gene_means, expression_lookup, metadata_alignment,
    gene_space_overlap, aligned_gene_space, disease_labels, perturbed_genes)}

MOMENTS = """mom AS (SELECT g.gene_id, c.n AS n_cells, coalesce(sum(x), 0) / c.n AS mean,
    greatest(coalesce(sum(x * x), 0) / c.n - (coalesce(sum(x), 0) / c.n) * (coalesce(sum(x), 0) / c.n), 0) * c.n / (c.n - 1) AS variance
    FROM cell_genes g LEFT JOIN expr USING (gene_id), (SELECT count(*) AS n FROM cells) c GROUP BY g.gene_id, c.n)"""

QC = """sz AS (SELECT count(*) FILTER (grp = 'patient') AS np, count(*) FILTER (grp = 'reference') AS nr FROM cells),
  sums AS (SELECT gene_id, sum(n) FILTER (grp = 'patient') AS sp, sum(n) FILTER (grp = 'reference') AS sr,
    count(*) FILTER (grp = 'patient' AND n > 0) AS dp, count(*) FILTER (grp = 'reference' AND n > 0) AS dr FROM counts JOIN cells USING (cell_id) GROUP BY 1),
  qc AS (SELECT p_partkey AS gene_id, g.gene_id IS NOT NULL AS found, CASE WHEN g.gene_id IS NOT NULL THEN coalesce(sp, 0) / np END AS mp,
    CASE WHEN g.gene_id IS NOT NULL THEN coalesce(sr, 0) / nr END AS mr, CASE WHEN g.gene_id IS NOT NULL THEN coalesce(dp, 0) / np END AS pp,
    CASE WHEN g.gene_id IS NOT NULL THEN coalesce(dr, 0) / nr END AS pr FROM part LEFT JOIN cell_genes g ON g.gene_id = p_partkey
    LEFT JOIN sums s ON s.gene_id = p_partkey, sz)"""

ORACLES = {
    "cell_qc": with_views("counts cells cell_genes", """WITH m AS (SELECT c.cell_id, count(n) FILTER (n > 0) AS n_genes, coalesce(sum(n), 0) AS total_counts,
          coalesce(sum(n) FILTER (symbol LIKE 'MT-%'), 0) AS mt FROM cells c LEFT JOIN counts USING (cell_id) LEFT JOIN cell_genes USING (gene_id) GROUP BY 1)
        SELECT cell_id, n_genes, total_counts, CASE WHEN total_counts > 0 THEN round(mt / total_counts * 100, 6) END AS mito_pct,
          coalesce(n_genes >= 30 AND mt / nullif(total_counts, 0) * 100 < 5, false) AS keep FROM m"""),
    "library_size": with_views("counts cells", """WITH s AS (SELECT cell_id, coalesce(sum(n), 0) AS rs FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1)
        SELECT cell_id, round(c_acctbal, 6) AS library, CASE WHEN c_acctbal <= 0 THEN 'zero_library' WHEN c_acctbal + 1e-6 < rs THEN 'smaller_than_row_sum'
          ELSE 'ok' END AS library_status FROM s JOIN customer ON c_custkey = cell_id"""),
    "lognorm": with_views("expr", "SELECT cell_id, gene_id, round(x, 6) AS value FROM expr"),
    "gene_moments": with_views("expr cells cell_genes", f"WITH {MOMENTS} SELECT gene_id, n_cells, round(mean, 6) AS mean, round(variance, 6) AS variance FROM mom"),
    "gene_max": with_views("counts cell_genes", """SELECT g.gene_id, coalesce(max(n), 0) AS max_value FROM cell_genes g LEFT JOIN counts USING (gene_id) GROUP BY 1"""),
    "hvg_topk": with_views("expr cells cell_genes", f"WITH {MOMENTS} SELECT gene_id, round(variance, 6) AS variance FROM mom ORDER BY mom.variance DESC, gene_id LIMIT 25"),
    "downsample_cells": with_views("cells", """SELECT cell_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id
        ORDER BY md5(cell_id || ':7'), cell_id) AS k FROM cells) WHERE k <= 40"""),
    "interval_expression_qc": with_views("counts cells cell_genes", f"""WITH {QC} SELECT gene_id, found, round(mp, 6) AS mean_counts_patient,
        round(mr, 6) AS mean_counts_ref, round(pp, 6) AS pct_expr_patient, round(pr, 6) AS pct_expr_ref,
        round(log2((mp + 0.5) / (mr + 0.5)), 6) AS log2fc_patient_vs_ref FROM qc"""),
    "low_expression_flag": with_views("counts cells cell_genes", f"WITH {QC} SELECT gene_id, coalesce(found AND pp < 0.32, false) AS low_expression FROM qc"),
    "compensation_class": with_views("expr cells cell_genes", """WITH ok AS (SELECT * FROM cells WHERE cell_id IN (SELECT cell_id FROM libs WHERE lib > 0)),
        sz AS (SELECT count(*) FILTER (grp = 'patient') AS np, count(*) FILTER (grp = 'reference') AS nr FROM ok),
        s AS (SELECT gene_id, sum(n / lib * 10000) FILTER (grp = 'patient') AS sp, sum(n / lib * 10000) FILTER (grp = 'reference') AS sr,
          count(*) FILTER (grp = 'patient' AND n > 0) AS dp, count(*) FILTER (grp = 'reference' AND n > 0) AS dr FROM expr JOIN ok USING (cell_id) GROUP BY 1),
        m AS (SELECT g.gene_id, coalesce(sp, 0) / np AS mp, coalesce(sr, 0) / nr AS mr, coalesce(dp, 0) / np AS pp, coalesce(dr, 0) / nr AS pr, np, nr,
          (coalesce(sp, 0) / np) / nullif(coalesce(sr, 0) / nr, 0) AS ratio FROM cell_genes g LEFT JOIN s USING (gene_id), sz)
        SELECT gene_id, round_even(ratio, 4) AS compensation_ratio, CASE WHEN (pp < 0.01 AND pr < 0.01) OR ratio IS NULL THEN 'unreliable'
            WHEN ratio BETWEEN 0.95 AND 1.05 THEN 'full' WHEN ratio BETWEEN 0.85 AND 0.95 THEN 'partial_high' WHEN ratio BETWEEN 0.7 AND 0.85 THEN 'partial_low'
            WHEN ratio BETWEEN 0.4 AND 0.7 THEN 'uncompensated' WHEN ratio > 1.05 THEN 'overcompensated' ELSE 'strongly_down' END AS compensation_class,
          round_even(mp, 4) AS mean_patient, round_even(mr, 4) AS mean_reference, round_even(pp, 4) AS pct_patient, round_even(pr, 4) AS pct_reference,
          np AS n_patient, nr AS n_reference FROM m"""),
    "expression_by_group": with_views("counts cells cell_genes", """WITH sz AS (SELECT cell_type, count(*) AS n_cells FROM cells GROUP BY 1 HAVING count(*) >= 5),
        s AS (SELECT gene_id, cell_type, sum(n) AS s, count(*) FILTER (n > 0) AS p FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2)
        SELECT gene_id, cell_type, n_cells, round(coalesce(s, 0) / n_cells, 6) AS mean, round(coalesce(p, 0) / n_cells * 100, 6) AS pct_expressing
        FROM (SELECT gene_id, cell_type, n_cells FROM cell_genes, sz) LEFT JOIN s USING (gene_id, cell_type)"""),
    "group_gene_means": with_views("counts cells", """WITH sz AS (SELECT cell_type, count(*) AS n_cells FROM cells GROUP BY 1 HAVING count(*) >= 5)
        SELECT cell_type, gene_id, n_cells, round(sum(n) / n_cells, 6) AS mean FROM counts JOIN cells USING (cell_id) JOIN sz USING (cell_type) GROUP BY 1, 2, 3"""),
    "expression_lookup": with_views("counts cell_genes", """SELECT c_custkey AS cell_id, c_custkey AS gene_id, g.gene_id IS NOT NULL AS known_gene,
        CASE WHEN g.gene_id IS NOT NULL THEN coalesce(n, 0) END AS value FROM customer LEFT JOIN cell_genes g ON g.gene_id = c_custkey
        LEFT JOIN counts x ON x.cell_id = c_custkey AND x.gene_id = c_custkey"""),
    "metadata_alignment": """WITH a AS (SELECT DISTINCT o_custkey AS cell_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        l AS (SELECT c_custkey AS cell_id, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0 UNION ALL SELECT * FROM customer WHERE c_acctbal > 9500) GROUP BY 1)
        SELECT coalesce(a.cell_id, l.cell_id) AS cell_id, CASE WHEN n IS NULL THEN 'missing_label' WHEN a.cell_id IS NULL THEN 'extra_label'
          WHEN n > 1 THEN 'duplicate' ELSE 'matched' END AS status FROM a FULL JOIN l ON a.cell_id = l.cell_id""",
    "gene_space_overlap": with_views("cell_genes", """WITH s AS (SELECT p_partkey AS gene_id FROM part WHERE p_size > 5)
        SELECT (SELECT count(*) FROM cell_genes) AS n_matrix, (SELECT count(*) FROM s) AS n_space,
          (SELECT count(*) FROM cell_genes WHERE gene_id IN (SELECT gene_id FROM s)) AS n_shared,
          (SELECT count(*) FROM cell_genes WHERE gene_id IN (SELECT gene_id FROM s)) >= 50 AS enough"""),
    "aligned_gene_space": with_views("counts", """SELECT gene_id, count(*) AS n, sum(n) AS total FROM counts
        WHERE gene_id IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1"""),
    "disease_labels": """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'MS' WHEN 'MACHINERY' THEN 'normal' ELSE c_mktsegment END AS label,
        count(*) AS n FROM customer GROUP BY 1""",
    "perturbed_genes": """WITH c AS (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'ctrl' WHEN 1 THEN 'G' || c_nationkey || '+ctrl'
          WHEN 2 THEN 'ctrl+G' || c_nationkey ELSE 'G' || c_nationkey || '+G1' END AS condition,
          CASE WHEN c_nationkey % 4 IN (1, 2) THEN 'G' || c_nationkey END AS perturbed FROM customer)
        SELECT condition, perturbed, count(*) AS n_cells FROM c GROUP BY ALL""",
}
