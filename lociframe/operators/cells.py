"""Quality control and group statistics of long sparse expression tables.

A matrix is a long table (cell_id, gene_id, value) without zeros; zeros enter through the number
of cells in the denominators. ``cells`` lists every cell, also those without counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column
from ..scale import paired, top_k

CELL = ("cell_id",)
PER = 10_000


# ---------------------------------------------------------------- cell level
def cell_metrics(counts: DataFrame, genes: DataFrame, cells: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Per cell: detected genes, total counts and mitochondrial percentage (symbol starts MT-)."""
    mito = genes.where(F.upper("symbol").startswith("MT-")).select("gene_id").withColumn("_mt", F.lit(True))
    stats = counts.join(mito, "gene_id", "left").groupBy(*by).agg(
        F.count_if(F.col("count") > 0).alias("n_genes"), F.sum("count").alias("total_counts"),
        F.sum(F.when(F.col("_mt"), F.col("count")).otherwise(0.0)).alias("_mito"))
    joined = cells.join(stats, list(by), "left")
    total = F.coalesce("total_counts", F.lit(0.0))
    return (joined.withColumn("n_genes", F.coalesce("n_genes", F.lit(0).cast("bigint"))).withColumn("total_counts", total)
            .withColumn("mito_pct", F.when(F.col("total_counts") > 0, F.col("_mito") / F.col("total_counts") * 100)).drop("_mito"))


def cell_qc(metrics: DataFrame, min_genes: int = 200, max_mito_pct: float = 20.0) -> DataFrame:
    """Flag ``keep``: enough detected genes and mitochondrial share strictly below the limit."""
    return metrics.withColumn("keep", F.coalesce(
        (F.col("n_genes") >= min_genes) & (F.col("mito_pct") < max_mito_pct), F.lit(False)))


def keep_cells(table: DataFrame, kept: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    return table.join(kept.select(*by), list(by), "left_semi")


def downsample_cells(cells: DataFrame, n: int, seed: int = 0, by: Sequence[str] = ("sample_id",),
                     key: Sequence[str] = CELL) -> DataFrame:
    """At most ``n`` cells per sample, chosen by a seeded hash: the same on every run and partitioning."""
    text = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    chosen = top_k(cells.withColumn("_hash", text), by, ["_hash", *key], n, "_at")
    return chosen.drop("_hash", "_at")


def library_size(counts: DataFrame, cells: DataFrame, supplied: str | None = None, by: Sequence[str] = CELL) -> DataFrame:
    """Total counts per cell, or the supplied full-gene size, with a status.

    Status: ok, zero_library, or smaller_than_row_sum for a supplied size below the matrix row sum.
    """
    sums = counts.groupBy(*by).agg(F.sum("count").alias("_sum"))
    joined = cells.join(sums, list(by), "left").withColumn("_sum", F.coalesce("_sum", F.lit(0.0)))
    size = F.col(supplied).cast("double") if supplied else F.col("_sum")
    status = (F.when(~F.coalesce(size > 0, F.lit(False)), "zero_library")
              .when(size + 1e-6 < F.col("_sum"), "smaller_than_row_sum").otherwise("ok"))
    return joined.withColumn("library", size).withColumn("library_status", status).drop("_sum")


def lognorm(counts: DataFrame, libraries: DataFrame, target: float = PER, by: Sequence[str] = CELL) -> DataFrame:
    """Add ``value`` = log1p(count / library * target); absent rows stay zero because log1p(0) = 0.

    Counts of a cell without a positive library stop the run with a named violation.
    """
    size = libraries.select(*by, "library")
    bad = F.raise_error(F.concat(F.lit("invalid_library: cell "), F.concat_ws("/", *[F.col(c).cast("string") for c in by]))).cast("double")
    joined = counts.join(size, list(by), "left").withColumn("library", F.when(F.col("library") > 0, F.col("library").cast("double")).otherwise(bad))
    return joined.withColumn("value", F.log1p(F.col("count") / F.col("library") * F.lit(float(target))))


# ---------------------------------------------------------------- gene level
def cell_count(cells: DataFrame) -> Column:
    """Number of cells as a scalar subquery."""
    return cells.agg(F.count(F.lit(1)).alias("n")).scalar()


def gene_moments(expr: DataFrame, cells: DataFrame, genes: DataFrame, value: str = "value") -> DataFrame:
    """Mean and sample variance of every gene over all cells, zeros implicit.

    variance = max(E[x^2] - E[x]^2, 0) * n / (n - 1).
    """
    n = cell_count(cells)
    sums = expr.groupBy("gene_id").agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    joined = genes.select("gene_id").join(sums, "gene_id", "left").withColumn("n_cells", n)
    mean = F.coalesce("_s", F.lit(0.0)) / F.col("n_cells")
    square = F.coalesce("_q", F.lit(0.0)) / F.col("n_cells")
    spread = F.greatest(square - mean * mean, F.lit(0.0)) * F.col("n_cells") / F.greatest(F.col("n_cells") - 1, F.lit(1))
    return joined.select("gene_id", "n_cells", mean.alias("mean"), spread.alias("variance"))


def gene_max(expr: DataFrame, genes: DataFrame, value: str = "value") -> DataFrame:
    """Largest value of every gene; a gene never seen has 0."""
    peak = expr.groupBy("gene_id").agg(F.max(value).alias("_m"))
    return genes.select("gene_id").join(peak, "gene_id", "left").select(
        "gene_id", F.greatest(F.coalesce("_m", F.lit(0.0)), F.lit(0.0)).alias("max_value"))


def hvg(moments: DataFrame, k: int) -> DataFrame:
    """The k genes of largest variance, ties by gene id."""
    return moments.orderBy(F.desc("variance"), F.asc("gene_id")).limit(k)


def group_sizes(cells: DataFrame, group: str, min_cells: int = 5) -> DataFrame:
    return cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)


def expression_by_group(expr: DataFrame, cells: DataFrame, genes: DataFrame, group: str = "cell_type",
                        min_cells: int = 5, value: str = "value") -> DataFrame:
    """Every gene in every group of at least ``min_cells`` cells: mean and percentage expressing.

    The result is the dense gene x group table: zero pairs come from a join in blocks of groups.
    """
    sizes = group_sizes(cells, group, min_cells)
    sums = expr.join(cells.select("cell_id", group), "cell_id").groupBy("gene_id", group).agg(
        F.sum(value).alias("_s"), F.count_if(F.col(value) > 0).alias("_p"))
    grid = paired(genes.select("gene_id"), sizes, [group])
    return grid.join(sums, ["gene_id", group], "left").select(
        "gene_id", group, "n_cells", (F.coalesce("_s", F.lit(0.0)) / F.col("n_cells")).alias("mean"),
        (F.coalesce("_p", F.lit(0)) / F.col("n_cells") * 100).alias("pct_expressing"))


def group_gene_means(expr: DataFrame, cells: DataFrame, group: str = "cell_type", min_cells: int = 5,
                     value: str = "value") -> DataFrame:
    """Non-zero group x gene means (a missing pair is 0), groups of at least ``min_cells`` cells."""
    sizes = group_sizes(cells, group, min_cells)
    sums = expr.join(cells.select("cell_id", group), "cell_id").groupBy(group, "gene_id").agg(F.sum(value).alias("_s"))
    return sums.join(sizes, group).select(group, "gene_id", "n_cells", (F.col("_s") / F.col("n_cells")).alias("mean"))


def _two_groups(counts: DataFrame, cells: DataFrame, patient: str, reference: str) -> tuple[DataFrame, Column, Column]:
    if patient == reference:
        raise ValueError("patient and reference must be different groups")
    def present(name: str) -> Column:
        n = F.count_if(F.col("group") == name)
        return F.when(n > 0, n).otherwise(F.raise_error(F.lit(f"empty_group: no cell of group {name}")).cast("bigint"))

    sizes = cells.agg(present(patient).alias("p"), present(reference).alias("r"))
    n_patient, n_reference = sizes.select("p").scalar(), sizes.select("r").scalar()
    grouped = counts.join(cells.select("cell_id", "group"), "cell_id").where(F.col("group").isin(patient, reference))
    return grouped, n_patient, n_reference


def interval_gene_qc(counts: DataFrame, cells: DataFrame, wanted: DataFrame, genes: DataFrame,
                     patient: str = "patient", reference: str = "reference") -> DataFrame:
    """Raw-count expression of wanted genes in patient and reference cells.

    A gene outside the matrix has found = false and NULL statistics; an unexpressed gene has zeros.
    """
    grouped, n_p, n_r = _two_groups(counts.join(wanted.select("gene_id"), "gene_id", "left_semi"), cells, patient, reference)
    is_p = F.col("group") == patient
    sums = grouped.groupBy("gene_id").agg(
        F.sum(F.when(is_p, F.col("count")).otherwise(0.0)).alias("_sp"),
        F.sum(F.when(is_p, 0.0).otherwise(F.col("count"))).alias("_sr"),
        F.count_if(is_p & (F.col("count") > 0)).alias("_dp"), F.count_if(~is_p & (F.col("count") > 0)).alias("_dr"))
    known = genes.select("gene_id").distinct().withColumn("_known", F.lit(True))
    joined = (wanted.join(known, "gene_id", "left").join(sums, "gene_id", "left")
              .withColumns({"_np": n_p, "_nr": n_r}).withColumn("found", F.coalesce("_known", F.lit(False))))
    stat = lambda top, below: F.when(F.col("found"), F.coalesce(top, F.lit(0)) / F.col(below))
    done = (joined.withColumn("mean_counts_patient", stat("_sp", "_np")).withColumn("mean_counts_ref", stat("_sr", "_nr"))
            .withColumn("pct_expr_patient", stat("_dp", "_np")).withColumn("pct_expr_ref", stat("_dr", "_nr")))
    return done.withColumn("log2fc_patient_vs_ref", F.log2(
        (F.col("mean_counts_patient") + 0.5) / (F.col("mean_counts_ref") + 0.5))).drop(
        "_known", "_sp", "_sr", "_dp", "_dr", "_np", "_nr")


def low_expression_flag(qc: DataFrame, limit: float = 0.05) -> DataFrame:
    """Found genes expressed in less than ``limit`` of the patient cells."""
    return qc.withColumn("low_expression", F.col("found") & (F.col("pct_expr_patient") < limit))


# Compensation classes, tested in this order with both ends included.
COMPENSATION_CLASSES = [("full", 0.95, 1.05), ("partial_high", 0.85, 0.95), ("partial_low", 0.70, 0.85),
                        ("uncompensated", 0.40, 0.70)]


def compensation(counts: DataFrame, cells: DataFrame, libraries: DataFrame, wanted: DataFrame, patient: str = "patient",
                 reference: str = "reference", min_detection: float = 0.01) -> DataFrame:
    """Patient to reference ratio of library-normalised counts per 10,000 and its class.

    The class is taken before rounding; rounding is half-even to four digits. A cell of either group whose library is missing,
    not positive or smaller than its row sum stops the run with a named violation; drop such cells first, from counts and cells.
    """
    bad = F.raise_error(F.concat(F.lit("invalid_library: cell "), F.col("cell_id").cast("string"), F.lit(" is "),
                                 F.coalesce("library_status", F.lit("missing")))).cast("string")
    sound = F.when(F.coalesce(F.col("library_status") == "ok", F.lit(False)) | ~F.col("group").isin(patient, reference), F.col("group")).otherwise(bad)
    usable = cells.join(libraries.select("cell_id", "library_status"), "cell_id", "left").withColumn("group", sound).drop("library_status")
    rated = (counts.join(wanted.select("gene_id"), "gene_id", "left_semi").join(libraries.select("cell_id", "library"), "cell_id")
             .withColumn("_v", F.col("count") / F.col("library") * PER))
    grouped, n_p, n_r = _two_groups(rated, usable, patient, reference)
    is_p = F.col("group") == patient
    sums = grouped.groupBy("gene_id").agg(
        F.sum(F.when(is_p, F.col("_v")).otherwise(0.0)).alias("_sp"), F.sum(F.when(is_p, 0.0).otherwise(F.col("_v"))).alias("_sr"),
        F.count_if(is_p & (F.col("_v") > 0)).alias("_dp"), F.count_if(~is_p & (F.col("_v") > 0)).alias("_dr"))
    df = wanted.join(sums, "gene_id", "left").withColumns({"n_patient": n_p, "n_reference": n_r})
    rate = lambda top, below: F.coalesce(F.col(top), F.lit(0)) / F.col(below)
    df = df.withColumns({"_mp": rate("_sp", "n_patient"), "_mr": rate("_sr", "n_reference"),
                         "_pp": rate("_dp", "n_patient"), "_pr": rate("_dr", "n_reference")})
    df = df.withColumn("_ratio", F.when(F.col("_mr") > 0, F.col("_mp") / F.col("_mr")))
    label = F.when((F.col("_pp") < min_detection) & (F.col("_pr") < min_detection) | F.col("_ratio").isNull(), "unreliable")
    for name, low, high in COMPENSATION_CLASSES:
        label = label.when(F.col("_ratio").between(low, high), name)
    label = label.when(F.col("_ratio") > 1.05, "overcompensated").otherwise("strongly_down")
    return df.select(
        *wanted.columns, F.bround("_ratio", 4).alias("compensation_ratio"), label.alias("compensation_class"),
        F.bround("_mp", 4).alias("mean_patient"), F.bround("_mr", 4).alias("mean_reference"),
        F.bround("_pp", 4).alias("pct_patient"), F.bround("_pr", 4).alias("pct_reference"), "n_patient", "n_reference")


# ---------------------------------------------------------------- lookups and alignment
def expression_lookup(keys: DataFrame, expr: DataFrame, genes: DataFrame, value: str = "value") -> DataFrame:
    """Values for (cell_id, gene_id) keys: absent pair = 0, unknown gene = NULL and known_gene false."""
    known = genes.select("gene_id").distinct().withColumn("_known", F.lit(True))
    found = keys.join(expr.select("cell_id", "gene_id", F.col(value).alias("_v")), ["cell_id", "gene_id"], "left")
    found = found.join(known, "gene_id", "left").withColumn("known_gene", F.coalesce("_known", F.lit(False)))
    return found.withColumn("value", F.when(F.col("known_gene"), F.coalesce("_v", F.lit(0.0)))).drop("_v", "_known")


def align_gene_space(expr: DataFrame, genes: DataFrame, space: DataFrame) -> DataFrame:
    """Project onto a fixed gene list; genes missing from the matrix are implicit zeros."""
    return expr.join(space.select("gene_id"), "gene_id", "left_semi")


def gene_space_overlap(genes: DataFrame, space: DataFrame, minimum: int = 500) -> DataFrame:
    """One row: genes of the matrix, of the space, shared, and whether enough are shared."""
    marked = genes.select("gene_id").distinct().withColumn("_a", F.lit(1)).join(
        space.select("gene_id").distinct().withColumn("_b", F.lit(1)), "gene_id", "full")
    return marked.agg(F.count("_a").alias("n_matrix"), F.count("_b").alias("n_space"),
                      F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_shared")).withColumn(
        "enough", F.col("n_shared") >= minimum)


def align_metadata(cells: DataFrame, labels: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells and labels matched one to one; status matched, missing_label, extra_label or duplicate."""
    a = cells.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    status = (F.when(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""), "blank_id")
              .when(F.col("_b").isNull(), "missing_label").when(F.col("_a").isNull(), "extra_label")
              .when((F.col("_a") > 1) | (F.col("_b") > 1), "duplicate").otherwise("matched"))
    return a.join(b, key, "full").select(key, status.alias("status"))


def disease_label(text: Column | str) -> Column:
    """Free text to MS / normal; other labels are kept."""
    lower = F.lower(column(text))
    return (F.when(lower.contains("sclerosis"), "MS").when(lower.contains("normal") | lower.contains("control"), "normal")
            .otherwise(column(text)))


def perturbed_gene(condition: Column | str) -> Column:
    """The single perturbed gene of ``A+ctrl`` / ``ctrl+A`` / ``A``; NULL for ctrl and combinations."""
    named = F.filter(F.split(column(condition), r"\+"), lambda x: x != "ctrl")
    return F.when(F.size(named) == 1, named[0])
