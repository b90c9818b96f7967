"""Covariance linear response, baselines and per-group response over long sparse expression.

The response needs only the covariance columns of the perturbed genes (delta = cov x u with a
sparse u), so no gene x gene matrix is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scale import paired, top_k
from .cells import expression_by_group, group_gene_means, group_sizes, hvg


def fit_space(moments: DataFrame, k: int | None = None, reg: float = 0.1) -> DataFrame:
    """Gene space of the response: the k most variable genes with their ridge term.

    ridge = reg * mean variance of the space, added to the covariance diagonal.
    """
    space = hvg(moments, k) if k else moments
    return space.withColumn("ridge", F.lit(float(reg)) * space.agg(F.avg("variance")).scalar())


def covariance_columns(expr: DataFrame, space: DataFrame, targets: DataFrame, value: str = "value", genes: DataFrame | None = None) -> DataFrame:
    """Sample covariance (ddof 1, ridge on the diagonal) of every space gene, or of those among ``genes``, with each target gene.

    Each cell carries its few target values as one short list, so the expansion per cell is
    non-zeros x targets and is summed map-side; gene pairs that never co-occur follow from the means.
    """
    wanted = targets.select("gene_id").distinct()
    listed = wanted.join(space.select("gene_id", "mean"), "gene_id").select(F.col("gene_id").alias("target_id"), F.col("mean").alias("_tm"))
    inside = expr.join(space.select("gene_id"), "gene_id", "left_semi").select("cell_id", "gene_id", F.col(value).alias("_x"))
    per_cell = inside.join(wanted, "gene_id", "left_semi").groupBy("cell_id").agg(
        F.collect_list(F.struct(F.col("gene_id").alias("target_id"), F.col("_x").alias("_y"))).alias("_t"))
    asked = space if genes is None else space.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    rows = inside if genes is None else inside.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    products = (rows.join(per_cell, "cell_id").select("gene_id", "_x", F.inline("_t"))
                .groupBy("gene_id", "target_id").agg(F.sum(F.col("_x") * F.col("_y")).alias("_xy")))
    grid = paired(asked.select("gene_id", "n_cells", "mean", "ridge"), listed, ["target_id"])
    joined = grid.join(products, ["gene_id", "target_id"], "left")
    n = F.col("n_cells")
    cov = (F.coalesce("_xy", F.lit(0.0)) - n * F.col("mean") * F.col("_tm")) / F.greatest(n - 1, F.lit(1))
    diagonal = F.when(F.col("gene_id") == F.col("target_id"), F.col("ridge")).otherwise(0.0)
    return joined.select("gene_id", "target_id", (cov + diagonal).alias("cov"))


def perturbation_shift(perturbations: DataFrame, space: DataFrame) -> DataFrame:
    """u = target - mean per (pert_id, gene_id); direction ko -> 0, oe -> twice the mean, or target_value."""
    joined = perturbations.join(space.select("gene_id", "mean"), "gene_id")
    by_direction = F.when(F.col("direction") == "oe", F.col("mean") * 2).when(F.col("direction") == "ko", 0.0)
    target = F.coalesce(F.col("target_value"), by_direction) if "target_value" in perturbations.columns else by_direction
    return joined.select("pert_id", "gene_id", "mean", target.alias("target"), (target - F.col("mean")).alias("u"))


def unknown_targets(perturbations: DataFrame, space: DataFrame) -> DataFrame:
    """Perturbed genes outside the fitted space; must be empty before predicting."""
    return perturbations.join(space.select("gene_id"), "gene_id", "left_anti")


def linear_response(covariance: DataFrame, shifts: DataFrame, space: DataFrame) -> DataFrame:
    """delta = sum over targets of cov * u, and perturbed = mean + delta, per (pert_id, gene_id)."""
    terms = covariance.join(shifts.select("pert_id", F.col("gene_id").alias("target_id"), "u"), "target_id")
    delta = terms.groupBy("pert_id", "gene_id").agg(F.sum(F.col("cov") * F.col("u")).alias("delta"))
    return delta.join(space.select("gene_id", "mean", "variance", "ridge"), "gene_id").withColumn(
        "perturbed", F.col("mean") + F.col("delta"))


def response_band(response: DataFrame, reg: float = 0.1) -> DataFrame:
    """95% band of the noise model: delta +- 1.96 * 0.1 * reg * sqrt(regularised variance)."""
    half = F.lit(1.96 * 0.1 * reg) * F.sqrt(F.col("variance") + F.col("ridge"))
    return response.withColumn("ci_low", F.col("delta") - half).withColumn("ci_high", F.col("delta") + half)


def response_summary(response: DataFrame, threshold: float = 0.001) -> DataFrame:
    return response.groupBy("pert_id").agg(
        F.max(F.abs("delta")).alias("delta_abs_max"), F.avg(F.abs("delta")).alias("delta_abs_mean"),
        F.count_if(F.col("delta") > threshold).alias("n_up"), F.count_if(F.col("delta") < -threshold).alias("n_down"))


def additive_baseline(response: DataFrame, shifts: DataFrame) -> DataFrame:
    """Only perturbed genes move (by u); the control-mean baseline moves nothing."""
    moved = shifts.groupBy("pert_id", "gene_id").agg(F.sum("u").alias("_u"))
    joined = response.join(moved, ["pert_id", "gene_id"], "left")
    return (joined.withColumn("is_target", F.col("_u").isNotNull())
            .withColumn("baseline_ctrl_mean", F.col("mean"))
            .withColumn("baseline_additive", F.col("mean") + F.coalesce("_u", F.lit(0.0))).drop("_u"))


def top_responses(response: DataFrame, k: int = 30) -> DataFrame:
    """The k genes of largest |delta| of every perturbation."""
    return top_k(response, ["pert_id"], [F.desc(F.abs("delta")), F.asc("gene_id")], k, "at")


def compare_with_baselines(response: DataFrame, shifts: DataFrame, k: int = 30) -> DataFrame:
    """Top responses beside the control-mean and additive baselines."""
    return additive_baseline(top_responses(response, k), shifts)


def group_response(response: DataFrame, expr: DataFrame, cells: DataFrame, space: DataFrame, group: str = "cell_type",
                   min_cells: int = 5, value: str = "value") -> DataFrame:
    """Cosine of each group's enrichment profile with |delta|, and its three top driver genes.

    Enrichment w = max(group mean - mean of group means, 0); a gene a group never expresses has w = 0,
    so only non-zero group means are joined.
    """
    inside = expr.join(space.select("gene_id"), "gene_id", "left_semi")
    sizes = group_sizes(cells, group, min_cells)
    n_groups = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    means = group_gene_means(inside, cells, group, min_cells, value)
    overall = means.groupBy("gene_id").agg((F.sum("mean") / n_groups).alias("_all"))
    weights = means.join(overall, "gene_id").select(
        group, "gene_id", F.greatest(F.col("mean") - F.col("_all"), F.lit(0.0)).alias("w"))
    sides = response.groupBy("pert_id").agg(F.sum(F.col("delta") * F.col("delta")).alias("_dd"))
    grid = paired(sides, sizes, [group])
    norms = weights.groupBy(group).agg(F.sum(F.col("w") * F.col("w")).alias("_ww"))
    # A perturbation's rows, at most one a gene, meet once; products with all groups are made, summed and ordered where they are.
    lists = weights.where("w > 0").groupBy("gene_id").agg(F.collect_list(F.struct(group, "w")).alias("_lists"))
    met = response.select("pert_id", "gene_id", F.abs("delta").alias("_d")).join(lists, "gene_id").repartition("pert_id")
    pairs = met.select("pert_id", "gene_id", "_d", F.inline("_lists")).select("pert_id", group, "gene_id", (F.col("w") * F.col("_d")).alias("_wd"))
    own = W.partitionBy("pert_id", group)
    best = pairs.withColumns({"_at": F.row_number().over(own.orderBy(F.desc("_wd"), F.asc("gene_id"))), "_sum": F.sum("_wd").over(own)}).where("_at <= 3")
    drivers = best.groupBy("pert_id", group).agg(F.max("_sum").alias("_wd"), F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "gene_id"))), lambda s: s["gene_id"]).alias("drivers"))
    joined = grid.join(norms, group, "left").join(drivers, ["pert_id", group], "left")
    nw, nd = F.sqrt(F.coalesce("_ww", F.lit(0.0))), F.sqrt("_dd")
    cosine = F.when((nw > 1e-9) & (nd > 1e-9), F.coalesce("_wd", F.lit(0.0)) / (nw * nd)).otherwise(0.0)
    return joined.select("pert_id", group, "n_cells", cosine.alias("response"), "drivers")


def target_group_mean(shifts: DataFrame, expr: DataFrame, cells: DataFrame, group: str = "cell_type",
                      min_cells: int = 5, value: str = "value") -> DataFrame:
    """Mean expression of every perturbed gene in every group."""
    genes = shifts.select("gene_id").distinct()
    table = expression_by_group(expr.join(genes, "gene_id", "left_semi"), cells, genes, group, min_cells, value)
    return shifts.select("pert_id", "gene_id").join(table.select("gene_id", group, F.col("mean").alias("target_expr")), "gene_id")


def top_expressed(expr: DataFrame, cells: DataFrame, space: DataFrame, k: int = 500, group: str = "cell_type", min_cells: int = 5,
                  value: str = "value") -> DataFrame:
    """The k genes of highest mean in every group: group, gene_id, n_cells."""
    inside = expr.join(space.select("gene_id"), "gene_id", "left_semi")
    table = expression_by_group(inside, cells, space, group, min_cells, value)
    return top_k(table, [group], [F.desc("mean"), F.asc("gene_id")], k, "_at").select(group, "gene_id", "n_cells")


def group_response_top_expressed(response: DataFrame, top: DataFrame, group: str = "cell_type") -> DataFrame:
    """Older variant: mean |delta| over the group's ``top_expressed`` genes. Of the response only the rows of these genes are read."""
    return top.join(response.select("pert_id", "gene_id", "delta"), "gene_id").groupBy("pert_id", group, "n_cells").agg(
        F.avg(F.abs("delta")).alias("response"))
