"""The user-level runs: screen cases, derive intervals from expression, predict a perturbation.

Each run is a chain of lazy operators over whole cohorts; results reused by several later steps
are checkpointed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import MODULE_BP, MODULE_BUDGET_BP, SCREENING, Consensus
from .functions.columns import blank_to_null
from .operators import cells as cell_op
from .operators import cnv as cnv_op
from .operators import evidence as ev
from .operators import response as response_op
from .operators import tuning
from .operators.consensus import borda, consensus_score, evidence_gate, rank_agreement, score_order, sparse_evidence_warnings
from .operators.design import transcript_design
from .operators.expectations import check, one_of, unique
from .operators.identity import alias_key, build_alias_map, resolve_gene_ids
from .operators.intervals import genes_in_intervals
from .operators.selection import budget_select
from .scale import GROUP_ROWS, checkpoint, dealt, null_safe_join, position

BUILD = "GRCh38"
# Candidate rows of one task of a screening run, which sorts them some ten times.
SCREEN_ROWS = 100_000


def build_candidates(annotation: DataFrame, nomenclature: DataFrame, *, intervals: DataFrame | None = None,
                     labels: DataFrame | None = None, bin_width: int = 1 << 20) -> DataFrame:
    """Candidate genes of every case, from intervals (case_id, chrom, start, end) or labels (case_id, label).

    Unresolved, ambiguous or repeated identities raise with the first offending keys.
    """
    if (intervals is None) == (labels is None):
        raise ValueError("provide exactly one of intervals or labels")
    approved = nomenclature.where(F.col("status") == "Approved").select(
        "hgnc_id", "symbol", blank_to_null("ensembl_gene_id").alias("gene_id"))
    check(approved, [unique("hgnc_id"), unique("symbol")], "hgnc_id")
    check(annotation, [unique("gene_id")], "gene_id")
    if intervals is not None:
        found = genes_in_intervals(annotation, intervals, bin_width).withColumn("input_symbol", F.col("gene_name"))
        found = found.withColumn("input_type", F.lit("interval")).join(approved, "gene_id", "left")
        status = F.when(F.col("hgnc_id").isNull(), "unresolved_identity").otherwise("ok")
        found = found.withColumn("status", status)
    else:
        resolved = resolve_gene_ids(labels, nomenclature, build_alias_map(nomenclature), annotation)
        found = resolved.withColumnRenamed("label", "input_symbol").join(approved.drop("gene_id"), "hgnc_id", "left")
        found = found.withColumns({"interval_overlap": F.lit("not_provided"), "input_type": F.lit("gene_list")})
    found = checkpoint(found)
    # One Ensembl id on several approved records stops only the cases that select it.
    shared = approved.where("gene_id IS NOT NULL").groupBy("gene_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    doubled = found.select("gene_id").distinct().join(shared, "gene_id").orderBy("gene_id").limit(10).collect()
    if doubled:
        raise ValueError(f"gene_id on several approved records: {[r['gene_id'] for r in doubled]}")
    bad = found.where("status <> 'ok'").orderBy("case_id", "input_symbol").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['case_id']}/{r['input_symbol']}: {r['status']}" for r in bad))
    return found.drop("status").withColumn("genome_build", F.lit(BUILD))


def collect_evidence(candidates: DataFrame, nomenclature: DataFrame, curation: DataFrame, constraint: DataFrame,
                     tissues: DataFrame | None = None, viability: DataFrame | None = None,
                     associations: DataFrame | None = None, disease_id: str = "", phenotype_ids: Sequence[str] = ()) -> DataFrame:
    """Left-join every evidence and annotation source; annotations never change scores."""
    lookup = build_alias_map(nomenclature).select(F.col("alias").alias("_alias"), "hgnc_id")
    codes = (curation.withColumn("_alias", alias_key(F.col("gene symbol"))).join(lookup, "_alias")
             .select("hgnc_id", F.col("haploinsufficiency score").alias("_hi"), F.col("triplosensitivity score").alias("_ts")).distinct())
    codes = ev.curation_codes(ev.curation_codes(codes, "_hi", "_h"), "_ts", "_t").select(
        "hgnc_id", F.col("_h_score").alias("clinGen_hi_score"), F.col("_h_raw").alias("clinGen_haploinsufficiency_raw"),
        F.col("_h_status").alias("clinGen_haploinsufficiency_status"), F.col("_t_score").alias("clinGen_triplo_score"),
        F.col("_t_raw").alias("clinGen_triplosensitivity_raw"), F.col("_t_status").alias("clinGen_triplosensitivity_status"))
    known = [*ev.DOSAGE_LABELS.values()]
    check(codes, [unique("hgnc_id"), one_of("clinGen_haploinsufficiency_status", known),
                  one_of("clinGen_triplosensitivity_status", known)], "hgnc_id")
    df = ev.join_evidence(candidates, codes, "hgnc_id")
    for name in ("clinGen_haploinsufficiency_status", "clinGen_triplosensitivity_status"):
        df = df.withColumn(name, F.coalesce(name, F.lit("not_curated")))
    df = ev.join_constraint(df, constraint)
    if tissues is not None:
        by_gene = tissues.select(F.col("gene").alias("gene_id"), "tissue", "ntpm")
        df = df.join(ev.tissue_map(by_gene).withColumnRenamed("tissue_ntpm", "hpa_tissue_ntpm"), "gene_id", "left")
    if viability is not None:
        df = ev.viability_annotation(df, viability)
    else:
        df = df.withColumn("impc_viability", F.lit("not_supplied"))
    if associations is not None:
        df = ev.association_annotation(df, associations, disease_id, phenotype_ids)
    return df


@dataclass(frozen=True)
class ScreenRun:
    """A screened cohort. Cases that fail the missing-rate gate are in ``gate`` (rejected) and nowhere else.

    ``tuning`` and ``missing_controls`` are None without controls, ``sensitivity`` and ``robustness`` where they were not asked for.
    """
    gate: DataFrame
    ranked: DataFrame
    selected: DataFrame
    agreement: DataFrame
    warnings: DataFrame
    tuning: DataFrame | None = None
    missing_controls: DataFrame | None = None
    sensitivity: DataFrame | None = None
    robustness: DataFrame | None = None


def screen_cohort(candidates: DataFrame, features: DataFrame, evidence: DataFrame, cfg: Consensus = SCREENING, capacity: int = MODULE_BUDGET_BP,
                  module_size: int = MODULE_BP, controls: DataFrame | None = None, tune: bool = True, sensitivity: bool = False) -> ScreenRun:
    """Gate, weights tuned on the controls, consensus and Borda ranks, budget selection, sensitivity and warnings of every case.

    ``controls``: case_id, symbol. Weights are tuned for each case on its own controls; a case with fewer than three present ones keeps
    the default weights. Sensitivity moves the weights in use. Whether a case is too large for one task is measured once.
    """
    by = ["case_id"]
    sizes = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    split = (sizes["most"] or 0) > GROUP_ROWS

    def spread(df: DataFrame) -> DataFrame:
        """Cases over tasks by the number of rows; a case too large for one task is spread by its operators."""
        return df if split else dealt(df, sizes["rows"] or 0, by, SCREEN_ROWS)

    repeated = evidence.where("hgnc_id IS NOT NULL").groupBy(*by, "hgnc_id").count().where("count > 1").orderBy(*by, "hgnc_id").limit(10).collect()
    if repeated:
        raise ValueError(f"duplicate identity in a case: {[(r['case_id'], r['hgnc_id']) for r in repeated]}")
    gate = checkpoint(evidence_gate(consensus_score(spread(evidence), cfg, by, split), cfg, by))
    usable = checkpoint(spread(null_safe_join(evidence, gate.where("not rejected").select(*by, F.lit(True).alias("_passed")), by).where("_passed").drop("_passed")))
    tuned = chosen = absent = None
    if controls is not None:
        cases = usable.select(*by).distinct()
        # All symbols are ranked once; a case keeps the ranks of its own controls.
        ranks = tuning.control_ranks(usable, controls.select("symbol"), cfg, by, split)
        asked = controls.select(*by, F.upper(F.trim("symbol")).alias("control")).distinct()
        ranks = checkpoint(ranks.join(asked, [*by, "control"], "left_semi"))
        absent = tuning.missing_controls(ranks, cases, controls, by)
        if tune:
            tuned = checkpoint(tuning.loo_tune(ranks, cfg.tuning.top_n, by, cases))
            chosen = tuning.decode_weights(tuned.where("final_grid_id IS NOT NULL"), cfg).select(*by, "weights")
    # The weights join by case, NULL included, which may deal the rows anew.
    ranked = position(spread(consensus_score(usable, cfg, by, split, chosen)), by, score_order(), "rank", split)
    ranked = checkpoint(borda(ranked, cfg, by, split))
    design = transcript_design(features, candidates.select("gene_id").distinct())
    selected = budget_select(ranked.join(design, "gene_id", "left"), capacity, module_size, split=split)
    moved = checkpoint(tuning.weight_sensitivity(usable, cfg, by, split, chosen)) if sensitivity else None
    return ScreenRun(gate, ranked, selected, rank_agreement(ranked, "consensus_score", "borda_score", by, split), sparse_evidence_warnings(ranked, by), tuned, absent,
                     moved, tuning.robustness(moved, by) if sensitivity else None)


def screen(candidates: DataFrame, features: DataFrame, evidence: DataFrame, cfg: Consensus = SCREENING,
           capacity: int = MODULE_BUDGET_BP, module_size: int = MODULE_BP) -> DataFrame:
    """Rank every case with the default weights and select within its budget; see ``screen_cohort`` for the whole run."""
    return screen_cohort(candidates, features, evidence, cfg, capacity, module_size).selected


@dataclass(frozen=True)
class CopyNumberRun:
    windows: DataFrame
    segments: DataFrame
    origins: DataFrame
    candidates: DataFrame


# The two standard resolutions: the whole genome, and small deletions at the price of noise.
RESOLUTIONS = (cnv_op.Resolution("standard", 100, 10), cnv_op.Resolution("fine", 25, 5))


def copy_number(counts: DataFrame, cells: DataFrame, genes: DataFrame, annotation: DataFrame,
                resolutions: Sequence[cnv_op.Resolution] = RESOLUTIONS, by: Sequence[str] = (), min_genes: int = 200, max_mito_pct: float = 20.0, downsample: int | None = None,
                z_threshold: float = 1.5, min_windows: int = 3, max_segment_mb: float | None = 10,
                known: DataFrame | None = None, include_auto: bool = False, bin_width: int = 1 << 20) -> CopyNumberRun:
    """Counts to windowed signal, deletion segments and candidate genes, at every resolution and for each case.

    ``by`` names the case columns of ``cells``: each case is centred, scaled and segmented by itself.
    """
    by = list(by)
    metrics = cell_op.cell_metrics(counts, genes, cells)
    kept = cell_op.cell_qc(metrics, min_genes, max_mito_pct).where("keep")
    if downsample:
        kept = cell_op.downsample_cells(kept, downsample)
    kept = checkpoint(kept.select(*cells.columns))
    usable = cell_op.keep_cells(counts, kept)
    expr = checkpoint(cell_op.lognorm(usable, cell_op.library_size(usable, kept)).select("cell_id", "gene_id", "value"))
    placed = cnv_op.position_genes(genes, annotation).where("status = 'positioned'")
    placed = checkpoint(cnv_op.exclude_chromosomes(placed))
    extents = checkpoint(cnv_op.resolution_windows(placed, resolutions))
    missing = {r.name for r in resolutions} - {r["resolution"] for r in extents.select("resolution").distinct().collect()}
    if missing:
        raise ValueError(f"INSUFFICIENT_DATA: no chromosome has enough positioned genes for {sorted(missing)}")
    windows = checkpoint(cnv_op.smooth_group_signal(expr, kept, placed, resolutions, extents, by))
    found = cnv_op.deletion_segments(windows, z_threshold, min_windows, order=("win_idx",), by=[*by, "resolution"])
    segments = checkpoint(cnv_op.segment_size_cap(found, max_segment_mb).where("kept").drop("kept"))
    auto = segments.withColumn("deletion_id", F.concat_ws("_", F.lit("auto"), *[F.col(c).cast("string") for c in by], "resolution", "chrom", "start"))
    empty = auto.select("deletion_id", "chrom", "start", "end").limit(0)
    origins = cnv_op.candidate_origins(known if known is not None else empty, auto, annotation, include_auto, bin_width)
    return CopyNumberRun(windows, segments, origins, cnv_op.collapse_origins(origins.where("in_candidates")))


@dataclass(frozen=True)
class PerturbationRun:
    response: DataFrame
    top: DataFrame
    groups: DataFrame
    summary: DataFrame


def predict_perturbation(expr: DataFrame, cells: DataFrame, genes: DataFrame, perturbations: DataFrame, hvg: int | None = 5000,
                         reg: float = 0.1, group: str = "cell_type", top: int = 30) -> PerturbationRun:
    """Linear response, top genes with baselines, group response and summary of every perturbation.

    ``expr`` is log-normalised (cell_id, gene_id, value); ``perturbations``: pert_id, gene_id,
    direction (ko or oe) or target_value.
    """
    space = checkpoint(response_op.fit_space(cell_op.gene_moments(expr, cells, genes), hvg, reg))
    if (space.agg(F.max("n_cells").alias("n")).first()["n"] or 0) < 2:
        raise ValueError("covariance needs at least two cells")
    unknown = response_op.unknown_targets(perturbations, space).limit(10).collect()
    if unknown:
        raise ValueError(f"genes outside the fitted space: {sorted({str(r['gene_id']) for r in unknown})}")
    shifts = response_op.perturbation_shift(perturbations, space)
    covariance = response_op.covariance_columns(expr, space, perturbations.select("gene_id"))
    response = checkpoint(response_op.response_band(response_op.linear_response(covariance, shifts, space), reg))
    return PerturbationRun(response, response_op.compare_with_baselines(response, shifts, top),
                           response_op.group_response(response, expr, cells, space, group), response_op.response_summary(response))
