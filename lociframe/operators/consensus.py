"""Normalise evidence inside each case, combine it into an explainable score and rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DOSAGE_COLUMNS, Consensus, Evidence, OrganPenalty
from ..functions.columns import correlation, finite
from ..scale import average_rank, descending_rank, null_safe_join, position, with_group_stats
from .evidence import SCORED_CODES, dosage_conflict, evidence_status

CASE = ("case_id",)


def usable(spec: Evidence) -> Column:
    """Evidence value that may score: finite, and for dosage columns one of the codes 0-3."""
    value = finite(spec.column)
    if spec.column in DOSAGE_COLUMNS:
        return F.when(value.isin(*SCORED_CODES), value)
    return value


def normalize_evidence(df: DataFrame, specs: Sequence[Evidence], method: str = "raw", by: Sequence[str] = CASE,
                       split: bool = False) -> DataFrame:
    """Add ``norm_<column>`` in [0, 1] per case, 1 = most driver-like, NULL preserved.

    raw and zscore give the same values because the z-scores are min-max rescaled. Constant
    columns become 0.5. Ordinal columns are clipped to their scale and ignore the direction.
    """
    df = df.withColumns({f"_v_{s.column}": usable(s) for s in specs})
    if method == "rank":
        for s in specs:
            if not s.scale:
                df = average_rank(df, by, f"_v_{s.column}", f"_r_{s.column}", split)
        stats = {f"_n_{s.column}": F.count(f"_v_{s.column}") for s in specs if not s.scale}
    else:
        stats = {}
        for s in specs:
            if not s.scale:
                stats[f"_lo_{s.column}"] = F.min(f"_v_{s.column}")
                stats[f"_hi_{s.column}"] = F.max(f"_v_{s.column}")
    df = with_group_stats(df, by, stats, split)
    columns = {}
    for s in specs:
        v = F.col(f"_v_{s.column}")
        if s.scale:
            columns[f"norm_{s.column}"] = F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(v, F.lit(float(s.scale))))
                                                 / F.lit(float(s.scale)))
            continue
        if method == "rank":
            scaled = F.col(f"_r_{s.column}") / F.nullif(F.col(f"_n_{s.column}"), F.lit(0))
        else:
            lo, hi = F.col(f"_lo_{s.column}"), F.col(f"_hi_{s.column}")
            scaled = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.5)
        if s.direction == "lower_better":
            scaled = 1.0 - scaled
        columns[f"norm_{s.column}"] = F.when(v.isNotNull(), scaled)
    return df.withColumns(columns).drop(*stats, *[f"_v_{s.column}" for s in specs], *[f"_r_{s.column}" for s in specs])


def recessive_flag(df: DataFrame) -> Column:
    """Boolean from boolean or text flags; anything else fails the query."""
    if "recessive" not in df.columns:
        return F.lit(False)
    text = F.lower(F.trim(F.coalesce(F.col("recessive").cast("string"), F.lit("false"))))
    bad = F.raise_error("recessive flags must be boolean")
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(bad.cast("boolean"))


def organ_penalty(df: DataFrame, penalty: OrganPenalty) -> Column:
    """Sum over organs expressed above the threshold, never below the (negative) cap."""
    term = F.lit(0.0)
    for organ in penalty.organs:
        name = f"hpa_{organ}_expr"
        if name in df.columns:
            over = F.coalesce(F.col(name) > penalty.expr_threshold, F.lit(False))
            term = term + F.when(over, F.lit(float(penalty.per_organ_weight))).otherwise(0.0)
    return F.greatest(term, F.lit(float(penalty.cap)))


def adjusted(df: DataFrame, cfg: Consensus, by: Sequence[str] = CASE, split: bool = False) -> DataFrame:
    """Normalised evidence plus ``adj_<column>`` (missing = 0, penalties and factor applied) and the penalty."""
    specs = [s for s in cfg.evidence if s.column in df.columns]
    df = normalize_evidence(df, specs, cfg.normalize, by, split).withColumn("_recessive", recessive_flag(df))
    columns = {}
    for s in specs:
        value = F.coalesce(f"norm_{s.column}", F.lit(0.0))
        if s.low_score_penalty and s.scale:
            low = F.coalesce(finite(s.column) <= 1.0, F.lit(False))
            value = value - F.when(low, F.lit(float(s.low_score_penalty))).otherwise(0.0)
        if s.column.startswith("gnomad_") and cfg.recessive_factor != 1:
            factor = F.when(F.col("_recessive"), F.lit(float(cfg.recessive_factor))).otherwise(1.0)
            value = value * factor
            columns[f"norm_{s.column}"] = F.col(f"norm_{s.column}") * factor
        columns[f"adj_{s.column}"] = value
    return df.withColumns(columns).withColumn("hpa_penalty", organ_penalty(df, cfg.penalty)).drop("_recessive")


def case_weights(df: DataFrame, cfg: Consensus, by: Sequence[str], chosen: DataFrame | None) -> DataFrame:
    """Add ``weights``: the array chosen for the row's case (``chosen``: by, weights), else the default weights. Nothing without ``chosen``."""
    if chosen is None:
        return df
    default = F.array(*[F.lit(float(w)) for w in cfg.weights])
    joined = null_safe_join(df, chosen.select(*by, F.col("weights").alias("_w")), list(by))
    return joined.withColumn("weights", F.coalesce("_w", default)).drop("_w")


def weight_of(df: DataFrame, cfg: Consensus, name: str) -> Column:
    """Weight of an evidence column: that of the row's case where ``case_weights`` gave one."""
    at = [s.column for s in cfg.evidence].index(name)
    return F.get("weights", F.lit(at)) if "weights" in df.columns else F.lit(float(cfg.weights[at]))


def consensus_score(df: DataFrame, cfg: Consensus, by: Sequence[str] = CASE, split: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """Add norm_*, contrib_*, hpa_penalty, consensus_score, evidence_status and dosage_conflict.

    ``chosen`` (by, weights) has weights of their own for some cases, as ``tuning.decode_weights`` gives them.
    """
    specs = [s for s in cfg.evidence if s.column in df.columns]
    scored = case_weights(adjusted(df, cfg, by, split), cfg, by, chosen)
    contributions = {f"contrib_{s.column}": F.col(f"adj_{s.column}") * weight_of(scored, cfg, s.column) for s in specs}
    total = F.lit(0.0)
    for s in specs:
        total = total + F.col(f"contrib_{s.column}")
    total = total + F.col("hpa_penalty")
    broken = F.isnan(total) | (F.abs(total) == F.lit(float("inf")))
    total = F.when(broken, F.raise_error("non-finite consensus score").cast("double")).otherwise(total)
    active = [f"norm_{s.column}" for s in specs if s.weight > 0]
    raw_code = next((c for c in ("clinGen_haploinsufficiency_raw", "clinGen_hi_score") if c in df.columns), None)
    conflict = dosage_conflict(finite(raw_code)) if raw_code else F.lit(False)
    return (scored.withColumns(contributions).withColumn("consensus_score", total)
            .withColumn("evidence_status", evidence_status(active, "hgnc_id"))
            .withColumn("dosage_conflict", conflict).drop(*[f"adj_{s.column}" for s in specs]))


def score_order() -> list[Column]:
    """Score descending, then id as text ascending with missing ids last."""
    return [F.desc("consensus_score"), F.asc_nulls_last("hgnc_id")]


def consensus_rank(df: DataFrame, cfg: Consensus, by: Sequence[str] = CASE, split: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """Score every candidate and number them 1..n per case; all candidates are kept."""
    return position(consensus_score(df, cfg, by, split, chosen), by, score_order(), "rank", split)


def evidence_gate(scored: DataFrame, cfg: Consensus, by: Sequence[str] = CASE) -> DataFrame:
    """Per case: share of candidates without usable evidence, per-column coverage, and the gate."""
    lacking = F.avg((F.col("evidence_status") != "available").cast("double"))
    coverage = [F.avg(F.col(f"norm_{s.column}").isNotNull().cast("double")).alias(f"coverage_{s.column}")
                for s in cfg.evidence if f"norm_{s.column}" in scored.columns]
    return (scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_candidates"), lacking.alias("missing_rate"), *coverage)
            .withColumn("rejected", F.col("missing_rate") > cfg.max_missing_rate))


def borda(scored: DataFrame, cfg: Consensus, by: Sequence[str] = CASE, split: bool = False) -> DataFrame:
    """Weighted Borda points and competition rank; the organ penalty does not enter.

    A missing value earns (n-1)/2 points (or none); a column no candidate of the case has earns nothing.
    """
    specs = [s for s in cfg.evidence if f"norm_{s.column}" in scored.columns]
    df = scored
    for s in specs:
        df = average_rank(df, by, f"norm_{s.column}", f"_r_{s.column}", split)
    stats = {f"_n_{s.column}": F.count(f"norm_{s.column}") for s in specs}
    df = with_group_stats(df, by, {"_n": F.count(F.lit(1)), **stats}, split)
    fill = (F.col("_n") - 1) / 2.0 if cfg.borda_missing == "median" else F.lit(0.0)
    points = F.lit(0.0)
    for s in specs:
        worst_first = F.col(f"_n_{s.column}") + 1 - F.col(f"_r_{s.column}")
        earned = F.coalesce(F.col("_n") - worst_first, fill)
        points = points + F.when(F.col(f"_n_{s.column}") > 0, weight_of(df, cfg, s.column) * earned).otherwise(0.0)
    df = df.withColumn("borda_score", points)
    df = descending_rank(df, by, "borda_score", "borda_rank", split)
    return df.drop("_n", *stats, *[f"_r_{s.column}" for s in specs])


def rank_agreement(df: DataFrame, x: str, y: str, by: Sequence[str] = CASE, split: bool = False) -> DataFrame:
    """Spearman correlation of two columns per group; NULL when one side is constant."""
    ranked = average_rank(average_rank(df, by, x, "_rx", split), by, y, "_ry", split)
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return (ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("_corr"), spread.alias("_ok"))
            .withColumn("spearman", F.when(F.col("_ok"), F.col("_corr"))).drop("_corr", "_ok"))


# ---------------------------------------------------------------- controls and warnings
def control_check(ranked: DataFrame, controls: DataFrame, by: Sequence[str] = CASE) -> DataFrame:
    """One row per (case, control): presence, rank, top-10, score and evidence.

    ``controls`` lists the symbols expected in each case.
    """
    wanted = controls.select(*by, F.upper(F.trim("symbol")).alias("control")).distinct()
    found = ranked.withColumn("control", F.upper(F.trim("symbol")))
    return (null_safe_join(wanted, found.drop("symbol"), [*by, "control"])
            .withColumn("in_candidates", F.col("rank").isNotNull())
            .withColumn("top10", F.coalesce(F.col("rank") <= 10, F.lit(False))))


def control_summary(checked: DataFrame, by: Sequence[str] = CASE) -> DataFrame:
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("controls_total"),
                                    F.count_if("in_candidates").alias("controls_present"),
                                    F.count_if("top10").alias("controls_top10"))


def validation_panel(checked: DataFrame, hi: str = "clinGen_hi_score", pli: str = "gnomad_pLI") -> DataFrame:
    """Present controls with known-driver support: (HI >= 2 or pLI >= 0.9) and no dosage conflict."""
    strong = F.coalesce(finite(hi) >= 2, F.lit(False)) | F.coalesce(finite(pli) >= 0.9, F.lit(False))
    return checked.where("in_candidates").withColumn("target_ok", strong & ~F.col("dosage_conflict"))


def validation_pass(panel: DataFrame, by: Sequence[str] = CASE, cases: DataFrame | None = None) -> DataFrame:
    """Per case: controls in the panel and whether any has support; of ``cases``, those without a present control have failed."""
    found = panel.groupBy(*by).agg(F.count(F.lit(1)).alias("n_controls"), F.bool_or("target_ok").alias("passed"))
    if cases is None:
        return found
    return null_safe_join(cases.select(*by).distinct(), found, list(by)).withColumns(
        {"n_controls": F.coalesce("n_controls", F.lit(0).cast("bigint")), "passed": F.coalesce("passed", F.lit(False))})


def sparse_evidence_warnings(ranked: DataFrame, by: Sequence[str] = CASE, dosage: str = "norm_clinGen_hi_score",
                             min_coverage: float = 0.2, max_genes: int = 20) -> DataFrame:
    """Per case: low dosage coverage, no dosage coverage, and many genes with similar top scores."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("consensus_score")))
    covered = F.col(dosage).isNotNull() if dosage in ranked.columns else F.lit(False)  # no dosage source at all
    stats = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_genes"), F.avg(covered.cast("double")).alias("dosage_coverage"),
        (at(1) - at(3)).alias("top3_gap"), F.stddev_samp("consensus_score").alias("score_sd"))
    similar = (F.col("n_genes") > max_genes) & F.coalesce(F.col("top3_gap") < F.col("score_sd"), F.lit(False))
    names = F.array_compact(F.array(
        F.when(F.col("dosage_coverage") < min_coverage, "low_dosage_coverage"),
        F.when(similar, "similar_top_scores"), F.when(F.col("dosage_coverage") == 0, "no_dosage_coverage")))
    return stats.withColumn("warnings", names)
