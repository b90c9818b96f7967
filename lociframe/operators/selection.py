"""Design selection inside a budget, review notes and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIN_UTR3_BP, MODULE_BP, MODULE_BUDGET_BP
from ..scale import OrderedGroups
from .consensus import CASE

# Review notes and selection reasons shown to users.
NOTE_RECESSIVE = ("ClinGen recessive association: annotation only; neither automatic exclusion nor evidence of no dosage "
                  "effect.")
NOTE_UNLIKELY = "ClinGen dosage sensitivity unlikely: conflicting evidence requires manual review."
NOTE_VIABLE = ("IMPC mouse viability does not establish absence of other phenotypes or effects of a human deletion.")
NOTE_PARTIAL = "Partial interval overlap: review functional impact and the status of the remaining copy."
NOTE_NO_EVIDENCE = "No usable core evidence; a low score is not negative evidence."
REASON_UNRESOLVED = "unresolved_transcript_or_utr"
REASON_SHORT = "below_project_utr3_minimum"
REASON_BUDGET = "module_budget_limit"
REASON_SELECTED = "selected_within_module_budget"

# Columns of the human-facing summary, in order.
SUMMARY_COLUMNS = ["rank", "symbol", "gene_id", "consensus_score", "clinGen_hi_score", "gnomad_LOEUF", "gnomad_pLI",
                   "evidence_status", "gnomad_status", "interval_overlap", "utr3_bp", "selected", "selection_reason",
                   "ot_status", "ot_disease_score", "evidence_notes"]


def evidence_notes(df: DataFrame) -> Column:
    """Conditional review notes in a fixed order; absent columns add nothing."""
    def when(column: str, value, note: str) -> Column:
        return F.when(F.col(column) == value, note) if column in df.columns else F.lit(None).cast("string")

    return F.concat_ws(" ", when("clinGen_haploinsufficiency_raw", 30, NOTE_RECESSIVE),
                       when("clinGen_haploinsufficiency_raw", 40, NOTE_UNLIKELY),
                       when("impc_viability", "viable", NOTE_VIABLE), when("interval_overlap", "partial", NOTE_PARTIAL),
                       when("evidence_status", "no_usable_evidence", NOTE_NO_EVIDENCE))


def budget_select(ranked: DataFrame, capacity: int = MODULE_BUDGET_BP, module_size: int = MODULE_BP,
                  minimum_utr: int = MIN_UTR3_BP, by: Sequence[str] = CASE, split: bool | None = None) -> DataFrame:
    """Select the first floor(capacity / module_size) eligible genes in rank order of each case.

    Ineligible genes use no budget. Adds selected, selection_reason and evidence_notes.
    """
    if capacity <= 0 or module_size <= 0:
        raise ValueError("module budget and size must be positive")
    unresolved = (F.coalesce(F.col("utr3_status"), F.lit("")) != "ok") | F.col("utr3_bp").isNull()
    eligible = ~unresolved & (F.col("utr3_bp") >= minimum_utr)
    counted = OrderedGroups(ranked, by, [F.col("rank")], split).running(
        "_taken", F.when(eligible, 1).otherwise(0).cast("bigint")).frame()
    reason = (F.when(unresolved, REASON_UNRESOLVED).when(F.col("utr3_bp") < minimum_utr, REASON_SHORT)
              .when(F.col("_taken") > capacity // module_size, REASON_BUDGET).otherwise(REASON_SELECTED))
    return (counted.withColumn("selection_reason", reason).withColumn("selected", F.col("selection_reason") == REASON_SELECTED)
            .withColumn("evidence_notes", evidence_notes(ranked)).withColumn("module_budget_bp", F.lit(capacity))
            .withColumn("assumed_module_bp", F.lit(module_size)).drop("_taken"))


def summary_view(ranked: DataFrame, by: Sequence[str] = CASE) -> DataFrame:
    """Fixed projection of a ranked table; columns the run did not produce are NULL."""
    columns = [F.col(c) if c in ranked.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY_COLUMNS]
    return ranked.select(*by, *columns)


def run_summary(ranked: DataFrame, by: Sequence[str] = CASE, coverage: Sequence[str] = ()) -> DataFrame:
    """Candidates, selected, missing evidence, annotation gaps and per-column coverage of every case."""
    status = (F.count_if(F.col("ot_status") == "query_failed") if "ot_status" in ranked.columns else F.lit(0).cast("bigint"))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if("selected").alias("n_selected"),
        F.count_if(F.col("evidence_status") == "no_usable_evidence").alias("n_without_evidence"),
        status.alias("n_annotation_gaps"),
        *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"coverage_{c}") for c in coverage])
