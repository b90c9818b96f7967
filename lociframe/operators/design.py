"""Transcript choice and 3' UTR length from transcript features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import GROUP_ROWS, checkpoint, dealt
from .intervals import merge_blocks

KEY = ("gene_id", "transcript_id")


def transcript_summary(features: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per transcript: strand, merged tags and coding extent.

    ``features`` is long: gene_id, transcript_id, feature, start, end, strand, tags ARRAY<STRING>.
    The known tags become flags, so no tag list is collected per transcript.
    """
    tag = lambda name: F.bool_or(F.coalesce(F.array_contains("tags", name), F.lit(False)))
    coding = F.col("feature").isin("CDS", "stop_codon")
    return features.groupBy(*key).agg(
        F.min("strand").alias("strand"), tag("MANE_Select").alias("is_mane"), tag("Ensembl_canonical").alias("is_canonical"),
        tag("cds_end_NF").alias("cds_end_missing"), F.bool_or(F.col("feature") == "exon").alias("has_exon"),
        F.count_if(F.col("feature") == "exon").alias("n_exons"), F.bool_or(F.col("feature") == "CDS").alias("has_cds"), F.bool_or(F.col("feature") == "stop_codon").alias("has_stop"),
        F.min(F.when(coding, F.col("start"))).alias("coding_start"), F.max(F.when(coding, F.col("end"))).alias("coding_end"))


def choose_transcript(transcripts: DataFrame) -> DataFrame:
    """Per gene: the MANE transcript, else the canonical one, else the only coding one.

    Two transcripts at the chosen level, or none, give no transcript.
    """
    coding = transcripts.where("has_cds")
    level = F.when(F.col("is_mane"), 1).when(F.col("is_canonical"), 2).otherwise(3)
    best = coding.groupBy("gene_id").agg(
        F.min(level).alias("_level"), F.count_if("is_mane").alias("_n1"),
        F.count_if("is_canonical").alias("_n2"),
        F.count(F.lit(1)).alias("_n3"), F.min_by("transcript_id", F.struct(level, F.col("transcript_id"))).alias("_tid"))
    single = (F.when(F.col("_level") == 1, F.col("_n1")).when(F.col("_level") == 2, F.col("_n2"))
              .otherwise(F.col("_n3"))) == 1
    choice = (F.when(F.col("_level") == 1, "MANE_Select").when(F.col("_level") == 2, "Ensembl_canonical")
              .when(single, "only_coding_transcript").otherwise("unresolved"))
    chosen = best.select("gene_id", choice.alias("transcript_choice"), F.when(single, F.col("_tid")).alias("transcript_id"))
    genes = transcripts.select("gene_id").distinct()
    return genes.join(chosen, "gene_id", "left").withColumn(
        "transcript_choice", F.coalesce("transcript_choice", F.lit("unresolved")))


def utr3_lengths(features: DataFrame, transcripts: DataFrame, key: Sequence[str] = KEY,
                 split: bool | None = None) -> DataFrame:
    """Spliced bases beyond the coding end on the strand, over merged exon blocks (never introns)."""
    exons = features.where("feature = 'exon'").select(*key, "start", "end")
    blocks = merge_blocks(exons, key, split=split)
    usable = transcripts.where("has_exon AND has_stop AND NOT cds_end_missing").select(
        *key, "strand", "coding_start", "coding_end")
    beyond = (F.when(F.col("strand") == "+", F.col("end") - F.greatest("start", F.col("coding_end") + 1) + 1)
              .otherwise(F.least("end", F.col("coding_start") - 1) - F.col("start") + 1))
    return blocks.join(usable, list(key)).groupBy(*key).agg(
        F.sum(F.greatest(F.lit(0).cast("bigint"), beyond.cast("bigint"))).alias("utr3_bp"))


def transcript_design(features: DataFrame, candidates: DataFrame, split: bool | None = None) -> DataFrame:
    """Add transcript_id, transcript_choice, utr3_bp and utr3_status to candidates (one row each)."""
    # Summaries come before genes are chosen: no feature row travels by gene, and where the features lie by transcript none travels at all.
    summaries = checkpoint(transcript_summary(features))  # one row per transcript
    size = summaries.agg(F.count(F.lit(1)).alias("n"), F.sum("n_exons").alias("exons"), F.max("n_exons").alias("most")).first()
    if split is None:  # the exon counts are at hand, so the exon rows need not be counted again
        split = (size["most"] or 0) > GROUP_ROWS
    genes = dealt(candidates.select("gene_id").distinct(), size["n"], ["gene_id"])
    transcripts = checkpoint(dealt(summaries, size["n"], ["gene_id"]).join(genes, "gene_id", "left_semi"))  # read three times below
    chosen = choose_transcript(transcripts)
    picked = chosen.where("transcript_id IS NOT NULL").select(*KEY)
    # Only the chosen transcript's exons are merged.
    exons = dealt(features.where("feature = 'exon'"), size["exons"] or 0, KEY).join(dealt(picked, size["exons"] or 0, KEY), list(KEY), "left_semi")
    lengths = utr3_lengths(exons, dealt(transcripts.join(picked, list(KEY), "left_semi"), size["exons"] or 0, KEY), split=split)
    designed = candidates.join(chosen, "gene_id", "left").join(lengths, list(KEY), "left")
    status = (F.when(F.col("transcript_id").isNull(), "ambiguous_or_missing_transcript")
              .when(F.col("utr3_bp").isNull(), "incomplete_coding_annotation").otherwise("ok"))
    return (designed.withColumn("utr3_status", status)
            .withColumn("transcript_choice", F.coalesce("transcript_choice", F.lit("unresolved"))))
