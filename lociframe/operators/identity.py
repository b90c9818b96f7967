"""Gene identity: alias dictionaries, symbol and id resolution, score crosswalks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, column, finite, strip_version, unquote
from ..scale import dictionary_join


def alias_key(symbol: Column | str) -> Column:
    return F.lower(F.trim(column(symbol)))


def _unique_ids(keyed: DataFrame) -> DataFrame:
    """Keys that lead to exactly one id; min/max combine map-side, so a hot key costs nothing."""
    return (keyed.groupBy("alias").agg(F.min("hgnc_id").alias("hgnc_id"), F.max("hgnc_id").alias("_last"))
            .where(F.col("hgnc_id") == F.col("_last")).drop("_last"))


def build_alias_map(nomenclature: DataFrame, alias_columns: Sequence[str] = ("prev_symbol", "alias_symbol")) -> DataFrame:
    """Case-folded symbol to id: approved symbols beat aliases, ambiguous keys are left out.

    Returns alias, hgnc_id, kind (``approved`` or ``alias``).
    """
    table = (nomenclature.withColumn("hgnc_id", blank_to_null("hgnc_id")).withColumn("symbol", blank_to_null("symbol"))
             .where("hgnc_id IS NOT NULL AND symbol IS NOT NULL"))
    symbols = table.select(alias_key("symbol").alias("alias"), "hgnc_id")
    approved = _unique_ids(symbols)
    present = [c for c in alias_columns if c in table.columns]
    if not present:
        return approved.withColumn("kind", F.lit("approved"))
    words = F.flatten(F.array_compact(F.array(*[F.split(unquote(c), "[,;|]") for c in present])))
    aliases = (table.select("hgnc_id", F.explode(words).alias("alias"))
               .select("hgnc_id", alias_key("alias").alias("alias")).where("alias <> ''"))
    # An approved symbol shields its key from aliases even where several ids share it and it resolves to none.
    unique = _unique_ids(aliases).join(symbols.select("alias").distinct(), "alias", "left_anti")
    return (approved.withColumn("kind", F.lit("approved"))
            .unionByName(unique.withColumn("kind", F.lit("alias"))))


def resolve_symbols(candidates: DataFrame, alias_map: DataFrame, symbol: str = "gene_symbol", heavy: DataFrame | None = None) -> DataFrame:
    """Left lookup of symbols; blanks and unknown or ambiguous symbols stay ``unresolved``.

    Blank symbols take no part in the join. ``heavy`` (``scale.heavy_keys`` of ``alias``) spreads symbols that hold very many rows.
    """
    keyed = candidates.withColumn("input_symbol", F.coalesce(F.trim(symbol), F.lit("")))
    keyed = keyed.withColumn("_alias", blank_to_null(alias_key("input_symbol")))
    lookup = alias_map.select(F.col("alias").alias("_alias"), F.col("hgnc_id"))
    heavy = heavy.withColumnRenamed("alias", "_alias") if heavy is not None else None
    resolved = dictionary_join(keyed.drop("hgnc_id"), lookup, ["_alias"], heavy).drop("_alias")
    return resolved.withColumn("status", F.when(F.col("hgnc_id").isNotNull(), "ok").otherwise("unresolved"))


def unresolved_rate(resolved: DataFrame, by: Sequence[str] = ("case_id",), limit: float = 0.1) -> DataFrame:
    """Per-case share of unresolved symbols and whether it exceeds the accepted share."""
    bad = F.count_if(F.col("status") == "unresolved")
    return (resolved.groupBy(*by).agg(F.count(F.lit(1)).alias("n_genes"), bad.alias("n_unresolved"))
            .withColumn("unresolved_rate", F.col("n_unresolved") / F.col("n_genes"))
            .withColumn("failed", F.col("unresolved_rate") > limit))


def resolve_gene_ids(labels: DataFrame, nomenclature: DataFrame, alias_map: DataFrame, annotation: DataFrame,
                     label: str = "label", by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Ensembl id, nomenclature id, symbol or alias to one approved, annotated gene.

    All three routes share one (kind, key) dictionary, hence one join. Status is ``ok``,
    ``unresolved_identity``, ``no_unique_position`` or ``duplicate_identity``.
    """
    approved = nomenclature.where(F.col("status") == "Approved").select(
        "hgnc_id", "symbol", blank_to_null("ensembl_gene_id").alias("gene_id"))
    dictionary = (approved.where("gene_id IS NOT NULL").select(F.lit("ensembl").alias("_kind"),
                                                               F.col("gene_id").alias("_key"), "hgnc_id")
                  .unionByName(approved.select(F.lit("id").alias("_kind"), F.col("hgnc_id").alias("_key"), "hgnc_id"))
                  .unionByName(alias_map.select(F.lit("symbol").alias("_kind"), F.col("alias").alias("_key"), "hgnc_id")))
    dictionary = (dictionary.groupBy("_kind", "_key")
                  .agg(F.min("hgnc_id").alias("_hid"), F.max("hgnc_id").alias("_last"))
                  .where("_hid = _last").drop("_last"))
    text = F.trim(F.col(label))
    kind = F.when(text.startswith("ENSG"), "ensembl").when(text.startswith("HGNC:"), "id").otherwise("symbol")
    key = F.when(text.startswith("ENSG"), strip_version(text)).when(text.startswith("HGNC:"), text).otherwise(alias_key(text))
    keyed = dictionary_join(labels.withColumn("_kind", kind).withColumn("_key", blank_to_null(key)), dictionary, ["_kind", "_key"])
    ids = approved.groupBy("hgnc_id").agg(F.min("gene_id").alias("gene_id"), F.count(F.lit(1)).alias("_n")).where(
        "_n = 1").select(F.col("hgnc_id").alias("_hid"), F.col("hgnc_id"), "gene_id")
    placed = annotation.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("_positions"), F.first("chrom").alias("chrom"), F.first("start").alias("start"),
        F.first("end").alias("end"))
    # Labels that resolve to nothing have no id from here on.
    found = dictionary_join(dictionary_join(keyed, ids, ["_hid"]), placed, ["gene_id"])
    copies = found.where("hgnc_id IS NOT NULL").groupBy(*by, "hgnc_id").agg(F.count(F.lit(1)).alias("_copies"))
    found = dictionary_join(found, copies, [*by, "hgnc_id"])
    status = (F.when(F.col("gene_id").isNull(), "unresolved_identity")
              .when(F.coalesce("_positions", F.lit(0)) != 1, "no_unique_position")
              .when(F.col("_copies") > 1, "duplicate_identity").otherwise("ok"))
    return found.withColumn("status", status).drop("_kind", "_key", "_hid", "_positions", "_copies")


def crosswalk_scores(scores: DataFrame, nomenclature: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Map (ensembl, gene_symbol) score rows to ids; no symbol fallback, disagreements are excluded.

    mapping_status: mapped, ambiguous_crosswalk, not_in_crosswalk, symbol_disagreement.
    """
    crosswalk = (nomenclature.select(blank_to_null("ensembl_gene_id").alias("_ensembl"),
                                     blank_to_null("hgnc_id").alias("_id"))
                 .where("_ensembl IS NOT NULL AND _id IS NOT NULL")
                 .groupBy("_ensembl").agg(F.min("_id").alias("_min"), F.max("_id").alias("_max")))
    by_symbol = alias_map.select(F.col("alias").alias("_alias"), F.col("hgnc_id").alias("symbol_hgnc_id"))
    keyed = scores.withColumn("_ensembl", blank_to_null(F.trim("ensembl"))).withColumn("_alias", blank_to_null(alias_key("gene_symbol")))
    joined = dictionary_join(dictionary_join(keyed, crosswalk, ["_ensembl"]), by_symbol, ["_alias"])
    unique = F.when(F.col("_min") == F.col("_max"), F.col("_min"))
    status = (F.when(F.col("_min").isNull(), "not_in_crosswalk").when(F.col("_min") != F.col("_max"), "ambiguous_crosswalk")
              .when(F.col("symbol_hgnc_id") != F.col("_min"), "symbol_disagreement").otherwise("mapped"))
    return (joined.withColumn("ensembl_hgnc_id", unique).withColumn("mapping_status", status)
            .withColumn("hgnc_id", F.when(F.col("mapping_status") == "mapped", F.col("ensembl_hgnc_id")))
            .drop("_ensembl", "_alias", "_min", "_max"))


def collapse_scores(mapped: DataFrame, score: str) -> DataFrame:
    """One score per id: identical duplicates collapse, different values are a ``conflict`` (score NULL)."""
    one = (mapped.where("hgnc_id IS NOT NULL").groupBy("hgnc_id")
           .agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count(F.lit(1)).alias("n_records")))
    return (one.withColumn("conflict", F.col("_low") != F.col("_high"))
            .withColumn(score, F.when(~F.col("conflict"), F.col("_low"))).drop("_low", "_high"))


def crosswalk_audit(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("mapping_status").agg(F.count(F.lit(1)).alias("n_records"))


def legacy_constraint(candidates: DataFrame, constraint: DataFrame, alias_map: DataFrame) -> DataFrame:
    """Constraint table keyed by (possibly historic) symbols, joined to candidates by id.

    ``constraint`` has gene_symbol, pli, oe_lof_upper and source_line; when several symbols lead
    to one id the earliest line wins.
    """
    resolved = resolve_symbols(constraint, alias_map).where("status = 'ok'")
    values = F.struct(F.col("pli"), F.col("oe_lof_upper"))
    first = resolved.groupBy("hgnc_id").agg(F.min_by(values, F.col("source_line")).alias("_v"))
    ready = first.select("hgnc_id", finite(F.col("_v.pli").try_cast("double")).alias("gnomad_pLI"),
                         finite(F.col("_v.oe_lof_upper").try_cast("double")).alias("gnomad_LOEUF"))
    return candidates.join(ready, "hgnc_id", "left")
