"""Evidence tables: category codes, quality masks, transcript choice, tissue tables, annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column, number

# Dosage curation categories and their labels.
DOSAGE_LABELS = {0: "no_evidence", 1: "little_evidence", 2: "emerging_evidence", 3: "sufficient_evidence",
                 30: "recessive_association", 40: "dosage_unlikely", -1: "not_evaluated"}
SCORED_CODES = (0, 1, 2, 3)
# Flag texts that mean "no quality flag".
NO_FLAG = ("", "[]", "{}", "NA", "null")


def join_evidence(candidates: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Left equi-join that keeps every candidate; an ``evidence`` table with several rows of one key stops the run, naming the key.

    The check is part of the join's own side: rows meet by key, as the join needs them, and are counted there.
    """
    others = [c for c in evidence.columns if c != key]
    once = evidence.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_row"))
    repeated = F.raise_error(F.concat(F.lit(f"duplicate {key} in evidence: "), F.col(key).cast("string"))).cast("boolean")
    checked = once.where(F.when(F.col("_n") > 1, repeated).otherwise(True)).select(key, *[F.col("_row")[c].alias(c) for c in others])
    return candidates.join(checked, key, "left")


def merge_optional(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Left merge of an optional score table; a column present on both sides is an error."""
    shared = sorted(set(base.columns) & set(extra.columns) - {key})
    if shared:
        raise ValueError(f"columns overlap existing evidence: {', '.join(shared)}")
    return join_evidence(base, extra, key)


# ---------------------------------------------------------------- dosage codes
def curation_codes(df: DataFrame, code: str, prefix: str) -> DataFrame:
    """Dosage category to ``<prefix>_score`` (0-3 only), ``<prefix>_raw`` and ``<prefix>_status``."""
    raw = number(code)
    status = F.lit(None).cast("string")
    for value, label in DOSAGE_LABELS.items():
        status = F.when(raw == value, label).otherwise(status)
    status = F.when(raw.isNull(), "not_evaluated").when(status.isNull(), "unexpected_category").otherwise(status)
    return (df.withColumn(f"{prefix}_raw", raw).withColumn(f"{prefix}_status", status)
            .withColumn(f"{prefix}_score", F.when(raw.isin(*SCORED_CODES), raw)))


def join_curation(candidates: DataFrame, curation: DataFrame, prefix: str, key: str = "hgnc_id") -> DataFrame:
    """Candidates without a curation record get status ``not_curated``."""
    joined = join_evidence(candidates, curation, key)
    return joined.withColumn(f"{prefix}_status", F.coalesce(f"{prefix}_status", F.lit("not_curated")))


# ---------------------------------------------------------------- constraint
def constraint_transcript(constraint: DataFrame) -> DataFrame:
    """One constraint row per gene: the MANE row, else the canonical row.

    Several rows at the chosen level give status ``ambiguous`` and no values.
    """
    yes = ["true", "1"]
    level = F.when(F.lower("mane_select").isin(*yes), 1).when(F.lower("canonical").isin(*yes), 2)
    rows = constraint.withColumn("_level", level).where(F.col("_level").isNotNull())
    values = F.struct(F.col("transcript"), F.col("`lof.pLI`").alias("pli"), F.col("`lof.oe_ci.upper`").alias("loeuf"),
                      F.col("constraint_flags"), F.col("gene_flags"))
    picked = rows.groupBy("gene_id").agg(
        F.min("_level").alias("level"), F.count_if(F.col("_level") == 1).alias("_n1"),
        F.count_if(F.col("_level") == 2).alias("_n2"),
        F.min_by(values, F.struct("_level", "transcript")).alias("_v"))
    chosen = F.when(F.col("level") == 1, F.col("_n1")).otherwise(F.col("_n2"))
    single = chosen == 1
    return picked.select(
        "gene_id", F.when(F.col("level") == 1, "MANE_Select").otherwise("canonical").alias("transcript_choice"),
        F.when(single, "single").otherwise("ambiguous").alias("choice_status"),
        *[F.when(single, F.col(f"_v.{c}")).alias(c) for c in ("transcript", "pli", "loeuf", "constraint_flags", "gene_flags")])


def constraint_mask(df: DataFrame, metrics: Mapping[str, str] | None = None,
                    flags: Sequence[str] = ("constraint_flags", "gene_flags")) -> DataFrame:
    """Metrics of flagged rows move to ``*_raw`` only; status says whether they were scored.

    A metric that is no number, negative or (pLI) above one is not scored either: status ``invalid_metric``.
    """
    metrics = metrics or {"gnomad_pLI": "pli", "gnomad_LOEUF": "loeuf"}
    flagged = F.lit(False)
    for name in flags:
        flagged = flagged | ~F.trim(F.coalesce(F.col(name), F.lit(""))).isin(*NO_FLAG)
    broken = F.lit(False)
    for target, source in metrics.items():
        text = F.trim(F.col(source).cast("string"))
        given = text.isNotNull() & ~F.lower(text).isin("", "na", "nan", "null", "none")
        limit = 1.0 if target.lower().endswith("pli") else float("inf")
        broken = broken | (given & ~F.coalesce(number(source).between(0.0, limit), F.lit(False)))
    df = df.withColumn("_flagged", flagged).withColumn("_broken", broken)
    for target, source in metrics.items():
        df = df.withColumn(f"{target}_raw", number(source))
        df = df.withColumn(target, F.when(~F.col("_flagged") & ~F.col("_broken"), F.col(f"{target}_raw")))
    status = F.when(F.col("_broken"), "invalid_metric").when(F.col("_flagged"), "quality_flagged_not_scored").otherwise("available")
    return df.withColumn("gnomad_status", status).drop("_flagged", "_broken")


def join_constraint(candidates: DataFrame, constraint: DataFrame) -> DataFrame:
    """Choose, mask and left-join constraint records by gene id; a gene with several chosen rows has status ``ambiguous_transcript``."""
    masked = constraint_mask(constraint_transcript(constraint))
    masked = masked.withColumn("gnomad_status", F.when(F.col("choice_status") == "ambiguous", "ambiguous_transcript").otherwise(F.col("gnomad_status")))
    ready = masked.select(
        "gene_id", F.col("transcript").alias("gnomad_transcript_id"), F.col("transcript_choice").alias(
            "gnomad_transcript_choice"), "gnomad_pLI_raw", "gnomad_LOEUF_raw", "gnomad_pLI", "gnomad_LOEUF", "gnomad_status")
    joined = join_evidence(candidates, ready, "gene_id")
    return joined.withColumn("gnomad_status", F.coalesce("gnomad_status", F.lit("no_selected_transcript_record")))


# ---------------------------------------------------------------- tissues
def tissue_pivot(long: DataFrame, tissues: Sequence[str], key: str = "gene_id") -> DataFrame:
    """gene x tissue maxima with an explicit column list (no extra distinct job)."""
    return long.groupBy(key).pivot("tissue", list(tissues)).agg(F.max("ntpm"))


def organ_rollup(long: DataFrame, organs: Mapping[str, Sequence[str]], key: str = "gene_id") -> DataFrame:
    """``hpa_<organ>_expr``: maximum over the organ's tissues (a group named like a tissue replaces it)."""
    aggregates = [F.max(F.when(F.col("tissue").isin(*tissues), F.col("ntpm"))).alias(
        f"hpa_{organ.lower().replace(' ', '_')}_expr") for organ, tissues in organs.items()]
    return long.groupBy(key).agg(*aggregates)


def tissue_map(long: DataFrame, key: str = "gene_id") -> DataFrame:
    """Per gene MAP<tissue, max>; two-level aggregation, so at most one entry per tissue is collected."""
    peak = long.groupBy(key, "tissue").agg(F.max("ntpm").alias("ntpm"))
    entries = F.array_sort(F.collect_list(F.struct("tissue", "ntpm")))
    return peak.groupBy(key).agg(F.map_from_entries(entries).alias("tissue_ntpm"))


def panel_coverage(panels: DataFrame, long: DataFrame, candidates: DataFrame, key: str = "gene_id") -> DataFrame:
    """Tissue coverage of every phenotype panel.

    ``panels`` has id, tissues ARRAY<STRING>. Available means the tissue occurs in ``long``; a
    measured zero counts as expression data, a missing record does not.
    """
    asked = panels.select("id", F.posexplode("tissues").alias("_at", "tissue"))
    known = long.where("ntpm IS NOT NULL").select("tissue").distinct().withColumn("_known", F.lit(True))
    entry = F.struct("_at", "tissue")
    status = asked.join(known, "tissue", "left").groupBy("id").agg(
        F.count_if(F.col("_known")).alias("_found"), F.count(F.lit(1)).alias("_asked"),
        F.array_sort(F.collect_list(F.when(F.col("_known"), entry))).alias("_have"),
        F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), entry))).alias("_lack"))
    measured = (long.where("ntpm IS NOT NULL").select(key, "tissue").distinct()
                .join(candidates.select(key), key, "left_semi")
                .join(asked.select("id", "tissue"), "tissue").select("id", key).distinct()
                .groupBy("id").agg(F.count(F.lit(1)).alias("genes_with_expression")))
    total = candidates.agg(F.count(F.lit(1)).alias("n")).scalar()
    label = (F.when(F.col("_found") == F.col("_asked"), "complete").when(F.col("_found") > 0, "partial")
             .otherwise("unavailable"))
    return status.join(measured, "id", "left").select(
        "id", F.transform("_have", lambda s: s["tissue"]).alias("available_tissues"),
        F.transform("_lack", lambda s: s["tissue"]).alias("missing_tissues"), label.alias("coverage_status"),
        F.coalesce("genes_with_expression", F.lit(0)).alias("genes_with_expression"), total.alias("candidate_count"))


# ---------------------------------------------------------------- inheritance
def recessive_symbols(records: DataFrame, text: str, approved: str, symbols: str | None = None) -> DataFrame:
    """Symbols of rows reported autosomal recessive and not dominant (one upper-case symbol per row)."""
    inheritance = F.lower(F.coalesce(F.col(text), F.lit("")))
    names = F.col(approved) if symbols is None else F.coalesce(F.col(approved), F.col(symbols))
    return (records.where(inheritance.contains("autosomal recessive") & ~inheritance.contains("dominant"))
            .select(F.explode(F.split(names, ",")).alias("symbol"))
            .select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct())


def recessive_from_modes(records: DataFrame, symbol: str = "GeneSymbol", mode: str = "ModeOfInheritance") -> DataFrame:
    """Prepared inheritance table: recessive symbols minus every symbol with a dominant row."""
    label = F.lower(F.trim(F.coalesce(F.col(mode), F.lit(""))))
    return (records.select(F.upper(F.trim(F.col(symbol))).alias("symbol"), label.alias("_mode")).where("symbol IS NOT NULL")
            .groupBy("symbol").agg(F.bool_or(F.col("_mode") == "autosomal recessive").alias("_rec"),
                                   F.bool_or(F.col("_mode").contains("dominant")).alias("_dom"))
            .where("_rec AND NOT _dom").select("symbol"))


def recessive_annotation(candidates: DataFrame, sources: Mapping[str, DataFrame], alias_map: DataFrame) -> DataFrame:
    """Add recessive, recessive_source (``;``-joined) and recessive_assessment; False means no record."""
    from .identity import alias_key
    tagged = candidates
    names = []
    for name, symbols in sources.items():
        flag = f"_in_{name}"
        lookup = alias_map.select(F.col("alias").alias("_alias"), "hgnc_id")
        ids = (symbols.select(alias_key("symbol").alias("_alias")).join(lookup, "_alias")
               .select("hgnc_id").distinct().withColumn(flag, F.lit(True)))
        tagged = tagged.join(ids, "hgnc_id", "left")
        names.append((name, flag))
    if not names:
        return tagged.withColumns({"recessive": F.lit(False), "recessive_source": F.lit(""),
                                   "recessive_assessment": F.lit("not_assessed")})
    source = F.concat_ws(";", *[F.when(F.col(flag), name) for name, flag in names])
    return (tagged.withColumn("recessive_source", source).withColumn("recessive", F.col("recessive_source") != "")
            .withColumn("recessive_assessment", F.lit("records_checked")).drop(*[flag for _, flag in names]))


# ---------------------------------------------------------------- associations and viability
ASSOCIATION = "STRUCT<disease: STRUCT<id: STRING, name: STRING>, score: DOUBLE, " \
              "datasourceScores: ARRAY<STRUCT<id: STRING, score: DOUBLE>>>"
SNAPSHOT_RECORD = f"STRUCT<status: STRING, error: STRING, associations: ARRAY<{ASSOCIATION}>, background: ARRAY<{ASSOCIATION}>>"


def association_annotation(candidates: DataFrame, records: DataFrame, disease_id: str,
                           phenotype_ids: Sequence[str] = (), key: str = "gene_id") -> DataFrame:
    """Left-join nested association records (``record`` of type SNAPSHOT_RECORD) as annotation columns.

    ot_status: available, no_record, query_failed or missing_record; a score of 0 is available.
    """
    phenotypes = list(phenotype_ids)
    targets = [disease_id, *phenotypes]
    joined = candidates.join(records.select(key, "record"), key, "left")
    good = F.col("record.status") == "ok"
    rows = F.coalesce(F.col("record.associations"), F.array().cast(f"ARRAY<{ASSOCIATION}>"))
    direct = F.filter(rows, lambda r: r["disease"]["id"] == disease_id)
    only = F.get(direct, F.lit(0))["score"]
    score = F.when(good & (F.size(direct) == 1) & only.between(0, 1), only)
    status = (F.when(F.col("record").isNull(), "missing_record").when(~good, "query_failed")
              .when(F.size(direct) == 0, "no_record").when(F.size(direct) > 1, "duplicate_association")
              .when(~F.coalesce(direct[0]["score"].between(0, 1), F.lit(False)), "invalid_score")
              .otherwise("available"))
    wanted = F.filter(rows, lambda r: r["disease"]["id"].isin(*phenotypes)) if phenotypes else F.filter(rows, lambda r: F.lit(False))
    background = F.filter(F.coalesce(F.col("record.background"), F.array().cast(f"ARRAY<{ASSOCIATION}>")),
                          lambda r: ~r["disease"]["id"].isin(*targets))
    return (joined.withColumn("ot_status", status).withColumn("ot_disease_score", score)
            .withColumn("ot_datasource_scores", F.when(good & (F.size(direct) == 1), direct[0]["datasourceScores"]))
            .withColumn("ot_phenotype_evidence", F.when(good, wanted))
            .withColumn("ot_other_background", F.when(good, background))
            .withColumn("ot_error", F.coalesce(F.col("record.error"), F.lit("")))
            .withColumn("ot_url", F.concat(F.lit("https://platform.opentargets.org/target/"), F.col(key).cast("string"),
                                           F.lit("/associations"))).drop("record"))


def viability_annotation(candidates: DataFrame, viability: DataFrame, key: str = "gene_id") -> DataFrame:
    """Left-join mouse viability; genes without a record are ``not_supplied`` and ranks never change."""
    extra = [F.col(c).alias(f"impc_{c}") for c in ("mouse_gene_id", "source", "release", "mapping_source")
             if c in viability.columns]
    joined = candidates.drop("impc_viability").join(viability.select(key, "impc_viability", *extra), key, "left")
    return joined.withColumn("impc_viability", F.coalesce("impc_viability", F.lit("not_supplied")))


# ---------------------------------------------------------------- small predicates
def dosage_conflict(raw: Column | str, score: Column | str | None = None) -> Column:
    """True when the raw dosage code is 40 (the score column stands in when no raw code exists)."""
    code = column(raw) if score is None else F.coalesce(column(raw), column(score))
    return F.coalesce(code == 40, F.lit(False))


def evidence_status(columns: Sequence[Column | str], identifier: Column | str) -> Column:
    """``available`` when any positively weighted evidence exists and the id is known."""
    any_value = F.lit(False)
    for c in columns:
        any_value = any_value | column(c).isNotNull()
    return F.when(any_value & column(identifier).isNotNull(), "available").otherwise("no_usable_evidence")


def gene_list_coverage(gene_sets: DataFrame, reference: DataFrame, key: str = "gene_id") -> DataFrame:
    """Per named set: genes asked for and genes present in ``reference``.

    ``gene_sets`` is long: set_id, gene key.
    """
    known = reference.select(key).distinct().withColumn("_known", F.lit(True))
    return gene_sets.join(known, key, "left").groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count_if(F.col("_known")).alias("n_present"))
