"""Evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..operators import evidence as op
from . import bindings as b
from .bindings import with_views
from .identity import ALIAS, alias_table

TISSUES = ["AF", "AO", "NF", "NO", "RF", "RO"]
ORGANS = {"organ one": ["AF", "AO"], "organ two": ["NF", "NO", "absent"], "RO": ["RO", "RF"]}


def curation_codes(spark, folder):
    # One code in thirteen is none of the known ones; every record counts.
    code = F.when(F.col("gene_id") % 13 == 5, "7").otherwise(F.col("clinGen_hi_score").cast("string"))
    codes = b.evidence(spark, folder).select("gene_id", code.alias("code"))
    done = op.join_curation(b.genes(spark, folder).select("gene_id"), op.curation_codes(codes, "code", "hi"), "hi", "gene_id")
    return done.select("gene_id", "hi_raw", "hi_score", "hi_status", op.dosage_conflict("hi_raw").alias("dosage_conflict"))


def _constraint(spark, folder):
    lines = b.table(spark, folder, "lineitem")
    text = lambda c: F.when(c, "true").otherwise("false")
    return lines.select(
        F.col("l_partkey").alias("gene_id"),
        F.concat(F.lit("T"), "l_orderkey", F.lit("."), "l_linenumber", F.lit("."), "l_suppkey").alias("transcript"),
        text((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("mane_select"),
        text((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 2)).alias("canonical"),
        F.when(F.col("l_tax") == 0, "NA").otherwise((F.col("l_discount") * 10).cast("string")).alias("lof.pLI"),
        F.col("l_quantity").cast("string").alias("lof.oe_ci.upper"),
        F.when(F.col("l_quantity") > 40, "['outlier_mis']").otherwise("[]").alias("constraint_flags"),
        F.when(F.col("l_discount") == 0, "{low}").otherwise("").alias("gene_flags"))


def constraint_transcript_pick(spark, folder):
    return op.constraint_transcript(_constraint(spark, folder)).select(
        "gene_id", "transcript_choice", "choice_status", "transcript")


def constraint_mask(spark, folder):
    done = op.join_constraint(b.genes(spark, folder).select("gene_id"), _constraint(spark, folder))
    return done.select("gene_id", fixed("gnomad_pLI_raw").alias("pli_raw"), fixed("gnomad_pLI").alias("pli"),
                       fixed("gnomad_LOEUF_raw").alias("loeuf_raw"), fixed("gnomad_LOEUF").alias("loeuf"), "gnomad_status")


def tissue_pivot(spark, folder):
    return op.tissue_pivot(b.tissue_long(spark, folder), TISSUES)


def organ_rollup(spark, folder):
    return op.organ_rollup(b.tissue_long(spark, folder), ORGANS)


def tissue_map_json(spark, folder):
    entries = F.transform(F.map_entries("tissue_ntpm"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("decimal(18,2)").cast("string")))
    done = op.tissue_map(b.tissue_long(spark, folder))
    return done.select("gene_id", F.array_join(entries, ";").alias("tissue_ntpm"))


def panel_coverage(spark, folder):
    panels = b.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.array(F.lit("AF"), F.when(F.col("n_nationkey") % 3 == 0, "absent").otherwise("NO"),
                F.when(F.col("n_regionkey") == 2, "RO").otherwise("gone")).alias("tissues"))
    panels = panels.unionByName(b.table(spark, folder, "region").select(
        F.col("r_name").alias("id"), F.array(F.lit("nowhere")).alias("tissues")))
    done = op.panel_coverage(panels, b.tissue_long(spark, folder), b.genes(spark, folder))
    return done.select("id", F.array_join("available_tissues", ",").alias("available_tissues"),
                       F.array_join("missing_tissues", ",").alias("missing_tissues"), "coverage_status",
                       "genes_with_expression", "candidate_count")


def _records(spark, folder):
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", "Ataxia, Autosomal recessive")
            .when(F.col("o_orderpriority") == "2-HIGH", "Autosomal recessive; Autosomal dominant")
            .when(F.col("o_orderpriority") == "5-LOW", "X-linked recessive").otherwise("Autosomal dominant"))
    key = F.col("o_custkey")
    return b.table(spark, folder, "orders").where("o_orderstatus IS NOT NULL").select(
        F.when(F.col("o_orderstatus") == "P", F.lit("PHENO")).otherwise(text).alias("Phenotypes"),
        F.when(F.col("o_totalprice") > 250000, F.concat(F.lit("s"), key)).alias("Approved"),
        F.concat(F.lit("S"), key, F.lit(", old"), (key + 1).cast("string")).alias("Symbols"))


def _modes(spark, folder):
    status = F.col("o_orderstatus")
    return b.table(spark, folder, "orders").select(
        F.concat(F.lit("OLD"), "o_custkey").alias("GeneSymbol"),
        F.when(status == "F", "Autosomal recessive").when(status == "O", " autosomal RECESSIVE ")
        .when(F.col("o_orderpriority") == "1-URGENT", "Autosomal dominant").alias("ModeOfInheritance"))


def inheritance_tags(spark, folder):
    a = op.recessive_symbols(_records(spark, folder), "Phenotypes", "Approved", "Symbols")
    c = op.recessive_from_modes(_modes(spark, folder))
    return a.withColumn("source", F.lit("records")).unionByName(c.withColumn("source", F.lit("modes")))


def recessive_annotation(spark, folder):
    sources = {"OMIM": op.recessive_symbols(_records(spark, folder), "Phenotypes", "Approved", "Symbols"),
               "ClinVar": op.recessive_from_modes(_modes(spark, folder))}
    done = op.recessive_annotation(b.genes(spark, folder).select("gene_id", "hgnc_id"), sources, alias_table(spark, folder))
    return done.select("gene_id", "recessive", "recessive_source", "recessive_assessment")


def _snapshot(spark, folder):
    """Nested association text per user of ``events``: one association per event type."""
    events = b.table(spark, folder, "events")
    per_type = events.groupBy(F.col("user_id").alias("gene_id"), "event_type").agg(
        F.max("value").alias("value"), F.count(F.lit(1)).alias("n")).where("value >= 150")
    entry = F.struct(F.struct(F.col("event_type").alias("id"), F.upper("event_type").alias("name")).alias("disease"),
                     (F.col("value") / (F.col("value") + F.col("n"))).alias("score"),
                     F.array(F.struct(F.lit("events").alias("id"), F.col("value").alias("score"))).alias("datasourceScores"))
    record = F.struct(F.when(F.col("top") < 200, "query_failed").otherwise("ok").alias("status"),
                      F.when(F.col("top") < 200, "timeout").alias("error"),
                      F.col("list").alias("associations"), F.col("list").alias("background"))
    listed = per_type.groupBy("gene_id").agg(F.max("value").alias("top"), F.array_sort(F.collect_list(entry)).alias("list"))
    return listed.select("gene_id", F.to_json(record).alias("json"))


def association_status(spark, folder):
    records = _snapshot(spark, folder).select("gene_id", F.from_json("json", op.SNAPSHOT_RECORD).alias("record"))
    done = op.association_annotation(b.genes(spark, folder).select("gene_id"), records, "purchase", ["click"])
    return done.select("gene_id", "ot_status", fixed("ot_disease_score").alias("ot_disease_score"),
                       F.size("ot_phenotype_evidence").cast("bigint").alias("n_phenotypes"),
                       F.size("ot_other_background").cast("bigint").alias("n_background"), "ot_error")


def viability_annotation(spark, folder):
    labels = F.when(F.col("s_acctbal") < 0, "lethal").when(F.col("s_acctbal") < 5000, "subviable").otherwise("viable")
    table = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("gene_id"), F.concat(F.lit("MGI:"), "s_suppkey").alias("mouse_gene_id"),
        labels.alias("impc_viability"), F.lit("table").alias("source"), F.lit("1").alias("release"), F.lit("map").alias("mapping_source"))
    done = op.viability_annotation(b.genes(spark, folder).select("gene_id"), table)
    return done.select("gene_id", "impc_viability", "impc_mouse_gene_id")


def gene_set_coverage(spark, folder):
    sets = b.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("gene_id")).distinct()
    reference = b.table(spark, folder, "part").where("p_size > 10").select(F.col("p_partkey").alias("gene_id"))
    return op.gene_list_coverage(sets, reference)


def optional_evidence(spark, folder):
    extra = b.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("gene_id")).agg(
        F.max("l_discount").alias("ai_score"))
    done = op.merge_optional(b.evidence(spark, folder).select("gene_id", "gnomad_pLI"), extra, "gene_id")
    return done.select("gene_id", fixed("gnomad_pLI").alias("pli"), fixed("ai_score").alias("ai_score"))


QUERIES = {"curation_codes": curation_codes, "constraint_transcript_pick": constraint_transcript_pick,
           "constraint_mask": constraint_mask, "tissue_pivot": tissue_pivot, "organ_rollup": organ_rollup,
           "tissue_map_json": tissue_map_json, "panel_coverage": panel_coverage, "inheritance_tags": inheritance_tags,
           "recessive_annotation": recessive_annotation, "association_status": association_status,
           "viability_annotation": viability_annotation, "gene_set_coverage": gene_set_coverage,
           "optional_evidence": optional_evidence}

PICKED = """rows AS (SELECT l_partkey AS gene_id, 'T' || l_orderkey || '.' || l_linenumber || '.' || l_suppkey AS transcript,
      CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 1 WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 2 END AS lvl,
      CASE WHEN l_tax <> 0 THEN l_discount * 10 END AS pli, l_quantity AS loeuf,
      l_quantity > 40 OR l_discount = 0 AS flagged FROM lineitem),
    best AS (SELECT gene_id, min(lvl) AS lvl FROM rows WHERE lvl IS NOT NULL GROUP BY gene_id),
    picked AS (SELECT gene_id, any_value(lvl) AS lvl, count(*) AS n, min(transcript) AS transcript, min(pli) AS pli,
      min(loeuf) AS loeuf, bool_or(flagged) AS flagged FROM rows JOIN best USING (gene_id, lvl) GROUP BY gene_id)"""

TAGS = """recs AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'PHENO' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'Ataxia, Autosomal recessive'
      WHEN '2-HIGH' THEN 'Autosomal recessive; Autosomal dominant' WHEN '5-LOW' THEN 'X-linked recessive'
      ELSE 'Autosomal dominant' END END AS txt,
      CASE WHEN o_totalprice > 250000 THEN 's' || o_custkey ELSE 'S' || o_custkey || ', old' || (o_custkey + 1) END AS names
      FROM orders WHERE o_orderstatus IS NOT NULL),
    omim AS (SELECT DISTINCT upper(trim(unnest(string_split(names, ',')))) AS symbol FROM recs
      WHERE lower(txt) LIKE '%autosomal recessive%' AND lower(txt) NOT LIKE '%dominant%'),
    modes AS (SELECT 'OLD' || o_custkey AS symbol FROM orders GROUP BY o_custkey
      HAVING bool_or(o_orderstatus IN ('F', 'O')) AND NOT bool_or(o_orderstatus NOT IN ('F', 'O') AND o_orderpriority = '1-URGENT'))"""

ORACLES = {
    "curation_codes": with_views("evidence", """SELECT p_partkey AS gene_id, hi AS hi_raw,
        CASE WHEN hi IN (0, 1, 2, 3) THEN hi END AS hi_score, CASE WHEN e.gene_id IS NULL THEN 'not_curated' WHEN hi = 0 THEN 'no_evidence'
          WHEN hi = 7 THEN 'unexpected_category' WHEN hi = 1 THEN 'little_evidence' WHEN hi = 2 THEN 'emerging_evidence' WHEN hi = 3 THEN 'sufficient_evidence' WHEN hi = 30 THEN 'recessive_association'
          WHEN hi = 40 THEN 'dosage_unlikely' ELSE 'not_evaluated' END AS hi_status, coalesce(hi = 40, false) AS dosage_conflict
        FROM part LEFT JOIN (SELECT gene_id, CASE WHEN gene_id % 13 = 5 THEN 7 ELSE hi END AS hi FROM evidence) e
        ON p_partkey = e.gene_id"""),
    "constraint_transcript_pick": f"""WITH {PICKED} SELECT gene_id, CASE lvl WHEN 1 THEN 'MANE_Select' ELSE 'canonical' END AS transcript_choice,
        CASE WHEN n = 1 THEN 'single' ELSE 'ambiguous' END AS choice_status, CASE WHEN n = 1 THEN transcript END AS transcript FROM picked""",
    "constraint_mask": f"""WITH {PICKED} SELECT p_partkey AS gene_id, round(pli, 6) AS pli_raw, round(loeuf, 6) AS loeuf_raw,
        CASE WHEN NOT flagged THEN round(pli, 6) END AS pli, CASE WHEN NOT flagged THEN round(loeuf, 6) END AS loeuf,
        CASE WHEN n IS NULL THEN 'no_selected_transcript_record' WHEN n > 1 THEN 'ambiguous_transcript' WHEN flagged THEN 'quality_flagged_not_scored'
          ELSE 'available' END AS gnomad_status FROM part LEFT JOIN
        (SELECT gene_id, n, CASE WHEN n = 1 THEN pli END AS pli, CASE WHEN n = 1 THEN loeuf END AS loeuf, CASE WHEN n = 1 THEN flagged END AS flagged
          FROM picked) ON p_partkey = gene_id""",
    "tissue_pivot": with_views("tissue_long", "SELECT gene_id, " + ", ".join(
        f"max(ntpm) FILTER (tissue = '{t}') AS \"{t}\"" for t in TISSUES) + " FROM tissue_long GROUP BY gene_id"),
    "organ_rollup": with_views("tissue_long", """SELECT gene_id, max(ntpm) FILTER (tissue IN ('AF', 'AO')) AS hpa_organ_one_expr,
        max(ntpm) FILTER (tissue IN ('NF', 'NO')) AS hpa_organ_two_expr, max(ntpm) FILTER (tissue IN ('RO', 'RF')) AS hpa_ro_expr
        FROM tissue_long GROUP BY gene_id"""),
    "tissue_map_json": with_views("tissue_long", """SELECT gene_id, string_agg(tissue || '=' || m::DECIMAL(18, 2)::VARCHAR, ';' ORDER BY tissue)
        AS tissue_ntpm FROM (SELECT gene_id, tissue, max(ntpm) AS m FROM tissue_long GROUP BY ALL) GROUP BY gene_id"""),
    "panel_coverage": with_views("tissue_long", """WITH asked AS (
          SELECT n_nationkey::VARCHAR AS id, unnest([1, 2, 3]) AS pos, unnest(['AF', CASE WHEN n_nationkey % 3 = 0 THEN 'absent' ELSE 'NO' END,
            CASE WHEN n_regionkey = 2 THEN 'RO' ELSE 'gone' END]) AS tissue FROM nation
          UNION ALL SELECT r_name, 1, 'nowhere' FROM region),
        marked AS (SELECT *, tissue IN (SELECT tissue FROM tissue_long) AS known FROM asked),
        listed AS (SELECT id, coalesce(string_agg(tissue, ',' ORDER BY pos) FILTER (known), '') AS available_tissues,
          coalesce(string_agg(tissue, ',' ORDER BY pos) FILTER (NOT known), '') AS missing_tissues,
          CASE WHEN bool_and(known) THEN 'complete' WHEN bool_or(known) THEN 'partial' ELSE 'unavailable' END AS coverage_status
          FROM marked GROUP BY id)
        SELECT l.*, (SELECT count(DISTINCT gene_id) FROM tissue_long t JOIN asked a ON a.tissue = t.tissue WHERE a.id = l.id
          AND t.gene_id IN (SELECT p_partkey FROM part)) AS genes_with_expression, (SELECT count(*) FROM part) AS candidate_count FROM listed l"""),
    "inheritance_tags": f"WITH {TAGS} SELECT symbol, 'records' AS source FROM omim UNION ALL SELECT symbol, 'modes' FROM modes",
    "recessive_annotation": f"""WITH {ALIAS}, {TAGS}, o AS (SELECT DISTINCT hgnc_id FROM omim JOIN amap ON alias = lower(omim.symbol)),
        m AS (SELECT DISTINCT hgnc_id FROM modes JOIN amap ON alias = lower(modes.symbol)),
        j AS (SELECT k AS gene_id, n.hgnc_id IN (SELECT hgnc_id FROM o) AS a, n.hgnc_id IN (SELECT hgnc_id FROM m) AS b FROM nomen n)
        SELECT gene_id, a OR b AS recessive, CASE WHEN a AND b THEN 'OMIM;ClinVar' WHEN a THEN 'OMIM' WHEN b THEN 'ClinVar' ELSE '' END
          AS recessive_source, 'records_checked' AS recessive_assessment FROM j""",
    "association_status": """WITH per AS (SELECT user_id, event_type, max(value) AS v, count(*) AS n FROM events GROUP BY ALL HAVING max(value) >= 150),
        g AS (SELECT user_id, max(v) AS top, max(v / (v + n)) FILTER (event_type = 'purchase') AS score,
          count(*) FILTER (event_type = 'click') AS np, count(*) FILTER (event_type NOT IN ('purchase', 'click')) AS nb FROM per GROUP BY 1)
        SELECT p_partkey AS gene_id, CASE WHEN top IS NULL THEN 'missing_record' WHEN top < 200 THEN 'query_failed'
            WHEN score IS NULL THEN 'no_record' ELSE 'available' END AS ot_status,
          CASE WHEN top >= 200 THEN round(score, 6) END AS ot_disease_score, CASE WHEN top >= 200 THEN np END AS n_phenotypes,
          CASE WHEN top >= 200 THEN nb END AS n_background, CASE WHEN top < 200 THEN 'timeout' ELSE '' END AS ot_error
        FROM part LEFT JOIN g ON user_id = p_partkey""",
    "viability_annotation": """SELECT p_partkey AS gene_id, CASE WHEN s_suppkey IS NULL THEN 'not_supplied' WHEN s_acctbal < 0 THEN 'lethal'
          WHEN s_acctbal < 5000 THEN 'subviable' ELSE 'viable' END AS impc_viability, 'MGI:' || s_suppkey AS impc_mouse_gene_id
        FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""",
    "gene_set_coverage": """SELECT l_suppkey AS set_id, count(DISTINCT l_partkey) AS n_genes,
        count(DISTINCT l_partkey) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS n_present
        FROM lineitem GROUP BY 1""",
    "optional_evidence": with_views("evidence", """SELECT e.gene_id, round(pli, 6) AS pli, round(s, 6) AS ai_score FROM evidence e
        LEFT JOIN (SELECT l_partkey, max(l_discount) AS s FROM lineitem GROUP BY 1) ON l_partkey = e.gene_id"""),
}
