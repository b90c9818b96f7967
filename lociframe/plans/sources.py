"""Reader and sink queries: files are derived from the supplied tables, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..operators import identity
from ..operators.intervals import genomic_order as in_genomic_order
from ..operators.selection import summary_view
from ..scale import shared_folder
from ..sources import matrix, sinks, tables
from . import bindings as b
from .bindings import with_views
from .consensus import SELECTED, _selected
from .identity import ALIAS, nomenclature


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def _lines(df: DataFrame, path: str, *parts) -> str:
    """Tab-separated lines, no header; a NULL cell is empty."""
    df.select(F.concat_ws("\t", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("value")).write.text(path)
    return path


def _table(df: DataFrame, path: str, sep: str = "\t") -> str:
    """A header in every file and cells as they are."""
    df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).write.option("header", True).option(
        "sep", sep).option("quote", "\u0000").option("emptyValue", "").csv(path)
    return path


def _text(prefix: str, c="p_partkey"):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def gtf_genes_parse(spark, folder):
    part = b.table(spark, folder, "part")
    key = F.col("p_partkey")
    name = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit('gene_name "S'), key.cast("string"), F.lit('";')))
    kind = F.when(F.col("p_size") % 7 == 0, "lncRNA").otherwise("protein_coding")
    field = F.when(key % 2 == 0, "gene_type").otherwise("gene_biotype")
    attributes = F.concat(F.lit('gene_id "ENSG'), key.cast("string"), F.lit("."), (key % 9).cast("string"), F.lit('"; '), field, F.lit(' "'), kind, F.lit('"; '), name)
    path = _lines(part, _place(spark, "genes.gtf"), F.concat(F.lit("chr"), (key % 25 + 1).cast("string")), F.lit("X"), F.lit("gene"), key * 100, key * 100 + F.col("p_size") * 10,
                  F.lit("."), F.when(key % 3 == 0, "-").otherwise("+"), F.lit("."), attributes)
    return tables.read_gtf_genes(spark, path)


def gtf_features_parse(spark, folder):
    lines = b.table(spark, folder, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("transcript", "exon", "CDS", "stop_codon", "gene")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    tags = F.concat(F.lit('tag "basic"; '), F.when(F.col("l_returnflag") == "A", 'tag "MANE_Select";').otherwise(""))
    attributes = F.concat(F.lit('gene_id "ENSG'), F.col("l_partkey").cast("string"), F.lit('.1"; transcript_id "T'), F.col("l_orderkey").cast("string"), F.lit('"; '), tags)
    start = F.col("l_suppkey") * 10 + 1
    path = _lines(lines, _place(spark, "features.gtf"), F.lit("chr1"), F.lit("X"), kind, start, start + F.col("l_linenumber"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    rows = tables.read_gtf_features(spark, path)
    return rows.groupBy("gene_id", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tags")).alias("n_tags"), F.min("start").alias("start"), F.max("end").alias("end"),
                                                  F.count_if(F.array_contains("tags", "MANE_Select")).alias("n_mane"))


def curation_parse(spark, folder):
    """Preamble, header and records stand in files of one folder; their order does not matter."""
    head = spark.range(1).select(F.explode(F.array(F.lit("#dosage list"), F.lit("#Gene Symbol\tHaploinsufficiency Score\tTriplosensitivity Score\tPMID\tPMID"))).alias("value"))
    code = F.when(F.col("p_size") % 6 == 0, "NA").otherwise((F.col("p_size") % 4).cast("string"))
    rows = b.table(spark, folder, "part").select(F.concat_ws("\t", _text("S"), code, F.lit("0"), _text("9"), F.lit("1")).alias("value"))
    path = _place(spark, "curation.tsv")
    head.union(rows).write.text(path)
    done = tables.read_curation_tsv(spark, path)
    return done.select(F.col("gene symbol").alias("symbol"), F.col("haploinsufficiency score").alias("hi"), F.col("triplosensitivity score").alias("ts"), "pmid")


def constraint_parse(spark, folder):
    part = b.table(spark, folder, "part")
    table = part.select(F.concat(_text("ENSG"), F.lit(".2")).alias("gene_id"), _text("T").alias("transcript"), (F.col("p_size") > 20).alias("mane_select"), F.lit("true").alias("canonical"),
                        F.when(F.col("p_size") % 5 == 0, "NA").otherwise((F.col("p_size") / 50).cast("string")).alias("lof.pLI"), F.lit("0.2").alias("lof.oe_ci.upper"),
                        F.lit("[]").alias("constraint_flags"), F.lit("").alias("gene_flags"), F.lit("z").alias("extra"))
    wanted = part.where("p_size > 10").select(_text("ENSG").alias("gene_id"))
    done = tables.read_constraint_tsv(spark, _table(table, _place(spark, "constraint.tsv")), wanted)
    return done.select("gene_id", "transcript", "mane_select", F.expr("try_cast(`lof.pLI` AS double)").alias("pli"), F.coalesce("gene_flags", F.lit("")).alias("gene_flags"))


def legacy_constraint_parse(spark, folder):
    """Several files, each with its header; the number of a row counts over all of them."""
    table = b.table(spark, folder, "part").select(_text("S").alias("gene"), F.when(F.col("p_size") > 40, "NA").otherwise((F.col("p_size") * 2).cast("string")).alias("pLI"), F.lit("0.25").alias("oe_lof_upper"))
    done = tables.read_legacy_constraint_tsv(spark, _table(table.repartition(3, "gene"), _place(spark, "legacy.tsv")))
    lines = done.agg(F.count_distinct("source_line").alias("n_lines"))
    return done.groupBy("pli", "oe_lof_upper").agg(F.count(F.lit(1)).alias("n"), F.min("gene_symbol").alias("first_symbol")).withColumn("n_lines", lines.scalar())


def tissue_parse(spark, folder):
    table = b.table(spark, folder, "lineitem").select(_text("ENSG", "l_partkey").alias("Gene"), _text("S", "l_partkey").alias("Gene name"),
                                                      F.concat("l_returnflag", "l_linestatus").alias("Tissue"), F.col("l_quantity").alias("nTPM"))
    done = tables.read_tissue_long(spark, _table(table, _place(spark, "tissue.tsv")))
    return done.groupBy("gene", "gene_name", "tissue").agg(fixed(F.sum("ntpm")).alias("ntpm"), F.count(F.lit(1)).alias("n"))


def alias_parse(spark, folder):
    path = _table(nomenclature(spark, folder), _place(spark, "nomenclature.tsv"))
    return identity.build_alias_map(tables.read_alias_table(spark, path, "\t"))


def bed_parse(spark, folder):
    """Intervals of a BED folder, good and bad ones."""
    key = F.col("s_suppkey")
    stop = F.when(key % 7 == 0, key * 1500).otherwise(key * 1500 + 100).cast("string")
    path = _lines(b.table(spark, folder, "supplier"), _place(spark, "regions.bed"), F.concat(F.when(key % 2 == 0, "chr").otherwise(""), (F.col("s_nationkey") + 1).cast("string")), key * 1500,
                  F.concat(stop, F.when(key % 11 == 0, ".5").otherwise("")))
    done = tables.read_interval_table(spark, path, "bed")
    return done.groupBy("interval", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def gene_list_parse(spark, folder):
    path = _lines(b.table(spark, folder, "part"), _place(spark, "genes.txt"), F.concat(F.lit(" "), _text("HGNC:"), F.lit(" ")))
    return tables.read_gene_list(spark, path, "txt")


def inheritance_parse(spark, folder):
    table = b.table(spark, folder, "part").select(_text("S").alias("GeneSymbol"), F.col("p_type").alias("ModeOfInheritance"))
    return tables.read_inheritance(spark, _table(table, _place(spark, "modes.tsv")), "modes").select("GeneSymbol", "ModeOfInheritance")


def ai_scores_parse(spark, folder):
    table = b.table(spark, folder, "part").select(_text("ENSG").alias("ensembl"), _text("S").alias("gene_symbol"), (F.col("p_size") / 64).alias("DeepLOF_score"))
    return tables.read_ai_scores(spark, _table(table, _place(spark, "scores.csv"), ",")).select("ensembl", "gene_symbol", fixed("DeepLOF_score").alias("score"))


def viability_parse(spark, folder):
    names = F.array(*[F.lit(x) for x in ("viable", "subviable", "lethal", "unknown")])
    table = b.table(spark, folder, "supplier").select(_text("ENSG", "s_suppkey").alias("gene_id"), _text("ENSMUSG", "s_suppkey").alias("mouse_gene_id"),
                                                      F.element_at(names, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("impc_viability"), F.lit("IMPC").alias("source"), F.lit("r1").alias("release"),
                                                      F.lit("table").alias("mapping_source"))
    return tables.read_viability(spark, _table(table, _place(spark, "viability.tsv")))


def matrix_parse(spark, folder):
    """A 10x triple over many files: banner and size in one, entries in the others, features and barcodes in order of their files."""
    counts = b.counts(spark, folder).where("count > 0")
    genes, cells = b.table(spark, folder, "supplier"), b.table(spark, folder, "customer")
    features = _lines(genes.orderBy("s_suppkey"), _place(spark, "features.tsv"), _text("ENSG", "s_suppkey"), _text("S", "s_suppkey"), F.lit("Gene Expression"))
    barcodes = _lines(cells.orderBy("c_custkey"), _place(spark, "barcodes.tsv"), _text("CELL", "c_custkey"))
    head = spark.range(0, 1, 1, 1).select(F.explode(F.array(F.lit("%%MatrixMarket matrix coordinate real general"), F.lit(f"{genes.count()} {cells.count()} {counts.count()}"))).alias("value"))
    entries = counts.select(F.concat_ws(" ", (F.col("gene_id") + 1).cast("string"), (F.col("cell_id") + 1).cast("string"), F.col("count").cast("double").cast("string")).alias("value"))
    path = _place(spark, "matrix.mtx")
    head.union(entries).write.text(path)
    done = matrix.read_10x(spark, path, features, barcodes)
    return done.counts.groupBy("gene_id").agg(fixed(F.sum("count")).alias("total"), F.count(F.lit(1)).alias("n_cells"), F.min("cell_id").alias("first_cell"))


def genomic_order(spark, folder):
    return in_genomic_order(b.cell_genes(spark, folder)).select("gene_id", "chrom", "genomic_at")


def evidence_readback(spark, folder):
    """Evidence written in buckets of the case; reading one bucket's cases opens one folder."""
    path = _place(spark, "evidence")
    sinks.write_evidence(b.panel(spark, folder).select("case_id", "gene_id", "clinGen_hi_score", "gnomad_pLI"), path)
    return sinks.read_cases(spark, path, [1, 2, 3]).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("gnomad_pLI")).alias("pli"))


def ranked_readback(spark, folder):
    """The ranked table and its summary as CSV, read back; the summary has the same cases and ranks."""
    ranked = _selected(spark, folder)
    whole, brief = _place(spark, "ranked"), _place(spark, "summary")
    sinks.write_ranked(ranked, whole)
    sinks.write_summary(ranked, brief)
    read = lambda path: spark.read.option("header", True).csv(path)
    done = read(whole).select("case_id", "rank", "gene_id").join(read(brief).select("case_id", "rank", "selected"), ["case_id", "rank"])
    assert len(summary_view(ranked).columns) == len(spark.read.option("header", True).csv(brief).columns)
    cast = lambda c: F.col(c).cast("bigint").alias(c)
    return done.select(cast("case_id"), cast("rank"), cast("gene_id"), F.col("selected").cast("boolean").alias("selected"))


QUERIES = {f.__name__: f for f in (
    gtf_genes_parse, gtf_features_parse, curation_parse, constraint_parse, legacy_constraint_parse, tissue_parse, alias_parse, bed_parse, gene_list_parse,
    inheritance_parse, ai_scores_parse, viability_parse, matrix_parse, genomic_order, evidence_readback, ranked_readback)}

ORACLES = {
    "gtf_genes_parse": """SELECT CASE WHEN p_partkey % 5 = 0 THEN 'ENSG' || p_partkey || '.' || (p_partkey % 9) ELSE 'S' || p_partkey END AS gene_name, 'ENSG' || p_partkey AS gene_id,
        'chr' || (p_partkey % 25 + 1) AS chrom, p_partkey * 100 AS start, p_partkey * 100 + p_size * 10 AS "end", CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand
        FROM part WHERE p_size % 7 <> 0 AND p_partkey % 25 < 22""",
    "gtf_features_parse": """SELECT 'ENSG' || l_partkey AS gene_id, ['transcript', 'exon', 'CDS', 'stop_codon'][l_linenumber % 5 + 1] AS feature, count(*) AS n,
        (count(*) + count(*) FILTER (l_returnflag = 'A'))::BIGINT AS n_tags, min(l_suppkey * 10 + 1) AS start, max(l_suppkey * 10 + 1 + l_linenumber) AS "end",
        count(*) FILTER (l_returnflag = 'A') AS n_mane FROM lineitem WHERE l_linenumber % 5 < 4 GROUP BY 1, 2""",
    "curation_parse": """SELECT 'S' || p_partkey AS symbol, CASE WHEN p_size % 6 <> 0 THEN (p_size % 4)::VARCHAR END AS hi, '0' AS ts, '9' || p_partkey AS pmid FROM part""",
    "constraint_parse": """SELECT 'ENSG' || p_partkey AS gene_id, 'T' || p_partkey AS transcript, CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END AS mane_select,
        CASE WHEN p_size % 5 <> 0 THEN p_size / 50 END AS pli, '' AS gene_flags FROM part WHERE p_size > 10""",
    "legacy_constraint_parse": """SELECT CASE WHEN p_size <= 40 THEN (p_size * 2)::VARCHAR END AS pli, '0.25' AS oe_lof_upper, count(*) AS n, min('S' || p_partkey) AS first_symbol,
        (SELECT count(*) FROM part) AS n_lines FROM part GROUP BY 1, 2""",
    "tissue_parse": """SELECT 'ENSG' || l_partkey AS gene, 'S' || l_partkey AS gene_name, l_returnflag || l_linestatus AS tissue, round(sum(l_quantity), 6) AS ntpm, count(*) AS n
        FROM lineitem GROUP BY 1, 2, 3""",
    "alias_parse": f"WITH {ALIAS} SELECT alias, hgnc_id, kind FROM amap",
    "bed_parse": """WITH r AS (SELECT s_suppkey AS k, s_nationkey + 1 AS c, s_suppkey * 1500 + 1 AS s, s_suppkey * 1500 + CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 100 END AS e FROM supplier),
        j AS (SELECT *, CASE WHEN c > 22 THEN 'unsupported_chromosome' WHEN k % 11 = 0 THEN 'non_integer_coordinates' WHEN s > e THEN 'empty_or_reversed' END AS reject_reason FROM r)
        SELECT CASE WHEN reject_reason IS NULL THEN 'chr' || c || ':' || s || '-' || e END AS interval, reject_reason, count(*) AS n FROM j GROUP BY 1, 2""",
    "gene_list_parse": "SELECT 'HGNC:' || p_partkey AS label FROM part",
    "inheritance_parse": """SELECT 'S' || p_partkey AS "GeneSymbol", p_type AS "ModeOfInheritance" FROM part""",
    "ai_scores_parse": "SELECT 'ENSG' || p_partkey AS ensembl, 'S' || p_partkey AS gene_symbol, round(p_size / 64, 6) AS score FROM part",
    "viability_parse": """SELECT 'ENSG' || s_suppkey AS gene_id, 'ENSMUSG' || s_suppkey AS mouse_gene_id, ['viable', 'subviable', 'lethal', 'unknown'][s_suppkey % 4 + 1] AS impc_viability,
        'IMPC' AS source, 'r1' AS release, 'table' AS mapping_source FROM supplier""",
    "matrix_parse": with_views("counts", """SELECT 'ENSG' || gene_id AS gene_id, round(sum(n), 6) AS total, count(*) AS n_cells, min('CELL' || cell_id) AS first_cell FROM counts WHERE n > 0 GROUP BY 1"""),
    "genomic_order": with_views("cell_genes", """SELECT gene_id, chrom, row_number() OVER (ORDER BY CASE chrom WHEN 'chrX' THEN 23 ELSE substr(chrom, 4)::INT END, g_start, gene_id) AS genomic_at FROM cell_genes"""),
    "ranked_readback": with_views("ranked", f"""WITH {SELECTED} SELECT case_id, rnk AS rank, gene_id, selection_reason = 'selected_within_module_budget' AS selected FROM picked"""),
    "evidence_readback": with_views("panel", "SELECT case_id, count(*) AS n, round(sum(pli), 6) AS pli FROM panel WHERE case_id IN (1, 2, 3) GROUP BY 1"),
}
