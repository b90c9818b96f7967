"""Readers for annotation, evidence and interval files.

Everything is read as text, validated, then cast. Files ending in .gz are not splittable: pass
``partitions`` to spread their rows before further work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import CHROMOSOMES, blank_to_null, chrom_rank, nullify, number, strip_version
from ..operators.evidence import SNAPSHOT_RECORD
from ..operators.expectations import check, gene_id_syntax, in_range, non_empty, one_of, require_columns, unique
from ..operators.intervals import ONE_BASED, ZERO_BASED, normalize_interval

GTF_COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their 0-based number (byte-order mark removed): ``line`` over all files in order of their
    paths, ``in_file`` inside each.

    A scan reads files in blocks. The number is the position inside the block plus the sizes of the earlier blocks; a table of block
    sizes, one row for each, is joined, so any number of files and blocks is one scan and nothing reaches the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = lambda window: F.coalesce(F.sum("_n").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each block of a file, so ordering them is cheap.
    blocks = blocks.withColumns({"_before": earlier(W.orderBy("_file", "_block")), "_in_file": earlier(W.partitionBy("_file").orderBy("_block"))}).drop("_n")
    joined = lines.join(F.broadcast(blocks), ["_file", "_block"])
    local = F.col("_at") - F.col("_first")
    return joined.select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"), (local + F.col("_before")).alias("line"), (local + F.col("_in_file")).alias("in_file"))


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    if row is None:
        raise ValueError(f"{path}: empty file")
    return row["value"].lstrip("﻿").rstrip("\r")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, lower: bool = False) -> DataFrame:
    """Header + text columns; header cells are trimmed, cells keep their text.

    ``sep=None`` picks tab or comma from the header line. Of repeated headers the first wins.
    """
    header_line = _first_line(spark, path)
    if sep is None:
        sep = "\t" if "\t" in header_line else ","
    reader = (spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("header", True)
              .option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True))
    raw_names = [c.strip().strip('"').lstrip("#").strip() for c in header_line.split(sep)]
    names = [c.lower() for c in raw_names] if lower else raw_names
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    table = reader.schema(schema).csv(path)
    seen: set[str] = set()
    columns = []
    for i, name in enumerate(names):
        if name not in seen:
            seen.add(name)
            columns.append(F.col(f"_c{i}").alias(name))
    return table.select(*columns)


# ---------------------------------------------------------------- annotation
def _gtf(spark: SparkSession, path: str, partitions: int | None) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("start", "end") else T.StringType()) for c in GTF_COLUMNS])
    table = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return _spread(table.where("attributes IS NOT NULL"), partitions)


def _attribute(name: str):
    return F.regexp_extract("attributes", rf'(?:^|[;\s]){name} "([^"]*)"', 1)


def read_gtf_genes(spark: SparkSession, path: str, gene_types: Sequence[str] | None = ("protein_coding",),
                   partitions: int | None = None) -> DataFrame:
    """Gene rows of a GTF on the main chromosomes, in genome order."""
    genes = _gtf(spark, path, partitions).where((F.col("feature") == "gene") & F.col("seqname").isin(*CHROMOSOMES))
    kind = F.coalesce(blank_to_null(_attribute("gene_type")), _attribute("gene_biotype"))
    if gene_types:
        genes = genes.where(kind.isin(*gene_types))
    name = F.coalesce(blank_to_null(_attribute("gene_name")), _attribute("gene_id"))
    return genes.select(name.alias("gene_name"), strip_version(_attribute("gene_id")).alias("gene_id"),
                        F.col("seqname").alias("chrom"), "start", "end", "strand").orderBy(chrom_rank("chrom"), "start")


def read_gtf_features(spark: SparkSession, path: str, genes: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Transcript, exon, CDS and stop-codon rows (of the wanted genes) with every repeated tag."""
    rows = _gtf(spark, path, partitions).where(F.col("feature").isin("transcript", "exon", "CDS", "stop_codon"))
    features = rows.select(
        strip_version(_attribute("gene_id")).alias("gene_id"), _attribute("transcript_id").alias("transcript_id"), "feature",
        "start", "end", "strand", F.regexp_extract_all("attributes", F.lit(r'tag "([^"]*)"'), F.lit(1)).alias("tags")
    ).where("transcript_id <> ''")
    return features if genes is None else features.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def read_alias_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Nomenclature with padded headers and cells; needs hgnc_id and symbol."""
    return require_columns(read_delimited(spark, path, sep), ["hgnc_id", "symbol"])


# ---------------------------------------------------------------- evidence
def read_curation_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Dosage curation after a preamble: the header line starts with ``#Gene Symbol``."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"))
    first_cell = F.lower(F.trim(F.split("value", "\t")[0]))
    header = lines.where(first_cell == "#gene symbol").first()
    if header is None:
        raise ValueError(f"{path}: missing header line '#Gene Symbol'")
    names = [c.strip().lower().lstrip("#") for c in header["value"].split("\t")]
    cells = F.split("value", "\t", -1)
    seen: set[str] = set()
    columns = []
    for i, name in enumerate(names):
        if name not in seen:
            seen.add(name)
            columns.append(nullify(F.try_element_at("cells", F.lit(i + 1)), ["", "NA", "NaN", "NULL", "null"]).alias(name))
    table = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(cells.alias("cells")).select(*columns)
    return require_columns(table, ["gene symbol", "haploinsufficiency score", "triplosensitivity score"])


def read_constraint_tsv(spark: SparkSession, path: str, genes: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Transcript-level constraint (eight named columns, text), restricted to candidate genes."""
    needed = ["gene_id", "transcript", "mane_select", "canonical", "lof.pLI", "lof.oe_ci.upper", "constraint_flags", "gene_flags"]
    table = require_columns(read_delimited(spark, path, "\t"), needed).select(*[F.col(f"`{c}`") for c in needed])
    table = _spread(table.withColumn("gene_id", strip_version("gene_id")), partitions)
    return table if genes is None else table.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def read_legacy_constraint_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Symbol-level constraint with source_line, so that the first row per gene can be told apart."""
    lines = numbered_lines(spark, path)
    header = [c.strip().lower().lstrip("#") for c in _first_line(spark, path).split("\t")]
    header = ["gene_symbol" if c == "gene" else c for c in header]
    for name in ("gene_symbol", "pli", "oe_lof_upper"):
        if name not in header:
            raise ValueError(f"{path}: missing required column: {name}")
    cell = lambda name: F.try_element_at("cells", F.lit(header.index(name) + 1))
    rows = lines.where("in_file > 0 AND trim(value) <> ''").select(F.split("value", "\t", -1).alias("cells"), "line")
    return rows.select(F.trim(cell("gene_symbol")).alias("gene_symbol"), nullify(cell("pli"), ["", "NA"]).alias("pli"),
                       nullify(cell("oe_lof_upper"), ["", "NA"]).alias("oe_lof_upper"), F.col("line").alias("source_line"))


def read_tissue_long(spark: SparkSession, path: str, key: str = "gene") -> DataFrame:
    """Long tissue expression: gene, gene_name, tissue, ntpm; a non-numeric value fails the read."""
    table = require_columns(read_delimited(spark, path, "\t", lower=True), [key, "tissue", "ntpm"])
    keep = [c for c in ("gene", "gene name") if c in table.columns]
    return table.select(*[F.col(c).alias(c.replace(" ", "_")) for c in keep], F.trim("tissue").alias("tissue"),
                        F.col("ntpm").cast("double").alias("ntpm"))


def read_inheritance(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``records``: header found by its named columns; ``modes``: prepared GeneSymbol/ModeOfInheritance."""
    if kind == "modes":
        return require_columns(read_delimited(spark, path, "\t"), ["GeneSymbol", "ModeOfInheritance"])
    if kind != "records":
        raise ValueError("kind must be records or modes")
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"))
    header = lines.where(F.col("value").contains("\tPhenotypes\t") & F.col("value").contains("Approved Gene Symbol")).first()
    if header is None:
        raise ValueError(f"{path}: missing named Phenotypes/Approved Gene Symbol columns")
    names = [c.lstrip("#").strip() for c in header["value"].split("\t")]
    body = lines.where((F.col("value") != header["value"]) & ~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = body.select(F.split("value", "\t", -1).alias("cells"))
    return cells.select(*[nullify(F.try_element_at("cells", F.lit(i + 1)), [""]).alias(n) for i, n in enumerate(names)])


def read_ai_scores(spark: SparkSession, path: str, score: str = "DeepLOF_score") -> DataFrame:
    """Score table keyed by Ensembl id; every score must be a finite number in [0, 1]."""
    table = require_columns(read_delimited(spark, path), ["ensembl", "gene_symbol", score])
    table = table.withColumn("_row", F.concat_ws(" ", "ensembl", F.coalesce(score, F.lit("")))).withColumn(score, number(score))
    return check(table, [in_range(score, 0, 1, allow_null=False)], "_row").drop("_row")


def read_viability(spark: SparkSession, path: str) -> DataFrame:
    """Mouse viability annotations: all six fields filled, one row per gene, known statuses."""
    needed = ["gene_id", "mouse_gene_id", "impc_viability", "source", "release", "mapping_source"]
    table = require_columns(read_delimited(spark, path, "\t"), needed).select(*needed)
    rules = [unique("gene_id"), *non_empty(*needed), one_of("impc_viability", ["viable", "subviable", "lethal", "unknown"])]
    return check(table, rules, "gene_id")


def read_association_snapshot(spark: SparkSession, path: str, disease_id: str | None = None,
                              release: str | None = None) -> DataFrame:
    """Association snapshot (one JSON document) as gene_id, record rows; request mismatches are errors."""
    schema = f"release STRING, disease_id STRING, phenotype_ids ARRAY<STRING>, records MAP<STRING, {SNAPSHOT_RECORD}>"
    table = spark.read.schema(schema).option("multiLine", True).json(path)
    wrong = F.lit(False)
    for column, value in (("disease_id", disease_id), ("release", release)):
        if value is not None:
            wrong = wrong | ~F.col(column).eqNullSafe(F.lit(value))
    if table.where(wrong).limit(1).count():
        raise ValueError("association snapshot disease or release mismatch")
    return table.select(F.explode("records").alias("gene_id", "record"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- inputs
def read_interval_table(spark: SparkSession, path: str, fmt: str, coordinates: str | None = None,
                        columns: Sequence[str] = ("chrom", "start", "end")) -> DataFrame:
    """All intervals of a BED, CSV, TSV or region file, one case_id per row, with interval or reject_reason.

    BED is 0-based half-open; CSV/TSV need declared coordinates; region files are keyed by region id.
    """
    if fmt == "bed":
        if coordinates not in (None, ZERO_BASED):
            raise ValueError("BED requires 0-based-half-open coordinates")
        lines = numbered_lines(spark, path).withColumn("value", F.trim("value"))
        rows = lines.where((F.col("value") != "") & ~F.col("value").rlike("^(#|track |browser )"))
        cells = rows.select("line", F.split("value", r"\s+").alias("cells"))
        raw = cells.select(F.col("line").cast("string").alias("case_id"), *[
            F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(("chrom", "start", "end"))])
        system = ZERO_BASED
    elif fmt in ("csv", "tsv"):
        if coordinates not in (ZERO_BASED, ONE_BASED):
            raise ValueError("table intervals require declared coordinates; they are never guessed")
        if len(set(columns)) != 3:
            raise ValueError("chromosome, start and end columns must be distinct")
        sep = "," if fmt == "csv" else "\t"
        header = [c.strip() for c in _first_line(spark, path).split(sep)]
        if len(set(header)) != len(header) or not set(columns) <= set(header):
            raise ValueError(f"duplicate or missing columns: {header}")
        rows = numbered_lines(spark, path).where("in_file > 0 AND trim(value) <> ''")
        cells = rows.select("line", F.from_csv("value", ", ".join(f"_c{i} STRING" for i in range(len(header))),
                                               {"sep": sep}).alias("cells"))
        raw = cells.select(F.col("line").cast("string").alias("case_id"), *[
            F.trim(F.col(f"cells._c{header.index(c)}")).alias(n) for c, n in zip(columns, ("chrom", "start", "end"))])
        system = coordinates
    elif fmt == "regions":
        lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"))
        header = lines.where(F.col("value").startswith("#ISCA ID\t")).first()
        build = lines.where(F.col("value").startswith("#") & F.col("value").contains("Genomic Locations are reported on GRCh38"))
        if header is None or build.limit(1).count() == 0:
            raise ValueError("expected a region table with an explicit GRCh38 header")
        names = header["value"].split("\t")
        if not {"#ISCA ID", "ISCA Region Name", "Genomic Location"} <= set(names):
            raise ValueError("the region table is missing required columns")
        cells = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t", -1).alias("cells"))
        cell = lambda n: F.try_element_at("cells", F.lit(names.index(n) + 1))
        place = F.coalesce(cell("Genomic Location"), F.lit(""))
        part = lambda i: F.regexp_extract(place, r"^([^:]+):([0-9]+)-([0-9]+)$", i)
        raw = cells.select(cell("#ISCA ID").alias("case_id"), cell("ISCA Region Name").alias("region_name"),
                           part(1).alias("chrom"), part(2).alias("start"), part(3).alias("end"))
        system = ONE_BASED
    else:
        raise ValueError(f"unknown interval format: {fmt}")
    return normalize_interval(raw, F.lit(system))


def read_gene_list(spark: SparkSession, path: str, fmt: str, column: str | None = None) -> DataFrame:
    """Gene identifiers, one per row; empty lists, duplicates and bad syntax are errors."""
    if fmt == "txt":
        if column:
            raise ValueError("a txt list has no header")
        labels = numbered_lines(spark, path).select(F.trim("value").alias("label")).where("label <> ''")
    elif fmt in ("csv", "tsv"):
        header = [c.strip() for c in _first_line(spark, path).split("," if fmt == "csv" else "\t")]
        if not column or len(set(header)) != len(header) or column not in header:
            raise ValueError(f"missing column {column!r} or repeated header: {header}")
        table = read_delimited(spark, path, "," if fmt == "csv" else "\t")
        labels = table.select(F.trim(F.coalesce(F.col(column), F.lit(""))).alias("label"))
    else:
        raise ValueError(f"unknown gene list format: {fmt}")
    if labels.limit(1).count() == 0:
        raise ValueError("gene list is empty")
    return check(labels, [gene_id_syntax("label"), unique("label")], "label")
