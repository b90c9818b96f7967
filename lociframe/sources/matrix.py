"""10x MatrixMarket triples to long counts, one or many samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expectations import check, non_empty, unique, whole_count
from .tables import numbered_lines


@dataclass(frozen=True)
class Matrix:
    """Long counts (cell_id, gene_id, count) with their gene and cell dimensions."""
    counts: DataFrame
    genes: DataFrame
    cells: DataFrame


def _dimension(spark: SparkSession, path: str, names: Sequence[str], fields: Sequence[int]) -> DataFrame:
    rows = numbered_lines(spark, path).withColumn("cells", F.split("value", "\t", -1))
    wrong = rows.where(~F.size("cells").isin(*fields)).limit(1).count()
    if wrong or rows.limit(1).count() == 0:
        raise ValueError(f"{path}: expected non-empty rows with {' or '.join(map(str, fields))} fields")
    return rows.select((F.col("line") + 1).alias("idx"), *[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def _padded(column: str):
    return F.col(column) != F.trim(F.col(column))


def read_10x(spark: SparkSession, matrix: str, features: str, barcodes: str, strict: bool = True) -> Matrix:
    """Read one 10x triple.

    Dimensions must match the feature and barcode lists; entries are finite non-negative integers
    without repeated coordinates; only ``Gene Expression`` features are accepted. ``strict=False``
    skips the entry checks for data already validated once.
    """
    genes = _dimension(spark, features, ("gene_id", "symbol", "type"), (2, 3))
    cells = _dimension(spark, barcodes, ("barcode",), (1,))
    if genes.where("type IS NOT NULL AND type <> 'Gene Expression'").limit(1).count():
        raise ValueError(f"{features}: only Gene Expression features are supported")
    if genes.where(_padded("gene_id") | _padded("symbol")).limit(1).count() or cells.where(_padded("barcode")).limit(1).count():
        raise ValueError("missing or whitespace-padded identifier")
    check(genes, [unique("gene_id"), *non_empty("gene_id", "symbol")], "idx")
    check(cells, [unique("barcode"), *non_empty("barcode")], "idx")

    lines = spark.read.text(matrix).select(F.trim(F.col("value")).alias("value"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("file"))
    banner = lines.where("block = 0 AND value LIKE '\\%\\%MatrixMarket%'").first()
    if banner is None or "coordinate" not in banner["value"].lower() or "general" not in banner["value"].lower():
        raise ValueError(f"{matrix}: expected a general coordinate MatrixMarket file")
    body = lines.where("value <> '' AND NOT value LIKE '\\%%'").select("value", "block", "file", F.monotonically_increasing_id().alias("at"))
    # The size line follows the banner; further files hold entries only.
    size_line = body.where((F.col("block") == 0) & (F.col("file") == banner["file"])).agg(F.min_by("value", "at").alias("v"), F.min("at").alias("at")).first()
    if size_line["v"] is None:
        raise ValueError(f"{matrix}: missing size line")
    n_genes, n_cells, n_entries = (int(x) for x in size_line["v"].split())
    found = (genes.count(), cells.count())
    if found != (n_genes, n_cells):
        raise ValueError(f"matrix dimensions {(n_genes, n_cells)} do not match genes/barcodes {found}")
    parts = F.split("value", r"\s+")
    entries = body.where(F.col("at") != size_line["at"]).select(
        parts[0].cast("bigint").alias("gene_idx"), parts[1].cast("bigint").alias("cell_idx"), parts[2].cast("double").alias("count"))
    if strict:
        totals = entries.agg(F.count(F.lit(1)).alias("n"), F.min("gene_idx").alias("g0"), F.max("gene_idx").alias("g1"),
                             F.min("cell_idx").alias("c0"), F.max("cell_idx").alias("c1")).first()
        if totals["n"] != n_entries:
            raise ValueError(f"{matrix}: {totals['n']} entries instead of {n_entries}")
        if totals["n"] and (totals["g0"] < 1 or totals["g1"] > n_genes or totals["c0"] < 1 or totals["c1"] > n_cells):
            raise ValueError(f"{matrix}: coordinate outside the matrix")
        check(entries.withColumn("key", F.concat_ws(",", "gene_idx", "cell_idx")),
              [whole_count("count"), unique("gene_idx", "cell_idx")], "key")
    counts = (entries.where("count > 0")
              .join(genes.select(F.col("idx").alias("gene_idx"), "gene_id"), "gene_idx")
              .join(cells.select(F.col("idx").alias("cell_idx"), F.col("barcode").alias("cell_id")), "cell_idx")
              .select("cell_id", "gene_id", "count"))
    return Matrix(counts, genes.select("gene_id", "symbol", F.col("idx").alias("gene_idx")),
                  cells.select(F.col("barcode").alias("cell_id")))


def read_samples(spark: SparkSession, samples: Sequence[Mapping[str, str]], strict: bool = True) -> Matrix:
    """Several samples (id, group, matrix, features, barcodes) as one matrix.

    The cell key is sample and barcode; feature lists must agree in id, symbol and order.
    """
    ids = [s["id"] for s in samples]
    if not ids or len(set(ids)) != len(ids) or any(not i.strip() for i in ids):
        raise ValueError("samples need unique, non-empty ids")
    merged: Matrix | None = None
    for sample in samples:
        one = read_10x(spark, sample["matrix"], sample["features"], sample["barcodes"], strict)
        key = F.concat_ws(":", F.lit(sample["id"]), F.col("cell_id"))
        counts = one.counts.select(F.lit(sample["id"]).alias("sample_id"), key.alias("cell_id"), "gene_id", "count")
        cells = one.cells.select(F.lit(sample["id"]).alias("sample_id"), key.alias("cell_id"),
                                 F.col("cell_id").alias("barcode"), F.lit(sample["group"]).alias("group"))
        if merged is None:
            merged = Matrix(counts, one.genes, cells)
            continue
        if one.genes.exceptAll(merged.genes).limit(1).count() or merged.genes.exceptAll(one.genes).limit(1).count():
            raise ValueError(f"sample {sample['id']}: gene identity or order differs from sample {ids[0]}")
        merged = Matrix(merged.counts.unionByName(counts), merged.genes, merged.cells.unionByName(cells))
    return merged
