"""Writers; existing output is refused unless a mode is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.selection import summary_view


def write_evidence(df: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Evidence parquet, spread over ``buckets`` folders by a hash of the case so reads of few cases prune."""
    bucket = F.pmod(F.xxhash64("case_id"), F.lit(buckets))
    df.withColumn("case_bucket", bucket).write.mode(mode).partitionBy("case_bucket").parquet(path)


def read_cases(spark: SparkSession, path: str, cases: Sequence, buckets: int = 64) -> DataFrame:
    """Evidence of some cases: only the folders of their buckets are listed and read. ``buckets`` is that of ``write_evidence``."""
    kind = spark.read.parquet(path).schema["case_id"].dataType
    wanted = spark.createDataFrame([(c,) for c in cases], T.StructType([T.StructField("case_id", kind)]))
    # As many rows as cases are asked for.
    places = [r[0] for r in wanted.select(F.pmod(F.xxhash64("case_id"), F.lit(buckets))).distinct().collect()]
    rows = spark.read.parquet(path).where(F.col("case_bucket").isin(places))
    return rows.join(F.broadcast(wanted), "case_id", "left_semi").drop("case_bucket")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for text sinks."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_ranked(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Full-width ranked table; rows of a case stay in rank order inside their file."""
    ordered = df.repartitionByRange("case_id", "rank").sortWithinPartitions("case_id", "rank")
    if fmt == "csv":
        flat(ordered).write.mode(mode).option("header", True).csv(path)
    else:
        ordered.write.mode(mode).parquet(path)


def write_candidates(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).option("header", True).csv(path)


def write_summary(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The fixed 16-column summary, same rows and order as the ranked table."""
    summary = summary_view(ranked).repartitionByRange("case_id", "rank").sortWithinPartitions("case_id", "rank")
    flat(summary).write.mode(mode).option("header", True).csv(path)
