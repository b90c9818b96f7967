"""Interval parsing, interval-gene range joins, overlap fractions and block union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chrom_name, chrom_rank, column
from ..scale import OrderedGroups, position

# Names of the two accepted coordinate systems.
ZERO_BASED = "0-based-half-open"
ONE_BASED = "1-based-inclusive"


def normalize_interval(df: DataFrame, coordinates: Column | str, chrom: str = "chrom", start: str = "start",
                       end: str = "end") -> DataFrame:
    """Text coordinates to ``interval`` (``chrN:start-end``, 1-based inclusive) or a ``reject_reason``.

    Bad rows are kept with a reason instead of failing the whole cohort.
    """
    coordinates = column(coordinates)
    name = F.regexp_replace(F.trim(F.col(chrom)), "^chr", "")
    first = F.when(F.col(start).rlike("^[0-9]+$"), F.col(start).try_cast("bigint"))
    last = F.when(F.col(end).rlike("^[0-9]+$"), F.col(end).try_cast("bigint"))
    first = F.when(coordinates == ZERO_BASED, first + 1).otherwise(first)
    reason = (F.when(~F.coalesce(name.rlike("^([1-9]|1[0-9]|2[0-2]|X|Y)$"), F.lit(False)), "unsupported_chromosome")
              .when(first.isNull() | last.isNull(), "non_integer_coordinates")
              .when(~F.coalesce(coordinates.isin(ZERO_BASED, ONE_BASED), F.lit(False)), "unknown_coordinate_system")
              .when((first < 1) | (first > last), "empty_or_reversed"))
    text = F.concat(F.lit("chr"), name, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))
    return df.withColumn("reject_reason", reason).withColumn(
        "interval", F.when(F.col("reject_reason").isNull(), text))


def parse_interval(interval: Column | str) -> Column:
    """``chrN:start-end`` text to STRUCT<chrom,start,end>; NULL when it does not match or is reversed."""
    interval = column(interval)
    pattern = r"^(?:chr)?([1-9][0-9]?|X|Y):([0-9]+)-([0-9]+)$"
    first = F.regexp_extract(interval, pattern, 2).try_cast("bigint")
    last = F.regexp_extract(interval, pattern, 3).try_cast("bigint")
    parsed = F.struct(F.concat(F.lit("chr"), F.regexp_extract(interval, pattern, 1)).alias("chrom"),
                      first.alias("start"), last.alias("end"))
    return F.when(interval.rlike(pattern) & (first >= 1) & (first <= last), parsed)


def overlap_class(inner_start: str, inner_end: str, outer_start: str, outer_end: str) -> Column:
    """``full`` when the outer interval contains the inner one, else ``partial``."""
    contained = (F.col(outer_start) <= F.col(inner_start)) & (F.col(inner_end) <= F.col(outer_end))
    return F.when(contained, "full").otherwise("partial")


def _binned(df: DataFrame, chrom: str, start: str, end: str, width: int, tag: str) -> DataFrame:
    first = F.floor(F.col(start) / width)
    return (df.where(F.col(start) <= F.col(end))
            .withColumn(f"_chrom{tag}", chrom_name(chrom))
            .withColumn(f"_first{tag}", first)
            .withColumn(f"_bin{tag}", F.explode(F.sequence(first, F.floor(F.col(end) / width)))))


def range_join(left: DataFrame, right: DataFrame, left_span: Sequence[str], right_span: Sequence[str],
               bin_width: int) -> DataFrame:
    """Inner join of overlapping spans, ends inclusive; spans are (chrom, start, end) column names.

    Both sides are exploded into fixed-width bins so the join is an equi-join on
    (chromosome, bin): no nested loop, and a crowded chromosome spreads over its bins. A pair
    is kept only in the first bin both spans share, so no de-duplication is needed.
    """
    lc, ls, le = left_span
    rc, rs, re = right_span
    a = _binned(left, lc, ls, le, bin_width, "_l")
    b = _binned(right, rc, rs, re, bin_width, "_r")
    condition = ((F.col("_chrom_l") == F.col("_chrom_r")) & (F.col("_bin_l") == F.col("_bin_r"))
                 & (F.col(le) >= F.col(rs)) & (F.col(ls) <= F.col(re))
                 & (F.col("_bin_l") == F.greatest("_first_l", "_first_r")))
    return a.join(b, condition).drop("_chrom_l", "_chrom_r", "_first_l", "_first_r", "_bin_l", "_bin_r")


def genes_in_intervals(genes: DataFrame, intervals: DataFrame, bin_width: int = 1 << 20) -> DataFrame:
    """Genes overlapping each interval (1-based inclusive), one row per (case_id, gene).

    ``intervals`` has case_id, chrom, start, end; every gene column is kept.
    """
    spans = intervals.select("case_id", F.col("chrom").alias("interval_chrom"),
                             F.col("start").alias("interval_start"), F.col("end").alias("interval_end"))
    joined = range_join(genes, spans, ("chrom", "start", "end"),
                        ("interval_chrom", "interval_start", "interval_end"), bin_width)
    return joined.withColumn("interval_overlap", overlap_class("start", "end", "interval_start", "interval_end"))


def covered_fraction(segment_start: str, segment_end: str, start: str, end: str) -> Column:
    """Share of [start, end] covered by a segment; lengths without +1."""
    shared = F.least(segment_end, end) - F.greatest(segment_start, start)
    return F.greatest(F.lit(0), shared) / F.greatest(F.lit(1), F.col(end) - F.col(start))


def segment_overlap(intervals: DataFrame, segments: DataFrame, key: str = "interval_id",
                    bin_width: int = 1 << 20) -> DataFrame:
    """Best covered fraction of every known interval over all segments (0.0 when none overlaps)."""
    parts = segments.select(F.col("chrom").alias("_sc"), F.col("start").alias("_ss"), F.col("end").alias("_se"))
    hits = range_join(intervals.select(key, "chrom", "start", "end"), parts, ("chrom", "start", "end"),
                      ("_sc", "_ss", "_se"), bin_width)
    best = hits.groupBy(key).agg(F.max(covered_fraction("_ss", "_se", "start", "end")).alias("best_overlap"))
    return intervals.join(best, key, "left").withColumn("best_overlap", F.coalesce("best_overlap", F.lit(0.0)))


def merge_blocks(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end",
                 split: bool | None = None) -> DataFrame:
    """Union of overlapping or adjacent blocks (start <= previous end + 1) inside each group."""
    blocks = (OrderedGroups(df.select(*by, start, end), by, [start, end], split)
              .running("_reach", F.col(end), how="max", inclusive=False))
    opens = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + 1), 1).otherwise(0)
    numbered = blocks.running("_block", opens, peers=True).frame()
    return (numbered.groupBy(*by, "_block").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_block"))


def genomic_order(df: DataFrame, name: str = "genomic_at") -> DataFrame:
    """1-based place of every gene by chromosome rank, start and id; genes off the main chromosomes come last. Spread over tasks."""
    return position(df, [], [F.asc_nulls_last(chrom_rank("chrom")), F.asc("start"), F.asc("gene_id")], name)
