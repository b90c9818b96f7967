"""Column expressions for missing values, identifiers and small text clean-ups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chromosome order of the human assembly.
CHROMOSOMES = ["chr1", "chr2", "chr3", "chr4", "chr5", "chr6", "chr7", "chr8", "chr9", "chr10", "chr11", "chr12",
               "chr13", "chr14", "chr15", "chr16", "chr17", "chr18", "chr19", "chr20", "chr21", "chr22", "chrX", "chrY"]


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL: missing evidence has one representation."""
    c = column(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def number(c: Column | str) -> Column:
    """Text to double; anything that is not a finite number becomes NULL."""
    return finite(column(c).cast("string").try_cast("double"))


def nullify(c: Column | str, tokens: Iterable[str]) -> Column:
    """Trimmed text with every listed token replaced by NULL."""
    c = F.trim(column(c))
    return F.when(~c.isin(*tokens), c)


def blank_to_null(c: Column | str) -> Column:
    return nullify(c, [""])


def strip_version(c: Column | str) -> Column:
    return F.split(column(c), r"\.")[0]


def unquote(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(column(c)), r'^"(.*)"$', "$1")


def chrom_name(c: Column | str) -> Column:
    """Prefix-tolerant chromosome name."""
    c = F.trim(column(c).cast("string"))
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def chrom_rank(c: Column | str) -> Column:
    """1-based genome order, NULL outside the main chromosomes."""
    names = F.array(*[F.lit(x) for x in CHROMOSOMES])
    at = F.array_position(names, column(c))
    return F.when(at > 0, at)


def fixed(c: Column | str, digits: int = 6) -> Column:
    return F.round(column(c), digits)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Like ``fixed`` for doubles, in floating-point steps (ties to even): rounding by decimals costs about half a microsecond a value."""
    return F.rint(column(c) * 10.0 ** digits) / 10.0 ** digits + 0.0


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation aggregate; NULL instead of an error when a side is constant."""
    spread = F.stddev_pop(column(x)) * F.stddev_pop(column(y))
    return F.try_divide(F.covar_pop(column(x), column(y)), F.nullif(spread, F.lit(0.0)))
