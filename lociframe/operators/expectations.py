"""Declarative data-quality rules: each contract becomes a rule that reports offending keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CHROMOSOMES


@dataclass(frozen=True)
class RowRule:
    """``bad`` is true on rows that break the rule."""
    name: str
    bad: Column


@dataclass(frozen=True)
class UniqueRule:
    """No two rows share the columns (NULL keys are not compared)."""
    name: str
    columns: tuple[str, ...]


def unique(*columns: str) -> UniqueRule:
    return UniqueRule(f"unique({','.join(columns)})", columns)


def _failed(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def matches(column: str, pattern: str) -> RowRule:
    return RowRule(f"syntax({column})", _failed(F.col(column).rlike(pattern)))


GENE_ID = r"^(?:HGNC:[0-9]+|[A-Za-z0-9][A-Za-z0-9_.-]*)$"


def gene_id_syntax(column: str) -> RowRule:
    return matches(column, GENE_ID)


def one_of(column: str, values: Sequence, allow_null: bool = False) -> RowRule:
    ok = F.col(column).isin(*values)
    return RowRule(f"enum({column})", _failed(ok | F.col(column).isNull() if allow_null else ok))


def non_empty(*columns: str) -> list[RowRule]:
    return [RowRule(f"non_empty({c})", _failed(F.length(F.trim(F.col(c).cast("string"))) > 0)) for c in columns]


def in_range(column: str, low: float | None = None, high: float | None = None, allow_null: bool = True) -> RowRule:
    """Finite number inside [low, high]."""
    value = F.col(column).cast("double")
    ok = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return RowRule(f"range({column})", _failed(value.isNull() | ok if allow_null else ok))


def whole_count(column: str) -> RowRule:
    """Finite, non-negative integer."""
    value = F.col(column).cast("double")
    return RowRule(f"count({column})", _failed(~F.isnan(value) & (value >= 0) & (value < 2 ** 53) & (value == F.floor(value))))


def coordinates(chrom: str = "chrom", start: str = "start", end: str = "end",
                chromosomes: Sequence[str] | None = tuple(CHROMOSOMES)) -> RowRule:
    ok = (F.col(start) >= 0) & (F.col(end) >= F.col(start))
    if chromosomes is not None:
        ok = ok & F.col(chrom).isin(*chromosomes)
    return RowRule(f"coordinates({chrom},{start},{end})", _failed(ok))


def sums_to(parts: Sequence[str], total: str, tolerance: float = 1e-9) -> RowRule:
    """The parts add up to the total."""
    added = F.lit(0.0)
    for part in parts:
        added = added + F.coalesce(F.col(part), F.lit(0.0))
    return RowRule(f"sum({total})", _failed(F.abs(added - F.col(total)) <= tolerance))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def violations(df: DataFrame, rules: Sequence[RowRule | UniqueRule], key: str) -> DataFrame:
    """Long table (rule, key, n): all row rules in one pass, one partial aggregation per unique rule."""
    row_rules = [r for r in rules if isinstance(r, RowRule)]
    found = None
    if row_rules:
        broken = F.filter(F.array(*[F.when(r.bad, r.name) for r in row_rules]), lambda x: x.isNotNull())
        found = (df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))
                 .groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")))
    for rule in rules:
        if isinstance(rule, UniqueRule):
            present = F.lit(True)
            for c in rule.columns:
                present = present & F.col(c).isNotNull()
            copies = (df.where(present).groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select(F.lit(rule.name).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in rule.columns]).alias("key"), "n"))
            found = copies if found is None else found.unionByName(copies)
    return found


def check(df: DataFrame, rules: Sequence[RowRule | UniqueRule], key: str) -> DataFrame:
    """Strict mode: raise with the first ten offending keys, else return the table unchanged."""
    first = violations(df, rules, key).orderBy("rule", "key").limit(10).collect()
    if first:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in first))
    return df


def keep_good(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """Rows that break no row rule."""
    for rule in rules:
        df = df.where(~rule.bad)
    return df


def groups_present(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """One row per required group with its row count and whether it is missing."""
    counts = df.where(F.col(group).isin(*values)).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{group} string")
    return wanted.join(counts, group, "left").select(
        group, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.col("n").isNull().alias("missing"))


def ranks_complete(ranked: DataFrame, by: Sequence[str] = ("case_id",), rank: str = "rank") -> DataFrame:
    """Groups whose ranks are not exactly 1..n (given unique ranks: smallest 1, largest n, right sum)."""
    stats = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("_lo"), F.max(rank).alias("_hi"),
                                    F.sum(rank).alias("_sum"), F.sum(F.col(rank) * F.col(rank)).alias("_squares"))
    n = F.col("n")
    good = ((F.col("_lo") == 1) & (F.col("_hi") == n) & (F.col("_sum") * 2 == n * (n + 1))
            & (F.col("_squares") * 6 == n * (n + 1) * (2 * n + 1)))
    return stats.where(~good).select(*by, "n")


def candidate_difference(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys lost or added between two tables; empty when the candidate set is preserved."""
    a = before.groupBy(*key).agg(F.count(F.lit(1)).alias("_a"))
    b = after.groupBy(*key).agg(F.count(F.lit(1)).alias("_b"))
    change = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "added").otherwise("count_changed")
    joined = a.join(b, list(key), "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select(*key, change.alias("change"))
