"""Helpers that keep plans safe when one key holds a large share of the rows.

Every ordered operator of the package goes through :class:`OrderedGroups`. Groups that fit
one task use an ordinary window. When the measured largest group is over the limit the rows
are range-partitioned on (group, order), so a hot group spreads over many tasks, and the
per-partition totals are added back as offsets.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Rows of one group that a single window task may sort (it spills beyond executor memory).
GROUP_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where a local session has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder configured for the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of a plain table that one task of a wide step takes.
TASK_ROWS = 1_000_000


def task_count(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for a step over so many rows: the session's number, more where a task would have over ``each`` of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt(df: DataFrame, rows: int, by: Sequence[str], each: int = TASK_ROWS) -> DataFrame:
    """The table dealt by its keys over more tasks than the session's number, where one of those would have over ``each`` of so many rows."""
    n = task_count(df.sparkSession, rows, each)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the biggest group; map-side combined, one small row reaches the driver."""
    if not by:
        return df.count()
    biggest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return biggest["n"] or 0


def is_hot(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    return largest_group(df, by) > (GROUP_ROWS if limit is None else limit)


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], blocks: int = 64) -> DataFrame:
    """Every left row with every right row where the result itself is that dense table.

    Right rows are dealt into blocks by their keys and each left row visits every block, so neither side becomes a
    literal or passes through one task.
    """
    dealt = right.withColumn("__block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    visits = left.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return visits.join(dealt, "__block").drop("__block")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on columns where NULL groups with NULL, keeping only the left key columns."""
    renamed = right.select(*[F.col(c).alias(f"__right_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"__right_{c}"])
    return left.join(renamed, condition, how).drop(*[f"__right_{c}" for c in on])


def heavy_keys(df: DataFrame, on: Sequence[str], limit: int = GROUP_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows; map-side combined, and at most rows / ``limit`` of them."""
    return df.where(_all_present(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")


def _all_present(on: Sequence[str]) -> Column:
    present = F.lit(True)
    for c in on:
        present = present & F.col(c).isNotNull()
    return present


def dictionary_join(left: DataFrame, right: DataFrame, on: Sequence[str], heavy: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """Left join with a table of few rows a key, safe for a left side of which most rows have no key or one key.

    Rows with a NULL among the keys match nothing; a plain join would send them all to one task, here they are dealt over ``salts``
    key values of their own. Rows of a key in ``heavy`` (``heavy_keys``) are dealt the same way and their dictionary rows are repeated.
    """
    on = list(on)
    dealt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    loose = ~_all_present(on)
    if heavy is not None:
        # Bounded by the rows of the left side over the limit that makes a key heavy.
        marks = F.broadcast(heavy.select(*on, F.lit(True).alias("_heavy")))
        left, right = left.join(marks, on, "left"), right.join(marks, on, "left")
        loose = loose | F.col("_heavy").isNotNull()
        places = F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        right = right.withColumn("_salt", F.explode(places)).drop("_heavy")
    else:
        # Always 0, but not a literal, which the optimizer would take out of the join keys.
        right = right.withColumn("_salt", F.pmod(F.xxhash64(*on), F.lit(1)).cast("int"))
    left = left.withColumn("_salt", F.when(loose, dealt).otherwise(0))
    return left.join(right, [*on, "_salt"], "left").drop("_salt", "_heavy")


def with_group_stats(df: DataFrame, by: Sequence[str], aggregates: dict[str, Column], split: bool) -> DataFrame:
    """Attach per-group aggregates to every row.

    Small groups share the window's single shuffle with later windows on the same key; hot
    groups use a pre-aggregated table and a join whose big side AQE may split.
    """
    if not aggregates:
        return df
    if not split:
        window = W.partitionBy(*by)
        return df.withColumns({name: agg.over(window) for name, agg in aggregates.items()})
    stats = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return null_safe_join(df, stats, by)


def _split(df: DataFrame, by: Sequence[str], split: bool | None, limit: int | None) -> bool:
    """A given answer, a measured one, or by default: a whole table without keys is spread, groups are not."""
    if split is None:
        return not by if limit is None else is_hot(df, by, limit)
    return split


class OrderedGroups:
    """Running totals and positions inside groups, without one task per hot group.

    ``order`` must be a total order inside a group (ties give any of the equal rows).
    ``split=True`` spreads a group over many tasks, ``split=False`` (the default where there are keys) uses one window per group; measure once
    per run with ``is_hot`` and pass the answer. Without keys the whole table is one group and is spread by default. Only a given
    ``limit`` without ``split`` measures here. The rows are the same either way.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                 split: bool | None = None, limit: int | None = None):
        self.by = list(by)
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.split = _split(df, by, split, limit)
        if self.split:
            placed = df.repartitionByRange(*[F.col(c) for c in self.by], *self.order)
            df = checkpoint(placed.withColumn("_piece", F.spark_partition_id()))
        self.df = df

    def running(self, name: str, value: Column, how: str = "sum", inclusive: bool = True,
                peers: bool = False) -> "OrderedGroups":
        """Add a running sum or max of ``value``; NULL before the first row when exclusive.

        ``peers=True`` gives rows with equal order keys the same (inclusive) value, so a result
        that depends on an earlier running column does not depend on how ties are arranged.
        """
        fold = {"sum": F.sum, "max": F.max}[how]
        last = W.currentRow if inclusive else -1
        keys = self.by + (["_piece"] if self.split else [])
        ordered = W.partitionBy(*keys).orderBy(*self.order)
        frame = ordered.rangeBetween if peers else ordered.rowsBetween
        window = frame(W.unboundedPreceding, last)
        if not self.split:
            self.df = self.df.withColumn(name, fold(value).over(window))
            return self
        totals = self.df.groupBy(*keys).agg(fold(value).alias("_total"))
        before = W.partitionBy(*self.by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        # At most one carried-in group per range partition, so this side is bounded.
        carried = (totals.withColumn("_carried", fold("_total").over(before))
                   .where(F.col("_carried").isNotNull()).drop("_total"))
        local = self.df.withColumn("_local", fold(value).over(window))
        joined = null_safe_join(local, F.broadcast(carried), keys)
        if how == "sum":
            total = F.when(F.col("_local").isNull() & F.col("_carried").isNull(), F.lit(None)).otherwise(
                F.coalesce("_local", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
        else:
            total = F.greatest("_local", "_carried")
        self.df = joined.withColumn(name, total).drop("_local", "_carried")
        return self

    def position(self, name: str) -> "OrderedGroups":
        """1-based position in the group's order."""
        if not self.split:
            window = W.partitionBy(*self.by).orderBy(*self.order)
            self.df = self.df.withColumn(name, F.row_number().over(window).cast("bigint"))
            return self
        return self.running(name, F.lit(1).cast("bigint"))

    def frame(self) -> DataFrame:
        return self.df.drop("_piece")


def position(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str,
             split: bool | None = None, limit: int | None = None) -> DataFrame:
    return OrderedGroups(df, by, order, split, limit).position(name).frame()


# Largest k for which Spark itself cuts rows per map task (its windowGroupLimitThreshold default).
MAP_SIDE_K = 1000


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int,
          name: str = "position", salts: int = 256) -> DataFrame:
    """First ``k`` rows of every group, without sorting a hot group in one task.

    The filter on the window's own rank lets Spark keep only k rows per group and map task before
    the shuffle. Beyond Spark's threshold for that rule, salted sub-groups are cut to k first.
    """
    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    if k > MAP_SIDE_K:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in by]), F.lit(salts))
        inner = W.partitionBy(*by, "_salt").orderBy(*sort)
        df = df.withColumn("_salt", salt).withColumn(name, F.row_number().over(inner)).where(F.col(name) <= k).drop("_salt", name)
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*sort))).where(F.col(name) <= k)
    return ranked.withColumn(name, F.col(name).cast("bigint"))


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str,
                 split: bool | None = None, limit: int | None = None) -> DataFrame:
    """Ascending rank where ties share their mean rank; NULL stays NULL and is not counted."""
    if not _split(df, by, split, limit):
        ordered = W.partitionBy(*by).orderBy(F.asc_nulls_last(value))
        peers = W.partitionBy(*by, value)
        rank = F.rank().over(ordered) + (F.count(value).over(peers) - 1) / 2.0
        return df.withColumn(name, F.when(F.col(value).isNotNull(), rank.cast("double")))
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_peers"))
    ranked = OrderedGroups(counted, by, [F.col(value)], split=True).running("_upto", F.col("_peers")).frame()
    ranked = ranked.select(*by, value, (F.col("_upto") - (F.col("_peers") - 1) / 2.0).cast("double").alias(name))
    return null_safe_join(df, ranked, [*by, value]).withColumn(
        name, F.when(F.col(value).isNotNull(), F.col(name)))


def descending_rank(df: DataFrame, by: Sequence[str], value: str, name: str,
                    split: bool | None = None, limit: int | None = None) -> DataFrame:
    """Competition rank, largest value first (ties share the lowest rank)."""
    if not _split(df, by, split, limit):
        return df.withColumn(name, F.rank().over(W.partitionBy(*by).orderBy(F.desc(value))).cast("bigint"))
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_peers"))
    ranked = OrderedGroups(counted, by, [F.desc(value)], split=True).running("_upto", F.col("_peers")).frame()
    ranked = ranked.select(*by, value, (F.col("_upto") - F.col("_peers") + 1).cast("bigint").alias(name))
    return null_safe_join(df, ranked, [*by, value])


# Bins of the second histogram, inside one bin of the first.
FINE_BINS = 1 << 12


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """One row per group, columns q0..qn: exact quantiles with linear interpolation, NULL values ignored.

    No group is sorted or held in a map. A first histogram counts sixteenths of an octave, a second one cuts the few bins in which a quantile
    lies into ``FINE_BINS`` parts, and only the distinct values of the parts hit are put in order. All counting is combined on
    the map side; the rows of the bins hit are counted by value, which spreads a hot group. Without keys there is always one row.
    """
    keys = list(by)
    number = F.col("_v").cast("double")
    octave = F.signum(number) * (F.floor(F.log2(F.abs(number)) * 16) + 20_000)
    binned = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).withColumn(
        "_bin", F.when(number == 0, 0).otherwise(octave).cast("bigint"))
    upto = lambda within, order: F.sum("_n").over(W.partitionBy(*within).orderBy(order))
    inside = (F.col("_at") >= F.col("_upto") - F.col("_n")) & (F.col("_at") < F.col("_upto"))
    # A histogram has at most some ten thousand bins a group, so ordering them is cheap.
    coarse = (binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min(number).alias("_low"), F.max(number).alias("_high"))
              .withColumns({"_upto": upto(keys, "_bin"), "_total": F.sum("_n").over(W.partitionBy(*keys))}))
    exact = [F.lit(float(p)) * (F.col("_total") - 1) for p in probabilities]
    asked = F.array(*[F.struct(F.lit(2 * i + side).alias("_q"), F.least(F.floor(x) + side, F.col("_total") - 1).alias("_at"))
                      for i, x in enumerate(exact) for side in (0, 1)])
    places = coarse.select("*", F.inline(asked)).where(inside).withColumn("_at", F.col("_at") - F.col("_upto") + F.col("_n"))
    # Two rows for each group and quantile; written once, as several later steps read them.
    places = checkpoint(places.select(*keys, "_bin", "_low", "_high", "_total", "_q", "_at"))
    hit = places.select(*keys, "_bin", "_low", "_high").distinct()
    span = F.col("_high") - F.col("_low")
    part = F.when(span > 0, F.least(F.lit(FINE_BINS - 1), F.floor((number - F.col("_low")) / span * FINE_BINS))).otherwise(0)
    counted = checkpoint(null_safe_join(binned, hit, [*keys, "_bin"], "inner").withColumn("_part", part.cast("bigint"))
                         .groupBy(*keys, "_bin", "_part", "_v").agg(F.count(F.lit(1)).alias("_n")))
    fine = counted.groupBy(*keys, "_bin", "_part").agg(F.sum("_n").alias("_n")).withColumn("_upto", upto([*keys, "_bin"], "_part"))
    narrow = null_safe_join(places, fine, [*keys, "_bin"], "inner").where(inside).withColumn("_at", F.col("_at") - F.col("_upto") + F.col("_n"))
    narrow = checkpoint(narrow.select(*keys, "_bin", "_part", "_total", "_q", "_at"))
    few = null_safe_join(counted, narrow.select(*keys, "_bin", "_part").distinct(), [*keys, "_bin", "_part"], "inner")
    few = few.withColumn("_upto", upto([*keys, "_bin", "_part"], "_v"))
    found = null_safe_join(narrow, few, [*keys, "_bin", "_part"], "inner").where(inside)
    at = lambda q: F.max(F.when(F.col("_q") == q, F.col("_v").cast("double")))
    share = lambda p: F.lit(float(p)) * (F.max("_total") - 1) - F.floor(F.lit(float(p)) * (F.max("_total") - 1))
    columns = [(at(2 * i) + (at(2 * i + 1) - at(2 * i)) * share(p)).alias(f"q{i}") for i, p in enumerate(probabilities)]
    return found.groupBy(*keys).agg(*columns) if keys else found.agg(*columns)


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """One row, columns q0..qn: exact quantiles of the whole table, NULL ignored; the table is never sorted in one task."""
    return grouped_quantiles(df, [], value, probabilities)


def session(cpus: int | str = 8, partitions: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    count = partitions or (cpus if isinstance(cpus, int) else 8)
    return (SparkSession.builder.master(f"local[{cpus}]").appName("lociframe")
            .config("spark.sql.shuffle.partitions", str(count))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false")
            .getOrCreate())
