"""Rank statistics, differential tables, permutation tests and attribution summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import correlation
from ..scale import average_rank, checkpoint, exact_quantiles, position, task_count, top_k


def score_quantiles(df: DataFrame, value: str) -> DataFrame:
    """p10, median and p90 with linear interpolation."""
    return exact_quantiles(df, value, [0.1, 0.5, 0.9]).select(
        F.col("q0").alias("p10"), F.col("q1").alias("p50"), F.col("q2").alias("p90"))


# ---------------------------------------------------------------- correlation
def _guarded_corr(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return df.agg(F.count(F.lit(1)).alias("n"), F.when(spread, correlation(x, y)).alias(name))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return _guarded_corr(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, "pearson")


def _ranked(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    for c in columns:
        df = average_rank(df, [], c, f"_r_{c}", limit=limit)
    return df


def spearman(df: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """Pearson correlation of average ranks over complete pairs; NULL when a side is constant."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return _guarded_corr(_ranked(complete, [x, y], limit), f"_r_{x}", f"_r_{y}", "spearman")


def partial_spearman(df: DataFrame, x: str, y: str, z: str, limit: int | None = None) -> DataFrame:
    """Spearman correlation of the residuals of rank(x) and rank(y) after a line on rank(z)."""
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(x, y, z)
    ranked = checkpoint(_ranked(complete, [x, y, z], limit))  # read by the fit and for the residuals
    fit = ranked.agg(*[f(f"_r_{c}", f"_r_{z}").alias(f"{n}{c}") for c in (x, y) for n, f in (
        ("_slope_", F.regr_slope), ("_icept_", F.regr_intercept))])
    line = lambda c: fit.select(f"_slope_{c}").scalar() * F.col(f"_r_{z}") + fit.select(f"_icept_{c}").scalar()
    # Residuals of equal pairs must tie exactly, so float noise is rounded away.
    residuals = ranked.select(F.round(F.col(f"_r_{x}") - line(x), 9).alias("x"), F.round(F.col(f"_r_{y}") - line(y), 9).alias("y"))
    return spearman(residuals, "x", "y", limit).withColumnRenamed("spearman", "partial_spearman")


# ---------------------------------------------------------------- top-k agreement
def _best(df: DataFrame, key: str, value: Column, k: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(value), F.asc(key)).limit(k).select(key)


def recall_at_k(df: DataFrame, key: str, effect: str, score: str, ks: Sequence[int]) -> DataFrame:
    """|top-k by effect and top-k by score| / k for each k."""
    biggest = max(ks)
    numbered = None
    for name, value in (("_e", effect), ("_s", score)):
        top = df.orderBy(F.desc_nulls_last(value), F.asc(key)).limit(biggest).select(key, value)
        top = position(top, [], [F.desc_nulls_last(value), F.asc(key)], name, split=False).select(key, name)
        # A key of one list alone stays: where no key is in both, every k still has its row.
        numbered = top if numbered is None else numbered.join(top, key, "full")
    wanted = F.explode(F.array(*[F.lit(k) for k in ks]))
    hits = numbered.withColumn("k", wanted).groupBy("k").agg(
        F.count_if((F.col("_e") <= F.col("k")) & (F.col("_s") <= F.col("k"))).alias("hits"))
    return hits.select(F.col("k").cast("bigint").alias("k"), (F.col("hits") / F.col("k")).alias("recall"))


def jaccard_top_k(df: DataFrame, key: str, x: str, y: str, k: int = 50) -> DataFrame:
    """Jaccard index of the top-k keys by |x| and by |y|."""
    a = _best(df, key, F.abs(F.col(x)), k).withColumn("_a", F.lit(True))
    b = _best(df, key, F.abs(F.col(y)), k).withColumn("_b", F.lit(True))
    return a.join(b, key, "full").agg(
        (F.count_if(F.col("_a") & F.col("_b")) / F.count(F.lit(1))).alias("jaccard"), F.count(F.lit(1)).alias("n_union"))


def auroc(df: DataFrame, key: str, effect: str, score: str, share: float = 0.1, limit: int | None = None) -> DataFrame:
    """Mann-Whitney area for the top ``share`` of effects as positives; ties count half."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = position(df.select(key, effect, score), [], [F.desc(effect), F.asc(key)], "_at", limit=limit)
    ranked = average_rank(placed, [], score, "_r", limit=limit)
    positive = F.col("_at") <= F.greatest(F.lit(1), F.floor(n * F.lit(share)))
    sums = ranked.agg(F.sum(F.when(positive, F.col("_r"))).alias("_sum"), F.count_if(positive).alias("n_positive"),
                      F.count(F.lit(1)).alias("_n"))
    n_pos, n_neg = F.col("n_positive"), F.col("_n") - F.col("n_positive")
    return sums.select("n_positive", ((F.col("_sum") - n_pos * (n_pos + 1) / 2) / F.nullif(n_pos * n_neg, F.lit(0))).alias("auroc"))


def rank_of_feature(values: DataFrame, targets: DataFrame, by: Sequence[str], feature: str, value: str) -> DataFrame:
    """Number of features with |value| at least that of the group's target feature."""
    mark = values.join(targets, [*by, feature], "left_semi").select(*by, F.col(feature).alias("target"), F.abs(value).alias("_t"))
    return values.join(mark, list(by)).groupBy(*by, "target").agg(
        F.count_if(F.abs(value) >= F.col("_t")).alias("rank"))


# ---------------------------------------------------------------- differential tables
def differential_table(long: DataFrame, group_a: str, group_b: str, feature: str = "feature", value: str = "value",
                       group: str = "group") -> DataFrame:
    """Per feature of a dense long table: group means, difference and effect size (pooled population variance)."""
    is_a, is_b = F.col(group) == group_a, F.col(group) == group_b
    stats = long.where(is_a | is_b).groupBy(feature).agg(
        F.avg(F.when(is_a, F.col(value))).alias("mean_a"), F.avg(F.when(is_b, F.col(value))).alias("mean_b"),
        F.var_pop(F.when(is_a, F.col(value))).alias("_va"), F.var_pop(F.when(is_b, F.col(value))).alias("_vb"))
    diff = F.col("mean_a") - F.col("mean_b")
    return stats.withColumn("diff", diff).withColumn(
        "effect_size", diff / (F.sqrt((F.col("_va") + F.col("_vb")) / 2) + 1e-6)).drop("_va", "_vb")


def off_target_impact(expr: DataFrame, cells: DataFrame, condition: str = "perturbed", control: str = "ctrl",
                      min_cells: int = 10, value: str = "value") -> DataFrame:
    """Per perturbation: sum over other genes of |mean(treated) - mean(control)|, zeros implicit.

    ``cells`` has cell_id and the perturbed gene (or the control label). Genes a perturbation never
    shows contribute their control mean, taken from one total instead of a dense grid.
    """
    sizes = cells.groupBy(condition).agg(F.count(F.lit(1)).alias("n_cells"))
    n_control = sizes.where(F.col(condition) == control).select("n_cells").scalar()
    labelled = expr.join(cells.select("cell_id", condition), "cell_id").groupBy(condition, "gene_id").agg(F.sum(value).alias("_s"))
    base = labelled.where(F.col(condition) == control).select("gene_id", (F.col("_s") / n_control).alias("_c"))
    treated = (labelled.where(F.col(condition) != control).join(sizes.where(F.col("n_cells") >= min_cells), condition)
               .withColumn("_t", F.col("_s") / F.col("n_cells")).join(base, "gene_id", "left")
               .withColumn("_c", F.coalesce("_c", F.lit(0.0))))
    own = F.col("gene_id").cast("string") == F.col(condition).cast("string")
    seen = treated.groupBy(condition, "n_cells").agg(
        F.sum(F.when(own, 0.0).otherwise(F.abs(F.col("_t") - F.col("_c")) - F.col("_c"))).alias("_seen"))
    total = base.agg(F.sum("_c").alias("t")).scalar()
    own_base = base.select(F.col("gene_id").cast("string").alias(condition), F.col("_c").alias("_own"))
    return (sizes.where((F.col(condition) != control) & (F.col("n_cells") >= min_cells))
            .join(seen.drop("n_cells"), condition, "left").join(own_base, condition, "left")
            .select(condition, "n_cells", (F.coalesce("_seen", F.lit(0.0)) + F.coalesce(total, F.lit(0.0))
                                           - F.coalesce("_own", F.lit(0.0))).alias("impact")))


def diff_expression(expr: DataFrame, cells: DataFrame, genes: DataFrame, condition: str = "perturbed", control: str = "ctrl",
                    min_cells: int = 10, value: str = "value") -> DataFrame:
    """mean(treated) - mean(control) for every gene of every perturbation of at least ``min_cells`` cells."""
    from .cells import expression_by_group
    table = expression_by_group(expr, cells, genes, condition, min_cells, value).select("gene_id", condition, "mean")
    base = table.where(F.col(condition) == control).select("gene_id", F.col("mean").alias("_c"))
    return table.where(F.col(condition) != control).join(base, "gene_id").select(
        condition, "gene_id", (F.col("mean") - F.col("_c")).alias("diff"))


# ---------------------------------------------------------------- permutation
def _shuffle_key(rep: str, key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(rep).cast("string"), F.col(key).cast("string")))


# Draws that one task hashes.
DRAWS = 8_000_000


def permutation_test(pool: DataFrame, key: str, value: str, marker: str, n_rep: int = 200, seed: int = 0) -> DataFrame:
    """Mean value of the marked set against ``n_rep`` random sets of the same size m from the pool.

    The draw is the m smallest seeded hashes, so every replicate is reproducible. A histogram of each replicate's hashes by their first
    two digits gives the bin that the m-th falls into: bins below it are taken as their sums, and only that bin, one row in
    256, is put in order. A set of half the pool costs no more than a small one. The pool is written once and dealt over as many tasks
    as its draws ask for: a small pool would lie in one partition, and all its draws with it.
    """
    spark = pool.sparkSession
    pool = checkpoint(pool.select(key, value, marker))
    pool = pool.repartition(task_count(spark, pool.count() * n_rep, DRAWS), key)
    observed = pool.where(marker).agg(F.count(F.lit(1)).alias("m"), F.avg(value).alias("v"))
    wanted, mean = observed.select("m").scalar(), observed.select("v").scalar()
    draws = pool.select(key, value).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1)))).withColumn("_h", _shuffle_key("_rep", key, seed))
    draws = draws.withColumn("_bin", F.substr("_h", F.lit(1), F.lit(2)))  # digits in lower case order like their numbers
    bins = draws.groupBy("_rep", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.count(value).alias("_c"))
    bins = bins.withColumn("_upto", F.sum("_n").over(W.partitionBy("_rep").orderBy("_bin"))).withColumn("_need", wanted - F.col("_upto") + F.col("_n"))
    whole = bins.where(F.col("_n") <= F.col("_need")).select("_rep", "_s", "_c")
    # One bin a replicate.
    cut = bins.where((F.col("_need") > 0) & (F.col("_n") > F.col("_need"))).select("_rep", "_bin", "_need")
    last = draws.join(F.broadcast(cut), ["_rep", "_bin"]).withColumn("_at", F.row_number().over(W.partitionBy("_rep").orderBy("_h", key))).where("_at <= _need")
    part = last.groupBy("_rep").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    null = whole.union(part).groupBy("_rep").agg((F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0))).alias("_v"))
    return null.agg(F.max(mean).alias("observed"), F.avg("_v").alias("null_mean"), F.stddev_pop("_v").alias("null_sd"),
                    F.avg((F.col("_v") >= mean).cast("double")).alias("p_value"))


# Draws that one task puts in order, and rows of the pool that are hashed at once.
ORDERED, HASHED = 4_000_000, 1 << 15


def _packed_draws(pool: DataFrame, n_rep: int, seed: int, n_bins: int, record: np.dtype) -> DataFrame:
    """(rep, bin, packed): the draws of each replicate by the leading bits of their hashes, as digest and twice the rank of y (0: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = [], []
        for batch in batches:
            # The same texts as those of ``_shuffle_key``, whose separator is missing where the key is NULL.
            keys += [b"" if k is None else b":" + k.encode() for k in batch["_key"].to_pylist()]
            ranks.append(np.nan_to_num(batch["_y"].to_numpy(zero_copy_only=False) * 2))
            if len(keys) >= HASHED:
                yield from pack(keys, np.concatenate(ranks))
                keys, ranks = [], []
        if keys:
            yield from pack(keys, np.concatenate(ranks))

    def pack(keys: list[bytes], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.empty(len(keys), record)
        for rep in range(n_rep):
            head = f"{seed}:{rep}".encode()
            digest = np.frombuffer(b"".join([hashlib.md5(head + k, usedforsecurity=False).digest() for k in keys]), ">u8").reshape(-1, 2)
            rows["high"], rows["low"], rows["y"] = digest[:, 0], digest[:, 1], ranks
            place = (rows["high"] >> np.uint64(32)) * np.uint64(n_bins) >> np.uint64(32)
            order = np.argsort(place, kind="stable")
            bins, first = np.unique(place[order], return_index=True)
            ends = np.append(first, len(keys)).astype(np.int32) * np.int32(record.itemsize)
            packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(rows[order].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), rep, np.int32)), pa.array(bins.astype(np.int32)), packed], names=["rep", "bin", "packed"])

    return pool.select("_key", "_y").mapInArrow(run, "rep int, bin int, packed binary")


def shuffled_spearman(df: DataFrame, key: str, x: str, y: str, n_rep: int = 200, seed: int = 0,
                      limit: int | None = None) -> DataFrame:
    """Mean and sd of the Spearman correlation when x is shuffled against y.

    The order of a replicate is that of its seeded hashes. Its draws meet by the leading bits of their hashes, packed (20 bytes a draw), in one
    shuffle. Counts of the bins give the places where each begins; as hashes are even, a bin covers nearly the same places in all replicates, so
    the x of these places travel to it once. Draws are put in order, met with x and summed where they are.
    """
    spark = df.sparkSession
    ranked = position(_ranked(df.select(key, x, y), [x, y], limit), [], [F.asc(key)], "_at", limit=limit)
    ranked = checkpoint(ranked.select(F.col(key).cast("string").alias("_key"), F.col(f"_r_{x}").alias("_x"), F.col(f"_r_{y}").alias("_y"), "_at"))
    whole = ranked.agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop("_x") * F.stddev_pop("_y")).alias("spread")).first()
    n, middle = whole["n"], (whole["n"] + 1) / 2
    n_bins = task_count(spark, n * n_rep, ORDERED)
    record = np.dtype([("high", "<u8"), ("low", "<u8"), ("y", "<u4" if 2 * n < 1 << 32 else "<u8")])
    dealt = ranked.repartition(task_count(spark, n * n_rep, DRAWS), "_at")
    # Counts and the draws themselves read the same shuffle.
    draws = _packed_draws(dealt, n_rep, seed, n_bins, record).repartition(n_bins, "bin")
    counts = draws.groupBy("rep", "bin").agg((F.sum(F.length("packed")) / record.itemsize).cast("bigint").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(W.partitionBy("rep").orderBy("bin")) - F.col("_n"))
    wide = max(1, n // n_bins)
    block = lambda c: F.floor(F.col(c) / wide)
    ranges = starts.groupBy("bin").agg((F.min("_start") + 1).alias("_from"), F.max(F.col("_start") + F.col("_n")).alias("_to"))
    ranges = ranges.withColumn("_block", F.explode(F.sequence(block("_from"), block("_to"))))
    places = ranked.select("_at", "_x", block("_at").alias("_block")).join(ranges, "_block").where(F.col("_at").between(F.col("_from"), F.col("_to")))
    needed = places.select(F.col("bin").alias("_bin"), F.lit(None).cast("int").alias("rep"), "_at", "_x").union(
        starts.select("bin", "rep", "_start", F.lit(None).cast("double")))

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        is_x = right["rep"].is_null().to_numpy()
        at, value = right["_at"].to_numpy()[is_x], right["_x"].to_numpy()[is_x] - middle
        value = value[np.argsort(at)]
        begin = dict(zip(right["rep"].to_numpy()[~is_x].astype(int).tolist(), right["_at"].to_numpy()[~is_x].tolist(), strict=True))
        found: dict[int, list[bytes]] = {}
        for rep, packed in zip(left["rep"].to_pylist(), left["packed"].to_pylist(), strict=True):
            found.setdefault(rep, []).append(packed)
        sums = []
        for rep, packed in found.items():
            rows = np.frombuffer(b"".join(packed), record)
            order = np.argsort(rows["high"])
            if (np.diff(rows["high"][order]) == 0).any():
                order = np.lexsort((rows["y"], rows["low"], rows["high"]))  # equal digests: rows of one key, in any order
            own_y = rows["y"][order].astype(np.float64)
            own_x = value[begin[rep] - int(at.min()) + 1:][:len(rows)]
            both = (own_y > 0) & ~np.isnan(own_x)
            own_x, own_y = own_x[both], own_y[both] / 2 - middle
            sums.append((rep, len(own_x), own_x.sum(), own_y.sum(), own_x @ own_y))
        return pa.table({c: pa.array([r[i] for r in sums], pa.float64() if i > 1 else pa.int64()) for i, c in enumerate(("rep", "n", "sx", "sy", "sxy"))})

    sums = draws.groupBy("bin").cogroup(needed.groupBy("_bin")).applyInArrow(merge, "rep bigint, n bigint, sx double, sy double, sxy double")
    pairs = F.nullif(F.sum("n"), F.lit(0))
    covariance = F.sum("sxy") / pairs - F.sum("sx") / pairs * (F.sum("sy") / pairs)
    null = sums.groupBy("rep").agg(F.try_divide(covariance, F.nullif(F.lit(whole["spread"]).cast("double"), F.lit(0.0))).alias("_c"))
    return null.agg(F.count(F.lit(1)).alias("n_rep"), F.avg("_c").alias("null_mean"), F.stddev_pop("_c").alias("null_sd"))


# ---------------------------------------------------------------- attribution tables
def mean_abs_attribution(attribution: DataFrame, cells: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean |attribution| over all listed cells (absent entries are zero)."""
    n = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    inside = attribution.join(cells.select("cell_id"), "cell_id", "left_semi")
    return inside.groupBy(feature).agg(F.sum(F.abs(value)).alias("_s")).select(feature, (F.col("_s") / n).alias("mean_abs"))


def attribution_enrichment(attribution: DataFrame, expr: DataFrame, cells: DataFrame, genes: DataFrame, k: int = 12,
                           value: str = "value") -> DataFrame:
    """Top-k attributed genes of every cell: attribution, cell value, population mean and difference."""
    from .cells import gene_moments
    top = top_k(attribution.select("cell_id", "gene_id", F.col("value").alias("attribution")), ["cell_id"],
                [F.desc("attribution"), F.asc("gene_id")], k, "at")
    means = gene_moments(expr, cells, genes, value).select("gene_id", F.col("mean").alias("pop_mean"))
    joined = (top.join(expr.select("cell_id", "gene_id", F.col(value).alias("expr")), ["cell_id", "gene_id"], "left")
              .join(means, "gene_id", "left").withColumn("expr", F.coalesce("expr", F.lit(0.0)))
              .withColumn("pop_mean", F.coalesce("pop_mean", F.lit(0.0))))
    return joined.withColumn("enrichment", F.col("expr") - F.col("pop_mean"))


def attribution_delta_topk(before: DataFrame, after: DataFrame, by: Sequence[str], feature: str = "feature",
                           value: str = "value", k: int = 15) -> DataFrame:
    """Features whose attribution changes most between two tables, per group."""
    joined = before.select(*by, feature, F.col(value).alias("before")).join(
        after.select(*by, feature, F.col(value).alias("after")), [*by, feature], "full")
    moved = joined.fillna(0.0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
    return top_k(moved, by, [F.desc(F.abs("delta")), F.asc(feature)], k, "at")
