"""Multi-scenario operators: weight grids, leave-one-out tuning and weight sensitivity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Consensus
from ..scale import checkpoint, dealt, null_safe_join, position
from .consensus import CASE, adjusted, case_weights


def weight_grid(cfg: Consensus) -> Column:
    """Array of the grid's raw positions with at least one positive weight; any size, no combination is listed on the driver."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(len(cfg.tuning.grid) ** len(cfg.evidence) - 1).cast("bigint"))
    return F.filter(every, lambda g: ~_without_weight(g, cfg)) if _idle(cfg) else every


def _idle(cfg: Consensus) -> list[int]:
    """Digits that stand for a weight that is not positive."""
    return [i for i, x in enumerate(cfg.tuning.grid) if x <= 0]


def _digits(position: Column, cfg: Consensus) -> list[Column]:
    base, n = len(cfg.tuning.grid), len(cfg.evidence)
    return [(F.floor(position / F.lit(base ** (n - 1 - i))) % base).cast("int") for i in range(n)]


def _without_weight(position: Column, cfg: Consensus) -> Column:
    """Is no weight of the combination positive?"""
    out = F.lit(True)
    for digit in _digits(position, cfg):
        out = out & digit.isin(*_idle(cfg))
    return out


def grid_weights(position: Column, cfg: Consensus) -> list[Column]:
    """Weights of a raw grid position: its digits in base of the grid's size, first evidence first."""
    listed = F.array(*[F.lit(float(x)) for x in cfg.tuning.grid])
    return [F.get(listed, digit) for digit in _digits(position, cfg)]


def grid_id(position: Column, cfg: Consensus) -> Column:
    """Number of a combination when those without a positive weight are not counted."""
    idle, n = _idle(cfg), len(cfg.evidence)
    if not idle:
        return position.cast("int")
    # Skipped positions below this one: they share its first digits, all idle, and have a smaller idle digit next.
    below, same = F.lit(0).cast("bigint"), F.lit(True)
    for i, digit in enumerate(_digits(position, cfg)):
        smaller = sum((F.lit(x) < digit).cast("bigint") for x in idle)
        below = below + F.when(same, smaller * len(idle) ** (n - 1 - i)).otherwise(0)
        same = same & digit.isin(*idle)
    return (position - below).cast("int")


def decode_weights(tuned: DataFrame, cfg: Consensus, name: str = "final_grid_id", into: str = "weights") -> DataFrame:
    """Add the array of weights that a grid id stands for; NULL stays NULL."""
    position = F.get(weight_grid(cfg), F.col(name).cast("int"))
    return tuned.withColumn(into, F.when(F.col(name).isNotNull(), F.array(*grid_weights(position, cfg))))


def _weighted(values: Sequence[Column], weights: Column, penalty: Column) -> Column:
    total = F.lit(0.0)
    for i, value in enumerate(values):
        total = total + value * weights[i]
    return total + penalty


# Scores compared at once in a task: candidate rows times weight combinations.
CELLS = 1 << 20
ROWS = 2048


def _dominance(pairs: DataFrame, cfg: Consensus) -> DataFrame:
    """(target, first, counts): how many candidates of a batch come before a target under each raw grid position from ``first`` on.

    Rows of ``pairs`` hold a candidate (a0.., pen), a target of its case (c0.., cpen, target) and whether the candidate wins ties. A batch is
    a matrix of candidates; its product with a block of the grid gives all scores, and wins are summed by target before they leave the task.
    """
    n, grid = len(cfg.evidence), np.array([float(x) for x in cfg.tuning.grid])
    size = len(grid) ** n

    def weights(first: int, last: int) -> np.ndarray:
        at = np.arange(first, last)
        return np.stack([grid[at // len(grid) ** (n - 1 - i) % len(grid)] for i in range(n)])

    def scores(parts: list[np.ndarray], penalty: np.ndarray, w: np.ndarray) -> np.ndarray:
        # Added in the order of the evidence, so equal scores are equal bit by bit everywhere.
        total = np.zeros((len(penalty), w.shape[1]))
        for i, part in enumerate(parts):
            total += part[:, None] * w[i]
        return total + penalty[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                held = {c: batch[c].slice(k, ROWS).to_numpy(zero_copy_only=False) for c in batch.schema.names}
                order = np.argsort(held["target"], kind="stable")
                held = {c: x[order] for c, x in held.items()}
                starts = np.flatnonzero(np.append(True, held["target"][1:] != held["target"][:-1]))
                step = max(1, CELLS // len(order))
                for first in range(0, size, step):
                    w = weights(first, min(size, first + step))
                    mine = scores([held[f"a{i}"] for i in range(n)], held["pen"], w)
                    theirs = scores([held[f"c{i}"][starts] for i in range(n)], held["cpen"][starts], w)
                    theirs = np.repeat(theirs, np.diff(np.append(starts, len(order))), axis=0)
                    better = (mine > theirs) | ((mine == theirs) & held["earlier"].astype(bool)[:, None])
                    counts = np.add.reduceat(better, starts, axis=0, dtype=np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * w.shape[1]), pa.array(counts.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(held["target"][starts]), pa.repeat(pa.scalar(first, pa.int64()), len(starts)), lists],
                                                     names=["target", "first", "counts"])

    return pairs.mapInArrow(run, "target bigint, first bigint, counts array<bigint>")


def control_ranks(panel: DataFrame, controls: DataFrame, cfg: Consensus, by: Sequence[str] = CASE,
                  split: bool = False) -> DataFrame:
    """Rank of every present control under every weight combination.

    A rank is one plus the number of better candidates, counted in blocks (``_dominance``): no sort per combination, no row for each
    candidate and combination, and a large case is summed by many tasks. Candidates that share a control's symbol are
    ranked one by one; the best of them stands for the control.
    Returns by, control, grid_id, l1 (distance to default weights), rank.
    """
    n = len(cfg.evidence)
    matrix = adjusted(panel, cfg, by, split).select(
        *by, F.coalesce("hgnc_id", F.lit("~")).alias("_id"), F.upper(F.trim("symbol")).alias("_symbol"), F.col("hpa_penalty").cast("double").alias("pen"),
        *[F.col(f"adj_{s.column}").cast("double").alias(f"a{i}") for i, s in enumerate(cfg.evidence)])
    wanted = controls.select(F.upper(F.trim("symbol")).alias("_symbol")).distinct()
    targets = checkpoint(matrix.join(wanted, "_symbol", "left_semi").select(
        *by, F.col("_symbol").alias("control"), F.col("_id").alias("_cid"), F.col("pen").alias("cpen"),
        *[F.col(f"a{i}").alias(f"c{i}") for i in range(n)]).withColumn("target", F.monotonically_increasing_id()))
    pairs = matrix.join(targets, list(by)).select("target", "pen", "cpen", (F.col("_id") < F.col("_cid")).alias("earlier"),
                                                  *[f"{side}{i}" for side in "ac" for i in range(n)])
    # Blocks of counts travel, one task's number of ranks is bounded, and a control's ranks are made where its blocks meet.
    rows, key = targets.count() * len(cfg.tuning.grid) ** n, [*by, "control"]
    named = dealt(_dominance(pairs, cfg), rows, ["target"]).join(dealt(targets.select(*key, "target"), rows, ["target"]), "target")
    each = dealt(named, rows, key).select(*key, "target", "first", F.posexplode("counts").alias("at", "n"))
    each = each.groupBy(*key, "target", (F.col("first") + F.col("at")).alias("position")).agg(F.sum("n").alias("better"))
    if _idle(cfg):
        each = each.where(~_without_weight(F.col("position"), cfg))
    best = each.groupBy(*key, "position").agg((F.min("better") + 1).alias("rank"))
    far = F.lit(0.0)
    for weight, default in zip(grid_weights(F.col("position"), cfg), cfg.weights, strict=True):
        far = far + F.abs(weight - F.lit(float(default)))
    return best.select(*by, "control", grid_id(F.col("position"), cfg).alias("grid_id"), far.alias("l1"), "rank")


def grid_recall(ranks: DataFrame, top_n: int = 10, by: Sequence[str] = CASE) -> DataFrame:
    """Share of the case's controls inside the top N under each weight combination."""
    return ranks.groupBy(*by, "grid_id").agg(F.count(F.lit(1)).alias("n_controls"),
                                             F.avg((F.col("rank") <= top_n).cast("double")).alias("recall"))


def loo_folds(ranks: DataFrame, top_n: int = 10, by: Sequence[str] = CASE, rows: int = 0) -> DataFrame:
    """Leave-one-out folds: weights chosen on the other controls, rank of the held-out one.

    Highest training recall, then smallest L1 distance to the default weights, then grid order;
    cases with fewer than three present controls are skipped. ``rows``, the number of ranks where it is known, bounds what a task holds.
    """
    ranks = dealt(ranks, rows, [*by, "grid_id"])
    hits = ranks.groupBy(*by, "grid_id").agg(F.count_if(F.col("rank") <= top_n).alias("_hits"),
                                             F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    fold = ranks.join(hits, [*by, "grid_id"])
    train = F.col("_hits") - (F.col("rank") <= top_n).cast("bigint")
    best = dealt(fold, rows, [*by, "control"]).groupBy(*by, "control").agg(
        F.max(F.struct(train.alias("hits"), (-F.col("l1")).alias("near"), (-F.col("grid_id")).alias("early"),
                       F.col("rank").alias("rank"), F.col("_n").alias("n"))).alias("_b"))
    return best.select(*by, F.col("control").alias("held_out"), (F.col("_b.hits") / (F.col("_b.n") - 1)).alias("train_recall"),
                       (-F.col("_b.early")).cast("bigint").alias("grid_id"), F.col("_b.rank").alias("held_out_rank"),
                       (F.col("_b.rank") <= top_n).alias("in_top_n"))


def loo_tune(ranks: DataFrame, top_n: int = 10, by: Sequence[str] = CASE, cases: DataFrame | None = None) -> DataFrame:
    """Per case: leave-one-out hit rate, the final weight combination and its recall.

    ``cases`` lists all cases: those without a present control are reported as skipped instead of being absent.
    """
    ranks = checkpoint(ranks)  # read by every fold and by the final choice
    rows = ranks.count()
    rate = loo_folds(ranks, top_n, by, rows).groupBy(*by).agg(F.avg(F.col("in_top_n").cast("double")).alias("loo_hit_rate"))
    recall = dealt(ranks, rows, [*by, "grid_id"]).groupBy(*by, "grid_id", "l1").agg(F.avg((F.col("rank") <= top_n).cast("double")).alias("_recall"),
                                                     F.count(F.lit(1)).alias("_n"))
    final = recall.groupBy(*by).agg(F.max(F.struct(
        F.col("_recall").alias("recall"), (-F.col("l1")).alias("near"), (-F.col("grid_id")).alias("early"))).alias("_f"),
        F.max("_n").alias("n_controls"))
    if cases is not None:
        final = null_safe_join(cases.select(*by).distinct(), final, list(by))
    final = final.withColumn("n_controls", F.coalesce("n_controls", F.lit(0).cast("bigint")))
    note = F.when(F.col("n_controls") < 3, "skipped_fewer_than_three_controls")
    kept = lambda c: F.when(F.col("n_controls") >= 3, c)
    return final.join(rate, list(by), "left").select(
        *by, "n_controls", kept((-F.col("_f.early")).cast("bigint")).alias("final_grid_id"),
        kept(F.col("_f.recall")).alias("final_recall"), "loo_hit_rate", note.alias("note"))


def tuned_rank(panel: DataFrame, tuned: DataFrame, cfg: Consensus, by: Sequence[str] = CASE, split: bool = False) -> DataFrame:
    """Rank every case with the weights chosen for it; a case whose tuning was skipped keeps the default weights.

    ``tuned`` is the result of ``loo_tune``. Adds weights, tuned (were they chosen?), tuned_score and tuned_rank.
    """
    chosen = decode_weights(tuned, cfg, into="_w").select(*by, "_w")
    joined = null_safe_join(adjusted(panel, cfg, by, split), chosen, list(by))
    default = F.array(*[F.lit(float(w)) for w in cfg.weights])
    joined = joined.withColumn("tuned", F.col("_w").isNotNull()).withColumn("weights", F.coalesce("_w", default)).drop("_w")
    score = _weighted([F.col(f"adj_{s.column}") for s in cfg.evidence], F.col("weights"), F.col("hpa_penalty"))
    order = [F.desc("tuned_score"), F.asc_nulls_last("hgnc_id"), F.asc("symbol")]
    return position(joined.withColumn("tuned_score", score), list(by), order, "tuned_rank", split)


def missing_controls(ranks: DataFrame, cases: DataFrame, controls: DataFrame, by: Sequence[str] = CASE) -> DataFrame:
    """(case, control) pairs that were asked for in ``controls`` (by, symbol) and are not among a case's candidates."""
    asked = controls.select(*by, F.upper(F.trim("symbol")).alias("control")).distinct().join(cases.select(*by).distinct(), list(by), "left_semi")
    return asked.join(ranks.select(*by, "control").distinct(), [*by, "control"], "left_anti")


def weight_sensitivity(panel: DataFrame, cfg: Consensus, by: Sequence[str] = CASE, split: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """Per (case, evidence, delta): largest rank shift and number of genes that enter the top three.

    Each weight of a case, its own where ``chosen`` has some, moves down and up by one and is floored at zero; moves that the floor undoes
    have no row. Rows are told apart by a number of their own, so genes without an id stay separate.
    """
    k = len(cfg.evidence)
    default = F.array(*[F.lit(float(w)) for w in cfg.weights])
    matrix = case_weights(adjusted(panel, cfg, by, split), cfg, by, chosen)
    matrix = matrix.withColumn("_own", F.col("weights") if chosen is not None else default).select(
        *by, "hgnc_id", "symbol", "_own", "hpa_penalty", *[F.col(f"adj_{s.column}").alias(f"_a{i}") for i, s in enumerate(cfg.evidence)])
    matrix = checkpoint(matrix.withColumn("_row", F.monotonically_increasing_id()))
    # Scenario 0 changes nothing; 2 i + 1 and 2 i + 2 move weight i down and up.
    moves = [(0, 0)] + [(i, d) for i in range(k) for d in (-1, 1)]
    listed = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(i).alias("_at"), F.lit(d).alias("_by")) for n, (i, d) in enumerate(moves)])
    runs = matrix.select("*", F.inline(listed))
    moved = F.transform("_own", lambda w, i: F.when(i == F.col("_at"), F.greatest(w + F.col("_by"), F.lit(0.0))).otherwise(w))
    runs = runs.withColumn("_w", moved)
    score = _weighted([F.col(f"_a{i}") for i in range(k)], F.col("_w"), F.col("hpa_penalty"))
    runs = runs.select(*by, "_row", "hgnc_id", "symbol", "scenario", (F.col("_w") != F.col("_own")).alias("_changed"), score.alias("_score"))
    ranked = position(runs, [*by, "scenario"], [F.desc("_score"), F.asc_nulls_last("hgnc_id"), F.asc("symbol"), F.asc("_row")], "_rank", split)
    # One row per gene with its rank in every scenario, then one aggregate per case.
    at = [F.max(F.when(F.col("scenario") == n, F.col("_rank"))).alias(f"_r{n}") for n in range(len(moves))]
    does = [F.bool_or((F.col("scenario") == n) & F.col("_changed")).alias(f"_c{n}") for n in range(1, len(moves))]
    wide = ranked.groupBy(*by, "_row").agg(*at, *does)
    effects = []
    for n in range(1, len(moves)):
        effects += [F.max(F.abs(F.col(f"_r{n}") - F.col("_r0"))).alias(f"_shift{n}"), F.count_if((F.col(f"_r{n}") <= 3) & (F.col("_r0") > 3)).alias(f"_new{n}"),
                    F.bool_or(f"_c{n}").alias(f"_does{n}")]
    rows = F.array(*[F.struct(F.lit(cfg.evidence[i].column).alias("evidence"), F.lit(d).cast("bigint").alias("delta"), F.col(f"_shift{n}").alias("max_rank_shift"),
                              F.col(f"_new{n}").alias("top3_genes_changed"), F.col(f"_does{n}").alias("_does")) for n, (i, d) in enumerate(moves) if n])
    return wide.groupBy(*by).agg(*effects).select(*by, F.inline(rows)).where("_does").drop("_does")


def robustness(sensitivity: DataFrame, by: Sequence[str] = CASE) -> DataFrame:
    """high: no scenario changes the top three; moderate: at most half (rounded down) do; else low."""
    changed, tested = F.col("n_causing_top3_change"), F.col("n_perturbations")
    label = (F.when(changed == 0, "high").when(changed <= F.floor(tested / 2), "moderate").otherwise("low"))
    return (sensitivity.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_perturbations"), F.max("max_rank_shift").alias("max_rank_shift"),
        F.count_if(F.col("top3_genes_changed") > 0).alias("n_causing_top3_change")).withColumn("robustness", label))
