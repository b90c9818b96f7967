"""Dense-vector operators on embeddings: centroids, displacement, neighbours, clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, l2, norm, subtract
from ..scale import top_k


def group_centroids(vectors: DataFrame, by: Sequence[str] = ("label",), vector: str = "embedding") -> DataFrame:
    """Mean vector per group: averaged per dimension with map-side combine, then reassembled."""
    sizes = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"))
    means = vectors.select(*by, F.posexplode(vector).alias("_pos", "_x")).groupBy(*by, "_pos").agg(F.avg("_x").alias("_m"))
    whole = means.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("centroid"))
    return whole.join(sizes, list(by))


def centroid_list(centroids: DataFrame, label: str = "label") -> Column:
    """All centroids as one array. Every result row lists the distance to each label, so a row is as wide as this array anyway."""
    return centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(label), F.col("centroid"))))).scalar()


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, label: str = "label", vector: str = "embedding",
                     prefix: str = "nearest") -> DataFrame:
    """Nearest label by L2 (ties: smaller label) and the distances to all labels."""
    distances = F.transform("_centroids", lambda c: F.struct(
        l2(F.col(vector), c["centroid"]).alias("distance"), c[label].alias(label)))
    df = (vectors.withColumn("_centroids", centroid_list(centroids, label))
          .withColumn(f"{prefix}_distances", distances).drop("_centroids"))
    best = F.array_min(f"{prefix}_distances")
    return df.withColumn(f"{prefix}_{label}", best[label]).withColumn(f"{prefix}_distance", best["distance"])


def displacement(before: Column | str, after: Column | str) -> Column:
    return norm(subtract(after, before))


def away_from_centroid(vectors: DataFrame, centroids: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Mean change of the distance to the group's own centroid, and mean displacement, per group."""
    joined = vectors.join(centroids.select(*by, "centroid"), list(by))
    return joined.groupBy(*by).agg(
        F.avg(l2("after", "centroid") - l2("embedding", "centroid")).alias("away"),
        F.avg(displacement("embedding", "after")).alias("displacement"), F.count(F.lit(1)).alias("n_cells"))


def centroid_effect(centroids: DataFrame, control, label: str = "label") -> DataFrame:
    """L2 distance of each perturbation's centroid to the control centroid."""
    reference = centroids.where(F.col(label) == control).select("centroid").scalar()
    return (centroids.where(F.col(label) != control).withColumn("_control", reference)
            .select(label, "n_cells", l2("centroid", "_control").alias("effect")))


def direction_cosine(predicted: DataFrame, actual: DataFrame, label: str = "label") -> DataFrame:
    """Cosine and length ratio of predicted and actual mean shifts (columns ``shift``)."""
    joined = predicted.select(label, F.col("shift").alias("_p")).join(actual.select(label, F.col("shift").alias("_a")), label)
    return joined.select(label, cosine("_p", "_a").alias("cosine"), (norm("_p") / (norm("_a") + 1e-12)).alias("magnitude_ratio"),
                         F.col("_a").alias("actual"))


def _uniform(parts: Sequence[Column]) -> Column:
    """Uniform (0, 1] number from an md5 of its seeds: reproducible on every run and partitioning."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(16 ** 12))


def direction_null(scored: DataFrame, n_null: int = 2000, seed: int = 0, label: str = "label") -> DataFrame:
    """Share of random Gaussian directions at least as aligned with ``actual`` as the prediction.

    Directions are generated row by row next to the (few) scored labels and summed map-side.
    """
    draws = scored.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n_null - 1))))
    flat = draws.select(label, "cosine", "_rep", F.posexplode("actual").alias("_pos", "_a"))
    u1 = _uniform([F.lit(seed), F.col("_rep"), F.col("_pos"), F.lit("a")])
    u2 = _uniform([F.lit(seed), F.col("_rep"), F.col("_pos"), F.lit("b")])
    g = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * np.pi) * u2)
    parts = flat.withColumn("_g", g).groupBy(label, "cosine", "_rep").agg(
        F.sum(F.col("_g") * F.col("_a")).alias("_ga"), F.sum(F.col("_g") * F.col("_g")).alias("_gg"),
        F.sum(F.col("_a") * F.col("_a")).alias("_aa"))
    null = F.col("_ga") / (F.sqrt("_gg") * F.sqrt("_aa") + 1e-12)
    return parts.withColumn("_null", null).groupBy(label, "cosine").agg(
        F.avg((F.col("_null") >= F.col("cosine")).cast("double")).alias("null_p"))


# ---------------------------------------------------------------- nearest neighbours
CHUNK = 16384


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Direct differences block by block: exact zeros for equal vectors and bounded memory."""
    out = np.empty((len(a), len(b)))
    rows = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), rows):
        diff = a[i:i + rows, None, :] - b[None, :, :]
        out[i:i + rows] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b for each row of a; equally near ones by their row.

    A matrix product gives squared distances up to rounding; rows within its error bound of the k-th are measured by direct differences.
    """
    k = min(k, len(b))
    norms = np.einsum("ij,ij->i", b, b)
    most = np.sqrt(norms.max())
    found = []
    rows = max(1, 1_000_000 // len(b))
    for i in range(0, len(a), rows):
        part = a[i:i + rows]
        about = norms - 2 * (part @ b.T)
        slack = 8 * (a.shape[1] + 8) * np.finfo(float).eps * most * (most + np.linalg.norm(part, axis=1))
        row, col = np.nonzero(~(about > (np.partition(about, k - 1, axis=1)[:, k - 1] + slack)[:, None]))
        d = np.empty(len(row))
        pairs = max(1, 4_000_000 // max(1, a.shape[1]))
        for j in range(0, len(row), pairs):
            diff = part[row[j:j + pairs]] - b[col[j:j + pairs]]
            d[j:j + pairs] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((row[at < k] + i, col[at < k], d[at < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _packed(centers: np.ndarray, sizes: np.ndarray, chunk: int) -> np.ndarray:
    """The group of each cell: neighbouring cells share one while they have at most ``chunk`` references together."""
    apart = _distances(centers, centers)
    group, open_size, n, at = np.full(len(centers), -1), 0, 0, 0
    while True:
        if open_size and open_size + sizes[at] > chunk:
            n, open_size = n + 1, 0
        group[at], open_size = n, open_size + sizes[at]
        left = np.flatnonzero(group < 0)
        if not len(left):
            return group
        at = left[apart[at, left].argmin()]


def knn(queries: DataFrame, references: DataFrame, k: int, pivots: int = 64, chunk: int = CHUNK) -> DataFrame:
    """Exact k nearest references (L2) of every query: query_id, ref_id, distance.

    ``queries``: query_id, vector; ``references``: ref_id, vector. References are grouped by their
    nearest pivot. From each cell's size and radius a query knows an upper bound of its k-th distance
    and visits only cells that the triangle inequality cannot rule out. Neighbouring small cells are packed, so a query
    travels once for all of them. Visits are joined in blocks of bounded size (hot cells are split on both sides) and each
    block returns at most k rows per query.
    """
    spark = references.sparkSession
    seeds = references.orderBy(F.xxhash64("ref_id"), "ref_id").limit(pivots).select("vector").collect()
    if not seeds:
        return spark.createDataFrame([], "query_id bigint, ref_id bigint, distance double")
    centers = np.array([r["vector"] for r in seeds], dtype=np.float64)

    @F.pandas_udf("struct<cell: int, far: double>")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        d = _distances(_stack(vectors), centers)
        best = d.argmin(axis=1)
        return pd.DataFrame({"cell": best.astype("int32"), "far": d[np.arange(len(best)), best]})

    placed = references.withColumn("_a", assign("vector")).select("ref_id", "vector", "_a.cell", "_a.far")
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    filled = np.array(sorted(row["cell"] for row in summary))
    sizes, radii = (np.array([row[name] for row in sorted(summary, key=lambda r: r["cell"])], float) for name in ("n", "radius"))
    group_of = _packed(centers[filled], sizes, chunk)
    in_group = np.bincount(group_of, weights=sizes)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def visits(vectors: pd.Series) -> pd.Series:
        d = _distances(_stack(vectors), centers)[:, filled]
        upper = d + radii
        order = np.argsort(upper, axis=1)
        enough = np.cumsum(sizes[order], axis=1) >= k
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), order.shape[1] - 1)
        bound = np.take_along_axis(upper, np.take_along_axis(order, last[:, None], 1), 1)
        keep = d - radii <= bound * (1 + 1e-9) + 1e-9
        return pd.Series([np.unique(group_of[row]).astype("int32") for row in keep])

    visiting = queries.withColumn("_group", F.explode(visits("vector")))
    asked = {r["_group"]: r["n"] for r in visiting.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = lambda counts: F.element_at(F.array(*[F.lit(max(1, int(-(-n // chunk)))) for n in counts]), F.col("_group") + 1)
    ref_blocks, query_blocks = blocks(in_group), blocks([asked.get(g, 1) for g in range(len(in_group))])
    group = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(filled, group_of, strict=True) for x in pair]), F.col("cell"))
    left = (visiting.withColumn("_qb", F.pmod(F.xxhash64("query_id"), query_blocks))
            .withColumn("_rb", F.explode(F.sequence(F.lit(0), ref_blocks - 1))).withColumn("_rb", F.col("_rb").cast("bigint")))
    right = (placed.drop("far").withColumn("_group", group).drop("cell").withColumn("_rb", F.pmod(F.xxhash64("ref_id"), ref_blocks))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
             .withColumn("_qb", F.col("_qb").cast("bigint")))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "ref_id": [], "distance": []})
        b = b.sort_values("ref_id")
        row, col, d = _nearest(_stack(a["vector"]), _stack(b["vector"]), k)
        return pd.DataFrame({"query_id": a["query_id"].to_numpy()[row], "ref_id": b["ref_id"].to_numpy()[col], "distance": d})

    keys = ["_group", "_qb", "_rb"]
    types = {f.name: f.dataType.simpleString() for f in queries.schema.fields + references.schema.fields}
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        nearest, f"query_id {types['query_id']}, ref_id {types['ref_id']}, distance double")
    return top_k(found, ["query_id"], ["distance", "ref_id"], k, "_at").drop("_at")


def knn_idw(queries: DataFrame, references: DataFrame, k: int = 15, power: float = 2.0, pivots: int = 64,
            chunk: int = CHUNK) -> DataFrame:
    """Map query vectors to the references' 2-D coordinates by inverse-distance weighting of k neighbours.

    A query that coincides with a reference (distance < 1e-12) gets that reference's coordinates.
    ``references`` carries x and y.
    """
    pairs = knn(queries, references.select("ref_id", "vector"), k, pivots, chunk)
    placed = pairs.join(references.select("ref_id", "x", "y"), "ref_id")
    hit = F.col("distance") < 1e-12
    weight = F.when(~hit, 1.0 / F.pow("distance", F.lit(float(power))))
    first = F.min_by(F.struct("x", "y"), F.struct(F.col("distance"), F.col("ref_id")))
    summed = placed.withColumn("_w", weight).groupBy("query_id").agg(
        F.bool_or(hit).alias("exact"), first.alias("_first"), F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("x")).alias("_x"), F.sum(F.col("_w") * F.col("y")).alias("_y"))
    pick = lambda name: F.when(F.col("exact"), F.col(f"_first.{name}")).otherwise(F.col(f"_{name}") / F.col("_sw"))
    return summed.select("query_id", "exact", pick("x").alias("x"), pick("y").alias("y"))


# Rounds of assignment and update.
ROUNDS = 10


def kmeans_centers(vectors: DataFrame, k: int, seed: int = 42, vector: str = "embedding", key: str = "cell_id", rounds: int = ROUNDS) -> list[list[float]]:
    """Centres after a fixed number of rounds; they start at the k vectors whose seeded hash is smallest, so a run repeats on any partitioning.

    A round is one pass: tasks assign their vectors to the nearest centre (of equal ones the first) and send k sums and counts; a centre
    without vectors stays where it is. At most k (30) vectors reach the driver. Fewer than k vectors give fewer centres.
    """
    if not 2 <= k <= 30:
        raise ValueError("number of groups must be between 2 and 30")
    held = vectors.where(F.col(vector).isNotNull())
    first = held.select(vector, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("_h"), F.col(key).alias("_k")).orderBy("_h", "_k").limit(k)
    centers = np.array([r[0] for r in first.collect()], float)

    def round_of(centers: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(centers), np.zeros(len(centers), np.int64)
            for batch in batches:
                x = _rows_of(batch.column(0))
                near = _distances(x, centers).argmin(1)
                np.add.at(sums, near, x)
                counts += np.bincount(near, minlength=len(centers))
            filled = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(list(sums[filled]), pa.list_(pa.float64())), pa.array(counts[filled])], names=["g", "s", "n"])
        return run

    for _ in range(rounds if len(centers) else 0):
        parts = held.select(F.col(vector).cast("array<double>")).mapInArrow(round_of(centers), "g bigint, s array<double>, n bigint")
        places = parts.select("g", "n", F.posexplode("s").alias("at", "x"))
        found = places.groupBy("g").agg(F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n")).join(
            places.groupBy("g", "at").agg(F.sum("x").alias("x")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("s")), "g")
        centers = centers.copy()
        for r in found.collect():
            centers[r["g"]] = np.array(r["s"]) / r["n"]
    return centers.tolist()


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.zeros((0, 1))


def kmeans_groups(vectors: DataFrame, k: int, seed: int = 42, vector: str = "embedding", key: str = "cell_id", rounds: int = ROUNDS) -> DataFrame:
    """k groups (2 to 30) with labels ``Computed group i``; a NULL vector has none. See ``kmeans_centers``."""
    centers = np.array(kmeans_centers(vectors, k, seed, vector, key, rounds))

    @F.pandas_udf("int")
    def nearest(found: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(found), dtype="Int32")
        there = found.notna().to_numpy()
        if there.any():
            out[there] = _distances(_stack(found[there]), centers).argmin(axis=1) + 1
        return out

    return vectors.withColumn("computed_group", F.concat(F.lit("Computed group "), nearest(vector).cast("string")))
