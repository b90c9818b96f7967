"""The split paths for hot groups must give the same rows as the plain windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe import scale
from lociframe.config import SCREENING
from lociframe.operators import consensus, selection, statistics, tuning

LIMIT = 40


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of the rows; values repeat and some are missing."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, rng.choice([None, *range(9)]), float(rng.randint(0, 30))) for i in range(600)]
    return spark.createDataFrame(rows, "g string, id int, v int, w double").repartition(5)


def same(a, b):
    assert a.columns == b.columns or sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert key(a) == key(b)


def test_measures_the_largest_group(skewed):
    assert scale.largest_group(skewed, ["g"]) == 400 and scale.largest_group(skewed, []) == 600
    assert scale.is_hot(skewed, ["g"], 399) and not scale.is_hot(skewed, ["g"], 400)


@pytest.mark.parametrize("by", [["g"], []])
def test_positions_and_running_values(skewed, by):
    order = [F.desc_nulls_last("v"), F.asc("id")]
    def run(split):
        return (scale.OrderedGroups(skewed, by, order, split=split).position("at").running("total", F.col("w"))
                .running("seen", F.col("w"), how="max", inclusive=False).frame())
    plain, split = run(False), run(True)
    assert split.schema["at"].dataType == plain.schema["at"].dataType
    same(plain, split)


@pytest.mark.parametrize("by", [["g"], []])
def test_ranks(skewed, by):
    same(scale.average_rank(skewed, by, "v", "r", split=False), scale.average_rank(skewed, by, "v", "r", split=True))
    same(scale.descending_rank(skewed, by, "w", "r", split=False), scale.descending_rank(skewed, by, "w", "r", split=True))


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("value", ["w", "v", "odd"])
def test_quantiles_by_refined_histograms(skewed, by, value):
    """Equal to sorting: ties, missing, negative, tiny, huge and repeated values, one group with most rows."""
    import numpy as np
    odd = F.when(F.col("id") % 9 == 0, 0.0).when(F.col("id") % 7 == 0, -F.pow(F.lit(10.0), F.col("id") % 300)).otherwise(F.col("id") * 1e-7 - 2e-5)
    frame = skewed.withColumn("odd", odd)
    held = {}
    for r in frame.collect():
        if r[value] is not None:
            held.setdefault(tuple(r[c] for c in by), []).append(float(r[value]))
    got = {tuple(r[c] for c in by): [r["q0"], r["q1"], r["q2"]] for r in scale.grouped_quantiles(frame, by, value, [0.1, 0.5, 1.0]).collect()}
    assert got.keys() == held.keys()
    for key, values in held.items():
        assert got[key] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 1.0])), rel=1e-12)


def test_quantiles_of_nothing(skewed):
    assert [tuple(r) for r in scale.exact_quantiles(skewed.where("false"), "w", [0.5]).collect()] == [(None,)]
    assert scale.grouped_quantiles(skewed.where("false"), ["g"], "w", [0.5]).collect() == []


def test_top_k_beyond_the_map_side_limit(skewed, monkeypatch):
    order = [F.desc("w"), F.asc("id")]
    plain = scale.top_k(skewed, ["g"], order, 50)
    monkeypatch.setattr(scale, "MAP_SIDE_K", 10)
    same(plain, scale.top_k(skewed, ["g"], order, 50, salts=7))


def test_null_groups_stay_together(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    for split in (False, True):
        got = {r["id"]: r["n"] for r in scale.with_group_stats(df, ["g"], {"n": F.count(F.lit(1))}, split).collect()}
        assert got == {1: 2, 2: 2, 3: 1}


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(7)
    rows = [(1 if i % 3 else 2 + i % 4, f"HGNC:{i}" if i % 50 else None, f"S{i}", rng.choice([0., 1., 2., 3., 30., 40., None]),
             rng.choice([None, .1, .5, .9]), rng.choice([None, .2, .4]), i % 60, "ok" if i % 5 else "bad") for i in range(300)]
    return spark.createDataFrame(rows, "case_id int, hgnc_id string, symbol string, clinGen_hi_score double, gnomad_pLI double, "
                                       "gnomad_LOEUF double, utr3_bp int, utr3_status string")


@pytest.mark.parametrize("method", ["raw", "rank"])
def test_ranking_of_a_hot_case(panel, method):
    cfg = SCREENING.with_(normalize=method)
    unique = panel.where("hgnc_id IS NOT NULL")
    def run(split):
        ranked = consensus.consensus_rank(unique, cfg, split=split)
        return selection.budget_select(consensus.borda(ranked, cfg, split=split), 1500, split=split).select(
            "case_id", "symbol", "rank", "borda_rank", "selected", F.round("consensus_score", 9).alias("s"))
    same(run(False), run(True))
    same(tuning.weight_sensitivity(unique, cfg, split=False), tuning.weight_sensitivity(unique, cfg, split=True))


def test_ranking_ignores_row_order_and_annotations(panel):
    base = consensus.consensus_rank(panel.where("hgnc_id IS NOT NULL"), SCREENING).select("case_id", "symbol", "rank")
    moved = panel.where("hgnc_id IS NOT NULL").orderBy(F.rand(3)).repartition(7).withColumn("note", F.lit("x"))
    same(base, consensus.consensus_rank(moved, SCREENING).select("case_id", "symbol", "rank"))


def test_one_case_alone_ranks_as_inside_a_cohort(panel):
    whole = consensus.consensus_rank(panel, SCREENING).where("case_id = 3").select("symbol", "rank", "consensus_score")
    same(whole, consensus.consensus_rank(panel.where("case_id = 3"), SCREENING).select("symbol", "rank", "consensus_score"))


def test_statistics_split(skewed):
    df = skewed.withColumn("x", F.col("v").cast("double"))
    a = statistics.spearman(df, "x", "w").collect()[0]["spearman"]
    b = statistics.spearman(df, "x", "w", limit=LIMIT).collect()[0]["spearman"]
    assert a == pytest.approx(b)
    c = statistics.auroc(df, "id", "w", "w").collect()[0]
    d = statistics.auroc(df, "id", "w", "w", limit=LIMIT).collect()[0]
    assert c["auroc"] == pytest.approx(d["auroc"]) and c["n_positive"] == d["n_positive"] == 60


def test_rows_without_a_key_are_dealt_over_tasks(spark):
    """Nine rows in ten have no key and half of the rest one heavy key: equal to a plain join, no task with more than its share."""
    rows = [(i, None if i % 10 else "hot" if i % 20 else f"k{i % 70}") for i in range(4000)]
    left = spark.createDataFrame(rows, "id int, key string").repartition(4)
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k20", 3)], "key string, v int")
    names = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("false", "-1", "8"), strict=True):
            spark.conf.set(n, v)
        plain = left.join(right, ["key"], "left")
        for heavy in (None, scale.heavy_keys(left, ["key"], 100)):
            done = scale.dictionary_join(left, right, ["key"], heavy)
            same(plain, done)
            sizes = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert max(sizes) < 0.25 * 4000 and len(sizes) == 8
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_permutation_of_a_large_set_equals_sorting(spark):
    """Half of the pool is marked; every replicate equals the mean of the m smallest hashes."""
    import hashlib
    rows = [(i, float(i * i % 97) if i % 11 else None, i % 2 == 0) for i in range(400)]
    got = statistics.permutation_test(spark.createDataFrame(rows, "k int, v double, m boolean"), "k", "v", "m", n_rep=7, seed=3).collect()[0]
    means = []
    for rep in range(7):
        drawn = sorted(rows, key=lambda r: (hashlib.md5(f"3:{rep}:{r[0]}".encode()).hexdigest(), r[0]))[:200]
        values = [v for _, v, _ in drawn if v is not None]
        means.append(sum(values) / len(values))
    marked = [v for _, v, m in rows if m and v is not None]
    assert got["observed"] == pytest.approx(sum(marked) / len(marked)) and got["null_mean"] == pytest.approx(sum(means) / 7)
    assert got["p_value"] == pytest.approx(sum(x >= got["observed"] for x in means) / 7)


def test_recall_without_a_common_key_is_zero(spark):
    rows = [(i, float(i), float(-i)) for i in range(20)]
    done = statistics.recall_at_k(spark.createDataFrame(rows, "k int, e double, s double"), "k", "e", "s", [2, 5])
    assert sorted(tuple(r) for r in done.collect()) == [(2, 0.0), (5, 0.0)]


def test_partial_spearman_does_not_depend_on_the_order_of_lines(spark, tmp_path):
    """Half a cent: the mean of these prices, added as doubles in two orders, falls on both sides of it."""
    from lociframe.plans import statistics as plan
    duckdb = pytest.importorskip("duckdb")
    prices = [104110.9, 63417.33, 75322.55, 43664.54, 104643.58, 10672.42, 9634.97, 53849.75]
    other = [53849.75, 43664.54, 10672.42, 104643.58, 104110.9, 63417.33, 9634.97, 75322.55]
    parts = spark.createDataFrame([(1, 2.0, 0), (2, 1.0, 0), (3, 8.0, 0), (4, 5.0, 0), (5, 9.0, 0)], "p_partkey long, p_retailprice double, p_size long")
    results = set()
    for name, order in (("a", prices), ("b", other)):
        folder = tmp_path / name
        rows = [(1, p, 4.0 / 8) for p in order] + [(2, 58164.51, 9.0), (3, 70000.0, 3.0), (4, 100.0, 6.0), (5, 58164.5, 8.0)]
        parts.coalesce(1).write.parquet(str(folder / "part.parquet"))
        spark.createDataFrame(rows, "l_partkey long, l_extendedprice double, l_quantity double").coalesce(1).write.parquet(str(folder / "lineitem.parquet"))
        results.add(tuple(plan.partial_spearman(spark, str(folder)).collect()[0]))
        con = duckdb.connect()
        for table in ("part", "lineitem"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        results.add(con.execute(plan.ORACLES["partial_spearman"]).fetchone())
    assert len(results) == 1


def test_permutation_draws_are_dealt_over_tasks(spark, monkeypatch):
    """A pool of one partition does not leave all its draws to one task."""
    seen = []
    keep = statistics.checkpoint
    monkeypatch.setattr(statistics, "checkpoint", lambda df: seen.append(df.columns) or keep(df))
    monkeypatch.setattr(statistics, "DRAWS", 100)
    pool = spark.createDataFrame([(i, float(i % 7), i % 3 == 0) for i in range(60)], "k int, v double, m boolean").coalesce(1)
    done = statistics.permutation_test(pool, "k", "v", "m", n_rep=20, seed=3)
    # 1,200 draws, 100 a task; the pool is written once, not made anew for each scan.
    assert "REPARTITION_BY_NUM" in done._jdf.queryExecution().executedPlan().toString() and seen == [["k", "v", "m"]]


def test_transcript_tasks_follow_the_number_of_lines(spark, monkeypatch):
    from lociframe.plans import design
    asked = []
    monkeypatch.setattr(design, "task_count", lambda session, rows: asked.append(rows) or 37)
    folder = "/root/testdata/sf0.001"
    assert design._features(spark, folder).rdd.getNumPartitions() == 37
    assert asked == [spark.read.parquet(f"{folder}/lineitem.parquet").count()]
    assert scale.task_count(spark, 90_000_001) == 91 and scale.task_count(spark, 5) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_neighbour_search_asks_for_every_fiftieth_row(spark):
    from lociframe.plans import vectors
    folder = "/root/testdata/sf0.01"
    ids = [r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r["query_id"] for r in vectors.knn_idw(spark, folder).collect()) == sorted(i for i in ids if i % 50 == 0)


def test_dense_window_blocks_are_not_shuffled(spark):
    from lociframe.plans import cnv
    plan = cnv.window_smooth_signal(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    windows, dense = plan.split("Generate inline")[:2]
    assert "Exchange" not in windows and "Exchange" not in dense


def test_shuffled_spearman_by_hand_and_its_bytes(spark):
    """Equal to a plain calculation, also with ties, NULL values and one NULL key; about 20 bytes a draw are shuffled, not a row."""
    import hashlib
    rows = [(None if i == 7 else i, None if i % 31 == 3 else float(i * 37 % 101), None if i % 17 == 2 else float(i * i % 53)) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    got = statistics.shuffled_spearman(df, "k", "x", "y", n_rep=9, seed=4).collect()[0]
    rank = lambda values: [None if v is None else sum(w < v for w in values if w is not None) + (sum(w == v for w in values) + 1) / 2 for v in values]
    rx, ry = rank([r[1] for r in rows]), rank([r[2] for r in rows])
    by_key = sorted(range(600), key=lambda i: -1 if rows[i][0] is None else rows[i][0])
    spread = np.std([v for v in rx if v is not None]) * np.std([v for v in ry if v is not None])
    found = []
    for rep in range(9):
        mixed = sorted(range(600), key=lambda i: hashlib.md5(":".join(["4", str(rep)] + ([] if rows[i][0] is None else [str(rows[i][0])])).encode()).hexdigest())
        pairs = np.array([(rx[a], ry[b]) for a, b in zip(by_key, mixed, strict=True) if rx[a] is not None and ry[b] is not None])
        found.append(np.cov(pairs.T, ddof=0)[0, 1] / spread)
    assert got["n_rep"] == 9 and got["null_mean"] == pytest.approx(np.mean(found)) and got["null_sd"] == pytest.approx(np.std(found))

    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    large = spark.range(20_000).select("id", (F.col("id") * 37 % 1009).cast("double").alias("x"), (F.col("id") * 11 % 503).cast("double").alias("y"))
    statistics.shuffled_spearman(large, "id", "x", "y", n_rep=100).collect()
    assert 0 < written() - before < 28 * 20_000 * 100
    assert tuple(statistics.shuffled_spearman(large.where("id < 0"), "id", "x", "y", n_rep=3).collect()[0]) == (0, None, None)


def test_neighbour_search_asks_for_every_row(spark):
    from lociframe.plans import vectors
    folder = "/root/testdata/sf0.001"
    ids = [r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r["query_id"] for r in vectors.knn_idw(spark, folder).collect()) == sorted(ids)
    assert "% 50" not in vectors.ORACLES["knn_idw"]


def test_nearest_rows_of_a_block_equal_brute_force():
    """Ties, copies and scales where the matrix product alone is not exact."""
    from lociframe.operators import embeddings
    rng = np.random.default_rng(1)
    for scale_of in (1e-6, 1.0, 1e6):
        b = rng.integers(0, 3, size=(50, 4)) * scale_of + rng.integers(0, 2, size=(50, 1)) * 1e-9
        a = np.vstack([rng.normal(size=(20, 4)), b[:5]])
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
        row, col, found = embeddings._nearest(a, b, 7)
        assert (row == np.repeat(np.arange(25), 7)).all() and np.allclose(found, np.sort(d, axis=1)[:, :7].ravel(), rtol=1e-12, atol=0)
        assert (found.reshape(25, 7)[20:, 0] == 0).all() and len(set(zip(row, col, strict=True))) == 25 * 7
    assert embeddings._packed(np.zeros((3, 2)), np.array([2.0, 2.0, 9.0]), 4).tolist() == [0, 0, 1]
