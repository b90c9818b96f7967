"""Statistics queries over per-part features and over flattened embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..operators import statistics as op
from . import bindings as b
from .bindings import with_views
from .cells import condition_text


def _features(spark, folder, price=None):
    price = F.avg("l_extendedprice") if price is None else price
    lines = b.table(spark, folder, "lineitem").groupBy("l_partkey").agg(price.alias("attr"), F.sum("l_quantity").alias("expr"))
    part = b.table(spark, folder, "part")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return part.join(lines, part.p_partkey == lines.l_partkey, "left").select(
        F.col("p_partkey").alias("gene_id"), F.round(zero("attr"), 2).alias("attr"), zero("expr").alias("expr"),
        (F.col("p_retailprice") + F.col("p_size")).alias("effect"))


def _attribution(spark, folder):
    return b.embeddings(spark, folder).select(
        "cell_id", "label", F.when(F.col("label") < 5, "MS").otherwise("normal").alias("group"),
        F.posexplode("embedding").alias("feature", "value"))


def score_quantiles(spark, folder):
    done = op.score_quantiles(b.table(spark, folder, "lineitem"), "l_extendedprice")
    return done.select(*[fixed(c).alias(c) for c in done.columns])


def spearman(spark, folder):
    return op.spearman(_features(spark, folder), "attr", "effect").withColumn("spearman", fixed("spearman"))


def pearson(spark, folder):
    return op.pearson(_features(spark, folder), "attr", "effect").withColumn("pearson", fixed("pearson"))


def _price_in_cents():
    """Mean price rounded to cents from whole cents: a mean of doubles falls on either side of half a cent, by the order of its lines."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return F.call_function("div", F.sum(cents) * 2 + F.count(cents), F.count(cents) * 2) / 100


def partial_spearman(spark, folder):
    done = op.partial_spearman(_features(spark, folder, _price_in_cents()), "attr", "expr", "effect")
    return done.withColumn("partial_spearman", fixed("partial_spearman"))


def recall_at_k(spark, folder):
    done = op.recall_at_k(_features(spark, folder), "gene_id", "effect", "expr", [50, 200, 500])
    return done.withColumn("recall", fixed("recall"))


def jaccard_topk(spark, folder):
    return op.jaccard_top_k(_features(spark, folder), "gene_id", "attr", "expr", 200).withColumn("jaccard", fixed("jaccard"))


def auroc(spark, folder):
    return op.auroc(_features(spark, folder), "gene_id", "effect", "attr").withColumn("auroc", fixed("auroc"))


def _label_means(spark, folder):
    return _attribution(spark, folder).groupBy("label", "feature").agg(F.avg("value").alias("value"))


def rank_of_feature(spark, folder):
    means = _label_means(spark, folder)
    targets = means.where("feature = label * 5").select("label", "feature")
    done = op.rank_of_feature(means, targets, ["label"], "feature", "value")
    return done.select("label", F.col("target").cast("bigint").alias("target"), "rank")


def differential_table(spark, folder):
    done = op.differential_table(_attribution(spark, folder), "MS", "normal")
    return done.select(F.col("feature").cast("bigint").alias("feature"), *[fixed(c).alias(c) for c in ("mean_a", "mean_b", "diff", "effect_size")])


def _conditions(spark, folder):
    from ..operators.cells import perturbed_gene
    gene = F.coalesce(F.substring(perturbed_gene(condition_text()), 2, 10), F.when(condition_text() == "ctrl", "ctrl"))
    return b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cell_id"), gene.alias("perturbed")).where("perturbed IS NOT NULL")


def off_target_impact(spark, folder):
    done = op.off_target_impact(b.counts(spark, folder), _conditions(spark, folder), value="count")
    return done.withColumn("impact", fixed("impact"))


def diff_expression(spark, folder):
    done = op.diff_expression(b.counts(spark, folder), _conditions(spark, folder), b.cell_genes(spark, folder), value="count")
    return done.withColumn("diff", fixed("diff"))


def permutation_test(spark, folder):
    pool = _features(spark, folder).withColumn("marker", F.col("effect") > 1000)
    done = op.permutation_test(pool, "gene_id", "expr", "marker", 200)
    return done.select(*[fixed(c).alias(c) for c in done.columns])


def shuffled_spearman(spark, folder):
    done = op.shuffled_spearman(_features(spark, folder), "gene_id", "attr", "effect", 200)
    return done.withColumn("null_mean", fixed("null_mean")).withColumn("null_sd", fixed("null_sd"))


def mean_abs_attribution(spark, folder):
    cells = b.embeddings(spark, folder).where("label = 0")
    done = op.mean_abs_attribution(_attribution(spark, folder), cells)
    return done.select(F.col("feature").cast("bigint").alias("feature"), fixed("mean_abs").alias("mean_abs"))


def attribution_enrichment(spark, folder):
    attribution = _attribution(spark, folder).select("cell_id", F.col("feature").cast("bigint").alias("gene_id"), "value")
    done = op.attribution_enrichment(attribution, b.counts(spark, folder), b.cells(spark, folder), b.cell_genes(spark, folder), value="count")
    return done.select("cell_id", "gene_id", "at", fixed("attribution").alias("attribution"), "expr",
                       fixed("pop_mean").alias("pop_mean"), fixed("enrichment").alias("enrichment"))


def attribution_delta_topk(spark, folder):
    means = _label_means(spark, folder)
    control = means.where("label = 0").select("feature", "value")
    labels = means.where("label <> 0").select("label").distinct()
    before = means.where("label <> 0").select("label", "feature").join(control, "feature")
    done = op.attribution_delta_topk(before, means.join(labels, "label", "left_semi"), ["label"])
    return done.select("label", F.col("feature").cast("bigint").alias("feature"), "at", fixed("delta").alias("delta"))


QUERIES = {f.__name__: f for f in (
    score_quantiles, spearman, pearson, partial_spearman, recall_at_k, jaccard_topk, auroc, rank_of_feature, differential_table,
    off_target_impact, diff_expression, permutation_test, shuffled_spearman, mean_abs_attribution, attribution_enrichment,
    attribution_delta_topk)}

FEATURES = """feat AS (SELECT p_partkey AS gene_id, round(coalesce(a, 0), 2) AS attr, coalesce(q, 0) AS expr, p_retailprice + p_size AS effect FROM part
    LEFT JOIN (SELECT l_partkey, avg(l_extendedprice) AS a, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""

# Means in whole cents do not depend on the order in which prices are added.
CENTS = FEATURES.replace("avg(l_extendedprice) AS a", """(2 * sum(floor(l_extendedprice * 100 + 0.5)::BIGINT) + count(l_extendedprice))
      // (2 * count(l_extendedprice)) / 100 AS a""")


def _rank(value, source_key=""):
    return f"rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2"


RANKED = f""", rk AS (SELECT *, {_rank('attr')} AS ra, {_rank('expr')} AS rx, {_rank('effect')} AS re FROM feat)"""
RANKS, CENTS_RANKS = FEATURES + RANKED, CENTS + RANKED

ATTR = """att AS (SELECT cell_id, label, CASE WHEN label < 5 THEN 'MS' ELSE 'normal' END AS grp, unnest(range(0, len(embedding))) AS feature,
    unnest(embedding) AS value FROM vecs), lm AS (SELECT label, feature, avg(value) AS value FROM att GROUP BY 1, 2)"""

COND = """cond AS (SELECT c_custkey AS cell_id, CASE c_nationkey % 4 WHEN 0 THEN 'ctrl' WHEN 3 THEN CASE WHEN c_nationkey = 1 THEN '1' END
      ELSE c_nationkey::VARCHAR END AS perturbed FROM customer WHERE c_nationkey % 4 <> 3),
  cs AS (SELECT perturbed, count(*) AS n_cells FROM cond GROUP BY 1 HAVING count(*) >= 10),
  pm AS (SELECT cs.perturbed, cs.n_cells, g.gene_id, coalesce(sum(n), 0) / cs.n_cells AS m FROM cs JOIN cell_genes g ON true
    LEFT JOIN (SELECT * FROM counts JOIN cond USING (cell_id)) x ON x.gene_id = g.gene_id AND x.perturbed = cs.perturbed GROUP BY 1, 2, 3),
  de AS (SELECT t.perturbed, t.n_cells, t.gene_id, t.m - c.m AS diff FROM pm t JOIN pm c USING (gene_id) WHERE c.perturbed = 'ctrl' AND t.perturbed <> 'ctrl')"""

ORACLES = {
    "score_quantiles": """SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
        round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem""",
    "spearman": f"WITH {RANKS} SELECT count(*) AS n, round(corr(ra, re), 6) AS spearman FROM rk",
    "pearson": f"WITH {FEATURES} SELECT count(*) AS n, round(corr(attr, effect), 6) AS pearson FROM feat",
    "partial_spearman": f"""WITH {CENTS_RANKS}, fit AS (SELECT regr_slope(ra, re) AS sa, regr_intercept(ra, re) AS ia, regr_slope(rx, re) AS sx, regr_intercept(rx, re) AS ix FROM rk),
        res AS (SELECT round(ra - (sa * re + ia), 9) AS x, round(rx - (sx * re + ix), 9) AS y FROM rk, fit),
        rr AS (SELECT {_rank('x')} AS x, {_rank('y')} AS y FROM res) SELECT count(*) AS n, round(corr(x, y), 6) AS partial_spearman FROM rr""",
    "recall_at_k": f"""WITH {FEATURES}, p AS (SELECT row_number() OVER (ORDER BY effect DESC, gene_id) AS a, row_number() OVER (ORDER BY expr DESC, gene_id) AS b FROM feat)
        SELECT k::BIGINT AS k, round(count(*) FILTER (a <= k AND b <= k) / k, 6) AS recall FROM p, (SELECT unnest([50, 200, 500]) AS k) GROUP BY k""",
    "jaccard_topk": f"""WITH {FEATURES}, p AS (SELECT row_number() OVER (ORDER BY abs(attr) DESC, gene_id) <= 200 AS a,
          row_number() OVER (ORDER BY abs(expr) DESC, gene_id) <= 200 AS b FROM feat)
        SELECT round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 6) AS jaccard, count(*) FILTER (a OR b) AS n_union FROM p""",
    "auroc": f"""WITH {RANKS}, p AS (SELECT ra, row_number() OVER (ORDER BY effect DESC, gene_id) <= greatest(1, floor((SELECT count(*) FROM part) * 0.1)) AS pos FROM rk),
        s AS (SELECT sum(ra) FILTER (pos) AS s, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn FROM p)
        SELECT np AS n_positive, round((s - np * (np + 1) / 2) / (np * nn), 6) AS auroc FROM s""",
    "rank_of_feature": with_views("vecs", f"""WITH {ATTR} SELECT t.label, t.feature AS target, count(*) AS rank FROM lm t JOIN lm o ON o.label = t.label
        AND abs(o.value) >= abs(t.value) WHERE t.feature = t.label * 5 GROUP BY 1, 2"""),
    "differential_table": with_views("vecs", f"""WITH {ATTR}, s AS (SELECT feature, avg(value) FILTER (grp = 'MS') AS a, avg(value) FILTER (grp = 'normal') AS b,
          var_pop(value) FILTER (grp = 'MS') AS va, var_pop(value) FILTER (grp = 'normal') AS vb FROM att GROUP BY 1)
        SELECT feature, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(a - b, 6) AS diff, round((a - b) / (sqrt((va + vb) / 2) + 1e-6), 6) AS effect_size FROM s"""),
    "off_target_impact": with_views("counts cell_genes", f"""WITH {COND} SELECT perturbed, n_cells, round(sum(abs(diff)) FILTER (gene_id::VARCHAR <> perturbed), 6) AS impact
        FROM de GROUP BY 1, 2"""),
    "diff_expression": with_views("counts cell_genes", f"WITH {COND} SELECT perturbed, gene_id, round(diff, 6) AS diff FROM de"),
    "permutation_test": f"""WITH {FEATURES}, m AS (SELECT count(*) AS m, avg(expr) AS v FROM feat WHERE effect > 1000),
        d AS (SELECT rep, expr, row_number() OVER (PARTITION BY rep ORDER BY md5('0:' || rep || ':' || gene_id), gene_id) AS k FROM feat, (SELECT unnest(range(0, 200)) AS rep)),
        n AS (SELECT rep, avg(expr) AS v FROM d WHERE k <= (SELECT m FROM m) GROUP BY 1)
        SELECT round((SELECT v FROM m), 6) AS observed, round(avg(v), 6) AS null_mean, round(stddev_pop(v), 6) AS null_sd,
          round(avg((v >= (SELECT v FROM m))::INT), 6) AS p_value FROM n""",
    "shuffled_spearman": f"""WITH {RANKS}, base AS (SELECT *, row_number() OVER (ORDER BY gene_id) AS pos FROM rk),
        d AS (SELECT rep, re, row_number() OVER (PARTITION BY rep ORDER BY md5('0:' || rep || ':' || gene_id), gene_id) AS pos FROM rk, (SELECT unnest(range(0, 200)) AS rep)),
        c AS (SELECT rep, corr(b.ra, d.re) AS c FROM d JOIN base b USING (pos) GROUP BY 1)
        SELECT count(*) AS n_rep, round(avg(c), 6) AS null_mean, round(stddev_pop(c), 6) AS null_sd FROM c""",
    "mean_abs_attribution": with_views("vecs", f"""WITH {ATTR} SELECT feature, round(sum(abs(value)) / (SELECT count(*) FROM vecs WHERE label = 0), 6) AS mean_abs
        FROM att WHERE label = 0 GROUP BY 1"""),
    "attribution_enrichment": with_views("vecs counts cells cell_genes", f"""WITH {ATTR}, t AS (SELECT cell_id, feature AS gene_id, value,
          row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, feature) AS at_k FROM att),
        m AS (SELECT gene_id, sum(n) / (SELECT count(*) FROM cells) AS m FROM counts JOIN cell_genes USING (gene_id) GROUP BY 1)
        SELECT t.cell_id, t.gene_id, at_k AS at, round(value, 6) AS attribution, coalesce(n, 0) AS expr, round(coalesce(m, 0), 6) AS pop_mean,
          round(coalesce(n, 0) - coalesce(m, 0), 6) AS enrichment FROM t LEFT JOIN counts c ON c.cell_id = t.cell_id AND c.gene_id = t.gene_id
          LEFT JOIN m ON m.gene_id = t.gene_id WHERE at_k <= 12"""),
    "attribution_delta_topk": with_views("vecs", f"""WITH {ATTR}, d AS (SELECT a.label, a.feature, a.value - z.value AS delta,
          row_number() OVER (PARTITION BY a.label ORDER BY abs(a.value - z.value) DESC, a.feature) AS at_k FROM lm a JOIN lm z USING (feature) WHERE z.label = 0 AND a.label <> 0)
        SELECT label, feature, at_k AS at, round(delta, 6) AS delta FROM d WHERE at_k <= 15"""),
}
