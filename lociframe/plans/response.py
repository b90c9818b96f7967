"""Response queries: every gene of the fitted space is perturbed, one by one and all together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..operators import cells as cell_op
from ..operators import response as op
from ..scale import checkpoint
from . import bindings as b
from .bindings import with_views
from .cells import MOMENTS, expression

# Size of the fitted space; all genes where there are fewer.
SPACE = 5000


def _fit(spark, folder):
    # The fitted tables are read by every later step, so they are materialised once.
    expr = checkpoint(expression(spark, folder))
    moments = checkpoint(cell_op.gene_moments(expr, b.cells(spark, folder), b.cell_genes(spark, folder)))
    space = op.fit_space(moments, SPACE)
    targets = space.select("gene_id")
    return expr, space, targets


def _shifts(space, targets):
    single = targets.withColumn("direction", F.explode(F.array(F.lit("ko"), F.lit("oe")))).withColumn(
        "pert_id", F.concat_ws(":", "direction", "gene_id"))
    joint = targets.select("gene_id", F.lit("ko").alias("direction"), F.lit("all").alias("pert_id"))
    return op.perturbation_shift(single.unionByName(joint), space)


def _response(spark, folder):
    expr, space, targets = _fit(spark, folder)
    shifts = _shifts(space, targets)
    response = op.linear_response(op.covariance_columns(expr, space, targets), shifts, space)
    return checkpoint(response), shifts, expr, space


def covariance_columns(spark, folder):
    expr, space, targets = _fit(spark, folder)
    done = op.covariance_columns(expr, space, targets)
    return done.select("gene_id", "target_id", fixed("cov").alias("cov"))


def linear_response(spark, folder):
    return _response(spark, folder)[0].select("pert_id", "gene_id", fixed("delta").alias("delta"), fixed("perturbed").alias("perturbed"))


def response_band(spark, folder):
    done = op.response_band(_response(spark, folder)[0])
    return done.select("pert_id", "gene_id", fixed("ci_low").alias("ci_low"), fixed("ci_high").alias("ci_high"))


def response_summary(spark, folder):
    done = op.response_summary(_response(spark, folder)[0])
    return done.select("pert_id", fixed("delta_abs_max").alias("delta_abs_max"), fixed("delta_abs_mean").alias("delta_abs_mean"), "n_up", "n_down")


def additive_baseline(spark, folder):
    response, shifts, _, _ = _response(spark, folder)
    return op.additive_baseline(response, shifts).select(
        "pert_id", "gene_id", "is_target", fixed("baseline_additive").alias("baseline_additive"))


def baseline_compare(spark, folder):
    response, shifts, _, _ = _response(spark, folder)
    done = op.compare_with_baselines(response, shifts)
    return done.select("pert_id", "gene_id", "at", "is_target", fixed("delta").alias("delta"),
                       fixed("baseline_ctrl_mean").alias("baseline_ctrl_mean"), fixed("baseline_additive").alias("baseline_additive"))


def group_response(spark, folder):
    response, _, expr, space = _response(spark, folder)
    done = op.group_response(response, expr, b.cells(spark, folder), space)
    return done.select("pert_id", "cell_type", "n_cells", fixed("response").alias("response"),
                       F.array_join(F.transform("drivers", lambda g: g.cast("string")), ",").alias("drivers"))


def group_response_top500(spark, folder):
    expr, space, targets = _fit(spark, folder)
    # The response of genes in no group's top would not be read; that of the others is read once, so it is not written.
    top = checkpoint(op.top_expressed(expr, b.cells(spark, folder), space, 500))
    response = op.linear_response(op.covariance_columns(expr, space, targets, genes=top), _shifts(space, targets), space)
    done = op.group_response_top_expressed(response, top)
    return done.select("pert_id", "cell_type", "n_cells", fixed("response").alias("response"))


def target_group_mean(spark, folder):
    _, shifts, expr, _ = _response(spark, folder)
    done = op.target_group_mean(shifts, expr, b.cells(spark, folder))
    return done.select("pert_id", "gene_id", "cell_type", fixed("target_expr").alias("target_expr"))


QUERIES = {f.__name__: f for f in (
    covariance_columns, linear_response, response_band, response_summary, additive_baseline, baseline_compare,
    group_response, group_response_top500, target_group_mean)}

FIT = MOMENTS + f""", space AS (SELECT * FROM mom ORDER BY variance DESC, gene_id LIMIT {SPACE}),
  ridge AS (SELECT 0.1 * avg(variance) AS r FROM space), tg AS (SELECT gene_id AS t, mean AS tm FROM space),
  inx AS (SELECT * FROM expr WHERE gene_id IN (SELECT gene_id FROM space)),
  prod AS (SELECT a.gene_id, b.gene_id AS t, sum(a.x * b.x) AS xy FROM inx a JOIN inx b ON a.cell_id = b.cell_id AND b.gene_id IN (SELECT t FROM tg) GROUP BY 1, 2),
  cov AS (SELECT s.gene_id, tg.t, (coalesce(xy, 0) - n_cells * mean * tm) / (n_cells - 1) + CASE WHEN s.gene_id = tg.t THEN r ELSE 0 END AS cov
    FROM space s JOIN tg ON true JOIN ridge ON true LEFT JOIN prod p ON p.gene_id = s.gene_id AND p.t = tg.t),
  pert AS (SELECT 'ko:' || t AS pert_id, t, -tm AS u FROM tg UNION ALL SELECT 'oe:' || t, t, tm FROM tg UNION ALL SELECT 'all', t, -tm FROM tg),
  resp AS (SELECT pert_id, c.gene_id, sum(cov * u) AS delta FROM cov c JOIN pert USING (t) GROUP BY 1, 2),
  full_r AS (SELECT r.*, s.mean, s.variance FROM resp r JOIN space s USING (gene_id)),
  base AS (SELECT f.pert_id, f.gene_id, f.delta, f.mean, f.mean + coalesce(u, 0) AS add_b, u IS NOT NULL AS is_target
    FROM full_r f LEFT JOIN pert p ON p.pert_id = f.pert_id AND p.t = f.gene_id)"""

GROUPS = FIT + """, sz AS (SELECT cell_type, count(*) AS n_cells FROM cells GROUP BY 1 HAVING count(*) >= 5),
  gm AS (SELECT z.cell_type, z.n_cells, s.gene_id, coalesce(sum(x), 0) / z.n_cells AS m FROM sz z JOIN space s ON true
    LEFT JOIN (SELECT * FROM inx JOIN cells USING (cell_id)) i ON i.cell_type = z.cell_type AND i.gene_id = s.gene_id GROUP BY 1, 2, 3),
  en AS (SELECT *, greatest(m - avg(m) OVER (PARTITION BY gene_id), 0) AS w FROM gm),
  wd AS (SELECT pert_id, cell_type, n_cells, gene_id, w, abs(delta) AS d, row_number() OVER (PARTITION BY pert_id, cell_type ORDER BY w * abs(delta) DESC, gene_id) AS k
    FROM en JOIN full_r USING (gene_id))"""

NEED = "expr cells cell_genes"
ORACLES = {
    "covariance_columns": with_views(NEED, f"WITH {FIT} SELECT gene_id, t AS target_id, round(cov, 6) AS cov FROM cov"),
    "linear_response": with_views(NEED, f"WITH {FIT} SELECT pert_id, gene_id, round(delta, 6) AS delta, round(mean + delta, 6) AS perturbed FROM full_r"),
    "response_band": with_views(NEED, f"""WITH {FIT} SELECT pert_id, gene_id, round(delta - 0.0196 * sqrt(variance + r), 6) AS ci_low,
        round(delta + 0.0196 * sqrt(variance + r), 6) AS ci_high FROM full_r, ridge"""),
    "response_summary": with_views(NEED, f"""WITH {FIT} SELECT pert_id, round(max(abs(delta)), 6) AS delta_abs_max, round(avg(abs(delta)), 6) AS delta_abs_mean,
        count(*) FILTER (delta > 0.001) AS n_up, count(*) FILTER (delta < -0.001) AS n_down FROM full_r GROUP BY 1"""),
    "additive_baseline": with_views(NEED, f"WITH {FIT} SELECT pert_id, gene_id, is_target, round(add_b, 6) AS baseline_additive FROM base"),
    "baseline_compare": with_views(NEED, f"""WITH {FIT}, k AS (SELECT *, row_number() OVER (PARTITION BY pert_id ORDER BY abs(delta) DESC, gene_id) AS at_k FROM base)
        SELECT pert_id, gene_id, at_k AS at, is_target, round(delta, 6) AS delta, round(mean, 6) AS baseline_ctrl_mean,
          round(add_b, 6) AS baseline_additive FROM k WHERE at_k <= 30"""),
    "group_response": with_views(NEED, f"""WITH {GROUPS} SELECT pert_id, cell_type, n_cells, round(CASE WHEN sqrt(sum(w * w)) > 1e-9 AND sqrt(sum(d * d)) > 1e-9
        THEN sum(w * d) / (sqrt(sum(w * w)) * sqrt(sum(d * d))) ELSE 0 END, 6) AS response,
        string_agg(gene_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 3 AND w > 0) AS drivers FROM wd GROUP BY 1, 2, 3"""),
    "group_response_top500": with_views(NEED, f"""WITH {GROUPS}, hi AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY m DESC, gene_id) AS k FROM gm)
        SELECT pert_id, cell_type, n_cells, round(avg(abs(delta)), 6) AS response FROM hi JOIN full_r USING (gene_id) WHERE k <= 500 GROUP BY 1, 2, 3"""),
    "target_group_mean": with_views(NEED, f"""WITH {GROUPS} SELECT pert_id, t AS gene_id, cell_type, round(m, 6) AS target_expr FROM pert JOIN gm ON gm.gene_id = pert.t"""),
}
