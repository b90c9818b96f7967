"""Scoring, ranking, tuning and selection queries over the candidate panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SCREENING, Evidence, OrganPenalty
from ..functions.columns import fixed
from ..operators import consensus as op
from ..operators import selection as sel
from ..operators import tuning as tune
from ..operators.intervals import genes_in_intervals
from . import bindings as b
from .bindings import with_views

COLUMNS = ("clinGen_hi_score", "gnomad_LOEUF", "gnomad_pLI")


def _plain(spark, folder):
    return b.panel(spark, folder).drop("recessive")


def _norms(df):
    return df.select("case_id", "gene_id", *[fixed(f"norm_{c}").alias(f"norm_{c}") for c in COLUMNS])


def normalize_raw(spark, folder):
    return _norms(op.normalize_evidence(_plain(spark, folder), SCREENING.evidence, "raw"))


def normalize_zscore(spark, folder):
    return _norms(op.normalize_evidence(_plain(spark, folder), SCREENING.evidence, "zscore"))


def normalize_rank(spark, folder):
    return _norms(op.normalize_evidence(_plain(spark, folder), SCREENING.evidence, "rank"))


def normalize_ordinal(spark, folder):
    specs = (Evidence("gnomad_LOEUF", 1, "lower_better", 2), Evidence("gnomad_pLI", 1, "ordinal", 0.5))
    done = op.normalize_evidence(_plain(spark, folder), specs, "rank")
    return done.select("case_id", "gene_id", fixed("norm_gnomad_LOEUF").alias("norm_gnomad_LOEUF"),
                       fixed("norm_gnomad_pLI").alias("norm_gnomad_pLI"))


def consensus_score_rank(spark, folder):
    done = op.consensus_rank(_plain(spark, folder), SCREENING)
    return done.select("case_id", "gene_id", "rank", fixed("consensus_score").alias("consensus_score"),
                       *[fixed(f"contrib_{c}").alias(f"contrib_{c}") for c in COLUMNS])


def consensus_penalty(spark, folder):
    from ..operators.evidence import organ_rollup
    organs = organ_rollup(b.tissue_long(spark, folder), {"one": ["AF"], "two": ["NO"], "three": ["RF"]})
    cfg = SCREENING.with_(recessive_factor=0.5, penalty=OrganPenalty(("one", "two", "three"), 70000.0, -2.0, -4.0))
    done = op.consensus_rank(b.panel(spark, folder).join(organs, "gene_id", "left"), cfg)
    return done.select("case_id", "gene_id", "rank", fixed("hpa_penalty").alias("hpa_penalty"),
                       fixed("consensus_score").alias("consensus_score"))


def evidence_status_gate(spark, folder):
    gate = op.evidence_gate(op.consensus_score(_plain(spark, folder), SCREENING), SCREENING)
    return gate.select("case_id", "n_candidates", "rejected", fixed("missing_rate").alias("missing_rate"),
                       *[fixed(f"coverage_{c}").alias(f"coverage_{c}") for c in COLUMNS])


def borda_rank(spark, folder):
    done = op.borda(op.consensus_score(_plain(spark, folder), SCREENING), SCREENING)
    return done.select("case_id", "gene_id", fixed("borda_score").alias("borda_score"), "borda_rank")


def rank_agreement(spark, folder):
    done = op.borda(op.consensus_score(_plain(spark, folder), SCREENING), SCREENING)
    return op.rank_agreement(done, "consensus_score", "borda_score").select(
        "case_id", "n", fixed("spearman").alias("spearman"))


def _designed(spark, folder):
    part = b.table(spark, folder, "part")
    status = F.when(F.col("p_type") == "ECONOMY", "incomplete_coding_annotation").otherwise("ok")
    design = part.select(F.col("p_partkey").alias("gene_id"), status.alias("utr3_status"), F.col("p_size").alias("utr3_bp"))
    ranked = op.consensus_rank(_plain(spark, folder), SCREENING)
    return ranked.join(design, "gene_id", "left")


def _selected(spark, folder):
    viability = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("gene_id"), F.when(F.col("s_acctbal") > 5000, "viable").otherwise("lethal").alias("impc_viability"))
    designed = (_designed(spark, folder).withColumn("clinGen_haploinsufficiency_raw", F.col("clinGen_hi_score"))
                .join(viability, "gene_id", "left"))
    return sel.budget_select(designed, capacity=1500)


def budget_select(spark, folder):
    return _selected(spark, folder).select("case_id", "gene_id", "rank", "selected", "selection_reason",
                                           fixed("consensus_score").alias("consensus_score"))


def evidence_notes(spark, folder):
    return _selected(spark, folder).select("case_id", "gene_id", "evidence_notes")


def run_summary(spark, folder):
    done = sel.run_summary(_selected(spark, folder), coverage=("gnomad_pLI", "gnomad_LOEUF"))
    return done.select("case_id", "n_candidates", "n_selected", "n_without_evidence", "n_annotation_gaps",
                       fixed("coverage_gnomad_pLI").alias("coverage_pli"), fixed("coverage_gnomad_LOEUF").alias("coverage_loeuf"))


def summary_projection(spark, folder):
    done = sel.summary_view(_selected(spark, folder))
    return done.select("case_id", "rank", "symbol", "gene_id", fixed("consensus_score").alias("consensus_score"),
                       "evidence_status", "interval_overlap", "utr3_bp", "selected", "selection_reason", "ot_status")


def _ranks(spark, folder):
    return tune.control_ranks(_plain(spark, folder), b.controls(spark, folder), SCREENING)


def weight_grid_recall(spark, folder):
    done = tune.grid_recall(_ranks(spark, folder), 10)
    return done.select("case_id", F.col("grid_id").cast("bigint").alias("grid_id"), "n_controls", fixed("recall").alias("recall"))


def loo_folds(spark, folder):
    return tune.loo_folds(_ranks(spark, folder), 10).withColumn("train_recall", fixed("train_recall"))


def loo_tune(spark, folder):
    done = tune.loo_tune(_ranks(spark, folder), 10, cases=b.cases(spark, folder))
    return done.select("case_id", "n_controls", "final_grid_id", fixed("final_recall").alias("final_recall"),
                       fixed("loo_hit_rate").alias("loo_hit_rate"), "note")


def tuned_rank(spark, folder):
    tuned = tune.loo_tune(_ranks(spark, folder), 10, cases=b.cases(spark, folder))
    done = tune.tuned_rank(_plain(spark, folder), tuned, SCREENING)
    return done.select("case_id", "gene_id", "tuned", fixed("tuned_score").alias("tuned_score"), "tuned_rank")


def _wanted(spark, folder):
    """Every control symbol is asked for in every third case, and two that no case has."""
    extra = b.cases(spark, folder).select("case_id", F.explode(F.array(F.lit("ABSENT1"), F.lit(" absent2 "))).alias("symbol"))
    inside = b.candidates(spark, folder).select("case_id", "symbol").join(b.controls(spark, folder), "symbol", "left_semi").select("case_id", "symbol")
    return inside.union(extra)


def missing_controls(spark, folder):
    ranks = _ranks(spark, folder)
    return tune.missing_controls(ranks, b.cases(spark, folder), _wanted(spark, folder))


def screen_cohort(spark, folder):
    """The whole run: gated cases, weights tuned on each case's controls, consensus and Borda ranks."""
    from ..workflows import screen_cohort as run
    from .design import _features as features
    panel = b.panel(spark, folder).drop("recessive")
    done = run(panel, features(spark, folder), panel, controls=_wanted(spark, folder))
    return done.ranked.select("case_id", "gene_id", "rank", fixed("consensus_score").alias("consensus_score"), F.get("weights", F.lit(0)).alias("first_weight"))


def weight_sensitivity(spark, folder):
    return tune.weight_sensitivity(_plain(spark, folder), SCREENING)


def weight_robustness(spark, folder):
    return tune.robustness(tune.weight_sensitivity(_plain(spark, folder), SCREENING))


def _checked(spark, folder):
    wide = b.cases(spark, folder).withColumn("start", F.col("start") - 20000).withColumn("end", F.col("end") + 20000)
    near = genes_in_intervals(b.genes(spark, folder), wide, b.BIN).join(b.controls(spark, folder), "symbol", "left_semi")
    ranked = op.consensus_rank(_plain(spark, folder), SCREENING)
    return op.control_check(ranked, near.select("case_id", "symbol"))


def control_check(spark, folder):
    return _checked(spark, folder).select("case_id", "control", "in_candidates", "rank", "top10",
                                          fixed("consensus_score").alias("consensus_score"))


def control_summary(spark, folder):
    return op.control_summary(_checked(spark, folder))


def validation_panel(spark, folder):
    return op.validation_panel(_checked(spark, folder)).select("case_id", "control", "rank", "target_ok")


def validation_pass(spark, folder):
    return op.validation_pass(op.validation_panel(_checked(spark, folder)), cases=b.cases(spark, folder))


def sparse_evidence_warnings(spark, folder):
    done = op.sparse_evidence_warnings(op.consensus_rank(_plain(spark, folder), SCREENING), min_coverage=0.5)
    return done.select("case_id", "n_genes", fixed("dosage_coverage").alias("dosage_coverage"),
                       fixed("top3_gap").alias("top3_gap"), fixed("score_sd").alias("score_sd"),
                       F.array_join("warnings", ",").alias("warnings"))


QUERIES = {f.__name__: f for f in (
    normalize_raw, normalize_zscore, normalize_rank, normalize_ordinal, consensus_score_rank, consensus_penalty,
    evidence_status_gate, borda_rank, rank_agreement, budget_select, evidence_notes, run_summary, summary_projection,
    weight_grid_recall, loo_folds, loo_tune, tuned_rank, missing_controls, screen_cohort, weight_sensitivity, weight_robustness, control_check, control_summary,
    validation_panel, validation_pass, sparse_evidence_warnings)}

NORMS = """SELECT case_id, gene_id, round(n_hi, 6) AS "norm_clinGen_hi_score", round(n_loeuf, 6) AS "norm_gnomad_LOEUF",
    round(n_pli, 6) AS "norm_gnomad_pLI" FROM """

GRID = """grid AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS grid_id, a, b, c, abs(a - 3) + abs(b - 2) + abs(c - 2) AS l1
    FROM (SELECT unnest([0, 1, 2, 3]) AS a), (SELECT unnest([0, 1, 2, 3]) AS b), (SELECT unnest([0, 1, 2, 3]) AS c) WHERE a + b + c > 0),
  runs AS (SELECT n.case_id, n.symbol, grid_id, l1, row_number() OVER (PARTITION BY case_id, grid_id ORDER BY
      coalesce(n_hi, 0) * a + coalesce(n_loeuf, 0) * b + coalesce(n_pli, 0) * c DESC, hgnc_id) AS rnk FROM normed n, grid),
  ctl AS (SELECT * FROM runs JOIN controls USING (symbol)),
  tot AS (SELECT case_id, grid_id, count(*) AS n, count(*) FILTER (rnk <= 10) AS hits FROM ctl GROUP BY ALL)"""

FOLDS = GRID + """, folds AS (SELECT c.case_id, c.symbol, c.grid_id, c.rnk, t.n, row_number() OVER (PARTITION BY c.case_id, c.symbol
      ORDER BY t.hits - (c.rnk <= 10)::INT DESC, c.l1, c.grid_id) AS pick, t.hits - (c.rnk <= 10)::INT AS hits
      FROM ctl c JOIN tot t USING (case_id, grid_id) WHERE t.n >= 3)"""

SENS = """scen AS (SELECT * FROM (VALUES (0, '', 0, 3, 2, 2), (1, 'clinGen_hi_score', -1, 2, 2, 2), (2, 'clinGen_hi_score', 1, 4, 2, 2),
      (3, 'gnomad_LOEUF', -1, 3, 1, 2), (4, 'gnomad_LOEUF', 1, 3, 3, 2), (5, 'gnomad_pLI', -1, 3, 2, 1), (6, 'gnomad_pLI', 1, 3, 2, 3))
      v(sid, evidence, delta, a, b, c)),
  sr AS (SELECT case_id, symbol, sid, evidence, delta, row_number() OVER (PARTITION BY case_id, sid ORDER BY
      coalesce(n_hi, 0) * a + coalesce(n_loeuf, 0) * b + coalesce(n_pli, 0) * c DESC, hgnc_id) AS r FROM normed, scen),
  sens AS (SELECT x.case_id, x.evidence, x.delta::BIGINT AS delta, max(abs(x.r - y.r)) AS max_rank_shift,
      count(*) FILTER (x.r <= 3 AND y.r > 3) AS top3_genes_changed FROM sr x JOIN sr y ON y.sid = 0 AND x.sid > 0
      AND x.case_id = y.case_id AND x.symbol = y.symbol GROUP BY 1, 2, 3)"""

SELECTED = """des AS (SELECT r.*, p.p_size AS utr3_bp, p.p_type <> 'ECONOMY' AS okay, s.s_acctbal > 5000 AS viable,
      (n_hi IS NOT NULL OR n_loeuf IS NOT NULL OR n_pli IS NOT NULL) AS has_evidence
      FROM ranked r JOIN part p ON p.p_partkey = r.gene_id LEFT JOIN supplier s ON s.s_suppkey = r.gene_id),
  taken AS (SELECT *, sum(CASE WHEN okay AND utr3_bp >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY rnk) AS k FROM des),
  picked AS (SELECT *, CASE WHEN NOT okay THEN 'unresolved_transcript_or_utr' WHEN utr3_bp < 30 THEN 'below_project_utr3_minimum'
      WHEN k > 5 THEN 'module_budget_limit' ELSE 'selected_within_module_budget' END AS selection_reason FROM taken)"""

CHECKED = """wanted AS (SELECT c.case_id, g.symbol FROM cases c JOIN genes g ON c.chrom = g.chrom AND g.g_end >= c.i_start - 20000
      AND g.g_start <= c.i_end + 20000 JOIN controls USING (symbol)),
  chk AS (SELECT w.case_id, w.symbol AS control, r.rnk AS rank, r.score, r.hi, r.pli FROM wanted w LEFT JOIN ranked r USING (case_id, symbol)),
  vp AS (SELECT case_id, control, rank, (coalesce(hi >= 2, false) OR coalesce(pli >= 0.9, false)) AND NOT coalesce(hi = 40, false) AS target_ok
      FROM chk WHERE rank IS NOT NULL)"""

BORDA = """br AS (SELECT *, n - (rank() OVER (PARTITION BY case_id ORDER BY n_hi DESC NULLS LAST) + (count(*) OVER (PARTITION BY case_id, n_hi) - 1) / 2) AS b_hi,
      n - (rank() OVER (PARTITION BY case_id ORDER BY n_loeuf DESC NULLS LAST) + (count(*) OVER (PARTITION BY case_id, n_loeuf) - 1) / 2) AS b_lo,
      n - (rank() OVER (PARTITION BY case_id ORDER BY n_pli DESC NULLS LAST) + (count(*) OVER (PARTITION BY case_id, n_pli) - 1) / 2) AS b_pl FROM scored),
  bs AS (SELECT *, CASE WHEN nh > 0 THEN 3 * CASE WHEN n_hi IS NULL THEN (n - 1) / 2 ELSE b_hi END ELSE 0 END
      + CASE WHEN nl > 0 THEN 2 * CASE WHEN n_loeuf IS NULL THEN (n - 1) / 2 ELSE b_lo END ELSE 0 END
      + CASE WHEN np > 0 THEN 2 * CASE WHEN n_pli IS NULL THEN (n - 1) / 2 ELSE b_pl END ELSE 0 END AS borda_score FROM br)"""

ORACLES = {
    "normalize_raw": with_views("normed", NORMS + "normed"),
    "normalize_zscore": with_views("panel", """WITH st AS (SELECT case_id, avg(loeuf) AS lm, stddev_pop(loeuf) AS ls, avg(pli) AS pm,
          stddev_pop(pli) AS ps FROM panel GROUP BY 1),
        z AS (SELECT p.*, (loeuf - lm) / CASE WHEN ls > 0 THEN ls ELSE 1 END AS zl, (pli - pm) / CASE WHEN ps > 0 THEN ps ELSE 1 END AS zp
          FROM panel p JOIN st USING (case_id)),
        w AS (SELECT *, min(zl) OVER c AS l0, max(zl) OVER c AS l1, min(zp) OVER c AS p0, max(zp) OVER c AS p1 FROM z WINDOW c AS (PARTITION BY case_id)),
        f AS (SELECT case_id, gene_id, CASE WHEN hi IN (0, 1, 2, 3) THEN hi / 3 END AS n_hi,
          CASE WHEN zl IS NOT NULL THEN 1 - CASE WHEN l1 > l0 THEN (zl - l0) / (l1 - l0) ELSE 0.5 END END AS n_loeuf,
          CASE WHEN zp IS NOT NULL THEN CASE WHEN p1 > p0 THEN (zp - p0) / (p1 - p0) ELSE 0.5 END END AS n_pli FROM w) """ + NORMS + "f"),
    "normalize_rank": with_views("panel", """WITH r AS (SELECT case_id, gene_id, CASE WHEN hi IN (0, 1, 2, 3) THEN hi / 3 END AS n_hi,
          CASE WHEN loeuf IS NOT NULL THEN 1 - (rank() OVER (PARTITION BY case_id ORDER BY loeuf NULLS LAST)
            + (count(*) OVER (PARTITION BY case_id, loeuf) - 1) / 2) / count(loeuf) OVER (PARTITION BY case_id) END AS n_loeuf,
          CASE WHEN pli IS NOT NULL THEN (rank() OVER (PARTITION BY case_id ORDER BY pli NULLS LAST)
            + (count(*) OVER (PARTITION BY case_id, pli) - 1) / 2) / count(pli) OVER (PARTITION BY case_id) END AS n_pli FROM panel) """ + NORMS + "r"),
    "normalize_ordinal": with_views("panel", """SELECT case_id, gene_id, CASE WHEN loeuf IS NOT NULL THEN round(least(greatest(loeuf, 0), 2) / 2, 6) END AS "norm_gnomad_LOEUF",
        CASE WHEN pli IS NOT NULL THEN round(least(greatest(pli, 0), 0.5) / 0.5, 6)::DOUBLE END AS "norm_gnomad_pLI" FROM panel"""),
    "consensus_score_rank": with_views("ranked", """SELECT case_id, gene_id, rnk AS rank, round(score, 6) AS consensus_score,
        round(coalesce(n_hi, 0) * 3, 6) AS "contrib_clinGen_hi_score", round(coalesce(n_loeuf, 0) * 2, 6) AS "contrib_gnomad_LOEUF",
        round(coalesce(n_pli, 0) * 2, 6) AS "contrib_gnomad_pLI" FROM ranked"""),
    "consensus_penalty": with_views("normed tissue_long", """WITH o AS (SELECT gene_id, max(ntpm) FILTER (tissue = 'AF') AS a,
          max(ntpm) FILTER (tissue = 'NO') AS b, max(ntpm) FILTER (tissue = 'RF') AS c FROM tissue_long GROUP BY 1),
        s AS (SELECT n.case_id, n.gene_id, n.hgnc_id, CASE WHEN recessive THEN 0.5::DOUBLE ELSE 1 END AS f,
          greatest(CASE WHEN a > 70000 THEN -2.0::DOUBLE ELSE 0 END + CASE WHEN b > 70000 THEN -2.0::DOUBLE ELSE 0 END
          + CASE WHEN c > 70000 THEN -2.0::DOUBLE ELSE 0 END, -4.0::DOUBLE) AS pen, n_hi, n_loeuf, n_pli FROM normed n LEFT JOIN o USING (gene_id)),
        t AS (SELECT *, coalesce(n_hi, 0) * 3 + coalesce(n_loeuf, 0) * f * 2 + coalesce(n_pli, 0) * f * 2 + pen AS score FROM s)
        SELECT case_id, gene_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, hgnc_id) AS rank, round(pen, 6) AS hpa_penalty,
          round(score, 6) AS consensus_score FROM t"""),
    "evidence_status_gate": with_views("normed", """SELECT case_id, count(*) AS n_candidates,
        round(avg((n_hi IS NULL AND n_loeuf IS NULL AND n_pli IS NULL)::INT), 6) AS missing_rate,
        avg((n_hi IS NULL AND n_loeuf IS NULL AND n_pli IS NULL)::INT) > 0.5 AS rejected,
        round(avg((n_hi IS NOT NULL)::INT), 6) AS "coverage_clinGen_hi_score", round(avg((n_loeuf IS NOT NULL)::INT), 6) AS "coverage_gnomad_LOEUF",
        round(avg((n_pli IS NOT NULL)::INT), 6) AS "coverage_gnomad_pLI" FROM normed GROUP BY case_id"""),
    "borda_rank": with_views("scored", f"""WITH {BORDA} SELECT case_id, gene_id, round(borda_score, 6) AS borda_score,
        rank() OVER (PARTITION BY case_id ORDER BY borda_score DESC) AS borda_rank FROM bs"""),
    "rank_agreement": with_views("scored", f"""WITH {BORDA}, ra AS (SELECT case_id,
          rank() OVER (PARTITION BY case_id ORDER BY score) + (count(*) OVER (PARTITION BY case_id, score) - 1) / 2 AS x,
          rank() OVER (PARTITION BY case_id ORDER BY borda_score) + (count(*) OVER (PARTITION BY case_id, borda_score) - 1) / 2 AS y FROM bs)
        SELECT case_id, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END AS spearman FROM ra GROUP BY 1"""),
    "budget_select": with_views("ranked", f"""WITH {SELECTED} SELECT case_id, gene_id, rnk AS rank,
        selection_reason = 'selected_within_module_budget' AS selected, selection_reason, round(score, 6) AS consensus_score FROM picked"""),
    "evidence_notes": with_views("ranked", f"""WITH {SELECTED} SELECT case_id, gene_id, concat_ws(' ',
        CASE WHEN hi = 30 THEN '{sel.NOTE_RECESSIVE}' END, CASE WHEN hi = 40 THEN '{sel.NOTE_UNLIKELY}' END,
        CASE WHEN viable THEN '{sel.NOTE_VIABLE}' END, CASE WHEN interval_overlap = 'partial' THEN '{sel.NOTE_PARTIAL}' END,
        CASE WHEN NOT has_evidence THEN '{sel.NOTE_NO_EVIDENCE}' END) AS evidence_notes FROM picked"""),
    "run_summary": with_views("ranked", f"""WITH {SELECTED} SELECT case_id, count(*) AS n_candidates,
        count(*) FILTER (selection_reason = 'selected_within_module_budget') AS n_selected,
        count(*) FILTER (NOT has_evidence) AS n_without_evidence, 0::BIGINT AS n_annotation_gaps,
        round(count(pli) / count(*), 6) AS coverage_pli, round(count(loeuf) / count(*), 6) AS coverage_loeuf FROM picked GROUP BY 1"""),
    "summary_projection": with_views("ranked", f"""WITH {SELECTED} SELECT case_id, rnk AS rank, symbol, gene_id, round(score, 6) AS consensus_score,
        CASE WHEN has_evidence THEN 'available' ELSE 'no_usable_evidence' END AS evidence_status, interval_overlap, utr3_bp,
        selection_reason = 'selected_within_module_budget' AS selected, selection_reason, NULL::VARCHAR AS ot_status FROM picked"""),
    "weight_grid_recall": with_views("normed controls", f"""WITH {GRID} SELECT case_id, grid_id, n AS n_controls,
        round(hits / n, 6) AS recall FROM tot"""),
    "loo_folds": with_views("normed controls", f"""WITH {FOLDS} SELECT case_id, symbol AS held_out, round(hits / (n - 1), 6) AS train_recall,
        grid_id, rnk AS held_out_rank, rnk <= 10 AS in_top_n FROM folds WHERE pick = 1"""),
    "loo_tune": with_views("normed controls", f"""WITH {FOLDS}, rate AS (SELECT case_id, avg((rnk <= 10)::INT) AS r FROM folds WHERE pick = 1 GROUP BY 1),
        fin AS (SELECT case_id, grid_id, n, hits, row_number() OVER (PARTITION BY case_id ORDER BY hits DESC, l1, grid_id) AS pick
          FROM tot JOIN grid USING (grid_id))
        SELECT case_id, coalesce(n, 0) AS n_controls, CASE WHEN n >= 3 THEN grid_id END AS final_grid_id, CASE WHEN n >= 3 THEN round(hits / n, 6) END AS final_recall,
          round(r, 6) AS loo_hit_rate, CASE WHEN coalesce(n, 0) < 3 THEN 'skipped_fewer_than_three_controls' END AS note
        FROM cases LEFT JOIN (SELECT * FROM fin WHERE pick = 1) USING (case_id) LEFT JOIN rate USING (case_id)"""),
    "tuned_rank": with_views("normed controls", f"""WITH {GRID}, fin AS (SELECT case_id, grid_id, n, row_number() OVER (PARTITION BY case_id ORDER BY hits DESC, l1, grid_id) AS pick
          FROM tot JOIN grid USING (grid_id)),
        w AS (SELECT case_id, a, b, c FROM fin JOIN grid USING (grid_id) WHERE pick = 1 AND n >= 3),
        s AS (SELECT o.case_id, o.gene_id, o.hgnc_id, w.a IS NOT NULL AS tuned, coalesce(n_hi, 0) * coalesce(w.a, 3) + coalesce(n_loeuf, 0) * coalesce(w.b, 2)
          + coalesce(n_pli, 0) * coalesce(w.c, 2) AS score FROM normed o LEFT JOIN w USING (case_id))
        SELECT case_id, gene_id, tuned, round(score, 6) AS tuned_score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, hgnc_id) AS tuned_rank FROM s"""),
    "missing_controls": """SELECT s_suppkey AS case_id, unnest(['ABSENT1', 'ABSENT2']) AS control FROM supplier""",
    "screen_cohort": with_views("normed controls", f"""WITH {GRID}, fin AS (SELECT case_id, grid_id, n, row_number() OVER (PARTITION BY case_id ORDER BY hits DESC, l1, grid_id) AS pick
          FROM tot JOIN grid USING (grid_id)),
        w AS (SELECT case_id, a, b, c FROM fin JOIN grid USING (grid_id) WHERE pick = 1 AND n >= 3),
        gate AS (SELECT case_id FROM normed GROUP BY 1 HAVING avg((n_hi IS NULL AND n_loeuf IS NULL AND n_pli IS NULL)::INT) <= 0.5),
        s AS (SELECT o.case_id, o.gene_id, o.hgnc_id, coalesce(w.a, 3)::DOUBLE AS first_weight, coalesce(n_hi, 0) * coalesce(w.a, 3) + coalesce(n_loeuf, 0) * coalesce(w.b, 2)
          + coalesce(n_pli, 0) * coalesce(w.c, 2) AS score FROM normed o JOIN gate USING (case_id) LEFT JOIN w USING (case_id))
        SELECT case_id, gene_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, hgnc_id) AS rank, round(score, 6) AS consensus_score, first_weight FROM s"""),
    "weight_sensitivity": with_views("normed", f"WITH {SENS} SELECT * FROM sens"),
    "weight_robustness": with_views("normed", f"""WITH {SENS}, g AS (SELECT case_id, count(*) AS n_perturbations, max(max_rank_shift) AS max_rank_shift,
          count(*) FILTER (top3_genes_changed > 0) AS n_causing_top3_change FROM sens GROUP BY 1)
        SELECT *, CASE WHEN n_causing_top3_change = 0 THEN 'high' WHEN n_causing_top3_change <= n_perturbations // 2 THEN 'moderate'
          ELSE 'low' END AS robustness FROM g"""),
    "control_check": with_views("ranked controls", f"""WITH {CHECKED} SELECT case_id, control, rank IS NOT NULL AS in_candidates, rank,
        coalesce(rank <= 10, false) AS top10, round(score, 6) AS consensus_score FROM chk"""),
    "control_summary": with_views("ranked controls", f"""WITH {CHECKED} SELECT case_id, count(*) AS controls_total, count(rank) AS controls_present,
        count(*) FILTER (rank <= 10) AS controls_top10 FROM chk GROUP BY 1"""),
    "validation_panel": with_views("ranked controls", f"WITH {CHECKED} SELECT * FROM vp"),
    "validation_pass": with_views("ranked controls", f"""WITH {CHECKED} SELECT case_id, count(vp.control) AS n_controls, coalesce(bool_or(target_ok), false) AS passed
        FROM cases LEFT JOIN vp USING (case_id) GROUP BY 1"""),
    "sparse_evidence_warnings": with_views("ranked", """WITH g AS (SELECT case_id, count(*) AS n_genes, avg((n_hi IS NOT NULL)::INT) AS cov,
          max(score) FILTER (rnk = 1) - max(score) FILTER (rnk = 3) AS gap, stddev_samp(score) AS sd FROM ranked GROUP BY 1)
        SELECT case_id, n_genes, round(cov, 6) AS dosage_coverage, round(gap, 6) AS top3_gap, round(sd, 6) AS score_sd,
          concat_ws(',', CASE WHEN cov < 0.5 THEN 'low_dosage_coverage' END, CASE WHEN n_genes > 20 AND gap < sd THEN 'similar_top_scores' END,
          CASE WHEN cov = 0 THEN 'no_dosage_coverage' END) AS warnings FROM g"""),
}
