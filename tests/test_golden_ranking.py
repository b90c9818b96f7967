"""Known values of the ranking and evidence operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lociframe.config import SCREENING, Consensus, Evidence, OrganPenalty, Tuning
from lociframe.operators import consensus as op
from lociframe.operators import evidence as ev
from lociframe.operators import expectations as ex
from lociframe.operators import identity, selection, tuning

SCHEMA = "case_id int, hgnc_id string, symbol string, clinGen_hi_score double, gnomad_pLI double, gnomad_LOEUF double"


def panel(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], SCHEMA)


def values(df, column, key="symbol"):
    return {r[key]: r[column] for r in df.collect()}


def test_rank_directions_of_one_column_sum_to_one(spark):
    df = panel(spark, [("H1", "A", None, .1, .1), ("H2", "B", None, .5, .5), ("H3", "C", None, .9, .9)])
    specs = (Evidence("gnomad_pLI", 1), Evidence("gnomad_LOEUF", 1, "lower_better"))
    done = op.normalize_evidence(df, specs, "rank").collect()
    assert all(abs(r["norm_gnomad_pLI"] + r["norm_gnomad_LOEUF"] - 1) < 1e-12 for r in done)
    assert max(r["norm_gnomad_LOEUF"] for r in done) == pytest.approx(1 - 1 / 3)


@pytest.mark.parametrize("method", ["raw", "zscore"])
@pytest.mark.parametrize("direction", ["higher_better", "lower_better"])
def test_constant_column_is_half_and_missing_stays_missing(spark, method, direction):
    df = panel(spark, [("H1", "A", None, .4, None), ("H2", "B", None, .4, None), ("H3", "C", None, None, None)])
    got = values(op.normalize_evidence(df, (Evidence("gnomad_pLI", 1, direction),), method), "norm_gnomad_pLI")
    assert got == {"A": 0.5, "B": 0.5, "C": None}


def test_missing_evidence_scores_exactly_zero_and_infinite_is_missing(spark):
    cfg = Consensus((Evidence("gnomad_pLI", 2),))
    df = panel(spark, [("H1", "A", None, 1.0, None), ("H2", "B", None, None, None), ("H3", "C", None, float("inf"), None),
                       ("H4", "D", None, float("nan"), None), ("H5", "E", None, 0.0, None)])
    got = values(op.consensus_score(df, cfg), "consensus_score")
    assert got == {"A": 2.0, "B": 0.0, "C": 0.0, "D": 0.0, "E": 0.0}


def test_dosage_codes(spark):
    codes = [0, 1, 2, 3, 30, 40, -1, None]
    df = panel(spark, [(f"H{i}", f"G{i}", None if c is None else float(c), 0.5, None) for i, c in enumerate(codes)])
    done = op.consensus_score(df, Consensus((Evidence("clinGen_hi_score", 3, "ordinal", 3),)))
    got = values(done, "contrib_clinGen_hi_score")
    assert [got[f"G{i}"] for i in range(8)] == [0, 1, 2, 3, 0, 0, 0, 0]
    assert values(done, "dosage_conflict")["G5"] and sum(values(done, "dosage_conflict").values()) == 1
    table = spark.createDataFrame([(f"H{i}", None if c is None else str(c)) for i, c in enumerate(codes)], "hgnc_id string, code string")
    joined = ev.join_curation(df.union(panel(spark, [("H99", "X", None, None, None)])), ev.curation_codes(table, "code", "hi"), "hi")
    status = values(joined, "hi_status")
    assert status["G5"] == "dosage_unlikely" and status["G6"] == status["G7"] == "not_evaluated" and status["X"] == "not_curated"


def test_organ_penalty_and_its_cap(spark):
    base = spark.createDataFrame([(1, "H1", "A", 1.0, 9., 9., 9.), (1, "H2", "B", 1.0, 0., None, 0.)],
                                 "case_id int, hgnc_id string, symbol string, gnomad_pLI double, hpa_liver_expr double, hpa_brain_expr double, hpa_kidney_expr double")
    two = Consensus((Evidence("gnomad_pLI", 1),), penalty=OrganPenalty(("liver", "brain"), 1.0, -2.0, -4.0))
    three = two.with_(penalty=OrganPenalty(("liver", "brain", "kidney"), 1.0, -2.0, -4.0))
    for cfg in (two, three):
        assert values(op.consensus_score(base, cfg), "hpa_penalty") == {"A": -4.0, "B": 0.0}


def test_borda_points(spark):
    df = panel(spark, [("H1", "A", None, 1.0, None), ("H2", "B", None, .5, None), ("H3", "C", None, None, None)])
    cfg = Consensus((Evidence("gnomad_pLI", 1),))
    done = op.borda(op.consensus_score(df, cfg), cfg)
    assert values(done, "borda_score") == {"A": 2.0, "B": 1.0, "C": 1.0}
    assert values(op.borda(op.consensus_score(df, cfg), cfg.with_(borda_missing="zero")), "borda_score")["C"] == 0.0
    assert values(done, "borda_rank") == {"A": 1, "B": 2, "C": 2}


def test_ties_use_id_text_and_missing_ids_last(spark):
    df = panel(spark, [(h, s, None, .5, None) for h, s in (("HGNC:2", "A"), ("HGNC:10", "B"), (None, "C"))])
    ranked = op.consensus_rank(df, Consensus((Evidence("gnomad_pLI", 1),)))
    assert values(ranked, "rank") == {"B": 1, "A": 2, "C": 3}
    assert values(ranked, "evidence_status")["C"] == "no_usable_evidence"


def test_recessive_factor_applies_once(spark):
    df = panel(spark, [("H1", "A", None, 1.0, None), ("H2", "B", None, 1.0, None), ("H3", "C", None, 0.0, None)])
    df = df.withColumn("recessive", F.col("symbol") == "A")
    cfg = Consensus((Evidence("gnomad_pLI", 1),), recessive_factor=0.5)
    got = values(op.consensus_score(df, cfg), "contrib_gnomad_pLI")
    assert got == {"A": 0.5, "B": 1.0, "C": 0.0}
    with pytest.raises(Exception):
        op.consensus_score(df.withColumn("recessive", F.lit("maybe")), cfg).collect()


def test_low_score_penalty_only_for_non_dosage_ordinals(spark):
    df = panel(spark, [("H1", "A", None, 0.0, None), ("H2", "B", None, 2.0, None), ("H3", "C", None, None, None)])
    cfg = Consensus((Evidence("gnomad_pLI", 2, "ordinal", 2, low_score_penalty=0.25),))
    assert values(op.consensus_score(df, cfg), "consensus_score") == {"A": -0.5, "B": 2.0, "C": 0.0}
    with pytest.raises(ValueError):
        Evidence("clinGen_hi_score", 1, "ordinal", 3, low_score_penalty=1)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), True, "3"])
def test_numbers_in_the_configuration_must_be_finite(bad):
    with pytest.raises(ValueError):
        Evidence("gnomad_pLI", bad)


def test_tuning_recovers_planted_controls(spark):
    rows = [(f"H{i:03d}", f"B{i}", 3.0 if i % 2 else 0.0, 0.1, 0.9) for i in range(40)]
    rows += [(f"H9{i}", f"CTRL{i}", 0.0, 1.0, 0.9) for i in range(5)]
    cfg = Consensus((Evidence("clinGen_hi_score", 3, "ordinal", 3), Evidence("gnomad_pLI", 2)), tuning=Tuning((0, 1, 2, 3), 10))
    controls = spark.createDataFrame([(f"ctrl{i}",) for i in range(5)], "symbol string")
    ranks = tuning.control_ranks(panel(spark, rows), controls, cfg)
    done = tuning.loo_tune(ranks, 10).collect()[0]
    assert done["loo_hit_rate"] == 1.0 and done["final_recall"] == 1.0
    folds = tuning.loo_folds(ranks, 10).collect()
    assert len(folds) == 5 and all(f["in_top_n"] for f in folds)


def test_tied_controls_beyond_the_top_are_not_hits(spark):
    rows = [(f"H{i:02d}", f"G{i}", None, .5, None) for i in range(13)]
    cfg = Consensus((Evidence("gnomad_pLI", 1),))
    controls = spark.createDataFrame([("G10",), ("G11",), ("G12",)], "symbol string")
    ranks = tuning.control_ranks(panel(spark, rows), controls, cfg)
    done = tuning.loo_tune(ranks, 10).collect()[0]
    assert done["loo_hit_rate"] == 0.0 and done["final_recall"] == 0.0
    assert {r["held_out"]: r["held_out_rank"] for r in tuning.loo_folds(ranks).collect()} == {"G10": 11, "G11": 12, "G12": 13}


def test_few_controls_skip_tuning(spark):
    ranks = tuning.control_ranks(panel(spark, [("H1", "A", None, .5, None), ("H2", "B", None, .1, None)]),
                                 spark.createDataFrame([("A",), ("B",)], "symbol string"), Consensus((Evidence("gnomad_pLI", 1),)))
    done = tuning.loo_tune(ranks).collect()[0]
    assert done["final_grid_id"] is None and "skipped" in done["note"]


def test_weight_grid_has_no_size_limit(spark):
    from pyspark.sql import functions as F
    wide = Consensus(tuple(Evidence(f"c{i}", 1) for i in range(8)))
    n = spark.range(1).select(F.size(tuning.weight_grid(wide)).alias("n")).first()["n"]
    assert n == 4 ** 8 - 1
    ids = spark.range(1).select(F.explode(tuning.weight_grid(SCREENING)).alias("g"))
    rows = ids.select(tuning.grid_id(F.col("g"), SCREENING).alias("grid_id"), F.array(*tuning.grid_weights(F.col("g"), SCREENING)).alias("w")).collect()
    assert [r["grid_id"] for r in rows] == list(range(63))
    assert rows[0]["w"] == [0.0, 0.0, 1.0] and rows[-1]["w"] == [3.0, 3.0, 3.0]
    decoded = tuning.decode_weights(ids.select(tuning.grid_id(F.col("g"), SCREENING).alias("final_grid_id")), SCREENING)
    assert [r["weights"] for r in decoded.orderBy("final_grid_id").collect()] == [r["w"] for r in rows]


def test_grids_with_several_idle_weights(spark):
    """Numbers count combinations with a positive weight only, in order, and decode to their weights."""
    from itertools import product

    from pyspark.sql import functions as F
    cfg = Consensus(tuple(Evidence(f"c{i}", 1) for i in range(3)), tuning=Tuning(grid=(0.0, 2.0, -1.0)))
    want = [list(map(float, w)) for w in product((0.0, 2.0, -1.0), repeat=3) if max(w) > 0]
    ids = spark.range(1).select(F.explode(tuning.weight_grid(cfg)).alias("g"))
    rows = ids.select(tuning.grid_id(F.col("g"), cfg).alias("final_grid_id"), F.array(*tuning.grid_weights(F.col("g"), cfg)).alias("w")).collect()
    assert [r["final_grid_id"] for r in rows] == list(range(len(want))) and [r["w"] for r in rows] == want
    decoded = tuning.decode_weights(ids.select(tuning.grid_id(F.col("g"), cfg).alias("final_grid_id")), cfg)
    assert [r["weights"] for r in decoded.orderBy("final_grid_id").collect()] == want


def test_control_ranks_over_a_large_grid_equal_counting(spark):
    """20,001 combinations of one case with ties, counted in blocks, against plain numpy."""
    import random
    rng = random.Random(2)
    rows = [(f"H{i:02d}", f"S{i}", None, rng.choice([None, .1, .2, .4]), rng.choice([.1, .5, 1.0])) for i in range(30)]
    grid = tuple(range(142))  # 142 x 142 positions
    cfg = Consensus((Evidence("gnomad_pLI", 1), Evidence("gnomad_LOEUF", 1, "lower_better")), tuning=Tuning(grid=grid))
    controls = spark.createDataFrame([("S3",), ("S4",), ("S9",)], "symbol string")
    frame = panel(spark, rows)
    ranks = tuning.control_ranks(frame, controls, cfg).collect()
    assert len(ranks) == 3 * (142 * 142 - 1)
    from lociframe.operators.consensus import adjusted
    held = {r["hgnc_id"]: (r["adj_gnomad_pLI"], r["adj_gnomad_LOEUF"]) for r in adjusted(frame, cfg).collect()}
    for r in rng.sample(ranks, 300):
        w = divmod(r["grid_id"] + 1, 142)
        score = {h: 0.0 + a * w[0] + b * w[1] + 0.0 for h, (a, b) in held.items()}
        own = f"H{int(r['control'][1:]):02d}"
        assert r["rank"] == 1 + sum((s > score[own]) or (s == score[own] and h < own) for h, s in score.items())


def test_budget(spark):
    schema = "case_id int, rank int, utr3_bp int, utr3_status string, clinGen_haploinsufficiency_raw double, interval_overlap string"
    ranked = spark.createDataFrame([(1, 1, 30, "ok", 40., "partial"), (1, 2, 29, "ok", None, "full"), (1, 3, None, "incomplete_coding_annotation", 30., "full"),
                                    (1, 4, 31, "ok", None, "full")], schema)
    pick = lambda **k: {r["rank"]: r["selection_reason"] for r in selection.budget_select(ranked, **k).collect()}
    assert pick(capacity=300) == {1: selection.REASON_SELECTED, 2: selection.REASON_SHORT, 3: selection.REASON_UNRESOLVED, 4: selection.REASON_BUDGET}
    assert pick(capacity=600)[4] == selection.REASON_SELECTED
    notes = {r["rank"]: r["evidence_notes"] for r in selection.budget_select(ranked).collect()}
    assert notes[1] == f"{selection.NOTE_UNLIKELY} {selection.NOTE_PARTIAL}" and notes[3] == selection.NOTE_RECESSIVE and notes[2] == ""
    with pytest.raises(ValueError):
        selection.budget_select(ranked, capacity=0)


def test_constraint_transcripts(spark):
    schema = "gene_id string, transcript string, mane_select string, canonical string, `lof.pLI` string, `lof.oe_ci.upper` string, constraint_flags string, gene_flags string"
    table = spark.createDataFrame([("G1", "T1", "true", "false", "0.9", "0.2", "[]", ""), ("G1", "T2", "false", "true", "0.1", "0.8", "[]", ""),
                                   ("G2", "T3", "false", "1", "0.5", "0.3", "['outlier']", ""), ("G3", "T4", "True", "", "1", "1", "", ""),
                                   ("G3", "T5", "1", "", "1", "1", "", "")], schema)
    genes = spark.createDataFrame([("G1",), ("G2",), ("G3",), ("G4",)], "gene_id string")
    got = {r["gene_id"]: r for r in ev.join_constraint(genes, table).collect()}
    assert got["G1"]["gnomad_LOEUF"] == 0.2 and got["G1"]["gnomad_transcript_choice"] == "MANE_Select"
    assert got["G2"]["gnomad_LOEUF"] is None and got["G2"]["gnomad_LOEUF_raw"] == 0.3 and got["G2"]["gnomad_status"] == "quality_flagged_not_scored"
    assert got["G4"]["gnomad_status"] == "no_selected_transcript_record"
    status = values(ev.constraint_transcript(table), "choice_status", "gene_id")
    assert status == {"G1": "single", "G2": "single", "G3": "ambiguous"}


def test_historic_symbol_reaches_its_gene(spark):
    nomenclature = spark.createDataFrame([("HGNC:12766", "NSD2", "WHSC1|OTHER")], "hgnc_id string, symbol string, prev_symbol string")
    constraint = spark.createDataFrame([("whsc1", "0.99", "0.1", 1), ("NSD2", "0.5", "0.5", 2)],
                                       "gene_symbol string, pli string, oe_lof_upper string, source_line bigint")
    candidates = spark.createDataFrame([("HGNC:12766",)], "hgnc_id string")
    got = identity.legacy_constraint(candidates, constraint, identity.build_alias_map(nomenclature)).collect()[0]
    assert (got["gnomad_pLI"], got["gnomad_LOEUF"]) == (0.99, 0.1)


def test_quoted_alias_lists(spark, rows):
    table = spark.createDataFrame([("HGNC:24086", "A1CF", '"OLD1; OLD2"', '"ACF|ASP,APOBEC1CF"')],
                                  "hgnc_id string, symbol string, prev_symbol string, alias_symbol string")
    got = {r[0] for r in rows(identity.build_alias_map(table), "alias")}
    assert got == {"a1cf", "old1", "old2", "acf", "asp", "apobec1cf"}


def test_tissue_zero_is_data_and_missing_is_not(spark):
    tissues = spark.createDataFrame([("G1", "cerebral cortex", 20.), ("G1", "cerebellum", 3.), ("G1", "liver", 2.), ("G2", "liver", 0.)],
                                    "gene_id string, tissue string, ntpm double")
    genes = spark.createDataFrame([("G1",), ("G2",), ("G3",)], "gene_id string")
    panels = spark.createDataFrame([("P1", ["liver", "absent"]), ("P2", ["nowhere"]), ("P3", ["liver"])], "id string, tissues array<string>")
    got = {r["id"]: r for r in ev.panel_coverage(panels, tissues, genes).collect()}
    assert got["P1"]["coverage_status"] == "partial" and got["P1"]["missing_tissues"] == ["absent"]
    assert got["P2"]["coverage_status"] == "unavailable" and got["P2"]["genes_with_expression"] == 0
    assert got["P3"]["genes_with_expression"] == 2 and got["P3"]["candidate_count"] == 3
    organs = ev.organ_rollup(tissues, {"brain": ["cerebral cortex", "cerebellum"], "liver": ["liver"]})
    wide = {r["gene_id"]: (r["hpa_brain_expr"], r["hpa_liver_expr"]) for r in organs.collect()}
    assert wide == {"G1": (20., 2.), "G2": (None, 0.)}


def test_optional_columns_may_not_overlap(spark):
    a = spark.createDataFrame([("H1", 1.0)], "hgnc_id string, x double")
    with pytest.raises(ValueError):
        ev.merge_optional(a, a, "hgnc_id")


def test_crosswalk_conflicts(spark):
    nomenclature = spark.createDataFrame([("HGNC:1", "A", "E1"), ("HGNC:1", "A", "E2"), ("HGNC:2", "B", "E3"), ("HGNC:3", "C", "E4"), ("HGNC:4", "D", "E4")],
                                         "hgnc_id string, symbol string, ensembl_gene_id string")
    scores = spark.createDataFrame([("E1", "A", .5), ("E2", "a ", .5), ("E3", "A", .1), ("E4", "C", .2), ("E9", "B", .3)],
                                   "ensembl string, gene_symbol string, score double")
    mapped = identity.crosswalk_scores(scores, nomenclature, identity.build_alias_map(nomenclature))
    assert values(mapped, "mapping_status", "ensembl") == {"E1": "mapped", "E2": "mapped", "E3": "symbol_disagreement",
                                                          "E4": "ambiguous_crosswalk", "E9": "not_in_crosswalk"}
    one = identity.collapse_scores(mapped, "score").collect()
    assert [(r["hgnc_id"], r["score"], r["n_records"], r["conflict"]) for r in one] == [("HGNC:1", .5, 2, False)]


def test_duplicate_ids_and_bad_values_are_reported(spark):
    df = spark.createDataFrame([("H1", 0.5), ("H1", 2.0), ("H2", None)], "hgnc_id string, score double")
    rules = [ex.unique("hgnc_id"), ex.in_range("score", 0, 1)]
    got = {(r["rule"], r["key"]): r["n"] for r in ex.violations(df, rules, "hgnc_id").collect()}
    assert got == {("unique(hgnc_id)", "H1"): 2, ("range(score)", "H1"): 1}
    with pytest.raises(ValueError):
        ex.check(df, rules, "hgnc_id")
    assert ex.keep_good(df, [rules[1]]).count() == 2
    ranked = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 1), (3, 3)], "case_id int, rank int")
    assert {r["case_id"] for r in ex.ranks_complete(ranked).collect()} == {2, 3}


def test_controls_and_warnings(spark):
    ranked = op.consensus_rank(panel(spark, [("H1", "A", 3., .95, .1), ("H2", "B", 40., .95, .2), ("H3", "C", None, .1, .9)]), SCREENING)
    controls = spark.createDataFrame([(1, "a"), (1, "B"), (1, "ZZ")], "case_id int, symbol string")
    checked = op.control_check(ranked, controls)
    assert values(checked, "in_candidates", "control") == {"A": True, "B": True, "ZZ": False}
    assert values(op.validation_panel(checked), "target_ok", "control") == {"A": True, "B": False}
    assert op.validation_pass(op.validation_panel(checked)).collect()[0]["passed"]
    bare = op.consensus_rank(panel(spark, [(f"H{i}", f"G{i}", None, i / 30, None) for i in range(25)]), SCREENING)
    assert op.sparse_evidence_warnings(bare).collect()[0]["warnings"] == ["low_dosage_coverage", "similar_top_scores", "no_dosage_coverage"]


# ---------------------------------------------------------------- rules that bad rows exercise
def test_shared_approved_symbol_shields_its_key(spark):
    from lociframe.operators import identity
    table = spark.createDataFrame([("H1", "FOO", None), ("H2", "FOO", None), ("H3", "BAR", "FOO")], "hgnc_id string, symbol string, alias_symbol string")
    found = {r["alias"]: r["hgnc_id"] for r in identity.build_alias_map(table, ["alias_symbol"]).collect()}
    assert found == {"bar": "H3"}


def test_invalid_metrics_are_not_scored(spark):
    from lociframe.operators import evidence
    rows = [("a", "0.5", "0.3"), ("b", "1.7", "0.3"), ("c", "0.5", "-3"), ("d", "oops", "0.3"), ("e", None, "0.3")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "g string, pli string, loeuf string, constraint_flags string, gene_flags string")
    got = {r["g"]: (r["gnomad_status"], r["gnomad_pLI"], r["gnomad_LOEUF"]) for r in evidence.constraint_mask(df).collect()}
    assert got["a"] == ("available", 0.5, 0.3) and got["e"] == ("available", None, 0.3)
    assert all(got[g] == ("invalid_metric", None, None) for g in "bcd")


def test_ambiguous_transcripts_are_named(spark):
    from lociframe.operators import evidence
    rows = [("g1", "t1", "true", None), ("g1", "t2", "true", None), ("g2", "t3", "true", None)]
    table = spark.createDataFrame([(*r, "0.4", "0.6", None, None) for r in rows], "gene_id string, transcript string, mane_select string, "
                                  "canonical string, `lof.pLI` string, `lof.oe_ci.upper` string, constraint_flags string, gene_flags string")
    wanted = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene_id string")
    got = {r["gene_id"]: (r["gnomad_status"], r["gnomad_pLI"]) for r in evidence.join_constraint(wanted, table).collect()}
    assert got == {"g1": ("ambiguous_transcript", None), "g2": ("available", 0.4), "g3": ("no_selected_transcript_record", None)}


def test_cases_without_controls_stay(spark):
    from lociframe.operators import consensus
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    panel = spark.createDataFrame([(1, "A", True)], "case_id int, control string, target_ok boolean")
    got = {r["case_id"]: (r["n_controls"], r["passed"]) for r in consensus.validation_pass(panel, cases=cases).collect()}
    assert got == {1: (1, True), 2: (0, False)}
    ranks = spark.createDataFrame([(1, "A", 0, 1.0, 3), (1, "A", 1, 0.0, 2)], "case_id int, control string, grid_id int, l1 double, rank long")
    tuned = {r["case_id"]: (r["n_controls"], r["final_grid_id"], r["note"] is not None) for r in tuning.loo_tune(ranks, cases=cases).collect()}
    assert tuned == {1: (1, None, True), 2: (0, None, True)}


def test_plans_build_without_reading_the_candidates(spark):
    """Only schema reads may run before an action."""
    from lociframe.plans import registry
    queries = registry.queries()
    tracker = spark.sparkContext.statusTracker()
    for name in ("consensus_score_rank", "borda_rank", "budget_select"):
        group = f"build-{name}"
        spark.sparkContext.setJobGroup(group, name)
        queries[name](spark, "/root/testdata/sf0.001")
        jobs = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs <= 6, (name, jobs)  # one footer read for each table
