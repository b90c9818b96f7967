"""Whole screening runs on a two-gene fixture: interval and list routes agree, annotations never move ranks."""

import pytest
from pyspark.sql import functions as F

from lociframe import workflows
from lociframe.operators import selection
from test_golden_cells import features as utr_features

INTERVAL = "case_id string, chrom string, start bigint, end bigint"


@pytest.fixture(scope="module")
def reference(spark):
    annotation = spark.createDataFrame([("A", "A", "chr4", 100, 329), ("B", "B", "chr4", 500, 699), ("C", "C", "chr5", 1, 2)],
                                       "gene_id string, gene_name string, chrom string, start bigint, end bigint")
    nomenclature = spark.createDataFrame(
        [("HGNC:1", "A", "Approved", "A", "OLD_A"), ("HGNC:2", "B", "Approved", "B", None), ("HGNC:3", "GONE", "Withdrawn", "Z", None)],
        "hgnc_id string, symbol string, status string, ensembl_gene_id string, alias_symbol string")
    return annotation, nomenclature


def evidence_for(spark, candidates, nomenclature, **extra):
    curation = spark.createDataFrame([("old_a", "3", "0"), ("B", "40", None)],
                                     "`gene symbol` string, `haploinsufficiency score` string, `triplosensitivity score` string")
    constraint = spark.createDataFrame([("A", "T1", "true", "true", "0.9", "0.2", "[]", ""), ("B", "T2", "true", "true", "0.1", "0.8", "[]", "")],
                                       "gene_id string, transcript string, mane_select string, canonical string, `lof.pLI` string, "
                                       "`lof.oe_ci.upper` string, constraint_flags string, gene_flags string")
    return workflows.collect_evidence(candidates, nomenclature, curation, constraint, **extra)


def key_rows(df):
    return sorted((r["symbol"], r["rank"], round(r["consensus_score"], 9), r["selection_reason"]) for r in df.collect())


def test_interval_and_list_routes_agree(spark, reference):
    annotation, nomenclature = reference
    intervals = spark.createDataFrame([("c", "4", 100, 699)], INTERVAL)
    labels = spark.createDataFrame([("c", "OLD_A"), ("c", "HGNC:2")], "case_id string, label string")
    by_interval = workflows.build_candidates(annotation, nomenclature, intervals=intervals)
    by_list = workflows.build_candidates(annotation, nomenclature, labels=labels)
    assert {r["gene_id"]: r["interval_overlap"] for r in by_interval.collect()} == {"A": "full", "B": "full"}
    assert {r["gene_id"]: r["interval_overlap"] for r in by_list.collect()} == {"A": "not_provided", "B": "not_provided"}
    runs = [workflows.screen(c, utr_features(spark), evidence_for(spark, c, nomenclature)) for c in (by_interval, by_list)]
    want = [("A", 1, 7.0, selection.REASON_SELECTED), ("B", 2, 0.0, selection.REASON_SHORT)]
    assert key_rows(runs[0]) == key_rows(runs[1]) == want
    full = {r["symbol"]: r for r in runs[0].collect()}
    assert full["B"]["dosage_conflict"] and full["B"]["clinGen_haploinsufficiency_status"] == "dosage_unlikely"
    assert full["A"]["clinGen_haploinsufficiency_status"] == "sufficient_evidence" and full["A"]["impc_viability"] == "not_supplied"

    tissues = spark.createDataFrame([("A", "liver", 5.0)], "gene string, tissue string, ntpm double")
    viability = spark.createDataFrame([("B", "M", "viable", "s", "1", "m")], "gene_id string, mouse_gene_id string, impc_viability string, "
                                      "source string, release string, mapping_source string")
    more = workflows.screen(by_interval, utr_features(spark), evidence_for(spark, by_interval, nomenclature, tissues=tissues, viability=viability))
    assert key_rows(more) == want
    assert {r["symbol"]: r["impc_viability"] for r in more.collect()} == {"A": "not_supplied", "B": "viable"}


def test_partial_overlap(spark, reference):
    annotation, nomenclature = reference
    intervals = spark.createDataFrame([("c", "chr4", 150, 600)], INTERVAL)
    got = workflows.build_candidates(annotation, nomenclature, intervals=intervals)
    assert [r["interval_overlap"] for r in got.collect()] == ["partial", "partial"]


@pytest.mark.parametrize("labels", [["UNKNOWN"], ["A", "OLD_A"], ["GONE"]])
def test_bad_lists_are_errors(spark, reference, labels):
    annotation, nomenclature = reference
    table = spark.createDataFrame([("c", x) for x in labels], "case_id string, label string")
    with pytest.raises(ValueError):
        workflows.build_candidates(annotation, nomenclature, labels=table)


def test_one_input_kind_only(spark, reference):
    with pytest.raises(ValueError):
        workflows.build_candidates(*reference)


def test_unknown_dosage_category_is_an_error(spark, reference):
    annotation, nomenclature = reference
    candidates = workflows.build_candidates(annotation, nomenclature, intervals=spark.createDataFrame([("c", "4", 100, 699)], INTERVAL))
    curation = spark.createDataFrame([("A", "7", "0")], "`gene symbol` string, `haploinsufficiency score` string, `triplosensitivity score` string")
    constraint = spark.createDataFrame([], "gene_id string, transcript string, mane_select string, canonical string, `lof.pLI` string, "
                                           "`lof.oe_ci.upper` string, constraint_flags string, gene_flags string")
    with pytest.raises(ValueError):
        workflows.collect_evidence(candidates, nomenclature, curation, constraint)


def test_screen_cohort_gates_tunes_and_reports(spark):
    """A case without evidence is rejected; weights in use, sensitivity and missing controls follow each case."""
    from pyspark.sql import functions as F

    from lociframe.config import Consensus, Evidence, Tuning
    from lociframe.operators import tuning
    cfg = Consensus((Evidence("gnomad_pLI", 1), Evidence("gnomad_LOEUF", 2, "lower_better")), tuning=Tuning(grid=(0, 1, 2), top_n=3))
    rows = [("one", f"H{i:02d}", f"E{i}", f"S{i}", i / 20, i / 20) for i in range(20)]
    rows += [("bare", f"H{i:02d}", f"E{i}", f"S{i}", None, None) for i in range(5)]
    panel = spark.createDataFrame(rows, "case_id string, hgnc_id string, gene_id string, symbol string, gnomad_pLI double, gnomad_LOEUF double").withColumn(
        "interval_overlap", F.lit("full"))
    controls = spark.createDataFrame([("one", "S19"), ("one", " s18"), ("one", "S17"), ("one", "NOT"), ("bare", "S1")], "case_id string, symbol string")
    run = workflows.screen_cohort(panel, utr_features(spark), panel, cfg, controls=controls, sensitivity=True)
    assert {r["case_id"]: r["rejected"] for r in run.gate.collect()} == {"one": False, "bare": True}
    assert {r["case_id"] for r in run.ranked.collect()} == {"one"}
    # High pLI marks the controls, so LOEUF, which is against them, loses its weight.
    top = {r["symbol"]: r["rank"] for r in run.ranked.collect()}
    assert [top[s] for s in ("S19", "S18", "S17")] == [1, 2, 3]
    weights = {tuple(r["weights"]) for r in run.ranked.collect()}
    assert weights == {(1.0, 0.0)}
    assert [(r["case_id"], r["control"]) for r in run.missing_controls.collect()] == [("one", "NOT")]
    moves = {(r["evidence"], r["delta"]) for r in run.sensitivity.collect()}
    assert moves == {("gnomad_pLI", -1), ("gnomad_pLI", 1), ("gnomad_LOEUF", 1)}  # zero cannot go down
    assert run.tuning.collect()[0]["final_recall"] == 1.0 and run.robustness.collect()[0]["n_perturbations"] == 3
    plain = workflows.screen_cohort(panel, utr_features(spark), panel, cfg)
    assert plain.tuning is None and plain.sensitivity is None and "weights" not in plain.ranked.columns
    assert tuning.weight_sensitivity(panel.where("case_id = 'one'"), cfg).count() == 4
    twice = panel.union(panel.limit(1))
    with pytest.raises(ValueError, match="duplicate identity"):
        workflows.screen_cohort(panel, utr_features(spark), twice, cfg)


def test_screen_cohort_bounds_the_rows_of_a_task(spark, monkeypatch):
    """More rows make more tasks, in ranking, tuning and transcript choice, and the same results."""
    from lociframe import scale
    from lociframe.config import Consensus, Evidence, Tuning
    from lociframe.operators import design, tuning
    cfg = Consensus((Evidence("gnomad_pLI", 1), Evidence("gnomad_LOEUF", 2, "lower_better")), tuning=Tuning(grid=(0, 1, 2), top_n=3))
    rows = [(None if c == 12 else f"c{c}", f"H{i:02d}", f"E{i}", f"S{i}", (i * (c + 3) % 17) / 20, (i * 7 % 11) / 20) for c in range(13) for i in range(20)]
    panel = spark.createDataFrame(rows, "case_id string, hgnc_id string, gene_id string, symbol string, gnomad_pLI double, gnomad_LOEUF double").withColumn(
        "interval_overlap", F.lit("full"))
    controls = panel.where("symbol IN ('S19', 'S18', 'S7', 'S3')").select("case_id", "symbol")
    lines = [(f"E{i}", f"T{i}{k}", f, s, s + 30 * (i % 3 + 1), "+", ["MANE_Select"] if k else ["basic"]) for i in range(20) for k in range(2)
             for f, s in (("exon", 100), ("exon", 300), ("CDS", 110), ("stop_codon", 301))]
    features = spark.createDataFrame(lines, "gene_id string, transcript_id string, feature string, start bigint, end bigint, strand string, tags array<string>")

    def results():
        run = workflows.screen_cohort(panel, features, panel, cfg, controls=controls)
        parts = [sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect()))) for df in (run.gate, run.ranked, run.selected, run.tuning, run.missing_controls)]
        return run, parts

    run, plain = results()
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert run.ranked.rdd.getNumPartitions() <= session and len(plain[1]) == 260
    few = lambda df, rows, by, each=0: scale.dealt(df, rows, by, 15)
    for module in (workflows, tuning, design):
        monkeypatch.setattr(module, "dealt", few, raising=False)
    dealt, same = results()
    assert dealt.ranked.rdd.getNumPartitions() > session and same == plain
    ranks = tuning.control_ranks(panel, controls, cfg)
    assert ranks.rdd.getNumPartitions() > session
