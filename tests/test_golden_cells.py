"""Known values of the single-cell, copy-number, response and vector operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe import workflows
from lociframe.operators import cells as op
from lociframe.operators import cnv, design, embeddings, intervals, response, statistics

GENES = "gene_id string, symbol string"


def long(spark, matrix, genes, cells):
    rows = [(c, g, float(matrix[i][j])) for i, c in enumerate(cells) for j, g in enumerate(genes) if matrix[i][j]]
    return spark.createDataFrame(rows, "cell_id string, gene_id string, count double")


def test_mitochondrial_filter(spark):
    counts = long(spark, [[9, 3], [4, 7]], ["ID_A", "ID_B"], ["C1", "C2"])
    genes = spark.createDataFrame([("ID_A", "mt-TEST"), ("ID_B", "B")], GENES)
    cells = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "cell_id string")
    metrics = op.cell_metrics(counts, genes, cells)
    kept = op.cell_qc(metrics, 1, 50).where("keep").collect()
    assert [r["cell_id"] for r in kept] == ["C2"]
    assert {r["cell_id"]: r["mito_pct"] for r in metrics.collect()}["C1"] == 75.0
    edge = op.cell_qc(metrics, 1, 75).where("keep").collect()
    assert [r["cell_id"] for r in edge] == ["C2"]


def test_positions_never_fall_back_to_symbols(spark):
    genes = spark.createDataFrame([("ID_A", "SAME"), ("ID_B", "SAME"), ("ID_C", "C"), ("ID_D", "D"), ("ID_E", "E")], GENES)
    annotation = spark.createDataFrame([("ID_B", "chr1", 10, 12), ("ID_A", "chr1", 30, 33), ("OTHER", "chr1", 1, 2), ("ID_D", "chr1", 9, 3),
                                        ("ID_E", "chr1", 1, 2), ("ID_E", "chr2", 1, 2)], "gene_id string, chrom string, start bigint, end bigint")
    got = {r["gene_id"]: r["status"] for r in cnv.position_genes(genes, annotation).collect()}
    assert got == {"ID_A": "positioned", "ID_B": "positioned", "ID_C": "not_in_supplied_annotation", "ID_D": "invalid_position", "ID_E": "ambiguous_annotation"}


def signal(spark, dips):
    return spark.createDataFrame([("chr7", i * 10_000, i * 10_000 + 5_000, (-3.0 if i in dips else 0.01 * ((i * 7) % 11 - 5))) for i in range(200)],
                                 "chrom string, start bigint, end bigint, score double")


@pytest.mark.parametrize("limit", [None, 20])
def test_planted_dip_is_one_segment(spark, limit):
    got = cnv.deletion_segments(signal(spark, set(range(130, 140))), limit=limit).collect()
    assert [(r["chrom"], r["start"], r["n_windows"]) for r in got] == [("chr7", 1_300_000, 10)]
    assert cnv.deletion_segments(signal(spark, {50}), limit=limit).count() == 0


def test_flat_signal_has_no_segment(spark):
    flat = signal(spark, set()).withColumn("score", F.lit(0.25))
    assert cnv.deletion_segments(flat).count() == 0


def test_overlap_fraction_and_size_cap(spark):
    known = spark.createDataFrame([("k", "chr1", 0, 400), ("other", "chr2", 0, 400)], "interval_id string, chrom string, start bigint, end bigint")
    segments = spark.createDataFrame([("1", 100, 200)], "chrom string, start bigint, end bigint")
    got = {r["interval_id"]: r["best_overlap"] for r in intervals.segment_overlap(known, segments).collect()}
    assert got == {"k": 0.25, "other": 0.0}
    sized = spark.createDataFrame([("chr1", 0, 5_000_000), ("chr1", 0, 25_000_000)], "chrom string, start bigint, end bigint")
    assert cnv.segment_size_cap(sized, 10).where("kept").count() == 1
    assert cnv.segment_size_cap(sized, None).where("kept").count() == 2


def test_gene_overlap_is_inclusive_and_prefix_tolerant(spark):
    genes = spark.createDataFrame([("A", "chr7", 100, 200), ("B", "chr7", 500, 600), ("C", "chr7", 900, 1000)],
                                  "gene_id string, chrom string, start bigint, end bigint")
    cases = spark.createDataFrame([("one", "chr7", 150, 550), ("two", "7", 150, 550), ("none", "chr7", 700, 800), ("edge", "7", 200, 500), ("bad", "7", 9, 1)],
                                  "case_id string, chrom string, start bigint, end bigint")
    got = {}
    for width in (64, 1 << 20):
        hits = intervals.genes_in_intervals(genes, cases, width)
        got[width] = sorted((r["case_id"], r["gene_id"], r["interval_overlap"]) for r in hits.collect())
    assert got[64] == got[1 << 20] == sorted([("one", "A", "partial"), ("one", "B", "partial"), ("two", "A", "partial"), ("two", "B", "partial"),
                                              ("edge", "A", "partial"), ("edge", "B", "partial")])


@pytest.mark.parametrize("split", [False, True])
def test_block_union(spark, split):
    blocks = spark.createDataFrame([("t", 1, 5), ("t", 6, 8), ("t", 10, 20), ("t", 12, 13), ("t", 22, 30), ("u", 1, 2)], "t string, start bigint, end bigint")
    got = sorted(tuple(r) for r in intervals.merge_blocks(blocks, ["t"], split=split).collect())
    assert got == [("t", 1, 8), ("t", 10, 20), ("t", 22, 30), ("u", 1, 2)]


def features(spark, drop=()):
    rows = []
    for gene, strand, exons, cds, stop in (("A", "+", [(100, 199), (300, 329)], (100, 196), (197, 199)), ("B", "-", [(500, 528), (600, 699)], (603, 699), (600, 602))):
        rows.append((gene, f"T{gene}", "transcript", 1, 9999, strand, ["MANE_Select"]))
        rows += [(gene, f"T{gene}", "exon", s, e, strand, []) for s, e in exons]
        rows.append((gene, f"T{gene}", "CDS", *cds, strand, []))
        rows.append((gene, f"T{gene}", "stop_codon", *stop, strand, []))
    rows = [r for r in rows if r[2] not in drop]
    return spark.createDataFrame(rows, "gene_id string, transcript_id string, feature string, start bigint, end bigint, strand string, tags array<string>")


def test_utr_on_both_strands(spark):
    genes = spark.createDataFrame([("A",), ("B",), ("Z",)], "gene_id string")
    got = {r["gene_id"]: (r["utr3_bp"], r["utr3_status"]) for r in design.transcript_design(features(spark), genes).collect()}
    assert got == {"A": (30, "ok"), "B": (29, "ok"), "Z": (None, "ambiguous_or_missing_transcript")}
    without = {r["gene_id"]: r["utr3_status"] for r in design.transcript_design(features(spark, ("stop_codon",)), genes).collect()}
    assert without["A"] == without["B"] == "incomplete_coding_annotation"


def test_two_tagged_transcripts_are_ambiguous(spark):
    both = features(spark).union(features(spark).withColumn("transcript_id", F.concat("transcript_id", F.lit("x"))))
    got = {r["gene_id"]: (r["transcript_id"], r["transcript_choice"]) for r in design.choose_transcript(design.transcript_summary(both)).collect()}
    assert got == {"A": (None, "MANE_Select"), "B": (None, "MANE_Select")}


def groups(spark):
    return spark.createDataFrame([(f"P{i}", "patient") for i in range(4)] + [(f"R{i}", "reference") for i in range(4)], "cell_id string, group string")


def test_interval_expression_qc(spark):
    cells = groups(spark)
    counts = cells.select("cell_id", F.lit("G1").alias("gene_id"), F.when(F.col("group") == "patient", 2.0).otherwise(4.0).alias("count"))
    genes = spark.createDataFrame([("G1", "G1"), ("G2", "G2")], GENES)
    wanted = spark.createDataFrame([("G1",), ("G2",), ("MISSING",)], "gene_id string")
    got = {r["gene_id"]: r for r in op.interval_gene_qc(counts, cells, wanted, genes).collect()}
    assert (got["G1"]["mean_counts_patient"], got["G1"]["mean_counts_ref"], got["G1"]["pct_expr_patient"]) == (2.0, 4.0, 1.0)
    assert got["G1"]["log2fc_patient_vs_ref"] < 0 and got["G2"]["found"] and got["G2"]["mean_counts_ref"] == 0.0
    assert not got["MISSING"]["found"] and got["MISSING"]["mean_counts_patient"] is None
    with pytest.raises(ValueError):
        op.interval_gene_qc(counts, cells, wanted, genes, "patient", "patient")


def test_depth_is_not_compensation(spark):
    counts = long(spark, [[10, 90], [20, 180]], ["A", "B"], ["P0", "R0"])
    cells = spark.createDataFrame([("P0", "patient"), ("R0", "reference")], "cell_id string, group string")
    wanted = spark.createDataFrame([("A",)], "gene_id string")
    row = op.compensation(counts, cells, op.library_size(counts, cells), wanted).collect()[0]
    assert row["compensation_ratio"] == 1.0 and row["compensation_class"] == "full"


def test_library_contract(spark):
    counts = long(spark, [[10, 90]], ["A", "B"], ["P0"])
    cells = spark.createDataFrame([("P0", 50.0), ("P1", 0.0), ("P2", 5.0)], "cell_id string, size double")
    got = {r["cell_id"]: r["library_status"] for r in op.library_size(counts, cells, "size").collect()}
    assert got == {"P0": "smaller_than_row_sum", "P1": "zero_library", "P2": "ok"}


def test_planted_deletion_is_recovered(spark):
    rng = np.random.default_rng(0)
    base = rng.poisson(4, size=(120, 300))
    base[:40, 160:210] = rng.poisson(1.5, size=(40, 50))
    genes = [f"g{j:03d}" for j in range(300)]
    names = [f"c{i}" for i in range(120)]
    cells = spark.createDataFrame([(c, "s", "patient" if i < 40 else "reference") for i, c in enumerate(names)], "cell_id string, sample_id string, group string")
    gene_table = spark.createDataFrame([(g, g) for g in genes], GENES)
    annotation = spark.createDataFrame([(g, g, "chr1" if j < 100 else "chr2", 1000 * j, 1000 * j + 900) for j, g in enumerate(genes)],
                                       "gene_id string, gene_name string, chrom string, start bigint, end bigint")
    run = workflows.copy_number(long(spark, base, genes, names), cells, gene_table, annotation, [cnv.Resolution("standard", 25, 5)], min_genes=10, include_auto=True, bin_width=1 << 14)
    assert run.windows.count() == 16 + 36
    hits = run.segments.where("chrom = 'chr2' AND start <= 209000 AND end >= 160000").collect()
    assert len(hits) == 1 and run.segments.count() == 1
    assert run.candidates.where("source = 'auto_segment'").count() > 30
    worst = run.windows.orderBy("score").first()
    assert worst["chrom"] == "chr2" and worst["ref_score"] > worst["score"]


def test_smoothing_equals_the_dense_calculation(spark):
    rng = np.random.default_rng(1)
    dense = rng.poisson(1, size=(6, 12)).astype(float)
    genes, names = [f"g{j:02d}" for j in range(12)], [f"c{i}" for i in range(6)]
    cells = spark.createDataFrame([(c, "patient" if i < 3 else "reference") for i, c in enumerate(names)], "cell_id string, group string")
    expr = long(spark, dense, genes, names).withColumnRenamed("count", "value")
    positions = spark.createDataFrame([(g, "chr1", j * 10, j * 10 + 5) for j, g in enumerate(genes)], "gene_id string, chrom string, start bigint, end bigint")
    ladder = [cnv.Resolution("a", 4, 2), cnv.Resolution("b", 6, 4)]
    done = cnv.smooth_signal(expr, cells, positions, ladder, clip=0.8).collect()
    got = {(r["cell_id"], r["win_idx"]): r["signal"] for r in done if r["resolution"] == "a"}
    assert sum(r["resolution"] == "b" for r in done) == 12
    moved = np.clip(dense - dense[3:].mean(axis=0), -0.8, 0.8)
    windows = np.stack([moved[:, i * 2:i * 2 + 4].mean(axis=1) for i in range(5)], axis=1)
    want = windows - np.median(windows, axis=1, keepdims=True)
    assert len(got) == 30
    for i, c in enumerate(names):
        for w in range(5):
            assert got[(c, w)] == pytest.approx(want[i, w], abs=1e-12)


def test_too_few_genes_is_insufficient(spark):
    positions = spark.createDataFrame([("a", "chr1", 1, 2)], "gene_id string, chrom string, start bigint, end bigint")
    assert cnv.gene_windows(positions, 5, 1).count() == 0


def test_provenance(spark):
    genes = spark.createDataFrame([("A", "A", "chr1", 100, 200), ("B", "B", "chr1", 300, 400)], "gene_id string, gene_name string, chrom string, start bigint, end bigint")
    known = spark.createDataFrame([("iv", "chr1", 200, 300)], "deletion_id string, chrom string, start bigint, end bigint")
    auto = spark.createDataFrame([("auto_0", "chr1", 100, 210)], "deletion_id string, chrom string, start bigint, end bigint")
    origins = cnv.candidate_origins(known, auto, genes, include_auto=True)
    assert origins.count() == 3
    got = {r["gene_id"]: (r["source"], r["deletion_id"], r["n_origins"], r["conflict"]) for r in cnv.collapse_origins(origins).collect()}
    assert got == {"A": ("multiple", None, 2, False), "B": ("known_interval", "iv", 1, False)}
    assert cnv.origins_json(origins).count() == 2


# ---------------------------------------------------------------- response
def tiny(spark):
    expr = long(spark, [[1, 2], [2, 4], [3, 6]], ["A", "B"], ["1", "2", "3"]).withColumnRenamed("count", "value")
    cells = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x")], "cell_id string, cell_type string")
    genes = spark.createDataFrame([("A", "A"), ("B", "B")], GENES)
    return expr, cells, genes


def test_linear_response_against_numpy(spark):
    expr, cells, genes = tiny(spark)
    perturbations = spark.createDataFrame([("ko", "A", "ko"), ("oe", "A", "oe"), ("both", "A", "ko"), ("both", "B", "ko")], "pert_id string, gene_id string, direction string")
    run = workflows.predict_perturbation(expr, cells, genes, perturbations, hvg=None)
    x = np.array([[1, 2], [2, 4], [3, 6]], float)
    sigma = np.cov(x.T) + np.eye(2) * 0.1 * np.diag(np.cov(x.T)).mean()
    want = {"ko": sigma @ [-2, 0], "oe": sigma @ [2, 0], "both": sigma @ [-2, -4]}
    got = {(r["pert_id"], r["gene_id"]): r for r in run.response.collect()}
    for name, delta in want.items():
        for j, g in enumerate("AB"):
            assert got[(name, g)]["delta"] == pytest.approx(delta[j])
            assert got[(name, g)]["mean"] == [2.0, 4.0][j]
            half = 1.96 * 0.1 * 0.1 * np.sqrt(sigma[j, j])
            assert got[(name, g)]["ci_high"] - got[(name, g)]["delta"] == pytest.approx(half)
    additive = {(r["pert_id"], r["gene_id"]): r["baseline_additive"] for r in run.top.collect()}
    assert additive[("ko", "A")] == 0.0 and additive[("ko", "B")] == 4.0 and additive[("both", "B")] == 0.0


def test_unknown_target_and_single_cell_are_errors(spark):
    expr, cells, genes = tiny(spark)
    bad = spark.createDataFrame([("p", "NOPE", "ko")], "pert_id string, gene_id string, direction string")
    with pytest.raises(ValueError):
        workflows.predict_perturbation(expr, cells, genes, bad, hvg=None)
    good = spark.createDataFrame([("p", "A", "ko")], "pert_id string, gene_id string, direction string")
    with pytest.raises(ValueError):
        workflows.predict_perturbation(expr.where("cell_id = '1'"), cells.where("cell_id = '1'"), genes, good, hvg=None)


def test_differential_table(spark):
    rows = [("MS", "A", 1.), ("MS", "A", 3.), ("MS", "B", 9.), ("MS", "B", 11.), ("normal", "A", 0.), ("normal", "A", 2.), ("normal", "B", 0.), ("normal", "B", 2.)]
    long_table = spark.createDataFrame(rows, "group string, feature string, value double")
    got = statistics.differential_table(long_table, "MS", "normal").orderBy(F.desc(F.abs("effect_size"))).collect()
    assert [(r["feature"], r["effect_size"]) for r in got] == [("B", pytest.approx(9 / (1 + 1e-6))), ("A", pytest.approx(1 / (1 + 1e-6)))]


def test_metadata_alignment(spark):
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string")
    labels = spark.createDataFrame([("c",), ("a",), ("a",), ("d",), (" ",)], "cell_id string")
    got = {r["cell_id"]: r["status"] for r in op.align_metadata(cells, labels).collect()}
    assert got == {"a": "duplicate", "b": "missing_label", "c": "matched", "d": "extra_label", " ": "blank_id"}


def test_condition_and_disease_labels(spark):
    df = spark.createDataFrame([("A+ctrl",), ("ctrl+A",), ("A",), ("ctrl",), ("A+B",)], "c string")
    assert [r[0] for r in df.select(op.perturbed_gene("c")).collect()] == ["A", "A", "A", None, None]
    text = spark.createDataFrame([("Multiple Sclerosis",), ("normal tissue",), ("Control",), ("other",)], "c string")
    assert [r[0] for r in text.select(op.disease_label("c")).collect()] == ["MS", "normal", "normal", "other"]


@pytest.mark.parametrize("chunk", [7, 4096])
def test_knn_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    refs = np.vstack([rng.normal(size=(60, 5)), np.tile(rng.normal(size=(1, 5)), (30, 1)) + rng.normal(scale=1e-3, size=(30, 5))])
    queries = np.vstack([rng.normal(size=(20, 5)), refs[:3]])
    r = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(refs)], "ref_id bigint, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    got = {}
    for row in embeddings.knn(q, r, 6, pivots=8, chunk=chunk).collect():
        got.setdefault(row["query_id"], set()).add(row["ref_id"])
    d = np.linalg.norm(queries[:, None] - refs[None], axis=2)
    for i in range(len(queries)):
        assert got[i] == set(np.lexsort((np.arange(len(refs)), d[i]))[:6].tolist())


def test_off_target_excludes_the_target(spark):
    expr = long(spark, [[4, 0, 2]] * 10 + [[0, 1, 2]] * 10, ["A", "B", "C"], [f"c{i}" for i in range(20)]).withColumnRenamed("count", "value")
    cells = spark.createDataFrame([(f"c{i}", "ctrl" if i < 10 else "A") for i in range(20)], "cell_id string, perturbed string")
    got = statistics.off_target_impact(expr, cells).collect()
    assert [(r["perturbed"], r["n_cells"], r["impact"]) for r in got] == [("A", 10, 1.0)]


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1., 1.), (2., 1.)], "x double, y double")
    assert statistics.spearman(df, "x", "y").collect()[0]["spearman"] is None


def test_cases_are_centred_apart(spark):
    """One case alone equals its rows in the cohort, at every resolution; a case without reference cells has none."""
    rng = np.random.default_rng(4)
    genes = [f"g{j:02d}" for j in range(24)]
    positions = spark.createDataFrame([(g, f"chr{1 + j // 14}", j * 10, j * 10 + 5) for j, g in enumerate(genes)], "gene_id string, chrom string, start bigint, end bigint")
    ladder = [cnv.Resolution("wide", 6, 3), cnv.Resolution("fine", 3, 3)]
    cells, frames = [], []
    for case in ("A", "B", "C"):
        names = [f"c{i}" for i in range(5)]
        cells += [(case, c, "patient" if i < 3 or case == "C" else "reference") for i, c in enumerate(names)]
        frames.append(long(spark, rng.poisson(1.0, size=(5, 24)).astype(float), genes, names).withColumn("case_id", F.lit(case)))
    cells = spark.createDataFrame(cells, "case_id string, cell_id string, group string")
    expr = frames[0].union(frames[1]).union(frames[2]).withColumnRenamed("count", "value")
    windows = cnv.resolution_windows(positions, ladder)
    keep = lambda df: sorted((r["resolution"], r["chrom"], r["win_idx"], round(r["score"], 9), round(r["ref_score"], 9)) for r in df.collect())
    whole = cnv.window_group_signal(cnv.smooth_signal(expr, cells, positions, ladder, ["case_id"]), windows, ["case_id"])
    for case in ("A", "B"):
        one = cnv.smooth_signal(expr.where(F.col("case_id") == case).drop("case_id"), cells.where(F.col("case_id") == case).drop("case_id"), positions, ladder)
        assert keep(whole.where(F.col("case_id") == case)) == keep(cnv.window_group_signal(one, windows))
    assert whole.where("case_id = 'C'").count() == 0


def test_segments_and_recovery_by_case_and_resolution(spark):
    rows = [(case, name, "chr1", k, k * 100, k * 100 + 99, (-5.0 if case == "A" and 10 <= k < 14 else 0.0) + k % 3 * 0.1)
            for case in ("A", "B") for name in ("x", "y") for k in range(40)]
    windows = spark.createDataFrame(rows, "case_id string, resolution string, chrom string, win_idx bigint, start bigint, end bigint, score double")
    segments = cnv.deletion_segments(windows, order=("win_idx",), by=["case_id", "resolution"])
    assert sorted((r["case_id"], r["resolution"], r["start"], r["end"], r["n_windows"]) for r in segments.collect()) == [("A", "x", 1000, 1399, 4), ("A", "y", 1000, 1399, 4)]
    known = spark.createDataFrame([("k", "chr1", 1000, 1399), ("far", "chr9", 1, 2)], "interval_id string, chrom string, start bigint, end bigint")
    genes = spark.createDataFrame([("g", "chr1", 1100, 1200)], "gene_id string, chrom string, start bigint, end bigint")
    qc = spark.createDataFrame([("A", "g", True, -1.0)], "case_id string, gene_id string, found boolean, log2fc_patient_vs_ref double")
    markers = spark.createDataFrame([("k", "g")], "interval_id string, gene_id string")
    got = {(r["interval_id"], r["case_id"], r["resolution"]): (r["cnv_status"], r["expression_status"], r["n_genes_in_expression"])
           for r in cnv.known_vs_auto(known, genes, segments, windows, qc, markers, by=["case_id", "resolution"]).collect()}
    assert len(got) == 8
    assert got["k", "A", "x"] == ("PASS", "PASS", 1) and got["k", "B", "y"] == ("FAIL", "INSUFFICIENT_DATA", 0)
    assert got["far", "A", "x"] == ("INSUFFICIENT_DATA", "INSUFFICIENT_DATA", 0)


def test_top_expressed_response_needs_only_the_top_genes(spark):
    """Covariance rows of the genes in some group's top give the same means as the whole response."""
    rng = np.random.default_rng(8)
    genes, names = [f"g{j}" for j in range(9)], [f"c{i}" for i in range(24)]
    expr = long(spark, rng.poisson(1.0, size=(24, 9)).astype(float), genes, names).withColumnRenamed("count", "value")
    cells = spark.createDataFrame([(c, "ab"[i % 2]) for i, c in enumerate(names)], "cell_id string, cell_type string")
    space = response.fit_space(op.gene_moments(expr, cells, spark.createDataFrame([(g,) for g in genes], "gene_id string")))
    top = response.top_expressed(expr, cells, space, 3)
    whole = response.covariance_columns(expr, space, space)
    few = response.covariance_columns(expr, space, space, genes=top)
    chosen = {r["gene_id"] for r in top.collect()}
    assert 3 <= len(chosen) < 9 and top.count() == 6
    assert {r["gene_id"] for r in few.collect()} == chosen and few.count() == 9 * len(chosen)
    shifts = response.perturbation_shift(space.select("gene_id", F.col("gene_id").alias("pert_id"), F.lit("ko").alias("direction")), space)
    means = [{(r["pert_id"], r["cell_type"]): r["response"] for r in response.group_response_top_expressed(response.linear_response(c, shifts, space), top).collect()} for c in (whole, few)]
    assert len(means[0]) == 18 and means[0] == pytest.approx(means[1])


def test_group_signal_needs_no_row_for_each_cell_and_window(spark, monkeypatch):
    """Equal to the means of the signal rows, over parts and steps of few cells, and to a dense calculation; tasks return sums only."""
    from lociframe.plans import cnv as plans
    monkeypatch.setattr(cnv, "PART_CELLS", 3)
    monkeypatch.setattr(cnv, "STEP_VALUES", 10)
    rng = np.random.default_rng(8)
    genes, names = [f"g{j:02d}" for j in range(23)], [f"c{i}" for i in range(11)]
    where = lambda j: f"chr{1 + (j > 12) + (j > 20)}"  # the last chromosome has too few genes for a window
    positions = spark.createDataFrame([(g, where(j), j * 10, j * 10 + 5) for j, g in enumerate(genes)], "gene_id string, chrom string, start bigint, end bigint")
    ladder = [cnv.Resolution("wide", 4, 2), cnv.Resolution("fine", 3, 1)]
    dense = rng.poisson(0.4, size=(2, 11, 23)).astype(float)
    of = lambda i: "reference" if i < 4 else "patient" if i < 9 else "other"
    cells = spark.createDataFrame([(case, c, of(i)) for case in ("A", "B", None) for i, c in enumerate(names)], "case_id string, cell_id string, group string")
    expr = long(spark, dense[0], genes, names).withColumn("case_id", F.lit("A")).union(
        long(spark, dense[1], genes, names).withColumn("case_id", F.lit("B"))).withColumnRenamed("count", "value")
    windows = cnv.resolution_windows(positions, ladder)
    for extra in ({}, {"clip": 0.7, "noise_sd": 0.5}):
        signal = cnv.smooth_signal(expr, cells, positions, ladder, ["case_id"], **extra)
        keep = lambda df: sorted((r["case_id"], r["resolution"], r["chrom"], r["win_idx"], r["start"], round(r["score"], 9), round(r["ref_score"], 9)) for r in df.collect())
        got = keep(cnv.smooth_group_signal(expr, cells, positions, ladder, windows, ["case_id"], **extra))
        assert got == keep(cnv.window_group_signal(signal, windows, ["case_id"])) and {r[0] for r in got} == {"A", "B"}
    rows = {(r["case_id"], r["cell_id"], r["chrom"], r["win_idx"]): r["signal"] for r in
            cnv.smooth_signal(expr, cells, positions, ladder, ["case_id"]).where("resolution = 'fine'").collect()}
    for k, case in enumerate("AB"):
        moved = dense[k] - dense[k][:4].mean(axis=0)
        at = [("chr1", i, i) for i in range(11)] + [("chr2", i, 13 + i) for i in range(6)]
        means = np.stack([moved[:, j:j + 3].mean(axis=1) for _, _, j in at], axis=1)
        want = means - np.median(means, axis=1, keepdims=True)
        for i, c in enumerate(names):
            assert [rows[(case, c, chrom, w)] for chrom, w, _ in at] == pytest.approx(want[i].tolist(), abs=1e-12)
    assert len(rows) == 2 * 11 * 17
    plan = plans.window_group_signal(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "median" not in plan and "percentile" not in plan


def test_window_signal_is_rounded_without_decimals(spark):
    """Six digits as from a decimal rounding, ties of halves aside; a row costs no decimal."""
    from lociframe.functions.columns import fixed, rounded
    from lociframe.plans import cnv as plans
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(x),) for x in [*rng.normal(size=500), -1e-9, 0.0, 123456.1234567]] + [(None,)], "x double")
    got = df.select(rounded("x").alias("a"), fixed("x").alias("b")).collect()
    assert all(r["a"] == r["b"] and str(r["a"]) != "-0.0" for r in got)
    plan = plans.window_smooth_signal(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rint" in plan.lower() and "round(signal" not in plan and "MapInArrow" in plan
