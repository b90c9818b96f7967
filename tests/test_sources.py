"""Readers and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lociframe.operators import identity
from lociframe.sources import matrix, sinks, tables

# Invented genes: a versioned id, a biotype under its other name, another biotype, a contig that is not kept, repeated tags.
GTF = "\n".join([
    "##provider: nobody",
    'chr9\tT\tgene\t81500\t90210\t.\t-\t.\tgene_id "ENSG70021.11"; gene_type "protein_coding"; gene_name "QORV4";',
    'chr9\tT\tgene\t4400\t7310\t.\t+\t.\tgene_id "ENSG70044.2"; gene_biotype "protein_coding"; gene_name "TELM";',
    'chr2\tT\tgene\t650\t1270\t.\t+\t.\tgene_id "ENSG70003.5"; gene_type "protein_coding"; gene_name "BRUX1";',
    'chr2\tT\tgene\t2000\t2750\t.\t-\t.\tgene_id "ENSG70090"; gene_type "miRNA"; gene_name "SILQ";',
    'chrM\tT\tgene\t12\t88\t.\t+\t.\tgene_id "ENSG70091"; gene_type "protein_coding"; gene_name "MOTO";',
    'chr2\tT\ttranscript\t650\t1270\t.\t+\t.\tgene_id "ENSG70003.5"; transcript_id "BX-1"; tag "basic"; tag "MANE_Select";',
    'chr2\tT\texon\t650\t1270\t.\t+\t.\tgene_id "ENSG70003.5"; transcript_id "BX-1";',
]) + "\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_gtf_genes_plain_and_gz(spark, tmp_path):
    plain = write(tmp_path / "a.gtf", GTF)
    zipped = tmp_path / "a.gtf.gz"
    with gzip.open(zipped, "wt") as handle:
        handle.write(GTF)
    for path in (plain, str(zipped)):
        genes = tables.read_gtf_genes(spark, path).collect()
        assert [(g["gene_name"], g["gene_id"], g["start"]) for g in genes] == [
            ("BRUX1", "ENSG70003", 650), ("TELM", "ENSG70044", 4400), ("QORV4", "ENSG70021", 81500)]
    assert tables.read_gtf_genes(spark, plain, gene_types=None).count() == 4


def test_gtf_features_keep_repeated_tags(spark, tmp_path):
    path = write(tmp_path / "a.gtf", GTF)
    genes = spark.createDataFrame([("ENSG70003",)], "gene_id string")
    got = {r["feature"]: r["tags"] for r in tables.read_gtf_features(spark, path, genes).collect()}
    assert got == {"transcript": ["basic", "MANE_Select"], "exon": []}


def test_curation_preamble_and_repeated_header(spark, tmp_path):
    text = "\n".join(["#ClinGen list", "#File date", "#Gene Symbol\tHaploinsufficiency Score\tTriplosensitivity Score\tPMID\tPMID",
                      "AAA\t3\t0\t1\t2", "BBB\tNA\t40\t\t"]) + "\n"
    table = tables.read_curation_tsv(spark, write(tmp_path / "c.tsv", text))
    assert table.columns == ["gene symbol", "haploinsufficiency score", "triplosensitivity score", "pmid"]
    assert sorted(tuple(r) for r in table.fillna("").collect()) == [("AAA", "3", "0", "1"), ("BBB", "", "40", "")]
    with pytest.raises(ValueError):
        tables.read_curation_tsv(spark, write(tmp_path / "bad.tsv", "Gene\tScore\nA\t1\n"))


def test_constraint_and_tissue(spark, tmp_path):
    head = "gene_id\ttranscript\tmane_select\tcanonical\tlof.pLI\tlof.oe_ci.upper\tconstraint_flags\tgene_flags\textra\n"
    path = write(tmp_path / "k.tsv", head + "ENSG1.2\tT1\ttrue\ttrue\t0.5\t0.2\t[]\t\tz\nENSG7\tT2\tfalse\ttrue\tNA\t\t[]\t\tz\n")
    wanted = spark.createDataFrame([("ENSG1",)], "gene_id string")
    assert [r["gene_id"] for r in tables.read_constraint_tsv(spark, path, wanted).collect()] == ["ENSG1"]
    tissue = write(tmp_path / "t.tsv", "Gene\tGene name\tTissue\tnTPM\nENSG1\tAAA\tliver\t2.5\n")
    assert tables.read_tissue_long(spark, tissue).collect()[0]["ntpm"] == 2.5
    broken = write(tmp_path / "u.tsv", "Gene\tGene name\tTissue\tnTPM\nENSG1\tAAA\tliver\tlow\n")
    with pytest.raises(Exception):
        tables.read_tissue_long(spark, broken).collect()


def test_alias_table_padded_and_quoted(spark, tmp_path, rows):
    # Padding in headers and cells, an alias that is another record's symbol, one that two records claim.
    text = ' hgnc_id \t symbol \tprev_symbol\talias_symbol\nHGNC:31 \t FENK\t FNX;FN-0 \tTWICE,GALD\nHGNC:45\tGALD\tGLD9\tTWICE\n'
    table = tables.read_alias_table(spark, write(tmp_path / "h.tsv", text))
    got = dict(rows(identity.build_alias_map(table), "alias", "hgnc_id"))
    assert got == {"fenk": "HGNC:31", "gald": "HGNC:45", "fnx": "HGNC:31", "fn-0": "HGNC:31", "gld9": "HGNC:45"}


def test_legacy_constraint_lines(spark, tmp_path):
    path = write(tmp_path / "l.tsv", "gene\tpLI\toe_lof_upper\nPRAV\t0.72\tNA\nOBLI\t0.33\t0.61\n")
    got = sorted(tuple(r) for r in tables.read_legacy_constraint_tsv(spark, path).fillna("-").collect())
    assert got == [("OBLI", "0.33", "0.61", 2), ("PRAV", "0.72", "-", 1)]


def test_interval_formats_agree(spark, tmp_path):
    bed = write(tmp_path / "a.bed", "track name=x\n#c\nchr4 99 699\n")
    tsv = write(tmp_path / "a.tsv", "c\ts\te\n4\t100\t699\n")
    csv = write(tmp_path / "a.csv", "﻿c,s,e\n4,99,699\n")
    cells = ("c", "s", "e")
    got = [tables.read_interval_table(spark, bed, "bed"), tables.read_interval_table(spark, tsv, "tsv", "1-based-inclusive", cells),
           tables.read_interval_table(spark, csv, "csv", "0-based-half-open", cells)]
    assert [[r["interval"] for r in g.collect()] for g in got] == [["chr4:100-699"]] * 3
    regions = write(tmp_path / "r.tsv", "#Genomic Locations are reported on GRCh38\n#ISCA ID\tISCA Region Name\tGenomic Location\n"
                    "ISCA-1\tRegion\tchr4:100-699\nISCA-2\tNone\ttbd\n")
    found = {r["case_id"]: (r["interval"], r["reject_reason"]) for r in tables.read_interval_table(spark, regions, "regions").collect()}
    assert found["ISCA-1"] == ("chr4:100-699", None) and found["ISCA-2"][0] is None
    with pytest.raises(ValueError):
        tables.read_interval_table(spark, csv, "csv")


@pytest.mark.parametrize("line", ["chr4 5 5", "chr4 9 5", "chr4 -1 5", "chr4 1.5 5", "chr99 1 5"])
def test_bad_intervals_are_rejected(spark, tmp_path, line):
    row = tables.read_interval_table(spark, write(tmp_path / "b.bed", line + "\n"), "bed").collect()[0]
    assert row["interval"] is None and row["reject_reason"]


def test_gene_lists(spark, tmp_path):
    labels = lambda df: [r["label"] for r in df.collect()]
    assert labels(tables.read_gene_list(spark, write(tmp_path / "a.txt", "﻿OLD_A\n\nHGNC:2\n"), "txt")) == ["OLD_A", "HGNC:2"]
    assert labels(tables.read_gene_list(spark, write(tmp_path / "a.csv", "gene,x\nOLD_A,1\nHGNC:2,2\n"), "csv", "gene")) == ["OLD_A", "HGNC:2"]
    for name, text in (("e.txt", "\n"), ("d.txt", "A\nA\n"), ("s.txt", "A;B\n")):
        with pytest.raises(ValueError):
            tables.read_gene_list(spark, write(tmp_path / name, text), "txt")
    with pytest.raises(ValueError):
        tables.read_gene_list(spark, write(tmp_path / "m.csv", "x\nA\n"), "csv", "gene")


def test_scores_and_viability_contracts(spark, tmp_path):
    good = write(tmp_path / "s.csv", "ensembl,gene_symbol,DeepLOF_score\nE1,A,0.5\n")
    assert tables.read_ai_scores(spark, good).collect()[0]["DeepLOF_score"] == 0.5
    for i, value in enumerate(("NaN", "inf", "-0.1", "1.1", "text", "True", "")):
        with pytest.raises(ValueError):
            tables.read_ai_scores(spark, write(tmp_path / f"s{i}.csv", f"ensembl,gene_symbol,DeepLOF_score\nE1,A,{value}\n"))
    head = "gene_id\tmouse_gene_id\timpc_viability\tsource\trelease\tmapping_source\n"
    assert tables.read_viability(spark, write(tmp_path / "v.tsv", head + "E1\tM1\tviable\ts\t1\tm\n")).count() == 1
    for i, body in enumerate(("E1\tM1\tviable\t\t1\tm\n", "E1\tM1\tfine\ts\t1\tm\n", "E1\tM1\tviable\ts\t1\tm\nE1\tM2\tlethal\ts\t1\tm\n")):
        with pytest.raises(ValueError):
            tables.read_viability(spark, write(tmp_path / f"v{i}.tsv", head + body))


def test_inheritance_files(spark, tmp_path, rows):
    from lociframe.operators import evidence
    omim = write(tmp_path / "o.tsv", "# Copyright\n# Gene Symbols\tX\tPhenotypes\tApproved Gene Symbol\n"
                 "OLD, N\t1\tThing, Autosomal recessive\tNEW\nB\t1\tAutosomal recessive, Autosomal dominant\tB\nC\t1\tX-linked recessive\tC\n")
    records = tables.read_inheritance(spark, omim, "records")
    assert rows(evidence.recessive_symbols(records, "Phenotypes", "Approved Gene Symbol", "Gene Symbols"), "symbol") == [("NEW",)]
    modes = write(tmp_path / "m.tsv", "GeneSymbol\tModeOfInheritance\nA\tAutosomal recessive\nB\tAutosomal recessive\nB\tAutosomal dominant\n")
    assert rows(evidence.recessive_from_modes(tables.read_inheritance(spark, modes, "modes")), "symbol") == [("A",)]


def test_association_snapshot(spark, tmp_path, rows):
    from lociframe.operators import evidence
    hit = {"disease": {"id": "D1", "name": "d"}, "score": 0, "datasourceScores": []}
    snapshot = {"release": "26.09", "disease_id": "D1", "phenotype_ids": [], "records": {
        "G1": {"status": "ok", "associations": [hit], "background": []},
        "G2": {"status": "ok", "associations": [], "background": []}, "G3": {"status": "query_failed", "error": "down"}}}
    path = write(tmp_path / "s.json", json.dumps(snapshot, indent=1))
    genes = spark.createDataFrame([("G1",), ("G2",), ("G3",)], "gene_id string")
    done = evidence.association_annotation(genes, tables.read_association_snapshot(spark, path, "D1", "26.09"), "D1")
    assert rows(done, "gene_id", "ot_status", "ot_disease_score") == [
        ("G1", "available", 0.0), ("G2", "no_record", None), ("G3", "query_failed", None)]
    with pytest.raises(ValueError):
        tables.read_association_snapshot(spark, path, "D2", "26.09")


# ---------------------------------------------------------------- 10x
def triple(folder, matrix_text=None, features="ID_A\tA\tGene Expression\nID_B\tB\tGene Expression\n", barcodes="C1\nC2\n"):
    folder.mkdir()
    text = matrix_text or "%%MatrixMarket matrix coordinate integer general\n%c\n2 2 4\n1 1 9\n2 1 3\n1 2 4\n2 2 7\n"
    return {"matrix": write(folder / "matrix.mtx", text), "features": write(folder / "features.tsv", features),
            "barcodes": write(folder / "barcodes.tsv", barcodes)}


def test_10x_counts(spark, tmp_path, rows):
    got = matrix.read_10x(spark, **triple(tmp_path / "a"))
    assert rows(got.counts, "cell_id", "gene_id", "count") == [
        ("C1", "ID_A", 9.0), ("C1", "ID_B", 3.0), ("C2", "ID_A", 4.0), ("C2", "ID_B", 7.0)]


HEAD = "%%MatrixMarket matrix coordinate integer general\n"


@pytest.mark.parametrize("change", [
    {"matrix_text": HEAD + "3 2 1\n1 1 9\n"}, {"matrix_text": HEAD + "2 3 1\n1 1 9\n"}, {"matrix_text": HEAD + "2 2 2\n1 1 9\n"},
    {"matrix_text": HEAD + "2 2 1\n1 1 -1\n"}, {"matrix_text": HEAD + "2 2 1\n1 1 1.5\n"}, {"matrix_text": HEAD + "2 2 1\n1 1 inf\n"},
    {"matrix_text": HEAD + "2 2 2\n1 1 9\n1 1 3\n"}, {"matrix_text": HEAD + "2 2 1\n3 1 9\n"}, {"matrix_text": "2 2 1\n1 1 9\n"},
    {"features": "ID_A\tA\tGene Expression\nID_A\tB\tGene Expression\n"}, {"features": "ID_A\tA\tAntibody Capture\nID_B\tB\tGene Expression\n"},
    {"features": "ID_A\nID_B\n"}, {"features": " ID_A\tA\nID_B\tB\n"}, {"features": "ID_A\t\nID_B\tB\n"},
    {"barcodes": "C1\nC1\n"}, {"barcodes": "C1\tx\nC2\ty\n"}])
def test_10x_contract(spark, tmp_path, change):
    with pytest.raises(ValueError):
        matrix.read_10x(spark, **triple(tmp_path / "bad", **change))


def test_samples_need_the_same_features(spark, tmp_path):
    a = {"id": "S1", "group": "patient", **triple(tmp_path / "a")}
    b = {"id": "S2", "group": "reference", **triple(tmp_path / "b")}
    both = matrix.read_samples(spark, [a, b])
    assert both.cells.count() == 4 and both.counts.select("cell_id").distinct().count() == 4
    c = {"id": "S3", "group": "reference", **triple(tmp_path / "c", features="ID_B\tB\tGene Expression\nID_A\tA\tGene Expression\n")}
    with pytest.raises(ValueError):
        matrix.read_samples(spark, [a, c])
    with pytest.raises(ValueError):
        matrix.read_samples(spark, [a, a])


# ---------------------------------------------------------------- sinks
def test_sinks_refuse_existing_output(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 2, "B", 0.5), (1, 1, "A", 0.9)], "case_id int, rank int, symbol string, consensus_score double")
    ranked = ranked.withColumn("tags", F.array("symbol"))
    path = str(tmp_path / "ranked")
    sinks.write_ranked(ranked, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ranked.columns and back.count() == 2
    with pytest.raises(Exception):
        sinks.write_ranked(ranked, path)
    sinks.write_summary(ranked, str(tmp_path / "summary"))
    summary = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert len(summary.columns) == 17 and summary.count() == 2
    sinks.write_evidence(ranked, str(tmp_path / "evidence"))
    assert tables.read_evidence(spark, str(tmp_path / "evidence")).count() == 2
    sinks.write_candidates(ranked, str(tmp_path / "candidates"))


def test_line_numbers_across_scan_partitions(spark, tmp_path):
    path = write(tmp_path / "long.txt", "".join(f"line{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = tables.numbered_lines(spark, path)
        assert lines.select(F.spark_partition_id()).distinct().count() > 1
        assert all(r["value"] == f"line{r['line']}" for r in lines.collect())
        assert lines.agg(F.countDistinct("line")).first()[0] == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_several_files_and_blocks(spark, tmp_path):
    """Numbers run on from file to file in order of their names, whatever blocks a scan cuts them into."""
    folder = tmp_path / "many"
    folder.mkdir()
    texts = {f"part-{k}": [f"{k}:{i}:" + "x" * (i % 7) for i in range(40 + 90 * (k % 2))] for k in range(4)}
    for name, lines in texts.items():
        write(folder / name, "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        got = sorted((r["line"], r["in_file"], r["value"]) for r in tables.numbered_lines(spark, str(folder)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    flat = [(i, line) for name in sorted(texts) for i, line in enumerate(texts[name])]
    assert got == [(n, i, line) for n, (i, line) in enumerate(flat)]


def test_evidence_of_few_cases_reads_few_folders(spark, tmp_path):
    path = str(tmp_path / "evidence")
    frame = spark.range(200).select((F.col("id") % 40).alias("case_id"), F.col("id").alias("gene_id"))
    sinks.write_evidence(frame, path)
    found = sinks.read_cases(spark, path, [3])
    assert sorted(r["gene_id"] for r in found.collect()) == [3, 43, 83, 123, 163] and found.columns == ["gene_id", "case_id"] or found.columns == ["case_id", "gene_id"]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "case_bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert len(found.inputFiles()) > 0


def test_duplicate_evidence_stops_the_join(spark):
    from lociframe.operators.evidence import join_evidence
    genes = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    good = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "g string, v double")
    assert sorted(((r["g"], r["v"]) for r in join_evidence(genes, good, "g").collect()), key=repr) == sorted([("a", 1.0), ("b", None), (None, None)], key=repr)
    twice = good.union(spark.createDataFrame([("b", 1.0), ("b", 2.0)], "g string, v double"))
    joined = join_evidence(genes, twice, "g")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(g") <= 3
    with pytest.raises(Exception, match="duplicate g in evidence: b"):
        joined.collect()
