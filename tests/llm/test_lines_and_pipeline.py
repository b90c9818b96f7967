"""Line dedup against brute force, the whole pipeline, and the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociframe.llm import line_dedup, queries

FOLDER = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_verdicts(rows):
    """(doc, line number) of the lines that stay."""
    rows = list(dict.fromkeys(rows))
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\v\f"):
                first.setdefault(line, (i is None, i or 0, k))
    near = {}
    for a in first:
        for b in first:
            longer = max(len(a), len(b))
            most = 0 if longer < 5 else 1 if longer < 10 else 2
            if a != b and min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most:
                near.setdefault(a, []).append(b)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = sum(1 for k, x in enumerate(lines) if x in first and (first[x] != (i is None, i or 0, k) or any(first[y] < first[x] for y in near.get(x, []))))
        close = sum(1 for x in lines if any(first[y] < first[x] for y in near.get(x, [])))
        out.append((i, len(lines), gone, close))
    return out


def test_lines_against_brute_force(docs, awkward):
    base = "This line is shared by many of the documents here."
    rows = [*awkward, (10, base), (11, base.replace("shared", "shred")), (12, base + "!!"), (13, "Abcde\nAbcd\nabcdef\nAb"), (14, base.replace("many", "some")),
            (15, "fine text\nfine test\nfive texts"), (16, "x" + base[1:] + "y"), (17, "😀" * 12), (18, "😀" * 11 + "é")]
    got = sorted((tuple(r) for r in line_dedup.summary(docs(rows)).collect()), key=repr)
    assert got == sorted(plain_verdicts(rows), key=repr)
    assert line_dedup.summary(docs([])).count() == 0


def test_query_counts_all_links(spark, tmp_path, awkward):
    """Rows, links included, as the SQL twin has them: groups of near copies, lines that stand often, two lengths."""
    duckdb = pytest.importorskip("duckdb")
    base = "A line of which many documents hold a copy, place %s."
    rows = [*[r for r in awkward if r[0] is not None], *[(100 + i, f"{base % chr(97 + i % 26)}\n{base % (i % 9)}!\n{base % 'a'}\nAbcde\nAbcd") for i in range(60)]]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op6_line_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(queries.LINES).fetchall())
    assert df.columns[-1] == "n_links" and df.agg(F.max("n_links")).first()[0] > 100


def test_near_copies_compare_linearly(docs, spark):
    """2,000 lines within two edits of one another: each meets the earliest of its buckets, not all the others."""
    base = "A long line that stands in very many documents, each time with a small change at %s place."
    rows = [(i, base % f"{i // 45:02d}"[:1] + chr(97 + i % 26)) for i in range(2000)]
    got = {r["doc_id"]: (r["n_removed"], r["n_near"]) for r in line_dedup.summary(docs(rows)).collect()}
    want = {i: (gone, close) for i, _, gone, close in plain_verdicts([r for r in rows if r[0] < 300])}
    assert all(got[i] == want[i] for i in range(300)) and all(got[i][0] == 1 for i in range(300, 2000))


def test_nulls_and_repeated_rows_lose_lines_alike(docs):
    line = "The very same line of text."
    rows = [(None, line), (None, line), (1, f"{line}\nmine alone"), (1, f"{line}\nmine alone"), (2, None), (2, ""), (3, f"{line}\nanother one here")]
    out = line_dedup.remove_lines(docs(rows))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(
        [(1, f"{line}\nmine alone"), (1, f"{line}\nmine alone"), (2, None), (2, ""), (3, "another one here")], key=repr)
    assert out.columns == docs(rows).columns


def test_removed_lines_leave_the_rest(docs):
    rows = [(1, "Alpha beta gamma delta.\nkeep me here"), (2, "Alpha beta gamma delta!\nanother thing"), (3, "Alpha beta gamma delta."), (4, None), (5, "\n \n")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(docs(rows)).collect()}
    assert got == {1: "Alpha beta gamma delta.\nkeep me here", 2: "another thing", 4: None, 5: "\n \n"}


@pytest.mark.parametrize("edits", [1, 2])
def test_bit_parallel_distance(spark, edits):
    import random
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = [rng.choice("abé") for _ in range(rng.randint(3, 25))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            rng.choice([lambda: b.insert(at, "c"), lambda: b.__setitem__(at, "b"), lambda: b.pop(at) if len(b) > 3 else None])()
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.padded(F.col("x"), edits).alias("p"), line_dedup.characters(F.col("y")).alias("q"))
    for r in df.withColumn("d", line_dedup.edit_distance(F.col("p"), F.col("q"), edits)).collect():
        want = levenshtein(r["x"], r["y"])
        assert (r["d"] == want) if want <= edits else r["d"] > edits


def test_native_plan_has_no_python(docs):
    plan = line_dedup.summary(docs([(1, "a line of text")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "pieces"]
    assert {r["doc_id"] for r in out} < before and len(out) > 50 and len({r["doc_id"] for r in out}) == len(out)
    good = corpus_pipeline.good_documents(spark, docs, FOLDER)
    assert good.columns == columns and corpus_pipeline.one_of_each(spark, docs, FOLDER).columns == columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rated = queries.QUERIES["op8_quality"](spark, FOLDER).join(labels, "doc_id").where("not base_failed")
    assert rated.where("quality = 1 and not kept").count() == 0 and rated.where("quality = 0 and kept").count() <= 2


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")
def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want


def test_memory_of_a_large_batch_is_bounded():
    """Classifier rules and fingerprints of 8 MB of texts in one batch: slices keep the arrays of a worker small."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lociframe.llm import arrow_text, quality, simhash
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{k}" for k in rng.integers(0, 3000, 700)) for _ in range(2400)]})
    model = quality.Model(np.zeros(quality.DIMENSIONS, np.float32), 0.0, 1.0, 0.0)
    arrow_text._powers.cache_clear()
    for work in (lambda d, o: quality._verdicts(model, d, o), simhash.fingerprints_of):
        tracemalloc.start()
        for _, data, offsets in arrow_text.pieces(batch, "text"):
            work(data, offsets)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000
