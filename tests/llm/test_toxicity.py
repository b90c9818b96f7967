"""The convolutional classifier against a plain forward pass, and its accuracy on held-out rows."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def held(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def plain_margin(net, text):
    """Word by word, filter by filter."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", lowered)
    vectors = []
    for word in words:
        buckets, _ = toxicity.word_buckets(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        vectors.append(np.concatenate([net.tables[k][buckets[k, 0]] for k in range(toxicity.TABLES)]).astype(float))
    nothing = np.zeros(toxicity.TABLES * toxicity.SIDE)
    margin, block = net.bias, 0
    for w, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max((sum(float(net.filters[block + p, f] @ (vectors[t + p] if t + p < len(words) else nothing)) for p in range(width))
                        for t in range(len(words))), default=0.0)
            margin += max(best + float(net.offset[w, f]), 0) * float(net.top[w, f])
        block += width
    return margin


def plain_score(classifier, text):
    margin = sum(plain_margin(net, text) for net in classifier.members) / len(classifier.members)
    return 1 / (1 + math.exp(-(classifier.slope * margin + classifier.shift)))


@pytest.fixture(scope="module")
def network(spark):
    docs, labels = queries.table(spark, FOLDER, "documents"), queries.table(spark, FOLDER, "labels")
    return toxicity.fit(docs, labels, held())


def test_held_out_accuracy(spark, network):
    docs, labels = queries.table(spark, FOLDER, "documents"), queries.table(spark, FOLDER, "labels")
    scored = toxicity.score(docs, network, held())
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score", "flagged").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.75
    assert hit / sum(r["predicted"] for r in rows) > 0.9
    assert sum(r["toxic"] and r["flagged"] for r in rows) >= 0.75 * sum(r["toxic"] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_held_out_labels_are_not_read(spark, docs):
    rows = [(i, "good words here" if i % 2 else "awful words there") for i in range(60)]
    frame = docs(rows).drop("id").withColumn("lang", F.lit("en"))
    true = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    lies = spark.createDataFrame([(i, int((i % 2 == 0) != (zlib.crc32(str(i).encode()) % 3 == 1))) for i in range(60)], "doc_id long, toxic int")
    one, two = (toxicity.fit(frame, t, held()) for t in (true, lies))
    assert all((a.tables == b.tables).all() and a.bias == b.bias for a, b in zip(one.members, two.members, strict=True)) and one.slope == two.slope


def test_scores_equal_a_plain_forward_pass(docs, awkward, network):
    rows = [*awkward, (20, "You IDIOT, trash talk."), (21, "word " * 70_000 + "idiot"), (22, "x")]
    frame = docs(rows).drop("lang").withColumn("lang", F.lit(None).cast("string"))
    got = sorted(((r["doc_id"], round(r["score"], 4)) for r in toxicity.score(frame, network, held()).collect()), key=repr)
    # The long row repeats one word, so a short one has the same windows.
    want = sorted(((i, round(plain_score(network, "word word word word idiot" if i == 21 else t or ""), 4)) for i, t in rows), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-4)


def test_odd_labels_and_empty_tables(spark, docs):
    frame = docs([(1, "a b"), (None, "c"), (2, None)]).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.fit(frame, labels, held()) is None
    got = sorted(((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in toxicity.score(frame, None, held()).collect()), key=repr)
    assert got == sorted([(1, zlib.crc32(b"1") % 3 == 1, 0.0, 0), (None, False, 0.0, 0), (2, zlib.crc32(b"2") % 3 == 1, 0.0, 0)], key=repr)
    empty = docs([]).withColumn("lang", F.lit("en"))
    assert toxicity.score(empty, toxicity.fit(empty, labels, held()), held()).collect() == []


def test_thresholds_by_hand():
    scores, toxic = np.array([0.9, 0.8, 0.8, 0.4, 0.1]), np.array([1.0, 1, 0, 1, 0])
    # F1 at 0.9: 2/4; at 0.8: 4/6; at 0.4: 6/7.
    assert toxicity.best_threshold(scores, toxic) == pytest.approx(0.25)


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Labels beyond the 5,000 smallest hashes of an id matter, for networks trained in parts and for thresholds."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 1000)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    frame = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), (F.col("id") % 7).cast("string"), F.when(F.col("id") % 5 == 0, " awful").otherwise(" fine")).alias("text"), F.lit("en").alias("lang"))
    true = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    late = [r["doc_id"] for r in true.where(~held()).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()[5000:]]
    assert len(late) > 500
    lies = true.withColumn("toxic", F.when(F.col("doc_id").isin(late), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(frame, t, held()) for t in (true, lies))
    assert all((a.tables != b.tables).any() for a, b in zip(one.members, two.members, strict=True))
    assert one.slope != two.slope and set(one.thresholds) == {"en"}
    assert [r["predicted"] for r in toxicity.score(frame, one, held()).where("doc_id < 10").orderBy("doc_id").collect()] == [1, 0, 0, 0, 0] * 2


def test_texts_without_a_label_do_not_travel(spark, monkeypatch):
    """Where labels are too many to be broadcast, only packed texts meet them, and of the others few."""
    written, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(toxicity, "checkpoint", lambda df: written.append(df) or df)
    frame = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = frame.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("toxic"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = toxicity._labelled(frame, labels, held(), "doc_id", "text", "toxic", "lang")
        want = {i for i in range(0, 60_000, 3) if zlib.crc32(str(i).encode()) % 3 != 1}
        assert {int(r["id"]) for r in rows.select("id").collect()} == want and rows.count() == len(want)
        join = written[0]._jdf.queryExecution().optimizedPlan()
        while join.nodeName() != "Join":
            join = join.children().apply(0)
        side = join.children().apply(0)
        assert "packed" in side.output().toString() and "text" not in side.output().toString()
        chosen = labels.where(~held()).select(F.col("doc_id").alias("label_id"))
        kept = toxicity._maybe_labelled(frame.select(F.col("doc_id").alias("id"), "text"), chosen, len(want))
        found = {r["id"] for r in kept.select("id").collect()}
        assert want <= found and len(found - want) < 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
