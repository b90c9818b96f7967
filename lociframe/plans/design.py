"""Transcript design queries: order lines are exon, CDS and stop-codon blocks of order transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as op
from ..operators.intervals import merge_blocks
from ..scale import task_count
from . import bindings as b


def _features(spark, folder):
    lines, orders = b.table(spark, folder, "lineitem"), b.table(spark, folder, "orders")
    tags = (F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("basic"), F.lit("MANE_Select")))
            .when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("Ensembl_canonical")))
            .when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("cds_end_NF"))).otherwise(F.array(F.lit("basic"))))
    start = (F.col("l_linenumber") * 40).cast("bigint")
    stop = start + F.col("l_quantity").cast("bigint")
    block = lambda name, end: F.struct(F.lit(name).alias("feature"), start.alias("start"), end.alias("end"))
    is_cds = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    # One pass over the lines: each gives an exon and, by its flags, a CDS or a stop codon.
    rows = F.array_compact(F.array(block("exon", stop), F.when(is_cds, block("CDS", stop)),
                                   F.when(F.col("l_returnflag") == "R", block("stop_codon", start + 2))))
    # The join, the blocks and the summaries of a transcript are sorted in one task, so a task gets a bounded number of lines (counted from the file footers).
    n = task_count(spark, lines.count())
    lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("gene_id"), F.col("l_orderkey").alias("transcript_id"),
        F.when(F.col("o_orderstatus") == "F", "+").otherwise("-").alias("strand"), tags.alias("tags"), F.inline(rows))


def merge_exon_blocks(spark, folder):
    exons = _features(spark, folder).where("feature = 'exon'")
    return merge_blocks(exons, ["transcript_id"])


def transcript_pick(spark, folder):
    return op.choose_transcript(op.transcript_summary(_features(spark, folder)))


def utr3_length(spark, folder):
    features = _features(spark, folder)
    return op.utr3_lengths(features, op.transcript_summary(features))


def transcript_design(spark, folder):
    genes = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("gene_id"))
    return op.transcript_design(_features(spark, folder), genes)


QUERIES = {"merge_exon_blocks": merge_exon_blocks, "transcript_pick": transcript_pick, "utr3_length": utr3_length,
           "transcript_design": transcript_design}

FEATURES = """base AS (SELECT o_custkey AS gene_id, l_orderkey AS transcript_id, l_linenumber * 40::BIGINT AS s,
      l_linenumber * 40 + l_quantity::BIGINT AS e, o_orderstatus = 'F' AS plus, o_orderpriority AS pr, l_returnflag AS f, l_linestatus AS st
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  flagged AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY transcript_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
      THEN 1 ELSE 0 END AS opens FROM base),
  numbered AS (SELECT *, sum(opens) OVER (PARTITION BY transcript_id ORDER BY s, e) AS block FROM flagged),
  blocks AS (SELECT gene_id, transcript_id, block, min(s) AS s, max(e) AS e FROM numbered GROUP BY ALL),
  tx AS (SELECT gene_id, transcript_id, any_value(plus) AS plus, any_value(pr) AS pr, bool_or(f = 'N' AND st = 'O') AS has_cds,
      bool_or(f = 'R') AS has_stop, min(s) FILTER ((f = 'N' AND st = 'O') OR f = 'R') AS cs,
      max(CASE WHEN f = 'N' AND st = 'O' THEN e WHEN f = 'R' THEN s + 2 END) AS ce FROM base GROUP BY ALL),
  utr AS (SELECT gene_id, transcript_id, sum(greatest(0, CASE WHEN plus THEN e - greatest(s, ce + 1) + 1 ELSE least(e, cs - 1) - s + 1 END))::BIGINT AS utr3_bp
      FROM blocks JOIN tx USING (gene_id, transcript_id) WHERE has_stop AND pr <> '5-LOW' GROUP BY ALL),
  lvl AS (SELECT gene_id, transcript_id, CASE pr WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS lvl FROM tx WHERE has_cds),
  top AS (SELECT gene_id, min(lvl) AS lvl FROM lvl GROUP BY 1),
  one AS (SELECT gene_id, any_value(lvl) AS lvl, count(*) AS n, min(transcript_id) AS tid FROM lvl JOIN top USING (gene_id, lvl) GROUP BY 1),
  pick AS (SELECT g.gene_id, CASE WHEN lvl = 1 THEN 'MANE_Select' WHEN lvl = 2 THEN 'Ensembl_canonical' WHEN n = 1 THEN 'only_coding_transcript'
      ELSE 'unresolved' END AS transcript_choice, CASE WHEN n = 1 THEN tid END AS transcript_id
      FROM (SELECT DISTINCT gene_id FROM tx) g LEFT JOIN one USING (gene_id))"""

ORACLES = {
    "merge_exon_blocks": f'WITH {FEATURES} SELECT transcript_id, s AS start, e AS "end" FROM blocks',
    "transcript_pick": f"WITH {FEATURES} SELECT * FROM pick",
    "utr3_length": f"WITH {FEATURES} SELECT * FROM utr",
    "transcript_design": f"""WITH {FEATURES} SELECT c_custkey AS gene_id, transcript_id, coalesce(transcript_choice, 'unresolved') AS transcript_choice,
        utr3_bp, CASE WHEN transcript_id IS NULL THEN 'ambiguous_or_missing_transcript' WHEN utr3_bp IS NULL THEN 'incomplete_coding_annotation'
          ELSE 'ok' END AS utr3_status FROM customer LEFT JOIN pick ON gene_id = c_custkey LEFT JOIN utr USING (gene_id, transcript_id)""",
}
