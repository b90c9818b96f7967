"""Toxicity scores from a convolutional text classifier trained in numpy.

A word (letters and digits, A-Z lower-cased) is embedded by hashes of the whole word and of its first bytes (``PREFIXES``), each into a table of its
own, so two words share all of their embedding only if they share every bucket, and words of one stem share some of it. Filters over ``WIDTHS`` neighbouring words are pooled by their maximum over the whole
text, and a logistic layer reads the pooled values. Every labelled row is used: a quarter, by a hash of the id, only calibrates probabilities and
chooses one threshold for each language, the others train. Training rows are dealt into parts of about ``PART_ROWS``. The networks start on one part; where
there are more, every part then goes on from the same networks by itself and what the parts changed is averaged, ``ROUNDS`` times. Scores read the text alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow_text
from ..scale import checkpoint
from .quality import calibrate

PART_ROWS = 8192  # labelled rows that one task trains on, about
# Bits of the map that tells which texts may have a label: at least and at most so many, BITS_PER_ROW for each labelled row between them.
LEAST_BITS, MOST_BITS, BITS_PER_ROW = 1 << 23, 1 << 27, 16
ROUNDS = 2  # passes over all parts after the start
SLICES = 64  # of the numbers of a network, for averaging
# Margins and scores are counted by steps of this size, so that no list of rows reaches the driver or one task.
MARGIN_STEP, SCORE_STEP = 1e-3, 1e-5
MOST_MARGIN = 100.0
MEMBERS = 3  # networks whose margins are averaged
WHOLE = 2  # independent hashes of the whole word
PREFIXES = (4, 6)  # bytes
TABLES = WHOLE + len(PREFIXES)
BUCKETS = 1 << 15
SIDE = 6  # numbers of a word in each table
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
EPOCHS = 6
RATE = 0.1
# A document is called toxic from this probability on, whatever its language.
TOXIC_FROM = 0.7
# A language needs so many rows of either label in the calibration part for a threshold of its own.
LEAST_OF_LANGUAGE = 8
STEP = 1 << 15  # words at a time
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BLOCKS = [(w, p) for w in range(len(WIDTHS)) for p in range(WIDTHS[w])]
_REACH = max(WIDTHS) - 1
_ROWS = 128


@dataclass
class Network:
    tables: np.ndarray  # (TABLES, BUCKETS + 1, SIDE); the last row is the empty word
    filters: np.ndarray  # (blocks, FILTERS, TABLES * SIDE), a block for each place of each width
    offset: np.ndarray  # (widths, FILTERS)
    top: np.ndarray  # (widths, FILTERS)
    bias: float

    @staticmethod
    def start(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        tables = rng.normal(0, 0.03, (TABLES, BUCKETS + 1, SIDE)).astype(np.float32)
        tables[:, BUCKETS] = 0
        size = (len(_BLOCKS), FILTERS, TABLES * SIDE)
        return Network(tables, rng.normal(0, 0.4, size).astype(np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32),
                       rng.normal(0, 0.5, (len(WIDTHS), FILTERS)).astype(np.float32), 0.0)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.tables.ravel(), self.filters.ravel(), self.offset.ravel(), self.top.ravel(), np.float32([self.bias])])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        net = Network.start()
        at = 0
        for part in (net.tables, net.filters, net.offset, net.top):
            part[...] = flat[at:at + part.size].reshape(part.shape)
            at += part.size
        net.bias = float(flat[at])
        return net

    def embedded(self, buckets: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[k][buckets[k]] for k in range(TABLES)], 1)

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """(widths, filters, places) of words followed by ``_REACH`` empty or further ones."""
        n = len(x) - _REACH
        # Products of this size stay in the calling thread; larger ones would start threads beside those of other tasks.
        x = np.concatenate([x, np.zeros((-len(x) % _ROWS, x.shape[1]), np.float32)])
        y = (x.reshape(-1, _ROWS, x.shape[1]) @ self.filters.reshape(-1, x.shape[1]).T).reshape(len(x), -1).T
        out = np.zeros((len(WIDTHS), FILTERS, n), np.float32)
        for block, (w, p) in enumerate(_BLOCKS):
            out[w] += y[block * FILTERS:(block + 1) * FILTERS, p:p + n]
        return out

    def pooled(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(documents, widths, filters): the largest value of each filter. Texts of any length go through in steps."""
        n_docs = len(first) - 1
        start = first[:-1] + _REACH * np.arange(n_docs)
        end = start + np.diff(first)
        padded = np.full((TABLES, buckets.shape[1] + _REACH * (n_docs + 1)), BUCKETS, np.int32)
        padded[:, np.arange(buckets.shape[1]) + _REACH * np.repeat(np.arange(n_docs), np.diff(first))] = buckets
        out = np.full((n_docs, len(WIDTHS), FILTERS), -np.inf, np.float32)
        for at in range(0, int(end[-1]) if n_docs else 0, STEP):
            values = self.convolved(self.embedded(padded[:, at:at + STEP + _REACH]))
            docs = np.arange(np.searchsorted(end, at, "right"), np.searchsorted(start, at + values.shape[2]))
            docs = docs[end[docs] > start[docs]]
            if len(docs):
                bounds = np.stack([np.maximum(start[docs] - at, 0), np.minimum(end[docs] - at, values.shape[2])], 1).ravel()
                values = np.concatenate([values, np.full((*values.shape[:2], 1), -np.inf, np.float32)], 2)
                most = np.maximum.reduceat(values, bounds, axis=2)[:, :, ::2]
                out[docs] = np.maximum(out[docs], most.transpose(2, 0, 1))
        out[end == start] = 0
        return out

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return (np.maximum(pooled + self.offset, 0) * self.top).sum((1, 2), dtype=np.float64) + self.bias


@dataclass
class Classifier:
    """Networks trained from different starts, the calibration of their mean margin and the thresholds."""
    members: list[Network]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = TOXIC_FROM  # for languages without one
    thresholds: dict[str, float] = field(default_factory=dict)

    def margins(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.mean([net.margins(net.pooled(buckets, first)) for net in self.members], 0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word in each table, bounds of the rows)."""
    data = arrow_text.LOWER[data]
    found = arrow_text.words(data, offsets, APART)
    hashes = arrow_text.span_hashes(data, found.start, found.end)
    sides = [hashes >> np.uint64(21 * k) for k in range(WHOLE)]
    sides += [arrow_text.span_hashes(data, found.start, np.minimum(found.end, found.start + size)) for size in PREFIXES]
    return np.stack([(side & np.uint64(BUCKETS - 1)).astype(np.int32) for side in sides]), found.first


class _Adagrad:
    def __init__(self, *shapes):
        self.squares = [np.full(s, 1e-6, np.float32) for s in shapes]

    def step(self, k: int, value: np.ndarray, slope: np.ndarray) -> None:
        self.squares[k] += slope * slope
        value -= RATE * slope / np.sqrt(self.squares[k] + 1e-2)


def train(texts: list[np.ndarray], toxic: np.ndarray, epochs: Iterable[int] = range(EPOCHS), seed: int = 0, net: Network | None = None,
          share: float | None = None) -> Network:
    """Fits the network on word buckets of texts; of a text only the pooled windows carry a gradient.

    It goes on from ``net`` where one is given. ``share`` is the share of toxic rows, of these texts by default.
    """
    net = Network.start(seed) if net is None else net
    share = toxic.mean() if share is None else share
    fit = _Adagrad(net.filters.shape, net.offset.shape, net.top.shape, net.tables.shape)
    bias_square, weight = 1e-6, np.where(toxic > 0, min((1 - share) / max(share, 1e-9), 4.0), 1.0)
    gaps = np.full((TABLES, _REACH), BUCKETS, np.int32)
    for epoch in epochs:
        for i in np.random.default_rng([seed, epoch]).permutation(len(texts)):
            if not texts[i].shape[1]:
                continue
            buckets = np.concatenate([texts[i], gaps], 1)
            x = net.embedded(buckets)
            values = net.convolved(x)
            best = values.argmax(2)
            pooled = np.take_along_axis(values, best[:, :, None], 2)[:, :, 0]
            hidden = np.maximum(pooled + net.offset, 0)
            margin = float((hidden * net.top).sum()) + net.bias
            slip = float(weight[i]) * (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - float(toxic[i]))
            if abs(slip) < 1e-3:
                continue
            down = slip * net.top * (hidden > 0)
            grown = np.zeros_like(net.filters)
            rows, slopes = [], []
            for block, (w, p) in enumerate(_BLOCKS):
                grown[block] = down[w][:, None] * x[best[w] + p]
                rows.append(best[w] + p)
                slopes.append(down[w][:, None] * net.filters[block])
            rows, slopes = np.concatenate(rows), np.concatenate(slopes)
            for k in range(TABLES):
                at, which = np.unique(buckets[k][rows], return_inverse=True)
                slope = np.zeros((len(at), SIDE), np.float32)
                np.add.at(slope, which, slopes[:, k * SIDE:(k + 1) * SIDE])
                slope[at == BUCKETS] = 0
                fit.squares[3][k, at] += slope * slope
                net.tables[k, at] -= RATE * slope / np.sqrt(fit.squares[3][k, at] + 1e-2)
            fit.step(0, net.filters, grown)
            fit.step(1, net.offset, down)
            fit.step(2, net.top, slip * hidden)
            bias_square += slip * slip
            net.bias -= RATE * slip / np.sqrt(bias_square + 1e-2)
    return net


def best_threshold(scores: np.ndarray, toxic: np.ndarray, rows: np.ndarray | None = None, low: np.ndarray | None = None) -> float:
    """The threshold of the best F1; of equal ones the highest. Between two scores it lies in the middle.

    An entry stands for one row, or for ``rows`` rows of scores from ``low`` to ``scores``, of which ``toxic`` are toxic.
    """
    rows, low = np.ones(len(scores)) if rows is None else rows, scores if low is None else low
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + toxic.sum())
    whole = np.append(scores[order][1:] < scores[order][:-1], True)  # equal scores stay together
    k = int(np.argmax(np.where(whole, f1, -1)))
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((low[order[k]] + below) / 2)


def _maybe_labelled(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The rows whose id falls on a set bit of a map of the ``n`` chosen ids: all labelled ones and few others, told apart by the join that follows."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * n).bit_length()))

    def hashed(c: str) -> Column:
        return F.pmod(F.xxhash64(c, F.lit("bit")), F.lit(size))

    # At most ``MOST_BITS`` / 8 bytes, whatever the number of ids.
    bits = (chosen.groupBy(F.bitmap_bucket_number(hashed("label_id")).alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(hashed("label_id"))).alias("_bits")))
    place = F.bitmap_bit_position(hashed("id"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(hashed("id"))).join(F.broadcast(bits), "_bucket")
    return marked.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_bits")


def _labelled(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, lang_col: str | None) -> DataFrame:
    """(id, toxic, lang, part, tuning, packed text) of every labelled row that is not held out, written once, one part in each partition.

    Texts without a label do not travel, the others are packed before they meet their labels.
    """
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~F.coalesce(held_out, F.lit(False)))
              .groupBy(F.col(id_col).alias("label_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).alias("toxic")))
    n = chosen.count()
    n_parts = max(1, -(-n // PART_ROWS))
    text_id = F.col("id").cast("string")
    dealt = F.pmod(F.xxhash64(text_id, F.lit("part")), F.lit(n_parts)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped = zstandard.ZstdCompressor()
        for batch in batches:
            for part, data, offsets in arrow_text.pieces(batch, "text"):
                held = [zipped.compress(data[offsets[i]:offsets[i + 1]].tobytes()) for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([part["id"], part["lang"], pa.array(held, pa.binary())], names=["id", "lang", "packed"])

    kind = docs.schema[id_col].dataType
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang")).where("id IS NOT NULL")
    if kind == labels.schema[id_col].dataType:  # ids of two types may be equal with unequal hashes
        rows = _maybe_labelled(rows, chosen, n)
    rows = rows.mapInArrow(pack, f"id {kind.simpleString()}, lang string, packed binary").join(chosen, F.col("id") == F.col("label_id"))
    rows = rows.select(text_id.alias("id"), "toxic", "lang", dealt.alias("part"), (F.pmod(F.xxhash64(text_id, F.lit("tuning")), F.lit(4)) == 0).alias("tuning"), "packed")
    return checkpoint(rows.repartitionById(n_parts, F.col("part")))


def _words(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return word_buckets(data, np.array([0, len(data)]))[0]


def _averaged(rows: DataFrame, start: list[Network] | None, epochs: range, share: float) -> list[Network]:
    """The members after ``epochs`` over each partition's rows. A number is averaged over the partitions that changed it.

    Without ``start`` a partition trains the one member that its rows name, from its own start. The networks, not rows, reach the driver.
    """
    size = len(Network.start().flat())
    shared = rows.sparkSession.sparkContext.broadcast(None if start is None else [net.flat() for net in start])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in batch.to_pylist()]
        if not found:
            return
        found.sort(key=lambda r: (r["id"], r["packed"]))
        texts = [_words(r["packed"]) for r in found]
        toxic = np.array([float(r["toxic"]) for r in found])
        members = range(MEMBERS) if shared.value is not None else sorted({r["member"] for r in found})
        for member in members:
            own = list(range(len(found))) if shared.value is not None else [i for i, r in enumerate(found) if r["member"] == member]
            before = np.zeros(size, np.float32) if shared.value is None else shared.value[member]
            net = train([texts[i] for i in own], toxic[own], epochs, member, None if shared.value is None else Network.of(before), share)
            change = np.array_split(net.flat() - before, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([member] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array([c[c != 0].tobytes() for c in change], pa.binary()),
                 pa.array([np.packbits(c != 0).tobytes() for c in change], pa.binary())], names=["member", "slice", "change", "moved"])

    def mean(table: pa.Table) -> pa.Table:
        member, piece = table["member"][0].as_py(), table["slice"][0].as_py()
        length = len(np.array_split(np.empty(size, np.int8), SLICES)[piece])
        total, times = np.zeros(length), np.zeros(length)
        for change, moved in sorted(zip(table["change"].to_pylist(), table["moved"].to_pylist(), strict=True)):  # sums do not depend on the order of tasks
            at = np.unpackbits(np.frombuffer(moved, np.uint8), count=length).astype(bool)
            total[at] += np.frombuffer(change, np.float32)
            times += at
        return pa.table({"member": pa.array([member], pa.int32()), "slice": pa.array([piece], pa.int32()),
                         "change": pa.array([(total / np.maximum(times, 1)).astype("<f4").tobytes()], pa.binary())})

    changes = rows.mapInArrow(run, "member int, slice int, change binary, moved binary")
    done = changes.groupBy("member", "slice").applyInArrow(mean, "member int, slice int, change binary").collect()
    out = []
    for member in range(MEMBERS):
        change = np.concatenate([np.frombuffer(r["change"], "<f4") for r in sorted((r for r in done if r["member"] == member), key=lambda r: r["slice"])])
        out.append(Network.of(change if start is None else start[member].flat() + change))
    shared.destroy()
    return out


def _margins(rows: DataFrame, net: Classifier) -> DataFrame:
    """(lang, toxic, margin) of every row, written once."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(w) for w in batch["packed"].to_pylist()]
            found = [float(shared.value.margins(w, np.array([0, w.shape[1]]))[0]) for w in words]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["toxic"], pa.array(found, pa.float64())], names=["lang", "toxic", "margin"])

    return checkpoint(rows.select("lang", "toxic", "packed").mapInArrow(run, "lang string, toxic boolean, margin double"))


def _set_thresholds(margins: DataFrame, net: Classifier) -> None:
    """Calibration and thresholds from counts of all margins, by label, language and step."""
    toxic = F.col("toxic").cast("double")
    step = F.floor(F.least(F.greatest("margin", F.lit(-MOST_MARGIN)), F.lit(MOST_MARGIN)) / MARGIN_STEP)
    steps = margins.groupBy(step.alias("_step"), "toxic").agg(F.avg("margin").alias("margin"), F.count(F.lit(1)).alias("n")).orderBy("_step", "toxic").collect()
    net.slope, net.shift = calibrate(*(np.array([float(r[c]) for r in steps]) for c in ("margin", "toxic", "n")))

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by("_step")
        own = best_threshold(*(table[c].to_numpy() for c in ("high", "n_toxic", "n", "low")))
        return pa.table({"whole": table["whole"][:1], "lang": table["lang"][:1], "threshold": pa.array([own])})

    # Each row counts for its language and for all of them.
    score = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(net.slope) * F.col("margin") + F.lit(net.shift), F.lit(-60.0)), F.lit(60.0))))
    groups = F.array(F.struct(F.lit(True).alias("whole"), F.lit("").alias("lang")), F.struct(F.lit(False).alias("whole"), F.coalesce("lang", F.lit("")).alias("lang")))
    counted = (margins.select(score.alias("score"), toxic.alias("toxic"), F.inline(groups)).groupBy("whole", "lang", F.floor(F.col("score") / SCORE_STEP).alias("_step"))
               .agg(F.max("score").alias("high"), F.min("score").alias("low"), F.sum("toxic").alias("n_toxic"), F.count(F.lit(1)).cast("double").alias("n")))
    for r in counted.groupBy("whole", "lang").applyInArrow(best, "whole boolean, lang string, threshold double").join(
            counted.groupBy("whole", "lang").agg(F.sum("n_toxic").alias("plus"), F.sum(F.col("n") - F.col("n_toxic")).alias("minus")), ["whole", "lang"]).collect():
        if r["whole"] and r["plus"]:
            net.threshold = r["threshold"]
        elif not r["whole"] and min(r["plus"], r["minus"]) >= LEAST_OF_LANGUAGE:
            net.thresholds[r["lang"]] = r["threshold"]


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        lang_col: str | None = "lang") -> Classifier | None:
    """Classifier from all labelled documents that are not held out; None unless both labels occur among the training rows.

    Labels of one id are averaged, NULL ones and NULL ids are left out. Rows stay in their tasks; networks and counts reach the driver.
    """
    rows = _labelled(docs, labels, held_out, id_col, text_col, label_col, lang_col)
    kept = rows.where("NOT tuning")
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("plus"), F.min("part").alias("first"), F.max("part").alias("last")).first()
    if not 0 < seen["plus"] < seen["n"]:
        return None
    share = seen["plus"] / seen["n"]
    alone = kept.where(F.col("part") == seen["first"]).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))))
    members = _averaged(alone.repartitionById(MEMBERS, F.col("member")), None, range(EPOCHS), share)
    for turn in range(ROUNDS if seen["last"] > seen["first"] else 0):
        members = _averaged(kept, members, range(EPOCHS + turn, EPOCHS + turn + 1), share)
    net = Classifier(members)
    _set_thresholds(_margins(rows.where("tuning"), net), net)
    return net


def score(docs: DataFrame, net: Classifier | None, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The id, held_out, score, predicted (score from ``TOXIC_FROM`` on) and, by the calibrated threshold of the row's language, flagged.

    One row for each row, whatever its id; a NULL text is empty, an empty text is scored by the bias. Without a classifier all scores are 0.
    No shuffle; other columns are dropped.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part, data, offsets in arrow_text.pieces(batch, "text"):
                scores = np.zeros(len(part)) if net is None else net.probability(net.margins(*word_buckets(data, offsets)))
                least = np.array([TOXIC_FROM if net is None else net.thresholds.get(lang or "", net.threshold) for lang in part["lang"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["id"], part["held_out"], pa.array(scores), pa.array((scores >= TOXIC_FROM).astype(np.int32)), pa.array(scores >= least)],
                                                 names=["id", "held_out", "score", "predicted", "flagged"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, flagged boolean").withColumnRenamed("id", id_col)
