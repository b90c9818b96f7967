"""Score texts with a bigram model whose counts live in a log-frequency Bloom filter.

Texts are handled in pieces of about 8 MB. A piece sends each bucket of hashes its distinct unigrams and bigrams once, as compressed steps of
rising hashes, with how often they stand in its training texts. The bucket merges the counts of all pieces and answers each piece in its turn. It also fills one slice of the filter: a count is put in as the levels 1..q of its logarithm, so a lookup probes level
after level until one is missing. A slice is as large as its inserts ask for (at most ``MOST_FULL``), so every count is in it
whatever the corpus; slices stay rows by bucket and are never gathered.

P(w | h) = (c(h w) + k P(w)) / (c(h) + k), P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), all c as read from the filter. Of the
candidates in ``PRIORS``, k is the one under which the training documents, each left out of its own counts, are likeliest.
The unigram base score next to it uses the exact counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import checkpoint
from . import arrow_text

BUCKET_BITS = 10
FILTER_BITS = 29  # least size of all slices, 64 MB; a slice with more inserts is larger
PROBES = 3
MOST_FULL = 0.35
PIECE_BYTES = 8 << 20
PRIORS = (1.0, 10.0, 100.0, 1e3, 1e4, 1e6)
STEPS = 2  # levels for each doubling of a count
END = np.uint64(0xA5A5F00DCAFE0001)
BEGIN = np.uint64(0xA5A5F00DCAFE0002)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(count) * STEPS + 1e-9).astype(np.int64)


def _decoded(levels: int = 64 * STEPS) -> np.ndarray:
    """Count for each level: the middle of the whole numbers it stands for; 0 for level 0."""
    out = np.zeros(levels + 1)
    for q in range(1, levels + 1):
        low, high = np.ceil(2 ** ((q - 1) / STEPS) - 1e-9), np.ceil(2 ** (q / STEPS) - 1e-9) - 1
        out[q] = (low + max(high, low)) / 2
    return out


COUNT_OF = _decoded()


def _bits(hashes: np.ndarray, level: np.ndarray | int, slice_bits: int) -> list[np.ndarray]:
    x = arrow_text.mix(hashes + np.asarray(level, np.uint64) * _GOLD)
    mask = np.uint64((1 << slice_bits) - 1)
    if slice_bits > 21:  # three probes no longer fit one hash
        return [(arrow_text.mix(x + np.uint64(k)) & mask).astype(np.int64) for k in range(PROBES)]
    return [((x >> np.uint64(shift)) & mask).astype(np.int64) for shift in (0, 21, 42)[:PROBES]]


@dataclass
class Filter:
    bits: np.ndarray  # uint8, slices one behind the other
    bucket_bits: int
    filter_bits: int

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        slice_bits = self.filter_bits - self.bucket_bits
        base = (hashes >> np.uint64(64 - self.bucket_bits)).astype(np.int64) << slice_bits if self.bucket_bits else np.zeros(len(hashes), np.int64)
        out, live, level = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 1
        while len(live):
            there = np.ones(len(live), bool)
            for bit in _bits(hashes[live], level, slice_bits):
                at = base[live] + bit
                there &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[there]
            out[live] = level
            level += 1
        return np.minimum(out, len(COUNT_OF) - 1)


def room_of(slice_bits: int) -> int:
    """Inserts that make a slice ``MOST_FULL``."""
    return int(-np.log(1 - MOST_FULL) / PROBES * (1 << slice_bits))


def slice_bits_for(unigrams: np.ndarray, bigrams: np.ndarray, least: int) -> int:
    """Size of the slice that holds all levels of these counts."""
    inserts = sum(int(level_of(n).sum()) for n in (unigrams, bigrams))
    while room_of(least) < inserts:
        least += 1
    return least


def fill_slice(unigrams: tuple[np.ndarray, np.ndarray], bigrams: tuple[np.ndarray, np.ndarray], slice_bits: int) -> np.ndarray:
    """Bits of one slice: all unigrams, then bigrams of the highest levels first as long as a whole level fits.

    All levels fit the size that ``slice_bits_for`` gives.
    """
    keys, levels = unigrams[0], level_of(unigrams[1])
    room = room_of(slice_bits) - int(levels.sum())
    if len(bigrams[0]):
        of_bigram = level_of(bigrams[1])
        need = np.bincount(of_bigram, weights=of_bigram)[::-1].cumsum()[::-1]  # inserts when levels from q on are kept
        least = int(np.argmax(need <= room)) if need[-1] <= room else len(need)
        kept = of_bigram >= max(least, 1)
        keys, levels = np.concatenate([keys, bigrams[0][kept]]), np.concatenate([levels, of_bigram[kept]])
    out = np.zeros(1 << slice_bits, bool)
    repeated = np.repeat(keys, levels)
    level = np.arange(len(repeated)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    for bit in _bits(repeated, level, slice_bits):
        out[bit] = True
    return np.packbits(out, bitorder="little")


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end token behind each row, their predecessors, row bounds)."""
    data = arrow_text.LOWER[data]
    found = arrow_text.words(data, offsets)
    n = len(offsets) - 1
    tokens = np.insert(arrow_text.span_hashes(data, found.start, found.end), found.first[1:], END)
    bounds = found.first + np.arange(n + 1)
    before = np.concatenate([[BEGIN], tokens[:-1]])
    before[bounds[:-1]] = BEGIN
    return tokens, before, bounds


def bigram_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return arrow_text.mix(arrow_text.mix(before) + tokens)


def _squeezed(values: np.ndarray, bounds: np.ndarray, rising: bool) -> pa.Array:
    """Compressed byte planes for each stretch; of rising values the steps, whose high bytes are mostly zero."""
    out = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        part = values[first:last]
        if rising:
            part = np.diff(part, prepend=values.dtype.type(0))
        planes = np.ascontiguousarray(part).view(np.uint8).reshape(-1, values.itemsize).T
        out.append(zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1) if last > first else b"")
    return pa.array(out, pa.binary())


def _released(packed: bytes, kind: type, rising: bool) -> np.ndarray:
    if not packed:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(size, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def _merge(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[start], np.add.reduceat(counts, start)


def count_grams(training: DataFrame, bucket_bits: int = BUCKET_BITS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each bucket of hashes with its filter slice. ``training`` has a column text."""
    rows = training.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def merge(rows: pa.Table) -> pa.Table:
        return pa.table({"bucket": rows["bucket"][:1], "bits": [_merged(rows, filter_bits - bucket_bits)[2].tobytes()]})

    return _asked(_pieces_of(rows, "int"), bucket_bits).groupBy("bucket").applyInArrow(merge, "bucket int, bits binary")


def _merged(rows: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct training unigrams, their counts, filter slice) of one bucket."""
    counts = []
    for name in ("uni", "bi"):
        keys, n = (np.concatenate([_released(x, kind, rising) for x in rows[column].to_pylist()])
                   for column, kind, rising in ((name, np.uint64, True), (name + "_n", np.uint32, False)))
        counts.append(_merge(keys[n > 0], n[n > 0].astype(np.int64)))
    return *counts[0], fill_slice(*counts, slice_bits_for(counts[0][1], counts[1][1], least))


def _pieces_of(rows: DataFrame, kind: str) -> DataFrame:
    """One row for each slice of texts: ids and bounds of its rows, its distinct tokens in order, and the number of each token among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrow_text.pieces(batch, "text", PIECE_BYTES):
                tokens, _, bounds = tokens_of(data, offsets)
                kinds, which = np.unique(tokens, return_inverse=True)
                whole = pa.array([0, len(part)], pa.int32())
                values = [pa.ListArray.from_arrays(whole, part["id"]), pa.ListArray.from_arrays(whole, part["held_out"]),
                          pa.ListArray.from_arrays(whole, pa.array(np.diff(bounds)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), *values, pa.array([kinds.tobytes()], pa.binary()),
                     pa.array([_packed(which, len(kinds))], pa.binary())],
                    names=["piece", "ids", "held_out", "n_tokens", "kinds", "which"])

    return rows.mapInArrow(run, f"piece string, ids array<{kind}>, held_out array<boolean>, n_tokens array<bigint>, kinds binary, which binary")


def _packed(which: np.ndarray, n_kinds: int) -> bytes:
    """Numbers as ranks by frequency, bytes of one weight together, so that they compress."""
    rank = np.empty(n_kinds, np.uint32)
    rank[np.argsort(-np.bincount(which, minlength=n_kinds), kind="stable")] = np.arange(n_kinds, dtype=np.uint32)
    planes = rank[which].view(np.uint8).reshape(-1, 4).T
    order = np.argsort(rank).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes() + np.ascontiguousarray(order).tobytes())


def _unpacked(packed: bytes, n_kinds: int) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    numbers = lambda part: np.ascontiguousarray(part.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
    return numbers(data[len(data) - 4 * n_kinds:])[numbers(data[:len(data) - 4 * n_kinds])]


def _grams(kinds: bytes, which: bytes, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, number of each token, is it the first of its row, distinct bigrams, number of each bigram) of a piece."""
    kinds = np.frombuffer(kinds, np.uint64)
    which = _unpacked(which, len(kinds))
    opens = np.zeros(len(which), bool)
    opens[np.cumsum(n_tokens) - n_tokens] = True
    tokens = kinds[which]
    before = np.where(opens, BEGIN, np.append(BEGIN, tokens[:-1]))
    pairs, which_pair = np.unique(bigram_hashes(before, tokens), return_inverse=True)
    return kinds, which, opens, pairs, which_pair


def _asked(pieces: DataFrame, bucket_bits: int) -> DataFrame:
    """Rows (piece, bucket) with the distinct unigrams and bigrams of a piece in that bucket and their counts in its training texts."""
    buckets = 1 << bucket_bits
    edges = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bucket_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n_tokens = batch["n_tokens"][i].values.to_numpy()
                kinds, which, _, pairs, which_pair = _grams(batch["kinds"][i].as_py(), batch["which"][i].as_py(), n_tokens)
                trains = np.repeat(~batch["held_out"][i].values.to_numpy(zero_copy_only=False), n_tokens)
                columns = []
                for keys, numbers in ((kinds, which), (pairs, which_pair)):
                    bounds = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                    columns += [_squeezed(keys, bounds, True), _squeezed(np.bincount(numbers[trains], minlength=len(keys)).astype(np.uint32), bounds, False)]
                rows = pa.RecordBatch.from_arrays([pa.repeat(batch["piece"][i], buckets), pa.array(np.arange(buckets, dtype=np.int32)), *columns],
                                                  names=["piece", "bucket", "uni", "uni_n", "bi", "bi_n"])
                yield rows.filter(pc.greater(pc.add(pc.binary_length(rows["uni"]), pc.binary_length(rows["bi"])), 0))

    return pieces.select("piece", "held_out", "n_tokens", "kinds", "which").mapInArrow(
        run, "piece string, bucket int, uni binary, uni_n binary, bi binary, bi_n binary")


def _answer(asked: pa.Table, least: int) -> pa.Table:
    """Filter levels of what pieces ask one bucket and exact counts of the unigrams; totals of the bucket stand in its first row."""
    keys, n, bits = _merged(asked, least)
    held = Filter(bits, 0, (len(bits) * 8).bit_length() - 1)
    uni, bi = ([_released(x, np.uint64, True) for x in asked[name].to_pylist()] for name in ("uni", "bi"))
    hashes = np.concatenate(uni)
    exact = np.zeros(len(hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        exact = np.where(keys[at] == hashes, n[at], 0)
    uni_bounds, bi_bounds = (np.cumsum([0, *map(len, parts)]) for parts in (uni, bi))
    first = np.arange(len(asked)) == 0
    return pa.table([asked["piece"], asked["bucket"], _squeezed(exact, uni_bounds, False), _squeezed(held.levels(hashes).astype(np.uint8), uni_bounds, False),
                     _squeezed(held.levels(np.concatenate(bi)).astype(np.uint8), bi_bounds, False), pa.array(first * int(n.sum())), pa.array(first * len(keys))],
                    names=["piece", "bucket", "exact", "uni", "bi", "n_tokens", "n_types"])


@dataclass
class Totals:
    n_tokens: int
    n_types: int

    def log_unigram(self, count: np.ndarray, less: int = 0) -> np.ndarray:
        return np.log10((count + 0.5) / (self.n_tokens - less + 0.5 * (self.n_types + 1)))

    def score_piece(self, piece: pa.Table, answers: pa.Table) -> dict:
        """Columns of the rows of one piece. Distinct grams are in the order of their hashes, so buckets in order give their answers."""
        n_tokens = piece["n_tokens"][0].values.to_numpy()
        starts = np.cumsum(n_tokens) - n_tokens
        kinds, which, opens, _, which_pair = _grams(piece["kinds"][0].as_py(), piece["which"][0].as_py(), n_tokens)
        answers = answers.sort_by("bucket")
        exact, uni, bi = (np.concatenate([_released(x, kind, False) for x in answers[name].to_pylist()])
                          for name, kind in (("exact", np.int64), ("uni", np.uint8), ("bi", np.uint8)))
        count = COUNT_OF[uni]
        begins = count[np.searchsorted(kinds, END)]  # as many texts begin as end
        c_word = count[which]
        c_before = np.where(opens, begins, np.append(0, c_word[:-1]))
        c_pair = np.minimum(COUNT_OF[bi][which_pair], np.minimum(c_before, c_word))
        p, p_out = 10.0 ** self.log_unigram(c_word), 10.0 ** self.log_unigram(np.maximum(c_word - 1, 0), 1 if self.n_tokens else 0)
        scores, left_out = [], []
        for k in PRIORS:
            scores.append(np.add.reduceat(np.log10((c_pair + k * p) / (c_before + k)), starts))
            left_out.append(np.add.reduceat(np.log10((np.maximum(c_pair - 1, 0) + k * p_out) / (np.maximum(c_before - 1, 0) + k)), starts))
        listed = lambda values: pa.FixedSizeListArray.from_arrays(pa.array(np.stack(values, 1).ravel()), len(PRIORS)).cast(pa.list_(pa.float64()))
        return {"n_tokens": pa.array(n_tokens), "n_known": pa.array(np.add.reduceat((exact > 0)[which].astype(np.int64), starts)),
                "base": pa.array(np.add.reduceat(self.log_unigram(exact)[which], starts)), "scores": listed(scores), "left_out": listed(left_out)}


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", bucket_bits: int = BUCKET_BITS,
          filter_bits: int = FILTER_BITS) -> DataFrame:
    """Train on the rows for which the Column ``held_out`` is not true and score all rows.

    Columns: the id, held_out, n_tokens, n_known, train_tokens, base_score and score. A NULL text is empty and has its end token
    only; a NULL ``held_out`` trains. Without training rows every probability of the base is one. ``filter_bits`` is the least size of
    the filter; it grows with its inserts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = checkpoint(_pieces_of(rows, kind))
    answers = checkpoint(_asked(pieces, bucket_bits).groupBy("bucket").applyInArrow(
        lambda asked: _answer(asked, filter_bits - bucket_bits), "piece string, bucket int, exact binary, uni binary, bi binary, n_tokens bigint, n_types bigint"))
    sums = answers.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_types").alias("n_types")).first()
    totals = Totals(sums["n_tokens"] or 0, sums["n_types"] or 0)
    answers = answers.drop("n_tokens", "n_types")

    def run(piece: pa.Table, found: pa.Table) -> pa.Table:
        columns = totals.score_piece(piece, found)
        return pa.table([piece["ids"][0].values, piece["held_out"][0].values, *columns.values()], names=["id", "held_out", *columns])

    scored = checkpoint(pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(
        run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, scores array<double>, left_out array<double>"))
    likely = scored.where("not held_out").agg(*[F.sum(F.get("left_out", F.lit(i))) for i in range(len(PRIORS))]).first()
    best = max(range(len(PRIORS)), key=lambda i: (likely[i] is not None, likely[i] or 0.0))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(totals.n_tokens).cast("bigint").alias("train_tokens"),
                         F.col("base").alias("base_score"), F.get("scores", F.lit(best)).alias("score"))
