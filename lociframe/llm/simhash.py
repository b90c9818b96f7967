"""SimHash fingerprints and all links within a bit threshold by anchor points of a covering code.

Two fingerprints within three bits differ by at most one bit in one of their 32-bit halves. The anchors of a half are the
words whose first 31 bits are a word of the [31, 26] Hamming code (the last bit is free): the covering radius is 1. A
fingerprint goes to every anchor within radius plus threshold, 1 + 1 = 2 bits, of either half; the anchor nearest to
one of a linked pair is then within that distance of the other, and members of an anchor are compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import checkpoint
from . import arrow_text
from .components import components

THRESHOLD = 3
SHINGLE = 3
SEED = 42
# Constants of the published XXH64 definition.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                            9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:end] for many spans: spans of one length are hashed together, long ones one by one."""
    out = np.zeros(len(start), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    half = np.ndarray((len(data) + 1,), "<u4", padded.data, strides=(1,))
    size = end - start
    order = np.argsort(np.minimum(size, 32).astype(np.int8), kind="stable")
    bounds = np.searchsorted(np.minimum(size, 32)[order], np.arange(34))
    with np.errstate(over="ignore"):
        for n in range(32):
            which = order[bounds[n]:bounds[n + 1]]
            if not len(which):
                continue
            at = start[which]
            h = np.full(len(at), np.uint64(seed) + P5 + np.uint64(n))
            k = 0
            while k + 8 <= n:
                h ^= _rotl(wide[at + k] * P2, 31) * P1
                h = _rotl(h, 27) * P1 + P4
                k += 8
            if k + 4 <= n:
                h ^= half[at + k].astype(np.uint64) * P1
                h = _rotl(h, 23) * P2 + P3
                k += 4
            for k in range(k, n):
                h ^= data[at + k].astype(np.uint64) * P5
                h = _rotl(h, 11) * P1
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            h ^= h >> np.uint64(32)
            out[which] = h
    whole = memoryview(np.ascontiguousarray(data))
    for i in order[bounds[32]:].tolist():
        out[i] = xxhash.xxh64_intdigest(whole[start[i]:end[i]], seed)
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One fingerprint per row of a slice of UTF-8 texts; zero for a row without words."""
    found = arrow_text.words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(found.start):
        return out
    # Keep the words and one space behind each that does not end its row.
    keep = np.zeros(len(data) + 1, bool)
    keep[:-1] = ~arrow_text.SPACE[data]
    text = np.append(arrow_text.LOWER[data], np.uint8(0x20))
    text[~keep] = 0x20
    keep[found.end] = True
    moved = np.concatenate([[0], np.cumsum(keep)])
    start, end, text = moved[found.start], moved[found.end - 1] + 1, text[keep]
    first, count = found.first[:-1], np.diff(found.first)
    shingles = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    total = np.concatenate([[0], np.cumsum(shingles)])
    left = np.arange(total[-1]) - np.repeat(total[:-1] - first, shingles)
    right = left + np.repeat(np.minimum(count, SHINGLE) - 1, shingles)
    bits = np.unpackbits(xxh64_spans(text, start[left], end[right]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.flatnonzero(count)
    ones = np.add.reduceat(bits, total[rows], axis=0, dtype=np.uint32)
    out[rows] = np.packbits(2 * ones > shingles[rows, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, fp), fp the 64 bits as a signed long. NULL texts are empty; ids pass through, NULL and repeated ones too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow_text.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(fingerprints_of(data, offsets).view(np.int64))],
                                                 names=["id", "row_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row_key bigint, fp bigint")


_position = np.arange(256, dtype=np.uint64)
# Syndrome of each byte of a half: XOR of the positions 1..31 of its set bits; bit 31 is the free one.
_SYNDROME = np.zeros((4, 256), np.uint32)
for _byte in range(4):
    for _bit in range(8):
        if (_at := 8 * _byte + _bit) < 31:
            _SYNDROME[_byte] ^= np.where(_position >> np.uint64(_bit) & np.uint64(1), _at + 1, 0).astype(np.uint32)


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, index of the fingerprint, is it the nearest anchor) of all anchors within two bits, for both halves."""
    keys, index, nearest = [], [], []
    here = np.arange(len(fp))
    for half in (0, 1):
        word = (fp >> np.uint64(32 * half)).astype(np.uint32)
        syndrome = np.zeros(len(fp), np.uint32)
        for k in range(4):
            syndrome ^= _SYNDROME[k][(word >> np.uint32(8 * k)) & np.uint32(255)]
        flip = lambda at: np.where(at > 0, np.uint32(1) << np.where(at > 0, at - np.uint32(1), np.uint32(0)).astype(np.uint32), np.uint32(0)).astype(np.uint32)
        home = word ^ flip(syndrome)
        found = [(home, here, True), (home ^ np.uint32(1 << 31), here, False)]
        for i in range(1, 32):
            other = syndrome ^ np.uint32(i)
            which = np.flatnonzero((syndrome > 0) & (other > i))
            found.append((word[which] ^ np.uint32(1 << (i - 1)) ^ flip(other[which]), which, False))
        for anchor, which, is_home in found:
            keys.append(anchor.astype(np.int64) | np.int64(half << 32))
            index.append(which)
            nearest.append(np.full(len(which), is_home))
    return np.concatenate(keys), np.concatenate(index), np.concatenate(nearest)


# Groups up to this size are compared row against following rows; larger ones by a search that emits a spanning forest.
PLAIN_GROUP = 16


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of pairs within ``bits``: one less than its nodes for each component."""
    rest, a, b = fp, [], []
    stack: list[int] = []
    while len(rest) or stack:
        if not stack:
            stack.append(rest[0])
            rest = rest[1:]
        at = stack.pop()
        near = np.bitwise_count(rest ^ at) <= bits
        hit = rest[near]
        if len(hit):
            a.append(np.full(len(hit), at))
            b.append(hit)
            stack.extend(hit)
            rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_in(key: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal key; rows are sorted by key."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(start, len(key)))
    a, b = [], []
    small = np.repeat(size <= PLAIN_GROUP, size)
    for d in range(1, min(PLAIN_GROUP, int(size.max(initial=1)))):
        ok = (key[d:] == key[:-d]) & small[d:] & (home[d:] | home[:-d])
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
        a.append(fp[at])
        b.append(fp[at + d])
    for s, n in zip(start[size > PLAIN_GROUP].tolist(), size[size > PLAIN_GROUP].tolist(), strict=True):
        x, y = _forest(fp[s:s + n], bits)
        a.append(x)
        b.append(y)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(distinct: DataFrame, bits: int = THRESHOLD) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column fp, enough of them to connect every linked pair.

    Each row meets at most 34 anchors. A group of one anchor is compared in one task, as 8 bytes a member.
    """
    if bits > 3:
        raise ValueError("the anchors of the two halves cover up to three differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, index, home = anchors_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found(rows: pa.Table) -> pa.RecordBatch:
            a, b = links_in(rows["anchor"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy(), bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows["anchor"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield found(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield found(held)

    spread_out = distinct.select("fp").mapInArrow(spread, "anchor bigint, fp bigint, home boolean")
    return (spread_out.repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(compare, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = THRESHOLD) -> DataFrame:
    """One row per document: id, row_key, fp, root (a fingerprint that names the class) and component_id, the smallest id reachable over links.

    Equal fingerprints are one class before any comparison, so thousands of copies cost one row. Documents without words have
    fingerprint zero and are linked like any other. NULL ids keep their row and never become a component_id.
    """
    marked = checkpoint(fingerprints(docs, id_col, text_col))
    classes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(classes, bits))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(best.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return (marked.join(by_class, F.col("fp") == F.col("f"))
            .select(F.col("id").alias(id_col), "row_key", "fp", "root", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = THRESHOLD) -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns; of equal rows one."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("i"), "row_key")).alias("m")
    chosen = near_duplicates(docs, id_col, text_col, bits).groupBy("root").agg(first).select(F.col("m.row_key").alias("__chosen"))
    rows = docs.withColumn("__key", F.xxhash64(id_col, text_col)).join(chosen, F.col("__key") == F.col("__chosen"), "left_semi")
    return rows.dropDuplicates(["__key"]).drop("__key")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
