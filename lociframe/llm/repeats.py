"""Byte passages that repeat across documents, from enhanced suffix arrays over anchored contexts.

Every window of ``LEAST`` bytes has one anchor: its 16-byte gram of least hash, so equal windows have equal anchors wherever
they stand. A first pass finds which anchors occur in several documents and keeps them in a Bloom filter of fixed
size (a false hit costs time only). A second pass sends the context of such anchors - the windows that chose it, about 67 bytes -
to the task of the anchor's hash bucket. There the suffixes that begin a window which stands there twice are sorted, common prefixes of neighbours are
measured, and a stack scan builds the interval tree of common prefixes: an interval whose members follow different bytes is a
maximal repeat inside its context, with all its occurrences. A repeat longer than a context shows up at each of its anchors; the
merged spans are the whole passage.

Equal contexts of one task travel once, with 20 bytes for each place they stand at. A bucket grows with the texts; its task works on one
part at a time, anchors with the same next bits of their hash, so its arrays do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text

LEAST = 50
GRAM = 16
GRAMS = LEAST - GRAM + 1  # in a window
BUCKET_BITS = 10
FILTER_BITS = 29  # 64 MB
# Text a task reads between two rounds of output; memory is a small multiple of it.
FLUSH_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
# Longer texts are read in stretches that overlap by LEAST - 1 bytes.
STRETCH = 32 << 20
# Bits of the hash after the bucket's that cut it into parts, and windows that parts worked on at once have together.
FINE_BITS = 8
PART_WINDOWS = 250_000
_PLACE = np.uint64(27)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
UNORDERED = np.iinfo(np.int64).max  # a NULL id is larger than all others


class Runs:
    """Runs of windows with one anchor: bounds of window starts and the hash of the anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data) - LEAST + 1
        self.start = self.stop = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n <= 0:
            return
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        wide = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
        m = len(data) - GRAM + 1
        h = arrow_text.mix(wide[:m] * _C1 + (wide[8:8 + m] ^ (wide[8:8 + m] >> np.uint64(29))) * _C2)
        key = (h >> _PLACE << _PLACE) | np.arange(m, dtype=np.uint64)
        # Sliding minimum by doubling.
        size = 1
        while 2 * size <= GRAMS:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        rest = GRAMS - size
        key = np.minimum(key[:n], key[rest:rest + n])
        anchor = (key & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        valid = np.ones(n, bool)
        for edge in offsets[1:-1].tolist():
            valid[max(edge - LEAST + 1, 0):edge] = False
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]))
        start = np.flatnonzero(new)
        stop = np.append(start[1:], n)
        ok = valid[start]
        self.start, self.stop = start[ok], stop[ok]
        # Anchors have small hashes by choice; mixed again they spread evenly over buckets and filter slices.
        self.hash = arrow_text.mix(h[anchor[self.start]])


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row offsets, ids, row keys, place of the first byte in its text) of bounded slices."""
    for rows, data, offsets in arrow_text.pieces(batch, "text", SLICE_BYTES):
        ids = pc.fill_null(rows["id"].cast(pa.int64()), int(UNORDERED)).to_numpy()
        keys = rows["row_key"].to_numpy()
        if len(data) <= STRETCH:
            yield data, offsets, ids, keys, np.zeros(len(ids), np.int64)
            continue
        for at in range(0, len(data), STRETCH):  # a single long text
            part = data[at:at + STRETCH + LEAST - 1]
            yield part, np.array([0, len(part)]), ids, keys, np.array([at])


def _cut(buckets: np.ndarray, bucket_bits: int) -> np.ndarray:
    return np.searchsorted(buckets, np.arange((1 << bucket_bits) + 1))


def _probes(hashes: np.ndarray, slice_bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << slice_bits) - 1)
    return [((hashes >> np.uint64(shift)) & mask).astype(np.int64) for shift in (0, 22)]


def shared_anchors(rows: DataFrame, bucket_bits: int, filter_bits: int) -> np.ndarray:
    """Bloom filter (one slice for each bucket) of the anchors that stand in more than one text."""
    slice_bits = filter_bits - bucket_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h)
            h, key = h[order], key[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
            several = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start) if len(h) else np.zeros(0, bool)
            h = h[start]
            columns = []
            for part in (h[~several], h[several]):
                bounds = _cut((part >> np.uint64(64 - bucket_bits)).astype(np.int64), bucket_bits)
                low = np.ascontiguousarray(part.view(np.uint8).reshape(-1, 8)[:, :6])  # the low 48 bits are enough for a filter
                columns.append(pa.Array.from_buffers(pa.binary(), 1 << bucket_bits, [None, pa.py_buffer((bounds * 6).astype(np.int32)), pa.py_buffer(low)]))
            out = pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bucket_bits, dtype=np.int32)), *columns], names=["bucket", "one", "several"])
            return out.filter(pc.greater(pc.add(pc.binary_length(out["one"]), pc.binary_length(out["several"])), 0))

        total = 0
        for batch in batches:
            for data, offsets, _, keys, _ in _stretches(batch):
                runs = Runs(data, offsets)
                held.append((runs.hash, keys[np.searchsorted(offsets, runs.start, "right") - 1]))
                total += len(data)
                if total >= FLUSH_BYTES:
                    yield flush()
                    total = 0
        if total:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        def low(name: str) -> np.ndarray:
            raw = np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(-1, 6)
            return np.pad(raw, ((0, 0), (0, 2))).view("<u8")[:, 0]
        several = low("several")
        every = np.sort(np.concatenate([low("one"), several]))
        again = np.concatenate([every[1:][every[1:] == every[:-1]], several])
        bits = np.zeros(1 << slice_bits, bool)
        for at in _probes(again, slice_bits):
            bits[at] = True
        return pa.table({"bucket": table["bucket"][:1].cast(pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    counted = rows.mapInArrow(count, "bucket int, one binary, several binary").groupBy("bucket").applyInArrow(merge, "bucket int, bits binary")
    out = np.zeros((1 << filter_bits) // 8, np.uint8)
    size = (1 << slice_bits) // 8
    for r in counted.toLocalIterator():
        out[r["bucket"] * size:(r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def contexts(rows: DataFrame, bits: np.ndarray, bucket_bits: int, filter_bits: int) -> DataFrame:
    """Contexts of shared anchors by bucket: distinct ones of a task once, each with the places it stands at."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    slice_bits = filter_bits - bucket_bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        filtered = shared.value

        def flush() -> pa.RecordBatch:
            texts, lengths, hashes, marks, before, ids, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            starts = np.cumsum(lengths) - lengths
            fine = (hashes >> np.uint64(64 - bucket_bits - FINE_BITS)).astype(np.int64)
            bucket = fine >> FINE_BITS
            order = np.lexsort((marks, fine))
            new = np.append(True, (marks[order][1:] != marks[order][:-1]) | (fine[order][1:] != fine[order][:-1])) if len(order) else np.zeros(0, bool)
            first = order[np.flatnonzero(new)]
            group = np.cumsum(new) - 1
            n_places = np.bincount(group, minlength=len(first)) if len(first) else np.zeros(0, int)
            # The byte before a context, or 256 where it differs or there is none.
            low = np.minimum.reduceat(before[order], np.flatnonzero(new)) if len(first) else before
            high = np.maximum.reduceat(before[order], np.flatnonzero(new)) if len(first) else before
            kept_before = np.where(low == high, low, 256).astype("<i2")
            fine = (fine[first] & ((1 << FINE_BITS) - 1)).astype(np.uint8)
            by_piece, by_place = _cut(bucket[first], bucket_bits), _cut(bucket[order], bucket_bits)
            pack = zstandard.ZstdCompressor(level=3).compress
            out = []
            for b in np.flatnonzero(by_piece[1:] > by_piece[:-1]).tolist():
                p, q = by_piece[b], by_piece[b + 1]
                s, e = by_place[b], by_place[b + 1]
                o = order[s:e]
                text = b"".join(texts[starts[i]:starts[i] + lengths[i]].tobytes() for i in first[p:q].tolist())
                out.append({"bucket": b, "text": pack(text), "fine": pack(fine[p:q].tobytes()), "lengths": lengths[first[p:q]].astype("<i4").tobytes(),
                            "before": kept_before[p:q].tobytes(), "n_places": n_places[p:q].astype("<i4").tobytes(),
                            "ids": pack(ids[o].tobytes()), "keys": keys[o].tobytes(), "places": pack(places[o].astype("<i4").tobytes())})
            return pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in
                                              ("text", "fine", "lengths", "before", "n_places", "ids", "keys", "places")]]))

        total = 0
        for batch in batches:
            for data, offsets, ids, keys, begun in _stretches(batch):
                total += len(data)
                runs = Runs(data, offsets)
                base = (runs.hash >> np.uint64(64 - bucket_bits)).astype(np.int64) << slice_bits
                hit = np.ones(len(base), bool)
                for bit in _probes(runs.hash & np.uint64((1 << 48) - 1), slice_bits):
                    at = base + bit
                    hit &= (filtered[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                start, stop, h = runs.start[hit], runs.stop[hit] + LEAST - 1, runs.hash[hit]
                if len(start):
                    row = np.searchsorted(offsets, start, "right") - 1
                    length = stop - start
                    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
                    before = np.where(start > offsets[row], data[np.maximum(start - 1, 0)], 256).astype(np.int64)
                    held.append((data[at], length, h, arrow_text.span_hashes(data, start, stop), before, ids[row], keys[row], start - offsets[row] + begun[row]))
                if total >= FLUSH_BYTES and held:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return rows.mapInArrow(send, "bucket int, text binary, fine binary, lengths binary, before binary, n_places binary, ids binary, keys binary, places binary")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def parts(table: pa.Table) -> Iterator[Bucket]:
    """The contexts of a bucket, those with one anchor together, at most PART_WINDOWS windows at once (more where one part of the hash has them)."""
    def column(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table[name].to_pylist()), kind)
    unpack = zstandard.ZstdDecompressor().decompress
    unpacked = lambda name, kind: np.frombuffer(b"".join(map(unpack, table[name].to_pylist())), kind)
    text, fine, length = unpacked("text", np.uint8), unpacked("fine", np.uint8), column("lengths", "<i4").astype(np.int64)
    before, n_places = column("before", "<i2"), column("n_places", "<i4").astype(np.int64)
    ids, keys, places = unpacked("ids", "<i8"), column("keys", "<i8"), unpacked("places", "<i4")
    begin, first = np.cumsum(length) - length, np.cumsum(n_places) - n_places
    order = np.argsort(fine, kind="stable")
    windows = np.bincount(fine, weights=length - LEAST + 1, minlength=1 << FINE_BITS)
    sizes = np.bincount(fine, minlength=1 << FINE_BITS)
    ends, held = [], 0
    for at, n in zip(np.cumsum(np.bincount(fine, minlength=1 << FINE_BITS)).tolist(), windows.tolist(), strict=True):
        if ends and held + n <= PART_WINDOWS:
            ends[-1], held = at, held + n
        else:
            ends, held = [*ends, at], n
    for some in np.split(order, ends[:-1]):
        if len(some):
            stands = _ranges(first[some], n_places[some])
            yield Bucket(text[_ranges(begin[some], length[some])], length[some], before[some], n_places[some], ids[stands], keys[stands], places[stands])


class Bucket:
    """Distinct contexts of whole anchors, the suffix array of their windows and its interval tree."""

    def __init__(self, text: np.ndarray, length: np.ndarray, before: np.ndarray, n_places: np.ndarray, ids: np.ndarray, keys: np.ndarray, places: np.ndarray):
        self.text, self.length, self.before = text, length, before
        self.begin = np.cumsum(self.length) - self.length
        self.ids, self.keys, self.places = ids, keys, places.astype(np.int64)
        self.context_of = np.repeat(np.arange(len(self.length)), n_places)
        self.least_id = np.minimum.reduceat(self.ids, np.cumsum(n_places) - n_places)
        self.n_places = n_places
        # Suffixes that begin a window. Only those whose window stands twice in the bucket can share an interval; the others
        # are repeats only where their whole context is, and need no place in the array.
        windows = self.length - LEAST + 1
        self.first = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(windows)), windows)
        at = self.begin[owner] + np.arange(windows.sum()) - self.first[owner]
        self.least = self.least_id[owner].copy()
        prints = arrow_text.span_hashes(self.text, at, at + LEAST)
        ranked = np.argsort(prints)
        same = prints[ranked][1:] == prints[ranked][:-1]
        twice = np.zeros(len(at), bool)
        twice[ranked[1:][same]] = True
        twice[ranked[:-1][same]] = True
        self.suffix = np.flatnonzero(twice)
        self.owner, self.at = owner[twice], at[twice]
        self.size = self.begin[self.owner] + self.length[self.owner] - self.at
        self._sort()
        self._scan()

    def _sort(self) -> None:
        """Suffix array by 8-byte words, and the common prefix of each suffix with the one before it."""
        padded = np.concatenate([self.text, np.zeros(96, np.uint8)])
        wide = np.ndarray((len(self.text) + 88,), ">u8", padded.data, strides=(1,))
        words = []
        for k in range(0, LEAST + GRAMS, 8):
            word = wide[self.at + k].astype(np.uint64)
            left = np.clip(self.size - k, 0, 8)  # bytes of the word inside the context
            word &= np.where(left == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)))
            words.append(word)
        self.order = np.lexsort((self.size, *words[::-1]))
        common = np.zeros(len(self.order), np.int64)
        same = np.ones(len(self.order), bool)
        same[:1] = False
        for word in words:
            word = word[self.order]
            bits = np.append(np.uint64(0), word[1:] ^ word[:-1])[:len(word)]
            equal = bits == 0
            for shift in (1, 2, 4, 8, 16, 32):
                bits |= bits >> np.uint64(shift)
            common += np.where(same, (64 - np.bitwise_count(bits).astype(np.int64)) // 8, 0)
            same &= equal
        size = self.size[self.order]
        self.common = np.minimum(common, np.minimum(size, np.append(0, size[:-1])[:len(size)]))

    def _scan(self) -> None:
        """Stack scan of the common prefixes of at least LEAST bytes.

        ``groups``: (length, low, high) of every interval, ranks low..high of the suffix array, inner ones first. ``least``: for each
        window the smallest id of a document it begins in, from the outermost interval around it.
        """
        common = np.where(self.common >= LEAST, self.common, 0)
        change = np.flatnonzero(np.append(common, 0) != np.append(0, common))
        groups: list[tuple[int, int, int]] = []
        lengths, lows = [0], [0]
        outer: list[tuple[int, int]] = []
        for rank, depth in zip(change.tolist(), np.append(common, 0)[change].tolist(), strict=True):
            low = rank - 1
            while lengths[-1] > depth:
                length, low = lengths.pop(), lows.pop()
                groups.append((length, low, rank - 1))
                if lengths[-1] == 0 and depth == 0:
                    outer.append((low, rank))
            if lengths[-1] < depth:
                lengths.append(depth)
                lows.append(low)
        self.groups = groups
        if outer:
            least = self.least_id[self.owner[self.order]]
            bounds = np.array(outer)
            smallest = np.minimum.reduceat(np.append(least, least[-1]), bounds.ravel())[::2]
            inside = np.repeat(bounds[:, 0] - np.concatenate([[0], np.cumsum(bounds[:, 1] - bounds[:, 0])[:-1]]), bounds[:, 1] - bounds[:, 0])
            inside = inside + np.arange(len(inside))
            self.least[self.suffix[self.order[inside]]] = np.repeat(smallest, bounds[:, 1] - bounds[:, 0])

    def diverse(self) -> list[tuple[int, int, int]]:
        """The groups whose members follow different bytes, or begin a text somewhere."""
        if not self.groups:
            return []
        owner, at = self.owner[self.order], self.at[self.order]
        follows = np.where(at > self.begin[owner], self.text[np.maximum(at - 1, 0)], self.before[owner])
        changes = np.concatenate([[0, 0], np.cumsum(follows[1:] != follows[:-1])])
        _, low, high = np.array(self.groups).T
        keep = (changes[high + 1] > changes[low + 1]) | (follows[low] == 256)
        return [g for g, k in zip(self.groups, keep.tolist(), strict=True) if k]

    def covered(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row key, first byte, end) of the bytes of each place that an earlier document has too, of bounded runs of places."""
        windows = (self.length - LEAST + 1)[self.context_of]
        upto = np.cumsum(windows)
        low = 0
        while low < len(windows):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] - windows[low] + PART_WINDOWS, "right")))
            place = np.repeat(np.arange(low, high), windows[low:high])
            at = _ranges(np.zeros(high - low, np.int64), windows[low:high])
            hit = self.least[self.first[self.context_of][place] + at] < self.ids[place]
            place, at = place[hit], at[hit]
            low = high
            if len(place):
                new = np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(place)) - 1
                yield self.keys[place[s]], self.places[place[s]] + at[s], self.places[place[s]] + at[e] + LEAST


def covered_spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The covered bytes of a bucket's places, from one part after another."""
    for bucket in parts(table):
        for key, start, end in bucket.covered():
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(start), pa.array(end)], names=["covered_key", "s", "e"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bits: int = BUCKET_BITS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Maximal repeat groups: group_id, length, passage and all occurrences (row_key, id, start byte).

    A group is a byte string of at least LEAST bytes, repeated at two or more places that follow different bytes (or begin a text) and
    go on differently or leave the context. Nested groups list their members each, so use this for reports, not for removal.
    """
    rows = _rows(docs, id_col, text_col)
    sent = contexts(rows, shared_anchors(rows, bucket_bits, filter_bits), bucket_bits, filter_bits)

    def listed(b: Bucket) -> list[dict]:
        first_place = np.cumsum(b.n_places) - b.n_places
        # (length, byte of the text, contexts and the place in them) of intervals, and of whole contexts that stand at several places.
        found = [(length, b.order[low:high + 1].tolist()) for length, low, high in b.diverse()]
        found = [(length, [(int(b.owner[x]), int(b.at[x] - b.begin[b.owner[x]])) for x in members]) for length, members in found]
        alone = np.flatnonzero((b.n_places > 1) & (b.before == 256)).tolist()
        covered = {tuple(sorted(m)) for _, m in found}
        found += [(int(b.length[o]), [(o, 0)]) for o in alone if ((o, 0),) not in covered]
        out = []
        for length, suffixes in found:
            members = []
            for o, shift in suffixes:
                for p in range(first_place[o], first_place[o] + b.n_places[o]):
                    members.append({"row_key": int(b.keys[p]), "id": None if b.ids[p] == UNORDERED else int(b.ids[p]), "start": int(b.places[p] + shift)})
            at = b.begin[suffixes[0][0]] + suffixes[0][1]
            passage = b.text[at:at + length].tobytes()
            out.append({"group_id": hashlib.sha1(passage).hexdigest(), "length": length, "passage": passage, "occurrences": members})
        return out

    def groups(table: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("row_key", pa.int64()), ("id", pa.int64()), ("start", pa.int64())]))
        out = [group for bucket in parts(table) for group in listed(bucket)]
        return pa.Table.from_pylist(out, pa.schema([("group_id", pa.string()), ("length", pa.int64()), ("passage", pa.binary()), ("occurrences", kind)]))

    return sent.groupBy("bucket").applyInArrow(
        groups, "group_id string, length bigint, passage binary, occurrences array<struct<row_key:bigint,id:bigint,start:bigint>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bits: int = BUCKET_BITS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of ``docs``: the id, n_bytes, n_removed, n_spans and kept (the bytes left).

    A byte goes when it lies in LEAST equal bytes that also begin in a document with a smaller id. A NULL text is empty; a NULL id is larger
    than all others; rows of one id never remove each other's bytes.
    """
    rows = _rows(docs, id_col, text_col)
    sent = contexts(rows, shared_anchors(rows, bucket_bits, filter_bits), bucket_bits, filter_bits)

    def cover(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(covered_spans(table), pa.schema([("covered_key", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]))

    covered = (sent.groupBy("bucket").applyInArrow(cover, "covered_key bigint, s bigint, e bigint")
               .groupBy("covered_key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
            out = []
            for text, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
                data, end, removed, n_spans, kept = text.as_py(), 0, 0, 0, []
                for span in spans or ():
                    if span["s"] > end or not n_spans:
                        kept.append(data[end:span["s"]])
                        n_spans += 1
                        end = span["e"]
                        removed += end - span["s"]
                    elif span["e"] > end:
                        removed += span["e"] - end
                        end = span["e"]
                kept.append(data[end:])
                out.append((len(data), removed, n_spans, b"".join(kept)))
            n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(covered, F.col("row_key") == F.col("covered_key"), "left").select("id", "text", "spans")
    return joined.mapInArrow(cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
