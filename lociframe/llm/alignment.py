"""Align the tokens of two tokenizers and count, corpus-wide, which ids end at the same byte.

A is a byte-level vocabulary applied to space + text, B a piece model applied to the text (it adds that space itself). Where tokens of both
end at one byte, a group ends and the last tokens of its two sides are linked. Every document is encoded once; ids are written
to the shared folder and all later passes align them again from byte lengths.

1. The distinct linked id pairs meet in ``PARTS`` parts by hash, and each part builds a minimal perfect hash: bit arrays, level by level,
   of the places that one key alone falls on; the rank of a key's bit is its slot.
2. The hash is broadcast, at most ``MOST_PAIRS`` pairs at a time (18 bytes each). Tasks add links to dense count vectors by slot, whose keys
   are verified, and the vectors are summed in a tree: first in lanes, then for each block.
3. Counts are broadcast with the hash; a second pass aligns each document again and looks its links up.

More pairs than ``MOST_PAIRS`` take more passes over parts of the pairs, with equal results. Distinct pairs are bounded by the product of the
two vocabularies, whatever the corpus.

A document has no tokens (zeros, empty digest) when its text is NULL or empty or when the bytes of its B pieces are not space + text, as with
U+2581 inside. Rows pass through whatever their id; repeated rows count each. An empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import checkpoint, shared_folder
from . import arrow_text

PARTS = 256
MOST_PAIRS = 4_000_000
BLOCK = 1 << 16  # counts of a vector that travel together
LANES = 16
GAMMA = 2.0
# Distinct pairs a task gathers before it passes them on.
HELD_PAIRS = 2_000_000
# Fixed value: what splits text before byte-level merges; the vocabulary file names this rule "ByteLevel" without spelling it out.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_SPACE = re.compile(r"\s{5000}").search
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabularies:
    """What workers need of both tokenizers; as large as the two files."""
    tokens: tuple[bytes, ...]  # A, by id
    file: str
    model: bytes
    pieces: tuple[bytes, ...]  # B, by id

    @staticmethod
    def read(byte_path: str, piece_path: str) -> Vocabularies:
        import sentencepiece
        with open(byte_path, encoding="utf-8") as file:
            source = file.read()
        held = json.loads(source)
        # Printable characters stand for themselves, the other bytes for the characters from U+0100 on, in order.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        tokens = [b""] * (1 + max(held["model"]["vocab"].values()))
        for token, i in held["model"]["vocab"].items():
            tokens[i] = bytes(byte_of[c] for c in token)
        with open(piece_path, "rb") as file:
            model = file.read()
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [(i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())]
        return Vocabularies(tuple(tokens), source, model, tuple(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in names))

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(t) for t in self.tokens]), np.array([len(p) for p in self.pieces])


class Encoder:
    def __init__(self, held: Vocabularies):
        import sentencepiece
        import tiktoken
        # Ids of a byte-level vocabulary are in the order of its merges.
        ranks = {t: i for i, t in enumerate(held.tokens) if t}
        self.bytes = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=held.model)
        self.held = held
        self.slow = None
        kinds = len(held.tokens)
        # A id: "id," inside a group, "id|" at its end; B id: "id," and "id;".
        self.texts = [f"{i}{mark}" for i in range(kinds) for mark in ",|"] + [f"{i}{mark}" for i in range(len(held.pieces)) for mark in ",;"]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for each text; nothing for a text without tokens."""
        a, b = [], []
        for text, ids in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            if not text or b"".join(map(self.held.pieces.__getitem__, ids)) != whole:
                a.append([])
                b.append([])
                continue
            a.append(self.bytes_of(" " + text))
            b.append(ids)
        return a, b

    def bytes_of(self, text: str) -> list[int]:
        # The faster library's splitter runs out of stack inside very long runs of white space; the other one reads the same file.
        if not LONG_SPACE(text):
            return self.bytes.encode_ordinary(text)
        if self.slow is None:
            import tokenizers
            self.slow = tokenizers.Tokenizer.from_str(self.held.file)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[int, Encoder] = {}


def _encoder(held: Vocabularies) -> Encoder:
    """One encoder per worker process and pair of vocabularies."""
    key = hash(held.model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(held)
    return _encoders[key]


@dataclass
class Aligned:
    """Tokens of a slice of documents side by side; ``a_at[i]:a_at[i + 1]`` are those of document i."""
    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_ends: np.ndarray  # does a group end here?
    b_ends: np.ndarray

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> Aligned:
        # Both sides of a document have equal bytes, so running totals over the slice stay level.
        upto_a, upto_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
        here = np.zeros(int(upto_a[-1]) + 1 if len(upto_a) else 1, np.uint8)
        here[upto_a] = 1
        here[upto_b] |= 2
        return Aligned(a, b, a_at, b_at, here[upto_a] == 3, here[upto_b] == 3)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, B ids, bounds of the documents) of the linked tokens."""
        return self.a[self.a_ends], self.b[self.b_ends], np.concatenate([[0], np.cumsum(self.a_ends)])[self.a_at]

    def written(self, texts: list[str]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        group_a, group_b = np.cumsum(self.a_ends) - self.a_ends, np.cumsum(self.b_ends) - self.b_ends
        before_b, upto_a = np.append(0, np.flatnonzero(self.b_ends) + 1), np.append(0, np.flatnonzero(self.a_ends) + 1)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + before_b[group_a]] = self.a * 2 + self.a_ends
        order[np.arange(len(self.b)) + upto_a[group_b + 1]] = (len(texts) - 2 * self.n_pieces) + self.b * 2 + self.b_ends
        at = (self.a_at + self.b_at).tolist()
        return ["".join(map(texts.__getitem__, order[at[i]:at[i + 1]].tolist()))[:-1] for i in range(len(at) - 1)]

    n_pieces: int = 0


def _packed(ids: np.ndarray) -> bytes:
    """Low bytes, then high bytes, which compress apart."""
    return ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, row bounds)."""
    parts = [np.frombuffer(x, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel() for x in column.to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, "<u2")).astype(np.int64), at


def _aligned_rows(batches: Iterator[pa.RecordBatch], sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    for batch in batches:
        for k in range(0, len(batch), 512):
            part = batch.slice(k, 512)
            (a, a_at), (b, b_at) = _unpacked(part["a"]), _unpacked(part["b"])
            yield part, Aligned.of(a, b, a_at, b_at, sizes)


def encode_documents(docs: DataFrame, held: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document, written to the shared folder: row (unique), id, n_a, n_b, n_groups, groups_sha256 and the packed ids a and b.

    Ids take 16 bits; larger vocabularies are refused.
    """
    if max(len(held.tokens), len(held.pieces)) > 1 << 16:
        raise ValueError("token ids take 16 bits")
    spark = docs.sparkSession
    shared, sizes = spark.sparkContext.broadcast(held), held.sizes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared.value)
        for batch in batches:
            for part, _, _ in arrow_text.pieces(batch, "text"):
                a, b = coder.encode([t or "" for t in part["text"].to_pylist()])
                at = [np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in (a, b)]
                flat = [np.array(list(chain.from_iterable(side)), np.int64) for side in (a, b)]
                found = Aligned.of(*flat, *at, sizes)
                found.n_pieces = len(shared.value.pieces)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.written(coder.texts)]
                _, _, bounds = found.links()
                yield pa.RecordBatch.from_arrays(
                    [part["row"], part["id"], *[pa.array(np.diff(x)) for x in (*at, bounds)], pa.array(digests, pa.string()),
                     *[pa.array([_packed(ids[x[i]:x[i + 1]]) for i in range(len(part))], pa.binary()) for ids, x in zip(flat, at, strict=True)]],
                    names=["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    target = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    rows.mapInArrow(run, f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a binary, b binary").write.option(
        "compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def _part_of(keys: np.ndarray) -> np.ndarray:
    return (arrow_text.mix(keys * _GOLD) >> np.uint64(56)).astype(np.int64) * PARTS >> 8


def _place(keys: np.ndarray, level: int) -> np.ndarray:
    return arrow_text.mix(keys + np.uint64((level + 1) * int(_GOLD) % (1 << 64)))


def build_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bits of each level, keys in slot order) for distinct keys: a level keeps the places that one key alone falls on."""
    levels, order = [], []
    while len(keys):
        room = max(64, int(GAMMA * len(keys)) + 63 & ~63)
        at = (_place(keys, len(levels)) % np.uint64(room)).astype(np.int64)
        alone = np.bincount(at, minlength=room) == 1
        levels.append(alone)
        settled = alone[at]
        order.append(keys[settled][np.argsort(at[settled])])
        keys = keys[~settled]
    return levels, np.concatenate(order) if order else np.zeros(0, np.uint64)


@dataclass
class PairHash:
    """Minimal perfect hash of the pairs in some parts. Slots follow the ranks of the set bits, part after part, level after level."""
    words: np.ndarray
    ranks: np.ndarray  # set bits in front of each word
    base: np.ndarray  # first bit of (part, level)
    room: np.ndarray  # bits of (part, level), 0 where there is none
    keys: np.ndarray
    counts: np.ndarray | None = None

    @staticmethod
    def of(rows: list) -> PairHash:
        """``rows``: (part, bits in each level, packed bits, keys in slot order)."""
        rows = sorted(rows, key=lambda r: r["part"])
        depth = max((len(r["rooms"]) for r in rows), default=0)
        base, room = np.zeros((PARTS, depth + 1), np.int64), np.zeros((PARTS, depth + 1), np.int64)
        at = 0
        for r in rows:
            for level, size in enumerate(r["rooms"]):
                base[r["part"], level], room[r["part"], level] = at, size
                at += size
        words = np.frombuffer(b"".join(r["bits"] for r in rows), "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.uint32)
        return PairHash(words, ranks, base, room, np.frombuffer(b"".join(r["keys"] for r in rows), "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the stored key is another one."""
        out, live, level, part = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, _part_of(keys)
        while len(live) and level < self.room.shape[1]:
            room = self.room[part[live], level]
            live, room = live[room > 0], room[room > 0]
            bit = self.base[part[live], level] + (_place(keys[live], level) % room.astype(np.uint64)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[live[hit]] = self.ranks[bit[hit] >> 6] + np.bitwise_count(below).astype(np.int64)
            live, level = live[~hit], level + 1
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def _pairs(a: np.ndarray, b: np.ndarray, n_pieces: int) -> np.ndarray:
    return a.astype(np.uint64) * np.uint64(n_pieces) + b.astype(np.uint64)


def pair_hashes(encoded: DataFrame, held: Vocabularies) -> DataFrame:
    """One row for each part with pairs: part, n, rooms, bits and keys of its minimal perfect hash. Written to the checkpoint folder."""
    sizes, n_pieces = held.sizes(), len(held.pieces)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys: np.ndarray) -> pa.RecordBatch:
            part = _part_of(keys)
            order = np.argsort(part, kind="stable")
            there, first = np.unique(part[order], return_index=True)
            cut = np.split(keys[order], first[1:])
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([c.tobytes() for c in cut], pa.binary())], names=["part", "keys"])

        seen, fresh, size = np.zeros(0, np.uint64), [], 0
        for _, found in _aligned_rows(batches, sizes):
            fresh.append(np.unique(_pairs(*found.links()[:2], n_pieces)))
            size += len(fresh[-1])
            if size > max(len(seen), HELD_PAIRS // 8):
                seen, fresh, size = np.unique(np.concatenate([seen, *fresh])), [], 0
                if len(seen) > HELD_PAIRS:
                    yield rows(seen)
                    seen = seen[:0]
        seen = np.unique(np.concatenate([seen, *fresh]))
        if len(seen):
            yield rows(seen)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part: int, keys: np.ndarray) -> pa.RecordBatch:
            levels, order = build_hash(keys)
            bits = b"".join(np.packbits(x, bitorder="little").tobytes() for x in levels)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(order)]), pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
                                               pa.array([bits], pa.binary()), pa.array([order.astype("<u8").tobytes()], pa.binary())],
                                              names=["part", "n", "rooms", "bits", "keys"])

        now, seen, fresh, size = None, np.zeros(0, np.uint64), [], 0
        for batch in batches:
            for part, keys in zip(batch["part"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield row(now, np.unique(np.concatenate([seen, *fresh])))
                    now, seen, fresh, size = part, np.zeros(0, np.uint64), [], 0
                fresh.append(np.frombuffer(keys, np.uint64))
                size += len(fresh[-1])
                if size > max(len(seen), 1 << 16):
                    seen, fresh, size = np.unique(np.concatenate([seen, *fresh])), [], 0
        if now is not None:
            yield row(now, np.unique(np.concatenate([seen, *fresh])))

    gathered = encoded.select("a", "b").mapInArrow(gather, "part int, keys binary")
    return checkpoint(gathered.repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(
        build, "part int, n bigint, rooms array<bigint>, bits binary, keys binary"))


def _summed(vectors: DataFrame, *keys: str) -> DataFrame:
    """Adds the packed count vectors of equal keys, one running total in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for i in range(len(batch)):
                key = tuple(batch[k][i].as_py() for k in keys)
                if key != now:
                    if now is not None:
                        yield row(now, total)
                    now, total = key, 0
                total = total + np.frombuffer(zstandard.decompress(batch["counts"][i].as_py()), "<i8")
        if now is not None:
            yield row(now, total)

    def row(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())],
                                          names=[*keys, "counts"])

    return vectors.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", counts binary")


def count_links(encoded: DataFrame, held: Vocabularies, pairs: PairHash) -> np.ndarray:
    """How many links of the corpus each slot holds."""
    shared, sizes, n_pieces = encoded.sparkSession.sparkContext.broadcast(pairs), held.sizes(), len(held.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value.keys), np.int64)
        for _, found in _aligned_rows(batches, sizes):
            keys, times = np.unique(_pairs(*found.links()[:2], n_pieces), return_counts=True)
            slots = shared.value.slots(keys)
            counts[slots[slots >= 0]] += times[slots >= 0]
        lane = TaskContext.get().partitionId() % LANES
        for block in range(0, len(counts), BLOCK):
            if (part := counts[block:block + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK], pa.int32()), pa.array([lane], pa.int32()),
                                                  pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], names=["block", "lane", "counts"])

    lanes = _summed(encoded.select("a", "b").mapInArrow(run, "block int, lane int, counts binary"), "block", "lane")
    out = np.zeros(len(pairs.keys), np.int64)
    # At most MOST_PAIRS counts reach the driver, 8 bytes each.
    for r in _summed(lanes.select("block", "counts"), "block").collect():
        part = np.frombuffer(zstandard.decompress(bytes(r["counts"])), "<i8")
        out[r["block"] * BLOCK:r["block"] * BLOCK + len(part)] = part
    return out


def _slices(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Parts in runs of at most ``most`` pairs; a part alone may be larger."""
    out: list[list[int]] = []
    room = 0
    for part in sorted(sizes):
        if not out or sizes[part] > room:
            out.append([])
            room = most
        out[-1].append(part)
        room -= sizes[part]
    return out


def counted_pairs(encoded: DataFrame, held: Vocabularies, most_pairs: int = MOST_PAIRS) -> list[PairHash]:
    """The hashes of all pairs with their counts, each of at most ``most_pairs`` pairs (one part at least)."""
    built = pair_hashes(encoded, held)
    out = []
    for parts in _slices({r["part"]: r["n"] for r in built.select("part", "n").collect()}, most_pairs):
        pairs = PairHash.of(built.where(F.col("part").isin(parts)).collect())
        pairs.counts = count_links(encoded, held, pairs)
        out.append(pairs)
    return out


def look_up(encoded: DataFrame, held: Vocabularies, tables: list[PairHash]) -> DataFrame:
    """Adds n_links, n_best and count_sum to the rows of ``encode_documents``."""
    context, sizes, n_pieces = encoded.sparkSession.sparkContext, held.sizes(), len(held.pieces)
    highest = np.zeros(n_pieces, np.int64)
    for pairs in tables:
        np.maximum.at(highest, (pairs.keys % np.uint64(n_pieces)).astype(np.int64), pairs.counts)
    kept = ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def with_counts(pairs: PairHash) -> DataFrame:
        shared = context.broadcast((pairs, highest))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, highest = shared.value
            for part, found in _aligned_rows(batches, sizes):
                a, b, bounds = found.links()
                slots = pairs.slots(_pairs(a, b, n_pieces))
                count = np.where(slots >= 0, pairs.counts[slots], 0) if len(pairs.counts) else np.zeros(len(slots), np.int64)
                totals = [np.concatenate([[0], np.cumsum(x)]) for x in ((slots >= 0) & (count == highest[b]), count)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], part["n_groups"], *[pa.array(t[bounds[1:]] - t[bounds[:-1]]) for t in totals]],
                                                 names=[*kept, "n_links", "n_best", "count_sum"])

        kind = encoded.schema["id"].dataType.simpleString()
        return encoded.mapInArrow(run, f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint")

    parts = [with_counts(pairs) for pairs in tables] or [with_counts(PairHash.of([]))]
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.groupBy("row").agg(*[F.first(c).alias(c) for c in (*kept[1:], "n_links")], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def pair_counts(spark, tables: list[PairHash], n_pieces: int) -> DataFrame:
    """Rows (a_id, b_id, links) of the counted pairs."""
    frames = [pa.table({"a_id": t.keys // np.uint64(n_pieces), "b_id": t.keys % np.uint64(n_pieces), "links": t.counts}) for t in tables]
    shape = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64()), ("links", pa.int64())])
    return spark.createDataFrame(pa.concat_tables([f.cast(shape) for f in frames]) if frames else shape.empty_table())


def align_documents(docs: DataFrame, held: Vocabularies, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row for each document: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    encoded = encode_documents(docs, held, id_col, text_col)
    out = look_up(encoded, held, counted_pairs(encoded, held, most_pairs))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
