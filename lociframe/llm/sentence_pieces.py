"""Exact merge-type piece encoding and decoding of whole texts.

Merges never cross a boundary in front of a space mark, beside a line feed without a piece, or between two characters
that no piece has side by side, so texts are cut there and each distinct stretch is encoded once per worker. A stretch is encoded by backtracking: all
piece matches come from one Aho-Corasick pass, the longest piece at a position is tried first, a piece is accepted when
re-merging it with its left neighbour gives the same two pieces, and an integer bitfield keeps the positions
from which no encoding was found.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Entries a worker keeps before it starts anew; results do not depend on it.
CACHE_STRETCHES = 1_000_000
CACHE_PAIRS = 1_000_000
# Longest stretch that is remembered.
CACHE_CHARS = 64
LATIN = "[A-Za-zÀ-ɏ]"


@dataclass(frozen=True)
class Vocabulary:
    """What a worker needs of a model file; as large as the file."""
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # N normal, B byte, C control, U unknown

    @staticmethod
    def read(path: str) -> Vocabulary:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = "".join("U" if model.is_unknown(i) else "C" if model.is_control(i) else "B" if model.is_byte(i) else "N" for i in ids)
        return Vocabulary(tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), kinds)


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        self.text = vocabulary.pieces
        self.id = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == "N"}
        self.score = {p: vocabulary.scores[i] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == "B"}
        self.unknown = vocabulary.kinds.index("U")
        controls = [i for i, k in enumerate(vocabulary.kinds) if k == "C"]
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in controls[:2])
        self.bytes_of = [b"" if k == "C" else bytes([int(p[3:5], 16)]) if k == "B" else " ⁇ ".encode() if k == "U"
                         else p.replace(MARK, " ").encode() for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # No piece has one of these after a Latin letter, so no merge crosses that boundary either.
        after_letter = {y for p in self.id for x, y in zip(p, p[1:], strict=False) if re.match(LATIN, x)}
        safe = "".join(re.escape(chr(c)) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in after_letter)
        cut = MARK if "\n" in self.id else MARK + "\n"
        self.stretches = re.compile(f"{MARK}*{LATIN}+(?=[{cut}{safe}]|\\Z)|{MARK}*[^{cut}]+|{MARK}+|\n").findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Best-scored merge first, leftmost among equals, until none is left; a heap keeps long texts in n log n."""
        n, score = len(text), self.score
        parts: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[text[k:k + 2]], k, 2) for k in range(n - 1) if text[k:k + 2] in score]
        heapify(heap)
        while heap:
            _, k, size = heappop(heap)
            to = after[k]
            if not parts[k] or to >= n or len(parts[k]) + len(parts[to]) != size:
                continue
            parts[k] += parts[to]
            parts[to] = ""
            after[k] = to = after[to]
            if to < n:
                before[to] = k
            for left, right in ((before[k], k), (k, to)):
                if left >= 0 and right < n and (joined := parts[left] + parts[right]) in score:
                    heappush(heap, (-score[joined], left, len(joined)))
        return [p for p in parts if p]

    def fits(self, left: int, right: int) -> bool:
        """Do the two pieces come out of merging their own text? A left of -1 asks for the right piece alone."""
        known = self.pairs.get((left, right))
        if known is None:
            want = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
            known = self.merged("".join(want)) == want
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Piece ids of characters that all have a piece."""
        longest: list[list[tuple[int, int]]] = [[] for _ in text]
        for last, match in self.automaton.iter(text):
            longest[last - match[1] + 1].append(match)
        ids: list[int] = []
        resume: list[int] = []  # matches left to try at each accepted position
        failed, at, n, left = 0, 0, len(text), -1
        fits, pairs = self.fits, self.pairs
        k = len(longest[0]) - 1
        while at < n:
            options = longest[at]
            while k >= 0:
                piece, size = options[k]
                if not failed >> (at + size) & 1:
                    fit = pairs.get((left, piece))
                    if fit is None:
                        fit = fits(left, piece)
                    if fit:
                        break
                k -= 1
            if k >= 0:
                ids.append(piece)
                resume.append(k - 1)
                left, at = piece, at + size
                k = len(longest[at]) - 1 if at < n else -1
            else:
                failed |= 1 << at
                if not ids:
                    return [self.id[p] for p in self.merged(text)]
                at -= len(self.text[ids.pop()])
                k = resume.pop()
                left = ids[-1] if ids else -1
        return ids

    def plain(self, part: str) -> list[int]:
        if part in self.id:
            return [self.id[part]]
        return [self.byte[b] for b in part.encode()] if self.byte else [self.unknown]

    def stretch(self, text: str) -> bytes:
        """Ids of one stretch; characters without a piece become their bytes."""
        ids: list[int] = []
        if text.startswith(MARK * 2):
            # Runs of marks have equal scores: which ones meet depends on the whole run, not on neighbours, so it is merged directly.
            for part in self.merged(text):
                ids += self.plain(part)
            return array("I", ids).tobytes()
        at, known = 0, self.id
        while at < len(text):
            to = at
            while to < len(text) and text[to] in known:
                to += 1
            if to > at:
                ids += self.backtrack(text[at:to])
            if to < len(text):
                ids += self.plain(text[to])
            at = to + 1
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return self.begin + self.end
        known, out = self.known, [self.begin]
        for s in self.stretches(MARK + text.replace(" ", MARK)):
            ids = known.get(s)
            if ids is None:
                ids = self.stretch(s)
                if len(s) <= CACHE_CHARS:
                    if len(known) >= CACHE_STRETCHES:
                        known.clear()
                    known[s] = ids
            out.append(ids)
        out.append(self.end)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        joined = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").removeprefix(" ")


_coders: dict[int, Coder] = {}


def _coder(vocabulary: Vocabulary) -> Coder:
    """One coder per worker process and vocabulary; its memory of stretches outlives a task."""
    key = hash(vocabulary)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, ``ids`` (little-endian unsigned 32-bit, begin and end included) and ``decoded``.

    A NULL text is an empty one; an empty text has only the begin and end ids. Any id, repeated or NULL, passes
    through; other columns are dropped. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())],
                                                 names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", "decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
