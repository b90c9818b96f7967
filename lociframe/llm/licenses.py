"""Find license texts in documents, also reworded, cut or filled-in ones.

Winnowed fingerprints of the templates (runs of three words) are an inverted index, bounded by the number of templates.
Every run of three words of a document is looked up; hits that lie near one diagonal of a template make a candidate, and
a banded alignment of the words gives the share of the template that is there and where.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text
from .license_templates import TEMPLATES

RUN = 3
WINDOW = 4
BAND = 6
LEAST_COVERAGE = 0.8
# Templates are held in every worker.
MOST_TEMPLATE_WORDS = 200_000
# Words are runs of ASCII letters, digits and all other non-ASCII bytes.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
OUT = ("license string, coverage double, n_matched bigint, n_template_words bigint, byte_start bigint, byte_end bigint, "
       "spans array<struct<byte_start:bigint,byte_end:bigint>>")


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray  # sorted fingerprints
    template: np.ndarray
    place: np.ndarray


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[arrow_text.Words, np.ndarray]:
    found = arrow_text.words(data, offsets, APART)
    return found, arrow_text.span_hashes(arrow_text.LOWER[data], found.start, found.end)


def winnow(prints: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least fingerprint of every window, the rightmost among equals; all places of a list shorter than two windows."""
    n = len(prints)
    if n < 2 * window:
        return np.arange(n)
    seen = np.lib.stride_tricks.sliding_window_view(prints, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - np.argmin(seen, axis=1))


def build_index(templates: dict[str, str]) -> Index:
    names, words, rows = [], [], []
    for name, text in sorted(templates.items()):
        data = np.frombuffer(text.encode(), np.uint8)
        _, hashes = _word_hashes(data, np.array([0, len(data)]))
        if not len(hashes):
            continue
        prints = arrow_text.sliding(hashes, RUN)
        rows += [(prints[at], len(names), at) for at in winnow(prints)]
        names.append(name)
        words.append(hashes)
    if sum(map(len, words)) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words; scan with a part of them at a time")
    rows.sort()
    return Index(names, words, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Matched (template word, text word) pairs of a best alignment whose diagonals (text minus template place) lie in [low, high].

    A match scores 3, a skipped word of either side -1 inside the match and 0 before and after it on the text's side.
    """
    n, width = len(template), high - low + 1
    moves = np.zeros((n, width), np.int8)
    row = np.zeros(width)
    for i in range(n):
        place = i + low + np.arange(width)
        inside = (place >= 0) & (place < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[place[inside]] == template[i]
        new = np.where(same, row + 3, -np.inf)
        skip = np.append(row[1:], -np.inf) - 1  # the template's word is skipped
        move = np.where(new >= skip, 1, 2)
        new = np.maximum(new, skip)
        # The text's word is skipped: best of the cells to the left, one point a step.
        steps = np.maximum.accumulate(new + np.arange(width)) - np.arange(width)
        move[steps > new] = 3
        moves[i], row = move, steps
    pairs, i, d = [], n - 1, int(np.argmax(row))
    while i >= 0:
        if moves[i, d] == 1:
            pairs.append((i, i + low + d))
            i -= 1
        elif moves[i, d] == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return pairs[::-1]


def _candidates(index: Index, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, template, places in the row, places in the template) of hits that may belong to one copy."""
    prints = arrow_text.sliding(hashes, RUN)
    left = np.searchsorted(index.prints, prints)
    hit = np.flatnonzero(arrow_text.run_starts(first, RUN) & (index.prints[np.minimum(left, len(index.prints) - 1)] == prints)) if len(index.prints) else []
    if not len(hit):
        return
    count = np.searchsorted(index.prints, prints[hit], "right") - left[hit]
    entry = np.repeat(left[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    place = np.repeat(hit, count)
    row = np.searchsorted(first, place, "right") - 1
    template, at = index.template[entry], index.place[entry]
    sizes = np.array([len(w) for w in index.words])
    diagonal = place - first[row] - at
    order = np.lexsort((place, diagonal, template, row))
    row, template, place, at, diagonal = row[order], template[order], place[order] - first[row[order]], at[order], diagonal[order]
    slack = BAND + sizes[template] // 8
    cut = np.flatnonzero((row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])) + 1
    for s, e in zip(np.append(0, cut), np.append(cut, len(row)), strict=True):
        yield int(row[s]), int(template[s]), place[s:e], at[s:e]


def scan_slice(index: Index, data: np.ndarray, offsets: np.ndarray, least: float) -> list[tuple]:
    found, hashes = _word_hashes(data, offsets)
    out = []
    for row, t, place, at in _candidates(index, hashes, found.first):
        words = hashes[found.first[row]:found.first[row + 1]]
        start = found.start[found.first[row]:found.first[row + 1]] - offsets[row]
        end = found.end[found.first[row]:found.first[row + 1]] - offsets[row]
        size = len(index.words[t])
        slack = BAND + size // 8
        order = np.argsort(place, kind="stable")
        place, at = place[order], at[order]
        floor = 0  # words behind the last reported match
        while len(place):
            # Hits near the first one's diagonal and within one template's length of it are aligned together.
            diagonal = place - at
            near = (np.abs(diagonal - diagonal[0]) <= slack) & (place <= place[0] + size + slack)
            pairs = align(index.words[t], words[floor:], int(diagonal[near].min()) - slack - floor, int(diagonal[near].max()) + slack - floor)
            pairs = [(i, w + floor) for i, w in pairs]
            coverage = len(pairs) / size
            left = np.ones(len(place), bool)
            left[0] = False
            if coverage >= least:
                floor = pairs[-1][1] + 1
                left &= place >= floor
                spans: list[list[int]] = []
                for k, (_, w) in enumerate(pairs):
                    if k and w == pairs[k - 1][1] + 1:
                        spans[-1][1] = int(end[w])
                    else:
                        spans.append([int(start[w]), int(end[w])])
                out.append((row, index.names[t], coverage, len(pairs), size, spans[0][0], spans[-1][1],
                            [{"byte_start": x, "byte_end": y} for x, y in spans]))
            else:
                left &= ~near
            place, at = place[left], at[left]
    # One row for each place: of matches of one template that overlap, the fullest and then the first.
    out.sort(key=lambda r: (r[0], r[1], -r[2], r[5], r[6]))
    kept: list[tuple] = []
    for r in out:
        if not any(k[:2] == r[:2] and k[5] < r[6] and r[5] < k[6] for k in reversed(kept[-64:])):
            kept.append(r)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
         least: float = LEAST_COVERAGE) -> DataFrame:
    """One row for each match: the id, license, coverage (share of the template's words), n_matched, byte bounds and matched spans.

    Documents without a match, NULL and empty texts give no row; repeated rows give theirs each. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates))
    span = pa.struct([("byte_start", pa.int64()), ("byte_end", pa.int64())])
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrow_text.pieces(batch, "text"):
                rows = scan_slice(shared.value, data, offsets, least)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0])), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]],
                                                     names=["id", "license", "coverage", "n_matched", "n_template_words", "byte_start", "byte_end", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)
