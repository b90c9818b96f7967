"""Token counts under a unigram piece model, by dynamic programming over a trie of pre-tokens.

A pre-token is a space mark and a word. Its best segmentation has the highest sum of piece scores, then the fewest pieces.
Distinct pre-tokens go into a trie; the best forward score of a prefix is computed once, at its node, whatever number
of pre-tokens share it, and the piece count of a whole pre-token is kept where it ends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentence_pieces import MARK, Vocabulary

UNIT = 1 << 20  # scores are whole numbers of this fraction, so that ties are exact
UNCOVERED = 10  # natural-log units an uncovered byte scores below the rarest piece
# A worker starts a new trie beyond so many nodes; results do not depend on it.
TRIE_NODES = 1_200_000
_PACK = 60  # a segmentation is packed as pieces << 60 plus its negated score


def piece_scores(vocabulary: Vocabulary) -> dict[str, int]:
    """Zipf's law over the vocabulary's ranks: log probability -ln(1 + rank), in whole units."""
    return {p: -round(UNIT * math.log(1 - s)) for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True) if k == "N"}


class Trie:
    def __init__(self, scores: dict[str, int]):
        self.cost = {p: (1 << _PACK) - s for p, s in scores.items()}
        rarest = min(scores.values(), default=0)
        self.byte_cost = (1 << _PACK) - (rarest - UNCOVERED * UNIT)
        sizes: dict[str, set[int]] = {}
        for p in scores:
            sizes.setdefault(p[-1], set()).add(len(p))
        self.sizes = {c: sorted(n) for c, n in sizes.items()}
        self.ends: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | character
        self.best = [0]  # packed so that less is better: score first, then pieces
        self.ends.clear()

    @staticmethod
    def order(packed: int) -> tuple[int, int]:
        return packed & ((1 << _PACK) - 1), packed >> _PACK

    def insert(self, token: str) -> int:
        """Packed best segmentation of the token; only nodes that no earlier token made are computed."""
        child, best = self.child, self.best
        node, path = 0, [0]
        for at, c in enumerate(token, 1):
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                found, least = None, None
                for n in self.sizes.get(c, ()):
                    if n > at:
                        break
                    cost = self.cost.get(token[at - n:at])
                    if cost is not None:
                        total = path[at - n] + cost
                        rank = (total & ((1 << _PACK) - 1), total >> _PACK)
                        if least is None or rank < least:
                            found, least = total, rank
                if token[at - 1] not in self.cost:
                    total = path[at - 1] + self.byte_cost * len(c.encode())
                    if least is None or self.order(total) < least:
                        found = total
                node = child[key] = len(best)
                best.append(found)
            path.append(best[node])
        return path[-1]

    def of(self, token: str) -> int:
        found = self.ends.get(token)
        if found is None:
            if len(self.best) > TRIE_NODES:
                self.clear()
            found = self.ends[token] = self.insert(MARK + token)
        return found


_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_tries: dict[int, Trie] = {}


def _trie(vocabulary: Vocabulary) -> Trie:
    key = hash(vocabulary)
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(piece_scores(vocabulary))
    return _tries[key]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_pretokens, n_tokens and log_score (natural log) of every row's whole text.

    A NULL text, or one without words, has no tokens. Ids pass through; other columns are dropped. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _trie(shared.value).of
        mask = (1 << _PACK) - 1
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                n_words, n_tokens, score = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = _words(text or "")
                    total = sum(map(of, tokens))
                    n_words.append(len(tokens))
                    n_tokens.append(total >> _PACK)
                    score.append(-(total & mask) / UNIT)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(score, pa.float64())],
                                                 names=["id", "n_pretokens", "n_tokens", "log_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_pretokens bigint, n_tokens bigint, log_score double")
    return out.withColumnRenamed("id", id_col)
