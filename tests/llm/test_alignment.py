"""Cross-tokenizer alignment against both libraries and plain dictionaries."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from lociframe.llm import alignment, queries


@pytest.fixture(scope="module")
def held():
    import public_tokenizers
    return alignment.Vocabularies.read(public_tokenizers.path("byte_bpe_50k.json"), queries.piece_model())


def plain(rows):
    """The contract of the query with the libraries themselves; ``rows`` are (id, text)."""
    import public_tokenizers
    import sentencepiece
    import tokenizers
    byte_level = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    byte_level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    table = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    table |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in table)}
    back = {c: b for b, c in table.items()}

    def bytes_of(piece):
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    done = []
    for i, text in rows:
        if not text:
            done.append((i, [], [], []))
            continue
        whole = (" " + text).encode()
        e = byte_level.encode(" " + text, add_special_tokens=False)
        a = [(k, bytes(back[c] for c in t)) for k, t in zip(e.ids, e.tokens, strict=True)]
        b = [(k, bytes_of(pieces.id_to_piece(k))) for k in pieces.encode(text)]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            done.append((i, [], [], []))
            continue
        groups, x, y, at_a, at_b, left, right = [], 0, 0, 0, 0, [], []
        while x < len(a) or y < len(b):
            if at_a <= at_b:
                at_a += len(a[x][1])
                left.append(a[x][0])
                x += 1
            else:
                at_b += len(b[y][1])
                right.append(b[y][0])
                y += 1
            if at_a == at_b:
                groups.append((left, right))
                left, right = [], []
        done.append((i, a, b, groups))
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in done for g in groups)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for i, a, b, groups in done:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[k] == highest[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), count


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_the_query_equals_the_libraries(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, folder, "documents").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, folder).collect()), key=repr)
    assert got == plain(rows)[0]


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 40])
def test_awkward_rows_and_several_passes(docs, awkward, held, most):
    rows = [*awkward, (20, " " * 6000 + "x"), (21, "<|endoftext|><s></s>"), (22, "\x00 ▁ x"), (23, "👩‍👩‍👧 naïve 1234567"), (24, "  a  b\n\n c\t")]
    frame = alignment.align_documents(docs(rows), held, most_pairs=most)
    want, _ = plain(rows)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr) == want


def test_pair_counts(spark, docs, held):
    rows = [(i, f"the word {i % 7} and another word {i}") for i in range(40)]
    encoded = alignment.encode_documents(docs(rows), held)
    tables = alignment.counted_pairs(encoded, held)
    got = {(r["a_id"], r["b_id"]): r["links"] for r in alignment.pair_counts(spark, tables, len(held.pieces)).collect()}
    assert got == dict(plain(rows)[1])


def test_the_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 30_000).astype(np.uint64))
    rows = []
    for part in np.unique(alignment._part_of(keys)):
        levels, order = alignment.build_hash(keys[alignment._part_of(keys) == part])
        rows.append({"part": int(part), "rooms": [len(x) for x in levels], "keys": order.astype("<u8").tobytes(),
                     "bits": b"".join(np.packbits(x, bitorder="little").tobytes() for x in levels)})
    pairs = alignment.PairHash.of(rows)
    assert sorted(pairs.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1, 40_000, dtype=np.uint64), keys)
    assert (pairs.slots(others) == -1).all()


def test_an_empty_table(docs, held):
    assert alignment.align_documents(docs([]), held).collect() == []
