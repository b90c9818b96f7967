"""Small exact checks of the operators that work row by row, awkward rows included."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lociframe.llm import archives, arrow_text, decontamination, language_model, licenses, quality, repeats, sentence_pieces, simhash, token_counts
from lociframe.llm.queries import piece_model


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pieces_equal_the_library(docs, awkward):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = [*awkward, (20, " " * 300 + "x   y"), (21, "\x00<s></s>▁▁a"), (22, "ab$$$ c.d,e||f 12,5.6\r\n\tx")]
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in sentence_pieces.encode_documents(docs(rows), piece_model()).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, bytearray(np.array(ids, "<u4").tobytes()), model.decode(ids)))
    assert [(a, bytes(b), c) for a, b, c in got] == sorted(((a, bytes(b), c) for a, b, c in want), key=lambda x: repr((x[0], bytearray(x[1]), x[2])))


def test_pieces_of_an_empty_table(docs):
    assert sentence_pieces.digests(sentence_pieces.encode_documents(docs([]), piece_model())).collect() == []


def test_token_counts_equal_a_plain_search(docs, awkward):
    scores = token_counts.piece_scores(sentence_pieces.Vocabulary.read(piece_model()))
    rarest = min(scores.values())

    def best(token):
        token = "▁" + token
        at = [(0, 0)]
        for end in range(1, len(token) + 1):
            options = []
            for start in range(max(0, end - 16), end):
                if token[start:end] in scores:
                    options.append((at[start][0] - scores[token[start:end]], at[start][1] + 1))
            if token[end - 1] not in scores:
                n = len(token[end - 1].encode())
                options.append((at[end - 1][0] - n * (rarest - token_counts.UNCOVERED * token_counts.UNIT), at[end - 1][1] + n))
            at.append(min(options))
        return at[-1]

    got = sorted(((r["doc_id"], r["n_pretokens"], r["n_tokens"], round(r["log_score"], 6)) for r in token_counts.count_tokens(docs(awkward), piece_model()).collect()), key=repr)
    want = []
    for i, t in awkward:
        found = [best(w) for w in words(t)]
        want.append((i, len(found), sum(n for _, n in found), round(-sum(s for s, _ in found) / token_counts.UNIT, 6)))
    assert [(*g[:3], g[3] + 0.0) for g in got] == sorted([(*w[:3], w[3] + 0.0) for w in want], key=repr)
    assert token_counts.count_tokens(docs([]), piece_model()).count() == 0


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    end = start + rng.integers(0, 90, 500)
    got = simhash.xxh64_spans(data, start, end)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s:e].tobytes(), 42) for s, e in zip(start, end)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash_components(docs, awkward, spark):
    rows = [*awkward, (30, " ".join(f"t{i}" for i in range(400))), (31, " ".join(f"t{i}" for i in range(401)))]
    got = simhash.near_duplicates(docs(rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        want.append((i, prints[k], min(ids, default=None)))
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    kept = simhash.keep_one(docs(rows)).collect()
    assert len(kept) == len(set(label)) and "spans" in kept[0].asDict()
    assert simhash.near_duplicates(docs([])).count() == 0


def test_chain_of_fingerprints_is_one_class(spark):
    base, chain = 0x123456789ABCDEF0, []
    for k in range(60):
        base ^= (0b111 << (k % 60))
        chain.append(base - 2**64 if base >= 2**63 else base)
    far = [int(x) for x in np.random.default_rng(5).integers(-2**63, 2**63, 200)]
    df = spark.createDataFrame([(x,) for x in chain + far], "fp long")
    from lociframe.llm.components import components
    found = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    assert len({found[x] for x in chain}) == 1


def test_crowded_anchor_groups_keep_every_link():
    rng = np.random.default_rng(2)
    fp = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 30, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 30, 300).astype(np.uint64)))
    a, b = simhash.links_in(np.zeros(len(fp), np.int64), fp, np.ones(len(fp), bool), 3)
    seen, todo = {int(fp[0])}, [int(fp[0])]
    edges = {}
    for x, y in zip(a.tolist(), b.tolist()):
        edges.setdefault(x, []).append(y)
        edges.setdefault(y, []).append(x)
    while todo:
        for y in edges.get(todo.pop(), []):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    assert seen == set(fp.tolist()) and len(a) == len(fp) - 1


def test_quality_counts_and_verdicts(docs, awkward, spark):
    rows = [*awkward, (40, "one two three four five\nsix\none two three four five\nsix seven # $x"), (41, "b c d e f g h i j k l m n o p")]

    def plain(t):
        w, t = words(t), t or ""
        lines, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    got = quality.judge(docs(rows), None).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])


def test_quality_classifier_on_held_out_rows(docs, spark):
    rng = np.random.default_rng(0)
    text = lambda junk: " ".join(f"{rng.choice(['alpha', 'beta', 'gamma', 'delta'])}{rng.integers(99)}{'$$$' if junk else ''}" for _ in range(60))
    rows = [(i, text(i % 5 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs(rows), labels)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(rows), model).collect()}
    assert all(got[i] == (i % 5 != 0) for i in range(400, 600))
    assert quality.keep_good(docs(rows), model).columns == docs(rows).columns
    assert quality.fit(docs(rows), labels.limit(0)) is None


def test_license_scan(docs, awkward):
    from lociframe.llm.license_templates import TEMPLATES
    mit = TEMPLATES["MIT"]
    cut = " ".join("filled in" if k % 17 == 0 else w for k, w in enumerate(mit.split()))
    rows = [*awkward, (50, "Some text.\n" + mit), (51, f"{cut} tail"), (52, "Released under the MIT License. " * 3), (53, "the software is fine without restriction")]
    got = licenses.scan(docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["license"] for r in by[50]] == ["MIT"] and by[50][0]["coverage"] == 1.0 and by[50][0]["byte_start"] == 11
    assert [r["license"] for r in by[51]] == ["MIT"] and 0.8 < by[51][0]["coverage"] < 1 and len(by[51][0]["spans"]) > 3
    assert sorted(r["byte_start"] for r in by[52]) == [0, 32, 64] and set(by) == {50, 51, 52}
    assert licenses.scan(docs([])).count() == 0


def test_alignment_equals_longest_common_subsequence_without_noise():
    template = np.arange(40, dtype=np.uint64)
    text = np.concatenate([np.arange(100, 110), np.arange(0, 20), [500, 501], np.arange(22, 40), [900]]).astype(np.uint64)
    pairs = licenses.align(template, text, 0, 20)
    assert [t for t, _ in pairs] == [*range(20), *range(22, 40)] and all(template[t] == text[w] for t, w in pairs)


def test_language_model_against_plain_counts(docs, awkward):
    rng = np.random.default_rng(1)
    rows = [*[(i, t) for i, t in awkward if i is not None and i != 6], *[(100 + i, " ".join(f"V{rng.zipf(1.5) % 50}" for _ in range(40))) for i in range(60)]]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    out = language_model.score(docs(rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, bucket_bits=4, filter_bits=18).collect()
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    count = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    for r in out:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), n)
        assert r["n_known"] == sum(count[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert np.isfinite(r["score"]) and r["score"] <= 0
    assert len(out) == len(rows)
    assert language_model.score(docs([]), F.lit(False), bucket_bits=4, filter_bits=18).count() == 0


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    keys[:] = keys >> np.uint64(4)  # one bucket of sixteen
    counts = rng.integers(1, 1000, 4000)
    bits = language_model.fill_slice((keys[:2000], counts[:2000]), (keys[2000:], counts[2000:]), 20)
    table = np.zeros(16 * len(bits), np.uint8)
    table[:len(bits)] = bits
    got = language_model.Filter(table, 4, 24).levels(keys)
    want = language_model.level_of(counts)
    assert (got >= want).all() and (got == want).mean() > 0.9
    # Where not everything fits, whole levels of bigrams go, the lowest first.
    tight = language_model.fill_slice((keys[:500], counts[:500]), (keys[2000:], counts[2000:]), 17)
    table = np.zeros(16 * len(tight), np.uint8)
    table[:len(tight)] = tight
    got = language_model.Filter(table, 4, 21).levels(keys)
    assert (got[:500] >= want[:500]).all()
    assert (got[2000:] < want[2000:]).any()


def test_language_model_keeps_every_level(docs):
    """Scores equal those of exact counts read by level, and a filter far too small at first grows until no bigram is left out."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"v{rng.integers(300)}" for _ in range(80))) for i in range(80)]
    held = F.col("doc_id") % 5 == 1
    got = {r["doc_id"]: r["score"] for r in language_model.score(docs(rows), held, bucket_bits=4, filter_bits=24).collect()}
    tokens = {i: [*t.split(), None] for i, t in rows}
    uni = Counter(w for i, ws in tokens.items() if i % 5 != 1 for w in ws)
    bi = Counter(p for i, ws in tokens.items() if i % 5 != 1 for p in zip(["^", *ws], ws))
    n, v = sum(uni.values()), len(uni)
    read = lambda c: language_model.COUNT_OF[language_model.level_of(np.array([c]))[0]] if c else 0.0

    def plain(ws, k):
        total = 0.0
        for h, w in zip(["^", *ws], ws):
            c_h, c_w = read(uni[None if h == "^" else h]), read(uni[w])
            c = min(read(bi[h, w]), c_h, c_w)
            total += np.log10((c + k * (c_w + 0.5) / (n + 0.5 * (v + 1))) / (c_h + k))
        return total

    errors = {k: max(abs(got[i] - plain(ws, k)) for i, ws in tokens.items()) for k in language_model.PRIORS}
    assert min(errors.values()) < 1e-6
    slices = {r["bucket"]: np.frombuffer(r["bits"], np.uint8) for r in language_model.count_grams(docs(rows).where(~held), 4, 8).collect()}
    data = "\n".join(t for i, t in rows if i % 5 != 1).encode()
    ends = np.cumsum([0, *(len(t) + 1 for i, t in rows if i % 5 != 1)])
    ends[-1] -= 1
    found, before, _ = language_model.tokens_of(np.frombuffer(data, np.uint8), ends)
    keys, counts = np.unique(language_model.bigram_hashes(before, found), return_counts=True)
    for bucket, bits in slices.items():
        inside = keys >> np.uint64(60) == bucket
        levels = language_model.Filter(bits, 0, (len(bits) * 8).bit_length() - 1).levels(keys[inside])
        assert inside.any() and (levels >= language_model.level_of(counts[inside])).all()


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u3", None), (4, "u4", ""), (5, "u 5\r\n", "é" * 90_000), (6, "u6", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "digest", "payload", "d")})
    archives.write_archives(archives.plan_records(pages), str(tmp_path / "warc"))
    records = archives.read_archives(spark.read.parquet(str(tmp_path / "warc")))
    got = {r["page_id"]: r for r in archives.digests(records).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and all(r["status"] == "verified" for r in got.values())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4),
                                                                             4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len((html or "").encode()), archives.base32_digest((html or "").encode()))
    assert archives.read_archives(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_archive_reader_goes_on_after_damage():
    good = [archives.record("response", f"urn:page:{i}", "u", "d", archives.base32_digest(b"x" * n), n, b"x" * n, None) for i, n in enumerate((10, 200_000, 0))]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    got = list(archives.read_segment(good[0] + bytes(broken) + good[2]))
    assert [r["status"] for r in got if r["status"] == "verified"] == ["verified"] * 2 and any(r["status"] == "damaged" for r in got)
    assert [r["status"] for r in archives.read_segment(b"".join(good)[:-3])] == ["verified", "verified", "damaged"]


def test_leaks(docs, spark, awkward):
    item = "Anna has 12 apples and gives Bert 5 of them every day, so how many apples has Anna after 3 days in 7 kg boxes?"
    same = item.replace("Anna", "Carla").replace("Bert", "Dora").replace("12", "40").replace("5", "6")
    mixed = item.replace("Anna", "Carla", 1)  # the name changes half way
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    rows = [*awkward, (60, f"Before it. {item} After it."), (61, f"Text. {same} More."), (62, f"x {item.upper()} y"), (63, "Nothing of it."), (64, "it has two words here")]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.leaks(docs(rows), bench).collect()}
    assert got[60, 1] == "verbatim" and got[61, 1] == "reparameterised" and got[64, 4] == "verbatim"
    assert not any(d in (63,) or d is None for d, _ in got)
    kept = {r["doc_id"] for r in decontamination.drop_leaks(docs(rows), bench).collect()}
    assert {60, 61} & kept == set() and {1, 2, 63} <= kept
    assert decontamination.leaks(docs([]), bench).count() == 0 and decontamination.leaks(docs(rows), bench.limit(0)).count() == 0
    assert mixed != item


def test_leaks_of_every_item_of_a_template(docs, spark):
    text = lambda n, a, b: f"{n} has {a} red apples and {b} green pears in the box"
    items = [(1, "So " + text("Tom", 2, 2)), (2, "So " + text("Tom", 3, 5)), (3, "So " + text("Ann", 7, 8))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"Read this. {t} today.") for i, t in items] + [(4, "Read this. So " + text("Ann", 3, 8))]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontamination.leaks(docs(rows), bench).collect()}
    assert got[1, 1] == got[2, 2] == got[3, 2] == "verbatim" and got[4, 2] == "reparameterised"
    assert (2, 1) not in got and (3, 1) not in got and got[1, 2] == "reparameterised"


def test_leaks_of_slot_rich_items_and_other_case(docs, spark):
    items = [(1, "Compute 3 + 4 + 5 + 6 + 7."), (2, "Anna has 5 kg and Bert 3 kg 4 g 2 mg"), (3, "Compute 8 + 4 + 5 + 6 + 9."),
             (4, "When Tom and Ann met Bob near Rome with Eve they sang")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"x {t} y") for i, t in items] + [(10 + i, f"x {t.upper()} y") for i, t in items] + [(20 + i, f"x {t.lower()} y") for i, t in items]
    rows += [(30, "Compute 1 + 2 + 9 + 8 times 7."), (31, "3 4 5 6 and 7")]
    out = decontamination.leaks(docs(rows), bench).collect()
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["coverage"]) for r in out}
    assert got == {(k + i, 1 if i == 3 else i): ("verbatim", 1.0) for k in (0, 10, 20) for i, _ in items}


def test_repeats_against_plain_search(docs, awkward):
    rng = np.random.default_rng(4)
    shared = "".join(rng.choice(list("abcde "), 300))
    rows = [*awkward, (70, "left " + shared + " right"), (71, shared[40:220]), (72, "xx" + shared[:60] + "é" + shared[60:120]), (73, shared[:49]), (71, shared + shared)]
    order = lambda i: 2**63 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], 2**64), order(i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < order(i):
                gone[k:k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    got = repeats.digests(repeats.remove_repeats(docs(rows), bucket_bits=3, filter_bits=16)).collect()
    fix = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert fix(got) == fix(want)
    assert repeats.remove_repeats(docs([]), bucket_bits=3, filter_bits=16).count() == 0


def test_repeat_groups_list_all_occurrences(docs):
    passage = "A passage that is long enough to count as one repeat of the corpus."
    rows = [(1, "one " + passage + " end"), (2, "two: " + passage), (3, passage + " three")]
    got = repeats.repeat_groups(docs(rows), bucket_bits=2, filter_bits=14).collect()
    assert got and all(len(r["occurrences"]) >= 2 for r in got)
    for r in got:
        for o in r["occurrences"]:
            assert dict(rows)[o["id"]].encode()[o["start"]:].startswith(bytes(r["passage"]))
    assert max(len({o["id"] for o in r["occurrences"]}) for r in got) == 3


def test_slices_cover_every_text_once():
    texts = ["", "abc", None, "x" * 5000, "é"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]).slice(1)
    out = []
    for part, data, offsets in arrow_text.pieces(batch, "text", 1000):
        out += [bytes(data[offsets[i]:offsets[i + 1]]).decode() for i in range(len(part))]
    assert out == [t or "" for t in texts[1:]]


def test_repeats_work_on_a_bounded_part_of_a_bucket(docs, monkeypatch):
    """The arrays of a task do not grow with its bucket, and the bytes removed are the same."""
    rng = np.random.default_rng(6)
    passages = ["".join(rng.choice(list("abcdef "), 120)) for _ in range(30)]
    rows = docs([(i, " ".join(passages[k] for k in rng.integers(0, 30, 4))) for i in range(60)])
    whole = sorted(map(tuple, repeats.digests(repeats.remove_repeats(rows, bucket_bits=1, filter_bits=16)).collect()))
    assert sum(r[2] for r in whole) > 10_000
    sent = repeats.contexts(repeats._rows(rows, "doc_id", "text"), np.full(1 << 13, 255, np.uint8), 1, 16).where("bucket = 0").toArrow()
    spans = lambda: sorted(s for batch in repeats.covered_spans(sent) for s in zip(*batch.to_pydict().values(), strict=True))
    once = spans()
    monkeypatch.setattr(repeats, "PART_WINDOWS", 300)
    found = list(repeats.parts(sent))
    windows = [len(b.least) for b in found]
    assert len(found) > 10 and sum(windows) > 3_000 and max(windows) < 600 and spans() == once
    for b in found:
        assert all(len(key) <= 300 for key, _, _ in b.covered())
