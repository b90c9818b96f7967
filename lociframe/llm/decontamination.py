"""Find benchmark items in documents, also with other numbers, names and units.

Numbers, names (words with one capital inside a sentence) and units behind a number become typed placeholders. Windows of five
canonical words of the items are hash-joined with those of the documents, and so are windows of the lower-cased words themselves, which find
number-rich stretches and copies in other case. Hits of one document and item on one diagonal are one copy; it counts when every slot value of the item stands for one and the same value in the document throughout.
A document is a leak of an item when its copies cover at least four fifths of the item's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import checkpoint
from . import arrow_text

WIDTH = 5
LEAST_COVERAGE = 0.8
# Up to this many item windows (8 bytes each) tasks drop windows of documents that no item has; beyond it all are joined.
FILTER_WINDOWS = 1_000_000
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7))
# Words for units.
UNITS = """mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres mg g kg ton tons gram grams kilogram kilograms
oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days
week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh""".split()
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT, _UPPER, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = _UPPER[65:91] = True
_STOP[list(b".!?:;\n\"|()[]{}*#")] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    found = arrow_text.words(data, np.array([0, len(data)]))
    return np.sort(arrow_text.span_hashes(data, found.start, found.end))


_UNIT_HASHES = _unit_hashes()


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, byte by byte in place."""
    out = arrow_text.LOWER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[upper] += 0x20
    return out


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[arrow_text.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, hashes with placeholders, hashes of the lower-cased words, is it a slot)."""
    found = arrow_text.words(data, offsets, APART)
    literal = arrow_text.span_hashes(fold(data), found.start, found.end)
    if not len(literal):
        return found, literal, literal, np.zeros(0, bool)
    number = _DIGIT[data[found.start]]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(literal), bool)
    opens[1:] = stops[found.start[1:]] > stops[found.end[:-1]]
    opens[found.first[:-1][np.diff(found.first) > 0]] = True
    # A name has a capital and then small letters; text in capitals throughout has no names.
    second = np.minimum(found.start + 1, len(data) - 1)
    name = _UPPER[data[found.start]] & (data[second] >= 97) & (found.end - found.start > 1) & ~opens
    unit = np.zeros(len(literal), bool)
    at = np.minimum(np.searchsorted(_UNIT_HASHES, literal), len(_UNIT_HASHES) - 1)
    unit[1:] = (_UNIT_HASHES[at] == literal)[1:] & number[:-1] & ~opens[1:]
    unit &= ~number
    out = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
    return found, out, literal, number | name | unit


def windows(found: arrow_text.Words, hashes: np.ndarray, literal: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows inside one row: canonical ones with at least two literal words (short windows: half their
    words), and all windows with slots by their own words too. Windows without slots have one hash in both forms."""
    inside = arrow_text.run_starts(found.first, width)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    slots = np.concatenate([[0], np.cumsum(slot)])
    n_slots = (slots[width:] - slots[:-width])[:len(inside)]
    general = np.flatnonzero(inside & (n_slots <= max(width // 2, width - 2)))
    own = np.flatnonzero(inside & (n_slots > 0))
    keys = np.concatenate([arrow_text.sliding(hashes, width)[general], arrow_text.sliding(literal, width)[own]])
    return np.concatenate([general, own]), keys + np.uint64(width)


def _window_rows(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, widths: list[int] | None, wanted: np.ndarray | None) -> list[pa.RecordBatch]:
    """Window rows of a slice; ``widths=None`` takes WIDTH, or the whole row where that is shorter."""
    found, hashes, literal, slot = canonical(data, offsets)
    n_words = np.diff(found.first)
    out = []
    for width in widths or range(1, WIDTH + 1):
        at, key = windows(found, hashes, literal, slot, width)
        if widths is None and len(at):
            ok = n_words[np.searchsorted(found.first, at, "right") - 1]
            ok = ok == width if width < WIDTH else ok >= WIDTH
            at, key = at[ok], key[ok]
        if wanted is not None and len(at):
            ok = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            at, key = at[ok], key[ok]
        if not len(at):
            continue
        row = np.searchsorted(found.first, at, "right") - 1
        inside = at[:, None] + np.arange(width)
        values = literal[inside].view(np.int64)
        listed = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), width).cast(pa.list_(pa.int64()))
        out.append(pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(at - found.first[row]),
             pa.array(np.full(len(at), width)), pa.array(n_words[row]), listed], names=["id", "row_key", "window", "place", "width", "n_words", "words"]))
    return out


def _item_rows(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Template and slot values of every item with words. The template has the canonical words and which slots are equal."""
    found, hashes, literal, slot = canonical(data, offsets)
    values = np.where(slot, literal, np.uint64(0))
    templates = []
    for k in range(len(rows)):
        inside = slice(found.first[k], found.first[k + 1])
        _, first, which = np.unique(values[inside], return_index=True, return_inverse=True)
        equal = np.where(slot[inside], first[which] + 1, 0).astype(np.uint64)
        templates.append(hashlib.blake2b(hashes[inside].tobytes() + equal.tobytes(), digest_size=16).hexdigest())
    listed = pa.ListArray.from_arrays(pa.array(found.first.astype(np.int32)), pa.array(values.view(np.int64)))
    out = pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(templates, pa.string()), listed], names=["id", "row_key", "template", "values"])
    return out.filter(pa.array(np.diff(found.first) > 0))


def _all_items(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow_text.pieces(batch, "text"):
                yield _item_rows(rows, data, offsets)

    rows = table.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row_key bigint, template string, values array<bigint>")


def _members_of(copies: DataFrame, members: DataFrame) -> DataFrame:
    """Copies with the column verbatim: do their slots have the values of one member of the class?

    A class and the slots that some copy covers are asked once; each member then has one key, so copies are not paired with members.
    """
    key = lambda pairs: F.xxhash64(F.sort_array(pairs))
    keyed = copies.withColumn("covered", F.sort_array(F.transform("pairs", lambda p: p["a"]))).withColumn("key", key(F.col("pairs")))
    asked = keyed.where(F.exists("pairs", lambda p: p["a"] != p["b"])).select(F.col("template").alias("t"), F.col("covered").alias("c")).distinct()
    have = asked.join(members, F.col("t") == F.col("template")).select(
        "t", "c", key(F.filter("member", lambda p: F.array_contains("c", p["a"]))).alias("k")).distinct()
    same = (F.col("template") == F.col("t")) & (F.col("covered") == F.col("c")) & (F.col("key") == F.col("k"))
    return keyed.join(have, same, "left").withColumn("verbatim", F.col("k").isNotNull() | ~F.exists("pairs", lambda p: p["a"] != p["b"])).drop("t", "c", "k")


def _all_windows(table: DataFrame, id_col: str, text_col: str, widths: list[int] | None, wanted: np.ndarray | None) -> DataFrame:
    kind = table.schema[id_col].dataType.simpleString()
    shared = table.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrow_text.pieces(batch, "text"):
                yield from _window_rows(rows, data, offsets, widths, shared.value)

    rows = table.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row_key bigint, window bigint, place bigint, width bigint, n_words bigint, words array<bigint>")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", least: float = LEAST_COVERAGE) -> DataFrame:
    """One row for each document and item it leaks: the id, row_key, item_id, coverage, n_words of the item, n_slots and kind.

    ``kind`` is 'verbatim' when every slot has the value of one item, else 'reparameterised'. Items of one template, with the same slots
    equal, are one class: item_id is the smallest of the class. NULL and empty texts match nothing; equal rows of documents give one
    row; an item of fewer than five words is one window of its length. Either table may be empty.
    """
    benchmark = benchmark.where(F.col(item_text).isNotNull())
    heads = checkpoint(_all_items(benchmark, item_id, item_text))
    classes = heads.groupBy("template").agg(F.min(F.struct("id", "row_key", "values")).alias("m")).select(
        "template", F.col("m.id").alias("item"), F.col("m.values").alias("own"))
    zipped = F.arrays_zip(F.col("own").alias("a"), F.col("values").alias("b"))
    members = checkpoint(heads.join(classes, "template").select("template", F.array_distinct(F.filter(zipped, lambda p: p["a"] != 0)).alias("member")).distinct())
    items = _all_windows(benchmark, item_id, item_text, None, None).join(
        heads.select(F.col("id").alias("hid"), F.col("row_key").alias("hkey"), "template").distinct(),
        F.col("id").eqNullSafe(F.col("hid")) & (F.col("row_key") == F.col("hkey")))
    items = checkpoint(items.select("template", "window", "place", "width", "n_words").distinct().join(classes, "template").select(
        "template", F.col("item").alias("id"), "window", "place", "width", "n_words", F.slice("own", F.col("place").cast("int") + 1, F.col("width").cast("int")).alias("slots")))
    size = items.count()
    wanted = None
    if size <= FILTER_WINDOWS:
        wanted = np.array([r[0] for r in items.select("window").distinct().collect()] or [0], np.int64).view(np.uint64)
        wanted.sort()
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()]
    found = _all_windows(docs.where(F.col(text_col).isNotNull()), id_col, text_col, widths or [WIDTH], wanted)
    right = items.select("template", F.col("id").alias("item"), F.col("window").alias("w"), F.col("place").alias("item_place"), F.col("n_words").alias("item_words"),
                         F.col("slots").alias("item_slots"))
    hits = found.join(F.broadcast(right) if wanted is not None else right, F.col("window") == F.col("w"))
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("words").alias("b")), lambda p: p["a"] != 0)
    # A copy has two rows for each window of its item at most.
    copies = (hits.groupBy("id", "row_key", "template", "item", "item_words", (F.col("place") - F.col("item_place")).alias("diagonal"))
              .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("item_place", F.col("item_place") + F.col("width") - 1)))).alias("places"),
                   F.array_distinct(F.flatten(F.collect_list(pairs))).alias("pairs")))
    copies = copies.where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs"))
    whole = _members_of(copies, members).groupBy("id", "row_key", "template", "item", "item_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.max(F.size("pairs")).alias("n_slots"),
        F.min("verbatim").alias("verbatim"))
    return whole.where(F.col("n") >= F.col("item_words") * F.lit(least)).select(
        F.col("id").alias(id_col), "row_key", F.col("item").alias("item_id"), (F.col("n") / F.col("item_words")).alias("coverage"),
        F.col("item_words").alias("n_words"), F.col("n_slots").cast("bigint").alias("n_slots"), F.when(F.col("verbatim"), "verbatim").otherwise("reparameterised").alias("kind"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("row_key").alias("__bad")).distinct()
    return docs.withColumn("__key", F.xxhash64(id_col, text_col)).join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")
