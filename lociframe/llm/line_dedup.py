"""Remove lines that repeat an earlier line exactly or within a few edits, with built-in expressions only.

Every distinct line is cut into threshold-plus-one segments, which are indexed by length, segment number and content.
A line within the threshold keeps one segment whole, so each line looks up only the substrings that could be such a segment of a
line of its own or a slightly smaller length, at the few places where the remaining edits allow it. Pairs that also
pass a letter-count bound are verified by a bit-parallel edit distance on a band of diagonals.

A line is removed when an earlier one (by document id, then line number) is linked to it; the first occurrence of a line
without an earlier partner stays. Links are between lines of at least ``EXACT_BELOW`` characters: one edit up to nine
characters, ``EDITS`` from ten on. Lines without a word are never removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import checkpoint

EDITS = 2
EXACT_BELOW = 5
# So many of the most frequent lines are made distinct before the shuffle; any other line is less than this share of all lines.
HOT_LINES = 10_000
# Sides of up to this many ids (8 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_IDS = 500_000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\v\f\r"


def has_word(line: str) -> Column:
    return F.btrim(F.col(line), F.lit(SPACES)) != ""


def allowed_edits(longer: Column) -> Column:
    return F.when(longer < EXACT_BELOW, 0).when(longer < 10, 1).otherwise(EDITS)


def letter_counts(line: Column) -> Column:
    """Counts of the letters a to z, modulo 4, two bits each: one edit moves them by two steps at most."""
    n = F.octet_length(line)
    out = F.lit(0).cast("bigint")
    for k, letter in enumerate(LETTERS):
        out = out.bitwiseOR(F.shiftleft(((n - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))) % 4).cast("bigint"), 2 * k))
    return out


def letters_differ(a: Column, b: Column) -> Column:
    """Steps between two counts, each letter going round the shorter way."""
    low = F.lit(0x5555555555555555).cast("bigint")
    other = a.bitwiseXOR(b)
    odd = other.bitwiseAND(low)
    two = F.shiftrightunsigned(other, 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(two)


def _segment(length: Column, number: Column, edits: int) -> tuple[Column, Column]:
    """(first character from 1, size) of a segment; the last segments take the remainder."""
    size = F.floor(length / (edits + 1)).cast("int")
    plain = F.lit(edits + 1) - length % (edits + 1)  # segments of the smaller size
    return (number * size + F.greatest(number - plain, F.lit(0)) + 1).cast("int"), (size + (number >= plain).cast("int")).cast("int")


def _index_places(edits: int) -> list[tuple[int, int, int]]:
    return [(0, number, 0) for number in range(edits + 1)]


def _probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(characters by which the other line is shorter, its segment, shift) that at most ``edits`` edits on both sides allow."""
    return [(shorter, number, move) for shorter in range(edits + 1) for number in range(edits + 1)
            for move in range(max(-number, shorter - (edits - number)), min(number, shorter + (edits - number)) + 1)]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def padded(text: Column, edits: int = EDITS) -> Column:
    """Characters with room for the band on both sides."""
    edge = F.array(*[F.lit("")] * edits)
    return F.concat(edge, characters(text), edge, edge)


def edit_distance(rows: Column, letters: Column, edits: int = EDITS) -> Column:
    """Edit distance of a text given by ``padded`` and one given by ``characters`` when it is at most ``edits``, else some larger number.

    Both texts have more than ``edits`` characters. The two arguments should be stored columns, as they are read at every step.
    Letter by letter of the second text, one long holds the rows within ``edits`` of the diagonal: which vertical steps go up or down.
    """
    width = 2 * edits + 1
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    mask = F.lit((1 << width) - 1).cast("bigint")
    m, n = F.size(rows) - 3 * edits, F.size(letters)

    def step(state: Column, j: Column) -> Column:
        letter = F.get(letters, j - 1)
        match = zero
        for bit in range(width):
            match = match.bitwiseOR(F.when(F.get(rows, j - 1 + bit) == letter, F.lit(1 << bit).cast("bigint")).otherwise(zero))
        up, down = state["up"], state["down"]

        def with_match(x: Column) -> Column:
            diagonal = (x.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(x).bitwiseOR(down).bitwiseAND(mask)
            return _let(diagonal, with_diagonal)

        def with_diagonal(d0: Column) -> Column:
            right_up = down.bitwiseOR(F.bitwise_not(d0.bitwiseOR(up))).bitwiseAND(mask)
            return _let(right_up, lambda hp: finish(d0, hp, d0.bitwiseAND(up)))

        def finish(d0: Column, hp: Column, hn: Column) -> Column:
            next_rows = F.shiftright(d0, 1)
            row = m - j + edits  # bit of the last row once the band has reached it
            at_edge = one - F.shiftright(d0, 2 * edits).bitwiseAND(one)
            bit = lambda v: F.getbit(v, F.greatest(row, F.lit(0)))
            along = (bit(hp) - bit(hn)).cast("bigint")
            return F.struct(hn.bitwiseOR(F.bitwise_not(next_rows.bitwiseOR(hp))).bitwiseAND(mask).alias("up"), next_rows.bitwiseAND(hp).alias("down"),
                            (state["d"] + F.when(row >= 2 * edits, at_edge).otherwise(along)).alias("d"))

        return _let(match, with_match)

    start = F.struct(F.lit(((1 << width) - 1) & ~((1 << edits) - 1)).cast("bigint").alias("up"), zero.alias("down"), F.lit(edits).cast("bigint").alias("d"))
    return F.when(F.abs(m - n) > edits, F.lit(edits + 1).cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"]))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row_key and the lines of each row. A NULL text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("row_key"), F.split(text, "\n", -1).alias("parts"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line with a word: id, row_key, line_no, line, line_id and its place in the corpus."""
    lines = _rows(docs, id_col, text_col).select("id", "row_key", F.posexplode("parts").alias("line_no", "line")).where(has_word("line"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key", "line_no")
    return lines.withColumns({"line_id": F.xxhash64("line"), "place": place})


def _among(rows: DataFrame, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """Rows whose line_id is (not) among the n distinct ids of column ``picked``."""
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("line_id") == F.col("picked"), how)


def _cut(texts: DataFrame, places: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """A row for each substring of a line that is a segment (``_index_places``) or could equal one of another line (``_probe_places``)."""
    listed = F.array(*[F.struct(F.lit(s).alias("shorter"), F.lit(k).alias("number"), F.lit(m).alias("move")) for s, k, m in places])
    out = texts.select("*", F.length("line").alias("n")).select("*", F.inline(listed))
    other = F.col("n") - F.col("shorter")
    start, size = _segment(other, F.col("number"), edits)
    out = out.withColumns({"other": other, "start": start + F.col("move"), "size": size})
    out = out.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")) & (F.col("other") > edits))
    return out.withColumn("key", F.xxhash64("other", "number", F.substr("line", "start", "size")))


def _linked(pairs: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """Of the pairs (a, b) of line ids those within the threshold, with the first places of both lines, which are in ``known``."""
    left = known.select(F.col("line_id").alias("a"), F.col("place").alias("first_a"), F.length("line").alias("na"), padded(F.col("line"), edits).alias("rows"))
    right = known.select(F.col("line_id").alias("b"), F.col("place").alias("first_b"), F.length("line").alias("nb"), characters(F.col("line")).alias("letters"))
    # The arrays are made below the joins, so the distance reads stored ones at every step.
    both = pairs.join(left, "a").join(right, "b")
    near = edit_distance(F.col("rows"), F.col("letters"), edits) <= F.least(F.lit(edits), allowed_edits(F.greatest("na", "nb")))
    return both.where(near).select("a", "b", "first_a", "first_b")


def _meetings(lines: DataFrame, hot: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """(met, known): the buckets of segments in which a line b met another one, with the bucket's earliest line a, and the lines that met any.

    ``lines`` comes from ``_lines``; ``hot`` has the most frequent lines' ids (``picked``) and first places.
    """
    # One occurrence of a hot line is enough; the other lines are each less than a share of HOT_LINES of all lines.
    usable = lines.where(F.length("line") >= max(EXACT_BELOW - 1, edits + 1))
    texts = usable.join(F.broadcast(hot), F.col("line_id") == F.col("picked"), "left").where("picked is null or place = first").select("line_id", "line", "place")
    marked = lambda places: _cut(texts, places, edits).withColumn("b", F.col("line_id"))
    index = marked(_index_places(edits)).select("key", F.col("b").alias("a"), F.col("place.id").alias("id"))
    probes = marked(_probe_places(edits)).select("key", "b", "shorter", ((F.col("shorter") == 0) & (F.col("move") == 0)).alias("own"))
    # The line of the smallest document id stands for a bucket; where no id is known, any.
    heads = index.groupBy("key").agg(F.coalesce(F.min_by("a", "id"), F.min("a")).alias("a"), F.min("a").alias("low"), F.max("a").alias("high"))
    # A bucket that holds the probing line alone has nothing for it. Buckets are many and small, so they are hashed and the probes not sorted.
    met = probes.join(heads.hint("shuffle_hash"), "key").where((F.col("low") != F.col("high")) | (F.col("low") != F.col("b")))
    met = checkpoint(met.select("key", "b", "shorter", "own", "a", (F.col("low") != F.col("high")).alias("more")))
    # Only lines that met a bucket are read again: their text, first place and letters.
    ids = checkpoint(met.select(F.explode(F.array("a", "b")).alias("picked")).distinct())
    known = _among(texts, ids, ids.count()).groupBy("line_id").agg(F.min(F.struct("place", "line")).alias("one"))
    known = checkpoint(known.select("line_id", "one.place", "one.line", letter_counts(F.col("one.line")).alias("letters")))
    letters = lambda line, counts, most: known.select(F.col("line_id").alias(line), F.col("letters").alias(counts), allowed_edits(F.length("line")).alias(most))
    return checkpoint(met.join(letters("a", "la", "_most"), "a").drop("_most").join(letters("b", "lb", "most"), "b")), known


def _close(edits: int) -> Column:
    return (F.col("a") != F.col("b")) & (letters_differ(F.col("la"), F.col("lb")) <= 2 * F.least(F.col("most"), F.lit(edits)))


def _members(met: DataFrame) -> DataFrame:
    """The lines of the buckets with more than one: those that look up their own segment there."""
    return met.where("own and more").select("key", F.col("b").alias("a"), F.col("lb").alias("la")).distinct()


def line_links(lines: DataFrame, hot: DataFrame, edits: int = EDITS) -> DataFrame:
    """(line_id, first, links, later): the lines linked to others, where they stand first, to how many other lines, and whether to an earlier one.

    Arguments as for ``later_lines``. Counting needs every pair of lines that share a bucket, so a group of near copies costs the square of its lines.
    """
    met, known = _meetings(lines, hot, edits)
    asked = met.where("more").select("key", "b", "lb", "most").distinct()
    pairs = met.where("not more").where(_close(edits)).select("a", "b").union(asked.join(_members(met), "key").where(_close(edits)).select("a", "b"))
    pairs = checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = checkpoint(_linked(pairs, known, edits))
    side = lambda line, first, other: linked.select(F.col(line).alias("line_id"), F.col(first).alias("first"), (F.col(other) < F.col(first)).alias("later"))
    both = side("a", "first_a", "first_b").union(side("b", "first_b", "first_a"))
    return checkpoint(both.groupBy("line_id").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("links"), F.bool_or("later").alias("later")))


def later_lines(lines: DataFrame, hot: DataFrame, edits: int = EDITS) -> DataFrame:
    """(line_id, first): the lines with an earlier line linked to them, and where they stand first.

    ``lines`` comes from ``_lines``; ``hot`` has the most frequent lines' ids (``picked``) and first places.

    Round one compares a line only with the earliest line of each bucket of segments that it looks up, one for each key, so a group of near
    copies costs as many comparisons as it has lines. A line that found an earlier partner there is decided. Round two goes through the
    whole buckets for pairs of which one line at least is undecided; a decided line stays a partner of the others.
    """
    met, known = _meetings(lines, hot, edits)
    close = _close(edits)

    def later(pairs: DataFrame) -> DataFrame:
        # A pair of unequal length is met from the longer line only, so both ends are looked at.
        linked = _linked(pairs, known, edits)
        swapped = F.col("first_b") < F.col("first_a")
        return linked.select(F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("line_id"), F.greatest("first_a", "first_b").alias("first"))

    decided = checkpoint(later(met.where(close).select("a", "b").distinct()).distinct())
    done = decided.select(F.col("line_id").alias("d"))
    open_keys = met.where("more").select("key", "b", "lb", "most", "shorter").distinct().join(done, F.col("b") == F.col("d"), "left").withColumn("sure", F.col("d").isNotNull()).drop("d")
    # Equally long lines look each other up, so a decided one may rest there.
    open_keys = checkpoint(open_keys.where("not sure or shorter > 0"))
    members = _members(met).join(done, F.col("a") == F.col("d"), "left").withColumn("settled", F.col("d").isNotNull()).drop("d")
    free = members.where("not settled")
    rest = open_keys.where("not sure").join(members.drop("settled"), "key").where(close).select("a", "b").union(
        open_keys.where("sure").join(free.drop("settled"), "key").where(close).select("a", "b"))
    return checkpoint(decided.union(later(checkpoint(rest.distinct()))).distinct())


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """Distinct (id, row_key, line_no, near) of the lines that go; near: because of a line that is not equal.

    Equal rows (id and text) have equal keys and count once. A row with a NULL id stands behind all others.
    """
    lines = _lines(docs, id_col, text_col)
    repeated, hot = _repeated(lines)
    return _removed(lines, repeated, hot, later_lines(lines, hot, edits))


def _repeated(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that stand more than once, and the most frequent of them."""
    repeated = checkpoint(lines.groupBy("line_id").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first")).where("times > 1"))
    return repeated, checkpoint(repeated.orderBy(F.desc("times"), "line_id").limit(HOT_LINES).select(F.col("line_id").alias("picked"), "first"))


def _removed(lines: DataFrame, repeated: DataFrame, hot: DataFrame, later: DataFrame) -> DataFrame:
    near = repeated.join(later.select(F.col("line_id").alias("l")), F.col("line_id") == F.col("l"), "left").select(
        F.col("line_id").alias("picked"), F.col("first").alias("at"), F.col("l").isNotNull().alias("near"))
    # Hot lines are at most HOT_LINES, so theirs is a broadcast join; their rows take part in the other join under keys of their own.
    warm = near.join(F.broadcast(hot.select(F.col("picked").alias("h"))), F.col("picked") == F.col("h")).select("h", F.col("at").alias("hot_at"), F.col("near").alias("hot_near"))
    slim = lines.select("line_id", "place").join(F.broadcast(warm), F.col("line_id") == F.col("h"), "left").where("h is null or place <> hot_at")
    cold = near.join(F.broadcast(hot.select(F.col("picked").alias("h"))), F.col("picked") == F.col("h"), "left_anti")
    spread = slim.withColumn("_key", F.when(F.col("h").isNull(), F.col("line_id")).otherwise(F.xxhash64("place")))
    joined = spread.join(cold, (F.col("_key") == F.col("picked")) & F.col("h").isNull(), "left").where("h is not null or place <> at")
    again = joined.select("place", F.coalesce("hot_near", "near").alias("near"))
    return again.union(later.select("first", F.lit(True))).distinct().select("place.id", "place.row_key", "place.line_no", "near")


def _link_sums(lines: DataFrame, hot: DataFrame, links: DataFrame) -> DataFrame:
    """(id, row_key, n_links) of the rows with linked lines. Every place of a line counts its links."""
    links = links.select(F.col("line_id").alias("picked"), "links")
    # At most HOT_LINES rows; their lines take part in the other join under keys of their own.
    warm = hot.select("picked").join(links, "picked", "left").select(F.col("picked").alias("h"), F.coalesce("links", F.lit(0)).alias("hot_links"))
    rows = lines.select("id", "row_key", "line_id", "place").join(F.broadcast(warm), F.col("line_id") == F.col("h"), "left")
    rows = rows.withColumn("_key", F.when(F.col("h").isNull(), F.col("line_id")).otherwise(F.xxhash64("place")))
    every = rows.join(links, (F.col("_key") == F.col("picked")) & F.col("h").isNull(), "left")
    return every.groupBy("id", "row_key").agg(F.sum(F.coalesce("hot_links", "links", F.lit(0))).alias("n_links"))


def _with_removed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key")), "left")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, links: bool = False) -> DataFrame:
    """One row for each distinct (id, text) row: n_lines, n_removed and n_near (removed, and linked to an earlier different line).

    ``links=True`` adds n_links, the number of other lines that its lines are linked to, each place of a line counted.
    """
    whole = _rows(docs, id_col, text_col).select("id", "row_key", F.size("parts").cast("bigint").alias("n_lines")).distinct()
    lines = _lines(docs, id_col, text_col)
    repeated, hot = _repeated(lines)
    if links:
        found = line_links(lines, hot, edits)
        later = found.where("later").select("line_id", "first")
    else:
        later = later_lines(lines, hot, edits)
    gone = _removed(lines, repeated, hot, later).groupBy(F.col("id").alias("__id"), F.col("row_key").alias("__key")).agg(
        F.count(F.lit(1)).alias("n_removed"), F.count_if("near").alias("n_near"))
    counts = ["n_removed", "n_near"]
    done = _with_removed(whole, gone)
    if links:
        sums = _link_sums(lines, hot, found).select(F.col("id").alias("__id"), F.col("row_key").alias("__key"), "n_links")
        done, counts = _with_removed(done.drop("__id", "__key"), sums), [*counts, "n_links"]
    return done.select(F.col("id").alias(id_col), "n_lines", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts])


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """The documents without their removed lines, all other columns as they were; equal rows lose the same lines.

    A document all of whose worded lines are removed goes; one that never had a worded line stays as it is, and so does a NULL text.
    """
    gone = removed_lines(docs, id_col, text_col, edits).groupBy(F.col("id").alias("__id"), F.col("row_key").alias("__key")).agg(
        F.collect_set("line_no").alias("__gone"))  # lines of one document
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumns({"__own": F.col(id_col), "__hash": F.xxhash64(F.col(id_col), text)})
    rows = rows.join(gone, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key")), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    stays = F.col("__gone").isNull() | F.exists(kept, lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return rows.where(stays).withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
