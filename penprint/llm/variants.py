"""Spelling variants of words: dense prefix-suffix tiling.

Two words are one edit apart (one code point inserted, deleted or replaced)
exactly when the length of their common prefix plus that of their common
suffix, which may not overlap in the shorter word, reaches the longer length
minus one. Words are laid out as padded code-point matrices, once from the
left and once from the right, and blocks of rows are compared pair by pair.

Which blocks meet: let m be the shorter length and cut it into ``SEGMENTS``
parts. The first differing place lies in one part, so the words agree in
all that stands before this part, counted from the left, and in all that
stands behind it, counted from the right. Words are dealt by (m, part, what
stands before, what stands behind); a pair is reported for the one part that
holds its first difference, hence once. No pair is lost and none outside a key
is compared. A key with many words is cut into parts of bounded rows and
bytes, and every two parts meet in a tile of their own; only near pairs leave
a tile. Links and counts are then combined by grouping with map-side partials.

A word's form is its near word of largest count (ties: the first in code-point
order) if that count is at least ``RATIO`` times its own; counts rise along
forms, so following them ends, by pointer doubling over written tables.

Defined cases: a null text has no words; a null id counts as an empty one; an
empty table gives an empty result; repeated rows count each; a word of any
length is compared whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.tables import stored

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
# A letter of every DAMAGED-th run, by checksum, is deleted before words are counted.
DAMAGED = 199
SEGMENTS = 3
# A key's words are cut into parts of at most about so many rows and code points.
TILE_ROWS = 2048
TILE_CHARS = 1 << 18
# Tiles up to this many rows are compared row against shifted row, all at once.
SMALL = 48
CELLS = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, id_: Column, every: int = DAMAGED) -> Column:
    """The run without its code point crc32 % length, where ``every`` divides the crc32 of ``id:run``."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters, some damaged, with enough code points and occurrences."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(
        F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(LETTERS), F.lit(0)),
        lambda r: F.length(r) >= min_length)).alias("run"))
    return (runs.select(damaged(F.col("run"), F.col("id")).alias("word"))
            .where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _keys(words: DataFrame, min_length: int) -> DataFrame:
    """(m, segment, key, word, n): where a word may meet words of its length or one less (as shorter, as longer)."""
    size = F.length("word")
    at = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= min_length)
    at = at.select("word", "n", "m", F.explode(F.array(*[F.lit(s) for s in range(SEGMENTS)])).alias("segment"))
    before = F.expr(f"substr(word, 1, (m * segment) div {SEGMENTS})")
    behind = F.expr(f"right(word, m - (m * (segment + 1)) div {SEGMENTS})")
    return at.select("m", "segment", F.xxhash64("m", "segment", before, behind).alias("key"), "word", "n")


def _tiles(keys: DataFrame) -> DataFrame:
    """Rows of every tile (key, i, j): parts i and j of a key's words; ``mine`` is the row's own part."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("word")).alias("chars"))
    sizes = sizes.where("rows > 1").select("key", F.expr(
        f"cast(least(rows, greatest(ceil(rows / {TILE_ROWS}), ceil(chars / {TILE_CHARS}))) as int)").alias("parts"))
    rows = keys.join(sizes, "key").withColumn("mine", F.expr("cast(pmod(xxhash64(word, 13), parts) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("m", "segment", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                       "mine", "word", "n")


def _matrix(words: list[str], width: int) -> np.ndarray:
    out = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first differing column of each row; the width where rows are equal."""
    differs = a != b
    first = differs.argmax(axis=-1)
    return np.where(np.take_along_axis(differs, first[..., None], -1)[..., 0], first, differs.shape[-1])


class _Block:
    """Words of lengths m and m + 1, aligned left and right."""

    def __init__(self, words: list[str], m: int):
        self.m = m
        self.left, self.right = _matrix(words, m + 1), _matrix([w[::-1] for w in words], m + 1)
        self.size = np.fromiter(map(len, words), np.int64, len(words))

    def near(self, a: np.ndarray, b: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Positions of the row pairs (a, b) that are one edit apart with the first difference inside ``segment``."""
        sizes = self.size[a], self.size[b]
        keep = np.flatnonzero(np.minimum(*sizes) == self.m)
        prefix = np.minimum(_first_difference(self.left[a[keep]], self.left[b[keep]]), self.m)
        place = np.minimum(prefix, self.m - 1)
        part = segment[keep]
        inside = (place >= self.m * part // SEGMENTS) & (place < self.m * (part + 1) // SEGMENTS)
        keep, prefix = keep[inside], prefix[inside]
        suffix = np.minimum(_first_difference(self.right[a[keep]], self.right[b[keep]]), self.m - prefix)
        return keep[prefix + suffix >= np.maximum(sizes[0][keep], sizes[1][keep]) - 1]


def _compare(words: list[str], m: int, segment: np.ndarray, start: np.ndarray, mine: np.ndarray, cross: np.ndarray
             ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (row, row) inside the tiles that begin at ``start``; ``cross`` tiles compare two parts only."""
    block = _Block(words, m)
    end = np.append(start[1:], len(words))
    tile = np.repeat(np.arange(len(start)), end - start)
    size = end - start
    small = size <= SMALL
    rows = np.flatnonzero(small[tile])
    for shift in range(1, int(size[small].max(initial=0))):
        a = rows[rows + shift < end[tile[rows]]]
        b = a + shift
        meet = ~cross[tile[a]] | (mine[a] != mine[b])
        a, b = a[meet], b[meet]
        found = block.near(a, b, segment[a])
        yield a[found], b[found]
    side = max(1, int((CELLS // (m + 1)) ** 0.5))
    for t in np.flatnonzero(~small).tolist():
        lo, hi = int(start[t]), int(end[t])
        # Rows of a cross tile are sorted by part: the first part's rows meet the second's.
        middle = lo + int(np.searchsorted(mine[lo:hi], mine[lo], side="right")) if cross[t] else hi
        for u in range(lo, middle, side):
            first = np.arange(u, min(u + side, middle))
            for v in range(middle if cross[t] else u, hi, side):
                second = np.arange(v, min(v + side, hi))
                a, b = np.repeat(first, len(second)), np.tile(second, len(first))
                if v == u and not cross[t]:
                    a, b = a[a < b], b[a < b]
                found = block.near(a, b, segment[a])
                yield a[found], b[found]


def _near_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs of whole tiles, sorted by (m, segment, key, i, j, mine)."""
    table = table.combine_chunks()
    column = {c: table[c].to_numpy() for c in ("m", "segment", "key", "i", "j", "mine", "n")}
    same = np.ones(len(table), bool)
    for c in ("m", "segment", "key", "i", "j"):
        same[1:] &= column[c][1:] == column[c][:-1]
    same[0] = False
    starts = np.flatnonzero(~same)
    ends = np.append(starts[1:], len(table))
    t = 0
    while t < len(starts):
        m = int(column["m"][starts[t]])
        last = t + 1
        while last < len(starts) and column["m"][starts[last]] == m and (ends[last] - starts[t]) * (m + 1) <= CELLS:
            last += 1
        lo, hi = int(starts[t]), int(ends[last - 1])
        words = table["word"].slice(lo, hi - lo).to_pylist()
        n = column["n"][lo:hi]
        begin = starts[t:last]
        found = list(_compare(words, m, column["segment"][lo:hi], begin - lo, column["mine"][lo:hi],
                              column["i"][begin] != column["j"][begin]))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        if len(a):
            texts = pa.array(words, pa.string())
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(a)), pa.array(n[a]), texts.take(pa.array(b)),
                                              pa.array(n[b])], ["a", "n_a", "b", "n_b"])
        t = last


def _near_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works through a sorted partition; only the tile not yet complete is held back."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        same = np.ones(len(table), bool)
        for c in ("m", "segment", "key", "i", "j"):
            values = table[c].to_numpy()
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = table.slice(cut)
        if cut:
            yield from _near_in(table.slice(0, cut))
    if rest is not None:
        yield from _near_in(rest)


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart, once. ``words`` has distinct words and their n."""
    tiles = _tiles(_keys(words, min_length))
    order = ["m", "segment", "key", "i", "j", "mine"]
    return (tiles.repartition("key", "i", "j").sortWithinPartitions(*order)
            .mapInArrow(_near_stream, "a string, n_a bigint, b string, n_b bigint"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer doubling."""
    table = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        table = stored(table.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if table.where("moved").isEmpty():
            return table.select("word", "root")
        table = table.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n; words distinct and long enough)."""
    words = stored(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    pairs = near_pairs(words, min_length)
    links = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("l"))
    near = links.groupBy("l.word").agg(F.count(F.lit(1)).alias("n_near"),
                                       F.min(F.struct((-F.col("l.near_n")).alias("down"), "l.near")).alias("top"))
    takes = -F.col("top.down") >= ratio * F.col("n")
    graded = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("top.near")).alias("form"), F.when(takes, -F.col("top.down")).alias("form_n")), "graded")
    roots = _roots(graded.where("form is not null"))
    return (graded.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of ``docs`` with their forms and roots."""
    return group_variants(word_counts(docs, id_col, text_col))
