"""Near-duplicate documents by min-max hashing.

Words are A-Z folded runs outside white space; a document's set holds its
distinct 5-word shingles (the whole sequence when it has fewer words). Under
each of 60 permutations both the smallest and the largest image are kept: 120
unbiased values from 60 evaluations. They are cut into 24 bands of 5, or for a
threshold below ``PERCENT`` into bands short enough: two sets at the threshold
share no band with probability below 1e-6 (0.85: 24 bands of 5; 0.8: 30 of 4).

Equal sets form one class before anything is compared, so copies cost nothing.
Classes that share a band meet in groups of bounded size (a larger bucket is
cut into parts and every pair of parts meets in a task of its own). A group
indexes the rarest shingles of each set and confirms links on the full sets;
only the links that connect something new leave it, never all pairs.

Defined cases: null, empty or white-space-only text has an empty set, is linked
with nothing and always stays; rows with a null id take part, and their group
is named by its smallest id that is not null (null if there is none); repeated
rows share a class; an empty table gives an empty result; other columns are
ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.tables import components, stored
from penprint.llm.words import hashed_words, inside_texts, mix, release, rolling

WIDTH = 5
# A link needs 100 * intersection >= percent * union; PERCENT unless the caller says otherwise.
PERCENT = 85
PERMUTATIONS, BANDS = 60, 24
# Probability, at most, that two sets at the threshold share no band.
MISS = 1e-6
# Shingles of one part of a bucket; a task holds two parts.
PART_SHINGLES = 1 << 16

_rng = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]


@cache
def _band_factors(bands: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([77, bands]))
    return rng.integers(1, 1 << 63, (bands, 1 + 2 * PERMUTATIONS // bands), dtype=np.uint64)


def bands_for(percent: int) -> int:
    """The fewest bands, BANDS at least, that miss two sets at the threshold with probability below MISS."""
    values = 2 * PERMUTATIONS
    for bands in range(BANDS, values + 1):
        if values % bands == 0 and (1 - (percent / 100) ** (values // bands)) ** bands < MISS:
            return bands
    raise ValueError(f"no bands of {values} values find sets at {percent} % of similarity")


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, offsets = hashed_words(texts, fold=True)
    runs = rolling(words, width)
    for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if to - at >= width:
            yield np.unique(runs[at:to - width + 1])
        elif to > at:
            yield mix(rolling(words[at:to], to - at) + np.uint64(to - at))
        else:
            yield np.zeros(0, np.uint64)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The smallest and the largest image of a set under every permutation of the 32-bit numbers."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = None, None
    for at in range(0, len(x), 1 << 14):
        images = _MULTIPLY * x[None, at:at + (1 << 14)] + _ADD
        a, b = images.min(axis=1), images.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    cut, by = values.reshape(bands, -1).astype(np.uint64), _band_factors(bands)
    return mix((cut * (by[:, 1:] | np.uint64(1))).sum(axis=1, dtype=np.uint64) + by[:, 0])


def set_class(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(batches: Iterator[pa.RecordBatch], n_bands: int = BANDS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            sizes, classes, bands = [], [], []
            for s in shingle_sets(some.column(1)):
                sizes.append(len(s))
                classes.append(set_class(s) if len(s) else None)
                bands.append(band_keys(min_max(s), n_bands).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["id", "digest", "n_shingles", "class", "bands"])
        release()


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of the class a row stands for; a row whose text belongs to another class gives nothing."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            found = [(c, s.tobytes()) for c, s in zip(some.column(0).to_pylist(), shingle_sets(some.column(1)),
                                                      strict=True) if len(s) and set_class(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.binary()),
                                              pa.array([s for _, s in found], pa.binary())], names=["class", "set"])
            del found
        release()


def connect(sets: list[np.ndarray], part: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links that connect the sets of a group as all its links do.

    Two sets this similar share one of their rarest shingles, whatever order
    of rarity is used: only sets that meet there are confirmed, on the full
    sets. Sets already connected are not compared again. If the group holds
    two parts, only links between them are looked for.
    """
    if len(sets) < 2:
        return
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(len(often), bool)
    root = np.arange(len(sets))
    two = bool((part != part[0]).any())
    index: dict[int, list[int]] = {}
    for x in np.lexsort((np.arange(len(sets)), sizes)).tolist():
        mine = np.sort(token[starts[x]:ends[x]])
        rare = mine[:sizes[x] - -(-percent * int(sizes[x]) // 100) + 1].tolist()
        near = {y for t in rare for y in index.get(t, ())}
        if near:
            others = np.fromiter(near, np.int64, len(near))
            others = others[(root[others] != root[x]) & (100 * sizes[others] >= percent * sizes[x])]
            if two:
                others = others[part[others] != part[x]]
            mark[mine] = True
            for at in range(0, len(others), 256):
                some = np.sort(others[at:at + 256])
                some = some[root[some] != root[x]]
                if not len(some):
                    continue
                lens = sizes[some]
                take = np.repeat(starts[some] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
                shared = np.add.reduceat(mark[token[take]].astype(np.int64), np.cumsum(lens) - lens)
                for y in some[100 * shared >= percent * (lens + sizes[x] - shared)].tolist():
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                        yield x, y
            mark[mine] = False
        for t in rare:
            index.setdefault(t, []).append(x)


def confirm(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links of one group of classes (or of two parts of a large bucket)."""
    names = table["class"].to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
    found = list(connect(sets, table["part"].to_numpy(), percent))
    return pa.table({"a": pa.array([names[x] for x, _ in found], pa.binary()),
                     "b": pa.array([names[y] for _, y in found], pa.binary())})


def _grouped(docs: DataFrame, id_col: str, text_col: str, part_shingles: int,
             percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest, n_shingles, class) of every row, and (class, root) of every class."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.md5(F.col(text_col).cast("binary")).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()
    bands = bands_for(percent)
    signed = stored(rows.mapInArrow(
        lambda batches: signatures(batches, bands), f"id {kind}, digest string, n_shingles bigint, class binary, bands array<bigint>"), "signatures")
    classes = stored(signed.where("n_shingles > 0").groupBy("class").agg(
        F.min("id").alias("first_id"), F.min(F.struct("id", "digest")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")),
        "classes")
    banded = classes.select("class", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = (banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"), F.min("class").alias("low"),
        F.max("class").alias("high"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("members"))
        # Buckets of the same classes are worked through once.
        .where("n > 1").groupBy("n", "total", "low", "high", "members").agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.ceil(F.col("total") / part_shingles).cast("int").alias("parts")))
    members = stored(banded.join(buckets, "bucket").select(
        "bucket", "class", "parts", F.pmod(F.xxhash64("class", "bucket"), F.col("parts")).cast("int").alias("part")),
        "members")
    # By id and text: rows without an id meet only the class of their text.
    wanted = members.select("class").distinct().join(classes.select(
        "class", F.col("one.id").alias("one_id"), F.col("one.digest").alias("one_digest")), "class")
    sets = (rows.join(wanted, F.col("id").eqNullSafe(F.col("one_id")) & (F.col("digest") == F.col("one_digest")))
            .select("class", "text")
            .mapInArrow(full_sets, "class binary, set binary").dropDuplicates(["class"]))
    met = members.select("bucket", "class", "part", F.explode(F.expr(
        "transform(sequence(0, parts - 1), j -> struct(least(part, j) as i, greatest(part, j) as j))")).alias("pair"))
    links = (met.select("bucket", "pair.i", "pair.j", "class", "part").join(sets, "class")
             .groupBy("bucket", "i", "j").applyInArrow(lambda table: confirm(table, percent), "a binary, b binary"))
    roots = components(links)
    return signed, classes.select("class", "first_id").join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "first_id", F.coalesce("root", "class").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    part_shingles: int = PART_SHINGLES, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    signed, classes = _grouped(docs, id_col, text_col, part_shingles, percent)
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "root").select("class", "component_id")
    alone = signed.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    linked = signed.where("n_shingles > 0").join(named, "class").select("id", "n_shingles", "component_id")
    return linked.unionAll(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id",
                                         F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_shingles: int = PART_SHINGLES, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, and every row without words.

    The row with the group's smallest id stays (a null id only if there is no
    other); among several rows of that id the one with the smallest text
    digest, and of equal rows one.
    """
    def key(id_value, digest):
        return F.concat_ws(":", F.coalesce(id_value.cast("string"), F.lit("null")), digest)

    signed, classes = _grouped(docs, id_col, text_col, part_shingles, percent)
    # The copies of a text come down to one row before the join.
    firsts = signed.where("n_shingles > 0").groupBy("class").agg(
        F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")).alias("leader"))
    leaders = (firsts.join(classes.select("class", "root"), "class").groupBy("root").agg(F.min("leader").alias("leader"))
               .select(key(F.col("leader.id"), F.col("leader.digest")).alias("key")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(
        F.col(id_col), F.md5(F.col(text_col).cast("binary"))).alias("key"), (F.length(F.translate(
            F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\f\r", "")) == 0).alias("empty"))
    stay = (rows.where("not empty").join(leaders, "key")
            .withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("n = 1"))
    return stay.select("row").unionAll(rows.where("empty").select("row")).select("row.*")
