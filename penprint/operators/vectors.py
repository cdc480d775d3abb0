"""Vector operators.

Vector math that Spark has no built-in for (matrix products) runs in Arrow
batches with NumPy, inside tasks that Spark partitions; everything around it
(grouping, joins, means) stays relational. Every group handed to NumPy is
bounded by a parameter (block width, batch size), never by the data.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions.columns import tokens as token_array
from penprint.operators.indexing import with_dense_index
from penprint.session import cut_lineage

# InfoNCE temperature and the evaluation batch size (authors).
INFO_NCE_TEMPERATURE = 0.07
EVAL_BATCH_AUTHORS = 64
# Vectors per block of the all-pairs product.
COSINE_BLOCK = 1024
# All-pairs products: blocks of the grid, numbers in one block at most, rows and columns multiplied at once.
GRID = 24
BLOCK_NUMBERS = 1 << 22
TILE = 512
HASH_DIM = 64


# ---------------------------------------------------------------- E1: embedding texts

def hash_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token for the hashing embedder: first 32 bits of md5, mod dim."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")


def hashing_embedding(text: Column, dim: int = HASH_DIM) -> Column:
    """Default offline embedder, all JVM side and within the row: tokens counted in ``dim``
    hash buckets, L2-normalised; zeros for a text without tokens."""
    buckets = F.transform(token_array(text), lambda t: hash_bucket(t, dim))

    def counted(b: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(b) - F.size(F.array_remove(b, d)))
        return F.transform(F.array(counts), lambda c: F.transform(F.array(F.sqrt(F.aggregate(
            c, F.lit(0.0), lambda a, x: a + x * x))), lambda norm: F.transform(
                c, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))[0])[0]

    return F.transform(F.array(buckets), counted)[0]


# what a named model wants in front of a text, unless its registration says otherwise.
PREFIXES = {"hashing": "", "nomic": "", "e5": "passage: "}
# Texts that a model sees at once, unless its registration says otherwise.
EMBED_BATCH = 512

Model = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    """How to get a model, texts -> float32 [n, d]. ``build`` runs once in each Python worker."""

    build: Callable[[], Model]
    prefix: str = ""
    batch_size: int = EMBED_BATCH
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


# Encoders by name: an Embedder, or a plain function; registered by whoever has the weights.
EMBEDDERS: dict[str, Embedder | Model] = {}
_models: dict[str, Model] = {}


def register_embedder(name: str, build: Callable[[], Model], prefix: str | None = None,
                      batch_size: int = EMBED_BATCH) -> None:
    EMBEDDERS[name] = Embedder(build, PREFIXES.get(name, "") if prefix is None else prefix, batch_size)


def _embedder(given: str | Embedder | Model | None) -> Embedder | None:
    """The model asked for; None for the built-in hashing embedder. A name without a model is an error."""
    if given is None or (given == "hashing" and "hashing" not in EMBEDDERS):
        return None
    prefix = ""
    if isinstance(given, str):
        if given not in EMBEDDERS:
            raise ValueError(f"no model is registered for embedder {given!r}")
        prefix, given = PREFIXES.get(given, ""), EMBEDDERS[given]
    return given if isinstance(given, Embedder) else Embedder(lambda model=given: model, prefix)


def _model(embedder: Embedder) -> Model:
    """The worker's copy of the model, built at its first use."""
    if embedder.token not in _models:
        _models[embedder.token] = embedder.build()
    return _models[embedder.token]


def width_of(vectors: DataFrame, embedding: str = "embedding") -> int | None:
    """Length of the vectors, from one row; None for an empty table."""
    row = vectors.select(F.size(embedding).alias("w")).where("w >= 0").first()
    return row["w"] if row else None


def of_width(embedding: Column, width: int | Column) -> Column:
    """The vector itself; the job fails where its length is another one."""
    width = width if isinstance(width, Column) else F.lit(width)
    message = F.concat(F.lit("embeddings of different widths: "), F.concat_ws(" and ", F.size(embedding), width))
    return F.when(embedding.isNull() | (F.size(embedding) == width), embedding).otherwise(F.raise_error(message))


def embedder_width(docs: DataFrame, text: str = "text", embedder: str | Embedder | Model | None = None,
                   dim: int = HASH_DIM) -> int | None:
    """Width of an embedder's vectors: the hashing embedder's ``dim``, or a model's, from one text."""
    chosen = _embedder(embedder)
    if chosen is None:
        return dim
    one = docs.select(F.col(text).alias("_sample")).limit(1)
    return width_of(embed_texts(one, [], "_sample", chosen, batch_size=1, width=0))


def embed_texts(docs: DataFrame, keys: list[str], text: str = "text",
                embedder: str | Embedder | Model | None = None, dim: int = HASH_DIM,
                batch_size: int | None = None, width: int | None = None) -> DataFrame:
    """One embedding per row: (keys..., embedding); rows of equal keys stay apart.

    ``embedder`` is an Embedder, a function from texts to a float32 [n, d]
    array, or the name of one in EMBEDDERS; its prefix is put before every
    text. A name without a registered model is an error; None and "hashing"
    are the JVM-side hashing embedder of ``dim`` numbers.

    A model is built once in each Python worker and sees ``batch_size`` texts
    at a time (the last ones of a task may be fewer), whatever the size of
    Spark's Arrow batches. The vectors' ``width`` is taken from a sample of
    one text if it is not given; an array of another shape fails the job.
    """
    chosen = _embedder(embedder)
    prefix = chosen.prefix if chosen else ""
    src = docs.select(*keys, F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    if chosen is None:
        return src.select(*keys, hashing_embedding(F.col("_t"), dim).alias("embedding"))
    size = batch_size or chosen.batch_size
    schema = T.StructType([f for f in src.schema.fields if f.name != "_t"]
                          + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    width = embedder_width(docs, text, chosen) if width is None else width

    def embed(rows: pa.Table) -> pa.RecordBatch:
        found = np.asarray(_model(chosen)(rows["_t"].to_pylist()), dtype=np.float32)
        if found.ndim != 2 or found.shape[0] != len(rows) or (width and width != found.shape[1]):
            raise ValueError(f"{len(rows)} texts gave an array of shape {found.shape}; vectors have {width or '?'} numbers")
        flat = pa.array(np.ascontiguousarray(found).ravel())
        lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * found.shape[1], flat)
        columns = [rows[k].combine_chunks() for k in keys] + [lists]
        return pa.RecordBatch.from_arrays(columns, [*keys, "embedding"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            full = len(held) - len(held) % size
            for at in range(0, full, size):
                yield embed(held.slice(at, size))
            held = held.slice(full)
        if held is not None and len(held):
            yield embed(held)

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------- A18: persona means

def mean_embedding(vectors: DataFrame, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """Element-wise mean per key, long form (keys..., pos, value).

    posexplode + groupBy(keys, pos).avg: partial aggregation before the
    shuffle, so a key with many vectors is combined map-side.
    """
    long = vectors.select(*keys, F.posexplode(embedding).alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


# Numbers of a vector averaged by one aggregate; wider vectors are cut into such slices.
SLICE = 64


def persona_embeddings(doc_vectors: DataFrame, keys: list[str], width: int | None = None,
                       embedding: str = "embedding") -> DataFrame:
    """E2 "average posts": mean of a persona's document vectors, combined map-side.

    The width is the vectors' own, from a sample if it is not given; a vector
    of another length fails the job. Wide vectors are averaged slice by slice.
    """
    width = width or width_of(doc_vectors, embedding) or 1

    def means(part: Column, n: int) -> Column:
        return F.array(*[F.avg(F.get(part, F.lit(i)).cast("double")) for i in range(n)])

    vector = of_width(F.col(embedding), width)
    if width <= SLICE:
        return doc_vectors.select(*keys, vector.alias("_v")).groupBy(*keys).agg(means(F.col("_v"), width).alias("embedding"))
    starts = F.sequence(F.lit(1), F.lit(width), F.lit(SLICE))
    parts = doc_vectors.select(*keys, vector.alias("_v")).select(*keys, F.posexplode(F.transform(
        starts, lambda at: F.slice(F.col("_v"), at, SLICE))).alias("_n", "_p"))
    sliced = parts.groupBy(*keys, "_n").agg(means(F.col("_p"), SLICE).alias("_p"))
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_p")))
    return sliced.groupBy(*keys).agg(F.slice(F.flatten(F.transform(ordered, lambda x: x["_p"])), 1, width).alias("embedding"))


def cached_or_computed(requested: DataFrame, cache: DataFrame, keys: list[str],
                       compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take the precomputed embedding when present, compute only the rest."""
    known = cache.select(*keys, F.col("embedding").cast("array<double>").alias("embedding"))
    hit = known.join(requested.select(*keys), keys, "left_semi")
    miss = requested.join(cache.select(*keys), keys, "left_anti")
    return hit.unionByName(compute(miss).select(*keys, F.col("embedding").cast("array<double>").alias("embedding")))


# ---------------------------------------------------------------- M7: projection

def project(vectors: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], embedding: str = "embedding",
            out: str = "embedding") -> DataFrame:
    """M7: apply Linear, or Linear -> ReLU -> Linear, to every vector.

    ``layers`` is a list of (weight [out, in], bias [out]) pairs; the weights
    are a model parameter (broadcast with the function), applied to Arrow
    batches of vectors with one matrix product per batch.
    """
    mats = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(col: pd.Series) -> pd.Series:
        if len(col) == 0:
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in col])
        for n, (w, b) in enumerate(mats):
            x = x @ w.T + b
            if n < len(mats) - 1:
                x = np.maximum(x, 0.0)
        return pd.Series(list(x))
    return vectors.withColumn(out, apply(F.col(embedding)))


# ---------------------------------------------------------------- J9: all-pairs cosine

@dataclass
class CosineBlock:
    """The similarities of one tile of a block product. Cells that are no pair, or hold a zero vector, are NaN."""

    sim: np.ndarray                       # [a, b]
    match: tuple[np.ndarray, np.ndarray]  # cells of two personas of one author
    left: tuple[np.ndarray, np.ndarray]   # author and slot of the rows
    right: tuple[np.ndarray, np.ndarray]  # author and slot of the columns
    diagonal: bool                        # rows and columns are the same vectors; only cells above the diagonal count
    whole: bool = False                   # no cell is NaN

    @cached_property
    def _by_label(self) -> dict[int, np.ndarray]:
        if self.whole:
            flat = self.sim.ravel()
            cells = np.ravel_multi_index(self.match, self.sim.shape)
            return {0: np.delete(flat, cells) if len(cells) else flat, 1: flat[cells]}
        other = self.sim.copy()
        other[self.match] = np.nan
        matched = self.sim[self.match]
        return {0: other[~np.isnan(other)], 1: matched[~np.isnan(matched)]}

    def values(self, label: int) -> np.ndarray:
        """All similarities of label 1 (two personas of one author) or 0 (of two authors)."""
        return self._by_label[label]

    def cells(self, label: int, wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the label's cells whose similarity is ``wanted``."""
        if label:
            keep = wanted(self.sim[self.match])
            return self.match[0][keep], self.match[1][keep]
        found = wanted(self.sim)
        found[self.match] = False
        return np.nonzero(found)


def _tiles(table: pa.Table) -> Iterator[CosineBlock]:
    """The product of one block pair, ``TILE`` x ``TILE`` similarities at a time."""
    side = table["side"].to_numpy()
    diag = table["bi"][0].as_py() == table["bj"][0].as_py()
    a = np.flatnonzero(side == 0)
    b = a if diag else np.flatnonzero(side == 1)
    lists = table["embedding"].combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(side), -1)
    norm = np.linalg.norm(x, axis=1)
    author = table["author"].combine_chunks().dictionary_encode()
    code, slot = author.indices.to_numpy(zero_copy_only=False), table["slot"].to_numpy()
    names = author.dictionary.to_numpy(zero_copy_only=False)
    for i in range(0, len(a), TILE):
        for j in range(i if diag else 0, len(b), TILE):
            one, two = a[i:i + TILE], b[j:j + TILE]
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = x[one] @ x[two].T
                sim /= np.outer(norm[one], norm[two])
            same = diag and i == j
            whole = not same and bool(np.isfinite(sim.sum()))
            if not whole:
                sim[~np.isfinite(sim)] = np.nan
            match = np.nonzero(code[one][:, None] == code[two])
            if same:
                sim[np.tril_indices(len(one))] = np.nan
                upper = match[0] < match[1]
                match = match[0][upper], match[1][upper]
            yield CosineBlock(sim, match, (names[code[one]], slot[one]), (names[code[two]], slot[two]), same, whole)


@dataclass(frozen=True)
class Blocked:
    """Vectors dealt to the blocks of the all-pairs grid: (author, slot, embedding, blk)."""

    rows: DataFrame
    n: int


def blocked(vectors: DataFrame, author: str = "author", slot: str = "slot", block: int = COSINE_BLOCK,
            keep: bool = False) -> Blocked:
    """Deal vectors to ``GRID`` blocks: fewer if they would hold less than ``block`` vectors, more if one would hold more
    than ``BLOCK_NUMBERS`` numbers. ``keep`` writes them out for several products."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n = min(math.ceil(size.n / block), max(GRID, math.ceil(size.n * max(size.width or 1, 1) / BLOCK_NUMBERS)))
    return _dealt(vectors, author, slot, max(1, n), keep)


def _dealt(vectors: DataFrame, author: str, slot: str, n: int, keep: bool = False) -> Blocked:
    # Floats stay floats until they are multiplied.
    number = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    rows = vectors.select(F.col(author).cast("string").alias("author"), F.col(slot).cast("int").alias("slot"),
                          F.col("embedding").cast(f"array<{number}>").alias("embedding"),
                          F.pmod(F.xxhash64(author, slot), F.lit(n)).cast("int").alias("blk")).where("embedding is not null")
    if n > 1:  # Every vector becomes n rows, so a task of the product's input takes few.
        rows = rows.repartition(4 * n, "author", "slot")
    return Blocked(cut_lineage(rows) if keep else rows, n)


def cosine_blocks(vectors: DataFrame | Blocked, reduce: Callable[[Iterator[CosineBlock]], pa.Table], schema: str,
                  author: str = "author", slot: str = "slot", block: int = COSINE_BLOCK) -> DataFrame:
    """Reduce every block of the all-pairs cosine matrix inside the task that computes it.

    Block grid: vectors are hashed into n blocks; each vector is replicated
    to the n block pairs (I <= J) it takes part in; a block pair is one task,
    which multiplies tile by tile. n does not grow with the number of vectors
    (see ``blocked``), so what is shuffled grows as the vectors do. ``reduce``
    sees the similarities of all tiles (label 1 for the two personas of one
    author) and returns a few rows, so the pairs themselves are never written
    or shuffled.
    """
    grid = vectors if isinstance(vectors, Blocked) else blocked(vectors, author, slot, block)
    return _block_pairs(grid).applyInArrow(lambda table: reduce(_tiles(table)), schema)


def _block_pairs(grid: Blocked) -> GroupedData:
    """Every vector at each of the n block pairs it takes part in, grouped by block pair."""
    other = F.explode(F.sequence(F.lit(0), F.lit(grid.n - 1))).alias("_other")
    sides = grid.rows.select("author", "slot", "embedding", "blk", other).select(
        "author", "slot", "embedding", F.least("blk", "_other").alias("bi"), F.greatest("blk", "_other").alias("bj"),
        F.when(F.col("blk") <= F.col("_other"), 0).otherwise(1).alias("side"))
    return sides.repartition(grid.n * (grid.n + 1) // 2, "bi", "bj").groupBy("bi", "bj")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of one block pair, a tile at a time."""
    for b in _tiles(pa.Table.from_batches(list(batches))):
        label = np.zeros(b.sim.shape, np.int32)
        label[b.match] = 1
        pair = np.triu(np.ones(b.sim.shape, bool), 1) if b.diagonal else np.ones(b.sim.shape, bool)
        yield pa.RecordBatch.from_pydict({"label": label[pair], "value": b.sim[pair]})


def cosine_all_pairs(vectors: DataFrame | Blocked, author: str = "author", slot: str = "slot",
                     block: int = COSINE_BLOCK) -> DataFrame:
    """All pairs as rows (label, value); the value of a pair with a zero vector is NaN.

    A task hands its pairs on tile by tile, so it holds two blocks of vectors and
    one tile at any number of pairs; what aggregates them next combines them in the
    same task, before any shuffle.
    """
    grid = vectors if isinstance(vectors, Blocked) else blocked(vectors, author, slot, block)
    return _block_pairs(grid).applyInArrow(_pair_rows, "label int, value double")


# ---------------------------------------------------------------- A26/A27: batch metrics

def _batch_metrics(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["idx", "slot"])
    n = len(pdf) // 2
    first = pdf[pdf["slot"] == 0]
    second = pdf[pdf["slot"] == 1]
    # Rows: persona 0 of every author, then persona 1 of every author; partner is n rows away.
    x = np.stack([np.asarray(v, dtype=np.float64) for v in list(first["embedding"]) + list(second["embedding"])])
    norms = np.linalg.norm(x, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (x @ x.T) / np.outer(norms, norms)
    m = len(x)
    sim = sim / pdf["_tau"].iat[0]
    partner = (np.arange(m) + n) % m
    pos = sim[np.arange(m), partner]
    masked = sim.copy()
    np.fill_diagonal(masked, -np.inf)
    top = masked.max(axis=1, keepdims=True)
    lse = top[:, 0] + np.log(np.exp(masked - top).sum(axis=1))
    loss = -pos + lse
    others = masked.copy()
    others[np.arange(m), partner] = -np.inf
    rank = 1 + (others > pos[:, None]).sum(axis=1)
    authors = list(first["author"]) + list(second["author"])
    slots = [0] * n + [1] * n
    return pd.DataFrame({"batch": int(pdf["batch"].iat[0]), "author": authors, "slot": slots,
                         "loss": loss, "rank": rank.astype("int64")})


def batch_rows(pairs: DataFrame, author: str = "author", slot: str = "slot", batch_authors: int = EVAL_BATCH_AUTHORS,
               temperature: float = INFO_NCE_TEMPERATURE) -> DataFrame:
    """Per persona row of an evaluation batch: InfoNCE loss term and rank of its partner.

    Authors (each with slots 0 and 1) are numbered by name and cut into
    batches of ``batch_authors`` (the last one may be partial); each batch is
    one bounded NumPy problem of 2B x 2B similarities.
    """
    # An author must have the two slots 0 and 1, once each; otherwise the job fails.
    message = F.concat(F.lit("author without exactly two personas (slots 0 and 1): "), F.col(author).cast("string"))
    whole = pairs.groupBy(author).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_set(slot)).alias("_slots"))
    whole = whole.select(F.when((F.col("_n") == 2) & (F.col("_slots") == F.array(F.lit(0), F.lit(1))), F.col(author))
                         .otherwise(F.raise_error(message)).alias(author))
    authors = with_dense_index(whole, [author])
    tagged = pairs.join(authors, author).withColumn("batch", (F.col("idx") / F.lit(batch_authors)).cast("bigint"))
    tagged = tagged.withColumn("_tau", F.lit(float(temperature)))
    schema = "batch bigint, author string, slot int, loss double, rank bigint"
    return tagged.select(F.col(author).cast("string").alias("author"), F.col(slot).alias("slot"), "embedding", "idx", "batch", "_tau") \
        .groupBy("batch").applyInPandas(_batch_metrics, schema)


def info_nce(rows: DataFrame) -> DataFrame:
    """Mean InfoNCE loss per batch (mean of its 2B rows)."""
    return rows.groupBy("batch").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_rows"))


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """A27 (over all rows): top-1, top-5 and mean position of the positive."""
    return rows.agg(F.avg((F.col("rank") == 1).cast("double")).alias("top1"),
                    F.avg((F.col("rank") <= 5).cast("double")).alias("top5"),
                    F.avg(F.col("rank").cast("double")).alias("mean_position"),
                    F.count(F.lit(1)).alias("n_rows"))
