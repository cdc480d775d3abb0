"""Sharding along a Hilbert curve, for file pruning in several dimensions at once.

Every dimension (strings and numbers by their whole values) is quantised
into 2^BITS bins of about equal rows; the bins' Hilbert index orders the rows
so that neighbours on the curve agree in all dimensions, and the curve is cut
into runs of equal length. Law ``rows``: shard sizes differ by one row at most.
The order is total (curve, text checksum, id, size), so a bin that holds a
third of all rows is simply cut in the middle; equal texts of one bin stand
together. Positions come from a distributed sort with per-partition offsets.

Defined cases: null values of a dimension go to its first bin; a null text has
size 1 and checksum 0; a null id comes first among its ties; repeated rows get
a place each; an empty table gives an empty result; other columns are ignored
by ``assign`` and kept by ``write_ordered``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from penprint.llm.tables import stored
from penprint.operators.indexing import with_dense_index

BITS = 5
SHARDS = 8
DIMENSIONS = ("lang", "source", "n_chars")


def hilbert_index(bins: np.ndarray, bits: int) -> np.ndarray:
    """Position of every cell (one row of ``bins``) on the Hilbert curve of a grid with 2^bits cells a side.

    Walks from the coarsest bit to the finest, undoing the reflection and
    exchange of axes that each finer curve goes through, then reads the
    Gray-coded bits axis by axis.
    """
    x = bins.astype(np.int64).copy()
    axes = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for a in range(axes):
            turned = (x[:, a] & bit) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, a]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, a] ^= swap
        bit >>= 1
    for a in range(1, axes):
        x[:, a] ^= x[:, a - 1]
    flip = np.zeros(len(x), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[:, -1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for a in range(axes):
            out = out << 1 | (x[:, a] >> b & 1)
    return out


def _value_limits(docs: DataFrame, column: str, bins: int) -> list[str]:
    """The whole values at which the column's sorted rows pass each of ``bins`` equal shares, the last one left out."""
    counts = (docs.select(F.col(column).cast("string").alias("value")).where("value is not null")
              .groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    runs = stored(counts.repartitionByRange("value").withColumn("run", F.spark_partition_id()), "values")
    before, total = {}, 0
    for run, n, _ in sorted(map(tuple, runs.groupBy("run").agg(F.sum("n"), F.min("value").alias("low")).collect()),
                            key=lambda r: r[2]):
        before[run], total = total, total + n
    if not total:
        return []
    offset = F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair])[F.col("run").cast("bigint")]
    window = Window.partitionBy("run").orderBy("value")
    passed = (runs.withColumn("upto", F.sum("n").over(window) + offset)
              .select("value", F.expr(f"((upto - n) * {bins}L) div {total}L").alias("low"),
                      F.expr(f"(upto * {bins}L) div {total}L").alias("high")).where("high > low").collect())
    return sorted(r.value for r in passed for k in range(r.low + 1, r.high + 1) if k < bins)


def curve(docs: DataFrame, dimensions=DIMENSIONS, bits: int = BITS) -> Column:
    """Hilbert index of each row; the bins' limits are quantiles over all rows."""
    numeric = [isinstance(docs.schema[d].dataType, NumericType) for d in dimensions]
    codes = [F.col(d).cast("double" if n else "string") for d, n in zip(dimensions, numeric, strict=True)]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = iter(docs.agg(F.count(F.lit(1)), *[F.percentile_approx(c, shares, 10_000)
                                               for c, n in zip(codes, numeric, strict=True) if n]).first()[1:])
    limits = [np.array(next(found) or [], np.float64) if n else np.array(_value_limits(docs, d, 1 << bits), object)
              for d, n in zip(dimensions, numeric, strict=True)]

    @F.pandas_udf("bigint")
    def index(frame: pd.DataFrame) -> pd.Series:
        bins = np.zeros((len(frame), len(limits)), np.int64)
        for k, limit in enumerate(limits):
            known = frame.iloc[:, k].notna().to_numpy()
            values = frame.iloc[:, k].to_numpy()[known]
            bins[known, k] = np.searchsorted(limit, values.astype(limit.dtype), side="left")
        return pd.Series(hilbert_index(bins, bits))

    return index(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(codes)]))


def assign(docs: DataFrame, shards: int = SHARDS, dimensions=DIMENSIONS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), curve(docs, dimensions).alias("curve"))
    placed = with_dense_index(rows, ["curve", "text_crc32", "id", "size"], "position")
    total = placed.count()
    # position * shards / total in whole numbers.
    shard = F.expr(f"cast((position * {shards}L) div {max(total, 1)}L as int)")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("position") - first).cast("bigint").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_ordered(docs: DataFrame, path: str, files: int, dimensions=DIMENSIONS, bits: int = BITS) -> None:
    """Write ``docs`` as Parquet files that each hold one run of the curve, so min/max statistics prune them."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        curve(docs, dimensions, bits).alias("curve"), F.xxhash64(F.struct(*docs.columns)).alias("tie"))
    (keyed.repartitionByRange(files, "curve", "tie").sortWithinPartitions("curve", "tie").select("row.*")
     .write.parquet(path))
