"""Global positions and the pairings built on them.

A global dense index is a sort, so it is done the distributed way: range
partition + sort within partitions, count rows per partition (one row per
partition reaches the driver side of the plan), then add each partition's
offset. The tagged rows are checkpointed to the shared folder so both uses of
them see exactly the same rows, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.session import cut_lineage

# Fixed value: seed of the derangement pairing.
DERANGEMENT_SEED = 424242


def with_dense_index(df: DataFrame, order: list[Column | str], name: str = "idx",
                     num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position by ``order`` (must be a total order on the rows)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    tagged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    tagged = cut_lineage(tagged)
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window over it is tiny and bounded by the partition count.
    offsets = per_part.select(
        "_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))


def at_index(indexed: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """The row at position n of a dense index."""
    return indexed.where(F.col(idx) == n)


def following_pairs(indexed: DataFrame, key: str, idx: str = "idx", ahead: int = 4) -> DataFrame:
    """Each position i with positions i+1 .. i+ahead (when they exist).

    An explode of a fixed-length sequence followed by an equi-join on the
    position: no window and no theta join.
    """
    left = indexed.select(F.col(key).alias(f"{key}_a"), F.col(idx).alias("idx_a"))
    right = indexed.select(F.col(key).alias(f"{key}_b"), F.col(idx).alias("idx_b"))
    wanted = left.select("*", F.explode(F.sequence(F.col("idx_a") + 1, F.col("idx_a") + ahead)).alias("idx_b"))
    return wanted.join(right, "idx_b").select(f"{key}_a", f"{key}_b", "idx_a", "idx_b")


def derangement_order(key: str | Column, seed: int = DERANGEMENT_SEED) -> Column:
    """Seeded pseudo-random order of a key: sha2(seed ':' key)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), k.cast("string")), 256)


def derangement_pairs(keys: DataFrame, key: str, seed: int = DERANGEMENT_SEED) -> DataFrame:
    """Pair every key with another one, no key with itself.

    Keys are put in a seeded hash order and position i is paired with
    position (i + 1) mod n: a derangement for n >= 2. It is deterministic and
    identical in any engine with sha256, but it is neither uniform over all
    derangements nor NumPy's permutation. One key cannot be deranged: error.
    """
    distinct = keys.select(key).distinct()
    indexed = with_dense_index(distinct.withColumn("_h", derangement_order(key, seed)), ["_h", key])
    n = indexed.count()
    if n < 2:
        raise ValueError(f"a derangement needs at least two keys, got {n}")
    left = indexed.select(F.col(key).alias(f"{key}_a"), F.col("idx").alias("idx_a"),
                          ((F.col("idx") + 1) % F.lit(n)).alias("idx_b"))
    right = indexed.select(F.col(key).alias(f"{key}_b"), F.col("idx").alias("idx_b"))
    return left.join(right, "idx_b").select(f"{key}_a", f"{key}_b", "idx_a", "idx_b")
