"""Tables that a job reads more than once, and connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, keeps pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``links``; root is the smallest node it is connected with.

    Alternates the large-star and small-star steps until the links are stars.
    Each step is a group minimum (combined map-side) and a join, so a node
    with very many links is never gathered; every round is written out.
    """
    def measure(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # Links point from the larger node to the smaller one.
    table = (links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
             .where(F.col("a") != F.col("b")).distinct())
    table = stored(table, "links")
    before = measure(table)
    while before[0]:
        both = table.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(table.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").where("v != m")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low).distinct())
        table = stored(small, "links")
        after = measure(table)
        if after == before:
            break
        before = after
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        table.select("b", "b").distinct())


def constant_array(table: DataFrame, position: str, value: str, kind: str) -> Column:
    """A table of a fixed number of rows as one constant array, for use inside higher-order functions.

    Only for tables whose size is a parameter (one row per hash bucket).
    """
    text = table.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(position, value))),
                                           lambda x: x[value]))).first()[0]
    return F.from_json(F.lit(text), kind)
