"""Sinks (K1-K14). Every writer is a distributed ``DataFrameWriter`` call.

Fan-out sinks use ``partitionBy`` so that later reads prune partitions. Their
rows are dealt by the partition columns first, so a directory gets a few files of
a good size, not one from every task; adaptive execution splits a directory's
rows by size where they are too many for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.sources import schemas


def _writer(df: DataFrame, mode: str, partition_by: list[str] | None):
    if not partition_by:
        return df.write.mode(mode)
    return df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                 compression: str | None = None) -> None:
    """K1/K3/K4/K7: newline-delimited JSON; readers take compressed files as they are."""
    _writer(df, mode, partition_by).json(path, compression=compression)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    _writer(df, mode, partition_by).parquet(path)


def write_nsfw_flag_object(flags: DataFrame, path: str) -> None:
    """K2, interchange form: one JSON object subreddit -> flag (one record by definition; rows are the form for scale)."""
    entries = F.collect_list(F.struct("subreddit", F.col("flagged").cast("boolean")))
    flags.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)


def write_nsfw_flags(flags: DataFrame, path: str) -> None:
    """K2: (subreddit, flagged) rows."""
    write_ndjson(flags.select("subreddit", F.col("flagged").cast("boolean")), path)


def write_count_csv(counts: DataFrame, path: str) -> None:
    """K6: two columns with a header."""
    counts.write.mode("overwrite").option("header", True).csv(path)


def write_line_list(df: DataFrame, path: str, column: str = "author") -> None:
    """K5: one name per line, sorted (range-partitioned sort, no single task)."""
    df.select(column).distinct().orderBy(column).write.mode("overwrite").text(path)


def write_arms(flat: DataFrame, path: str) -> None:
    """K8: flat author documents (one row per document, column ``arm``), one directory per arm."""
    write_ndjson(flat.select(*schemas.AUTHOR_DOCUMENT.names, "arm"), path, partition_by=["arm"])


def write_day_shards(df: DataFrame, path: str) -> None:
    """K9: one directory per UTC day of month (column ``day``)."""
    write_ndjson(df, path, partition_by=["day"])


def write_token_counts(ranked: DataFrame, path: str) -> None:
    """(rank, token, n)."""
    write_parquet(ranked.select(*[f.name for f in schemas.TOKEN_COUNT.fields]), path)


def write_token_accuracies(ranked: DataFrame, path: str) -> None:
    """(rank, accuracy, token)."""
    write_parquet(ranked.select(*[f.name for f in schemas.TOKEN_ACCURACY.fields]), path)


def write_log_likelihood_model(tokens: DataFrame, path: str) -> None:
    """model_type by name + ordered token list (bounded by the model size)."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.struct(
        F.col("token_index").cast("int").alias("token_index"), F.col("token").alias("string")).alias("t"))))
    model = tokens.agg(ordered.alias("ts")).select(
        F.lit("LOG_LIKELIHOOD_MODEL").alias("model_type"),
        F.struct(F.transform("ts", lambda x: x["t"]).alias("tokens")).alias("model_params"))
    write_ndjson(model.coalesce(1), path)


def write_embedding_model(spark, path: str, embedding_model: str, strategy: str, checkpoint: str) -> None:
    """K12 for embedding models: one parameter row."""
    row = spark.createDataFrame([("EMBEDDING_MODEL", (embedding_model, strategy, checkpoint))],
                                "model_type STRING, model_params STRUCT<embedding_model: STRING, "
                                "embedding_strategy: STRING, embedding_model_checkpoint_path: STRING>")
    write_ndjson(row, path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """One directory per arm."""
    write_parquet(embeddings, path, partition_by=["arm"])


def write_scores(scores: DataFrame, path: str) -> None:
    """Pairs + match_score."""
    write_parquet(scores, path)
