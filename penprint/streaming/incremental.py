"""Incremental cleaning of newly arriving dump files.

The reference has no streaming operator: every input is a finished file. The
one step worth running incrementally is the stateless basic filter (P1-P4),
so new monthly or daily dumps can be cleaned as they land without rereading
old ones. It is the same filter as ``operators.corpus``, run as a Structured
Streaming query over a directory with ``availableNow`` (process what is
there, then stop); the ignore list and the flag table are static joins.
The checkpoint must be a lasting path of the caller's: it remembers which
files are done. A damaged line stops the query, as it stops the batch readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.sources.schemas import RAW_COMMENT, RAW_SUBMISSION, SUBMISSION, COMMENT


def clean_new_submissions(spark: SparkSession, source_dir: str, out_dir: str, ignored: DataFrame,
                          flags: DataFrame, checkpoint: str):
    """Filter newly arrived submission files (P1, P3, P4 with a fixed flag table) into Parquet."""
    stream = spark.readStream.schema(RAW_SUBMISSION).option("mode", "FAILFAST").json(source_dir)
    over = F.coalesce(F.col("over_18"), F.lit(False))
    kept = (stream.join(flags.select("subreddit", F.col("flagged").alias("_flag")), "subreddit", "left")
            .where(~(over & F.coalesce(F.col("_flag"), F.lit(False))))
            .join(ignored.select("author").distinct(), "author", "left_anti")
            .select(*[f.name for f in SUBMISSION.fields]))
    return (kept.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def clean_new_comments(spark: SparkSession, source_dir: str, out_dir: str, ignored: DataFrame,
                       checkpoint: str):
    """Filter newly arrived comment files (P2, P3) into Parquet."""
    stream = spark.readStream.schema(RAW_COMMENT).option("mode", "FAILFAST").json(source_dir)
    kept = (stream.join(ignored.select("author").distinct(), "author", "left_anti")
            .select(*[f.name for f in COMMENT.fields]))
    return (kept.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
