"""Corpus cleaning and activity profiles.

All steps are lazy and relational: scans, joins without hints (adaptive
execution broadcasts a side that turns out small) and hash aggregates with
partial (map-side) aggregation. Nothing runs before the caller's action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.functions.columns import utc_day_of_month
from penprint.sources.schemas import COMMENT, SUBMISSION

# Fixed values of the reference's cleaning rules.
NSFW_RATIO_CUTOFF = 0.1        # flagged when over / (over + other + 0.1) > 0.1
NSFW_RATIO_SMOOTHING = 0.1


def nsfw_flags(submissions: DataFrame) -> DataFrame:
    """Per subreddit, flagged = over / (over + other + 0.1) > 0.1 over all posts
    (ignored authors included; a null over_18 counts as not over 18)."""
    over = F.coalesce(F.col("over_18"), F.lit(False))
    counts = submissions.groupBy("subreddit").agg(
        F.count_if(over).alias("n_over_18"), F.count(F.lit(1)).alias("n_posts"))
    ratio = F.col("n_over_18") / (F.col("n_posts") + F.lit(NSFW_RATIO_SMOOTHING))
    return counts.select("subreddit", (ratio > F.lit(NSFW_RATIO_CUTOFF)).alias("flagged"))


def drop_ignored(df: DataFrame, ignored: DataFrame, author: str = "author") -> DataFrame:
    """Anti-join on the ignore list (case-sensitive names, list is data)."""
    return df.join(ignored.select(F.col("author").alias(author)), author, "left_anti")


def filter_submissions(submissions: DataFrame, ignored: DataFrame, flags: DataFrame | None = None,
                       on_missing: str = "keep") -> DataFrame:
    """P1 + P3 + P4 + J1: keep the 9 submission columns, drop ignored authors, and drop
    a post when it is over 18 *and* its subreddit is flagged.

    ``flags`` defaults to ``nsfw_flags(submissions)``. With a supplied flag table,
    ``on_missing='error'`` fails the job when an over-18 post's subreddit has no flag.
    """
    if flags is None:
        flags = nsfw_flags(submissions)
    posts = submissions.select(*[f.name for f in SUBMISSION.fields])
    over = F.coalesce(F.col("over_18"), F.lit(False))
    joined = posts.join(flags.select("subreddit", F.col("flagged").alias("_flag")), "subreddit", "left")
    if on_missing == "error":
        message = F.concat(F.lit("over-18 post in a subreddit without a flag: "), F.col("subreddit"))
        joined = joined.withColumn("_flag", F.when(over & F.col("_flag").isNull(), F.raise_error(message))
                                   .otherwise(F.col("_flag")))
    kept = joined.where(~(over & F.coalesce(F.col("_flag"), F.lit(False)))).drop("_flag")
    return drop_ignored(kept, ignored).select(*[f.name for f in SUBMISSION.fields])


def filter_comments(comments: DataFrame, ignored: DataFrame) -> DataFrame:
    """P2 + P3: keep the 7 comment columns and drop ignored authors (no over-18 test)."""
    return drop_ignored(comments.select(*[f.name for f in COMMENT.fields]), ignored).select(
        *[f.name for f in COMMENT.fields])


def activity_rows(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per post or comment: author, subreddit, kind, characters (code points)."""
    length = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0))
    posts = submissions.select("author", "subreddit", F.lit("post").alias("kind"),
                               (length("selftext") + length("title")).cast("bigint").alias("chars"))
    notes = comments.select("author", "subreddit", F.lit("comment").alias("kind"),
                            length("body").cast("bigint").alias("chars"))
    return posts.unionByName(notes)


def characters_per_author_subreddit(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """A2 + A3 + J3: characters, comments and posts per (author, subreddit) in one aggregate."""
    return activity_rows(submissions, comments).groupBy("author", "subreddit").agg(
        F.sum("chars").alias("num_characters"),
        F.count_if(F.col("kind") == "comment").alias("num_comments"),
        F.count_if(F.col("kind") == "post").alias("num_posts"))


def prolific_authors(stats: DataFrame, min_characters: int = 10000, min_subreddits: int = 2) -> DataFrame:
    """A4: authors with >= min_characters in at least ``min_subreddits`` subreddits."""
    return (stats.groupBy("author")
            .agg(F.count_if(F.col("num_characters") >= min_characters).alias("_n"))
            .where(F.col("_n") >= min_subreddits).select("author"))


def of_authors(df: DataFrame, authors: DataFrame) -> DataFrame:
    """Rows of the given authors (left semi-join)."""
    return df.join(authors.select("author"), "author", "left_semi")


def author_subreddit_stats(stats: DataFrame, authors: DataFrame) -> DataFrame:
    """The stats of prolific authors, all of their subreddits."""
    return of_authors(stats, authors).select("author", "subreddit", "num_characters", "num_comments", "num_posts")


def activity_counts(submissions: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """Posts + comments per author or per subreddit."""
    rows = submissions.select(key).unionByName(comments.select(key))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def both_activity_counts(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """A5 + A6 in one scan: (kind 'author' or 'subreddit', name, count) by grouping sets."""
    keys = ["author", "subreddit"]
    rows = submissions.select(*keys).unionByName(comments.select(*keys))
    counted = rows.groupingSets([["author"], ["subreddit"]], *keys).agg(
        F.count(F.lit(1)).alias("count"), F.grouping("author").alias("_by_subreddit"))
    by_subreddit = F.col("_by_subreddit") == 1
    return counted.select(F.when(by_subreddit, "subreddit").otherwise("author").alias("kind"),
                          F.when(by_subreddit, F.col("subreddit")).otherwise(F.col("author")).alias("name"), "count")


def at_least(counts: DataFrame, min_count: int) -> DataFrame:
    """P5: entries with count >= min_count."""
    return counts.where(F.col("count") >= min_count)


def activity_summary(submissions: DataFrame, comments: DataFrame, author_cutoff: int = 30,
                     subreddit_cutoff: int = 30) -> DataFrame:
    """Distinct authors and subreddits, before and after the cutoffs (one row)."""
    counts = both_activity_counts(submissions, comments)
    author = F.col("kind") == "author"
    return counts.agg(
        F.count_if(author).alias("n_authors"),
        F.count_if(author & (F.col("count") >= author_cutoff)).alias("n_active_authors"),
        F.count_if(~author).alias("n_subreddits"),
        F.count_if(~author & (F.col("count") >= subreddit_cutoff)).alias("n_active_subreddits"))


def activity_extremes(counts: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n most and n least active entries (by count; ties by name).
    Overlap is kept when there are fewer than 2n entries."""
    top = counts.orderBy(F.col("count").desc(), F.col(key).asc()).limit(n).withColumn("end", F.lit("most"))
    bottom = counts.orderBy(F.col("count").asc(), F.col(key).desc()).limit(n).withColumn("end", F.lit("least"))
    return top.unionByName(bottom)


def with_utc_day(df: DataFrame, epoch_col: str = "created_utc") -> DataFrame:
    """The UTC day of month of the creation time, for K9 day shards."""
    return df.withColumn("day", utc_day_of_month(epoch_col))
