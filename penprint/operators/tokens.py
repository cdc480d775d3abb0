"""Token statistics.

Counts are kept as a long table (keys..., token, n) so that every later step
is a join or an aggregate, without hints and without a limit on the token set.
A persona's counts over a token set become a dense ARRAY<BIGINT> in token-rank
order only when a vector is needed, in time linear in the set's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions.columns import (safe_freq, smoothed_log2_freq, tokens as token_array,
                                        wilson_bounds)
from penprint.operators.indexing import with_dense_index


def explode_tokens(segments: DataFrame, keys: list[str], text: str = "text",
                   tokenizer=None) -> DataFrame:
    """One row per token occurrence: (keys..., token).

    ``tokenizer`` maps a text column to an ARRAY<STRING> column; the default is
    the built-in regex splitter (JVM side). A BPE or other tokenizer can be
    plugged in as a pandas UDF with the same signature.
    """
    split = tokenizer or token_array
    return segments.select(*keys, F.explode(split(F.col(text))).alias("token"))


def token_counts(segments: DataFrame, keys: list[str], text: str = "text", tokenizer=None) -> DataFrame:
    """(keys..., token, n). Partial aggregation runs before the shuffle."""
    return (explode_tokens(segments, keys, text, tokenizer)
            .groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n")))


def roll_up(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A12 from A11: counts per coarser key, without tokenizing again."""
    return counts.groupBy(*keys, "token").agg(F.sum("n").alias("n"))


def with_token_text(ids: DataFrame, vocabulary: DataFrame, token_id: str = "token_id") -> DataFrame:
    """the text of each token id, from a vocabulary table (token_id, token); null for an unknown id."""
    return ids.join(vocabulary.select(F.col("token_id").alias(token_id), "token"), token_id, "left")


def token_frequencies(counts: DataFrame, author_keys: list[str], top_k: int | None = None,
                      min_authors: int = 2) -> DataFrame:
    """A9 + A10 + W3: corpus count and number of distinct authors per token.

    Keeps tokens used by at least ``min_authors`` authors, ranks them by count
    descending (ties: token ascending) and keeps the first ``top_k``.
    Two-level aggregation: (author, token) first, then token.
    """
    per_author = counts.groupBy(*author_keys, "token").agg(F.sum("n").alias("n"))
    per_token = per_author.groupBy("token").agg(F.sum("n").alias("n"),
                                                F.count(F.lit(1)).alias("n_authors"))
    kept = per_token.where(F.col("n_authors") >= min_authors)
    order = [F.col("n").desc(), F.col("token").asc()]
    ranked = with_dense_index(kept, order, name="rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.where(F.col("rank") < top_k) if top_k is not None else ranked


def token_set(tokens: DataFrame) -> tuple[DataFrame, int]:
    """Distinct tokens of a set with dense ranks in order of their first rank, and the set size.

    Duplicate tokens in the set collapse onto their first position.
    """
    distinct = tokens.groupBy("token").agg(F.min("rank").alias("first"))
    dense = with_dense_index(distinct, ["first", "token"], name="rank").select("token", F.col("rank").cast("int").alias("rank"))
    return dense, dense.count()


def in_set_counts(counts: DataFrame, tset: DataFrame) -> DataFrame:
    """Counts restricted to the token set: (keys..., token, rank, n)."""
    return counts.join(tset.select("token", "rank"), "token")


def persona_totals(counts: DataFrame, tset: DataFrame, keys: list[str]) -> DataFrame:
    """n_total, n_in_set, n_excluded per persona (one pass, no join)."""
    flagged = counts.join(tset.select("token", F.lit(True).alias("_in")), "token", "left")
    return flagged.groupBy(*keys).agg(
        F.sum("n").alias("n_total"),
        F.sum(F.when(F.col("_in"), F.col("n")).otherwise(F.lit(0))).alias("n_in_set")).withColumn(
        "n_excluded", F.col("n_total") - F.col("n_in_set"))


def dense_array(entries: Column, position: str, value: str, size: int, zero: Column) -> Column:
    """Sorted (position, value) structs as an array of ``size`` values, ``zero`` where there is no entry.

    Each entry brings the gap in front of it, so the work is linear in ``size``.
    """
    before = lambda i: F.coalesce(F.get(entries, i - 1)[position], F.lit(-1))
    filled = F.flatten(F.transform(entries, lambda e, i: F.concat(F.array_repeat(zero, e[position] - before(i) - 1),
                                                                   F.array(e[value]))))
    last = F.element_at(entries, -1)[position]
    return F.when(entries.isNull(), F.array_repeat(zero, size)).otherwise(
        F.concat(filled, F.array_repeat(zero, F.lit(size - 1) - last)))


def persona_vectors(counts: DataFrame, tset: DataFrame, k: int, keys: list[str],
                    personas: DataFrame | None = None) -> DataFrame:
    """Per persona, ARRAY<BIGINT> of k counts in token-rank order (zero-filled),
    with n_total / n_in_set / n_excluded. ``personas`` lists personas to keep even
    when they have no tokens at all (their vector is all zeros).
    """
    inset = in_set_counts(counts, tset)
    sparse = inset.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("_s"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n_total"))
    base = totals if personas is None else personas.select(*keys).distinct().join(totals, keys, "left")
    out = base.join(sparse, keys, "left").select(
        *keys, F.coalesce(F.col("n_total"), F.lit(0).cast("bigint")).alias("n_total"),
        dense_array(F.col("_s"), "rank", "n", k, F.lit(0).cast("bigint")).alias("counts"))
    n_in = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.withColumn("n_in_set", n_in).withColumn("n_excluded", F.col("n_total") - F.col("n_in_set"))


def persona_token_freq(counts: DataFrame, tset: DataFrame, k: int, keys: list[str],
                       personas: DataFrame | None = None) -> DataFrame:
    """Freq over the set and freq including excluded tokens (counts themselves if the total is 0).

    Long form over the full set: the zero-filled persona vector is exploded
    with its positions, so every persona gets every token of the set.
    """
    vec = persona_vectors(counts, tset, k, keys, personas)
    filled = (vec.select(*keys, "n_in_set", "n_excluded", F.posexplode("counts").alias("rank", "n"))
              .join(tset.select("token", "rank"), "rank"))
    return filled.select(*keys, "rank", "token", "n", "n_in_set", "n_excluded",
                         safe_freq("n", "n_in_set").alias("freq"),
                         safe_freq("n", F.col("n_in_set") + F.col("n_excluded")).alias("freq_with_excluded"))


def persona_log_freq(freq_table: DataFrame, k: int) -> DataFrame:
    """Smoothed log2 frequency without / with the excluded bucket."""
    return freq_table.withColumn("log_freq", smoothed_log2_freq("n", "n_in_set", k)).withColumn(
        "log_freq_with_excluded", smoothed_log2_freq("n", "n_in_set", k, "n_excluded"))


def token_wilson_ci(freq_table: DataFrame) -> DataFrame:
    """Wilson 95% interval of each in-set frequency (null for an empty persona)."""
    lo, hi = wilson_bounds("freq", "n_in_set")
    return freq_table.withColumn("lower_ci", lo).withColumn("upper_ci", hi)


def authors_with_enough_tokens(counts: DataFrame, tset: DataFrame, author: str, slot: str,
                               sufficient: int = 500) -> DataFrame:
    """Authors whose personas 0 and 1 each have strictly more than ``sufficient`` in-set tokens."""
    per_persona = in_set_counts(counts, tset).groupBy(author, slot).agg(F.sum("n").alias("n_in_set"))
    good = per_persona.where((F.col(slot).isin(0, 1)) & (F.col("n_in_set") > sufficient))
    return good.groupBy(author).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == 2).select(author)


def first_k_tokens_of_ranking(ranked: DataFrame, start: int, end: int) -> DataFrame:
    """Tokens from position ``start`` (inclusive) to ``end`` (exclusive) of a ranking."""
    return ranked.where((F.col("rank") >= start) & (F.col("rank") < end))
