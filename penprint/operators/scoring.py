"""Pair scoring.

A scorer prepares one table and scores pairs by equi joins with it. The
log-likelihood scorer stays sparse: a persona is one row with the tokens of the
set that it has, in order of rank. A pair meets the rows of its two personas
and merges them inside the row, linear in what they hold, so pairs are neither
multiplied by tokens nor grouped again, and no vector as wide as the token set
travels with them. A hot persona named by many pairs is a skewed join key,
which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions.columns import cosine
from penprint.operators import tokens as tok
from penprint.operators import vectors
from penprint.sources.readers import validate_documents, validate_pairs
from penprint.sources.schemas import PAIR_COLUMNS

PERSONA_KEYS = ["entity", "persona"]


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Give every pair row an id so order and duplicates survive the joins."""
    return validate_pairs(pairs).withColumn("pair_id", F.monotonically_increasing_id())


def check_known_personas(pairs: DataFrame, personas: DataFrame) -> None:
    """A pair naming a persona without documents is an error (anti-join, first few shown)."""
    known = personas.select(*PERSONA_KEYS).distinct()
    sides = pairs.select(F.col("entity1").alias("entity"), F.col("persona1").alias("persona")).union(
        pairs.select(F.col("entity2").alias("entity"), F.col("persona2").alias("persona")))
    unknown = sides.join(known, PERSONA_KEYS, "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"pairs name personas without documents: {[tuple(r) for r in unknown]}")


def document_counts(documents: DataFrame, tokenizer=None) -> tuple[DataFrame, DataFrame]:
    """Prepare step: (personas with documents, their token counts)."""
    docs = validate_documents(documents).where(F.col("entity").isNotNull() & F.col("persona").isNotNull())
    return docs.select(*PERSONA_KEYS).distinct(), tok.token_counts(docs, PERSONA_KEYS, "text", tokenizer)


def _unknown_guard(value: Column, known: Column) -> Column:
    """Fail the job when a pair names a persona that has no row (checked while scoring,
    so it costs no extra pass over the pairs)."""
    msg = F.concat(F.lit("pair names a persona without documents: "),
                   F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("null")) for c in PAIR_COLUMNS]))
    return F.when(known, value).otherwise(F.raise_error(msg))


def pair_log_likelihood(pairs: DataFrame, model: list[str], observed: list[str], personas: DataFrame,
                        counts: DataFrame, tset: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """A16 for every row of ``pairs`` (a row id included): its columns, ``score``, ``_known``.

    sum_t obs(t) * [log2(c(t) + .5) - log2(N + (k + 1) / 2)] / sum_t obs(t), and 0 when
    the observation has no in-set token. N is every token of the model persona, so the
    excluded bucket is included. ``model`` and ``observed`` name the pair columns that
    hold the two personas' ``keys``.
    """
    known = tset.select("token", "rank")
    entry = F.when(F.col("rank").isNotNull(), F.struct("rank", "n"))
    sparse = counts.select(*keys, "token", F.col("n").cast("bigint").alias("n")).join(known, "token", "left").groupBy(*keys).agg(
        F.sum("n").alias("_total"), F.array_sort(F.collect_list(entry)).alias("_has"))
    rows = personas.select(*keys).distinct().join(sparse, keys, "left")

    def side(columns: list[str], mark: str, total: str, has: str) -> DataFrame:
        names = [F.col(k).alias(c) for k, c in zip(keys, columns, strict=True)]
        return rows.select(*names, F.lit(True).alias(mark), F.col("_total").alias(total), F.col("_has").alias(has))

    met = (pairs.join(side(model, "_m", "_total", "_c"), model, "left")
           .join(side(observed, "_o", "_unused", "_obs"), observed, "left"))
    norm = F.log2(F.coalesce(F.col("_total"), F.lit(0)).cast("double") + F.lit((k + 1) / 2.0))
    score = F.transform(F.array(_merged(F.col("_c"), F.col("_obs"))),
                        lambda s: F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["w"] / s["n"] - norm))[0]
    return met.select(*pairs.columns, score.alias("score"),
                      (F.col("_m").isNotNull() & F.col("_o").isNotNull()).alias("_known"))


def _merged(model: Column, observed: Column) -> Column:
    """Struct of w = sum over observed tokens of n * log2(model's count + 1/2), and n = their number.

    Both are arrays of (rank, n). Put in order of rank, the model's entry first, each observed entry finds the
    model's count in the entry before it.
    """
    def tagged(entries: Column, who: int) -> Column:
        some = F.transform(entries, lambda e: F.struct(e["rank"].alias("r"), F.lit(who).alias("who"), e["n"].alias("n")))
        return F.coalesce(some, F.array().cast("array<struct<r:int,who:int,n:bigint>>"))

    def step(done: Column, e: Column) -> Column:
        count = F.when(done["r"] == e["r"], done["c"]).otherwise(F.lit(0).cast("bigint"))
        gain = e["n"] * F.log2(count.cast("double") + F.lit(0.5))
        return F.when(e["who"] == 0, F.struct(e["r"].alias("r"), e["n"].alias("c"), done["w"].alias("w"), done["n"].alias("n"))) \
            .otherwise(F.struct(done["r"].alias("r"), done["c"].alias("c"), (done["w"] + gain).alias("w"),
                                (done["n"] + e["n"]).alias("n")))

    nothing = F.struct(F.lit(-1).alias("r"), F.lit(0).cast("bigint").alias("c"), F.lit(0.0).alias("w"),
                       F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.array_sort(F.concat(tagged(model, 0), tagged(observed, 1))), nothing, step)


def score_log_likelihood(personas: DataFrame, counts: DataFrame, model_tokens: DataFrame, pairs: DataFrame,
                         check: str = "lazy") -> DataFrame:
    """J10 + A16: entity1/persona1 is the model persona, entity2/persona2 the observation.

    ``check='lazy'`` fails the scoring job itself on an unknown persona;
    ``'eager'`` runs an anti-join first and raises KeyError before scoring.
    """
    numbered = number_pairs(pairs).select("pair_id", *PAIR_COLUMNS)
    if check == "eager":
        check_known_personas(numbered, personas)
    tset, k = tok.token_set(model_tokens)
    scored = pair_log_likelihood(numbered, ["entity1", "persona1"], ["entity2", "persona2"], personas, counts, tset, k,
                                 PERSONA_KEYS)
    return scored.select("pair_id", *PAIR_COLUMNS, _unknown_guard(F.col("score"), F.col("_known")).alias("match_score"))


def score_embedding(persona_embeddings: DataFrame, pairs: DataFrame, check: str = "lazy") -> DataFrame:
    """M9 (embedding model): cosine of the two personas' (projected) mean embeddings.

    ``persona_embeddings`` has entity, persona, embedding. A zero vector gives null.
    """
    numbered = number_pairs(pairs)
    if check == "eager":
        check_known_personas(numbered, persona_embeddings)
    a = persona_embeddings.select(F.col("entity").alias("entity1"), F.col("persona").alias("persona1"),
                                  F.col("embedding").alias("_a"))
    b = persona_embeddings.select(F.col("entity").alias("entity2"), F.col("persona").alias("persona2"),
                                  F.col("embedding").alias("_b"))
    joined = numbered.join(a, ["entity1", "persona1"], "left").join(b, ["entity2", "persona2"], "left")
    alike = vectors.of_width(F.col("_a"), F.size("_b"))
    score = F.when(F.col("_b").isNotNull(), cosine(alike, "_b"))
    return joined.select("pair_id", *PAIR_COLUMNS, _unknown_guard(
        score, F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("match_score"))


def embedding_personas(documents: DataFrame, embedder: str | vectors.Embedder | Callable | None = None,
                       dim: int = vectors.HASH_DIM, layers: list | None = None, cache: DataFrame | None = None,
                       batch_size: int | None = None) -> DataFrame:
    """Prepare step of the embedding scorer: (entity, persona, embedding), projected if ``layers`` are given.

    ``dim`` is the width of the hashing embedder; a model's width is its own. J13: a persona found in
    ``cache`` (entity, persona, embedding before the projection) is not embedded again; cached vectors of
    another width than the computed ones fail the job.
    """
    docs = validate_documents(documents).where(F.col("entity").isNotNull() & F.col("persona").isNotNull())

    def compute(rows: DataFrame) -> DataFrame:
        width = vectors.embedder_width(rows, "text", embedder, dim)
        embedded = vectors.embed_texts(rows, PERSONA_KEYS, "text", embedder, dim, batch_size, width)
        return vectors.persona_embeddings(embedded, PERSONA_KEYS, width)

    means = compute(docs) if cache is None else vectors.cached_or_computed(docs, cache, PERSONA_KEYS, compute)
    return vectors.project(means, layers) if layers else means


def run_inference(model_type: str, documents: DataFrame, pairs: DataFrame, model_tokens: DataFrame | None = None,
                  tokenizer=None, check: str = "lazy", embedder: str | vectors.Embedder | Callable | None = None,
                  dim: int = vectors.HASH_DIM, layers: list | None = None, cache: DataFrame | None = None,
                  batch_size: int | None = None) -> DataFrame:
    """M9: pick the scorer by model type and score every pair (order and duplicates kept)."""
    if model_type == "LOG_LIKELIHOOD_MODEL":
        personas, counts = document_counts(documents, tokenizer)
        return score_log_likelihood(personas, counts, model_tokens, pairs, check)
    if model_type == "EMBEDDING_MODEL":
        return score_embedding(embedding_personas(documents, embedder, dim, layers, cache, batch_size), pairs, check)
    raise ValueError(f"unknown model type {model_type!r}")
