"""Evaluation: cutoffs, per-token accuracies, distribution summaries.

Tail counts over a cutoff grid never compare every sample with every grid
point: each sample is put in the bucket of the first grid point it passes,
buckets are counted with a partial aggregate, and a running sum over the
(bounded) grid gives "how many samples pass cutoff g". Only the grid, whose
size is a parameter, is ever held per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.functions.columns import capped_bucket
from penprint.operators.indexing import following_pairs, with_dense_index

# The log-likelihood cutoff grid 0, -0.05, ..., -19.95.
LL_GRID_SIZE = 400
LL_GRID_STEP = -0.05
# Spread grid of the second cutoff variant: 100 points over min-3sd .. max+3sd.
SPREAD_GRID_SIZE = 100
SPREAD_SIGMAS = 3.0
# Scores are rounded to this many decimals before they meet a grid.
SCORE_DECIMALS = 9


def decreasing_grid_bucket(score: Column, size: int = LL_GRID_SIZE, step: float = LL_GRID_STEP) -> Column:
    """First index g of the grid g*step (step < 0) with score >= g*step; ``size`` if none."""
    g0 = F.greatest(F.lit(0), F.ceil(score / F.lit(step)).cast("int"))
    g1 = F.when((g0 > 0) & (score >= (g0 - 1).cast("double") * F.lit(step)), g0 - 1).otherwise(g0)
    g2 = F.when(score < g1.cast("double") * F.lit(step), g1 + 1).otherwise(g1)
    return F.least(g2, F.lit(size))


def grid_tail_counts(samples: DataFrame, keys: list[str], label: str, bucket: str, grid: DataFrame,
                     totals: dict[int, int] | None = None, implicit_bucket: int = 0) -> DataFrame:
    """For every key and grid index g: n1_pass, n0_pass = samples of label 1 / 0 whose bucket <= g, out of n1, n0.

    Without ``totals`` every sample has a row and n1, n0 are counted per key.
    With ``totals`` (samples per label, the same for every key) the samples
    without a row (implicit ones) are counted in ``implicit_bucket``.
    """
    if not keys:  # one group: a constant key keeps the plan the same
        out = grid_tail_counts(samples.withColumn("_all", F.lit(0)), ["_all"], label, bucket,
                               grid.withColumn("_all", F.lit(0)), totals, implicit_bucket)
        return out.drop("_all")
    per_bucket = samples.groupBy(*keys, bucket).agg(
        F.count_if(F.col(label) == 1).alias("_b1"), F.count_if(F.col(label) == 0).alias("_b0"))
    present = per_bucket.groupBy(*keys).agg(F.sum("_b1").alias("_p1"), F.sum("_b0").alias("_p0"))
    filled = grid.join(per_bucket.withColumnRenamed(bucket, "g"), keys + ["g"], "left").fillna(0, ["_b1", "_b0"])
    w = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    cum = filled.withColumn("_c1", F.sum("_b1").over(w)).withColumn("_c0", F.sum("_b0").over(w))
    out = cum.join(present, keys, "left").fillna(0, ["_p1", "_p0"])
    n1, n0 = (F.col("_p1"), F.col("_p0")) if totals is None else (F.lit(int(totals.get(1, 0))), F.lit(int(totals.get(0, 0))))
    late = F.col("g") >= implicit_bucket
    c1 = F.col("_c1") + F.when(late, n1 - F.col("_p1")).otherwise(F.lit(0))
    c0 = F.col("_c0") + F.when(late, n0 - F.col("_p0")).otherwise(F.lit(0))
    return out.select(*keys, "g", c1.cast("bigint").alias("n1_pass"), c0.cast("bigint").alias("n0_pass"),
                      n1.cast("bigint").alias("n1"), n0.cast("bigint").alias("n0"))


def cutoff_accuracy(n1_pass: Column, n0_pass: Column, n1: Column, n0: Column) -> Column:
    """(P(match passes) + 1 - P(mismatch passes)) / 2; null if a label has no sample."""
    return F.lit(0.5) * (F.try_divide(n1_pass, n1) + F.lit(1.0) - F.try_divide(n0_pass, n0))


def pick_best(tails: DataFrame, keys: list[str], cutoff: Column, objective: str) -> DataFrame:
    """Choose per key the grid point with the best objective (exact integer comparison),
    ties to the lowest grid index. ``objective``: 'distance' = max |acc - 1/2|
    (variant 1), 'accuracy' = max acc (variant 2)."""
    diff = F.col("n1_pass") * F.col("n0") - F.col("n0_pass") * F.col("n1")
    score = F.abs(diff) if objective == "distance" else diff
    best = tails.withColumn("_cut", cutoff).groupBy(*keys).agg(F.max(F.struct(
        score.alias("_s"), (-F.col("g")).alias("_ng"), "g", "_cut", "n1_pass", "n0_pass", "n1", "n0")).alias("_b"))
    acc = cutoff_accuracy(*[F.col(f"_b.{c}") for c in ("n1_pass", "n0_pass", "n1", "n0")])
    return best.select(*keys, F.col("_b.g").alias("grid_index"), F.col("_b._cut").alias("cutoff"),
                       acc.alias("accuracy"))


def label_totals(samples: DataFrame, label: str) -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in samples.groupBy(label).count().collect()}  # two rows


def best_cutoff_log_grid(scores: DataFrame, score: str = "score", label: str = "label",
                         keys: list[str] | None = None) -> DataFrame:
    """Cutoff among 0, -0.05, ..., -19.95 maximizing |accuracy - 1/2|, where
    accuracy = (P(match >= c) + 1 - P(mismatch >= c)) / 2, per key; first grid point on ties."""
    keys = keys or []
    s = F.round(F.col(score), SCORE_DECIMALS)
    samples = scores.select(*keys, label, decreasing_grid_bucket(s).alias("_bucket"))
    grid_rows = F.explode(F.sequence(F.lit(0), F.lit(LL_GRID_SIZE - 1))).alias("g")
    grid = (samples.select(*keys).distinct().select(*keys, grid_rows) if keys
            else scores.sparkSession.range(LL_GRID_SIZE).select(F.col("id").cast("int").alias("g")))
    tails = grid_tail_counts(samples, keys, label, "_bucket", grid)
    return pick_best(tails, keys, F.col("g").cast("double") * F.lit(LL_GRID_STEP), "distance")


def mismatched_pairs(authors: DataFrame, author: str = "author", ahead: int = 4) -> DataFrame:
    """Author i (by name order) with the next ``ahead`` authors: (author_a, author_b)."""
    indexed = with_dense_index(authors.select(author).distinct(), [author])
    return following_pairs(indexed, author, "idx", ahead).select(
        F.col(f"{author}_a").alias("author_a"), F.col(f"{author}_b").alias("author_b"))


def evaluation_pairs(authors: DataFrame, author: str = "author", ahead: int = 4) -> DataFrame:
    """Matched (label 1: author with itself) and J8 mismatched (label 0) model/observation pairs."""
    a = authors.select(F.col(author).alias("author")).distinct()
    same = a.select(F.col("author").alias("author_a"), F.col("author").alias("author_b"), F.lit(1).alias("label"))
    other = mismatched_pairs(a, "author", ahead).withColumn("label", F.lit(0))
    return same.unionByName(other)


def token_accuracies(counts: DataFrame, candidates: DataFrame, pairs: DataFrame,
                     author: str = "author", slot: str = "slot") -> DataFrame:
    """For each candidate token alone, the best cutoff and accuracy of the
    one-token log-likelihood classifier over matched and mismatched pairs.

    With one token, a pair scores 0 unless the observed persona (slot 1 of
    author_b) has the token; then log2((c + .5) / (N + 1)) with c the token's
    count and N all tokens of the model persona (slot 0 of author_a). So only
    (pair, token held by the observation) rows exist; absent rows are zeros,
    which pass every cutoff <= 0 and are added to every tail count.
    """
    cand = candidates.select("token")
    obs = counts.where(F.col(slot) == 1).join(cand, "token").select(
        F.col(author).alias("author_b"), "token", F.col("n").alias("_o"))
    model = counts.where(F.col(slot) == 0)
    model_tok = model.join(cand, "token").select(F.col(author).alias("author_a"), "token", F.col("n").alias("_c"))
    model_tot = model.groupBy(author).agg(F.sum("n").alias("_N")).select(F.col(author).alias("author_a"), "_N")
    rows = (pairs.join(obs, "author_b").join(model_tok, ["author_a", "token"], "left")
            .join(model_tot, "author_a", "left").fillna(0, ["_c", "_N"]))
    score = F.log2((F.col("_c") + F.lit(0.5)) / (F.col("_N") + F.lit(1.0)))
    samples = rows.select("token", "label", decreasing_grid_bucket(F.round(score, SCORE_DECIMALS)).alias("_bucket"))
    totals = label_totals(pairs, "label")
    grid = candidates.select("token").distinct().select(
        "token", F.explode(F.sequence(F.lit(0), F.lit(LL_GRID_SIZE - 1))).alias("g"))
    tails = grid_tail_counts(samples, ["token"], "label", "_bucket", grid, totals)
    return pick_best(tails, ["token"], F.col("g").cast("double") * F.lit(LL_GRID_STEP), "distance")


def rank_by_accuracy(accuracies: DataFrame, candidates: DataFrame, top_n: int | None = None) -> DataFrame:
    """W4 + K11: tokens by accuracy descending (ties: candidate rank); rank after sorting.

    Candidates may be as many as the corpus has tokens: with ``top_n`` every task keeps its own best first,
    and positions come from a distributed sort.
    """
    j = accuracies.join(candidates.select("token", F.col("rank").alias("_cr")), "token")
    order = [F.col("accuracy").desc_nulls_last(), F.col("_cr").asc()]
    best = j if top_n is None else j.orderBy(*order).limit(top_n)
    ranked = with_dense_index(best, order, "rank")
    return ranked.select(F.col("rank").cast("int").alias("rank"), "accuracy", "token", F.col("_cr").alias("token_index"))


def spread_grid(per_label: dict[int, dict], size: int = SPREAD_GRID_SIZE, sigmas: float = SPREAD_SIGMAS) -> list[float]:
    """``size`` points from min(min - 3sd) to max(max + 3sd) over both labels (population sd)."""
    lo = min(float(r["min"]) - sigmas * float(r["std"]) for r in per_label.values())
    hi = max(float(r["max"]) + sigmas * float(r["std"]) for r in per_label.values())
    step = (hi - lo) / (size - 1)
    return [hi if i == size - 1 else i * step + lo for i in range(size)]


def spread_grid_cutoffs(samples: DataFrame, value: str = "value", label: str = "label", best: int = 5,
                        size: int = SPREAD_GRID_SIZE, sigmas: float = SPREAD_SIGMAS) -> DataFrame:
    """The ``best`` cutoffs of the grid by accuracy, first grid point on ties; null samples do not count."""
    known = samples.where(F.col(value).isNotNull())
    per = {int(r[label]): r.asDict() for r in known.groupBy(label).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std")).collect()}  # two rows
    grid = spread_grid(per, size, sigmas)
    v, n = F.col(value).cast("double"), F.lit(size)
    # Number of grid points <= v, from the step, then corrected by one for rounding.
    points = F.array(*[F.lit(x) for x in grid])
    step = grid[1] - grid[0]
    if step > 0:
        near = F.least(F.greatest(F.floor((v - F.lit(grid[0])) / F.lit(step)).cast("int") + 1, F.lit(0)), n)
    else:
        near = F.when(v >= F.lit(grid[0]), n).otherwise(F.lit(0))
    near = F.when((near > 0) & (v < F.get(points, near - 1)), near - 1).otherwise(near)
    near = F.when((near < n) & (v >= F.get(points, near)), near + 1).otherwise(near)
    counts = {(int(r[0]), int(r[1])): int(r[2]) for r in known.groupBy(label, near.alias("m")).count().collect()}
    return best_of_grid(samples.sparkSession, grid, counts, best)


def best_of_grid(spark, grid: list[float], counts: dict[tuple[int, int], int], best: int = 5) -> DataFrame:
    """The ``best`` grid points, given how many samples of each label have m grid points at or below them.

    The grid and its counts are bounded by the grid's size, so this is driver arithmetic in whole numbers.
    """
    size = len(grid)
    total = {k: sum(n for (label, _), n in counts.items() if label == k) for k in (0, 1)}
    passing = {k: [sum(counts.get((k, m), 0) for m in range(g + 1, size + 1)) for g in range(size)] for k in (0, 1)}
    order = sorted(range(size), key=lambda g: (-(passing[1][g] * total[0] - passing[0][g] * total[1]), g))[:best]

    def accuracy(g: int) -> float | None:
        if not total[0] or not total[1]:
            return None
        return 0.5 * (passing[1][g] / total[1] + 1 - passing[0][g] / total[0])

    rows = [(k, g, grid[g], accuracy(g), grid[0], grid[-1]) for k, g in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, grid_index int, cutoff double, accuracy double, grid_low double, "
                                       "grid_high double")


def exact_median(samples: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """Exact median per label by a distributed sort: range-partitioned positions,
    then the one or two middle ranks per label. Equal values are spread by a tie
    number; null values do not count."""
    known = samples.where(F.col(value).isNotNull()).select(
        label, F.col(value).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_tie"))
    pos = with_dense_index(known, [label, "_v", "_tie"], "_i")
    bounds = pos.groupBy(label).agg(F.min("_i").alias("_start"), F.count(F.lit(1)).alias("_n"))
    ranked = pos.join(bounds, label).withColumn("_r", F.col("_i") - F.col("_start"))
    mid = ranked.where((F.col("_r") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2)))
    return mid.groupBy(label).agg(F.avg("_v").alias("median"))


def distribution_summary(samples: DataFrame, value: str = "value", label: str = "label") -> DataFrame:
    """Per label, over its values that are not null: n, mean, exact median, population sd, min, max."""
    moments = samples.groupBy(label).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return moments.join(exact_median(samples, value, label), label)


def histogram(samples: DataFrame, value: str = "value", label: str = "label", bins: int = 20) -> DataFrame:
    """Per label, ``bins`` equal bins over the label's own min..max, as density
    (count / (n * width)); the maximum falls in the last bin; null values do not count."""
    known = samples.where(F.col(value).isNotNull())
    rng = known.groupBy(label).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                   F.count(F.lit(1)).alias("_n"))
    b = known.join(rng, label).select(label, "_lo", "_hi", "_n", capped_bucket(value, "_lo", "_hi", bins).alias("bin"))
    counts = b.groupBy(label, "bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("count"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / F.lit(bins)).otherwise(F.lit(1.0 / bins))
    return counts.select(label, "bin", "count", (F.col("count") / (F.col("_n") * width)).alias("density"))


def threshold_shares(counted: DataFrame) -> DataFrame:
    """The share of matches on either side of a threshold, from its four counts."""
    share = lambda side: F.try_divide(F.col(f"n_match_{side}"), F.col(f"n_match_{side}")
                                      + F.col(f"n_mismatch_{side}")).cast("double").alias(f"match_share_{side}")
    return counted.select("*", share("above"), share("below"))


def threshold_precision(samples: DataFrame, threshold: float, value: str = "value", label: str = "label") -> DataFrame:
    """Among samples strictly above / strictly below a threshold, the share that are matches."""
    above, below = F.col(value) > F.lit(threshold), F.col(value) < F.lit(threshold)
    return threshold_shares(samples.agg(
        F.count_if(above & (F.col(label) == 1)).alias("n_match_above"),
        F.count_if(above & (F.col(label) == 0)).alias("n_mismatch_above"),
        F.count_if(below & (F.col(label) == 1)).alias("n_match_below"),
        F.count_if(below & (F.col(label) == 0)).alias("n_mismatch_below")))
