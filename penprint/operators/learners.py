"""Pair features and classifiers (J12 use, M1-M6, A21), trained with ``pyspark.ml``.

Features are built relationally in long form (pair, position, value) from the
per-persona token table, then gathered into one vector per pair (bounded by
the token-set size) for ``pyspark.ml``.

A trained model becomes a table: weights by feature, or tree nodes by number.
Accuracies come from scoring the long features by that table (weights by a join,
trees inside the row), so they can be derived again outside Spark, and the logistic model carries a
certificate, the gradient of its loss at the weights (0 only at the optimum).
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from penprint.functions.columns import capped_bucket
from penprint.operators.indexing import derangement_pairs
from penprint.operators.personas import with_arm
from penprint.session import cut_lineage, scratch_path

# Fixed values of the reference's learners.
GBT_TREES = 100
GBT_STEP = 0.1
GBT_SEED = 42
LR_MAX_ITER = 1000


def labelled_pairs(authors: DataFrame, deranged: DataFrame, author: str = "author") -> DataFrame:
    """U4: same-author pairs (label 1) and derangement pairs (label 0)."""
    a = authors.select(F.col(author).alias("author")).distinct()
    same = a.select(F.col("author").alias("author_a"), F.col("author").alias("author_b"), F.lit(1).alias("label"))
    other = deranged.select("author_a", "author_b", F.lit(0).alias("label"))
    return same.unionByName(other)


def arm_pairs(authors: DataFrame, arms: tuple[str, ...] = ("train", "val"), author: str = "author") -> DataFrame:
    """J12 + U4 inside each arm: (author_a, author_b, label, arm). Both authors of a pair are in its arm."""
    armed = with_arm(authors.select(F.col(author).alias("author")).distinct())
    out = None
    for arm in arms:
        own = armed.where(F.col("arm") == arm).select("author")
        pairs = labelled_pairs(own, derangement_pairs(own, "author")).withColumn("arm", F.lit(arm))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def concat_features(freq_long: DataFrame, pairs: DataFrame, k: int, value: str = "log_freq") -> DataFrame:
    """M1 + M2: [logfreq(persona 0 of a) ; logfreq(persona 1 of b)], width 2k, long form."""
    left = freq_long.where(F.col("slot") == 0).select(F.col("author").alias("author_a"), "rank", F.col(value).alias("v"))
    right = freq_long.where(F.col("slot") == 1).select(F.col("author").alias("author_b"), "rank", F.col(value).alias("v"))
    a = pairs.join(left, "author_a").select(*pairs.columns, F.col("rank").alias("pos"), F.col("v").alias("value"))
    b = pairs.join(right, "author_b").select(*pairs.columns, (F.col("rank") + F.lit(k)).alias("pos"),
                                             F.col("v").alias("value"))
    return a.unionByName(b)


def weighted_features(freq_long: DataFrame, pairs: DataFrame) -> DataFrame:
    """M3: logfreq_with_excluded(persona 0 of a, t) * n(persona 1 of b, t) / sum_t n(persona 1 of b, t);
    zeros when persona 1 of b has no in-set token. Summed over t this is the A16 score."""
    m = freq_long.where(F.col("slot") == 0).select(F.col("author").alias("author_a"), "rank",
                                                   F.col("log_freq_with_excluded").alias("_lf"))
    o = freq_long.where(F.col("slot") == 1).select(F.col("author").alias("author_b"), "rank",
                                                   F.col("n").alias("_n"), F.col("n_in_set").alias("_tot"))
    j = pairs.join(m, "author_a").join(o, ["author_b", "rank"])
    val = F.when(F.col("_tot") == 0, F.lit(0.0)).otherwise(F.col("_lf") * F.col("_n") / F.col("_tot"))
    return j.select(*pairs.columns, F.col("rank").alias("pos"), val.alias("value"))


def to_vectors(long: DataFrame) -> DataFrame:
    """Long features -> (author_a, author_b, label, features: ml Vector); width bounded by the set size."""
    arr = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"].cast("double"))
    keys = [c for c in long.columns if c not in ("pos", "value")]
    g = long.groupBy(*keys).agg(arr.alias("_f"))
    return g.withColumn("label", F.col("label").cast("double")).withColumn("features", array_to_vector("_f")).drop("_f")


def accuracy(pred: DataFrame) -> float:
    return pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def logistic_regression(train: DataFrame):
    """M4: L2 logistic regression (C = 1 -> regParam = 1 / n), no standardisation."""
    return LogisticRegression(maxIter=LR_MAX_ITER, regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0,
                              standardization=False).fit(train)


def boosted_trees(train: DataFrame, depth: int):
    """M5: gradient-boosted trees, 100 trees, step 0.1, seed 42."""
    return GBTClassifier(maxIter=GBT_TREES, maxDepth=depth, stepSize=GBT_STEP, seed=GBT_SEED).fit(train)


def boosted_by_depth(train: DataFrame, depths: tuple[int, ...]) -> list:
    """M5 for several depths at once: one tree's passes are short, so a fit alone leaves most cores waiting."""
    with ThreadPool(len(depths)) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(lambda depth: boosted_trees(train, depth)), depths)


# ---------------------------------------------------------------- models as tables

def loss_derivatives(train: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of sum(log loss) + |w|^2 / 2 at ``weights`` (the intercept, last, is not penalised).

    One pass; each task sends one matrix as wide as the features.
    """
    size = len(weights)

    def sums(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.hstack([x, np.ones((len(x), 1))])
                p = 1.0 / (1.0 + np.exp(-(x @ weights)))
                total[:, :size] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, size] += x.T @ (p - batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    rows = train.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    cells = rows.mapInArrow(sums, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(size * (size + 1))
    for r in cells:
        total[r.cell] = r.value
    total = total.reshape(size, size + 1)
    penalty = np.append(np.ones(size - 1), 0.0)
    return total[:, size] + penalty * weights, total[:, :size] + np.diag(penalty)


def exact_weights(model, train: DataFrame, limit: float = 1e-9, steps: int = 10) -> tuple[np.ndarray, float]:
    """(weights with the intercept last, largest entry of the gradient there): the fitted model's, brought to the
    optimum by Newton steps until the gradient is below ``limit``."""
    weights = np.append(model.coefficients.toArray(), model.intercept)
    gradient, hessian = loss_derivatives(train, weights)
    for _ in range(steps):
        if np.abs(gradient).max() <= limit:
            break
        weights = weights - np.linalg.solve(hessian, gradient)
        gradient, hessian = loss_derivatives(train, weights)
    return weights, float(np.abs(gradient).max())


def weight_rows(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """(pos, weight): one row per feature; the intercept has the position behind the last feature."""
    return spark.createDataFrame([(k, float(w)) for k, w in enumerate(weights)], "pos int, weight double")


def linear_predictions(long: DataFrame, weights: DataFrame) -> DataFrame:
    """(pair columns, prediction) of long features by a table of weights."""
    keys = [c for c in long.columns if c not in ("pos", "value")]
    last = weights.agg(F.max("pos")).first()[0]
    one = long.select(*keys).distinct().select(*keys, F.lit(last).alias("pos"), F.lit(1.0).alias("value"))
    rows = long.select(*keys, "pos", F.col("value").cast("double").alias("value")).unionByName(one).join(weights, "pos")
    return rows.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) > 0).cast("int").alias("prediction"))


def tree_rows(spark: SparkSession, model) -> DataFrame:
    """(tree, node, feature, threshold, low, high, value): the nodes of a boosted model; a leaf has no feature.

    A leaf's value is its prediction times the tree's weight. Read from the files that the model is saved as.
    """
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(model.treeWeights)], "tree int, w double")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").cast("int").alias("tree"), "nodeData.*")
    leaf = F.col("leftChild") < 0
    return nodes.join(weights, "tree").select(
        "tree", F.col("id").alias("node"), F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("low"), F.when(~leaf, F.col("rightChild")).alias("high"),
        F.when(leaf, F.col("prediction") * F.col("w")).alias("value"))


def tree_predictions(long: DataFrame, trees: DataFrame, depth: int) -> DataFrame:
    """(pair columns, prediction) of long features by a table of tree nodes.

    A pair's features meet in one row, which goes down all trees inside its task; the nodes, fewer than
    2^(depth + 1) a tree whatever the pairs are, go there with the function. A tree that asks for a feature
    which the pair has not says nothing, and a pair without any tree's word has no row.
    """
    keys = [c for c in long.columns if c not in ("pos", "value")]
    nodes = trees.select("tree", "node", "feature", "threshold", "low", "high", "value").collect()
    shape = (max(r.tree for r in nodes) + 1, max(r.node for r in nodes) + 1)
    feature, low, high = (np.full(shape, -1, np.int32) for _ in range(3))
    threshold, value, known = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
    for r in nodes:
        known[r.tree, r.node] = True
        if r.feature is None:
            value[r.tree, r.node] = r.value
        else:
            feature[r.tree, r.node], threshold[r.tree, r.node] = r.feature, r.threshold
            low[r.tree, r.node], high[r.tree, r.node] = r.low, r.high
    width = int(feature.max()) + 1

    def walk(batches):
        every = np.arange(shape[0])
        for batch in batches:
            entries = batch.column(len(keys))
            row = np.repeat(np.arange(batch.num_rows), np.diff(entries.offsets.to_numpy()))
            flat = entries.flatten()
            pos = flat.field("pos").to_numpy(zero_copy_only=False)
            x, has = np.full((batch.num_rows, width), np.nan), np.zeros((batch.num_rows, width), bool)
            asked = pos < width
            x[row[asked], pos[asked]] = flat.field("value").to_numpy(zero_copy_only=False)[asked]
            has[row[asked], pos[asked]] = True
            at = np.zeros((batch.num_rows, shape[0]), np.int32)
            alive = np.broadcast_to(known[:, 0], at.shape).copy()
            for _ in range(depth):
                inner, tree = np.nonzero(alive & (feature[every, at] >= 0))
                node = at[inner, tree]
                asks = feature[tree, node]
                alive[inner, tree] = has[inner, asks]
                # Null and NaN go to the high side.
                at[inner, tree] = np.where(x[inner, asks] <= threshold[tree, node], low[tree, node], high[tree, node])
            alive &= feature[every, at] < 0
            total = np.where(alive, value[every, at], 0.0).sum(axis=1)
            out = pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], pa.array((total > 0).astype(np.int32))],
                                             names=[*keys, "prediction"])
            yield out.filter(pa.array(alive.any(axis=1)))

    gathered = long.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("pos").cast("int").alias("pos"), F.col("value").cast("double").alias("value"))).alias("_x"))
    schema = StructType([*(long.schema[c] for c in keys), StructField("prediction", IntegerType())])
    return gathered.mapInArrow(walk, schema)


def accuracy_by_arm(predictions: DataFrame) -> DataFrame:
    """(arm, n, n_correct, accuracy)."""
    right = F.count_if(F.col("prediction") == F.col("label").cast("int"))
    return predictions.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), right.alias("n_correct"),
                                          (right / F.count(F.lit(1))).alias("accuracy"))


def pca_scores(data: DataFrame, k: int = 3, top: int = 5) -> tuple[DataFrame, list[float]]:
    """M6: centre (no scaling), PCA; scores on the first ``k`` components and the
    explained-variance ratio of the first ``top``. Component signs are arbitrary."""
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_c").fit(data)
    centred = scaler.transform(data)
    model = PCA(k=top, inputCol="_c", outputCol="_p").fit(centred)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    scores = model.transform(centred).select("author_a", "author_b", "label",
                            F.slice(vector_to_array("_p"), 1, k).alias("scores"))
    return scores, ratios


def hist2d(x_y: DataFrame, keys: list[str], bins: int = 30) -> DataFrame:
    """Bins x bins counts of (x, y) per key, each axis over its own min..max."""
    rng = x_y.groupBy(*keys).agg(F.min("x").alias("_xl"), F.max("x").alias("_xh"),
                                 F.min("y").alias("_yl"), F.max("y").alias("_yh"))
    j = x_y.join(rng, keys)
    b = j.select(*keys, capped_bucket("x", "_xl", "_xh", bins).alias("bx"),
                 capped_bucket("y", "_yl", "_yh", bins).alias("by"))
    return b.groupBy(*keys, "bx", "by").agg(F.count(F.lit(1)).alias("count"))
