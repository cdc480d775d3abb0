"""Models as tables: scored by joins, and derived again outside Spark."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.operators import learners as LRN

WIDTH = 6


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(240):
        x = rng.normal(size=WIDTH).round(3)
        label = int(x[0] - 0.5 * x[1] + 0.4 * x[2] * x[3] + rng.normal() * 0.5 > 0)
        rows += [(f"a{k}", f"b{k}", label, "train" if k % 3 else "val", p, float(v)) for p, v in enumerate(x)]
    return spark.createDataFrame(rows, "author_a STRING, author_b STRING, label INT, arm STRING, pos INT, value DOUBLE").cache()


def arm_accuracy(predictions):
    return {r.arm: (r.n, r.n_correct, round(r.accuracy, 9)) for r in LRN.accuracy_by_arm(predictions).collect()}


def ml_accuracy(model, long):
    out = model.transform(LRN.to_vectors(long)).select("arm", "label", F.col("prediction").cast("int").alias("prediction"))
    return arm_accuracy(out)


def test_logistic_weights_are_the_optimum(spark, long):
    train = LRN.to_vectors(long).where("arm = 'train'").cache()
    model = LRN.logistic_regression(train)
    weights, gradient = LRN.exact_weights(model, train)
    assert gradient <= 1e-9
    rows = train.collect()
    x = np.array([np.append(r.features.toArray(), 1.0) for r in rows])
    y = np.array([r.label for r in rows])
    p = 1 / (1 + np.exp(-x @ weights))
    assert np.abs(x.T @ (p - y) + np.append(weights[:-1], 0)).max() < 1e-8
    assert np.abs(weights - np.append(model.coefficients.toArray(), model.intercept)).max() < 1e-2
    got = arm_accuracy(LRN.linear_predictions(long, LRN.weight_rows(spark, weights)))
    val = {r.author_a: np.append(r.features.toArray(), 1.0) @ weights > 0 for r in LRN.to_vectors(long).collect()}
    want = {}
    for r in LRN.to_vectors(long).collect():
        n, right = want.get(r.arm, (0, 0))
        want[r.arm] = (n + 1, right + int(val[r.author_a] == bool(r.label)))
    assert {k: v[:2] for k, v in got.items()} == want and got["val"][2] > 0.7


@pytest.mark.parametrize("depth", [2, 4])
def test_tree_tables_score_as_the_model_does(spark, long, tmp_path, depth):
    model = LRN.boosted_trees(LRN.to_vectors(long).where("arm = 'train'"), depth)
    trees = LRN.tree_rows(spark, model).cache()
    assert trees.select("tree").distinct().count() == LRN.GBT_TREES
    got = arm_accuracy(LRN.tree_predictions(long, trees, depth))
    assert got == ml_accuracy(model, long) and got["train"][2] > 0.8 and got["val"][2] > 0.6
    trees.write.parquet(f"{tmp_path}/trees")
    long.write.parquet(f"{tmp_path}/long")
    again = duckdb.connect().execute(f"""WITH RECURSIVE t AS (SELECT * FROM '{tmp_path}/trees/*.parquet'),
        f AS (SELECT * FROM '{tmp_path}/long/*.parquet'),
        walk AS (SELECT DISTINCT author_a, arm, label, t.tree, 0 AS node FROM f, t
                 UNION ALL
                 SELECT w.author_a, w.arm, w.label, w.tree, CASE WHEN f.value <= t.threshold THEN t.low ELSE t.high END
                 FROM walk w JOIN t ON t.tree = w.tree AND t.node = w.node AND t.feature IS NOT NULL
                 JOIN f ON f.author_a = w.author_a AND f.pos = t.feature),
        score AS (SELECT author_a, arm, label, sum(t.value) AS s FROM walk w JOIN t USING (tree, node) WHERE t.feature IS NULL GROUP BY ALL)
        SELECT arm, count(*), count(*) FILTER (WHERE (s > 0) = (label = 1)) FROM score GROUP BY arm""").fetchall()
    assert {arm: (n, right) for arm, n, right in again} == {k: v[:2] for k, v in got.items()}


def test_trees_are_walked_inside_the_row_and_absent_features_say_nothing(spark, long):
    trees = spark.createDataFrame(
        [(0, 0, 0, 0.5, 1, 2, None), (0, 1, None, None, None, None, -1.0), (0, 2, 1, 0.0, 3, 4, None),
         (0, 3, None, None, None, None, 2.0), (0, 4, None, None, None, None, -3.0),
         (1, 0, None, None, None, None, 0.5)],
        "tree int, node int, feature int, threshold double, low int, high int, value double")
    some = spark.createDataFrame(
        [("a", 0, 0.5), ("a", 1, 9.0), ("b", 0, 0.6), ("b", 1, 0.0), ("c", 0, 0.7), ("c", 1, None), ("d", 0, float("nan")),
         ("d", 1, -1.0), ("e", 0, 2.0), ("f", 7, 1.0)], "id string, pos int, value double")
    got = {r.id: r.prediction for r in LRN.tree_predictions(some, trees, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1, "f": 1}
    # Without the tree that is one leaf, pairs that lack what the other asks for have no row.
    assert {r.id for r in LRN.tree_predictions(some, trees.where("tree = 0"), 2).collect()} == set("abcd")
    # No row for each pair and tree: nothing is joined or written step by step.
    plan = LRN.tree_predictions(some, trees, 2)._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1
    models = LRN.boosted_by_depth(LRN.to_vectors(long).where("arm = 'train'").limit(40), (1, 2))
    assert [max(t.depth for t in m.trees) for m in models] == [1, 2]


def test_model_gbt_says_whether_trees_are_missing_and_chance_is_beaten(spark, monkeypatch):
    from penprint.plans import catalog
    long = spark.createDataFrame([("a", "b", 1, "train", 0, 0.5)], "author_a STRING, author_b STRING, label INT, arm STRING, pos INT, value DOUBLE")
    for n, right in ((100, 1), (99, 0)):
        trees = spark.range(n).selectExpr("cast(id as int) AS tree")
        predicted = spark.createDataFrame([("train", 1, right), ("val", 1, 1)], "arm STRING, label INT, prediction INT")
        monkeypatch.setattr(catalog, "_boosted", lambda *_, t=trees, p=predicted: iter([("gbt2", t, long, p)]))
        assert {(r.finished, r.beats_chance) for r in catalog.QUERIES["model_gbt"](spark, "").collect()} == {(n == 100, right == 1)}
