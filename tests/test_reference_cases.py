"""The reference's own test cases, re-expressed on DataFrames."""

import numpy as np
from pyspark.sql import functions as F

from penprint.operators import personas, scoring, vectors
from penprint.sources import readers, writers
from penprint.session import scratch_path


def test_documents_grouping_keeps_order_and_ignores_extra_columns(spark):
    docs = spark.createDataFrame(
        [("d1", "entity1", "persona1", "first", 0), ("d2", "entity1", "persona1", "second", 1),
         ("d3", "entity1", "persona2", "third", 2)],
        "document_id STRING, entity STRING, persona STRING, text STRING, ordinal INT")
    path = scratch_path(spark, "docs-test")
    writers.write_parquet(docs.coalesce(1), path)
    read = readers.read_documents(spark, path)
    assert read.columns == ["entity", "persona", "text"]
    want = {("entity1", "persona1"): ["first", "second"], ("entity1", "persona2"): ["third"]}
    assert {(r.entity, r.persona): r.texts for r in personas.group_documents(read).collect()} == want
    assert {(r.entity, r.persona): r.texts for r in personas.group_documents(docs, "ordinal").collect()} == want


def test_documents_with_wrong_types_are_rejected(spark):
    import pytest
    bad = spark.createDataFrame([(1, "p", "t")], "entity INT, persona STRING, text STRING")
    with pytest.raises(ValueError):
        readers.validate_documents(bad)
    with pytest.raises(ValueError):
        readers.validate_pairs(spark.createDataFrame([("a", "b")], "entity1 STRING, persona1 STRING"))


def _scoring_inputs(spark):
    docs = spark.createDataFrame([
        ("jekyll", "jekyll", "I do not think he does. He doesn't, does he?"),
        ("jekyll", "jekyll", "Do it as he does; don't wait."),
        ("jekyll", "hyde", "He does what he does, and I don't. He does."),
        ("robert", "robert", "We do, you do, they do; do what you do."),
        ("robert", "robert", "I do it as it does."),
        ("silent", "silent", "Nothing here is said the same way at all."),
    ], "entity STRING, persona STRING, text STRING")
    pairs = spark.createDataFrame([
        ("jekyll", "jekyll", "jekyll", "hyde"),
        ("jekyll", "jekyll", "robert", "robert"),
        ("jekyll", "jekyll", "silent", "silent"),
    ], "entity1 STRING, persona1 STRING, entity2 STRING, persona2 STRING")
    tokens = spark.createDataFrame([(0, "does"), (1, "do"), (2, "don"), (3, "doesn")], "rank INT, token STRING")
    return docs, pairs, tokens


def test_log_likelihood_end_to_end_match_scores_higher(spark):
    docs, pairs, tokens = _scoring_inputs(spark)
    scores = scoring.run_inference("LOG_LIKELIHOOD_MODEL", docs, pairs, model_tokens=tokens)
    rows = {(r.entity2, r.persona2): r.match_score for r in scores.collect()}
    assert len(rows) == 3
    assert rows[("jekyll", "hyde")] > rows[("robert", "robert")]
    assert rows[("silent", "silent")] == 0.0  # no in-set token observed


def test_log_likelihood_value_matches_numpy(spark):
    docs, pairs, tokens = _scoring_inputs(spark)
    scores = {(r.entity2, r.persona2): r.match_score
              for r in scoring.run_inference("LOG_LIKELIHOOD_MODEL", docs, pairs, model_tokens=tokens).collect()}
    # by hand: model persona jekyll/jekyll, observation jekyll/hyde
    import re
    pat = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
    model = pat.findall("I do not think he does. He doesn't, does he?") + pat.findall("Do it as he does; don't wait.")
    obs = pat.findall("He does what he does, and I don't. He does.")
    toks = ["does", "do", "don", "doesn"]
    c = np.array([model.count(t) for t in toks], dtype=float)
    o = np.array([obs.count(t) for t in toks], dtype=float)
    adj = np.concatenate([c + 0.5, [len(model) - c.sum() + 0.5]])
    logf = (np.log2(adj) - np.log2(adj.sum()))[:-1]
    assert abs(scores[("jekyll", "hyde")] - float((o * logf).sum() / o.sum())) < 1e-12


def test_pairs_keep_duplicates_and_unknown_persona_raises(spark):
    import pytest
    docs, pairs, tokens = _scoring_inputs(spark)
    dup = pairs.union(pairs.limit(1))
    out = scoring.run_inference("LOG_LIKELIHOOD_MODEL", docs, dup, model_tokens=tokens)
    assert len(out.collect()) == 4
    bad = spark.createDataFrame([("jekyll", "jekyll", "nobody", "none")],
                                "entity1 STRING, persona1 STRING, entity2 STRING, persona2 STRING")
    with pytest.raises(KeyError):
        scoring.run_inference("LOG_LIKELIHOOD_MODEL", docs, bad, model_tokens=tokens, check="eager")
    with pytest.raises(Exception, match="persona without documents"):
        scoring.run_inference("LOG_LIKELIHOOD_MODEL", docs, bad, model_tokens=tokens).collect()


def test_model_roundtrip_keeps_token_order(spark):
    toks = spark.createDataFrame([(0, 11, " the"), (1, 7, "’s"), (2, 3, " \n ")],
                                 "rank INT, token_index INT, token STRING")
    path = scratch_path(spark, "model-test")
    writers.write_log_likelihood_model(toks, path)
    kind, back = readers.read_model(spark, path)
    assert kind == "LOG_LIKELIHOOD_MODEL"
    assert [(r.rank, r.token_index, r.token) for r in back.orderBy("rank").collect()] == \
        [(0, 11, " the"), (1, 7, "’s"), (2, 3, " \n ")]


def test_embedding_averages_with_dummy_embedder(spark):
    # 8 texts "1".."8" over 3 authors with 1, 2 and 5 personas; one-hot of int(text) % 4.
    rows = [("a", 0, "1"), ("b", 0, "2"), ("b", 1, "3"),
            ("c", 0, "4"), ("c", 1, "5"), ("c", 2, "6"), ("c", 3, "7"), ("c", 4, "8")]
    docs = spark.createDataFrame(rows, "author STRING, persona INT, text STRING")
    extra = spark.createDataFrame([("c", 4, "2")], "author STRING, persona INT, text STRING")
    docs = docs.union(extra)

    def one_hot(texts):
        out = np.zeros((len(texts), 4), dtype=np.float32)
        for i, t in enumerate(texts):
            out[i, int(t) % 4] = 1.0
        return out
    keys = ["author", "persona"]  # not unique: two documents of one persona stay two vectors
    vecs = vectors.embed_texts(docs, keys, "text", embedder=one_hot)
    assert vecs.count() == 9
    got = {(r.author, r.persona): [round(x, 6) for x in r.embedding]
           for r in vectors.persona_embeddings(vecs, keys, 4).collect()}
    assert got[("a", 0)] == [0, 1, 0, 0]
    assert got[("c", 4)] == [0.5, 0, 0.5, 0]
    assert len(got) == 8


def test_hashing_embedding_counts_and_normalises(spark):
    docs = spark.createDataFrame([("a", "x x y"), ("a", "x x y"), ("b", ""), ("c", None)], "k STRING, text STRING")
    rows = vectors.embed_texts(docs, ["k"], "text", "hashing", 32).collect()
    assert len(rows) == 4
    for r in rows:
        values = sorted(v for v in r.embedding if v)
        if r.k == "a":
            assert [round(v, 9) for v in values] == [round(v / 5 ** 0.5, 9) for v in (1.0, 2.0)]
        else:
            assert values == [] and len(r.embedding) == 32


def test_embedder_by_name_gets_its_prefix(spark):
    import pytest
    docs = spark.createDataFrame([("a", "text")], "k STRING, text STRING")
    vectors.EMBEDDERS["e5"] = lambda texts: np.array([[len(t), t.startswith("passage: ")] for t in texts])
    try:
        row = vectors.embed_texts(docs, ["k"], "text", "e5").first()
    finally:
        del vectors.EMBEDDERS["e5"]
    assert list(row.embedding) == [13.0, 1.0]
    with pytest.raises(ValueError):
        vectors.embed_texts(docs, ["k"], "text", "unheard of")
    with pytest.raises(ValueError, match="no model is registered"):
        vectors.embed_texts(docs, ["k"], "text", "nomic")


def test_embedding_scores_project_and_use_the_cache(spark):
    docs = spark.createDataFrame([("a", "0", "1"), ("a", "0", "2"), ("b", "0", "1"), ("c", "0", "3")],
                                 "entity STRING, persona STRING, text STRING")
    pairs = spark.createDataFrame([("a", "0", "b", "0"), ("c", "0", "b", "0")],
                                  "entity1 STRING, persona1 STRING, entity2 STRING, persona2 STRING")

    def one_hot(texts):
        if any(t == "3" for t in texts):
            raise AssertionError("a cached persona was embedded")
        return np.eye(4, dtype=np.float32)[[int(t) % 4 for t in texts]]

    cache = spark.createDataFrame([("c", "0", [0.0, 2.0, 0.0, 0.0]), ("unasked", "0", [1.0, 0.0, 0.0, 0.0])],
                                  "entity STRING, persona STRING, embedding ARRAY<DOUBLE>")
    weight, bias = np.array([[1.0, 0, 0, 0], [0, 1, 1, 0]]), np.array([0.5, -0.25])
    out = scoring.run_inference("EMBEDDING_MODEL", docs, pairs, embedder=one_hot, dim=4, layers=[(weight, bias)], cache=cache)
    got = {r.entity1: r.match_score for r in out.collect()}
    project = lambda v: weight @ np.array(v) + bias
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    b = project([0, 1, 0, 0])
    assert abs(got["a"] - cos(project([0, 0.5, 0.5, 0]), b)) < 1e-9 and abs(got["c"] - cos(project([0, 2, 0, 0]), b)) < 1e-9


def test_model_files_are_strict(spark):
    import pytest
    for text in ('{"model_type": "LOG_LIKELIHOOD_MODEL", "model_params": {"tokens": []}, "more": 1}',
                 '{"model_type": "LOG_LIKELIHOOD_MODEL", "model_params": {"tokens": [], "k": 2}}',
                 '{"model_type": "LOG_LIKELIHOOD_MODEL", "model_params": {"tokens": [{"token_index": 1, "string": "a", "x": 0}]}}',
                 '{"model_type": "OTHER", "model_params": {}}'):
        path = scratch_path(spark, "bad-model")
        spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.text(path)
        with pytest.raises(ValueError):
            readers.read_model(spark, path)
    path = scratch_path(spark, "embedding-model")
    writers.write_embedding_model(spark, path, "e5", "average_posts", "/models/one")
    kind, params = readers.read_model(spark, path)
    assert kind == "EMBEDDING_MODEL" and params.first().embedding_model == "e5"


def test_damaged_lines_are_errors_and_names_are_trimmed(spark):
    import pytest
    path = scratch_path(spark, "damaged")
    spark.createDataFrame([('{"author": "a", "subreddit": "s"}',), ("{broken",)], "value STRING").write.text(path)
    with pytest.raises(Exception):
        readers.read_submissions(spark, path).collect()
    path = scratch_path(spark, "names")
    spark.createDataFrame([("\t a b \u00a0",), ("a b",), ("c\r",)], "value STRING").write.text(path)
    assert sorted(r.author for r in readers.read_line_list(spark, path).collect()) == ["a b", "c"]
