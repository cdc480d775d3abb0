"""The embedding job: registered models, batch sizes, widths."""

import glob
import os
import tempfile
import uuid

import numpy as np
import pytest

from penprint.operators import scoring, vectors


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="penprint-models-")


def wide(width, folder=None):
    def build():
        if folder:
            open(f"{folder}/built-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def run(texts):
            if folder:
                with open(f"{folder}/calls-{os.getpid()}", "a") as f:
                    f.write(f"{len(texts)}\n")
            return np.array([[len(t) + k for k in range(width)] for t in texts], np.float32).reshape(len(texts), width)
        return run
    return build


def docs(spark, n=1000, parts=10):
    return spark.createDataFrame([(f"e{k % 50}", "p", "x" * (k % 7)) for k in range(n)],
                                 "entity STRING, persona STRING, text STRING").repartition(parts)


def test_models_are_built_once_per_worker_and_see_batches_of_their_size(spark, folder):
    model = vectors.Embedder(wide(96, folder), batch_size=32)
    assert vectors.embed_texts(docs(spark), ["entity"], embedder=model).count() == 1000
    rows = vectors.embed_texts(docs(spark), ["entity", "text"], embedder=model).collect()
    assert all(list(r.embedding) == [len(r.text) + k for k in range(96)] for r in rows)
    built = [os.path.basename(f).split("-")[1] for f in glob.glob(f"{folder}/built-*")]
    assert len(built) == len(set(built))
    calls = [int(x) for f in glob.glob(f"{folder}/calls-*") for x in open(f)]
    assert max(calls) == 32 and sum(c == 32 for c in calls) > sum(1 < c < 32 for c in calls)
    assert {len(r.embedding) for r in vectors.embed_texts(docs(spark, 40, 1), ["entity"], embedder=model, batch_size=7).collect()} == {96}


def test_batches_do_not_follow_arrow_batches(spark, folder):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        model = vectors.Embedder(wide(3, folder), batch_size=64)
        vectors.embed_texts(docs(spark, 200, 1), ["entity"], embedder=model, width=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    calls = [int(x) for f in glob.glob(f"{folder}/calls-*") for x in open(f)]
    assert sorted(calls) == [8, 64, 64, 64]


@pytest.mark.parametrize("width", [1, 64, 65, 768])
def test_means_are_as_wide_as_the_vectors(spark, width):
    means = scoring.embedding_personas(docs(spark, 300), vectors.Embedder(wide(width))).collect()
    assert len(means) == 50
    text = {f"e{k}": [j % 7 for j in range(k, 300, 50)] for k in range(50)}
    for r in means:
        want = np.mean([[n + k for k in range(width)] for n in text[r.entity]], axis=0)
        assert np.allclose(r.embedding, want) and len(r.embedding) == width


def test_unequal_widths_fail(spark):
    def ragged():
        return lambda texts: np.zeros((len(texts), 5 if any(len(t) == 6 for t in texts) else 4), np.float32)
    with pytest.raises(Exception, match="gave an array of shape"):
        vectors.embed_texts(docs(spark, 300), ["entity"], embedder=vectors.Embedder(ragged, batch_size=1), width=4).collect()
    with pytest.raises(Exception, match="gave an array of shape"):
        vectors.embed_texts(docs(spark, 3), ["entity"], embedder=lambda texts: np.zeros(len(texts)), width=0).collect()
    mixed = spark.createDataFrame([("a", "p", [1.0, 2.0]), ("a", "p", [1.0])], "entity STRING, persona STRING, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="different widths"):
        vectors.persona_embeddings(mixed, ["entity", "persona"]).collect()
    pairs = spark.createDataFrame([("e0", "p", "old", "p")], "entity1 STRING, persona1 STRING, entity2 STRING, persona2 STRING")
    cache = spark.createDataFrame([("old", "p", [1.0, 2.0, 3.0])], "entity STRING, persona STRING, embedding ARRAY<DOUBLE>")
    more = docs(spark, 50).union(spark.createDataFrame([("old", "p", "x")], "entity STRING, persona STRING, text STRING"))
    with pytest.raises(Exception, match="different widths"):
        scoring.run_inference("EMBEDDING_MODEL", more, pairs, embedder=vectors.Embedder(wide(4)), cache=cache).collect()


def test_a_name_needs_a_registered_model(spark):
    for name in ("nomic", "e5", "anything"):
        with pytest.raises(ValueError, match="no model is registered"):
            vectors.embed_texts(docs(spark, 2), ["entity"], embedder=name)
    vectors.register_embedder("e5", wide(2))
    try:
        rows = vectors.embed_texts(docs(spark, 8, 1), ["text"], embedder="e5").collect()
        assert all(r.embedding[0] == len("passage: ") + len(r.text) for r in rows)
    finally:
        del vectors.EMBEDDERS["e5"]


def test_empty_tables(spark):
    none = docs(spark, 2).where("false")
    assert scoring.embedding_personas(none, vectors.Embedder(wide(9))).collect() == []
    assert vectors.embed_texts(none, ["entity"], embedder=vectors.Embedder(wide(9))).collect() == []
