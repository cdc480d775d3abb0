import corpus_pipeline
from cases import documents, rows
from penprint.llm import pii


def test_stages_apply_to_what_is_left(spark, tmp_path):
    """Every stage takes odd rows, keeps the columns of its input, and its decision reaches the next one."""
    item = "a test question of some length that nobody would write by chance and its short answer here"
    data = rows() + [(60, f"before {item} after"), (61, "mail me at some.one@mail.example.com please " * 3),
                     (62, rows()[4][1] + " and mail a@b.com now")]
    docs = documents(spark, data)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 0, 0), (5, 1, 0), (9, 1, 0), (13, 0, 0), (17, 0, 0), (12, 1, None)],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates",
                                                      "benchmark decontamination", "personal data", "packing"]
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = [before]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], str(tmp_path))
        if k < 4:
            assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/out{k}"))
    ids = [[r[0] for r in s.select("doc_id").collect()] for s in steps]
    assert all(ids[k].count(i) >= ids[k + 1].count(i) for k in range(4) for i in set(ids[k]))
    texts = {r.doc_id: (r.text, r.n_chars) for r in steps[4].collect()}
    assert all(t == pii.redacted(t) and n == len(t) for t, n in texts.values() if t is not None)
    if 60 in ids[2]:
        assert 60 not in ids[3]
    assert set(ids[5]) == set(ids[4])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == steps[5].columns
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, steps[5].collect()))
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_registered_queries():
    from __spark_entry__ import queries
    names = set(queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q[:q.index("_") + 1] for q in names if q.startswith("op")}
    assert "pipeline" in names
