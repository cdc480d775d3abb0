from penprint.plans import bindings as B
from penprint.session import scratch_path
from penprint.sources import writers
from penprint.streaming.incremental import clean_new_submissions
from penprint.operators import corpus


def test_incremental_filter_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    subs = B.submissions(spark, sf)
    src = scratch_path(spark, "stream-src")
    writers.write_ndjson(subs, src)
    flags = corpus.nsfw_flags(subs)
    out = scratch_path(spark, "stream-out")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    for _ in range(2):  # the second run finds nothing new
        q = clean_new_submissions(spark, src, out, B.ignored_authors(spark), flags, checkpoint)
        q.awaitTermination(300)
    got = spark.read.parquet(out)
    want = corpus.filter_submissions(subs, B.ignored_authors(spark), flags)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
