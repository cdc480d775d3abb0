"""File order, last-wins statistics, bounded nested records and fan-out sinks."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from penprint.operators import corpus, personas
from penprint.session import scratch_path
from penprint.sources import readers, writers


def _local(path):
    return path.removeprefix("file:")


def test_parquet_documents_come_in_file_order(spark):
    path = scratch_path(spark, "ordered")
    number, want = 0, []
    for name, n in (("a", 1), ("b", 300), ("c", 5)):
        rows = [("e", "p", f"text {number + k}") for k in range(n)]
        number += n
        want += [r[2] for r in rows]
        spark.createDataFrame(rows, "entity STRING, persona STRING, text STRING").coalesce(1).write.parquet(f"{path}/{name}")
    got = personas.group_documents(readers.read_documents(spark, f"{path}/*")).collect()
    assert [r.texts for r in got] == [want]


def test_json_lines_come_in_file_order_across_splits(spark):
    path = scratch_path(spark, "lines")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    names = [f"c{k}" for k in range(4000)]
    for part, lines in (("1", names[:2500]), ("2", names[2500:])):
        rows = spark.createDataFrame([("u", n + "x" * 50) for n in lines], "author STRING, body STRING").coalesce(1)
        writers.write_ndjson(rows, f"{path}/{part}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = readers.read_comments(spark, f"{path}/*", file_order="ordinal")
        assert rows.rdd.getNumPartitions() > 5
        got = [r.body.rstrip("x") for r in rows.orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == names


def test_the_last_line_of_repeated_statistics_stands(spark):
    path = scratch_path(spark, "repeated")
    schema = "author STRING, subreddit STRING, num_characters BIGINT, num_comments BIGINT, num_posts BIGINT"
    writers.write_ndjson(spark.createDataFrame([("a", "s", 9, 1, 1), ("b", "s", 2, 1, None)], schema).coalesce(1), f"{path}/1")
    writers.write_ndjson(spark.createDataFrame([("a", "s", 5, 2, 2), ("a", "s", 1, 3, 3), ("a", "t", 4, 4, 4)], schema)
                         .coalesce(1), f"{path}/2")
    got = {(r.author, r.subreddit): (r.num_characters, r.num_comments, r.num_posts)
           for r in readers.read_author_subreddit_stats(spark, f"{path}/*").collect()}
    assert got == {("a", "s"): (1, 3, 3), ("b", "s"): (2, 1, None), ("a", "t"): (4, 4, 4)}


FLAT = ("author STRING, slot INT, subreddit STRING, kind STRING, ordinal BIGINT, title STRING, selftext STRING, url STRING, "
        "body STRING, permalink STRING")


@pytest.mark.parametrize("bound", [200, 1 << 20])
def test_nested_records_are_bounded_and_merge(spark, bound):
    rnd = random.Random(2)
    rows = []
    for author, n in (("few", 3), ("many", 400), ("none", 0)):
        for slot in (0, 1):
            if not n:
                rows.append((author, slot, f"s{slot}", None, None, None, None, None, None, None))
            for k in range(n):
                body = "y" * (900 if rnd.random() < 0.05 else rnd.randint(0, 60))
                if k % 3:
                    rows.append((author, slot, f"s{slot}", "comment", k, None, None, None, f"{k} {body}", f"p{k}"))
                else:
                    rows.append((author, slot, f"s{slot}", "submission", k, f"t{k}", None if k % 2 else body, f"u{k}", None, None))
    flat = spark.createDataFrame(rows, FLAT).repartition(6)
    path = scratch_path(spark, "nested")
    writers.write_ndjson(personas.nest_author_docs(flat, bound), path)
    records = [json.loads(line) for f in glob.glob(f"{_local(path)}/*.json") for line in open(f)]
    assert {r["username"] for r in records} == {"few", "many", "none"}
    assert (len(records) > 50) == (bound == 200)
    for r in records:
        docs = [d for p in r["personas"] for d in p["submissions"] + p["comments"]]
        sizes = [sum(len(v) for v in d.values()) for d in docs]
        assert sum(sizes) <= bound or len(docs) == 1
    got = sorted(tuple("" if x is None else x for x in r) for r in personas.flatten_author_docs(readers.read_author_infos(spark, path)).collect())
    want, at = [], {}
    for a, s, c, kind, _, *fields in sorted((r for r in rows if r[3]), key=lambda r: (r[0], r[1], r[3], r[4])):
        place = at[a, s, kind] = at.get((a, s, kind), -1) + 1
        want.append(tuple("" if x is None else x for x in (a, s, c, kind, place, *fields)))
    assert got == sorted(want)


def test_records_without_chunks_are_read(spark):
    path = scratch_path(spark, "plain-records")
    line = {"username": "a", "personas": [{"subreddit": "x", "submissions": [], "comments": [{"body": "b", "permalink": "p"}]},
                                          {"subreddit": "y", "submissions": [{"title": "t", "selftext": "", "url": "u"}], "comments": []}]}
    spark.createDataFrame([(json.dumps(line),)], "value STRING").write.text(path)
    got = sorted((r.slot, r.kind, r.position) for r in personas.flatten_author_docs(readers.read_author_infos(spark, path)).collect())
    assert got == [(0, "comment", 0), (1, "submission", 0)]


def test_fan_out_writes_few_files(spark):
    rows = spark.range(100_000, numPartitions=200).select("id", (F.col("id") * 86_400 % (86_400 * 365)).alias("created_utc"))
    path = scratch_path(spark, "days")
    writers.write_day_shards(corpus.with_utc_day(rows), path)
    files = glob.glob(f"{_local(path)}/day=*/*.json")
    assert 31 <= len(files) <= 62
    assert spark.read.json(path).count() == 100_000
