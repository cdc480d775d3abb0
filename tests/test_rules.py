"""Edge cases of the selection rules, orders and thresholds (strict vs. inclusive, nulls, ties)."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.functions.columns import sha256_mod_100, utc_day_of_month
from penprint.operators import corpus, evaluate, graph, indexing, learners, pairing, similarity, tokens, vectors


def test_nsfw_flags_and_filter(spark):
    subs = spark.createDataFrame([
        ("u1", "s1", True), ("u1", "s1", None), ("ign", "s1", True),   # s1: 2/(3+0.1) > .1 -> flagged
        ("u2", "s2", True), ("u2", "s2", False), ("u2", "s2", False), ("u2", "s2", False),
        ("u2", "s2", False), ("u2", "s2", False), ("u2", "s2", False), ("u2", "s2", False),
        ("u2", "s2", False), ("u2", "s2", False),                      # s2: 1/10.1 < .1 -> not flagged
    ], "author STRING, subreddit STRING, over_18 BOOLEAN")
    for c in ["id", "subreddit_id", "subreddit_name_prefixed", "selftext", "title", "url"]:
        subs = subs.withColumn(c, F.lit("x"))
    flags = {r.subreddit: r.flagged for r in corpus.nsfw_flags(subs).collect()}
    assert flags == {"s1": True, "s2": False}
    ign = spark.createDataFrame([("ign",)], "author STRING")
    kept = corpus.filter_submissions(subs, ign).collect()
    # s1: over-18 post dropped, null over_18 kept, ignored author dropped; s2: over-18 kept (unflagged)
    assert sorted((r.subreddit, r.over_18) for r in kept if r.subreddit == "s1") == [("s1", None)]
    assert sum(1 for r in kept if r.subreddit == "s2") == 10


def test_filter_missing_flag_error(spark):
    subs = spark.createDataFrame([("u", "s9", True)], "author STRING, subreddit STRING, over_18 BOOLEAN")
    for c in ["id", "subreddit_id", "subreddit_name_prefixed", "selftext", "title", "url"]:
        subs = subs.withColumn(c, F.lit("x"))
    flags = spark.createDataFrame([("other", True)], "subreddit STRING, flagged BOOLEAN")
    ign = spark.createDataFrame([], "author STRING")
    with pytest.raises(Exception, match="without a flag"):
        corpus.filter_submissions(subs, ign, flags, on_missing="error").collect()
    assert corpus.filter_submissions(subs, ign, flags, on_missing="keep").count() == 1


def test_prolific_needs_two_subreddits_inclusive(spark):
    stats = spark.createDataFrame([("a", "s1", 10000), ("a", "s2", 10000), ("b", "s1", 99999), ("c", "s1", 10000),
                                   ("c", "s2", 9999)], "author STRING, subreddit STRING, num_characters BIGINT")
    assert [r.author for r in corpus.prolific_authors(stats, 10000).collect()] == ["a"]


def test_min_count_is_inclusive(spark):
    counts = spark.createDataFrame([("a", 30), ("b", 29)], "author STRING, count BIGINT")
    assert [r.author for r in corpus.at_least(counts, 30).collect()] == ["a"]


def test_enough_tokens_is_strict(spark):
    counts = spark.createDataFrame([("a", 0, "x", 500), ("a", 1, "x", 501), ("b", 0, "x", 501), ("b", 1, "x", 501)],
                                   "author STRING, slot INT, token STRING, n BIGINT")
    tset = spark.createDataFrame([("x", 0)], "token STRING, rank INT")
    assert [r.author for r in tokens.authors_with_enough_tokens(counts, tset, "author", "slot", 500).collect()] == ["b"]


def test_sha256_mod_100_matches_python(spark):
    names = [f"user_{i}" for i in range(300)] + ["", "Ünïcødé", "a" * 200]
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = {r.name: r.b for r in df.select("name", sha256_mod_100("name").alias("b")).collect()}
    for n in names:
        assert got[n] == int(hashlib.sha256(n.encode()).hexdigest(), 16) % 100


def test_utc_day_of_month(spark):
    import datetime
    secs = [0, 86399, 86400, 1714521600, 1717199999, -1]
    df = spark.createDataFrame([(s,) for s in secs], "t BIGINT")
    got = [r.d for r in df.select(utc_day_of_month("t").alias("d")).collect()]
    assert got == [datetime.datetime.fromtimestamp(s, tz=datetime.timezone.utc).day for s in secs]


def test_derangement_two_and_one(spark):
    two = spark.createDataFrame([("a",), ("b",)], "author STRING")
    pairs = {(r.author_a, r.author_b) for r in indexing.derangement_pairs(two, "author").collect()}
    assert pairs == {("a", "b"), ("b", "a")}
    with pytest.raises(ValueError):
        indexing.derangement_pairs(spark.createDataFrame([("a",)], "author STRING"), "author")
    many = spark.createDataFrame([(f"a{i}",) for i in range(57)], "author STRING")
    got = indexing.derangement_pairs(many, "author").collect()
    assert len(got) == 57 and all(r.author_a != r.author_b for r in got)
    assert len({r.author_b for r in got}) == 57


def test_dense_index_and_following_pairs(spark):
    authors = spark.createDataFrame([(f"x{i:03d}",) for i in range(23)], "author STRING")
    got = evaluate.mismatched_pairs(authors).collect()
    names = sorted(f"x{i:03d}" for i in range(23))
    want = {(names[i], names[j]) for i in range(23) for j in range(i + 1, min(i + 5, 23))}
    assert {(r.author_a, r.author_b) for r in got} == want


def test_adjacency_matches_brute_force(spark):
    rng = random.Random(7)
    rows = set()
    for a in range(60):
        for _ in range(rng.randint(1, 12)):
            rows.add((f"a{a}", rng.randint(0, 80)))
    rows |= {("hot", s) for s in range(81)}  # one author in every community
    inc = spark.createDataFrame([(a, s, 100) for a, s in rows], "author STRING, subreddit BIGINT, num_characters BIGINT")
    by_sub = {}
    for a, s in rows:
        by_sub.setdefault(s, set()).add(a)
    want = {}
    for s1, s2 in itertools.combinations(sorted(by_sub), 2):
        shared = by_sub[s1] & by_sub[s2]
        if shared:
            want[(s1, s2)] = (len(shared), next(iter(shared)) if len(shared) == 1 else None)
    for part in (8, 1024):
        edges = graph.subreddit_adjacency(inc, part=part).collect()
        assert {(r.subreddit_a, r.subreddit_b): (r.shared_authors, r.sole_author) for r in edges} == want
    touching = {k: v for k, v in want.items() if max(len(by_sub[k[0]]), len(by_sub[k[1]])) >= 6}
    for part in (5, 1024):
        edges = graph.subreddit_adjacency(inc, 6, part).collect()
        assert {(r.subreddit_a, r.subreddit_b): (r.shared_authors, r.sole_author) for r in edges} == touching


def test_pairs_are_counted_where_the_lists_of_a_community_meet(spark, monkeypatch):
    rng = random.Random(5)
    rows = {(f"a{a:02d}", f"s{rng.randint(0, 30):02d}") for a in range(50) for _ in range(rng.randint(1, 9))}
    rows |= {(f"a{a:02d}", s) for a in range(0, 50, 2) for s in ("s00", "s99")} | {("hot", f"s{s:02d}") for s in range(31)}
    chars = {r: 100 + i for i, r in enumerate(sorted(rows))}
    inc = spark.createDataFrame([(*r, n) for r, n in chars.items()], "author STRING, subreddit STRING, num_characters BIGINT")
    of = {}
    for a, s in rows:
        of.setdefault(s, set()).add(a)
    for cell, part, least in ((20, 7, 12), (20, 1024, 1), (1 << 20, 7, 1)):
        monkeypatch.setattr(graph, "CELL", cell)
        want = {}
        for s1, s2 in itertools.combinations(sorted(of), 2):
            if (shared := of[s1] & of[s2]) and max(len(of[s1]), len(of[s2])) >= least:
                sole = next(iter(shared)) if len(shared) == 1 else None
                want[s1, s2] = (len(shared), sole, chars.get((sole, s1)), chars.get((sole, s2)))
        edges = graph.subreddit_adjacency(inc, least, part)
        assert {tuple(r)[:2]: tuple(r)[2:] for r in edges.collect()} == want
        # Every pair goes to its edge inside a list: no shuffle and no join lies between the unpacked pairs and their count.
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.index("posexplode")]
        pairs = sum(v[0] for v in want.values())
        met = graph.shared_author_rows(inc, least, part)
        assert met.count() == pairs and met.rdd.getNumPartitions() == -(-pairs // cell)
        assert max(r["count"] for r in met.groupBy("s1", "q").count().collect()) <= (3 * cell)


def test_cells_make_every_pair_once_in_short_runs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pairing, "RUN", 5)
    monkeypatch.setattr(pairing, "LOOK", 3)
    monkeypatch.setattr(pairing, "ORDER", 50)
    monkeypatch.setattr(pairing, "ROWS", 4)
    rng = random.Random(11)
    lists = {f"a{a:02d}": sorted(rng.sample(range(40), rng.randint(2, 9))) for a in range(30)} | {"hot": list(range(40))}
    chars = {(a, s): None if (a, s) == ("hot", 3) else 10.5 * i for i, (a, s) in enumerate((a, s) for a in lists for s in lists[a])}
    for large, blocks, least in ((lambda s: True, 1, 1000), (lambda s: True, 4, 7), (lambda s: s % 3 == 0, 3, 20)):
        rows = [(a, large(s), s, chars[a, s]) for a in sorted(lists) for s in sorted(lists[a], key=lambda s: (not large(s), s))]
        pieces = [pa.RecordBatch.from_pydict(dict(zip(("author", "large", "id", "chars"), map(list, zip(*rows[i:i + 11])))),
                                             pa.schema([("author", pa.string()), ("large", pa.bool_()), ("id", pa.int64()), ("chars", pa.float64())]))
                  for i in range(0, len(rows), 11)]
        names = pa.RecordBatch.from_pydict({"id": list(range(40)), "name": [f"s{i:02d}" for i in range(40)]})
        batches, want = list(pairing.batch(least)(iter(pieces))), {}
        for a, communities in lists.items():
            for one, two in itertools.combinations(communities, 2):
                if large(one) or large(two):
                    want.setdefault((f"s{one:02d}", f"s{two:02d}"), []).append((a, chars[a, one], chars[a, two]))
        assert sum(b["pairs"][0].as_py() for b in batches) == sum(map(len, want.values()))
        rows = pa.Table.from_batches([*pairing.split_lists(blocks)(iter(batches)), *pairing.split_names(blocks)(iter([names]))])
        got = {}
        for cell in set(rows["cell"].to_pylist()):
            for out in pairing.edges(iter(rows.filter(pa.compute.field("cell") == cell).to_batches())):
                for lists_of in out.to_pylist():
                    for s1, s2, n, author, c1, c2 in zip(*(lists_of[k] for k in ("s1", "s2", "n", "author", "c1", "c2")), strict=True):
                        assert (min(s1, s2), max(s1, s2)) not in got
                        got[min(s1, s2), max(s1, s2)] = (n, author, *((c1, c2) if s1 < s2 else (c2, c1)))
        assert got == {k: (1, *v[0]) if len(v) == 1 else (len(v), None, None, None) for k, v in want.items()}


def test_lists_travel_in_few_bytes(spark):
    rows = spark.range(2000).select(F.col("id").alias("author"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    rows = rows.select("author", F.pmod(F.xxhash64("author", "k"), F.lit(4000)).alias("subreddit")).distinct()
    inc = rows.select("author", "subreddit", (F.col("subreddit") % 50).alias("num_characters"))
    cells, blocks = graph._cells(inc, 1, graph.PART)
    pairs = graph.shared_author_rows(inc).count()
    assert pairs > 1_500_000 and blocks == 1
    # A pair was a list entry of a name and a number in the shuffle, ten bytes and more.
    assert cells.agg(F.sum(F.length("data"))).first()[0] < 0.3 * pairs


def test_null_keys_are_an_error_without_the_filters_too(spark):
    schema = "author STRING, subreddit STRING, num_characters BIGINT"
    for row, name in (((None, "s1", 5), "author"), (("a", None, 5), "subreddit")):
        with pytest.raises(Exception, match=f"null {name}"):
            graph.subreddit_adjacency(spark.createDataFrame([row, ("a", "s1", 5), ("a", "s2", 5)], schema)).collect()


def test_active_and_chosen_restrict_the_graph(spark):
    stats = spark.createDataFrame([("a", "s1", 5), ("a", "s2", 5), ("b", "s1", 5), ("b", "s2", 5), ("c", "s1", 5),
                                   ("c", "s3", 5)], "author STRING, subreddit STRING, num_characters BIGINT")
    active = spark.createDataFrame([("s1", 1001), ("s2", 1001), ("s3", 1000)], "subreddit STRING, count BIGINT")
    chosen = spark.createDataFrame([("a",), ("c",)], "author STRING")
    inc = graph.graph_incidence(stats, active, authors=chosen)
    assert sorted((r.author, r.subreddit) for r in inc.collect()) == [("a", "s1"), ("a", "s2"), ("c", "s1")]


def test_null_author_is_an_error(spark):
    stats = spark.createDataFrame([(None, "s1", 5), ("a", "s1", 5)], "author STRING, subreddit STRING, num_characters BIGINT")
    with pytest.raises(Exception, match="null author"):
        graph.subreddit_adjacency(graph.graph_incidence(stats)).collect()


def test_repeated_statistics_that_differ_are_an_error(spark):
    rows = [("a", "s1", 5), ("a", "s1", 5), ("a", "s2", 5)]
    schema = "author STRING, subreddit STRING, num_characters BIGINT"
    assert graph.subreddit_adjacency(spark.createDataFrame(rows, schema)).first().shared_authors == 1
    with pytest.raises(Exception, match="repeated statistics"):
        graph.subreddit_adjacency(spark.createDataFrame([*rows, ("a", "s2", 6)], schema)).collect()


def test_an_author_in_very_many_communities_meets_large_ones_only(spark):
    # One author in 50,000 communities, of which 20 are large: 50,000 x 20 pairs, not 50,000 x 50,000.
    hot = spark.range(50_000).select(F.lit("hot").alias("author"), F.col("id").alias("subreddit"), F.lit(100).alias("num_characters"))
    others = spark.range(25).crossJoin(spark.range(20).withColumnRenamed("id", "subreddit")).select(
        F.concat(F.lit("m"), "id").alias("author"), "subreddit", F.lit(100).alias("num_characters"))
    inc = hot.unionByName(others)
    rows = graph.shared_author_rows(inc, 20)
    assert rows.count() == 20 * (50_000 - 20) + 26 * 190
    got = graph.suitable_authors(graph.subreddit_adjacency(inc, 20), min_max_neighbours=20, min_chars=50)
    assert [tuple(r) for r in got.collect()] == [("hot", 0, 20)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def _suitable_edges(spark):
    # s1-s2 share only 'a' (a has 10 chars in s1, 100 in s2); s1-s3 share only 'b'; s1-s4 many.
    stats = [("a", 1, 10), ("a", 2, 100), ("b", 1, 100), ("b", 3, 100), ("a", 5, 100), ("b", 5, 100), ("b", 6, 100)]
    stats += [(f"m{i}", s, 100) for i in range(3) for s in (1, 4)]
    return graph.subreddit_adjacency(spark.createDataFrame(stats, "author STRING, subreddit BIGINT, num_characters BIGINT"))


def test_suitable_authors_first_qualifying_pair(spark):
    got = {r.author: (r.subreddit_0, r.subreddit_1)
           for r in graph.suitable_authors(_suitable_edges(spark), min_max_neighbours=3, min_chars=50).collect()}
    # a fails on (1, 2) (10 chars in s1) and has no other single-author pair from a strong subreddit
    assert got == {"b": (1, 3)}


@pytest.mark.parametrize("name", [lambda i: f"s{i:02d}", lambda i: i - 5])
def test_candidates_are_folded_in_the_task_and_dealt_by_community(name, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pairing, "FOLD", 60)
    monkeypatch.setattr(pairing, "HELD", 90)
    rng = random.Random(6)
    kind = pa.string() if isinstance(name(0), str) else pa.int64()
    schema = pa.schema([("a", kind), ("b", kind), ("strong", pa.bool_()), ("author", pa.string())])
    edges = [(name(i), name(j), strong, None if strong else f"u{rng.randint(0, 30)}")
             for i, j in itertools.combinations(range(25), 2) if rng.random() < 0.7 for strong in [i < 20 and rng.random() < 0.05]]
    strong = {s for a, b, yes, _ in edges if yes for s in (a, b)}
    want = {}
    for a, b, _, author in edges:
        for i, j in ((a, b), (b, a)):
            if author and i in strong:
                want[author] = min(want.get(author, (i, j)), (i, j))
    sent, by_target = 0, {}
    for part in (edges[:100], edges[100:101], edges[101:], [e for e in edges if e[2]]):  # four tasks
        batches = [pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*part[at:at + 20])))), schema)
                   for at in range(0, len(part), 20)]
        for out in pairing.fold_candidates(3)(iter(batches)):
            for row in out.to_pylist():
                by_target.setdefault(row["target"], []).append(row["data"])
                sent += len(pairing.unpack(row["data"])[2])
    assert 0 < len(strong) < 25 and sent <= 2 * sum(e[3] is not None for e in edges) and set(by_target) == {0, 1, 2}
    got = {}
    for data in by_target.values():
        for out in pairing.strong_candidates(iter([pa.RecordBatch.from_pydict({"data": data})])):
            for r in out.to_pylist():
                got[r["author"]] = min(got.get(r["author"], (r["i"], r["j"])), (r["i"], r["j"]))
    assert got == want


def test_candidates_are_not_joined_again(spark):
    got = graph.suitable_authors(_suitable_edges(spark), min_max_neighbours=3, min_chars=50)
    # The communities that pass are known where their candidates lie: no stored candidates, no join.
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("b", 1, 3)]


def test_suitable_authors_order_keeps_unlisted_communities(spark):
    order = spark.createDataFrame([(6, 0), (1, 1)], "subreddit BIGINT, subreddit_order INT")
    got = {r.author: (r.subreddit_0, r.subreddit_1) for r in graph.suitable_authors(
        _suitable_edges(spark), min_max_neighbours=3, min_chars=50, order=order).collect()}
    assert got == {"b": (1, 6)}
    other = spark.createDataFrame([(9, 0)], "subreddit BIGINT, subreddit_order INT")
    got = {r.author: (r.subreddit_0, r.subreddit_1) for r in graph.suitable_authors(
        _suitable_edges(spark), min_max_neighbours=3, min_chars=50, order=other).collect()}
    assert got == {"b": (1, 3)}


def test_grid_bucket_matches_brute_force(spark):
    vals = [0.0, -0.05, -0.1, -0.15, -1.0, -19.95, -19.96, -3.3333, -0.0499999, -25.0]
    df = spark.createDataFrame([(v,) for v in vals], "s DOUBLE")
    got = [r.b for r in df.select(evaluate.decreasing_grid_bucket(F.col("s")).alias("b")).collect()]
    grid = np.arange(0, -20, -0.05)
    want = [next((g for g, c in enumerate(grid) if v >= c), 400) for v in vals]
    assert got == want


def test_token_accuracies_match_brute_force(spark):
    rng = np.random.default_rng(3)
    toks = ["t0", "t1", "t2", "t3"]
    rows = []
    for a in range(14):
        for slot in (0, 1):
            for t in toks + ["other"]:
                n = int(rng.integers(0, 4))
                if n:
                    rows.append((f"a{a:02d}", slot, t, n))
    counts = spark.createDataFrame(rows, "author STRING, slot INT, token STRING, n BIGINT")
    cand = spark.createDataFrame([(t, i) for i, t in enumerate(toks)], "token STRING, rank INT")
    authors = spark.createDataFrame([(f"a{a:02d}",) for a in range(14)], "author STRING")
    pairs = evaluate.evaluation_pairs(authors)
    got = {r.token: (r.cutoff, r.accuracy) for r in evaluate.token_accuracies(counts, cand, pairs).collect()}
    c = {}
    for a, s, t, n in rows:
        c[(a, s, t)] = n
    names = sorted({r[0] for r in rows} | {f"a{a:02d}" for a in range(14)})
    grid = np.arange(0, -20, -0.05)
    for t in toks:
        def score(m, o):
            if c.get((o, 1, t), 0) == 0:
                return 0.0
            total = sum(v for (a, s, _), v in c.items() if a == m and s == 0)
            return float(np.log2((c.get((m, 0, t), 0) + 0.5) / (total + 1)))
        match = np.array([score(a, a) for a in names])
        mism = np.array([score(names[i], names[j]) for i in range(len(names))
                         for j in range(i + 1, min(i + 5, len(names)))])
        res = []
        for cut in grid:
            p1 = (match >= cut).mean()
            p2 = (mism >= cut).mean()
            res.append((cut, 0.5 * (p1 + 1 - p2)))
        best = sorted(res, key=lambda x: abs(x[1] - 0.5), reverse=True)[0]
        assert abs(got[t][1] - best[1]) < 1e-12 and abs(got[t][0] - best[0]) < 1e-12


def test_zero_vector_cosine_is_null(spark):
    vecs = spark.createDataFrame([("a", 0, [0.0, 0.0]), ("a", 1, [1.0, 0.0]), ("b", 0, [1.0, 1.0]),
                                  ("b", 1, [0.0, 2.0])], "author STRING, slot INT, embedding ARRAY<FLOAT>")
    vals = vectors.cosine_all_pairs(vecs).collect()
    assert len(vals) == 6
    assert sum(1 for r in vals if r.value is None or r.value != r.value) == 3
    assert {r.label: r.n for r in similarity.moments(vecs).collect()} == {0: 2, 1: 1}
    assert sum(r.label for r in vals) == 2


def test_cosine_all_pairs_aggregates_the_rows_of_all_pairs(spark, tmp_path, monkeypatch):
    import duckdb

    from penprint.plans import catalog

    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in rng.standard_normal(4) * (i != 5)]) for i in range(40)]  # vector 5 is zero
    spark.createDataFrame(rows, "vec_id BIGINT, label INT, embedding ARRAY<FLOAT>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(catalog.SQL["cosine_all_pairs"]).fetchall()}
    monkeypatch.setattr(vectors, "TILE", 8)
    made, operator = [], vectors.cosine_all_pairs
    monkeypatch.setattr(vectors, "cosine_all_pairs", lambda *a, **b: made.append(operator(*a, block=7, **b)) or made[-1])
    got = {r.label: tuple(r)[1:] for r in catalog.QUERIES["cosine_all_pairs"](spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 40 * 39 // 2 - 20, 1: 20} and made[0].count() == 40 * 39 // 2
    for k, v in want.items():  # pairs with the zero vector count, and their value is no number
        assert got[k] == pytest.approx(v, abs=1e-6, nan_ok=True)


def test_pairs_leave_a_block_tile_by_tile(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vectors, "TILE", 10)
    table = pa.RecordBatch.from_pydict({
        "author": [f"a{i // 2}" for i in range(35)], "slot": pa.array([i % 2 for i in range(35)], pa.int32()),
        "embedding": [[1.0, float(i)] for i in range(35)], "side": [0] * 35, "bi": [0] * 35, "bj": [0] * 35})
    sizes = [b.num_rows for b in vectors._pair_rows(iter([table]))]
    assert sum(sizes) == 35 * 34 // 2 and max(sizes) <= 100


def test_exact_median(spark):
    data = [(1, float(v)) for v in [5, 1, 3, 2, 4]] + [(0, float(v)) for v in [1, 2, 3, 10]]
    df = spark.createDataFrame(data, "label INT, value DOUBLE")
    got = {r.label: r.median for r in evaluate.exact_median(df).collect()}
    assert got == {1: 3.0, 0: 2.5}


def test_thresholds_are_strict_on_both_sides(spark):
    data = [(1, 0.0), (1, 0.0), (0, -0.1), (0, 0.2), (1, None), (1, -0.5)]
    df = spark.createDataFrame(data, "label INT, value DOUBLE")
    r = evaluate.threshold_precision(df, 0.0).first()
    assert (r.n_match_above, r.n_mismatch_above, r.n_match_below, r.n_mismatch_below) == (0, 1, 1, 1)
    assert r.match_share_below == 0.5 and r.match_share_above == 0.0


def test_nulls_do_not_count_and_constants_have_a_cutoff(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, None), (0, 2.0)], "label INT, value DOUBLE")
    got = {r.label: (r.n, r.median, r["std"]) for r in evaluate.distribution_summary(df).collect()}
    assert got == {1: (2, 2.0, 0.0), 0: (1, 2.0, 0.0)}
    assert sum(r["count"] for r in evaluate.histogram(df).collect()) == 3
    best = evaluate.spread_grid_cutoffs(df).collect()
    assert len(best) == 5 and best[0].accuracy == 0.5 and best[0].cutoff == 2.0


def _brute_best(samples, n):
    match, other = (np.array([v for k, v in samples if k == label]) for label in (1, 0))
    lo = min(match.min() - 3 * match.std(), other.min() - 3 * other.std())
    hi = max(match.max() + 3 * match.std(), other.max() + 3 * other.std())
    accuracy = [(0.5 * ((match >= c).mean() + 1 - (other >= c).mean()), -g) for g, c in enumerate(np.linspace(lo, hi, 100))]
    return [(-g, round(a, 9)) for a, g in sorted(accuracy, reverse=True)[:n]]


def test_five_best_cutoffs(spark):
    rng = np.random.default_rng(4)
    samples = [(1, float(v)) for v in rng.normal(1, 1, 60)] + [(0, float(v)) for v in rng.normal(0, 1, 80)]
    out = evaluate.spread_grid_cutoffs(spark.createDataFrame(samples, "label INT, value DOUBLE")).collect()
    got = [(r.grid_index, round(r.accuracy, 9)) for r in sorted(out, key=lambda r: r["rank"])]
    assert [a for _, a in got] == [a for _, a in _brute_best(samples, 5)]


def test_best_cutoff_per_key_uses_its_own_totals(spark):
    rows = [("x", 1, -0.01), ("x", 0, -5.0), ("y", 1, -1.0), ("y", 0, -8.0), ("y", 0, -9.0)]
    out = evaluate.best_cutoff_log_grid(spark.createDataFrame(rows, "k STRING, label INT, score DOUBLE"), keys=["k"])
    assert {r.k: r.accuracy for r in out.collect()} == {"x": 1.0, "y": 1.0}


def _vector_table(spark, n=40, dim=5):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, dim)).round(2)
    x[3] = 0
    x[6] = x[8]
    rows = [(f"a{i // 2:02d}", i % 2, [float(v) for v in x[i]]) for i in range(n)]
    pairs = []
    for i, j in itertools.combinations(range(n), 2):
        size = np.linalg.norm(x[i]) * np.linalg.norm(x[j])
        if size:
            pairs.append((int(rows[i][0] == rows[j][0]), float(x[i] @ x[j] / size), rows[i][:2] + rows[j][:2]))
    return spark.createDataFrame(rows, "author STRING, slot INT, embedding ARRAY<DOUBLE>"), pairs


@pytest.mark.parametrize("points", [16, 64, 4096])
def test_summary_takes_two_products_at_most(spark, monkeypatch, points):
    monkeypatch.setattr(vectors.cosine_blocks, "__defaults__", ("author", "slot", 9))
    monkeypatch.setattr(vectors.blocked, "__defaults__", ("author", "slot", 9, False))
    monkeypatch.setattr(similarity, "POINTS", points)
    monkeypatch.setattr(similarity, "MERGE", 3)
    table, pairs = _vector_table(spark, 60)
    runs = []
    product = vectors.cosine_blocks
    monkeypatch.setattr(similarity, "cosine_blocks", lambda *a, **b: runs.append(1) or product(*a, **b))
    got = {r.label: r for r in similarity.summary(table).collect()}
    assert len(runs) <= 2
    for label in (0, 1):
        v = np.array([s for k, s, _ in pairs if k == label])
        assert got[label].n == len(v) and np.isclose(got[label].median, np.median(v), rtol=0, atol=1e-12)
    runs.clear()
    whole = similarity.report(table, 10, 5, 0.5, 0.2, 0.0, 3)
    assert len(runs) == 2
    parts = {"summary": similarity.summary(table), "histogram": similarity.histogram(table, 10),
             "best_cutoffs": similarity.best_cutoffs(table), "threshold": similarity.threshold_precision(table, 0.5),
             "examples": similarity.examples(table, 0.2, 0.0, 3)}
    def rows(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    for name, alone in parts.items():
        assert rows(whole[name]) == rows(alone), name


def test_median_of_equal_and_two_valued_similarities(spark):
    same = [(f"a{i // 2:02d}", i % 2, [1.0, 1.0]) for i in range(30)]
    two = [(f"a{i // 2:02d}", i % 2, [1.0, 0.0] if i < 7 else [0.0, 1.0]) for i in range(30)]
    for data in (same, two):
        table = spark.createDataFrame(data, "author STRING, slot INT, embedding ARRAY<DOUBLE>")
        got = {r.label: r.median for r in similarity.summary(table).collect()}
        for label in (0, 1):
            v = [float(np.dot(x[2], y[2]) / np.linalg.norm(x[2]) / np.linalg.norm(y[2]))
                 for x, y in itertools.combinations(data, 2) if (x[0] == y[0]) == bool(label)]
            assert abs(got[label] - np.median(v)) < 1e-12


def test_rank_sketch_brackets_hold_every_rank():
    rng = np.random.default_rng(5)
    for points in (8, 32, 200):
        sketch = similarity.RankSketch(points, 3)
        for case in range(30):
            parts = [np.sort(rng.normal(size=rng.integers(1, 90)).round(1 if case % 2 else 6)) for _ in range(9)]
            level = [similarity._compress(p, np.ones(len(p)), points) for p in parts]
            rounds = 1
            while len(level) > 1:
                merged = []
                for at in range(0, len(level), 3):
                    v = np.concatenate([x[0] for x in level[at:at + 3]])
                    w = np.concatenate([x[1] for x in level[at:at + 3]])
                    order = np.argsort(v, kind="stable")
                    merged.append(similarity._compress(v[order], w[order], points))
                level, rounds = merged, rounds + 1
            values = np.sort(np.concatenate(parts))
            found = sketch.brackets((*level[0], rounds), set(range(len(values))), values[0], values[-1])
            assert all(lo <= values[r] <= hi for r, (lo, hi) in found.items())


@pytest.mark.parametrize("block", [1024, 7])
def test_similarity_statistics_equal_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors.cosine_blocks, "__defaults__", ("author", "slot", block))
    monkeypatch.setattr(vectors.blocked, "__defaults__", ("author", "slot", block, False))
    table, pairs = _vector_table(spark)
    got = {r.label: r for r in similarity.summary(table).collect()}
    for label in (0, 1):
        v = np.array([s for k, s, _ in pairs if k == label])
        r = got[label]
        assert r.n == len(v) and np.allclose([r.mean, r.median, r["std"], r.min, r.max],
                                             [v.mean(), np.median(v), v.std(), v.min(), v.max()])
    hist = {(r.label, r.bin): r["count"] for r in similarity.histogram(table, 10).collect()}
    for label in (0, 1):
        want, _ = np.histogram([s for k, s, _ in pairs if k == label], 10)
        assert [hist.get((label, b + 1), 0) for b in range(10)] == want.tolist()
    best = sorted(similarity.best_cutoffs(table).collect(), key=lambda r: r["rank"])
    assert [round(r.accuracy, 9) for r in best] == [a for _, a in _brute_best([p[:2] for p in pairs], 5)]
    r = similarity.threshold_precision(table, 0.5).first()
    count = lambda k, side: sum(1 for label, s, _ in pairs if label == k and (s > 0.5 if side else s < 0.5))
    assert (r.n_match_above, r.n_mismatch_above, r.n_match_below, r.n_mismatch_below) == (
        count(1, 1), count(0, 1), count(1, 0), count(0, 0))
    shown = similarity.examples(table, 0.2, 0.0, 3).collect()
    for kind, label, keep, sign in (("true_match", 1, lambda s: s > 0.2, -1), ("false_match", 0, lambda s: s > 0.2, -1),
                                    ("missed_match", 1, lambda s: s < 0.0, 1)):
        want = sorted((sign * round(s, 9), ids) for k, s, ids in pairs if k == label and keep(s))[:3]
        mine = sorted((r.place, (r.author_i, r.slot_i, r.author_j, r.slot_j)) for r in shown if r.kind == kind)
        assert [ids for _, ids in mine] == [ids for _, ids in want]


def test_blocks_of_several_tiles_send_each_vector_to_a_bounded_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GRID", 3)
    monkeypatch.setattr(vectors, "TILE", 4)
    monkeypatch.setattr(similarity, "FOLD", 2)
    monkeypatch.setattr(similarity, "VALUES", 5)
    table, pairs = _vector_table(spark, 60)
    grid = vectors.blocked(table, block=4)
    assert grid.n == 3  # not 15: what is shuffled is the vectors times 3
    bare = vectors.blocked(table.withColumn("embedding", F.col("embedding").cast("array<float>")))
    assert bare.rows.schema["embedding"].dataType.elementType.simpleString() == "float"
    monkeypatch.setattr(vectors.blocked, "__defaults__", ("author", "slot", 4, False))
    for points in (2, 64, 1 << 15):
        monkeypatch.setattr(similarity, "POINTS", points)
        parts = similarity.report(table, 10, 5, 0.5, 0.2, 0.0, 3)
        got = {r.label: r for r in parts["summary"].collect()}
        bins = {(r.label, r.bin): r["count"] for r in parts["histogram"].collect()}
        for label in (0, 1):
            v = np.array([s for k, s, _ in pairs if k == label])
            r = got[label]
            assert r.n == len(v) and np.allclose([r.mean, r.median, r["std"], r.min, r.max],
                                                 [v.mean(), np.median(v), v.std(), v.min(), v.max()], rtol=0, atol=1e-12)
            assert [bins.get((label, b + 1), 0) for b in range(10)] == np.histogram(v, 10)[0].tolist()
    assert [round(r.accuracy, 9) for r in sorted(parts["best_cutoffs"].collect(), key=lambda r: r["rank"])] == [
        a for _, a in _brute_best([p[:2] for p in pairs], 5)]
    shown = [(r.kind, r.place, r.author_i, r.slot_i, r.author_j, r.slot_j) for r in parts["examples"].collect()]
    want = sorted((-round(s, 9), ids) for k, s, ids in pairs if k == 0 and s > 0.2)[:3]
    assert sorted(x[1:] for x in shown if x[0] == "false_match") == [(n, *ids) for n, (_, ids) in enumerate(want)]


def test_even_grid_counts_as_a_search_does():
    rng = np.random.default_rng(3)
    for low, high in ((-1.3, 1.4), (0.1, 0.1 + 1e-9), (0.5, 0.5)):
        points = np.array([low + i * ((high - low) / 99) for i in range(99)] + [high])
        v = np.concatenate([points, np.nextafter(points, 9), np.nextafter(points, -9), rng.uniform(low - 1, high + 1, 999)])
        assert (similarity._upto(points, v) == np.searchsorted(points, v, side="right")).all()
    uneven = np.array([0.0, 0.1, 5.0])
    assert (similarity._upto(uneven, np.array([-1, 0.2, 7.0])) == [0, 2, 3]).all()


def test_examples_show_comments_first(spark):
    found = spark.createDataFrame([("true_match", 0, "a", 0, "a", 1, 0.9)], "kind STRING, place INT, author_i STRING, "
                                  "slot_i INT, author_j STRING, slot_j INT, value DOUBLE")
    docs = spark.createDataFrame([("a", 0, "submission", 1, "p1"), ("a", 0, "comment", 5, "c5"), ("a", 0, "comment", 2, "c2")],
                                 "author STRING, slot INT, kind STRING, ordinal BIGINT, text STRING")
    rows = similarity.with_documents(found, docs, 2).collect()
    assert [(r.side, r.position, r.text) for r in sorted(rows, key=lambda r: (r.side, r.position))] == [
        (0, 0, "c2"), (0, 1, "c5"), (1, 0, None)]


def test_authors_need_exactly_two_personas(spark):
    rows = [("b", 0, [1.0, 0.0]), ("c", 1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "author STRING, slot INT, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="without exactly two personas"):
        vectors.batch_rows(table).collect()


def test_dense_vectors_fill_gaps(spark):
    counts = spark.createDataFrame([("p", "t1", 2), ("p", "t4", 7), ("p", "zz", 5), ("q", "zz", 1)],
                                   "k STRING, token STRING, n BIGINT")
    tset, k = tokens.token_set(spark.createDataFrame([(f"t{i}", i) for i in range(6)] + [("t4", 9)], "token STRING, rank INT"))
    everyone = spark.createDataFrame([("p",), ("q",), ("r",)], "k STRING")
    got = {r.k: (list(r.counts), r.n_total, r.n_in_set, r.n_excluded)
           for r in tokens.persona_vectors(counts, tset, k, ["k"], everyone).collect()}
    assert k == 6 and got == {"p": ([0, 2, 0, 0, 7, 0], 14, 9, 5), "q": ([0] * 6, 1, 0, 1), "r": ([0] * 6, 0, 0, 0)}


def test_token_ids_become_text(spark):
    vocabulary = spark.createDataFrame([(7, "seven"), (8, "eight")], "token_id INT, token STRING")
    ids = spark.createDataFrame([(8,), (9,)], "token_id INT")
    assert {r.token_id: r.token for r in tokens.with_token_text(ids, vocabulary).collect()} == {8: "eight", 9: None}


def test_summary_counts_in_one_scan(spark):
    posts = spark.createDataFrame([("a", "s1"), ("a", "s2"), (None, "s1")], "author STRING, subreddit STRING")
    notes = spark.createDataFrame([("b", "s1"), ("a", "s1")], "author STRING, subreddit STRING")
    r = corpus.activity_summary(posts, notes, 2, 2).first()
    assert (r.n_authors, r.n_active_authors, r.n_subreddits, r.n_active_subreddits) == (3, 1, 2, 1)


def _pairs_with_features(spark, n=60, width=4):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, width))
    y = (x @ np.array([1.5, -1, 0.5, 0]) + rng.normal(size=n) * 0.5 > 0).astype(int)
    long = [(f"a{i}", "b", int(y[i]), "train", j, float(x[i, j])) for i in range(n) for j in range(width)]
    table = spark.createDataFrame(long, "author_a STRING, author_b STRING, label INT, arm STRING, pos INT, value DOUBLE")
    return learners.to_vectors(table), x, y


def test_logistic_regression_equals_numpy(spark):
    data, x, y = _pairs_with_features(spark)
    model = learners.logistic_regression(data)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(50):  # Newton steps on the same objective: mean log loss + |w|^2 / (2 n)
        p = 1 / (1 + np.exp(-(x @ w + b)))
        z = np.hstack([x, np.ones((len(x), 1))])
        grad = z.T @ (p - y) / len(y) + np.append(w, 0) / len(y)
        hess = z.T @ (z * (p * (1 - p))[:, None]) / len(y) + np.diag([1 / len(y)] * x.shape[1] + [0])
        step = np.linalg.solve(hess, grad)
        w, b = w - step[:-1], b - step[-1]
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-3) and abs(model.intercept - b) < 1e-3


def test_pca_equals_numpy(spark):
    data, x, _ = _pairs_with_features(spark)
    scores, ratios = learners.pca_scores(data, 2, 3)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(ratios, (s ** 2 / (s ** 2).sum())[:3])
    want = np.abs(centred @ vt[:2].T)
    got = {r.author_a: np.abs(r.scores) for r in scores.collect()}
    assert all(np.allclose(got[f"a{i}"], want[i]) for i in range(len(x)))


def test_derangement_stays_inside_the_arm(spark):
    authors = spark.createDataFrame([(f"a{i}",) for i in range(60)], "author STRING")
    rows = learners.arm_pairs(authors).collect()
    arm = lambda n: (lambda h: "train" if h < 70 else "val" if h < 85 else "test")(
        int(hashlib.sha256(n.encode()).hexdigest(), 16) % 100)
    assert {r.arm for r in rows} == {"train", "val"}
    assert all(arm(r.author_a) == arm(r.author_b) == r.arm for r in rows)
    assert all((r.author_a == r.author_b) == (r.label == 1) for r in rows)


def test_boosted_trees_learn(spark):
    data, _, _ = _pairs_with_features(spark)
    assert learners.accuracy(learners.boosted_trees(data, 2).transform(data)) > 0.9
