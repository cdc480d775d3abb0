import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cases import documents, prose, rows
from penprint.llm import decontamination, quality, quality_rules, sharding, urls

SPACE = r"\x20\x09-\x0D"


# Quality classifier.

def labelled(n=240):
    """Good prose, and bad documents whose second half is shouting or symbols."""
    rnd = random.Random(3)
    data, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(100 + i, rnd.randint(60, 300))
        if not good:
            text += "\n" + " ".join(w.upper() + "!!" if i % 8 else w + "###" for w in prose(900 + i, 200).split())
        data.append((i, text))
        labels.append((i, int(good), 0))
    return data, labels


def test_classifier_learns_from_document_labels(spark):
    data, labels = labelled()
    table = spark.createDataFrame(labels + [(3, 0, 0), (None, 1, 0), (5, None, 0), (9999, 1, 0)],
                                  "doc_id bigint, quality int, toxic int")
    docs = documents(spark, data + [r for r in rows() if r[0] is None or r[0] > 3])
    model = quality.learn(docs, table)
    out = quality.score(docs, model).collect()
    assert len(out) == docs.count()
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert not any(r.held_out for r in out if r.doc_id is None)
    again = quality.learn(docs, table)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.3 for r in out)


def test_classifier_without_labels_or_texts(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.score for r in quality.score(docs, quality.learn(docs, none)).collect()}
    assert got == {0.0, 0.5}
    one = spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, one)).collect()} == {0.0, 1.0}
    empty = documents(spark, [])
    assert quality.score(empty, quality.learn(empty, one)).collect() == []


def test_gradients_and_attention_in_pieces():
    """The score of a document is the attention-weighted mean over its passages, however they were batched."""
    data, labels = labelled(60)
    import pyarrow as pa
    texts = pa.array([t for _, t in data] + [None, " "])
    rows_, offsets = quality.passages(texts)
    bags = [rows_[a:b] for a, b in zip(offsets[:-3], offsets[1:-2], strict=True)]
    target = np.array([q for _, q, _ in labels], float)
    model = quality.fit(bags, target, np.ones(len(bags)), 0.75)
    whole = model.scores(texts)
    assert np.allclose(whole[:5], [model.scores(texts.slice(i, 1))[0] for i in range(5)], atol=1e-5)
    logit, value = model.passage_values(bags[0])
    weight = np.exp(logit - logit.max())
    expected = 1 / (1 + math.exp(-((weight * value).sum() / weight.sum() + model.weights["b"])))
    assert abs(whole[0] - expected) < 1e-5 and whole[-1] == whole[-2] == 0


# Quality rules.

def plain_rules(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{SPACE}]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def test_rules_equal_a_plain_version(spark):
    rnd = random.Random(9)
    data = rows() + [(100 + k, "".join(rnd.choice(["a ", "b ", "c\n", "d|", "é\t", "\n", "a b c d e ", "#", " "])
                                       for _ in range(rnd.randint(0, 80)))) for k in range(120)]
    good = spark.createDataFrame([(5, 1), (9, 1), (10, 1), (12, 1), (12, None), (15, 1), (15, 0), (None, 1)],
                                 "doc_id bigint, quality int")
    out = quality_rules.judge(documents(spark, data), good, buckets=1 << 10).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in out), key=repr)
    assert got == sorted(((i, *plain_rules(t)) for i, t in data), key=repr)
    assert all(r.kept == (not r.base_failed and r.score >= quality_rules.CUT) for r in out)
    assert quality_rules.judge(documents(spark, []), good).collect() == []


def test_ratio_drops_what_the_target_never_has(spark):
    data, labels = labelled(120)
    table = spark.createDataFrame([(i, q) for i, q, _ in labels], "doc_id bigint, quality int")
    docs = documents(spark, data)
    out = {r.doc_id: r for r in quality_rules.judge(docs, table, buckets=1 << 12).collect()}
    truth = {i: q for i, q, _ in labels}
    good, bad = ([out[i].score for i in truth if truth[i] == v] for v in (1, 0))
    assert min(good) > max(bad) and min(good) > quality_rules.CUT
    none = quality_rules.judge(docs, table.where("quality = 7"), buckets=1 << 12).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in none)


def test_rules_plan_has_no_python(spark):
    docs = documents(spark).select("doc_id", "text")
    docs.write.mode("overwrite").parquet(path := _scratch(spark))
    table = spark.createDataFrame([(5, 1)], "doc_id bigint, quality int")
    plan = quality_rules.judge(spark.read.parquet(path), table, buckets=64)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def _scratch(spark):
    from penprint.session import scratch_path
    return scratch_path(spark, "test")


# URL filter.

def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            best = max(best or ("", ""), (verdict, rule), key=lambda r: len(r[1]))
    return host, path, *(best[::-1] if best else (None, None))


def test_url_rules_and_model(spark):
    odd = [None, "", "no scheme", "http://", "http://org", "http://ORG/x", "http://a.Example.ORG/es/1?q#f", "x://y://z/",
           "http://example.org/en/1#a", "http://example.org/en/2", "http://a.com/fr/", "http://a.com/fr", "http://notcom/de/1",
           "https://É.com/de/é?x", "http://b.net#/fr/", "http://a.com?x=/de/", "http://a.net/en/x", "http://a.net/en/x"]
    rnd = random.Random(2)
    data = [(k, u) for k, u in enumerate(odd)] + [(None, "http://c.org/q"), (3, "http://c.org/q")]
    data += [(100 + k, f"http://{prose(k, 1)}.example.{rnd.choice(['org', 'com', 'net'])}/{rnd.choice(['fr', 'de', 'es', 'en'])}/"
              f"{rnd.randint(1, 9999)}") for k in range(200)]
    pages = spark.createDataFrame([(i, u, "h", "v", "r", 1.0) for i, u in data],
                                  "page_id bigint, url string, html string, host string, verdict string, score double")
    out = urls.judge(pages, buckets=1 << 12).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in out), key=repr)
    assert got == sorted(((i, *plain_rule(u)[:3]) for i, u in data), key=repr)
    by_url = dict(data)
    for r in out:
        if r.rule:
            assert r.verdict == dict((b, a) for a, b in urls.RULES)[r.rule]
        assert r.verdict in ("allow", "block")
    blocked = [r.score for r in out if r.rule and r.verdict == "block"]
    allowed = [r.score for r in out if r.rule and r.verdict == "allow"]
    assert np.mean(allowed) > np.mean(blocked)
    cut = round((np.mean(allowed) + np.mean(blocked)) / 2, 6)
    assert all(r.verdict == ("allow" if r.score >= cut else "block") for r in out if not r.rule and abs(r.score - cut) > 1e-5)
    assert by_url[16] == by_url[17]
    plan = urls.judge(pages, buckets=64)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert urls.judge(pages.where("page_id < 0")).collect() == []


def test_url_score_equals_a_plain_markov_model(spark):
    """Without hash collisions the score is that of interpolated models counted with dictionaries."""
    data = [(1, "http://a.org/x1"), (2, "http://b.org/x2"), (3, "http://a.com/de/q"), (4, "http://c.com/de/zz"),
            (5, "http://a.net/x1q")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(data, "page_id bigint, url string"),
                                             buckets=1 << 16).collect()}
    text = {i: "".join(plain_rule(u)[:2]) for i, u in data}
    counts = {}
    for side, ids in (("allow", (1, 2)), ("block", (3, 4))):
        counts[side] = Counter(text[i][p - k:p + 1] for i in ids for k in range(5) for p in range(k, len(text[i])))

    def likelihood(t, c):
        total, out_ = sum(v for g, v in c.items() if len(g) == 1), 0.0
        for i in range(len(t)):
            p = (c[t[i]] + urls.PULL / urls.ALPHABET) / (total + urls.PULL)
            for k in range(1, 5):
                gram, seen = (c[t[i - k:i + 1]], c[t[i - k:i]]) if i >= k else (0, 0)
                p = (gram + urls.PULL * p) / (seen + urls.PULL)
            out_ += math.log(p)
        return out_

    for i, t in text.items():
        assert abs(out[i].score - (likelihood(t, counts["allow"]) - likelihood(t, counts["block"])) / len(t)) < 1e-9


def test_url_counts_share_nothing_at_any_size(spark):
    """With more n-grams than any fixed table, the score is still that of exact counts."""
    data = [(k, f"http://{prose(k, 2).replace(' ', '')}{k}.{('org/', 'com/de/', 'net/')[k % 3]}{prose(9000 + k, 8).replace(' ', '-')}")
            for k in range(1800)] + [(5000, "http://a.org/x"), (5001, "http://a.org/x")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(data, "page_id bigint, url string")).collect()}
    text = {i: "".join(plain_rule(u)[:2]) for i, u in data}
    counts = {side: Counter(text[i][p - k:p + 1] for i, u in data if plain_rule(u)[3] == side for k in range(5)
                            for p in range(k, len(text[i]))) for side in ("allow", "block")}
    total = {side: sum(v for g, v in c.items() if len(g) == 1) for side, c in counts.items()}

    def likelihood(t, side):
        c, out_ = counts[side], 0.0
        for i in range(len(t)):
            p = (c[t[i]] + urls.PULL / urls.ALPHABET) / (total[side] + urls.PULL)
            for k in range(1, min(i, 4) + 1):
                p = (c[t[i - k:i + 1]] + urls.PULL * p) / (c[t[i - k:i]] + urls.PULL)
            out_ += math.log(p)
        return out_

    assert len(out) == len(data)
    for i, t in text.items():
        assert abs(out[i].score - (likelihood(t, "allow") - likelihood(t, "block")) / len(t)) < 1e-9


def test_urls_without_both_kinds_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.net/")], "page_id bigint, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages).collect()} == {1: ("org/", "allow"), 2: (None, "allow")}


# Decontamination.

def test_items_are_found_wherever_they_stand(spark):
    items = [(k, prose(500 + k, n)) for k, n in enumerate((5, 9, 12, 30, 60, 64, 65, 130, 400))]
    items += [(20, None), (21, ""), (22, "four words are few"), (23, items[3][1]), (None, prose(600, 20))]
    data = rows()
    for k, (_, t) in enumerate(items):
        data.append((1000 + k, prose(700 + k, 37 * k) + " " + (t or "") + ". " + prose(800 + k, 50)))
    half = items[4][1].split()
    data.append((2000, prose(1, 20) + " " + " ".join(half[:30]) + " " + prose(2, 90)))
    data.append((2001, items[4][1].upper().replace(" ", ", ") + "!"))
    punct = str.maketrans({c: " " for c in r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""})

    def grams(w):
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    want = set()
    for n, (i, t) in enumerate(data):
        mine = grams((t or "").translate(punct).lower().split())
        for j, item in items:
            w = (item or "").translate(punct).lower().split()
            if len(w) < 5:
                have = (t or "").translate(punct).lower().split()
                if w and any(have[k:k + len(w)] == w for k in range(len(have))):
                    want.add((repr(i), repr(j)))
                continue
            cut = max(5, -(-len(w) // 4))
            cut = cut if len(w) - cut >= 5 else len(w)
            parts = grams(w[:max(len(w) - cut, 5)]), grams(w[-cut:])
            if all(len(p & mine) >= 0.8 * len(p) for p in parts):
                want.add((repr(i), repr(j)))
    docs = documents(spark, data)
    table = spark.createDataFrame([(j, t, "x") for j, t in items], "item_id bigint, text string, doc_id string")
    scores = []
    for index_bytes in (decontamination.INDEX_BYTES, 1500):
        out = decontamination.contaminated_pairs(docs, table, index_bytes=index_bytes).collect()
        assert {(repr(r.doc_id), repr(r.item_id)) for r in out} == want and len(want) >= 11
        scores.append(sorted((repr(r.doc_id), repr(r.item_id), round(r.score, 9)) for r in out))
        left = decontamination.clean(docs, table, index_bytes=index_bytes)
        assert left.columns == docs.columns
        bad = {i for i, _ in want}
        assert sorted(repr(r.doc_id) for r in left.collect()) == sorted(repr(i) for i, _ in data if repr(i) not in bad)
    assert scores[0] == scores[1]
    assert decontamination.contaminated_pairs(documents(spark, []), table).collect() == []
    assert decontamination.contaminated_pairs(docs, table.where("item_id < 0")).collect() == []


def test_one_changed_word_hides_no_item():
    """A copy that has 0.8 of its item's shingles is found whichever word was changed, in the short answer too."""
    import pyarrow as pa
    items = [prose(900 + n, n) for n in (9, 15, 16, 24, 29, 30, 40, 59)]
    index = decontamination.Index(list(range(len(items))), items)
    texts, want = [], set()
    for k, item in enumerate(items):
        w = item.split()
        for at in range(len(w)):
            changed = w[:at] + ["changed"] + w[at + 1:]
            grams = [{tuple(x[j:j + 5]) for j in range(len(x) - 4)} for x in (w, changed)]
            if len(grams[0] & grams[1]) >= 0.8 * len(grams[0]):
                want.add((len(texts), k))
            texts.append("some words before it " + " ".join(changed) + " and some more words behind")
    found = {(d, i) for d, i, *_ in index.matches(pa.array(texts))}
    assert want <= found and len(want) > 130


def test_block_bounds_lose_no_segment():
    """Every passage that scores a segment at the threshold or above has the segment's block alive."""
    import pyarrow as pa
    rnd = random.Random(1)
    vocabulary = prose(1, 60).split()
    index = decontamination.Index(list(range(80)), [" ".join(rnd.choices(vocabulary, k=20)) for _ in range(80)])
    text = " ".join(rnd.choices(vocabulary, k=64))
    words, _ = decontamination.hashed_words(pa.array([text]), True, decontamination.PUNCTUATED)
    terms = index.coded(words)
    where, block = index.live(terms, np.zeros(len(words), np.int64), np.ones(len(words), bool))
    mark = np.isin(np.arange(len(index.terms)), terms)
    scores = np.bincount(index.seg, index.weight * mark[index.term])
    strong = np.flatnonzero(scores >= decontamination.THRESHOLD)
    assert len(strong) and set((strong // decontamination.BLOCK).tolist()) <= set(block[where == 0].tolist())
    assert np.allclose(np.bincount(index.seg, index.weight), 1)


# Sharding.

@pytest.mark.parametrize("bits,axes", [(3, 2), (2, 3), (4, 3), (1, 4)])
def test_hilbert_curve_visits_neighbours(bits, axes):
    cells = np.array(list(np.ndindex(*[1 << bits] * axes)))
    place = sharding.hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_equal_runs_of_the_curve(spark, tmp_path):
    import zlib
    data = rows() + [(50, prose(3, 20))] * 40
    docs = documents(spark, data)
    out = sharding.assign(docs, shards=8).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == len(data) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k]))
    runs = [(min(c), max(c)) for c in ([r.curve for r in out if r.shard == k] for k in range(8))]
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:], strict=False))
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    sharding.write_ordered(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == docs.columns and back.count() == len(data)
    assert sharding.assign(documents(spark, [])).collect() == []


def test_values_with_a_common_prefix_get_bins_of_their_own(spark):
    data = [(k, f"common_crawl_{k % 8:02d}") for k in range(160)] + [(900, None)]
    docs = spark.createDataFrame(data, "doc_id bigint, source string")
    out = docs.select("source", sharding.curve(docs, ("source",)).alias("curve")).distinct().collect()
    assert len(out) == 9 and len({r.curve for r in out if r.source}) == 8
    known = sorted((r.source, r.curve) for r in out if r.source)
    assert [c for _, c in known] == sorted(c for _, c in known)
    assert sharding._value_limits(docs, "source", 4) == [f"common_crawl_{k:02d}" for k in (1, 3, 5)]
    assert sharding._value_limits(docs.where("source is null"), "source", 4) == []
