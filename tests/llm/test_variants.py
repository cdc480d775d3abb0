import random
import re
import zlib
from collections import Counter

from cases import documents, rows
from penprint.llm import variants


def edits_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_counts(data, min_length=6, min_count=5):
    count = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= min_length:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= min_count}


def plain_groups(count):
    out = {}
    for w, n in count.items():
        near = [v for v in count if edits_one(w, v)]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        form = best if best is not None and count[best] >= 5 * n else None
        out[w] = (form, len(near))
    rows_ = []
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows_.append((w, form, root, count[w], n_near, count[form] if form else None))
    return sorted(rows_)


def collected(df):
    return sorted(map(tuple, df.collect()))


def letters(rnd, n, alphabet="abé"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def test_groups_equal_a_plain_version(spark):
    rnd = random.Random(3)
    count = {letters(rnd, rnd.randint(6, 9)): rnd.choice([5, 5, 6, 25, 30, 150, 900]) for _ in range(1200)}
    count |= {"abł" + letters(rnd, 5): 7 for _ in range(40)} | {"x" * 40_000: 50, "x" * 40_001: 9, "x" * 20_000 + "y" * 20_000: 9}
    words = spark.createDataFrame(list(count.items()), "word string, n bigint").repartition(5)
    assert collected(variants.group_variants(words)) == plain_groups(count)


def test_hot_keys_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(variants, "TILE_ROWS", 60)
    rnd = random.Random(4)
    count = {"common" + letters(rnd, 5) + "ending": rnd.randint(5, 400) for _ in range(700)}
    words = spark.createDataFrame(list(count.items()), "word string, n bigint")
    tiles = variants._tiles(variants._keys(words, 6)).groupBy("key", "i", "j").count()
    assert tiles.where("j > 0").count() > 3 and tiles.agg({"count": "max"}).first()[0] < 250
    assert collected(variants.group_variants(words)) == plain_groups(count)
    pairs = [tuple(sorted((r.a, r.b))) for r in variants.near_pairs(words).collect()]
    assert len(pairs) == len(set(pairs))


def test_words_of_documents(spark):
    data = rows() + [(30, "Letters LETTERS lettErs, leters; Ähnlich ähnlich×÷ " * 9), (31, "leters letters " * 400),
                     (None, "letters Letterz " * 6)]
    data += [(100 + k, "spelling variant grouping") for k in range(600)]
    count = plain_counts(data)
    docs = documents(spark, data)
    assert dict(variants.word_counts(docs).collect()) == count
    assert collected(variants.spelling_variants(docs)) == plain_groups(count)


def test_chains_end_at_the_last_form(spark):
    count = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "cccccc": 5,
             "cccccd": 25, "cccdcd": 25, "ccccce": 25}
    words = spark.createDataFrame(list(count.items()), "word string, n bigint")
    got = {r.word: r for r in variants.group_variants(words).collect()}
    assert got["aaaaaa"].root == "abbbbb" and got["aaaaaa"].form == "aaaaab"
    assert got["cccccc"].form == "cccccd" and got["cccccc"].n_near == 2 and got["cccccd"].form is None
    assert collected(variants.group_variants(words)) == plain_groups(count)


def test_empty_tables(spark):
    assert variants.spelling_variants(documents(spark, [])).collect() == []
    assert variants.spelling_variants(documents(spark, [(1, None), (2, "")])).collect() == []
