import tracemalloc
import zlib

import numpy as np

from cases import documents, rows
from penprint.llm import packing
from penprint.llm.packing import fill, pack
from penprint.llm.token_counts import count_tokens
from penprint.llm.tokenizing import public_path


def _library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_path("byte_bpe_50k.json"))


def _ids(text):
    return _library().encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library_s(spark):
    got = sorted(map(tuple, count_tokens(documents(spark)).collect()), key=repr)
    lib = _library()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512)
            for i, t in rows()]
    assert got == sorted(want, key=repr)
    assert count_tokens(documents(spark, [])).collect() == []


def test_every_id_lies_in_exactly_one_piece(spark):
    pieces = pack(documents(spark), window=256, shard_bytes=200_000).collect()
    lib = _library()
    ids = [(i, np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in rows()]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 256
    # Every document, repeated ones too, is covered from its first to its last id.
    want = sorted((repr(i), len(x)) for i, x in ids)
    starts = sorted((repr(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0)
    assert starts == want
    unique = {i: x for i, x in ids if i not in (None, 15, 16)}
    for i, x in unique.items():
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(x[at:at + p.length].tobytes())
            at += p.length
        assert at == len(x)
    total = sum(len(x) for _, x in ids)
    assert sum(p.length for p in pieces) == total
    # Only the last window of a shard is not full; tasks end with a shard that may be small.
    shards = 2 * total // 200_000 + len({s >> 32 for s in sequences})
    assert len(sequences) * 256 - total <= 256 * shards
    assert pack(documents(spark, [])).collect() == []


def test_neighbours_share_terms():
    """A seed is followed by the unused document that shares its rare terms, not by the next one."""
    docs = [np.array(x, np.uint16) for x in ([5, 6, 7, 8], [1, 2, 3, 4], [5, 6, 7, 9], [1, 2, 3, 10])]
    order = [(d, q) for d, _, _, q, _ in fill(docs, 16, 8)]
    assert order == [(0, 0), (2, 0), (1, 1), (3, 1)]
    assert list(fill([], 16, 8)) == []


def test_neighbours_equal_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, rng.integers(1, 120)).clip(1, 900).astype(np.uint16) for _ in range(400)]
    docs += [docs[7], docs[7], docs[9][:5], np.array([], np.uint16)]
    index = packing.Index(docs, 1024)
    lens = np.array([len(d) for d in docs])
    sets = [np.unique(d, return_counts=True) for d in docs]
    df = np.zeros(1024)
    for t, _ in sets:
        df[t] += 1
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    free = rng.random(len(docs)) < 0.8
    for seed in (0, 7, 9, 50, 401, 402):
        asked = set(sets[seed][0].tolist())
        score = np.array([sum(np.float32(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / lens.mean())))
                              for t, f in zip(*s, strict=True) if t in asked) for s, n in zip(sets, lens, strict=True)])
        want = sorted((i for i in range(len(docs)) if free[i] and score[i] > 0), key=lambda i: (-score[i], i))[:packing.NEIGHBOURS]
        got = index.neighbours(seed, free).tolist()
        assert np.allclose(score[got], score[want], rtol=1e-6) and len(got) == len(want)
        strict = [i for i in want if abs(score[i] - score[want[-1]]) > 1e-4]
        assert set(strict) <= set(got)
    assert index.neighbours(403, free).tolist() == []


def test_equal_texts_share_windows_at_any_number_of_shards(spark):
    rnd = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rnd.integers(0, 5000, rnd.integers(20, 120))) for _ in range(600)]
    data = [(k, t) for k, t in enumerate(base)] + [(1000 + k, t) for k, t in enumerate(base)]
    shared = []
    for shard_bytes in (1 << 30, 40_000, 8_000):
        windows = {}
        for p in pack(documents(spark, data), window=1024, shard_bytes=shard_bytes).collect():
            windows.setdefault(p.doc_id, set()).add(p.sequence_id)
        shared.append(sum(bool(windows[k] & windows[1000 + k]) for k in range(600)))
    assert shared[0] > 500 and min(shared) >= 0.9 * shared[0]


def test_lexical_keys_meet_for_copies_and_likely_for_near_copies():
    rng = np.random.default_rng(5)
    meet = 0
    for _ in range(200):
        ids = rng.integers(0, 50_000, 300)
        near = ids.copy()
        near[rng.integers(0, 300, 5)] = 7
        assert packing.lexical_keys(ids) == packing.lexical_keys(ids.astype(np.uint16).astype(np.uint32))
        meet += packing.lexical_keys(ids)[0] == packing.lexical_keys(near)[0]
    assert meet > 140
    assert packing.lexical_keys(np.array([1])) != packing.lexical_keys(np.array([2]))


def test_index_of_a_shard_takes_few_numbers_an_id():
    rng = np.random.default_rng(0)
    docs = [(rng.zipf(1.3, rng.integers(1, 2500)) % 50_000).astype(np.uint16) for _ in range(400)]
    tracemalloc.start()
    index = packing.Index(docs, 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * sum(map(len, docs))
    terms = [np.unique(d) for d in docs]
    assert all((index.term[index.first[i]:index.first[i + 1]] == t).all() for i, t in enumerate(terms))


def test_free_memory_goes_back_and_encoders_are_dropped():
    import psutil

    from penprint.llm import tokenizing
    from penprint.llm.words import release
    process = psutil.Process()
    # Blocks too small to be mapped one by one, the last of them still in use: without a trim all stay with the process.
    blocks = [bytes([k % 256]) * 100_000 for k in range(2000)]
    last = blocks[-1]
    held = process.memory_info().rss
    del blocks
    release()
    assert held - process.memory_info().rss > 100e6 and len(last) == 100_000
    tokenizing.encoder("byte_bpe_50k.json")
    tokenizing.forget()
    assert not tokenizing._encoders
