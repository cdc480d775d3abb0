import random

import numpy as np
import pyarrow as pa
import pytest

from penprint.llm import tokenizing
from penprint.llm import words as W

PARTS = ["a", "Bé", "é", " ", "\n", "\t", "\x0b", "xy", "漢", "  ", " ", "　", " ", "\x85", "\x1c", "1", "23",
         "'s", "'", "!", ".", ",", "<|endoftext|>", "<|", "\r\n", "ß", "Ã", "​", "🙂", "À"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [
        None, "", " ", "a" * 300, "b " * 300]


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_words_and_runs_match_plain_splitting(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE", piece)
    some = texts(300)
    hashes, offsets = W.hashed_words(pa.array(some), True)
    runs, inside = W.rolling(hashes, 3), W.inside_texts(offsets, 3)
    known, known_runs = {}, {}
    for i, text in enumerate(some):
        expected = (text or "").encode().lower().split()
        assert len(expected) == offsets[i + 1] - offsets[i]
        for k, word in enumerate(expected):
            p = offsets[i] + k
            assert known.setdefault(word, hashes[p]) == hashes[p]
            if p < len(runs):
                assert inside[p] == (k + 3 <= len(expected))
            if k + 3 <= len(expected):
                assert known_runs.setdefault(tuple(expected[k:k + 3]), runs[p]) == runs[p]
    assert len(set(known.values())) == len(known) and len(set(known_runs.values())) == len(known_runs)


def test_giant_words_and_sliced_columns():
    some = ["z" * (3 << 20) + " q " + "w" * 70_000, None, "q"]
    hashes, offsets = W.hashed_words(pa.array(some), False)
    assert offsets.tolist() == [0, 3, 3, 4] and hashes[1] == hashes[3]
    sliced, _ = W.hashed_words(pa.array(some).slice(2, 1), False)
    assert sliced.tolist() == [hashes[3]]


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_ids_equal_the_library_s(monkeypatch, size):
    from tokenizers import Tokenizer
    monkeypatch.setattr(tokenizing, "BATCH_BYTES", size)
    plain = Tokenizer.from_file(tokenizing.public_path("byte_bpe_50k.json"))
    some = texts(2000, 2) + ["word  foo.\n" * 400]
    expected = [e.ids for e in plain.encode_batch([t or "" for t in some], add_special_tokens=False)]
    tool = tokenizing.Encoder("byte_bpe_50k.json")
    for _ in range(2):  # the second time from memory
        assert tool.lengths(pa.array(some)).tolist() == [len(x) for x in expected]
        got = [[] for _ in some]
        for i, ids in tool.ids(pa.array(some)):
            got[i] += ids.tolist()
        assert got == expected


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_vocabularies_without_safe_cuts_are_encoded_whole(name):
    some = ["Hello  World, this is\n a test.", "", None, "ümläut"]
    tool = tokenizing.Encoder(name)
    assert not tool.splits
    if name.endswith(".model"):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=tokenizing.public_path(name))
        expected = [len(lib.encode(t or "")) for t in some]
    else:
        from tokenizers import Tokenizer
        lib = Tokenizer.from_file(tokenizing.public_path(name))
        expected = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in some]
    assert tool.lengths(pa.array(some)).tolist() == expected
    assert np.array_equal(tool.lengths(pa.array(some)), expected)


def complement_pair(length, letters):
    """A Thue-Morse string and its complement: equal under every polynomial modulo 2^64 from 1,024 letters on."""
    bits = np.zeros(1, np.int64)
    while len(bits) < length:
        bits = np.concatenate([bits, 1 - bits])
    return ["".join(letters[b] for b in x) for x in (bits[:length], 1 - bits[:length])]


@pytest.mark.parametrize("length", [64, 1024, 4096, 65_536])
def test_complement_strings_are_different_words(length):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizing.public_path("byte_bpe_50k.json"))
    for letters in ("ab", "09", "xZ"):
        pair = complement_pair(length, letters)
        hashes, _ = W.hashed_words(pa.array(pair), True)
        assert hashes[0] != hashes[1]
        expected = [e.ids for e in plain.encode_batch(pair, add_special_tokens=False)]
        tool = tokenizing.Encoder("byte_bpe_50k.json")
        assert tool.lengths(pa.array(pair)).tolist() == [len(x) for x in expected]
        got = [[], []]
        for i, ids in tool.ids(pa.array(pair)):
            got[i] += ids.tolist()
        assert got == expected


def test_parts_that_share_the_first_lane_stay_apart(monkeypatch):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tokenizing.public_path("byte_bpe_50k.json"))
    def weak(data, begins, ends):
        first, second = W.name_spans(data, begins, ends)
        return first & np.uint64(3), mix(second + mix(first))

    mix = W.mix
    monkeypatch.setattr(tokenizing, "name_spans", weak)
    some = texts(300, 5)
    tool = tokenizing.Encoder("byte_bpe_50k.json")
    expected = [len(e.ids) for e in plain.encode_batch([t or "" for t in some], add_special_tokens=False)]
    for _ in range(2):
        assert tool.lengths(pa.array(some)).tolist() == expected


def test_spans_hash_by_their_bytes_alone():
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abABé") for _ in range(rnd.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 255, 256, 257, 900])))
                    for _ in range(3000)})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    sizes = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(sizes + 1) - 1
    for fold in (False, True):
        first, second = W.name_spans(data, ends - sizes, ends, fold)
        want = {w.lower() if fold else w for w in words}
        assert len(set(first.tolist())) == len(set(zip(first.tolist(), second.tolist(), strict=True))) == len(want)
        long = sizes > 8
        assert len(set(second[long].tolist())) == len({w.lower() if fold else w for w in words if len(w.encode()) > 8})
        for w, x, y in list(zip(words, first, second, strict=True))[::37]:
            alone = np.frombuffer(w.encode(), np.uint8)
            got = W.name_spans(alone, np.array([0]), np.array([len(alone)]), fold)
            assert (got[0][0], got[1][0]) == (x, y)


def test_trailing_zero_bytes_count():
    data = np.array([97, 0, 97, 0, 0, 97], np.uint8)
    first, second = W.name_spans(data, np.array([0, 2, 5]), np.array([2, 5, 6]))
    assert len(set(first.tolist())) == 3 and len(set(second.tolist())) == 1
