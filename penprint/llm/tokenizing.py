"""Batch encoding with a public tokenizer inside Arrow functions.

A text is split at safe boundaries: in front of ASCII white space that follows
a visible character, and between an ASCII letter and a full stop or comma. A
byte-level BPE never joins characters across such a boundary, so encoding the
parts one by one gives exactly the ids of the whole text. Equal parts of a
batch are encoded once, and every Python worker remembers the parts it met in
flat arrays of bounded length, keyed by the parts' 128-bit hashes.

Vocabularies of another kind (with a normaliser, a prefix space or white-space
pieces) have no such boundary; their texts are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from penprint.llm.words import SPACE, name_spans, text_buffers

# Bytes of text encoded together.
BATCH_BYTES = 1 << 20
# Parts of text remembered by a Python worker (about 38 bytes each); longer parts are not kept.
MEMORY = 1_200_000
LONGEST_KEPT = 64

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True


def public_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (asked for inside the task)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions where the bytes of a text may be cut without changing its ids."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    behind = _VISIBLE[data[:-1]]
    # U+00C0..U+00FF are C3 80..BF; other wide characters may be white space, so no cut is made there.
    behind[1:] |= (data[1:-1] >= 0x80) & (data[:-2] == 0xC3)
    cut = SPACE[data[1:]] & behind
    cut |= _STOP[data[1:]] & _LETTER[data[:-1]]
    return np.flatnonzero(cut) + 1


class Memory:
    """Ids of parts by hash: sorted first lanes, second lanes to be sure, and places in one flat array."""

    def __init__(self, kind):
        self.keys = np.zeros(0, np.uint64)
        self.sure = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, kind)

    def find(self, keys: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Place of every key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (self.sure[at] == sure), at, -1)

    def add(self, keys: np.ndarray, sure: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        room = MEMORY - len(self.keys)
        if room <= 0 or not len(keys):
            return
        keys, sure, sizes = keys[:room], sure[:room], sizes[:room]
        starts = np.cumsum(sizes) - sizes + len(self.flat)
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.sure = np.concatenate([self.sure, sure])[order]
        self.start = np.concatenate([self.start, starts])[order]
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])[order]
        self.flat = np.concatenate([self.flat, flat[:int(sizes.sum())]])


class Encoder:
    """One vocabulary in one Python worker."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = name if os.path.sep in name else public_path(name)
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits, self.size = False, model.get_piece_size()
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            self.memory = Memory(np.uint16 if self.size <= 1 << 16 else np.uint32)
            return
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                       and not spec.get("normalizer")
                       and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])
                                   for t in spec.get("added_tokens", [])))
        self.size = tokenizer.get_vocab_size()
        self._encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.memory = Memory(np.uint16 if self.size <= 1 << 16 else np.uint32)

    def batches(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, last text + 1, bytes, limits of the parts, number of parts of each text), balanced by bytes.

        A text longer than BATCH_BYTES comes in several batches of its own.
        """
        data, offsets = text_buffers(column)
        n, row = len(offsets) - 1, 0
        while row < n:
            last = max(int(np.searchsorted(offsets, offsets[row] + BATCH_BYTES, side="right")) - 1, row + 1)
            at, to = int(offsets[row]), int(offsets[last])
            part, inner = data[at:to], offsets[row:last + 1] - at
            if not len(part):
                row = last
                continue
            limits = inner[np.concatenate([[True], inner[1:] > inner[:-1]])]
            if self.splits:
                mark = np.zeros(len(part) + 1, bool)
                mark[safe_cuts(part)] = True
                mark[inner] = True
                limits = np.flatnonzero(mark)
            if last - row > 1:
                yield row, last, part, limits, np.diff(np.searchsorted(limits, inner))
            else:
                k = 0
                while k < len(limits) - 1:
                    to = max(int(np.searchsorted(limits, limits[k] + BATCH_BYTES, side="right")) - 1, k + 1)
                    yield row, last, part, limits[k:to + 1], np.array([to - k])
                    k = to
            row = last

    def coded(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the distinct parts end to end, start and size of each, index of every part)."""
        begins, ends = limits[:-1], limits[1:]
        hashes, second = name_spans(data, begins, ends)
        table = pa.array(hashes).dictionary_encode()
        index = table.indices.to_numpy(zero_copy_only=False)
        first = np.empty(len(table.dictionary), np.int64)
        first[index[::-1]] = np.arange(len(index) - 1, -1, -1)
        if (second[first][index] != second).any():  # equal in the first lane only
            _, first, index = np.unique(np.stack([hashes, second], axis=1), axis=0, return_index=True, return_inverse=True)
        keys, sure = hashes[first], second[first]
        place = self.memory.find(keys, sure)
        new = np.flatnonzero(place < 0)
        if len(new):
            parts = [data[b:e].tobytes().decode() for b, e in zip(begins[first[new]].tolist(), ends[first[new]].tolist(),
                                                                 strict=True)]
            sizes, flat = self._encode_all(parts)
        else:
            sizes, flat = np.zeros(0, np.int64), np.zeros(0, self.memory.flat.dtype)
        start, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        old = place >= 0
        start[old], size[old] = self.memory.start[place[old]], self.memory.size[place[old]]
        start[new], size[new] = np.cumsum(sizes) - sizes + len(self.memory.flat), sizes
        everything = np.concatenate([self.memory.flat, flat]) if len(new) else self.memory.flat
        if len(new):
            short = (ends - begins)[first[new]] <= LONGEST_KEPT
            if not short.all():
                flat = flat[np.repeat(short, sizes)]
                new, sizes = new[short], sizes[short]
            self.memory.add(keys[new], sure[new], sizes, flat)
        return everything, start, size, index

    def _encode_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat, kind = [], [], self.memory.flat.dtype
        for at in range(0, len(parts), 8192):
            found = self._encode(parts[at:at + 8192])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), kind, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(flat)

    def lengths(self, column) -> np.ndarray:
        """Number of ids of every text."""
        out = np.zeros(len(column), np.int64)
        for lo, hi, data, limits, counts in self.batches(column):
            _, _, size, index = self.coded(data, limits)
            sums = np.concatenate([[0], np.cumsum(size[index])])
            ends = np.cumsum(counts)
            out[lo:hi] += sums[ends] - sums[ends - counts]
        return out

    def ids(self, column) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, its ids); a very long text comes in several consecutive parts, an empty one not at all."""
        for lo, hi, data, limits, counts in self.batches(column):
            flat, start, size, index = self.coded(data, limits)
            lens = size[index]
            ends = np.cumsum(lens)
            take = np.repeat(start[index] - (ends - lens), lens)
            take += np.arange(len(take))
            ids = flat[take]
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            for k in range(hi - lo):
                yield lo + k, ids[edges[k]:edges[k + 1]]


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Drop the worker's encoders, with the parts they remember: for tasks that only work on ids."""
    _encoders.clear()


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file (loaded once per process)."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
