"""Vectorised words over Arrow text columns (used inside tasks).

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; no other byte
of a UTF-8 text is such a separator, so byte positions are safe word limits.
Every function works through a column in pieces of about ``PIECE`` bytes, so
the temporary arrays stay small however large a batch or a text is.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
# A word longer than this is hashed by blake2b, one by one.
LONG_WORD = 256

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# The same and all ASCII punctuation: words are then runs of letters, digits and wide characters.
PUNCTUATED = SPACE.copy()
PUNCTUATED[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FOLDED = np.frombuffer(_FOLD, np.uint8)
# The low k bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
# For each number of a name a start, a factor and a factor of the length.
_LANES = np.array([[0x243F6A8885A308D3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93],
                   [0x452821E638D01377, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25]], np.uint64)
_powers: dict[str, np.ndarray] = {}
# The C library's own, where it has one (glibc).
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that is free in this process back to the system: a Python worker lives longer than its task, and
    what the C library keeps of one batch's arrays would stay with the executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def powers(n: int, base: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64 (kept per process)."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        for key, b in ((name, base), (name + "~", pow(base, -1, 1 << 64))):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done:done + step] = out[:step] * np.uint64(pow(b, done, 1 << 64))
                done += step
            _powers[key] = out
    return _powers[name][:n], _powers[name + "~"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n + 1 offsets) of a text column; null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Cut a column into (first text, last text + 1, first byte, last byte + 1).

    Whole texts are put together up to PIECE bytes; a longer text is cut in
    front of white space (a word longer than a piece is never cut).
    """
    n, row = len(offsets) - 1, 0
    while row < n:
        if offsets[row + 1] - offsets[row] > PIECE:
            pos, end = int(offsets[row]), int(offsets[row + 1])
            while pos < end:
                stop = min(pos + PIECE, end)
                if stop < end:
                    spaces = np.flatnonzero(SPACE[data[pos + 1:stop]])
                    if len(spaces):
                        stop = pos + 1 + int(spaces[-1])
                    else:
                        while stop < end and not SPACE[data[stop:stop + PIECE]].any():
                            stop = min(stop + PIECE, end)
                        more = np.flatnonzero(SPACE[data[stop:stop + PIECE]])
                        stop = stop + int(more[0]) if len(more) else end
                yield row, row + 1, pos, stop
                pos = stop
            row += 1
            continue
        last = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        last = max(last, row + 1)
        yield row, last, int(offsets[row]), int(offsets[last])
        row = last


def word_spans(data: np.ndarray, starts_of_texts: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; a text's first byte always begins a word or white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts_of_texts] = True
    first[-1] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    finishes[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of every span (see ``name_spans``)."""
    return name_spans(data, begins, ends, fold, 1)[0]


def name_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: bool = False, lanes: int = 2) -> list[np.ndarray]:
    """One or two 64-bit numbers that name every span by its bytes.

    A span is read eight bytes at a time; each step mixes (``mix`` is
    one-to-one and not linear), multiplies and adds, so, unlike a polynomial
    modulo 2^64, there are no texts that collide whatever the factors are. The
    second number of a span of at most eight bytes is those bytes themselves:
    with the first, which takes in the length, it names such a span for certain.
    """
    if not len(begins):
        return [np.zeros(0, np.uint64)] * lanes
    size = ends - begins
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = _FOLDED[data] if fold else data
    at_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    head = at_byte[begins] & _LOW[np.minimum(size, 8)]
    out = [head + (size.astype(np.uint64) * _LANES[0, 2] + _LANES[0, 0]), head][:lanes]
    rest, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(rest):
        left = size[rest] - done
        more = at_byte[begins[rest] + done] & _LOW[np.minimum(left, 8)]
        for lane, numbers in enumerate(out):
            numbers[rest] = mix(numbers[rest] + _LANES[lane, 0]) * _LANES[lane, 1] + more
        rest, done = rest[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(padded[begins[i]:ends[i]].tobytes(), digest_size=16).digest()
        for lane, numbers in enumerate(out):
            numbers[i] = int.from_bytes(digest[8 * lane:8 * lane + 8], "little")
    out[0] = mix(out[0])
    return out


def hashed_words(column, fold: bool, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, n + 1 word offsets of the texts). fold: A-Z as a-z."""
    data, offsets = text_buffers(column)
    counts = np.zeros(len(offsets) - 1, np.int64)
    out = []
    for lo, hi, at, to in pieces(data, offsets):
        part = data[at:to]
        inner = np.clip(offsets[lo:hi] - at, 0, None)
        begins, ends = word_spans(part, inner[inner < len(part)], breaks)
        out.append(hash_spans(part, begins, ends, fold))
        if hi - lo == 1:
            counts[lo] += len(begins)
        else:
            counts[lo:hi] += np.diff(np.searchsorted(begins, np.append(inner, len(part))))
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return hashes, np.concatenate([[0], np.cumsum(counts)])


_ROLL = 0xC2B2AE3D27D4EB4F | 1


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` consecutive words (modulo 2^64, then mixed).

    Runs across texts are included: the caller keeps those inside one text.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, PIECE):
        part = hashes[at:at + PIECE + width - 1]
        up, down = powers(PIECE + width, _ROLL, "roll")
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        m = len(part) - width + 1
        out[at:at + m] = mix((sums[width:] - sums[:-width]) * down[:m])
    return out


def inside_texts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Mask over rolling()'s runs: True where all words of the run belong to one text."""
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    mask = np.ones(n + width, bool)
    for k in range(1, width):
        cut = offsets[1:-1] - k
        mask[cut[cut >= 0]] = False
    return mask[:n]
