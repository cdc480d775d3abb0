"""Packing: documents that share vocabulary fill a training window together.

Every document becomes its token ids plus one end id. Documents are put in a
lexical order: by the smallest hashes of their runs of three ids under
``KEYS`` permutations, so that copies stand side by side and documents that share
many runs are likely to. A distributed sort spreads the order over tasks, also
where a third of all documents are alike, and each task cuts its stretch into
shards of about ``SHARD_BYTES``. A shard holds a BM25 inverted index of its
documents; a window starts with a seed document, asks the index with all the
seed's terms for unused neighbours and takes them, best first, until the window
is full. The last document taken is cut at the window's end and its rest seeds
the next window, so only the last window of a shard is not full.

Defined cases: a null or empty text is the end id alone; a null id is passed
through; repeated rows are packed each; a text longer than a window fills
several windows and its rest is packed like any other; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.tables import stored
from penprint.llm.tokenizing import encoder, forget
from penprint.llm.words import mix, release

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
END_ID = 1
# Bytes of ids in a shard, about, at two each; shards of one task.
SHARD_BYTES = 4 << 20
TASK_SHARDS = 4
# Neighbours asked for at a time.
NEIGHBOURS = 16
# Permutations of the lexical order, and the factors of the ids in a run.
KEYS = 3
_RUN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PERMUTED = np.array([0x452821E638D01377, 0xBE5466CF34E90C6D, 0xC0AC29B7C97C50DD], np.uint64)[:KEYS]
# The usual BM25 parameters.
K1, B = 1.2, 0.75

PIECES = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


class Index:
    """BM25 inverted index of one shard: token ids as terms, documents as numbers."""

    def __init__(self, docs: list[np.ndarray], size: int):
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        # One array is sorted in place: a task's memory is a few numbers an id.
        keys = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        keys *= max(len(docs), 1)
        keys += np.repeat(np.arange(len(docs), dtype=np.int64), lens)
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(first, append=len(keys))
        keys = keys[first]
        del first
        self.doc = keys % max(len(docs), 1)
        keys //= max(len(docs), 1)
        term = keys.astype(np.int32)
        del keys
        self.start = np.searchsorted(term, np.arange(size + 1, dtype=np.int32))
        df = np.diff(self.start)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lens / max(lens.mean(), 1e-9)) if len(docs) else lens.astype(float)
        self.weight = idf[term]
        self.weight *= tf
        self.weight *= K1 + 1
        below = norm[self.doc]
        below += tf
        self.weight /= below
        del tf, below
        # Every document's terms, in rising order.
        order = np.argsort(self.doc, kind="stable")
        self.term = term[order]
        self.first = np.searchsorted(self.doc[order], np.arange(len(docs) + 1))
        self.listed = len(docs)

    def neighbours(self, doc: int, free: np.ndarray) -> np.ndarray:
        """The best unused documents that share terms with ``doc``, best first (ties by number); all its terms count."""
        if 10 * int(free.sum()) < 9 * self.listed:
            # Postings of used documents go; the others keep their weights.
            keep = free[self.doc]
            self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
            self.doc, self.weight, self.listed = self.doc[keep], self.weight[keep], int(free.sum())
        terms = self.term[self.first[doc]:self.first[doc + 1]]
        lists = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True) if a < b]
        if not lists:
            return np.zeros(0, np.int64)
        scores = np.bincount(np.concatenate([self.doc[s] for s in lists]),
                             np.concatenate([self.weight[s] for s in lists]), len(free))
        met = np.flatnonzero((scores > 0) & free)
        if len(met) > NEIGHBOURS:
            least = -np.partition(-scores[met], NEIGHBOURS - 1)[NEIGHBOURS - 1]
            met = met[scores[met] >= least]
        return met[np.lexsort((met, -scores[met]))][:NEIGHBOURS]


def fill(docs: list[np.ndarray], size: int, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one shard."""
    index, free = Index(docs, size), np.ones(len(docs), bool)
    upcoming, sequence, offset = 0, 0, 0
    seed, queue, current, start = -1, [], -1, 0
    while True:
        if current < 0:
            while queue and not free[queue[-1]]:
                queue.pop()
            if not queue and seed >= 0:
                queue = index.neighbours(seed, free)[::-1].tolist()
            if queue:
                current = queue.pop()
            else:
                while upcoming < len(docs) and not free[upcoming]:
                    upcoming += 1
                if upcoming == len(docs):
                    return
                current = upcoming
                seed = current
            start, free[current] = 0, False
        if offset == 0:
            seed, queue = current, []
        length = min(len(docs[current]) - start, window - offset)
        yield current, start, length, sequence, offset
        start, offset = start + length, offset + length
        if start == len(docs[current]):
            current = -1
        if offset == window:
            sequence, offset = sequence + 1, 0


def lexical_keys(ids: np.ndarray) -> list[int]:
    """The smallest hash of any run of three ids (or of all, where there are fewer) under every permutation."""
    x = ids.astype(np.uint64)
    if len(x) >= len(_RUN):
        runs = x[:-2] * _RUN[0]
        runs += x[1:-1] * _RUN[1]
        runs += x[2:] * _RUN[2]
    else:
        runs = (x * _RUN[:len(x)]).sum(keepdims=True, dtype=np.uint64)
    runs = mix(runs)
    # Mixed numbers times an odd one are another permutation. The smallest ones are mixed again: long documents
    # have smaller ones, and would all stand at the beginning of the order.
    return (mix(np.array([(runs * f).min() for f in _PERMUTED])) >> np.uint64(1)).astype(np.int64).tolist()


def encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(id, ids as little-endian bytes, their width, lexical keys) of every document, the end id included."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tool = encoder(vocabulary)
            kind = "<u2" if tool.size <= 1 << 16 else "<u4"
            end = np.array([END_ID], kind)
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                parts: list[list[np.ndarray]] = [[] for _ in range(some.num_rows)]
                for row, ids in tool.ids(some.column(1)):
                    parts[row].append(ids.astype(kind, copy=False))
                whole = [np.concatenate([*p, end]) for p in parts]
                del parts
                keys = np.array([lexical_keys(ids) for ids in whole], np.int64).reshape(-1, KEYS)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([ids.tobytes() for ids in whole], pa.binary()),
                     pa.array(np.full(some.num_rows, int(kind[-1]), np.int32)), *(pa.array(k) for k in keys.T)],
                    names=["id", "ids", "width", *(f"k{n}" for n in range(KEYS))])
                del whole
            release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, ids binary, width int, " + ", ".join(f"k{n} bigint" for n in range(KEYS)))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # Written once: the sort reads it twice, and the number of a row settles ties between equal ones.
    table = stored(encoded(docs, vocabulary, id_col, text_col).withColumn("nr", F.monotonically_increasing_id()), "ids")
    total = table.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    tasks = max(1, -(-total // (shard_bytes * TASK_SHARDS)))
    kind = table.schema["id"].dataType.simpleString()

    def shard(ids: list, raw: list[bytes], width: int, sequences: int) -> pa.RecordBatch:
        texts = [np.frombuffer(x, "<u2" if width == 2 else "<u4") for x in raw]
        out = list(fill(texts, 1 << (16 if width == 2 else 20), window))
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*out, strict=True))
        crc = np.array([zlib.crc32(texts[d][s:s + n].astype("<u4").tobytes()) for d, s, n, _, _ in out], np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids).take(pa.array(doc)), *(pa.array(x) for x in (
                start, length, crc, sizes[doc], sequence + sequences, offset))],
            names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        release()
        sequences, ids, raw, held, width = TaskContext.get().partitionId() << 32, [], [], 0, 2
        for batch in batches:
            begin = 0
            sizes = batch.column(1).to_pylist()
            width = batch.column(2)[0].as_py() if batch.num_rows else width
            for row, x in enumerate(sizes):
                raw.append(x)
                held += len(x)
                if held >= shard_bytes:
                    out = shard([*ids, batch.column(0).slice(begin, row + 1 - begin)], raw, width, sequences)
                    yield out
                    sequences = out.column(5)[-1].as_py() + 1
                    ids, raw, held, begin = [], [], 0, row + 1
                    release()
            ids.append(batch.column(0).slice(begin))
        if raw:
            yield shard(ids, raw, width, sequences)
            del ids, raw
        release()

    order = [*(f"k{n}" for n in range(KEYS)), "nr"]
    return (table.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "ids", "width")
            .mapInArrow(pieces, f"`{id_col}` {kind}, {PIECES}"))
