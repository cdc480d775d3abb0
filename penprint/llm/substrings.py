"""Substring de-duplication: every window of 20 words is hashed and counted.

A Rabin-Karp hash of every window of every document is taken. Documents are
dealt to blocks of neighbouring ids, so that the order of blocks is the order
of windows. Each block sends its distinct hashes, sorted and packed, to the
task that counts their range of hash values; that task answers each block
with the hashes an earlier block holds too. Back in its block, a window is a
repeat if its hash was answered or occurs earlier in the block; repeated
windows merge into the intervals of words that go. Packing costs about six
bytes a window after shuffle compression, and a window that occurs in a third
of all documents is sent once per block.

Windows are identified by 64-bit hashes: among N windows about N*N/2^65 are
taken for repeats by accident (0.0003 for the 10^8 windows of 1 GB).

Defined cases: null, empty or white-space-only text has no words and keeps the
empty text; a text of fewer words than a window loses nothing; rows with a
null id come before all others; rows of equal id are ordered by text, and of
equal rows one counts as the earlier; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.words import hashed_words, inside_texts, rolling

WIDTH = 20
# UTF-8 bytes of text in a block, about, and of the texts whose windows one counting task gets.
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 16 << 20

RESULT = "n_words bigint, n_removed bigint, kept_sha256 string"


def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a block by (id, text), null ids first."""
    named = table.append_column("named", table["id"].is_valid())
    return named.sort_by([("named", "ascending"), ("id", "ascending"), ("text", "ascending")])


def _windows(texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every run of words, mask of the runs inside one text, word offsets of the texts)."""
    words, offsets = hashed_words(texts, fold=False)
    return rolling(words, width), inside_texts(offsets, width), offsets


def pack_hashes(sorted_hashes: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte planes apart: the high planes are almost all zero and compress away."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_hashes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def remove_repeats(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES,
                   id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, with ``texts`` also kept_text; ids must be whole numbers."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total = total or 0
    blocks = int(max(1, min(-(-total // block_bytes), count)))
    ranges = int(max(1, -(-total // range_bytes)))
    limits = rows.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0] \
        if blocks > 1 else []
    edges = np.unique(np.array([x for x in limits or [] if x is not None], np.int64))

    @F.pandas_udf("int")
    def block_of(ids):
        known = ids.notna()
        return (np.searchsorted(edges, ids.where(known, -(2 ** 63)).astype("int64"), side="right") + 1) * known

    def hashes_of_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        runs, inside, _ = _windows(table["text"], width)
        distinct = np.unique(runs[inside])
        cuts = np.searchsorted(distinct, np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64))
        parts = [(k, p) for k, p in enumerate(np.split(distinct, cuts)) if len(p)]
        return pa.table({"range": pa.array([k for k, _ in parts], pa.int32()),
                         "block": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                         "hashes": pa.array([pack_hashes(p) for _, p in parts], pa.binary())})

    def later_blocks(table: pa.Table) -> pa.Table:
        order = np.argsort(table["block"].to_numpy(), kind="stable")
        lists = [unpack_hashes(table["hashes"][int(i)].as_py()) for i in order]
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        flat = np.concatenate(lists)
        by = np.argsort(flat, kind="stable")
        again = np.zeros(len(flat), bool)
        again[by[1:]] = flat[by[1:]] == flat[by[:-1]]
        found = [(int(order[i]), flat[again & (owner == i)]) for i in np.unique(owner[again])]
        return pa.table({"block": pa.array([table["block"][i].as_py() for i, _ in found], pa.int32()),
                         "hashes": pa.array([pack_hashes(x) for _, x in found], pa.binary())})

    def keep(documents: pa.Table, answers: pa.Table) -> pa.Table:
        table = _ordered(documents)
        runs, inside, offsets = _windows(table["text"], width)
        at = np.flatnonzero(inside)
        runs = runs[at]
        repeat = np.ones(len(runs), bool)
        repeat[np.unique(runs, return_index=True)[1]] = False
        if answers.num_rows:
            known = np.sort(np.concatenate([unpack_hashes(x) for x in answers["hashes"].to_pylist()]))
            place = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            repeat |= known[place] == runs
        steps = np.zeros(int(offsets[-1]) + 1, np.int64)
        np.add.at(steps, at[repeat], 1)
        np.add.at(steps, at[repeat] + width, -1)
        gone = np.cumsum(steps)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
        kept = []
        for i, text in enumerate(table["text"]):
            words = (text.as_py() or "").encode().split()
            if removed[i + 1] > removed[i]:
                words = [w for w, g in zip(words, gone[offsets[i]:offsets[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
        out = {"id": table["id"], "n_words": np.diff(offsets), "n_removed": np.diff(removed),
               "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if texts else {}))

    blocked = rows.withColumn("block", block_of("id")).repartition("block")
    answers = (blocked.groupBy("block").applyInArrow(hashes_of_block, "range int, block int, hashes binary")
               .groupBy("range").applyInArrow(later_blocks, "block int, hashes binary"))
    result = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        keep, f"id bigint, {RESULT}" + ", kept_text string" * texts)
    return result.withColumnRenamed("id", id_col)
