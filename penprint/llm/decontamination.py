"""Benchmark decontamination: BM25 index of the test items, searched by every passage of every document.

Words are A-Z folded runs of letters, digits and wide characters. Items longer
than ``SEGMENT`` words are indexed as several segments. A document is read as
passages of two half-passages of ``HALF`` words each, one beginning at every
half, so any run of ``HALF`` words lies in one passage. The score of a segment
is its BM25 score divided by the score it would give itself: 1 when the
passage has all its words.

Segments are laid out in blocks of similar ones and searched in the manner of
block-max WAND: per block, the lists of frequent terms have one joint bound
(the most they can give any segment of the block together) and every list of a
rarer term has its block maximum. A passage looks into a block only if the
bounds of the terms it has reach the threshold, so all segments at or above
it are found. They are then verified against the whole document: at least
``OVERLAP`` of the item's five-word shingles have to occur, or that share of
those of its question (all but the last quarter of its words) and of its
answer (the last quarter, five words at least). The first finds an item one of
whose words was changed wherever that word stands, in a short answer too.

An item of fewer than five words has no shingle; it is found where its whole
run of words stands, with score 1.

The index is built and broadcast for at most ``INDEX_BYTES`` of items at a
time; a larger benchmark is searched in several rounds, one index after the
other. Document frequencies and the mean length are those of all items, so
scores do not depend on the rounds.

Defined cases: a null or empty text matches nothing, neither does an item
without words (null and empty ones too); rows
with a null id are reported with it; repeated documents and repeated items are
reported each; empty tables give an empty result; ``contaminated_pairs``
ignores other columns, ``clean`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.tables import stored
from penprint.llm.words import PUNCTUATED, hashed_words, inside_texts, release, rolling

WIDTH, OVERLAP = 5, 0.8
SEGMENT, HALF = 64, 64
THRESHOLD = 0.6
BLOCK = 16
# Terms in more than this share of the segments may count as frequent, up to this joint score of any segment.
FREQUENT, JOINT = 0.02, 0.4
INDEX_BYTES = 32 << 20
# The usual BM25 parameters.
K1, B = 1.2, 0.75


def segments_of(words: np.ndarray) -> list[np.ndarray]:
    """The segments of an item's words; none for an item without shingles."""
    return np.array_split(words, -(-len(words) // SEGMENT)) if len(words) >= WIDTH else []


class Corpus(NamedTuple):
    """What BM25 knows of all items: number and mean length of their segments, and how many have a term."""

    segments: int
    mean_length: float
    often: dict[int, int]


class Index:
    """Inverted index of test items; terms are word hashes. ``corpus``: of all items, if these are a part."""

    def __init__(self, ids: list, texts: list[str | None], corpus: Corpus | None = None):
        words, offsets = hashed_words(pa.array(texts, pa.string()), True, PUNCTUATED)
        runs = rolling(words, WIDTH)
        self.ids, self.parts = [], []
        segments, owner = [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for i, (at, to) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if to - at < WIDTH:
                if to > at:
                    run = rolling(words[at:to], to - at)[0]
                    short.setdefault(to - at, []).append((int(run), len(self.ids)))
                    self.ids.append(ids[i])
                    self.parts.append(None)
                continue
            cut = max(WIDTH, -(-(to - at) // 4))
            cut = cut if to - at - cut >= WIDTH else to - at
            answer = np.unique(runs[to - cut:to - WIDTH + 1])
            question = np.unique(runs[at:max(to - cut, at + WIDTH) - WIDTH + 1])
            for piece in segments_of(words[at:to]):
                segments.append(piece)
                owner.append(len(self.ids))
            self.ids.append(ids[i])
            self.parts.append((question, answer, np.unique(runs[at:to - WIDTH + 1])))
        order = self._similar_first(segments)
        self.owner = np.array(owner, np.int64)[order]
        # Runs of the items without shingles, by their number of words.
        self.short = {n: (np.array([h for h, _ in sorted(found)], np.uint64), [i for _, i in sorted(found)])
                      for n, found in short.items()}
        self._weigh([segments[k] for k in order], corpus)

    @staticmethod
    def _similar_first(segments: list[np.ndarray]) -> list[int]:
        """Order of the segments in which those that share frequent terms stand together."""
        if not segments:
            return []
        terms, often = np.unique(np.concatenate([np.unique(s) for s in segments]), return_counts=True)
        common = terms[np.argsort(-often, kind="stable")[:16]]
        return sorted(range(len(segments)), key=lambda k: (np.isin(common, segments[k]).tolist(), k))

    def _weigh(self, segments: list[np.ndarray], corpus: Corpus | None) -> None:
        n = len(segments)
        self.blocks = -(-n // BLOCK)
        lens = np.fromiter(map(len, segments), np.int64, n)
        flat = np.concatenate(segments) if n else np.zeros(0, np.uint64)
        self.terms, coded = np.unique(flat, return_inverse=True)
        v = len(self.terms)
        keys, tf = np.unique(np.repeat(np.arange(n), lens) * max(v, 1) + coded, return_counts=True)
        self.seg, self.term = np.divmod(keys, max(v, 1))
        df = np.bincount(self.term, minlength=v)
        if corpus is None:
            total, mean, often = n, lens.mean() if n else 0.0, df
        else:
            total, mean, often = corpus.segments, corpus.mean_length, np.array([corpus.often[t] for t in self.terms.tolist()], np.int64)
        idf = np.log1p((total - often + 0.5) / (often + 0.5))
        norm = K1 * (1 - B + B * lens / max(mean, 1e-9)) if n else lens
        weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.seg])
        self.weight = weight / np.bincount(self.seg, weight, minlength=n)[self.seg]
        self.seg_start = np.searchsorted(self.seg, np.arange(n + 1))
        # Frequent lists, longest first, as long as together they stay clear of the threshold: no segment is
        # found by them alone.
        by_term = np.argsort(self.term, kind="stable")
        at = np.searchsorted(self.term[by_term], np.arange(v + 1))
        joint, frequent = np.zeros(n), np.zeros(v, bool)
        for t in np.argsort(-df, kind="stable").tolist():
            mine = by_term[at[t]:at[t + 1]]
            segs = self.seg[mine]
            if df[t] <= max(1, FREQUENT * n) or (joint[segs] + self.weight[mine]).max() > JOINT:
                break
            joint[segs] += self.weight[mine]
            frequent[t] = True
        self.joint = np.array([joint[k * BLOCK:(k + 1) * BLOCK].max() for k in range(self.blocks)])
        # Lists of the rarer terms: (block, largest weight in it).
        rare = ~frequent[self.term]
        cell = self.term[rare] * max(self.blocks, 1) + self.seg[rare] // BLOCK
        cells, at = np.unique(cell, return_inverse=True)
        top = np.zeros(len(cells))
        np.maximum.at(top, at, self.weight[rare])
        self.list_block, self.list_top = cells % max(self.blocks, 1), top
        self.list_start = np.searchsorted(cells // max(self.blocks, 1), np.arange(v + 1))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Term number of every word, -1 for words that no item has."""
        out = np.full(len(words), -1, np.int64)
        if len(self.terms):
            some = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.terms, words[some]), len(self.terms) - 1)
            hit = self.terms[at] == words[some]
            out[some[hit]] = at[hit]
        return out

    def live(self, terms: np.ndarray, passage: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) whose bounds reach the threshold. ``last``: the word's half ends its document."""
        count = np.diff(self.list_start)
        known = np.flatnonzero(terms >= 0)
        known = known[count[terms[known]] > 0]
        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A word stands in the passage that begins at its half and in the one that began a half before.
        v = len(self.terms)
        keys = np.unique(np.concatenate([passage[known] * v + terms[known],
                                         (passage[known] - 1)[~last[known]] * v + terms[known][~last[known]]]))
        where, term = np.divmod(keys, v)
        n = count[term]
        take = np.repeat(self.list_start[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(where, n) * self.blocks + self.list_block[take]
        cells, at = np.unique(cell, return_inverse=True)
        bound = np.bincount(at, self.list_top[take])
        where, block = np.divmod(cells, self.blocks)
        alive = bound + self.joint[block] >= THRESHOLD - 1e-9
        return where[alive], block[alive]

    def _short_matches(self, words: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of the items without shingles whose words stand in the text one after the other."""
        found: set[tuple[int, int]] = set()
        for n, (known, items) in self.short.items():
            runs = rolling(words, n)
            low, high = np.searchsorted(known, runs, side="left"), np.searchsorted(known, runs, side="right")
            at = np.flatnonzero((low < high) & inside_texts(offsets, n))
            doc = np.searchsorted(offsets, at, side="right") - 1
            found |= {(d, items[k]) for d, lo, hi in zip(doc.tolist(), low[at].tolist(), high[at].tolist(), strict=True)
                      for k in range(lo, hi)}
        return found

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of all verified items, in order."""
        words, offsets = hashed_words(texts, True, PUNCTUATED)
        short = [(d, i, 1.0, 1.0, 1.0) for d, i in self._short_matches(words, offsets)]
        yield from sorted([*self._long_matches(words, offsets), *short])

    def _long_matches(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        if not self.blocks or not len(words):
            return
        terms = self.coded(words)
        sizes = np.diff(offsets)
        halves = -(-sizes // HALF)
        first = np.cumsum(halves) - halves
        doc = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.arange(len(words)) - offsets[doc]
        passage = first[doc] + inner // HALF
        where, block = self.live(terms, passage, inner < HALF)
        if not len(where):
            return
        mark = np.zeros(len(self.terms), bool)
        found: dict[tuple[int, int], float] = {}
        owner = np.searchsorted(first, where, side="right") - 1
        for w, b, d in zip(where.tolist(), block.tolist(), owner.tolist(), strict=True):
            at = int(offsets[d] + (w - first[d]) * HALF)
            mine = terms[at:min(at + 2 * HALF, int(offsets[d + 1]))]
            mine = mine[mine >= 0]
            mark[mine] = True
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.owner))
            span = slice(int(self.seg_start[lo]), int(self.seg_start[hi]))
            scores = np.add.reduceat(self.weight[span] * mark[self.term[span]], self.seg_start[lo:hi] - span.start)
            mark[mine] = False
            for k in np.flatnonzero(scores >= THRESHOLD - 1e-9).tolist():
                key = d, int(self.owner[lo + k])
                found[key] = max(found.get(key, 0.0), float(scores[k]))
        runs, shingles, held = rolling(words, WIDTH), np.zeros(0, np.uint64), -1
        for (d, item), score in sorted(found.items()):
            if d != held:
                held, shingles = d, np.unique(runs[offsets[d]:max(offsets[d + 1] - WIDTH + 1, offsets[d])])
            question, answer, whole = (float(np.isin(p, shingles).mean()) for p in self.parts[item])
            if whole >= OVERLAP or (question >= OVERLAP and answer >= OVERLAP):
                yield d, item, score, question, answer


def corpus_of(items: DataFrame, text_col: str) -> DataFrame:
    """(what, term, n): in how many segments of all items each term stands, their number, and that of their words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = hashed_words(batch.column(0), True, PUNCTUATED)
            pieces = [p for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                      for p in segments_of(words[at:to])]
            if pieces:
                terms, n = np.unique(np.concatenate([np.unique(p) for p in pieces]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["term"] * len(terms) + ["segments", "words"]),
                     pa.array([*terms.view(np.int64).tolist(), 0, 0], pa.int64()),
                     pa.array([*n.tolist(), len(pieces), sum(map(len, pieces))], pa.int64())], ["what", "term", "n"])

    return (items.select(F.col(text_col)).mapInArrow(count, "what string, term bigint, n bigint")
            .groupBy("what", "term").agg(F.sum("n").alias("n")))


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
            index_bytes: int = INDEX_BYTES) -> Iterator:
    """Broadcast indexes over all items, each of at most about ``index_bytes`` of text."""
    total = items.agg(F.sum(F.octet_length(text_col) + 16)).first()[0] or 0
    rounds = max(1, -(-total // index_bytes))
    counts = stored(corpus_of(items, text_col), "terms") if rounds > 1 else None
    for k in range(rounds):
        some = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(rounds)) == k) if rounds > 1 else items
        rows = some.select(F.col(id_col), F.col(text_col)).orderBy(id_col, text_col).collect()
        corpus = None
        if counts is not None:
            # The terms of this round's items only.
            own = corpus_of(some, text_col).where("what = 'term'").select("term")
            often = {r.term % (1 << 64): r.n for r in counts.where("what = 'term'").join(own, "term").collect()}
            whole = {r.what: r.n for r in counts.where("what <> 'term'").collect()}
            corpus = Corpus(whole.get("segments", 0), whole.get("words", 0) / max(whole.get("segments", 0), 1), often)
        yield items.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], corpus)), rounds


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) of every document and test item it contains."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    kinds = [rows.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    out = None
    for index, rounds in indexes(items, item_col, item_text_col, index_bytes):
        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    some = batch.slice(at, 500)
                    found = list(index.value.matches(some.column(1)))
                    rows, items_found, *numbers = zip(*found, strict=True) if found else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(pa.array(rows, pa.int64())),
                         pa.array([index.value.ids[i] for i in items_found], item_type),
                         *(pa.array(x, pa.float64()) for x in numbers)],
                        names=[id_col, item_col, "score", "question_overlap", "answer_overlap"])

        item_type = _arrow(items, item_col)
        some = rows.mapInArrow(search, f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, score double, "
                                       "question_overlap double, answer_overlap double")
        if rounds > 1:  # one index in memory at a time
            some = stored(some, "found")
            index.unpersist(blocking=True)
        out = some if out is None else out.unionAll(some)
    return out


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    for index, rounds in indexes(items, item_col, item_text_col, index_bytes):
        docs = docs.where(~_detector(index)(F.col(text_col)))
        if rounds > 1:
            docs = stored(docs, "clean")
            index.unpersist(blocking=True)
    return docs


def _detector(index):
    @F.arrow_udf("boolean")
    def contaminated(texts: pa.Array) -> pa.Array:
        hit = np.zeros(len(texts), bool)
        for at in range(0, len(texts), 500):
            for row, *_ in index.value.matches(texts.slice(at, 500)):
                hit[at + row] = True
        release()
        return pa.array(hit)

    return contaminated
