"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of up to ``PASSAGE`` words. Every passage is
encoded from what it looks like: shares of byte classes, shares of hashed byte
pairs, word lengths and repetition inside the passage. Labels exist for whole
documents only; a gated attention learns from them which passages speak for a
document, and the score is a logistic function of the attention-weighted mean
of the encoded passages.

The network is fitted on the driver on at most ``SAMPLE`` labelled documents
(half of each label where there are enough, chosen by a hash of the id,
weighted back to the labels' shares) with at most ``FIT_PASSAGES`` passages
together; a document takes part with all its passages, or, where they exceed
what is left of its label's half, not at all. These are the only bounds.
Scoring reads every passage of every text.

Defined cases: a text without words (null, empty, white space) scores 0; a
null id is scored, is never held out and takes no part in fitting; a label
given several times counts once, 0 before 1; repeated rows are scored each, and of an
id's texts the first in byte order is learned from; without
labels of both kinds every text with words scores the share of label 1 (0.5
without any label); an empty table gives an empty result; other columns are
ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.tables import stored
from penprint.llm.words import hash_spans, pieces, release, text_buffers, word_spans

PASSAGE = 64
SAMPLE, FIT_PASSAGES = 3000, 120_000
THRESHOLD = 0.3
PAIRS, HIDDEN, GATES = 64, 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.01, 1e-4
# Words at which a passage's features count half.
SHRINK = 8

_CLASS = np.full(256, 11, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r",
                             b".,;:?'\"-", b"|", b"#$%&*<>", b"!", b"()[]{}/\\_=+@")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
CLASSES = 12
FEATURES = CLASSES + PAIRS + 5


def passages(texts) -> tuple[np.ndarray, np.ndarray]:
    """(one row of features per passage, n + 1 offsets of the texts). Passages restart at pieces of 1 MiB."""
    data, offsets = text_buffers(texts)
    out, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for lo, hi, at, to in pieces(data, offsets):
        part = data[at:to]
        inner = np.clip(offsets[lo:hi] - at, 0, None)
        begins, ends = word_spans(part, inner[inner < len(part)])
        if not len(begins):
            continue
        words = np.diff(np.searchsorted(begins, np.append(inner, len(part)))) if hi - lo > 1 else np.array([len(begins)])
        per_text = -(-words // PASSAGE)
        counts[lo:hi] += per_text
        first = np.cumsum(words) - words
        text = np.repeat(np.arange(hi - lo), words)
        rank = np.arange(len(begins)) - first[text]
        owner = (np.cumsum(per_text) - per_text)[text] + rank // PASSAGE
        out.append(_features(part, begins, ends, owner, rank == 0))
    rows = np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)
    return rows, np.concatenate([[0], np.cumsum(counts)])


def _features(data, begins, ends, owner, opens) -> np.ndarray:
    n = int(owner[-1]) + 1
    heads = np.searchsorted(owner, np.arange(n + 1))
    words = np.diff(heads).astype(np.float64)
    # A passage's bytes reach from its first word to the end of its last, whatever stands next to it.
    low, high = begins[heads[:-1]], ends[heads[1:] - 1]
    size = high - low
    cell = np.repeat(np.arange(n, dtype=np.int64), size)
    body = data[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(cell))]
    classes = np.bincount(cell * CLASSES + _CLASS[body], minlength=n * CLASSES).reshape(n, CLASSES)
    pair = (body[:-1].astype(np.uint16) * np.uint16(167) + body[1:].astype(np.uint16) * np.uint16(13)) >> 3 & (PAIRS - 1)
    within = cell[:-1] == cell[1:]
    pairs = np.bincount((cell[:-1] * PAIRS + pair)[within], minlength=n * PAIRS).reshape(n, PAIRS)
    hashes = hash_spans(data, begins, ends, fold=True)
    same = np.append(False, hashes[1:] == hashes[:-1]) & ~opens
    distinct = _distinct(owner, hashes, n)
    length = np.add.reduceat((ends - begins).astype(np.float64), heads[:-1])
    return np.column_stack([
        classes / size[:, None], pairs / size[:, None], length / words / 10,
        np.add.reduceat(same.astype(np.float64), heads[:-1]) / words, distinct / words, np.log(words) / 4,
        np.add.reduceat((_CLASS[data[begins]] == 0).astype(np.float64), heads[:-1]) / words]).astype(np.float32)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1]))
    return np.bincount(o[new], minlength=n)


def _standard(rows: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, drawn towards the mean where a passage has few words to show."""
    words = np.exp(4 * rows[:, -2:-1])
    return (rows - shift) / scale * (words / (words + SHRINK))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights of the network; ``prior`` is the score where it could not be fitted."""

    prior: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def passage_values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(attention logit, contribution to the document's logit) of every passage."""
        w = self.weights
        h = np.tanh(_standard(rows, self.shift, self.scale) @ w["E"] + w["e"])
        gate = np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])
        return gate @ w["a"], h @ w["c"]

    def scores(self, texts) -> np.ndarray:
        rows, offsets = passages(texts)
        out = np.zeros(len(offsets) - 1)
        some = np.flatnonzero(np.diff(offsets))
        if self.weights is None:
            out[some] = self.prior
        elif len(some):
            logit, value = self.passage_values(rows)
            at = offsets[some]
            weight = np.exp(logit - np.repeat(np.maximum.reduceat(logit, at), np.diff(offsets)[some]))
            mean = np.add.reduceat(weight * value, at) / np.add.reduceat(weight, at)
            out[some] = _sigmoid(mean + self.weights["b"])
        return out


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Gated-attention network by Adam on (bags of passage features, document labels, document weights)."""
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    w = {"E": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.3, (HIDDEN, GATES)), "U": rng.normal(0, 0.3, (HIDDEN, GATES)),
         "a": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(())}
    bags = [_standard(x, shift, scale).astype(np.float64) for x in bags]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), BATCH):
            some = order[at:at + BATCH]
            x = np.concatenate([bags[i] for i in some])
            n = np.array([len(bags[i]) for i in some])
            first = np.cumsum(n) - n
            # Forward: encode, gate, attend, score.
            h = np.tanh(x @ w["E"] + w["e"])
            t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
            logit = (t * s) @ w["a"]
            p = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first), n))
            p /= np.repeat(np.add.reduceat(p, first), n)
            value = h @ w["c"]
            score = np.add.reduceat(p * value, first)
            d = (_sigmoid(score + w["b"]) - labels[some]) * weights[some] / weights[some].sum()
            # Backward.
            wide = np.repeat(d, n)
            d_value = wide * p
            d_logit = wide * p * (value - np.repeat(score, n))
            d_gate = d_logit[:, None] * w["a"]
            d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
            d_h = d_value[:, None] * w["c"] + d_t @ w["V"].T + d_s @ w["U"].T
            d_in = d_h * (1 - h * h)
            grads = {"E": x.T @ d_in, "e": d_in.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s, "a": (t * s).T @ d_logit,
                     "c": h.T @ d_value, "b": d.sum()}
            step += 1
            for k, g in grads.items():
                g = g + DECAY * w[k]
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] = w[k] - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(prior, shift.astype(np.float32), scale.astype(np.float32),
                 {k: np.asarray(v, np.float32) for k, v in w.items()})


def held_out(id_value: Column) -> Column:
    """The fold that fitting never sees: crc32 of the id's text modulo 5 is 0."""
    return F.coalesce(F.crc32(id_value.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit the model on the labelled documents that are not held out."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
             .groupBy("id").agg(F.min("label").cast("int").alias("label")))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model(prior)
    chosen = None
    for label in (0, 1):
        some = (known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample // 2))
        chosen = some if chosen is None else chosen.unionAll(some)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets = passages(batch.column(2))
            kept = [rows[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(kept, pa.large_binary())
                 .cast(pa.binary())], names=["id", "label", "n", "rows"])
            del rows, kept
            release()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most ``sample`` ids: broadcast.
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = found.schema["id"].dataType.simpleString()
    bagged = stored(found.mapInArrow(bags, f"id {kind}, label int, n bigint, rows binary").where("n > 0"), "bags")
    taken, left = [], {0: FIT_PASSAGES // 2, 1: FIT_PASSAGES // 2}
    for r in bagged.select("id", "label", "n").orderBy(F.xxhash64("id"), "id").collect():
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            taken.append((r.id,))
    if not taken:
        return Model(prior)
    ids = docs.sparkSession.createDataFrame(taken, f"id {kind}")
    fitted = sorted((tuple(r) for r in bagged.join(F.broadcast(ids), "id").select("id", "label", "rows").collect()),
                    key=lambda r: (r[0], r[1]))
    target = np.array([r[1] for r in fitted], np.float64)
    if len(set(target.tolist())) < 2:
        return Model(prior)
    share = target.mean()
    weights = np.where(target == 1, prior / share, (1 - prior) / (1 - share))
    return fit([np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in fitted], target, weights, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    value = scorer(model)(F.col(text_col))
    return (docs.select(F.col(id_col), value.alias("score"))
            .select(id_col, held_out(F.col(id_col)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def scorer(model: Model):
    """Column function: text -> score."""
    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        out = [model.scores(texts.slice(at, 1000)) for at in range(0, len(texts), 1000)]
        release()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return scores


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    return docs.where(scorer(model)(F.col(text_col)) >= threshold)
