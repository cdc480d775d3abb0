"""Statistics of all-pairs cosine similarity without all-pairs rows.

Every statistic is a reducer: it turns the similarities of one tile of
``vectors.cosine_blocks`` into a few rows, folds the rows of a task's tiles into
as few, and combines the rows of all tasks afterwards. ``fuse`` runs any number
of reducers on one stream of tiles, so a product is computed and its vectors
are shuffled once for all of them. What leaves a task is bounded by a parameter.

The exact median takes two products at most: counts in ``POINTS`` equal bins of
-1..1 from the first one bracket the middle ranks, and the second collects the
values inside the brackets, from which the ranks are picked by a distributed
sort. Pairs with a zero vector have no
similarity and do not count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penprint.operators import evaluate
from penprint.operators.vectors import Blocked, CosineBlock, blocked, cosine_blocks
from penprint.session import cut_lineage

# Bins of the rank counts or points of a rank sketch, sketches merged by one task, tiles folded at once, values in a row.
POINTS = 1 << 15
MERGE = 64
FOLD = 32
VALUES = 8192
EXAMPLE_IDS = ["author_i", "slot_i", "author_j", "slot_j"]
LABELS = (0, 1)

# What every reducer's rows look like: which reducer, a label, a key, a count, numbers and names.
_ROWS = pa.schema([("reducer", pa.string()), ("label", pa.int32()), ("key", pa.int64()), ("n", pa.int64()),
                   ("x", pa.list_(pa.float64())), ("s", pa.list_(pa.string()))])
_SCHEMA = "reducer string, label int, key bigint, n bigint, x array<double>, s array<string>"
_Row = tuple[int, int, int, list, list]


def _by_key(rows: list[_Row]) -> dict[tuple[int, int], list[_Row]]:
    found: dict[tuple[int, int], list[_Row]] = {}
    for row in rows:
        found.setdefault(row[:2], []).append(row)
    return found


def _sum_counts(rows: list[_Row]) -> list[_Row]:
    return [(*key, sum(r[2] for r in same), [], []) for key, same in _by_key(rows).items()]


class Moments:
    """Per label: n, mean, std (population), min, max."""

    def tile(self, b: CosineBlock) -> list[_Row]:
        rows = []
        for k in LABELS:
            if len(v := b.values(k)):
                mean = float(v.mean())
                rows.append((k, 0, len(v), [mean, float(((v - mean) ** 2).sum()), float(v.min()), float(v.max())], []))
        return rows

    def fold(self, rows: list[_Row]) -> list[_Row]:
        out = []
        for key, same in _by_key(rows).items():
            n = np.array([r[2] for r in same])
            mean, m2, low, high = np.array([r[3] for r in same]).T
            middle = float((n * mean).sum() / n.sum())
            out.append((*key, int(n.sum()), [middle, float((m2 + n * (mean - middle) ** 2).sum()), float(low.min()),
                                             float(high.max())], []))
        return out

    def combine(self, rows: DataFrame) -> DataFrame:
        n, mean, m2 = F.col("n"), F.get("x", F.lit(0)), F.get("x", F.lit(1))
        # Around a value inside the range of the means, so that nothing large is subtracted.
        total = rows.groupBy("label").agg(
            F.sum("n").alias("n"), (F.sum(n * mean) / F.sum("n")).alias("mean"), F.sum(m2).alias("_m2"),
            F.sum(n * mean * mean).alias("_sq"), F.min(F.get("x", F.lit(2))).alias("min"), F.max(F.get("x", F.lit(3))).alias("max"))
        spread = (F.col("_m2") + F.col("_sq")) / F.col("n") - F.col("mean") * F.col("mean")
        return total.select("label", "n", "mean", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"), "min", "max")


def _compress(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` of the sorted weighted values; ranks move by the weight / points at most."""
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, (np.arange(points) + 0.5) * (upto[-1] / points))
    return values[np.minimum(at, len(values) - 1)], np.full(points, upto[-1] / points)


class RankSketch:
    """Per label a bounded sample of the sorted values with weights, mergeable; its rank error has a bound. For values of
    any range; similarities have one, see ``RankCounts``."""

    def __init__(self, points: int | None = None, merge: int | None = None):
        self.points, self.fan = points or POINTS, merge or MERGE

    def tile(self, b: CosineBlock) -> list[_Row]:
        rows = []
        for k in LABELS:
            if len(v := b.values(k)):
                values, weights = _compress(np.sort(v), np.ones(len(v)), self.points)
                rows.append((k, 0, 1, [*values.tolist(), *weights.tolist()], []))
        return rows

    def _merge(self, table: pa.Table) -> pa.Table:
        sketches = table["x"].to_pylist()
        values = np.concatenate([x[:len(x) // 2] for x in sketches])
        weights = np.concatenate([x[len(x) // 2:] for x in sketches])
        order = np.argsort(values, kind="stable")
        values, weights = _compress(values[order], weights[order], self.points)
        level = max(table["n"].to_pylist()) + 1
        return pa.table({"label": pa.array([table["label"][0].as_py()], pa.int32()), "n": pa.array([level], pa.int64()),
                         "x": pa.array([[*values.tolist(), *weights.tolist()]], pa.list_(pa.float64()))})

    def combine(self, rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
        """label -> (values, weights, times that ranks were rounded); merged level by level inside tasks."""
        left, schema = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0, "label int, n bigint, x array<double>"
        rows = rows.select("label", "n", "x")
        while left > 1:
            parts = math.ceil(left / self.fan)
            part = F.pmod(F.xxhash64("x"), F.lit(parts)).alias("_part")
            rows = cut_lineage(rows.groupBy("label", part).applyInArrow(lambda table: self._merge(table), schema))
            left = parts if parts > 1 else 1
        return {r.label: (np.array(r.x[:len(r.x) // 2]), np.array(r.x[len(r.x) // 2:]), r.n) for r in rows.collect()}

    def brackets(self, sketch: tuple[np.ndarray, np.ndarray, int], ranks: set[int], low: float, high: float) -> dict[int, tuple]:
        """rank -> (lo, hi) that hold the value of this 0-based rank for certain."""
        values, weights, rounds = sketch
        upto = np.cumsum(weights)
        if len(values) < self.points:  # nothing was left out
            return {r: (float(values[at]),) * 2 for r in ranks for at in [np.searchsorted(upto, r + 0.5)]}
        error = (rounds + 1) * upto[-1] / self.points + 1
        out = {}
        for r in ranks:
            below = int(np.searchsorted(upto, r + 0.5 - error)) - 1
            above = int(np.searchsorted(upto, r + 0.5 + error))
            out[r] = (float(values[below]) if below >= 0 else low, float(values[above]) if above < len(values) else high)
        return out


class RankCounts:
    """Per label the counts of similarities in ``points`` equal bins of -1..1."""

    def __init__(self, points: int | None = None):
        self.points = points or POINTS

    def tile(self, b: CosineBlock) -> list[_Row]:
        rows = []
        for k in LABELS:
            if len(v := b.values(k)):
                cell = np.clip(((v + 1.0) * (self.points / 2)).astype(np.int64), 0, self.points - 1)
                rows.append((k, 0, len(v), np.bincount(cell, minlength=self.points), []))
        return rows

    def fold(self, rows: list[_Row]) -> list[_Row]:
        return [(*key, sum(r[2] for r in same), np.sum([r[3] for r in same], axis=0), []) for key, same in _by_key(rows).items()]

    def combine(self, rows: DataFrame) -> dict[int, np.ndarray]:
        """label -> counts by bin."""
        bins = rows.select("label", F.posexplode("x").alias("bin", "n")).where("n > 0").groupBy("label", "bin").agg(F.sum("n").alias("n"))
        out = {k: np.zeros(self.points, np.int64) for k in LABELS}
        for r in bins.collect():  # ``points`` rows a label at most
            out[r.label][r.bin] = int(r.n)
        return out

    def brackets(self, counts: np.ndarray, ranks: set[int], low: float, high: float) -> dict[int, tuple]:
        """rank -> (lo, hi) that hold the value of this 0-based rank for certain."""
        upto, out = np.cumsum(counts), {}
        for r in ranks:
            cell = int(np.searchsorted(upto, r, side="right"))
            # Wider than the rounding of a similarity and of its bin.
            lo, hi = cell * 2 / self.points - 1 - 1e-9, (cell + 1) * 2 / self.points - 1 + 1e-9
            out[r] = (max(lo, low) if cell else low, min(hi, high) if cell < self.points - 1 else high)
        return out


class Inside:
    """The values inside each (label, lo, hi) with their counts, and how many lie below."""

    def __init__(self, ranges: list[tuple[int, float, float]]):
        self.ranges = ranges

    def tile(self, b: CosineBlock) -> list[_Row]:
        rows = []
        for i, (k, lo, hi) in enumerate(self.ranges):
            v = b.values(k)
            values, counts = np.unique(v[(v >= lo) & (v <= hi)], return_counts=True)
            rows.append((k, i, int(np.count_nonzero(v < lo)), [*values.tolist(), *counts.tolist()], []))
        return rows

    def fold(self, rows: list[_Row]) -> list[_Row]:
        out = []
        for key, same in _by_key(rows).items():
            below = sum(r[2] for r in same)
            values, at = np.unique(np.concatenate([r[3][:len(r[3]) // 2] for r in same]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([r[3][len(r[3]) // 2:] for r in same]), len(values))
            for begin in range(0, max(len(values), 1), VALUES):
                some = slice(begin, begin + VALUES)
                out.append((*key, 0 if begin else below, [*values[some].tolist(), *counts[some].tolist()], []))
        return out

    def combine(self, rows: DataFrame, ranks: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """(range, rank over the label) -> value, by a range-partitioned sort and per-partition counts."""
        below = {r.key: r.n for r in rows.groupBy("key").agg(F.sum("n").alias("n")).collect()}
        half = (F.size("x") / 2).cast("int")
        values = rows.where(F.size("x") > 0).select("key", half.alias("half"), "x", F.posexplode(F.slice("x", F.lit(1), half)).alias("at", "v"))
        values = values.groupBy("key", "v").agg(F.sum(F.get("x", F.col("half") + F.col("at"))).cast("bigint").alias("n"))
        placed = cut_lineage(values.repartitionByRange("key", "v").withColumn("_run", F.spark_partition_id()))
        # One row per range and partition.
        runs = sorted(tuple(r) for r in placed.groupBy("key", "_run").agg(F.min("v").alias("lo"), F.sum("n").alias("n"))
                      .select("key", "lo", "_run", "n").collect())
        wanted = {}
        for key, rank in ranks:
            left = rank - below.get(key, 0)
            for k, _, run, n in runs:
                if k == key:
                    if left < n:
                        wanted[key, rank] = (run, left)
                        break
                    left -= n
        upto = F.sum("n").over(Window.partitionBy("key", "_run").orderBy("v"))
        hit = F.lit(False)
        for (key, _), (run, left) in wanted.items():
            hit = hit | ((F.col("key") == key) & (F.col("_run") == run) & (F.col("_upto") > left) & (F.col("_upto") - F.col("n") <= left))
        found = [tuple(r) for r in placed.withColumn("_upto", upto).where(hit).select("key", "_run", "v", "n", "_upto").collect()]
        return {(key, rank): next(v for k, r, v, n, u in found if k == key and r == run and u - n <= left < u)
                for (key, rank), (run, left) in wanted.items()}


class Cells:
    """Per label, counts of values by a function to whole numbers."""

    def __init__(self, cell):
        self.cell = cell

    def tile(self, b: CosineBlock) -> list[_Row]:
        rows = []
        for k in LABELS:
            counts = np.bincount(self.cell(k, b.values(k)))  # cells are small whole numbers
            rows += [(k, int(c), int(counts[c]), [], []) for c in np.flatnonzero(counts)]
        return rows

    fold = staticmethod(_sum_counts)

    def combine(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("label", F.col("key").alias("cell")).agg(F.sum("n").alias("count"))


class Sides:
    """Matches and mismatches strictly above and strictly below a threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def tile(self, b: CosineBlock) -> list[_Row]:
        return [(k, side, int(beyond.sum()), [], []) for k in LABELS
                for side, beyond in enumerate((b.values(k) < self.threshold, b.values(k) > self.threshold))]

    fold = staticmethod(_sum_counts)

    def combine(self, rows: DataFrame) -> DataFrame:
        def count(label: int, side: int):
            return F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("key") == side), F.col("n"))), F.lit(0))
        return evaluate.threshold_shares(rows.agg(*[
            count(k, side).cast("bigint").alias(f"n_{name}_{word}") for side, word in ((1, "above"), (0, "below"))
            for k, name in ((1, "match"), (0, "mismatch"))]))


class Examples:
    """The ``n`` clearest true and false matches above ``high`` and missed matches below ``low``."""

    KINDS = ("true_match", "false_match", "missed_match")

    def __init__(self, high: float, low: float, n: int = 5):
        self.high, self.low, self.n = high, low, n

    def tile(self, b: CosineBlock) -> list[_Row]:
        out = []
        for kind, (label, sign, beyond) in enumerate(((1, -1, lambda v: v > self.high), (0, -1, lambda v: v > self.high),
                                                      (1, 1, lambda v: v < self.low))):
            i, j = b.cells(label, beyond)
            key = sign * b.sim[i, j]
            if len(key) > self.n:  # everything up to the n-th best, ties included
                keep = key <= np.partition(key, self.n - 1)[self.n - 1]
                i, j, key = i[keep], j[keep], key[keep]
            pairs = []
            for x, one, two in zip(key.tolist(), i.tolist(), j.tolist(), strict=True):
                ids = sorted([(b.left[0][one], int(b.left[1][one])), (b.right[0][two], int(b.right[1][two]))])
                pairs.append((x, ids))
            out += [(label, kind, 0, [sign * x], [ids[0][0], str(ids[0][1]), ids[1][0], str(ids[1][1])])
                    for x, ids in sorted(pairs)[:self.n]]
        return out

    def fold(self, rows: list[_Row]) -> list[_Row]:
        def order(row: _Row) -> tuple:
            value, (one, slot1, two, slot2) = row[3][0], row[4]
            return value if row[1] == 2 else -value, one, int(slot1), two, int(slot2)
        return [row for same in _by_key(rows).values() for row in sorted(same, key=order)[:self.n]]

    def combine(self, rows: DataFrame) -> DataFrame:
        kinds = F.array(*[F.lit(k) for k in self.KINDS])
        found = rows.select(
            F.get(kinds, F.col("key").cast("int")).alias("kind"), F.get("s", F.lit(0)).alias("author_i"),
            F.get("s", F.lit(1)).cast("int").alias("slot_i"), F.get("s", F.lit(2)).alias("author_j"),
            F.get("s", F.lit(3)).cast("int").alias("slot_j"), F.get("x", F.lit(0)).alias("value"))
        key = F.when(F.col("kind") == "missed_match", F.col("value")).otherwise(-F.col("value"))
        # A limit on row_number: every task keeps its own best n of a kind before they meet.
        best = found.withColumn("_rank", F.row_number().over(Window.partitionBy("kind").orderBy(key, *EXAMPLE_IDS)))
        return best.where(F.col("_rank") <= self.n).select(
            "kind", *EXAMPLE_IDS, "value", (F.col("_rank") - 1).cast("int").alias("place"))


def fuse(vectors: DataFrame | Blocked, reducers: dict) -> dict[str, DataFrame]:
    """The rows of every reducer, all from one product; kept on shared storage when there are several."""
    def reduce(tiles: Iterator[CosineBlock]) -> pa.Table:
        kept = {name: [] for name in reducers}
        for at, tile in enumerate(tiles, 1):
            for name, reducer in reducers.items():
                kept[name] += reducer.tile(tile)
                if at % FOLD == 0:
                    kept[name] = reducer.fold(kept[name])
        rows = [(name, *row) for name, reducer in reducers.items() for row in reducer.fold(kept[name])]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ROWS)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    rows = cosine_blocks(vectors, reduce, _SCHEMA)
    rows = cut_lineage(rows) if len(reducers) > 1 else rows
    return {name: rows.where(F.col("reducer") == name) for name in reducers}


def _run(vectors: DataFrame | Blocked, reducer):
    return reducer.combine(fuse(vectors, {"one": reducer})["one"])


def moments(vectors: DataFrame | Blocked) -> DataFrame:
    """Per label: n, mean, std (population), min, max of all pairs."""
    return _run(vectors, Moments())


def _per_label(rows: DataFrame) -> dict[int, dict]:
    return {r["label"]: r.asDict() for r in rows.collect()}  # two rows


class _Median:
    """The second half of the median: brackets from the first product, values from the second."""

    def __init__(self, sketch: RankCounts, rows: DataFrame, per: dict[int, dict]):
        ranks = {k: {(m["n"] - 1) // 2, m["n"] // 2} for k, m in per.items()}
        merged = sketch.combine(rows)
        found = {(k, r): lohi for k, m in per.items()
                 for r, lohi in sketch.brackets(merged[k], ranks[k], m["min"], m["max"]).items()}
        self.known = {kr: lo for kr, (lo, hi) in found.items() if lo == hi}
        self.ranges = sorted({(k, lo, hi) for (k, _), (lo, hi) in found.items() if lo < hi})
        self.asked = {kr: self.ranges.index((kr[0], *lohi)) for kr, lohi in found.items() if lohi[0] < lohi[1]}
        self.reducer = Inside(self.ranges)

    def medians(self, rows: DataFrame | None) -> dict[int, float]:
        values = dict(self.known)
        if self.asked:
            picked = self.reducer.combine(rows, [(i, r) for (_, r), i in self.asked.items()])
            values |= {kr: picked[i, kr[1]] for kr, i in self.asked.items()}
        return {k: sum(v for (label, _), v in values.items() if label == k) / sum(label == k for label, _ in values)
                for k in {label for label, _ in values}}


def _summary_rows(spark, per: dict[int, dict], medians: dict[int, float]) -> DataFrame:
    rows = [(k, m["n"], m["mean"], medians[k], m["std"], m["min"], m["max"]) for k, m in per.items()]
    return spark.createDataFrame(
        rows, "label int, n bigint, mean double, median double, std double, min double, max double")


def _bins(per: dict[int, dict], bins: int) -> Cells:
    def cell(label: int, v: np.ndarray) -> np.ndarray:
        if label not in per or not len(v):
            return np.zeros(0, np.int64)
        m = per[label]
        width = m["max"] - m["min"]
        if width <= 0:
            return np.full(len(v), bins // 2 + 1, np.int64)
        return np.clip(np.floor((v - m["min"]) * bins / width).astype(np.int64) + 1, 1, bins)
    return Cells(cell)


def _densities(counts: DataFrame, per: dict[int, dict], bins: int) -> DataFrame:
    area = F.coalesce(*[F.when(F.col("label") == k, F.lit(m["n"] * ((m["max"] - m["min"]) / bins or 1.0 / bins)))
                        for k, m in per.items()], F.lit(1.0))
    return counts.select("label", F.col("cell").cast("int").alias("bin"), "count", (F.col("count") / area).alias("density"))


def _upto(points: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many of the ascending points are at most v: a guess from their even spacing, mended by one where rounding asks."""
    step = (points[-1] - points[0]) / max(len(points) - 1, 1)
    if not step > 0 or np.abs(np.diff(points) - step).max() > 1e-3 * step:
        return np.searchsorted(points, v, side="right")
    guess = np.clip((v - points[0]) * (1 / step), 0, len(points) - 1).astype(np.int64)
    return guess + 1 - (points[guess] > v) + (np.append(points[1:], np.inf)[guess] <= v)


def _grid(per: dict[int, dict]) -> tuple[list[float], Cells]:
    grid = evaluate.spread_grid(per)
    points = np.array(grid)
    return grid, Cells(lambda label, v: _upto(points, v))


def _best(spark, grid: list[float], cells: DataFrame, best: int) -> DataFrame:
    return evaluate.best_of_grid(spark, grid, {(r.label, r.cell): r["count"] for r in cells.collect()}, best)


def summary(vectors: DataFrame) -> DataFrame:
    """Per label: n, mean, exact median, population sd, min, max. Two products at most."""
    spark, grid, sketch = vectors.sparkSession, blocked(vectors, keep=True), RankCounts()
    first = fuse(grid, {"moments": Moments(), "ranks": sketch})
    per = _per_label(Moments().combine(first["moments"]))
    median = _Median(sketch, first["ranks"], per)
    rows = fuse(grid, {"inside": median.reducer})["inside"] if median.ranges else None
    return _summary_rows(spark, per, median.medians(rows))


def histogram(vectors: DataFrame, bins: int = 20) -> DataFrame:
    """Per label, ``bins`` equal bins over its own min..max, as density; the maximum is in the last bin."""
    grid = blocked(vectors, keep=True)
    per = _per_label(moments(grid))
    return _densities(_run(grid, _bins(per, bins)), per, bins)


def best_cutoffs(vectors: DataFrame, best: int = 5) -> DataFrame:
    """The ``best`` cutoffs of the spread grid by accuracy."""
    blocks = blocked(vectors, keep=True)
    grid, cells = _grid(_per_label(moments(blocks)))
    return _best(vectors.sparkSession, grid, _run(blocks, cells), best)


def threshold_precision(vectors: DataFrame, threshold: float) -> DataFrame:
    """Matches and mismatches strictly above and strictly below a threshold."""
    return _run(vectors, Sides(threshold))


def examples(vectors: DataFrame, high: float, low: float, n: int = 5) -> DataFrame:
    """The ``n`` clearest true matches and false matches strictly above ``high`` and the
    ``n`` clearest missed matches strictly below ``low``: (kind, ids of the pair, value)."""
    return _run(vectors, Examples(high, low, n))


def report(vectors: DataFrame, bins: int = 20, best: int = 5, threshold: float = 0.5, high: float = 0.5,
           low: float = 0.0, shown: int = 5) -> dict[str, DataFrame]:
    """A19, A20, A22, A24 and P17 together, from two products: what needs no range of the values comes from
    the first, the median's brackets, the histogram and the cutoff grid from the second."""
    spark, blocks, sketch = vectors.sparkSession, blocked(vectors, keep=True), RankCounts()
    first = fuse(blocks, {"moments": Moments(), "ranks": sketch, "sides": Sides(threshold),
                          "examples": Examples(high, low, shown)})
    per = _per_label(Moments().combine(first["moments"]))
    median, histogram_cells, (grid, grid_cells) = _Median(sketch, first["ranks"], per), _bins(per, bins), _grid(per)
    second = fuse(blocks, {"inside": median.reducer, "bins": histogram_cells, "grid": grid_cells})
    return {"summary": _summary_rows(spark, per, median.medians(second["inside"])),
            "histogram": _densities(histogram_cells.combine(second["bins"]), per, bins),
            "best_cutoffs": _best(spark, grid, grid_cells.combine(second["grid"]), best),
            "threshold": Sides(threshold).combine(first["sides"]),
            "examples": Examples(high, low, shown).combine(first["examples"])}


def with_documents(found: DataFrame, documents: DataFrame, per_persona: int = 5) -> DataFrame:
    """Each persona of each example with up to ``per_persona`` of its documents, comments first.

    ``documents``: (author, slot, kind, ordinal, text); a persona without documents keeps one row with null text.
    """
    sides = found.select("kind", "place", *EXAMPLE_IDS, "value", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("author_i").alias("author"), F.col("slot_i").alias("slot")),
        F.struct(F.lit(1).alias("side"), F.col("author_j").alias("author"), F.col("slot_j").alias("slot")))).alias("p"))
    sides = sides.select("kind", "place", *EXAMPLE_IDS, "value", "p.side", "p.author", "p.slot")
    docs = documents.select("author", "slot", F.col("kind").alias("doc_kind"), "ordinal", "text")
    order = Window.partitionBy("kind", "place", "side").orderBy(
        F.when(F.col("doc_kind") == "comment", 0).otherwise(1), "ordinal")
    rows = sides.join(docs, ["author", "slot"], "left").withColumn("position", (F.row_number().over(order) - 1).cast("int"))
    return rows.where(F.col("position") < per_persona).select(
        "kind", "place", *EXAMPLE_IDS, "value", "side", "position", "doc_kind", "ordinal", "text")
