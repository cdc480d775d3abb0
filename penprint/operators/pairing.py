"""Pairs of communities met in cells, with NumPy (J4): what ``graph`` runs inside its tasks.

Communities have numbers 0..n-1 and are dealt to ``blocks`` blocks by them. The
lists of many authors travel as one packed batch; a batch is cut into the cells
(block, block), to which an author's two shares of the list go, and a cell
expands the pairs of its lists in runs of about ``RUN``. A list holds its large
communities first, each half ascending; a pair needs one large community.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Pairs expanded at once, list entries looked at for them and put in order at once, and rows handed on in one list.
RUN = 1 << 18
LOOK = 1 << 18
ORDER = 1 << 20
ROWS = 4096

NAMES, LISTS = 0, 1


# ---------------------------------------------------------------- packed arrays

def pack(*arrays: np.ndarray | pa.Array) -> bytes:
    """Arrays as compressed bytes: numbers byte by byte of their places, so that what is alike stands together."""
    heads, bodies = [], []
    for a in arrays:
        if isinstance(a, pa.Array):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("a", a.type)])) as out:
                out.write_batch(pa.record_batch([a], names=["a"]))
            body = sink.getvalue().to_pybytes()
            heads.append((None, len(body)))
        else:
            body = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
            heads.append((a.dtype.str, len(a)))
        bodies.append(body)
    raw = b"".join(bodies)
    return pickle.dumps((heads, len(raw), pa.compress(raw, codec="zstd", asbytes=True)))


def unpack(data: bytes) -> list:
    heads, length, packed = pickle.loads(data)
    raw, at, out = pa.decompress(packed, length, codec="zstd", asbytes=True), 0, []
    for kind, n in heads:
        if kind is None:
            with pa.ipc.open_stream(pa.py_buffer(raw[at:at + n])) as stream:
                out.append(stream.read_all()["a"].combine_chunks())
            at += n
        else:
            size = np.dtype(kind).itemsize
            planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
            out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
            at += n * size
    return out


def _runs(counts: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the ascending runs of lists: large communities, then the others."""
    lengths = np.stack([large, counts - large], axis=1).ravel().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    return starts[lengths > 0], lengths[lengths > 0]


def _steps(ids: np.ndarray, counts: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Ascending numbers as the steps between them."""
    steps = np.diff(ids, prepend=0)
    starts, _ = _runs(counts, large)
    steps[starts] = ids[starts]
    return steps.astype(np.uint32 if not len(steps) or steps.max() < 1 << 32 else np.uint64)


def _numbers(steps: np.ndarray, counts: np.ndarray, large: np.ndarray) -> np.ndarray:
    ids = np.cumsum(steps, dtype=np.int64)
    starts, lengths = _runs(counts, large)
    return ids - np.repeat(ids[starts] - steps[starts].astype(np.int64), lengths)


def _narrow(chars: np.ndarray) -> np.ndarray:
    short = chars.astype(np.float32)
    return short if np.array_equal(short, chars, equal_nan=True) else chars


# ---------------------------------------------------------------- rows -> numbers -> batches of lists

def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(author, subreddit, chars, large), equal subreddits together -> with the number of the subreddit in its partition
    (pid, n), its name on its first row."""
    from pyspark import TaskContext

    pid, last, n = TaskContext.get().partitionId(), None, -1
    for b in batches:
        if not b.num_rows:
            continue
        s = b["subreddit"]
        new = np.ones(len(s), bool)
        new[0] = last is None or s[0].as_py() != last
        new[1:] = pc.not_equal(s[1:], s[:-1]).to_numpy(zero_copy_only=False)
        numbers = n + np.cumsum(new)
        last, n = s[-1].as_py(), int(numbers[-1])
        yield pa.RecordBatch.from_pydict({
            "pid": pa.array(np.full(len(s), pid), pa.int32()), "n": pa.array(numbers, pa.int64()), "author": b["author"],
            "name": pc.if_else(pa.array(new), s, pa.scalar(None, s.type)), "chars": b["chars"], "large": b["large"]})


def _batch(table: pa.Table) -> tuple[bytes, int]:
    author = table["author"].combine_chunks()
    new = np.ones(len(author), bool)
    new[1:] = pc.not_equal(author[1:], author[:-1]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(author)))
    large = np.add.reduceat(table["large"].to_numpy().astype(np.int64), starts)
    pairs = int((large * (counts - large) + large * (large - 1) // 2).sum())
    ids, chars = table["id"].to_numpy(), table["chars"].to_numpy().astype(np.float64)
    return pack(author.take(pa.array(starts)), counts.astype(np.uint32), large.astype(np.uint32), _steps(ids, counts, large),
                _narrow(chars)), pairs


def batch(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(author, large, id, chars) in the order of lists -> (data, pairs): batches of whole lists, ``least`` entries or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, least

        def row(table: pa.Table) -> pa.RecordBatch:
            data, pairs = _batch(table)
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary()), "pairs": pa.array([pairs], pa.int64())})
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            author = table["author"].combine_chunks()
            change = np.flatnonzero(pc.not_equal(author[1:], author[:-1]).to_numpy(zero_copy_only=False)) + 1
            while len(change) and change[-1] >= least:  # cut behind whole lists
                at = int(change[np.searchsorted(change, least)])
                yield row(table.slice(0, at))
                table, change = table.slice(at), change[change > at] - at
            held, rows = table.to_batches(), table.num_rows
            enough = max(least, 2 * rows)
        if rows:
            yield row(pa.Table.from_batches(held))
    return run


# ---------------------------------------------------------------- batches -> cells

def cell_of(i: int, j: int, blocks: int) -> int:
    """The number of the cell of blocks i <= j."""
    return i * blocks - i * (i - 1) // 2 + j - i


_CELLS = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _cell_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("cell", "kind", "data"), r, strict=True)) for r in rows], _CELLS)


def split_names(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, name) -> the names of a block for each of its cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["id"].to_numpy()
            for i in range(blocks):
                at = np.flatnonzero(ids % blocks == i)
                if len(at):
                    at = at[np.argsort(ids[at])]
                    data = pack(np.array([i]), np.diff(ids[at] // blocks, prepend=0), b["name"].take(pa.array(at)))
                    yield _cell_rows([(cell_of(min(i, j), max(i, j), blocks), NAMES, data) for j in range(blocks)])
    return run


def split_lists(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(data) -> the shares of every list for each cell in which it has a pair."""
    def cut(data: bytes) -> Iterator[pa.RecordBatch]:
        authors, counts, large, steps, chars = unpack(data)
        ids = _numbers(steps, counts, large)
        n, of = len(counts), np.repeat(np.arange(len(counts)), counts)
        is_large = np.arange(len(ids)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts) < large[of]
        order = np.argsort((ids % blocks).astype(np.uint16 if blocks < 1 << 16 else np.int64), kind="stable")
        ends = np.cumsum(np.bincount(ids % blocks, minlength=blocks))
        shares = []
        for i in range(blocks):
            at = order[ends[i - 1] if i else 0:ends[i]]
            shares.append((of[at], is_large[at], ids[at] // blocks, chars[at], np.bincount(of[at], minlength=n),
                           np.bincount(of[at[is_large[at]]], minlength=n)))

        def side(share: tuple, kept: np.ndarray, used: np.ndarray) -> list[np.ndarray]:
            who, big, local, c = (x[kept] for x in share[:4])
            total = np.bincount(who, minlength=n)[used].astype(np.uint32)
            top = np.bincount(who[big], minlength=n)[used].astype(np.uint32)
            return [total, top, _steps(local, total, top), _narrow(c)]
        for i, one in enumerate(shares):
            rows = []
            for j in range(i, blocks):
                two = shares[j]
                if i == j:
                    use = (one[4] > 1) & (one[5] > 0)
                else:
                    use = (one[4] > 0) & (two[4] > 0) & ((one[5] > 0) | (two[5] > 0))
                used = np.flatnonzero(use)
                if not len(used):
                    continue
                # A small community meets large ones only.
                sides = side(one, use[one[0]] & (one[1] | (two[5] > 0)[one[0]]), used)
                if i != j:
                    sides += side(two, use[two[0]] & (two[1] | (one[5] > 0)[two[0]]), used)
                rows.append((cell_of(i, j, blocks), LISTS, pack(authors.take(pa.array(used)), *sides)))
            if rows:
                yield _cell_rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["data"]:
                yield from cut(data.as_py())
    return run


# ---------------------------------------------------------------- cells -> pairs

@dataclass
class Side:
    """Lists of one block: list of author a at offsets[a]:offsets[a + 1], its large communities first."""

    offsets: np.ndarray
    large: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    names: pa.Array


class Cell:
    """Everything of one cell: authors, and the lists of its one or two blocks."""

    def __init__(self, rows: Iterator[pa.RecordBatch]):
        names: dict[int, list] = {}
        parts: list[list] = []
        self.known: dict[float | None, int] = {}
        for b in rows:
            for kind, data in zip(b["kind"].to_pylist(), b["data"], strict=True):
                got = unpack(data.as_py())
                if kind == NAMES:
                    names.setdefault(int(got[0][0]), []).append((np.cumsum(got[1]), got[2]))
                else:
                    parts.append([got[0], *(x for k in range(1, len(got), 4) for x in (
                        got[k], got[k + 1], _numbers(got[k + 2], got[k], got[k + 1]).astype(np.int32), self._codes(got[k + 3])))])
        self.sides: list[Side] = []
        if not parts:
            return
        self.values = np.array([np.nan if v is None else v for v in self.known], np.float64)
        columns = [list(x) for x in zip(*parts, strict=True)]
        del parts

        def whole(k: int) -> np.ndarray:  # one column at a time
            out, columns[k] = np.concatenate(columns[k]), []
            return out
        self.authors = pa.concat_arrays(columns[0])
        for block, k in zip(sorted(names), range(1, len(columns), 4), strict=True):
            local, values = zip(*names[block], strict=True)
            named = pa.concat_arrays(values).take(pa.array(np.argsort(np.concatenate(local))))
            offsets = np.append(0, np.cumsum(whole(k), dtype=np.int64))
            self.sides.append(Side(offsets, whole(k + 1).astype(np.int32), whole(k + 2), whole(k + 3), named))
        lists = np.diff(self.sides[0].offsets)
        self.author = np.repeat(np.arange(len(lists), dtype=np.int32), lists)  # of the entries of the first side

    def _codes(self, chars: np.ndarray) -> np.ndarray:
        """Characters as places in ``values``, in the least bytes; the values of a cell are few beside its entries."""
        values, at = np.unique(chars, return_inverse=True)
        codes = np.array([self.known.setdefault(None if v != v else v, len(self.known)) for v in values.tolist()], np.int64)
        return codes.astype(np.min_scalar_type(len(self.known)))[at]

    def chars(self, side: Side, entries: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
        return _chars(self.values[side.codes[entries]], where)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """Runs of pairs in the order of the first community: (rank of the first community in the run, its entry, the entry
        of the second, whether the last community goes on in the next run)."""
        if not self.sides:
            return
        shares = math.ceil(len(self.sides[0].ids) / ORDER)
        for share in range(shares):
            yield from self._share(np.flatnonzero(self.sides[0].ids % shares == share))

    def _share(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        a, b = self.sides[0], self.sides[-1]
        who = self.author[entries]
        large = entries - a.offsets[who] < a.large[who]
        if a is b:  # a large community and what is behind it
            count = np.where(large, a.offsets[who + 1] - entries - 1, 0)
        else:
            count = np.where(large, b.offsets[who + 1] - b.offsets[who], b.large[who])
        entries, count = entries[count > 0], count[count > 0]
        order = np.argsort(a.ids[entries], kind="stable")
        entries, count = entries[order], count[order]
        del who, large, order
        at = 0
        while at < len(entries):
            n = count[at:at + LOOK]
            n = n[:max(1, int(np.searchsorted(np.cumsum(n), RUN, side="right")))]
            look = entries[at:at + len(n)]
            at += len(n)
            start = look + 1 if a is b else b.offsets[self.author[look]]
            first = np.repeat(look, n)
            second = np.arange(len(first)) + np.repeat(start - (np.cumsum(n) - n), n)
            rank = np.append(0, np.cumsum(np.diff(a.ids[look]) != 0))
            yield np.repeat(rank, n), first, second, at < len(entries) and a.ids[entries[at]] == a.ids[look[-1]]

    def edges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(authors, entry of the first community, entry of the second) of every two communities; the entries of one author."""
        held, width = None, int(self.sides[-1].ids.max()) + 1 if self.sides else 0
        for rank, first, second, more in self.pairs():
            n = np.ones(len(rank), np.int64)
            if held is not None:
                rank, n, first, second = (np.concatenate(x) for x in zip(held, (rank, n, first, second), strict=True))
            rank, n, first, second = self._fold(rank, n, first, second, width)
            held = None
            if more:
                goes_on = int(np.searchsorted(rank, rank[-1]))
                held = [np.zeros(len(rank) - goes_on, np.int64), n[goes_on:], first[goes_on:], second[goes_on:]]
                n, first, second = n[:goes_on], first[:goes_on], second[:goes_on]
            if len(n):
                yield n, first, second

    def _fold(self, rank: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray, width: int) -> tuple:
        key, bits = rank * width + self.sides[-1].ids[second], len(rank).bit_length()
        if (int(rank[-1]) + 1) * width < 1 << (63 - bits):  # the place rides along in the low bits
            key = (key << bits) | np.arange(len(key))
            key.sort()
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        one = order[starts]
        return rank[one], np.add.reduceat(n[order], starts), first[one], second[one]


def _lists(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Columns as rows of lists of ``ROWS`` values."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, 16 * ROWS):
        part = min(n - at, 16 * ROWS)
        offsets = pa.array(np.append(np.arange(0, part, ROWS), part), pa.int32())
        yield pa.RecordBatch.from_pydict({k: pa.ListArray.from_arrays(offsets, v.slice(at, part)) for k, v in columns.items()})


def _taken(values: pa.Array, at: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
    return values.take(pa.array(at, mask=None if where is None else ~where))


def _chars(values: np.ndarray, where: np.ndarray | None = None) -> pa.Array:
    # An unknown number is NaN on the way.
    return pa.array(values, pa.float64(), mask=np.isnan(values) if where is None else np.isnan(values) | ~where)


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a cell -> lists of edges: (s1, s2, n, author, c1, c2), the last three of edges of one author only."""
    cell = Cell(batches)
    for n, first, second in cell.edges():
        a, b, sole = cell.sides[0], cell.sides[-1], n == 1
        yield from _lists({"s1": _taken(a.names, a.ids[first]), "s2": _taken(b.names, b.ids[second]), "n": pa.array(n),
                           "author": _taken(cell.authors, cell.author[first], sole),
                           "c1": cell.chars(a, first, sole), "c2": cell.chars(b, second, sole)})


def pairs(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of a cell -> lists of pairs (s1, q, c1, s2, c2, author), s2 large; q is the block of s2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, cell = TaskContext.get().partitionId(), Cell(batches)
        i = next((i for i in range(blocks) if cell_of(i, blocks - 1, blocks) >= number), 0)
        j = number - cell_of(i, i, blocks) + i
        for _, first, second, _ in cell.pairs():
            a, b = cell.sides[0], cell.sides[-1]
            who = cell.author[first]
            # Which of the two is large: the second, or else the first.
            large = second - b.offsets[who] < b.large[who]
            s1, s2 = _taken(a.names, a.ids[first]), _taken(b.names, b.ids[second])
            c1, c2 = cell.chars(a, first), cell.chars(b, second)
            keep = pa.array(large)
            yield from _lists({
                "s1": pc.if_else(keep, s1, s2), "q": pa.array(np.where(large, j, i), pa.int32()), "c1": pc.if_else(keep, c1, c2),
                "s2": pc.if_else(keep, s2, s1), "c2": pc.if_else(keep, c2, c1), "author": _taken(cell.authors, who)})
    return run


# ---------------------------------------------------------------- edges -> the best pair of an author

# Candidates looked at before they are folded, and folded ones held by a task.
FOLD, HELD = 1 << 18, 1 << 19


def _plain(values: pa.Array) -> np.ndarray | pa.Array:
    return values.to_numpy() if pa.types.is_integer(values.type) else values


def _first_candidates(held: list[pa.Table]) -> pa.Table:
    """Of the candidates (i, author, j) the first j of every i and author, by i and author. Takes the tables out of the list."""
    table = pa.concat_tables(held)
    held.clear()

    def known(*columns: str) -> pa.Array:
        values = pa.chunked_array([c for name in columns for c in table[name].chunks], table[columns[0]].type).unique()
        return values.take(pc.sort_indices(values))

    def codes(name: str, values: pa.Array) -> np.ndarray:
        return pc.index_in(table[name], value_set=values).to_numpy()
    names, authors = known("i", "j"), known("author")
    n, m = max(len(names), 1), max(len(authors), 1)
    if n * n * m < 1 << 62:
        key = codes("i", names).astype(np.int64)
        key *= m
        key += codes("author", authors)
        key *= n
        key += codes("j", names)
        del table
        key.sort()
        who = key // n
        first = np.append(True, who[1:] != who[:-1])[:len(who)]
        who, j = who[first], (key[first] % n)
        i, who = who // m, who % m
    else:
        i, who, j = codes("i", names), codes("author", authors), codes("j", names)
        del table
        order = np.lexsort((j, who, i))
        i, who, j = i[order], who[order], j[order]
        first = np.append(True, (i[1:] != i[:-1]) | (who[1:] != who[:-1]))[:len(i)]
        i, who, j = i[first], who[first], j[first]
    return pa.table({"i": names.take(pa.array(i)), "author": authors.take(pa.array(who)), "j": names.take(pa.array(j))})


def fold_candidates(targets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b, strong, author), the author of those that qualify -> (target, data): for each target's communities i the
    candidates and which of them are strong."""
    def dealt(values: pa.Array) -> np.ndarray:
        return (pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(targets)).astype(np.int64)

    def packed(table: pa.Table, strong: pa.Array) -> pa.RecordBatch:
        i = table["i"].combine_chunks()
        new = np.append(True, pc.not_equal(i[1:], i[:-1]).to_numpy(zero_copy_only=False)) if len(i) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        counts, values = np.diff(np.append(starts, len(i))), i.take(pa.array(starts))
        target, own = dealt(values), dealt(strong)
        order = np.argsort(np.repeat(target, counts), kind="stable")
        table, ends = table.take(pa.array(order)), np.cumsum(np.bincount(np.repeat(target, counts), minlength=targets))
        author, j = table["author"].combine_chunks(), table["j"].combine_chunks()
        rows = []
        for t in np.unique(np.append(target, own)).tolist():
            begin, end, mine = int(ends[t - 1]) if t else 0, int(ends[t]), np.flatnonzero(target == t)
            rows.append({"target": t, "data": pack(
                values.take(pa.array(mine)), counts[mine].astype(np.uint32), _plain(author.slice(begin, end - begin)),
                _plain(j.slice(begin, end - begin)), strong.take(pa.array(np.flatnonzero(own == t))))})
        return pa.RecordBatch.from_pylist(rows, pa.schema([("target", pa.int32()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough, strong = [], 0, FOLD, None
        for e in batches:
            some = e["strong"].filter(e["strong"])
            if len(some):
                found = [x.filter(e["strong"]) for x in (e["a"], e["b"])]
                strong = pa.concat_arrays(found if strong is None else [strong, *found]).unique()
            known = e.filter(pc.is_valid(e["author"]))
            held += [pa.table({"i": known[i], "author": known["author"], "j": known[j]}) for i, j in (("a", "b"), ("b", "a"))]
            rows += 2 * known.num_rows
            if rows >= enough:
                held = [_first_candidates(held)]
                rows = held[0].num_rows
                if rows >= HELD:
                    yield packed(held[0], held[0]["i"].combine_chunks().slice(0, 0))
                    held, rows = [], 0
                enough = rows + FOLD
        if held:
            table = _first_candidates(held)
            strong = table["i"].combine_chunks().slice(0, 0) if strong is None else strong
            if table.num_rows or len(strong):
                yield packed(table, strong)
        elif strong is not None:
            yield packed(pa.table({"i": strong.slice(0, 0), "author": strong.slice(0, 0), "j": strong.slice(0, 0)}), strong)
    return run


def strong_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All data of one target -> (author, i, j) of the strong communities i."""
    parts = [data.as_py() for b in batches for data in b["data"]]
    strong = None
    for data in parts:
        found = unpack(data)[4]
        strong = found if strong is None else pa.concat_arrays([strong, found])
    for data in parts:
        values, counts, author, j, _ = unpack(data)
        keep = pc.is_in(values, value_set=strong).to_numpy(zero_copy_only=False)
        kept = pa.array(np.flatnonzero(np.repeat(keep, counts)))
        if len(kept):
            yield pa.RecordBatch.from_pydict({
                "author": pa.array(author).take(kept), "i": values.take(pa.array(np.repeat(np.arange(len(keep)), counts)[kept])),
                "j": pa.array(j).take(kept)})
