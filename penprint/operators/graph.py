"""Community graph.

Two communities are joined by an edge that counts the authors active in both.
Communities have dense numbers and are dealt to blocks by them; two blocks are a
cell, and a cell is one task. An author's communities are one list, which lies
packed with those of many authors, and every cell gets the author's communities
of its two blocks if they have a pair. So what is shuffled are list entries, as
often as there are blocks, in two or three bytes each, and a pair is made where
it is counted. Beside the count an edge of one author carries that author and
the characters in both communities.

Three things are bounded. The number of cells follows the number of pairs
(``CELL`` a task at most), a cell makes its pairs a run at a time in the order
of the first community (``pairing.RUN``) and holds only lists beside, so the
memory of a task follows its entries and not its pairs. And the selection of
authors needs only edges that touch a community with at least
``min_max_neighbours`` authors: no smaller community can share that many with
another, so it cannot be the first of a pair, and two smaller ones need not
meet. A list holds the larger ones first, and authors without one leave before.

P6 and P7 restrict the incidences before the join, so that only communities
and authors that can matter are multiplied. A null author or community stops
the job with an error: it would come from a damaged input line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.operators import pairing
from penprint.session import stored

# Default thresholds of the reference's selection rules.
ACTIVE_SUBREDDIT_MIN_COUNT = 1000      # P6: count strictly greater than this
MIN_MAX_NEIGHBOURS = 20                # P14: max shared authors with any other subreddit
MIN_CHARS_PER_SUBREDDIT = 5000         # P16: characters in each of the two (>=)

# Entries of a packed batch of lists, pairs of a cell at most and, with no more than ``TASKS`` cells, at least.
PART = 1 << 17
CELL, LEAST, TASKS = 1 << 26, 1 << 20, 28


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"null {name} in the author x community statistics: "
                                                       "damaged input line")))


def graph_incidence(stats: DataFrame, active: DataFrame | None = None,
                    min_activity: int = ACTIVE_SUBREDDIT_MIN_COUNT,
                    authors: DataFrame | None = None) -> DataFrame:
    """P6 + P7: stats rows of very active subreddits (count > min_activity) and chosen authors."""
    inc = stats.select(_known("author").alias("author"), _known("subreddit").alias("subreddit"), "num_characters")
    if authors is not None:
        inc = inc.join(authors.select("author"), "author", "left_semi")
    if active is not None:  # Last, so that the rows lie by community, as the graph wants them.
        inc = inc.join(active.where(F.col("count") > min_activity).select("subreddit"), "subreddit", "left_semi")
    return inc.select("author", "subreddit", "num_characters")


def _incidences(incidence: DataFrame) -> DataFrame:
    """(author, subreddit, chars), one row each. Repeated rows must agree: which one stands is for the reader
    of the statistics to decide (``readers.last_of``)."""
    chars = F.col("num_characters").cast("double") if "num_characters" in incidence.columns else F.lit(None).cast("double")
    one = incidence.select("author", "subreddit", chars.alias("chars")).groupBy("author", "subreddit").agg(
        F.min("chars").alias("chars"), F.max("chars").alias("_most"))
    message = F.concat(F.lit("repeated statistics of an author and community: "), F.col("author").cast("string"), F.lit(", "),
                       F.col("subreddit").cast("string"))
    agreed = F.when(F.col("chars").eqNullSafe(F.col("_most")), F.col("chars")).otherwise(F.raise_error(message))
    # The keys stay as they are, and with them where the rows lie.
    known = F.when(_known("author").isNotNull() & _known("subreddit").isNotNull(), agreed)
    return one.select("author", "subreddit", known.alias("chars"))


def _lists(incidence: DataFrame, min_degree: int, part: int) -> tuple[DataFrame, DataFrame]:
    """(data, pairs): packed batches of the lists of authors that have a pair, and (id, name) of the communities."""
    inc = _incidences(incidence)
    large = F.count(F.lit(1)).over(Window.partitionBy("subreddit")) >= min_degree
    rows = inc.select("author", "subreddit", "chars", large.alias("large")).sortWithinPartitions("subreddit")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = stored(rows.mapInArrow(pairing.number, f"pid int, n bigint, author {kind['author']}, name {kind['subreddit']}, "
                                                  "chars double, large boolean"), "incidences")
    # One row per partition: how many communities lie before it.
    counts = {r.pid: r.n + 1 for r in rows.groupBy("pid").agg(F.max("n").alias("n")).collect()}
    before = [sum(counts.get(i, 0) for i in range(pid)) for pid in range(max(counts, default=0) + 1)]
    place = F.get(F.array(*map(F.lit, before)), F.col("pid")) + F.col("n")
    rows = rows.select("author", "large", place.cast("bigint").alias("id"), "chars", "name")
    listed = rows.select("author", "large", "id", "chars").repartition("author").sortWithinPartitions(
        "author", F.col("large").desc(), "id")
    batches = stored(listed.mapInArrow(pairing.batch(part), "data binary, pairs bigint"), "lists").where("pairs > 0")
    return batches, rows.where(F.col("name").isNotNull()).select("id", "name")


def _cells(incidence: DataFrame, min_degree: int, part: int) -> tuple[DataFrame, int]:
    """(cell, kind, data), every cell in the task of its number, and the number of blocks."""
    batches, names = _lists(incidence, min_degree, part)
    pairs = batches.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(1, math.ceil(pairs / min(CELL, max(LEAST, pairs // TASKS))))
    blocks = (math.isqrt(8 * tasks + 1) - 1) // 2  # as many as have a cell for every task, or nearly
    schema = "cell int, kind int, data binary"
    rows = batches.select("data").mapInArrow(pairing.split_lists(blocks), schema).unionByName(
        names.mapInArrow(pairing.split_names(blocks), schema))
    return rows.repartitionById(tasks, "cell"), blocks


def _types(incidence: DataFrame) -> tuple[str, str]:
    return tuple(incidence.schema[c].dataType.simpleString() for c in ("author", "subreddit"))


def _unpacked(rows: DataFrame) -> DataFrame:
    """Rows of equally long lists -> one row per place."""
    first, *others = rows.columns
    one = rows.select(F.posexplode(first).alias("at", first), *others)
    return one.select(first, *[F.get(c, F.col("at")).alias(c) for c in others])


def shared_author_rows(incidence: DataFrame, min_degree: int = 1, part: int = PART) -> DataFrame:
    """The rows behind the edges: (s1, q, c1, s2, c2, author), s2 a community of at least ``min_degree`` authors.

    Two communities meet once; all rows of s1 and q, the block of s2, are in one task.
    """
    author, subreddit = _types(incidence)
    cells, blocks = _cells(incidence, min_degree, part)
    return _unpacked(cells.mapInArrow(
        pairing.pairs(blocks), f"s1 array<{subreddit}>, q array<int>, c1 array<double>, s2 array<{subreddit}>, "
                               f"c2 array<double>, author array<{author}>"))


def subreddit_adjacency(incidence: DataFrame, min_degree: int = 1, part: int = PART) -> DataFrame:
    """Undirected edges (subreddit_a < subreddit_b, shared_authors >= 1, sole_author).

    ``sole_author`` is the one shared author when shared_authors = 1, else null (J5);
    ``sole_chars_a`` / ``sole_chars_b`` are that author's characters in each community.
    With ``min_degree``, only edges that touch a community of at least so many authors.
    """
    author, subreddit = _types(incidence)
    cells, _ = _cells(incidence, min_degree, part)
    edges = _unpacked(cells.mapInArrow(
        pairing.edges, f"s1 array<{subreddit}>, s2 array<{subreddit}>, n array<bigint>, author array<{author}>, "
                       "c1 array<double>, c2 array<double>"))
    swap = F.col("s1") > F.col("s2")
    return edges.select(
        F.least("s1", "s2").alias("subreddit_a"), F.greatest("s1", "s2").alias("subreddit_b"), F.col("n").alias("shared_authors"),
        F.col("author").alias("sole_author"), F.when(swap, F.col("c2")).otherwise(F.col("c1")).alias("sole_chars_a"),
        F.when(swap, F.col("c1")).otherwise(F.col("c2")).alias("sole_chars_b"))


def adjacency_histogram(edges: DataFrame) -> DataFrame:
    """Number of undirected edges per shared-author count."""
    return edges.groupBy("shared_authors").agg(F.count(F.lit(1)).alias("n_pairs"))


def suitable_authors(edges: DataFrame, min_max_neighbours: int = MIN_MAX_NEIGHBOURS,
                     min_chars: int = MIN_CHARS_PER_SUBREDDIT, order: DataFrame | None = None) -> DataFrame:
    """P14 + P15 + P16 + W1: one persona pair per author.

    Candidate (i, j): subreddit i shares at least ``min_max_neighbours`` authors
    with some subreddit (tested on i only), i and j share exactly one author,
    and that author has at least ``min_chars`` characters in both. Each author
    keeps the first candidate in (order(i), order(j)); a failed candidate
    leaves no trace, so this equals the greedy scan. ``order`` is an optional
    (subreddit, subreddit_order) table; communities it lacks come after all
    others, by value. The default order is the subreddit value.

    The edges are read once and never stored: both tests are rows of the same
    stream, folded to one row per (community, author) inside a task and dealt by
    community, where those of communities that pass P14 are left over. Edges from
    ``subreddit_adjacency(.., min_degree=min_max_neighbours)`` suffice.
    """
    qualifies = ((F.col("shared_authors") == 1) & (F.col("sole_chars_a") >= min_chars)
                 & (F.col("sole_chars_b") >= min_chars))
    strong = F.col("shared_authors") >= min_max_neighbours
    found = edges.where(qualifies | strong).select(
        F.col("subreddit_a").alias("a"), F.col("subreddit_b").alias("b"), strong.alias("strong"),
        F.when(qualifies, F.col("sole_author")).alias("author"))
    if order is None:
        tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kind = {f.name: f.dataType.simpleString() for f in found.schema.fields}
        dealt = found.mapInArrow(pairing.fold_candidates(tasks), "target int, data binary").repartitionById(tasks, "target")
        ok = dealt.mapInArrow(pairing.strong_candidates, f"author {kind['author']}, i {kind['a']}, j {kind['a']}")
        best = ok.groupBy("author").agg(F.min(F.struct("i", "j")).alias("best"))
        return best.select("author", F.col("best.i").alias("subreddit_0"), F.col("best.j").alias("subreddit_1"))
    rows = found.select("strong", "author", F.explode(F.array(
        F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("e"))
    rows = rows.select("strong", "author", F.col("e.i").alias("i"), F.when(F.col("author").isNotNull(), F.col("e.j")).alias("j"))
    place = order.select(F.col("subreddit").alias("j"), F.col("subreddit_order").alias("oj"))
    rows = rows.join(place, "j", "left")
    first_j = F.min(F.when(F.col("j").isNotNull(), F.struct(F.col("oj").isNull().alias("late"), "oj", "j")))
    reduced = stored(rows.groupBy("i", "author").agg(F.max("strong").alias("strong"), first_j.alias("first")), "candidates")
    strong_ones = reduced.where("strong").select("i").distinct()
    ok = reduced.where(F.col("author").isNotNull()).join(strong_ones, "i", "left_semi")
    ok = ok.join(order.select(F.col("subreddit").alias("i"), F.col("subreddit_order").alias("oi")), "i", "left")
    best = ok.groupBy("author").agg(F.min(F.struct(F.col("oi").isNull().alias("late"), "oi", "i", "first")).alias("best"))
    return best.select("author", F.col("best.i").alias("subreddit_0"), F.col("best.first.j").alias("subreddit_1"))
