"""Personas: documents attached to (author, community) pairs.

The working form is flat: one row per document with (author, slot, subreddit,
kind, ordinal, ...). The nested author record (K7/S7) is an interchange format
built from and flattened back to that form; no computation needs it. A record
holds a bounded number of bytes: an author with more documents has several.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions.columns import arm_of, sha256_mod_100
from penprint.session import cut_lineage
from penprint.sources.readers import FILE_ORDER, with_file_order


def personas_from_selection(selection: DataFrame) -> DataFrame:
    """(author, subreddit_0, subreddit_1) -> (author, slot, subreddit), two rows per author."""
    return selection.select("author", F.posexplode(F.array("subreddit_0", "subreddit_1")).alias("slot", "subreddit")) \
        .select("author", F.col("slot").cast("int").alias("slot"), "subreddit")


def attach_documents(personas: DataFrame, submissions: DataFrame, comments: DataFrame,
                     ordinal: str = "ordinal") -> DataFrame:
    """J6 + J7: each persona's posts and comments in its community, flat.

    ``submissions``/``comments`` carry an ``ordinal`` column giving document
    order: a number, or the place in the files that ``readers.with_file_order``
    adds. A persona without documents is kept with one row whose kind is null
    (left join), so empty personas survive.
    """
    def place(rows: DataFrame):
        return F.col(ordinal) if isinstance(rows.schema[ordinal].dataType, T.StructType) else F.col(ordinal).cast("bigint")

    posts = submissions.select("author", "subreddit", F.lit("submission").alias("kind"),
                               place(submissions).alias("ordinal"), "title", "selftext", "url",
                               F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("permalink"))
    notes = comments.select("author", "subreddit", F.lit("comment").alias("kind"),
                            place(comments).alias("ordinal"),
                            F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("selftext"),
                            F.lit(None).cast("string").alias("url"), "body", "permalink")
    docs = posts.unionByName(notes)
    return personas.select("author", "slot", "subreddit").join(docs, ["author", "subreddit"], "left")


# Bytes of text in one nested record.
RECORD_BYTES = 8 << 20

_DOC_FIELDS = {"submission": ("title", "selftext", "url"), "comment": ("body", "permalink")}


def _numbered_chunks(flat: DataFrame, max_bytes: int) -> DataFrame:
    """Documents with their place: (chunk, the author's 0-based record; first, the position of the record's first
    document of this kind among the persona's).

    The documents are sorted by range over all tasks, so an author with very many is spread; running sums of
    bytes stay inside a task's part, and only sums per piece are put together.
    """
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for f in _DOC_FIELDS.values() for c in f), F.lit(0))
    order = ["author", "slot", "kind", "ordinal"]
    run = cut_lineage(flat.withColumn("_bytes", text.cast("bigint"))
                      .repartitionByRange(*order).withColumn("_run", F.spark_partition_id()))
    inside = Window.partitionBy("_run", "author").orderBy("slot", "kind", "ordinal")
    # Documents that end in the same half of the bound share a record; one larger than that has its own.
    half = max(1, max_bytes // 2)
    sized = run.withColumn("_alone", F.col("_bytes") > half).withColumn(
        "_half", F.floor(F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) / half))
    begins = (F.col("_alone") | F.coalesce(F.lag("_alone").over(inside), F.lit(True))
              | (F.lag("_half").over(inside) != F.col("_half")))
    number = F.sum(F.col("_begins").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    pieces = sized.withColumn("_begins", begins).withColumn("_piece", F.struct(F.col("_run"), number.alias("no")))
    # Rows of one piece; few beside the documents.
    counts = cut_lineage(pieces.groupBy("author", "_piece", "slot", "kind").agg(F.count("kind").alias("_n")))
    number = F.dense_rank().over(Window.partitionBy("author").orderBy("_piece")) - 1
    before = F.sum("_n").over(Window.partitionBy("author", "slot", "kind").orderBy("_piece")
                              .rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("author", "_piece", "slot", "kind", number.cast("int").alias("chunk"),
                           F.coalesce(before, F.lit(0)).alias("first"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("author", "_piece", "slot", "kind")]
    joined = pieces.alias("d").join(places.alias("p"), reduce(lambda x, y: x & y, same))
    return joined.select("d.*", "p.chunk", "p.first").drop("_piece", "_run", "_bytes", "_alone", "_half", "_begins")


def nest_author_docs(flat: DataFrame, max_bytes: int = RECORD_BYTES) -> DataFrame:
    """Flat documents -> AuthorInfo records (interchange only).

    An author whose texts exceed ``max_bytes`` has several records, numbered by ``chunk``; each holds the
    personas that have documents in it, with their ``slot`` and the positions of the first ones. No record is
    larger, unless one document alone is.
    """
    def docs(kind: str):
        one = F.struct("ordinal", F.struct(*_DOC_FIELDS[kind]).alias("d"))
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, one)))

    placed = _numbered_chunks(flat, max_bytes)
    first = {k: F.coalesce(F.min(F.when(F.col("kind") == k, F.col("first"))), F.lit(0)) for k in _DOC_FIELDS}
    per_persona = placed.groupBy("author", "chunk", "slot", "subreddit").agg(
        docs("submission").alias("_s"), docs("comment").alias("_c"),
        first["submission"].alias("first_submission"), first["comment"].alias("first_comment"))
    persona = F.struct(F.col("subreddit"), F.transform("_s", lambda x: x["d"]).alias("submissions"),
                       F.transform("_c", lambda x: x["d"]).alias("comments"), F.col("slot"),
                       F.col("first_submission"), F.col("first_comment"))
    return (per_persona.groupBy("author", "chunk")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("slot"), persona.alias("p")))).alias("_p"))
            .select(F.col("author").alias("username"), "chunk", F.transform("_p", lambda x: x["p"]).alias("personas")))


def flatten_author_docs(nested: DataFrame) -> DataFrame:
    """S7 inverse of ``nest_author_docs``: positions replace ordinals; the records of an author are put together.

    Records without chunk, slot or first positions (one record per author) count from 0.
    """
    personas = nested.select(F.col("username").alias("author"), F.posexplode("personas").alias("_at", "p")).select(
        "author", F.coalesce("p.slot", "_at").cast("int").alias("slot"), F.col("p.subreddit").alias("subreddit"), "p")

    def docs(kind: str) -> DataFrame:
        rows = personas.select("author", "slot", "subreddit", F.lit(kind).alias("kind"),
                               F.coalesce(F.col(f"p.first_{kind}"), F.lit(0)).cast("bigint").alias("_first"),
                               F.posexplode(f"p.{kind}s").alias("_place", "d"))
        fields = [F.col(f"d.{c}").alias(c) if k == kind else F.lit(None).cast("string").alias(c)
                  for k, names in _DOC_FIELDS.items() for c in names]
        return rows.select("author", "slot", "subreddit", "kind", (F.col("_first") + F.col("_place")).alias("position"), *fields)

    return docs("submission").unionByName(docs("comment"))


def persona_texts(flat: DataFrame) -> DataFrame:
    """Texts for embedding: title, plus a blank line and the selftext when it is not
    empty; then comment bodies. ``doc_order`` (0 posts, 1 comments) + ordinal give the order."""
    docs = flat.where(F.col("kind").isNotNull())
    text = F.when(F.col("kind") == "submission",
                  F.concat(F.coalesce(F.col("title"), F.lit("")),
                           F.when(F.coalesce(F.col("selftext"), F.lit("")) != "",
                                  F.concat(F.lit("\n\n"), F.col("selftext"))).otherwise(F.lit(""))))
    text = text.otherwise(F.col("body"))
    order = F.when(F.col("kind") == "submission", F.lit(0)).otherwise(F.lit(1))
    return docs.select("author", "slot", "subreddit", order.alias("doc_order"), "ordinal", text.alias("text"))


def persona_segments(flat: DataFrame) -> DataFrame:
    """P10: text segments for tokenizing: title and selftext separately, then bodies."""
    docs = flat.where(F.col("kind").isNotNull())
    parts = F.when(F.col("kind") == "submission", F.array(F.col("title"), F.col("selftext"))).otherwise(
        F.array(F.col("body")))
    return docs.select("author", "slot", "subreddit", "ordinal", F.posexplode(parts).alias("part", "text"))


def with_arm(df: DataFrame, name: str = "author") -> DataFrame:
    """Arm by int(sha256(name)) % 100: < 70 train, < 85 val, else test."""
    return df.withColumn("arm", arm_of(sha256_mod_100(F.col(name).cast("string"))))


def persona_pairs(persona_rows: DataFrame, author: str = "author", slot: str = "slot",
                  value: str = "embedding") -> DataFrame:
    """M8: one row per author with the persona-0 and persona-1 values; every author
    must have exactly the two slots 0 and 1, otherwise the job fails."""
    agg = persona_rows.groupBy(author).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(slot) == 0).alias("_n0"), F.count_if(F.col(slot) == 1).alias("_n1"),
        F.max(F.when(F.col(slot) == 0, F.col(value))).alias(f"{value}_0"),
        F.max(F.when(F.col(slot) == 1, F.col(value))).alias(f"{value}_1"))
    wrong = (F.col("_n") != 2) | (F.col("_n0") != 1) | (F.col("_n1") != 1)
    message = F.concat(F.lit("author without exactly two personas (slots 0 and 1): "), F.col(author).cast("string"))
    return agg.select(F.when(wrong, F.raise_error(message)).otherwise(F.col(author)).alias(author),
                      f"{value}_0", f"{value}_1")


def group_documents(documents: DataFrame, order: str | None = None) -> DataFrame:
    """A8, inference side: (entity, persona, texts in order). ``order`` is a column; the default is file order,
    for documents as ``readers.read_documents`` gives them.

    An export form like the nested record: scoring works on the flat rows.
    """
    if order is None:
        documents, order = with_file_order(documents, source="parquet"), FILE_ORDER
    rows = documents.select("entity", "persona", F.col(order).alias("_order"), "text")
    return rows.groupBy("entity", "persona").agg(F.array_sort(F.collect_list(F.struct("_order", "text"))).alias("_t")) \
        .select("entity", "persona", F.transform("_t", lambda x: x["text"]).alias("texts"))
