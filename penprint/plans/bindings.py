"""Bindings of the pipeline's inputs to the driver's test tables.

Each binding exists twice: as a Spark DataFrame builder and as a SQL CTE body
that DuckDB runs over the same Parquet tables (the oracle). Both are written
from the same rules; they read whole tables (queries on posts and comments
together split ``documents`` into the two kinds by doc_id; queries on one kind
alone take every document as that kind).

Rules (fixed values of the test binding):
  submissions: documents with doc_id % 3 = 0, labels left-joined; author
    'u' || doc_id % 37; subreddit = source; title = first 40 characters, selftext
    = the rest; over_18 = (toxic = 1), null when unlabelled; url 'doc/' || doc_id.
  comments: the other documents; body = text; permalink 'doc/' || doc_id.
  ignored authors: u0 and u5.
  graph stats: orders joined to lineitem; author = o_custkey, subreddit =
    l_partkey, characters = sum(l_quantity).
  persona documents: conversations; entity = conv_id as text, persona = user
    for role user and assistant for every other role, slot 0 = user, 1 =
    assistant, ordinal = turn. Queries that compare an entity's two personas
    leave out entities with one side only.
  persona vectors: embeddings; author = floor(vec_id / 2), slot = vec_id % 2.
  day shards: events; created_utc = epoch seconds of ts (UTC).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED_AUTHORS = ["u0", "u5"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def submissions(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Posts; ``every``: all documents as posts, not only the posts' part of the split."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if every else docs.where(F.col("doc_id") % 3 == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = docs.join(labels, "doc_id", "left")
    return d.select(
        F.concat(F.lit("u"), (F.col("doc_id") % 37).cast("string")).alias("author"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("subreddit"),
        F.concat(F.lit("t5_"), F.col("source")).alias("subreddit_id"),
        F.concat(F.lit("r/"), F.col("source")).alias("subreddit_name_prefixed"),
        F.substring("text", 41, 1 << 30).alias("selftext"),
        F.substring("text", 1, 40).alias("title"),
        (F.col("toxic") == 1).alias("over_18"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
    )


def comments(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs if every else docs.where(F.col("doc_id") % 3 != 0)
    return docs.select(
        F.concat(F.lit("u"), (F.col("doc_id") % 37).cast("string")).alias("author"),
        F.col("text").alias("body"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("subreddit"),
        F.concat(F.lit("t5_"), F.col("source")).alias("subreddit_id"),
        F.concat(F.lit("r/"), F.col("source")).alias("subreddit_name_prefixed"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("permalink"),
    )


def ignored_authors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in IGNORED_AUTHORS], "author STRING")


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col("o_custkey").alias("author"), F.col("l_partkey").alias("subreddit")).agg(
        F.sum("l_quantity").alias("num_characters"))


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's statistics as a file holds them: names are strings, characters whole numbers."""
    return graph_stats(spark, sf_dir).select(F.col("author").cast("string"), F.col("subreddit").cast("string"),
                                             F.col("num_characters").cast("bigint"))


def write_in_order(rows: DataFrame, path: str, order: str, files: int, form: str = "json") -> None:
    """Several files whose names and lines follow ``order``: the input of what reads files in their order."""
    rows.repartitionByRange(files, order).sortWithinPartitions(order).write.format(form).save(path)


# A tokenizer that gives ids: words by single spaces, lower case, the first 32 bits of their md5. The
# vocabulary knows the words of conversations that are shorter than seven characters.
def _id(word):
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")


def word_ids(text):
    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), " "), _id)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("token"))
    known = words.where(F.length("token") < 7).groupBy(_id(F.col("token")).alias("token_id"))
    return known.agg(F.min("token").alias("token"))


SQL_WORD_ID = "('0x' || substr(md5(t), 1, 8))::BIGINT"
SQL_VOCABULARY = f"""SELECT {SQL_WORD_ID} AS token_id, min(t) AS token
  FROM (SELECT unnest(string_split(lower(text), ' ')) AS t FROM conversations) WHERE length(t) < 7 GROUP BY 1"""

WIDE_MODEL = "code points modulo 96"


def build_wide_model():
    """A model for the tests of the embedding job; see the query ``embed_texts_model``."""
    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 96))
        for row, text in zip(out, texts, strict=True):
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32) % 96
            row += np.bincount(codes, minlength=96) / max(len(codes), 1)
        return out.astype(np.float32)
    return run


def persona_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("role").eqNullSafe("user")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("entity"),
        F.when(user, F.lit("user")).otherwise(F.lit("assistant")).alias("persona"),
        F.when(user, F.lit(0)).otherwise(F.lit(1)).alias("slot"),
        F.col("turn").alias("ordinal"),
        F.col("text"),
    )


def two_sided(rows: DataFrame, key: str, slot: str) -> DataFrame:
    """Keys that have both personas."""
    return (rows.groupBy(key).agg(F.count_if(F.col(slot) == 0).alias("_a"), F.count_if(F.col(slot) == 1).alias("_b"))
            .where("_a > 0 and _b > 0").select(key))


def inference_pairs(docs: DataFrame) -> DataFrame:
    """Same-entity pairs (user -> assistant) and next-entity pairs (user of e, assistant of e + 1)."""
    ents = two_sided(docs, "entity", "slot")
    same = ents.select(F.col("entity").alias("entity1"), F.lit("user").alias("persona1"),
                       F.col("entity").alias("entity2"), F.lit("assistant").alias("persona2"))
    nxt = (ents.select(F.col("entity").alias("entity1"),
                       (F.col("entity").cast("bigint") + 1).cast("string").alias("entity2"))
           .join(ents.select(F.col("entity").alias("entity2")), "entity2")
           .select("entity1", F.lit("user").alias("persona1"), "entity2", F.lit("assistant").alias("persona2")))
    return same.unionByName(nxt)


def persona_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 2).cast("bigint").cast("string").alias("author"),
        (F.col("vec_id") % 2).cast("int").alias("slot"),
        F.col("label"),
        F.col("embedding"),
    )


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the persona vectors: document d belongs to vector d mod the number of vectors."""
    n = table(spark, sf_dir, "embeddings").count()
    vec = F.col("doc_id") % n
    return table(spark, sf_dir, "documents").select(
        F.floor(vec / 2).cast("bigint").cast("string").alias("author"), (vec % 2).cast("int").alias("slot"),
        F.when(F.col("doc_id") % 3 == 0, "submission").otherwise("comment").alias("kind"),
        F.col("doc_id").alias("ordinal"), "text")


def events_with_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    secs = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return ev.withColumn("created_utc", secs.cast("bigint"))


# ---------------------------------------------------------------- SQL (DuckDB) forms

SQL_EVERY_SUBMISSION = """
  SELECT 'u' || CAST(d.doc_id % 37 AS VARCHAR) AS author, CAST(d.doc_id AS VARCHAR) AS id,
         d.source AS subreddit, 't5_' || d.source AS subreddit_id, 'r/' || d.source AS subreddit_name_prefixed,
         substring(d.text, 41) AS selftext, substring(d.text, 1, 40) AS title,
         (l.toxic = 1) AS over_18, 'doc/' || CAST(d.doc_id AS VARCHAR) AS url
  FROM documents d LEFT JOIN labels l USING (doc_id)"""
SQL_SUBMISSIONS = SQL_EVERY_SUBMISSION + " WHERE d.doc_id % 3 = 0"

SQL_EVERY_COMMENT = """
  SELECT 'u' || CAST(doc_id % 37 AS VARCHAR) AS author, text AS body, CAST(doc_id AS VARCHAR) AS id,
         source AS subreddit, 't5_' || source AS subreddit_id, 'r/' || source AS subreddit_name_prefixed,
         'doc/' || CAST(doc_id AS VARCHAR) AS permalink
  FROM documents"""
SQL_COMMENTS = SQL_EVERY_COMMENT + " WHERE doc_id % 3 <> 0"

SQL_IGNORED = "SELECT * FROM (VALUES ('u0'), ('u5')) t(author)"

SQL_GRAPH_STATS = """
  SELECT o.o_custkey AS author, l.l_partkey AS subreddit, sum(l.l_quantity) AS num_characters
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2"""

SQL_PERSONA_DOCS = """
  SELECT CAST(conv_id AS VARCHAR) AS entity,
         CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS persona,
         CASE WHEN role = 'user' THEN 0 ELSE 1 END AS slot, turn AS ordinal, text
  FROM conversations"""

SQL_INFERENCE_PAIRS = """
  SELECT e.entity AS entity1, 'user' AS persona1, e.entity AS entity2, 'assistant' AS persona2
  FROM (SELECT entity FROM docs GROUP BY entity HAVING count(DISTINCT slot) = 2) e
  UNION ALL
  SELECT a.entity, 'user', b.entity, 'assistant'
  FROM (SELECT entity FROM docs GROUP BY entity HAVING count(DISTINCT slot) = 2) a
  JOIN (SELECT entity FROM docs GROUP BY entity HAVING count(DISTINCT slot) = 2) b
    ON CAST(CAST(a.entity AS BIGINT) + 1 AS VARCHAR) = b.entity"""

SQL_PERSONA_VECTORS = """
  SELECT CAST(CAST(floor(vec_id / 2) AS BIGINT) AS VARCHAR) AS author, CAST(vec_id % 2 AS INTEGER) AS slot,
         label, embedding
  FROM embeddings"""

SQL_VECTOR_DOCS = """
  SELECT CAST(CAST(floor(v / 2) AS BIGINT) AS VARCHAR) AS author, CAST(v % 2 AS INTEGER) AS slot,
         CASE WHEN doc_id % 3 = 0 THEN 'submission' ELSE 'comment' END AS kind, doc_id AS ordinal, text
  FROM (SELECT *, doc_id % (SELECT count(*) FROM embeddings) AS v FROM documents)"""

SQL_EVENTS = """
  SELECT *, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS created_utc FROM events"""


# Persona documents as author records: conversations are authors, their user
# and assistant sides are the two personas (slot 0, 1). Turns 0 and 1 are
# posts (title = first 40 characters, selftext = the rest), later turns are
# comments. Every turn of every conversation is used.

def conv_personas(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("entity").alias("author"), "slot", F.col("persona").alias("subreddit")).distinct()


def conv_submissions(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("ordinal") < 2).select(
        F.col("entity").alias("author"), F.col("persona").alias("subreddit"), "ordinal",
        F.substring("text", 1, 40).alias("title"), F.substring("text", 41, 1 << 30).alias("selftext"),
        F.concat(F.lit("conv/"), F.col("entity"), F.lit("/"), F.col("ordinal").cast("string")).alias("url"))


def conv_comments(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("ordinal") >= 2).select(
        F.col("entity").alias("author"), F.col("persona").alias("subreddit"), "ordinal",
        F.col("text").alias("body"),
        F.concat(F.lit("conv/"), F.col("entity"), F.lit("/"), F.col("ordinal").cast("string")).alias("permalink"))


SQL_AUTHOR_DOCS = f"""
docs AS ({SQL_PERSONA_DOCS}),
personas AS (SELECT DISTINCT entity AS author, slot, persona AS subreddit FROM docs),
subs AS (SELECT entity AS author, persona AS subreddit, ordinal, substring(text, 1, 40) AS title,
                substring(text, 41) AS selftext, 'conv/' || entity || '/' || CAST(ordinal AS VARCHAR) AS url
         FROM docs WHERE ordinal < 2),
coms AS (SELECT entity AS author, persona AS subreddit, ordinal, text AS body,
                'conv/' || entity || '/' || CAST(ordinal AS VARCHAR) AS permalink
         FROM docs WHERE ordinal >= 2),
flat AS (
  SELECT p.author, p.slot, p.subreddit, d.kind, d.ordinal, d.title, d.selftext, d.url, d.body, d.permalink
  FROM personas p LEFT JOIN (
    SELECT author, subreddit, 'submission' AS kind, ordinal, title, selftext, url,
           CAST(NULL AS VARCHAR) AS body, CAST(NULL AS VARCHAR) AS permalink FROM subs
    UNION ALL
    SELECT author, subreddit, 'comment', ordinal, NULL, NULL, NULL, body, permalink FROM coms) d
  USING (author, subreddit))"""
