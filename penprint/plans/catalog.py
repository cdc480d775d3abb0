"""Registered queries: each binds library operators to the test tables.

Every query reads whole tables (see ``bindings``) and returns a DataFrame; its
DuckDB oracle is the SQL string of the same name. Doubles are rounded to 6
places on both sides for the comparison only; the library keeps full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions.columns import TOKEN_PATTERN
from penprint.operators import scoring
from penprint.operators import tokens as tok
from penprint.plans import bindings as B
from penprint.session import cut_lineage, scratch_path, stored
from penprint.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN_PATTERN}')"


# ------------------------------------------------------------------ scoring (flagship)

SQL_PERSONA_COUNTS = f"""
docs AS ({B.SQL_PERSONA_DOCS}),
toks AS (SELECT entity, persona, unnest({sql_tokens('text')}) AS token FROM docs),
counts AS (SELECT entity, persona, token, count(*) AS n FROM toks GROUP BY ALL)"""


@register("infer_log_likelihood", f"""
WITH {SQL_PERSONA_COUNTS},
per_author AS (SELECT entity, token, sum(n) AS n FROM counts GROUP BY ALL),
freq AS (SELECT token, sum(n) AS n FROM per_author GROUP BY token HAVING count(*) >= 2),
model AS (SELECT token FROM freq ORDER BY n DESC, token ASC LIMIT 40),
k AS (SELECT count(*) AS k FROM model),
totals AS (SELECT entity, persona, sum(n) AS n_total FROM counts GROUP BY ALL),
inset AS (SELECT c.entity, c.persona, c.token, c.n FROM counts c JOIN model USING (token)),
pairs AS ({B.SQL_INFERENCE_PAIRS}),
obs AS (
  SELECT p.entity1, p.persona1, p.entity2, p.persona2,
         sum(o.n * log2(coalesce(m.n, 0) + 0.5)) AS w, sum(o.n) AS n_obs
  FROM pairs p
  JOIN inset o ON o.entity = p.entity2 AND o.persona = p.persona2
  LEFT JOIN inset m ON m.entity = p.entity1 AND m.persona = p.persona1 AND m.token = o.token
  GROUP BY ALL)
SELECT p.entity1, p.persona1, p.entity2, p.persona2,
       round(CASE WHEN obs.n_obs IS NULL THEN 0.0
             ELSE obs.w / obs.n_obs - log2(t.n_total + (k.k + 1) / 2.0) END, 6) AS match_score
FROM pairs p
JOIN totals t ON t.entity = p.entity1 AND t.persona = p.persona1
LEFT JOIN obs USING (entity1, persona1, entity2, persona2)
CROSS JOIN k""")
def q_infer_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents and pairs from Parquet, same-author and next-author persona pairs scored with a
    log-likelihood model whose token set is the corpus' 40 most frequent tokens, scores to Parquet."""
    source = B.persona_documents(spark, sf_dir)
    paths = [scratch_path(spark, n) for n in ("documents", "pairs", "scores")]
    writers.write_parquet(source, paths[0])
    writers.write_parquet(B.inference_pairs(source), paths[1])
    docs, pairs = readers.read_documents(spark, paths[0]), readers.read_pairs(spark, paths[1])
    personas, counts = scoring.document_counts(docs)
    counts = cut_lineage(counts)  # the model and the scorer read it
    model_tokens = cut_lineage(tok.token_frequencies(counts, ["entity"], top_k=40, min_authors=2))
    writers.write_scores(scoring.score_log_likelihood(personas, counts, model_tokens, pairs), paths[2])
    return rounded(readers.read_scores(spark, paths[2]))


# ------------------------------------------------------------------ corpus (scan, clean, profile)

from penprint.operators import corpus  # noqa: E402

SQL_FILTERED_SUBS = f"""
subs AS ({B.SQL_SUBMISSIONS}),
flags AS (SELECT subreddit,
                 count(*) FILTER (WHERE coalesce(over_18, false)) / (count(*) + 0.1) > 0.1 AS flagged
          FROM subs GROUP BY subreddit),
fsubs AS (SELECT s.* FROM subs s JOIN flags f USING (subreddit)
          WHERE NOT (coalesce(s.over_18, false) AND f.flagged)
            AND s.author NOT IN (SELECT author FROM ({B.SQL_IGNORED}))),
coms AS ({B.SQL_COMMENTS}),
fcoms AS (SELECT * FROM coms WHERE author NOT IN (SELECT author FROM ({B.SQL_IGNORED})))"""

SQL_STATS = f"""{SQL_FILTERED_SUBS},
act AS (SELECT author, subreddit, 'post' AS kind,
               coalesce(length(selftext), 0) + coalesce(length(title), 0) AS chars FROM fsubs
        UNION ALL
        SELECT author, subreddit, 'comment', coalesce(length(body), 0) FROM fcoms),
stats AS (SELECT author, subreddit, sum(chars) AS num_characters,
                 count(*) FILTER (WHERE kind = 'comment') AS num_comments,
                 count(*) FILTER (WHERE kind = 'post') AS num_posts
          FROM act GROUP BY ALL),
prolific AS (SELECT author FROM stats GROUP BY author
             HAVING count(*) FILTER (WHERE num_characters >= 10000) >= 2)"""


SQL_EVERY_FILTERED = SQL_FILTERED_SUBS.replace(B.SQL_SUBMISSIONS, B.SQL_EVERY_SUBMISSION).replace(
    B.SQL_COMMENTS, B.SQL_EVERY_COMMENT)


def _filtered(spark, sf_dir):
    subs, coms = B.submissions(spark, sf_dir), B.comments(spark, sf_dir)
    ign = B.ignored_authors(spark)
    return corpus.filter_submissions(subs, ign), corpus.filter_comments(coms, ign)


def _cleaned(spark, sf_dir):
    """The clean step once, as Parquet: what is read from it afterwards keeps column pruning."""
    out = []
    for name, df in zip(("clean-posts", "clean-comments"), _filtered(spark, sf_dir), strict=True):
        path = scratch_path(spark, name)
        writers.write_parquet(df, path)
        out.append(spark.read.schema(df.schema).parquet(path))
    return out


def _stats(spark, sf_dir):
    fs, fc = _cleaned(spark, sf_dir)
    stats = cut_lineage(corpus.characters_per_author_subreddit(fs, fc))
    return fs, fc, stats, corpus.prolific_authors(stats, 10000)


@register("scan_submissions", f"WITH s AS ({B.SQL_EVERY_SUBMISSION}) SELECT * FROM s")
def q_scan_submissions(spark, sf_dir):
    path = scratch_path(spark, "submissions")
    writers.write_ndjson(B.submissions(spark, sf_dir, every=True), path)
    return readers.read_submissions(spark, path)


@register("scan_comments", f"WITH c AS ({B.SQL_EVERY_COMMENT}) SELECT * FROM c")
def q_scan_comments(spark, sf_dir):
    path = scratch_path(spark, "comments")
    writers.write_ndjson(B.comments(spark, sf_dir, every=True), path)
    return readers.read_comments(spark, path)


SQL_FLAGS = f"""WITH subs AS ({B.SQL_EVERY_SUBMISSION})
SELECT subreddit, count(*) FILTER (WHERE coalesce(over_18, false)) / (count(*) + 0.1) > 0.1 AS flagged
FROM subs GROUP BY subreddit"""


@register("nsfw_flags", SQL_FLAGS)
def q_nsfw_flags(spark, sf_dir):
    return corpus.nsfw_flags(B.submissions(spark, sf_dir, every=True))


@register("nsfw_flags_roundtrip", SQL_FLAGS)
def q_nsfw_flags_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "nsfw-flags")
    writers.write_nsfw_flags(corpus.nsfw_flags(B.submissions(spark, sf_dir, every=True)), path)
    return readers.read_nsfw_flags(spark, path)


@register("nsfw_flags_object", SQL_FLAGS)
def q_nsfw_flags_object(spark, sf_dir):
    path = scratch_path(spark, "nsfw-flag-object")
    writers.write_nsfw_flag_object(corpus.nsfw_flags(B.submissions(spark, sf_dir, every=True)), path)
    return readers.read_nsfw_flags(spark, path, single_object=True)


@register("filter_submissions", f"WITH {SQL_EVERY_FILTERED} SELECT * FROM fsubs")
def q_filter_submissions(spark, sf_dir):
    return corpus.filter_submissions(B.submissions(spark, sf_dir, every=True), B.ignored_authors(spark))


@register("filter_with_given_flags", f"WITH {SQL_EVERY_FILTERED} SELECT * FROM fsubs")
def q_filter_with_given_flags(spark, sf_dir):
    """The flag map loaded from its object form instead of computed (S3)."""
    subs = B.submissions(spark, sf_dir, every=True)
    return corpus.filter_submissions(subs, B.ignored_authors(spark), q_nsfw_flags_object(spark, sf_dir), on_missing="error")


@register("filter_comments", f"WITH {SQL_EVERY_FILTERED} SELECT * FROM fcoms")
def q_filter_comments(spark, sf_dir):
    return corpus.filter_comments(B.comments(spark, sf_dir, every=True), B.ignored_authors(spark))


@register("prolific_authors", f"WITH {SQL_STATS} SELECT author FROM prolific")
def q_prolific_authors(spark, sf_dir):
    return _stats(spark, sf_dir)[3]


@register("prolific_list_roundtrip", f"WITH {SQL_STATS} SELECT author FROM prolific")
def q_prolific_list_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "prolific")
    writers.write_line_list(_stats(spark, sf_dir)[3], path)
    return readers.read_line_list(spark, path)


@register("author_subreddit_stats", f"WITH {SQL_STATS} SELECT * FROM stats WHERE author IN (SELECT author FROM prolific)")
def q_author_subreddit_stats(spark, sf_dir):
    _, _, stats, prolific = _stats(spark, sf_dir)
    path = scratch_path(spark, "stats")
    writers.write_ndjson(corpus.author_subreddit_stats(stats, prolific), path)
    return readers.read_author_subreddit_stats(spark, path)


@register("prolific_submissions", f"WITH {SQL_STATS} SELECT * FROM fsubs WHERE author IN (SELECT author FROM prolific)")
def q_prolific_submissions(spark, sf_dir):
    fs, _, _, prolific = _stats(spark, sf_dir)
    path = scratch_path(spark, "prolific-posts")
    writers.write_ndjson(corpus.of_authors(fs, prolific), path)
    return readers.read_submissions(spark, path)


@register("prolific_comments", f"WITH {SQL_STATS} SELECT * FROM fcoms WHERE author IN (SELECT author FROM prolific)")
def q_prolific_comments(spark, sf_dir):
    _, fc, _, prolific = _stats(spark, sf_dir)
    path = scratch_path(spark, "prolific-comments")
    writers.write_ndjson(corpus.of_authors(fc, prolific), path)
    return readers.read_comments(spark, path)


SQL_COUNTS = f"""WITH {SQL_FILTERED_SUBS},
rows_ AS (SELECT author, subreddit FROM fsubs UNION ALL SELECT author, subreddit FROM fcoms),
authors AS (SELECT author, count(*) AS count FROM rows_ GROUP BY author),
subreddits AS (SELECT subreddit, count(*) AS count FROM rows_ GROUP BY subreddit)"""


@register("author_counts", f"{SQL_COUNTS} SELECT * FROM authors WHERE count >= 25")
def q_author_counts(spark, sf_dir):
    fs, fc = _filtered(spark, sf_dir)
    path = scratch_path(spark, "author-counts")
    writers.write_count_csv(corpus.at_least(corpus.activity_counts(fs, fc, "author"), 25), path)
    return readers.read_count_csv(spark, path, "author")


@register("active_subreddits", f"{SQL_COUNTS} SELECT * FROM subreddits WHERE count >= 30")
def q_active_subreddits(spark, sf_dir):
    fs, fc = _filtered(spark, sf_dir)
    path = scratch_path(spark, "subreddit-counts")
    writers.write_count_csv(corpus.at_least(corpus.activity_counts(fs, fc, "subreddit"), 30), path)
    return readers.read_count_csv(spark, path, "subreddit")


@register("activity_summary", f"""{SQL_COUNTS}
SELECT (SELECT count(*) FROM authors) AS n_authors,
       (SELECT count(*) FROM authors WHERE count >= 25) AS n_active_authors,
       (SELECT count(*) FROM subreddits) AS n_subreddits,
       (SELECT count(*) FROM subreddits WHERE count >= 30) AS n_active_subreddits""")
def q_activity_summary(spark, sf_dir):
    fs, fc = _filtered(spark, sf_dir)
    return corpus.activity_summary(fs, fc, 25, 30)


@register("activity_extremes", f"""{SQL_COUNTS},
active AS (SELECT * FROM subreddits WHERE count >= 30)
SELECT * FROM (SELECT subreddit, count, 'most' AS "end" FROM active ORDER BY count DESC, subreddit ASC LIMIT 5)
UNION ALL
SELECT * FROM (SELECT subreddit, count, 'least' AS "end" FROM active ORDER BY count ASC, subreddit DESC LIMIT 5)""")
def q_activity_extremes(spark, sf_dir):
    fs, fc = _filtered(spark, sf_dir)
    active = corpus.at_least(corpus.activity_counts(fs, fc, "subreddit"), 30)
    return corpus.activity_extremes(active, "subreddit", 5)


@register("shard_by_day", f"""WITH ev AS ({B.SQL_EVENTS})
SELECT event_id, created_utc,
       CAST(day(DATE '1970-01-01' + CAST(floor(created_utc / 86400) AS INTEGER)) AS INTEGER) AS day FROM ev""")
def q_shard_by_day(spark, sf_dir):
    ev = B.events_with_epoch(spark, sf_dir).select("event_id", "created_utc")
    path = scratch_path(spark, "day-shards")
    writers.write_day_shards(corpus.with_utc_day(ev), path)
    return spark.read.schema("event_id BIGINT, created_utc BIGINT, day INT").json(path)


# ------------------------------------------------------------------ community graph

from penprint.operators import graph  # noqa: E402

SQL_DIRECTED = f"""
all_stats AS ({B.SQL_GRAPH_STATS}),
active AS (SELECT subreddit, count(*) AS count FROM all_stats GROUP BY subreddit),
chosen AS (SELECT author FROM all_stats GROUP BY author HAVING count(*) FILTER (WHERE num_characters >= 10) >= 2),
stats AS (SELECT * FROM all_stats WHERE subreddit IN (SELECT subreddit FROM active WHERE count > 2)
          AND author IN (SELECT author FROM chosen)),
e AS (SELECT a.subreddit AS subreddit_i, b.subreddit AS subreddit_j, count(*) AS shared_authors,
             CASE WHEN count(*) = 1 THEN min(a.author) END AS sole_author
      FROM stats a JOIN stats b ON a.author = b.author AND a.subreddit <> b.subreddit GROUP BY 1, 2)"""


def _edges(spark, sf_dir, min_degree=1):
    return _graph(B.graph_stats(spark, sf_dir), min_degree)


def _graph(stats, min_degree=1):
    """P6 (communities with more than 2 authors) and P7 (authors with 10 characters in two of them), then J4."""
    stats = stored(stats, "graph-stats")
    active = stats.groupBy("subreddit").agg(F.count(F.lit(1)).alias("count"))
    chosen = corpus.prolific_authors(stats, 10, 2)
    return graph.subreddit_adjacency(graph.graph_incidence(stats, active, 2, chosen), min_degree)


SQL_FILE_STATS = """SELECT CAST(author AS VARCHAR) AS author, CAST(subreddit AS VARCHAR) AS subreddit, num_characters
  FROM (""" + B.SQL_GRAPH_STATS + ")"


@register("subreddit_adjacency", f"""WITH {SQL_DIRECTED.replace(B.SQL_GRAPH_STATS, SQL_FILE_STATS)},
sole AS (SELECT e.*, a.num_characters AS chars_i, b.num_characters AS chars_j FROM e
         LEFT JOIN stats a ON a.author = e.sole_author AND a.subreddit = e.subreddit_i
         LEFT JOIN stats b ON b.author = e.sole_author AND b.subreddit = e.subreddit_j)
SELECT subreddit_i AS subreddit_a, subreddit_j AS subreddit_b, shared_authors, sole_author,
       CAST(chars_i AS DOUBLE) AS sole_chars_a, CAST(chars_j AS DOUBLE) AS sole_chars_b
FROM sole WHERE subreddit_i < subreddit_j""")
def q_subreddit_adjacency(spark, sf_dir):
    """S6 + J4: the graph from a statistics file in which every key has an older, larger line before its last one."""
    path = scratch_path(spark, "stats-file")
    stats = stored(B.file_stats(spark, sf_dir), "stats")
    writers.write_ndjson(stats.withColumn("num_characters", F.col("num_characters") + 1000), f"{path}/1", compression="gzip")
    writers.write_ndjson(stats, f"{path}/2", compression="gzip")
    return _graph(readers.read_author_subreddit_stats(spark, f"{path}/*"))


@register("subreddit_adjacency_summary", f"""WITH {SQL_DIRECTED}
SELECT shared_authors, count(*) AS n_pairs FROM e WHERE subreddit_i < subreddit_j GROUP BY 1""")
def q_subreddit_adjacency_summary(spark, sf_dir):
    return graph.adjacency_histogram(_edges(spark, sf_dir))


SQL_SUITABLE = f"""WITH {SQL_DIRECTED},
rowmax AS (SELECT subreddit_i, max(shared_authors) AS mx FROM e GROUP BY 1),
cand AS (SELECT e.subreddit_i, e.subreddit_j, e.sole_author AS author FROM e JOIN rowmax USING (subreddit_i)
         WHERE rowmax.mx >= 3 AND e.shared_authors = 1),
ok AS (SELECT c.* FROM cand c
       JOIN stats s1 ON s1.author = c.author AND s1.subreddit = c.subreddit_i
       JOIN stats s2 ON s2.author = c.author AND s2.subreddit = c.subreddit_j
       WHERE s1.num_characters >= 30 AND s2.num_characters >= 30),
suitable AS (SELECT author, subreddit_i AS subreddit_0, subreddit_j AS subreddit_1 FROM (
  SELECT *, row_number() OVER (PARTITION BY author ORDER BY subreddit_i, subreddit_j) AS rn FROM ok) WHERE rn = 1)"""


def _suitable(spark, sf_dir):
    return graph.suitable_authors(_edges(spark, sf_dir, 3), min_max_neighbours=3, min_chars=30)


@register("suitable_authors", f"{SQL_SUITABLE} SELECT * FROM suitable")
def q_suitable_authors(spark, sf_dir):
    return _suitable(spark, sf_dir)


# ------------------------------------------------------------------ personas

from penprint.operators import personas as P  # noqa: E402


def sql_sha256_mod_100(expr: str) -> str:
    acc = "0"
    for i in range(8):
        acc = f"(({acc}) * 96 + ('0x' || substr(sha256({expr}), {1 + 8 * i}, 8))::BIGINT) % 100"
    return acc


def _author_docs(spark, sf_dir):
    docs = B.persona_documents(spark, sf_dir)
    flat = P.attach_documents(B.conv_personas(docs), B.conv_submissions(docs), B.conv_comments(docs))
    return docs, flat


@register("author_docs", f"WITH {B.SQL_AUTHOR_DOCS} SELECT * FROM flat")
def q_author_docs(spark, sf_dir):
    return _author_docs(spark, sf_dir)[1]


SQL_POSITIONS = f"""WITH {B.SQL_AUTHOR_DOCS}
SELECT author, slot, subreddit, kind,
       row_number() OVER (PARTITION BY author, slot, kind ORDER BY ordinal) - 1 AS position,
       title, selftext, url, body, permalink
FROM flat WHERE kind IS NOT NULL"""


@register("author_docs_roundtrip", SQL_POSITIONS)
def q_author_docs_roundtrip(spark, sf_dir):
    """K7 + S7 with records of at most 2,000 bytes of text, so that authors have several."""
    path = scratch_path(spark, "author-docs")
    writers.write_ndjson(P.nest_author_docs(_author_docs(spark, sf_dir)[1], 2000), path)
    return P.flatten_author_docs(readers.read_author_infos(spark, path))


@register("author_docs_from_files", SQL_POSITIONS)
def q_author_docs_from_files(spark, sf_dir):
    """J6 + J7 over several files of posts and comments: documents come in file order, written and read back nested."""
    docs = B.persona_documents(spark, sf_dir)
    paths = [scratch_path(spark, n) for n in ("posts", "comments", "nested")]
    B.write_in_order(B.conv_submissions(docs), paths[0], "ordinal", 5)
    B.write_in_order(B.conv_comments(docs), paths[1], "ordinal", 5)
    posts = readers.read_submissions(spark, paths[0], file_order="ordinal")
    notes = readers.read_comments(spark, paths[1], file_order="ordinal")
    flat = P.attach_documents(B.conv_personas(docs), posts, notes)
    writers.write_ndjson(P.nest_author_docs(flat), paths[2])
    return P.flatten_author_docs(readers.read_author_infos(spark, paths[2]))


SQL_ARMS = f"""WITH {B.SQL_AUTHOR_DOCS},
armed AS (SELECT *, CASE WHEN {sql_sha256_mod_100('author')} < 70 THEN 'train'
                         WHEN {sql_sha256_mod_100('author')} < 85 THEN 'val' ELSE 'test' END AS arm FROM flat)"""


def _arms(spark, sf_dir, arms):
    path = scratch_path(spark, "arms")
    writers.write_arms(P.with_arm(_author_docs(spark, sf_dir)[1], "author"), path)
    return readers.read_arms(spark, path, arms)


@register("split_arms", f"{SQL_ARMS} SELECT DISTINCT author AS username, arm FROM armed")
def q_split_arms(spark, sf_dir):
    return _arms(spark, sf_dir, ("train", "val", "test")).select(F.col("author").alias("username"), "arm").distinct()


@register("train_val_documents", f"{SQL_ARMS} SELECT arm, author, slot, kind, ordinal, title, body FROM armed WHERE arm <> 'test'")
def q_train_val_documents(spark, sf_dir):
    """The loader of the train and val arms (partition pruning)."""
    return _arms(spark, sf_dir, ("train", "val")).select("arm", "author", "slot", "kind", "ordinal", "title", "body")


@register("selected_author_documents", f"""WITH {SQL_STATS},
chosen AS (SELECT author, min(subreddit) AS subreddit_0, max(subreddit) AS subreddit_1 FROM stats
           WHERE author IN (SELECT author FROM prolific) AND num_characters >= 10000 GROUP BY author),
pers AS (SELECT author, 0 AS slot, subreddit_0 AS subreddit FROM chosen
         UNION ALL SELECT author, 1, subreddit_1 FROM chosen),
d AS (SELECT author, subreddit, 'submission' AS kind, CAST(id AS BIGINT) AS ordinal, title, body FROM
        (SELECT author, subreddit, id, title, CAST(NULL AS VARCHAR) AS body FROM fsubs)
      UNION ALL SELECT author, subreddit, 'comment', CAST(id AS BIGINT), NULL, body FROM fcoms)
SELECT p.author, p.slot, p.subreddit, d.kind, d.ordinal, d.title, d.body FROM pers p LEFT JOIN d USING (author, subreddit)""")
def q_selected_author_documents(spark, sf_dir):
    """From a selection of one community pair per author to their documents."""
    fs, fc, stats, prolific = _stats(spark, sf_dir)
    rich = corpus.of_authors(stats.where(F.col("num_characters") >= 10000), prolific)
    chosen = rich.groupBy("author").agg(F.min("subreddit").alias("subreddit_0"), F.max("subreddit").alias("subreddit_1"))
    number = F.col("id").cast("bigint")
    flat = P.attach_documents(P.personas_from_selection(chosen), fs.withColumn("ordinal", number),
                              fc.withColumn("ordinal", number))
    return flat.select("author", "slot", "subreddit", "kind", "ordinal", "title", "body")


@register("persona_texts", f"""WITH {B.SQL_AUTHOR_DOCS}
SELECT author, slot, subreddit, CASE WHEN kind = 'submission' THEN 0 ELSE 1 END AS doc_order, ordinal,
       CASE WHEN kind = 'submission'
            THEN coalesce(title, '') || CASE WHEN coalesce(selftext, '') <> '' THEN chr(10) || chr(10) || selftext ELSE '' END
            ELSE body END AS text
FROM flat WHERE kind IS NOT NULL""")
def q_persona_texts(spark, sf_dir):
    return P.persona_texts(_author_docs(spark, sf_dir)[1])


SQL_SEGMENT_COUNTS = f"""{B.SQL_AUTHOR_DOCS},
segs AS (SELECT author, slot, title AS text FROM flat WHERE kind = 'submission'
         UNION ALL SELECT author, slot, selftext FROM flat WHERE kind = 'submission'
         UNION ALL SELECT author, slot, body FROM flat WHERE kind = 'comment'),
stoks AS (SELECT author, slot, unnest({sql_tokens("coalesce(text, '')")}) AS token FROM segs),
pcounts AS (SELECT author, slot, token, count(*) AS n FROM stoks GROUP BY ALL)"""


def _segment_counts(spark, sf_dir):
    flat = _author_docs(spark, sf_dir)[1]
    # Tokenize once: every later step of the token model reads this table.
    return flat, cut_lineage(tok.token_counts(P.persona_segments(flat), ["author", "slot"]))


@register("persona_token_counts", f"WITH {SQL_SEGMENT_COUNTS} SELECT * FROM pcounts")
def q_persona_token_counts(spark, sf_dir):
    return _segment_counts(spark, sf_dir)[1]


@register("vocabulary_token_counts", f"""WITH {B.SQL_AUTHOR_DOCS},
segs AS (SELECT author, slot, title AS text FROM flat WHERE kind = 'submission'
         UNION ALL SELECT author, slot, selftext FROM flat WHERE kind = 'submission'
         UNION ALL SELECT author, slot, body FROM flat WHERE kind = 'comment'),
ids AS (SELECT author, slot, unnest(list_transform(string_split(lower(coalesce(text, '')), ' '), lambda t: {{}})) AS token_id FROM segs)
SELECT author, slot, token_id, v.token, count(*) AS n FROM ids LEFT JOIN ({B.SQL_VOCABULARY}) v USING (token_id)
GROUP BY ALL""".replace("{}", B.SQL_WORD_ID))
def q_vocabulary_token_counts(spark, sf_dir):
    """E4 + F12: texts through a tokenizer that gives ids, counted, and the ids turned back into text by a vocabulary."""
    segments = P.persona_segments(_author_docs(spark, sf_dir)[1])
    counts = tok.token_counts(segments, ["author", "slot"], tokenizer=B.word_ids).withColumnRenamed("token", "token_id")
    return tok.with_token_text(counts, B.vocabulary(spark, sf_dir)).select("author", "slot", "token_id", "token", "n")


@register("author_token_counts", f"WITH {SQL_SEGMENT_COUNTS} SELECT author, token, sum(n) AS n FROM pcounts GROUP BY ALL")
def q_author_token_counts(spark, sf_dir):
    return tok.roll_up(_segment_counts(spark, sf_dir)[1], ["author"])


@register("persona_docs", f"WITH docs AS ({B.SQL_PERSONA_DOCS}) SELECT entity, persona, CAST(row_number() OVER (PARTITION BY entity, persona ORDER BY ordinal) - 1 AS INTEGER) AS position, text FROM docs")
def q_persona_docs(spark, sf_dir):
    """S9 + A8 over several Parquet files: texts stand in file order."""
    path = scratch_path(spark, "persona-docs")
    B.write_in_order(B.persona_documents(spark, sf_dir), path, "ordinal", 7, form="parquet")
    grouped = P.group_documents(readers.read_documents(spark, path))
    return grouped.select("entity", "persona", F.posexplode("texts").alias("position", "text"))


# ------------------------------------------------------------------ token model

from penprint.operators import evaluate as ev  # noqa: E402
from penprint.operators import indexing as IX  # noqa: E402

SQL_CANDIDATES = f"""{SQL_SEGMENT_COUNTS},
per_author AS (SELECT author, token, sum(n) AS n FROM pcounts GROUP BY ALL),
freq AS (SELECT token, sum(n) AS n, count(*) AS n_authors FROM per_author GROUP BY token HAVING count(*) >= 20),
cand AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token ASC) - 1 AS INTEGER) AS rank
         FROM freq ORDER BY n DESC, token ASC LIMIT 1000),
two AS (SELECT author FROM flat GROUP BY author HAVING count(DISTINCT slot) = 2),
authors AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS idx FROM two),
pairs AS (SELECT author AS author_a, author AS author_b, 1 AS label FROM authors
          UNION ALL
          SELECT a.author, b.author, 0 FROM authors a JOIN authors b ON b.idx BETWEEN a.idx + 1 AND a.idx + 4),
ptot AS (SELECT label, count(*) AS n FROM pairs GROUP BY label),
n1 AS (SELECT n FROM ptot WHERE label = 1), n0 AS (SELECT n FROM ptot WHERE label = 0),
grid AS (SELECT CAST(g AS INTEGER) AS g, CAST(g AS DOUBLE) * CAST(-0.05 AS DOUBLE) AS cutoff FROM range(400) t(g))"""


def _candidates(spark, sf_dir):
    flat, counts = _segment_counts(spark, sf_dir)
    return flat, counts, cut_lineage(tok.token_frequencies(counts, ["author"], top_k=1000, min_authors=20))


def _evaluation_pairs(flat):
    return ev.evaluation_pairs(B.two_sided(flat, "author", "slot"))


@register("token_frequencies", f"WITH {SQL_CANDIDATES} SELECT rank, token, n FROM cand")
def q_token_frequencies(spark, sf_dir):
    path = scratch_path(spark, "token-counts")
    writers.write_token_counts(_candidates(spark, sf_dir)[2], path)
    return readers.read_token_counts(spark, path)


@register("likelihood_mismatched", f"WITH {SQL_CANDIDATES} SELECT author_a, author_b FROM pairs WHERE label = 0")
def q_likelihood_mismatched(spark, sf_dir):
    authors = B.two_sided(_author_docs(spark, sf_dir)[1], "author", "slot")
    return ev.mismatched_pairs(authors).select("author_a", "author_b")


@register("author_at_index", f"WITH {SQL_CANDIDATES} SELECT author, idx FROM authors WHERE idx = 7")
def q_author_at_index(spark, sf_dir):
    authors = B.two_sided(_author_docs(spark, sf_dir)[1], "author", "slot")
    return IX.at_index(IX.with_dense_index(authors, ["author"]), 7)


SQL_TOKEN_ACCURACY = f"""{SQL_CANDIDATES},
mtot AS (SELECT author, sum(n) AS total FROM pcounts WHERE slot = 0 GROUP BY author),
rows_ AS (SELECT p.label, o.token,
                 round(log2((coalesce(m.n, 0) + 0.5) / (coalesce(t.total, 0) + 1.0)), 9) AS s
          FROM pairs p JOIN pcounts o ON o.author = p.author_b AND o.slot = 1
          JOIN cand c ON c.token = o.token
          LEFT JOIN pcounts m ON m.author = p.author_a AND m.slot = 0 AND m.token = o.token
          LEFT JOIN mtot t ON t.author = p.author_a),
present AS (SELECT token, count(*) FILTER (WHERE label = 1) AS p1, count(*) FILTER (WHERE label = 0) AS p0
            FROM rows_ GROUP BY token),
pass AS (SELECT r.token, g.g, count(*) FILTER (WHERE r.label = 1) AS c1, count(*) FILTER (WHERE r.label = 0) AS c0
         FROM rows_ r JOIN grid g ON r.s >= g.cutoff GROUP BY ALL),
tails AS (SELECT c.token, g.g, g.cutoff,
                 coalesce(pass.c1, 0) + (SELECT n FROM n1) - coalesce(present.p1, 0) AS n1_pass,
                 coalesce(pass.c0, 0) + (SELECT n FROM n0) - coalesce(present.p0, 0) AS n0_pass
          FROM cand c CROSS JOIN grid g
          LEFT JOIN pass ON pass.token = c.token AND pass.g = g.g
          LEFT JOIN present ON present.token = c.token),
best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY
           abs(n1_pass * (SELECT n FROM n0) - n0_pass * (SELECT n FROM n1)) DESC, g ASC) AS rn FROM tails)
  WHERE rn = 1),
acc AS (SELECT token, g AS grid_index, cutoff,
               0.5 * (n1_pass / (SELECT n FROM n1) + 1 - n0_pass / (SELECT n FROM n0)) AS accuracy FROM best)"""


def _token_accuracy(spark, sf_dir):
    flat, counts, cand = _candidates(spark, sf_dir)
    pairs = cut_lineage(_evaluation_pairs(flat))
    return flat, counts, cand, pairs, ev.token_accuracies(counts, cand, pairs)


@register("token_accuracy", f"WITH {SQL_TOKEN_ACCURACY} SELECT token, grid_index, round(cutoff, 6) AS cutoff, round(accuracy, 6) AS accuracy FROM acc")
def q_token_accuracy(spark, sf_dir):
    return rounded(_token_accuracy(spark, sf_dir)[4])


SQL_TOPN = f"""{SQL_TOKEN_ACCURACY},
topn AS (SELECT CAST(row_number() OVER (ORDER BY a.accuracy DESC, c.rank ASC) - 1 AS INTEGER) AS rank,
                a.accuracy, a.token, c.rank AS token_index
         FROM acc a JOIN cand c USING (token) ORDER BY a.accuracy DESC, c.rank ASC LIMIT 40)"""


@register("token_accuracy_topn", f"WITH {SQL_TOPN} SELECT rank, round(accuracy, 6) AS accuracy, token FROM topn")
def q_token_accuracy_topn(spark, sf_dir):
    _, _, cand, _, acc = _token_accuracy(spark, sf_dir)
    path = scratch_path(spark, "token-accuracies")
    writers.write_token_accuracies(ev.rank_by_accuracy(acc, cand, 40), path)
    return rounded(readers.read_token_accuracies(spark, path))


@register("model_roundtrip", f"WITH {SQL_TOPN} SELECT rank, token_index, token FROM topn")
def q_model_roundtrip(spark, sf_dir):
    _, _, cand, _, acc = _token_accuracy(spark, sf_dir)
    path = scratch_path(spark, "model")
    writers.write_log_likelihood_model(ev.rank_by_accuracy(acc, cand, 40), path)
    kind, tokens = readers.read_model(spark, path)
    assert kind == "LOG_LIKELIHOOD_MODEL"
    return tokens.select(F.col("rank").cast("int").alias("rank"), F.col("token_index").cast("int").alias("token_index"),
                         "token")


SQL_SET_STATS = """,
pers AS (SELECT DISTINCT author, slot FROM flat),
ptotal AS (SELECT author, slot, sum(n) AS n_total FROM pcounts GROUP BY ALL),
kk AS (SELECT count(*) AS k FROM tset),
tgrid AS (SELECT p.author, p.slot, t.token, t.rank, coalesce(c.n, 0) AS n
          FROM pers p CROSS JOIN tset t
          LEFT JOIN pcounts c ON c.author = p.author AND c.slot = p.slot AND c.token = t.token),
vec AS (SELECT author, slot, string_agg(CAST(n AS VARCHAR), ',' ORDER BY rank) AS counts, sum(n) AS n_in_set
        FROM tgrid GROUP BY ALL),
tot AS (SELECT v.author, v.slot, coalesce(pt.n_total, 0) AS n_total, v.n_in_set,
               coalesce(pt.n_total, 0) - v.n_in_set AS n_excluded, v.counts
        FROM vec v LEFT JOIN ptotal pt USING (author, slot)),
freq_long AS (SELECT g.author, g.slot, g.rank, g.token, g.n, t.n_in_set, t.n_excluded,
                     CASE WHEN t.n_in_set = 0 THEN CAST(g.n AS DOUBLE) ELSE g.n / t.n_in_set END AS freq,
                     CASE WHEN t.n_in_set + t.n_excluded = 0 THEN CAST(g.n AS DOUBLE)
                          ELSE g.n / (t.n_in_set + t.n_excluded) END AS freq_with_excluded,
                     log2(g.n + 0.5) - log2(t.n_in_set + 0.5 * (SELECT k FROM kk)) AS log_freq,
                     log2(g.n + 0.5) - log2(t.n_in_set + 0.5 * (SELECT k FROM kk) + t.n_excluded + 0.5)
                       AS log_freq_with_excluded
              FROM tgrid g JOIN tot t USING (author, slot))"""


# Statistics over the 40 most frequent tokens, and over the 40 most accurate ones (the learners' set).
SQL_TSET_STATS = f"{SQL_CANDIDATES}, tset AS (SELECT token, rank FROM cand WHERE rank < 40){SQL_SET_STATS}"
SQL_BEST_STATS = f"{SQL_TOPN}, tset AS (SELECT token, rank FROM topn){SQL_SET_STATS}"


def _tset_stats(spark, sf_dir):
    flat, counts, cand = _candidates(spark, sf_dir)
    tset, k = tok.token_set(cand.where(F.col("rank") < 40))
    return flat, counts, tset, k, flat.select("author", "slot").distinct()


def _best_stats(spark, sf_dir):
    flat, counts, cand, _, acc = _token_accuracy(spark, sf_dir)
    tset, k = tok.token_set(cut_lineage(ev.rank_by_accuracy(acc, cand, 40)))
    return flat, counts, tset, k, flat.select("author", "slot").distinct()


@register("persona_token_vectors", f"WITH {SQL_TSET_STATS} SELECT * FROM tot")
def q_persona_token_vectors(spark, sf_dir):
    _, counts, tset, k, personas = _tset_stats(spark, sf_dir)
    vec = tok.persona_vectors(counts, tset, k, ["author", "slot"], personas)
    return vec.select("author", "slot", "n_total", "n_in_set", "n_excluded",
                      F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


@register("persona_token_totals", f"WITH {SQL_TSET_STATS} SELECT author, slot, n_total, n_in_set, n_excluded FROM tot WHERE n_total > 0")
def q_persona_token_totals(spark, sf_dir):
    _, counts, tset, _, _ = _tset_stats(spark, sf_dir)
    return tok.persona_totals(counts, tset, ["author", "slot"])


def _freq(spark, sf_dir):
    _, counts, tset, k, personas = _tset_stats(spark, sf_dir)
    return tok.persona_token_freq(counts, tset, k, ["author", "slot"], personas), k


@register("persona_token_freq", f"""WITH {SQL_TSET_STATS}
SELECT author, slot, rank, token, n, n_in_set, n_excluded, round(freq, 6) AS freq,
       round(freq_with_excluded, 6) AS freq_with_excluded FROM freq_long""")
def q_persona_token_freq(spark, sf_dir):
    return rounded(_freq(spark, sf_dir)[0])


@register("persona_log_freq", f"""WITH {SQL_TSET_STATS}
SELECT author, slot, rank, token, round(log_freq, 6) AS log_freq,
       round(log_freq_with_excluded, 6) AS log_freq_with_excluded FROM freq_long""")
def q_persona_log_freq(spark, sf_dir):
    f, k = _freq(spark, sf_dir)
    return rounded(tok.persona_log_freq(f, k).select("author", "slot", "rank", "token", "log_freq",
                                                     "log_freq_with_excluded"))


@register("token_wilson_ci", f"""WITH {SQL_TSET_STATS},
w AS (SELECT *, 1.0 / (1.0 + 1.96 * 1.96 / n_in_set) AS sc FROM freq_long WHERE n_in_set > 0)
SELECT author, slot, rank, token,
  round(least(greatest(sc * (freq + 1.96 * 1.96 / 2.0 / n_in_set)
        - sc * 1.96 / (2.0 * n_in_set) * sqrt(4.0 * n_in_set * freq * (1.0 - freq) + 1.96 * 1.96), 0.0), 1.0), 6) AS lower_ci,
  round(least(greatest(sc * (freq + 1.96 * 1.96 / 2.0 / n_in_set)
        + sc * 1.96 / (2.0 * n_in_set) * sqrt(4.0 * n_in_set * freq * (1.0 - freq) + 1.96 * 1.96), 0.0), 1.0), 6) AS upper_ci
FROM w WHERE rank < 20""")
def q_token_wilson_ci(spark, sf_dir):
    f, _ = _freq(spark, sf_dir)
    ci = tok.token_wilson_ci(tok.first_k_tokens_of_ranking(f, 0, 20))
    return rounded(ci.where(F.col("n_in_set") > 0).select("author", "slot", "rank", "token", "lower_ci", "upper_ci"))


@register("authors_enough_tokens", f"""WITH {SQL_TSET_STATS}
SELECT author FROM tot WHERE slot IN (0, 1) AND n_in_set > 50 GROUP BY author HAVING count(*) = 2""")
def q_authors_enough_tokens(spark, sf_dir):
    _, counts, tset, _, _ = _tset_stats(spark, sf_dir)
    return tok.authors_with_enough_tokens(counts, tset, "author", "slot", 50)


@register("likelihood_best_cutoff", f"""WITH {SQL_TOPN},
mt AS (SELECT token, rank FROM topn),
km AS (SELECT count(*) AS k FROM mt),
mtot2 AS (SELECT author, sum(n) AS total FROM pcounts WHERE slot = 0 GROUP BY author),
inset AS (SELECT c.author, c.slot, c.token, c.n FROM pcounts c JOIN mt USING (token)),
obs AS (SELECT p.author_a, p.author_b, p.label, sum(o.n * log2(coalesce(m.n, 0) + 0.5)) AS w, sum(o.n) AS n_obs
        FROM pairs p JOIN inset o ON o.author = p.author_b AND o.slot = 1
        LEFT JOIN inset m ON m.author = p.author_a AND m.slot = 0 AND m.token = o.token GROUP BY ALL),
scores AS (SELECT p.label, round(CASE WHEN obs.n_obs IS NULL THEN 0.0
                  ELSE obs.w / obs.n_obs - log2(coalesce(t.total, 0) + ((SELECT k FROM km) + 1) / 2.0) END, 9) AS s
           FROM pairs p LEFT JOIN obs USING (author_a, author_b, label) LEFT JOIN mtot2 t ON t.author = p.author_a),
tl AS (SELECT g.g, g.cutoff, count(*) FILTER (WHERE s.label = 1 AND s.s >= g.cutoff) AS n1_pass,
              count(*) FILTER (WHERE s.label = 0 AND s.s >= g.cutoff) AS n0_pass
       FROM grid g CROSS JOIN scores s GROUP BY ALL)
SELECT g AS grid_index, round(cutoff, 6) AS cutoff,
       round(0.5 * (n1_pass / (SELECT n FROM n1) + 1 - n0_pass / (SELECT n FROM n0)), 6) AS accuracy
FROM tl ORDER BY abs(n1_pass * (SELECT n FROM n0) - n0_pass * (SELECT n FROM n1)) DESC, g ASC LIMIT 1""")
def q_likelihood_best_cutoff(spark, sf_dir):
    flat, counts, cand, pairs, acc = _token_accuracy(spark, sf_dir)
    tset, k = tok.token_set(cut_lineage(ev.rank_by_accuracy(acc, cand, 40).select("token", "rank")))
    sides = pairs.select("label", F.col("author_a").alias("author1"), F.lit(0).alias("slot1"),
                         F.col("author_b").alias("author2"), F.lit(1).alias("slot2"))
    personas = flat.select("author", "slot").distinct()
    scores = scoring.pair_log_likelihood(sides, ["author1", "slot1"], ["author2", "slot2"], personas, counts, tset, k,
                                         ["author", "slot"])
    return rounded(ev.best_cutoff_log_grid(scores.select("label", "score")))


@register("likelihood_cutoff_by_arm", f"""WITH {SQL_TOPN},
armed AS (SELECT *, CASE WHEN {sql_sha256_mod_100('author_a')} < 70 THEN 'train'
                         WHEN {sql_sha256_mod_100('author_a')} < 85 THEN 'val' ELSE 'test' END AS arm FROM pairs),
best_token AS (SELECT token FROM topn WHERE rank = 0),
mtot2 AS (SELECT author, sum(n) AS total FROM pcounts WHERE slot = 0 GROUP BY author),
sc AS (SELECT p.arm, p.label, round(CASE WHEN o.n IS NULL THEN 0.0
              ELSE log2(coalesce(m.n, 0) + 0.5) - log2(coalesce(t.total, 0) + 1.0) END, 9) AS s
       FROM armed p CROSS JOIN best_token b
       LEFT JOIN pcounts o ON o.author = p.author_b AND o.slot = 1 AND o.token = b.token
       LEFT JOIN pcounts m ON m.author = p.author_a AND m.slot = 0 AND m.token = b.token
       LEFT JOIN mtot2 t ON t.author = p.author_a),
tl AS (SELECT sc.arm, g.g, g.cutoff, count(*) FILTER (WHERE label = 1 AND s >= cutoff) AS p1,
              count(*) FILTER (WHERE label = 0 AND s >= cutoff) AS p0, count(*) FILTER (WHERE label = 1) AS k1,
              count(*) FILTER (WHERE label = 0) AS k0 FROM sc CROSS JOIN grid g GROUP BY ALL)
SELECT arm, g AS grid_index, round(cutoff, 6) AS cutoff,
       round(0.5 * (CAST(p1 AS DOUBLE) / nullif(k1, 0) + 1 - CAST(p0 AS DOUBLE) / nullif(k0, 0)), 6) AS accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY abs(p1 * k0 - p0 * k1) DESC, g) AS rn FROM tl) WHERE rn = 1""")
def q_likelihood_cutoff_by_arm(spark, sf_dir):
    """A23 per key: the best cutoff of the most accurate token within the arm of the model persona's author."""
    flat, counts, cand, pairs, acc = _token_accuracy(spark, sf_dir)
    tset, k = tok.token_set(cut_lineage(ev.rank_by_accuracy(acc, cand, 1).select("token", "rank")))
    sides = P.with_arm(pairs, "author_a").select("arm", "label", F.col("author_a").alias("author1"), F.lit(0).alias("slot1"),
                                                 F.col("author_b").alias("author2"), F.lit(1).alias("slot2"))
    scores = scoring.pair_log_likelihood(sides, ["author1", "slot1"], ["author2", "slot2"],
                                         flat.select("author", "slot").distinct(), counts, tset, k, ["author", "slot"])
    return rounded(ev.best_cutoff_log_grid(scores.select("arm", "label", "score"), keys=["arm"]))


# ------------------------------------------------------------------ vectors

import numpy as np  # noqa: E402

from penprint.operators import similarity as SIM  # noqa: E402
from penprint.operators import vectors as V  # noqa: E402

SQL_VECS = f"vecs AS ({B.SQL_PERSONA_VECTORS})"


@register("persona_mean_embedding", """
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value
FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)
GROUP BY ALL""")
def q_persona_mean_embedding(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    return rounded(V.mean_embedding(e, ["label"]).select("label", F.col("pos").cast("int").alias("pos"), "value"))


def sql_md5_bucket(expr: str, dim: int) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT % {dim})"


SQL_DOC_EMBED = f"""{B.SQL_AUTHOR_DOCS},
texts AS (SELECT author, slot, CASE WHEN kind = 'submission' THEN 0 ELSE 1 END AS doc_order, ordinal,
                 CASE WHEN kind = 'submission'
                      THEN coalesce(title, '') || CASE WHEN coalesce(selftext, '') <> ''
                                                       THEN chr(10) || chr(10) || selftext ELSE '' END
                      ELSE body END AS text
          FROM flat WHERE kind IS NOT NULL),
ttoks AS (SELECT author, slot, doc_order, ordinal, unnest({sql_tokens("coalesce(text, '')")}) AS token FROM texts),
tb AS (SELECT author, slot, doc_order, ordinal, CAST({sql_md5_bucket('token', 64)} AS INTEGER) AS pos, count(*) AS c
       FROM ttoks GROUP BY ALL),
tn AS (SELECT author, slot, doc_order, ordinal, sqrt(sum(c * c)) AS norm FROM tb GROUP BY ALL),
sparse AS (SELECT tb.author, tb.slot, tb.doc_order, tb.ordinal, tb.pos, tb.c / tn.norm AS value
           FROM tb JOIN tn USING (author, slot, doc_order, ordinal))"""


def _doc_texts(spark, sf_dir):
    return P.persona_texts(_author_docs(spark, sf_dir)[1])


@register("embed_texts", f"WITH {SQL_DOC_EMBED} SELECT author, slot, doc_order, ordinal, pos, round(value, 6) AS value FROM sparse")
def q_embed_texts(spark, sf_dir):
    keys = ["author", "slot", "doc_order", "ordinal"]
    vecs = V.embed_texts(_doc_texts(spark, sf_dir), keys, "text", "hashing", 64)
    long = vecs.select(*keys, F.posexplode("embedding").alias("pos", "value"))
    return rounded(long.where(F.col("value") != 0))


# A registered model of the tests: 96 numbers, the counts of a text's code points modulo 96, divided by its length.
V.register_embedder(B.WIDE_MODEL, B.build_wide_model, prefix="passage: ", batch_size=100)

SQL_WIDE = """
wt AS (SELECT {keys}, 'passage: ' || coalesce(text, '') AS text FROM {docs}),
wc AS (SELECT {keys}, length(text) AS size, unicode(unnest(string_split(text, ''))) % 96 AS pos FROM wt),
wv AS (SELECT {keys}, CAST(pos AS INTEGER) AS pos, CAST(count(*) / any_value(size) AS FLOAT) AS value FROM wc GROUP BY {keys}, pos)"""


@register("embed_texts_model", f"""WITH {B.SQL_AUTHOR_DOCS},
texts AS (SELECT author, slot, CASE WHEN kind = 'submission' THEN 0 ELSE 1 END AS doc_order, ordinal,
                 CASE WHEN kind = 'submission'
                      THEN coalesce(title, '') || CASE WHEN coalesce(selftext, '') <> ''
                                                       THEN chr(10) || chr(10) || selftext ELSE '' END
                      ELSE body END AS text
          FROM flat WHERE kind IS NOT NULL), {SQL_WIDE.format(keys='author, slot, doc_order, ordinal', docs='texts')}
SELECT author, slot, doc_order, ordinal, pos, round(CAST(value AS DOUBLE), 6) AS value FROM wv""")
def q_embed_texts_model(spark, sf_dir):
    """E1 + F3 with a registered model: built once per worker, given 100 texts at a time, 96 numbers wide."""
    keys = ["author", "slot", "doc_order", "ordinal"]
    vecs = V.embed_texts(_doc_texts(spark, sf_dir), keys, "text", B.WIDE_MODEL)
    return rounded(vecs.select(*keys, F.posexplode("embedding").alias("pos", "value")).where("value != 0"))


# Fixed projection used by the tests: Linear(64 -> 16) -> ReLU -> Linear(16 -> 8);
# weight[o][i] = ((7 o + 3 i) mod 11 - 5) / 10, bias[o] = (o mod 5 - 2) / 10.
def projection_layers():
    def layer(n_out, n_in):
        w = np.array([[((7 * o + 3 * i) % 11 - 5) / 10.0 for i in range(n_in)] for o in range(n_out)])
        b = np.array([((o % 5) - 2) / 10.0 for o in range(n_out)])
        return w, b
    return [layer(16, 64), layer(8, 16)]


SQL_INFER_EMBED = f"""
docs AS ({B.SQL_PERSONA_DOCS}),
dt AS (SELECT entity, persona, ordinal, unnest({sql_tokens("coalesce(text, '')")}) AS token FROM docs),
db AS (SELECT entity, persona, ordinal, {sql_md5_bucket('token', 64)} AS pos, count(*) AS c FROM dt GROUP BY ALL),
dn AS (SELECT entity, persona, ordinal, sqrt(sum(c * c)) AS norm FROM db GROUP BY ALL),
nd AS (SELECT entity, persona, count(*) AS n_docs FROM docs GROUP BY ALL),
pv AS (SELECT db.entity, db.persona, db.pos, sum(db.c / dn.norm) / any_value(nd.n_docs) AS v
       FROM db JOIN dn USING (entity, persona, ordinal) JOIN nd USING (entity, persona) GROUP BY ALL),
w1 AS (SELECT o, i, ((7 * o + 3 * i) % 11 - 5) / 10.0 AS w FROM range(16) a(o), range(64) b(i)),
w2 AS (SELECT o, i, ((7 * o + 3 * i) % 11 - 5) / 10.0 AS w FROM range(8) a(o), range(16) b(i)),
ha AS (SELECT nd.entity, nd.persona, r.o, coalesce(sum(pv.v * w1.w), 0.0) + ((r.o % 5) - 2) / 10.0 AS h
       FROM nd CROSS JOIN range(16) r(o) LEFT JOIN pv ON pv.entity = nd.entity AND pv.persona = nd.persona
       LEFT JOIN w1 ON w1.i = pv.pos AND w1.o = r.o GROUP BY nd.entity, nd.persona, r.o),
pr AS (SELECT ha.entity, ha.persona, w2.o AS pos, sum(greatest(ha.h, 0.0) * w2.w) + ((w2.o % 5) - 2) / 10.0 AS v
       FROM ha JOIN w2 ON w2.i = ha.o GROUP BY ha.entity, ha.persona, w2.o),
pn AS (SELECT entity, persona, sqrt(sum(v * v)) AS norm FROM pr GROUP BY ALL),
pairs AS ({B.SQL_INFERENCE_PAIRS}),
dots AS (SELECT p.entity1, p.persona1, p.entity2, p.persona2, sum(a.v * b.v) AS dot
         FROM pairs p JOIN pr a ON a.entity = p.entity1 AND a.persona = p.persona1
         JOIN pr b ON b.entity = p.entity2 AND b.persona = p.persona2 AND b.pos = a.pos GROUP BY ALL)"""


@register("infer_embedding", f"""WITH {SQL_INFER_EMBED}
SELECT p.entity1, p.persona1, p.entity2, p.persona2,
       round(CASE WHEN n1.norm = 0 OR n2.norm = 0 THEN NULL ELSE d.dot / (n1.norm * n2.norm) END, 6) AS match_score
FROM pairs p
JOIN dots d USING (entity1, persona1, entity2, persona2)
JOIN pn n1 ON n1.entity = p.entity1 AND n1.persona = p.persona1
JOIN pn n2 ON n2.entity = p.entity2 AND n2.persona = p.persona2""")
def q_infer_embedding(spark, sf_dir):
    """Cosine of projected persona means; the embeddings of even entities come from a precomputed table."""
    source = B.persona_documents(spark, sf_dir)
    docs = readers.validate_documents(source.select("entity", "persona", "text"))
    even = docs.where(F.col("entity").cast("bigint") % 2 == 0)
    cache = cut_lineage(scoring.embedding_personas(even, "hashing", 64))
    scores = scoring.run_inference("EMBEDDING_MODEL", docs, B.inference_pairs(source), embedder="hashing", dim=64,
                                   layers=projection_layers(), cache=cache)
    return rounded(scores.drop("pair_id"))


@register("infer_embedding_model", f"""WITH docs AS ({B.SQL_PERSONA_DOCS}), {SQL_WIDE.format(keys='entity, persona, ordinal', docs='docs')},
nd AS (SELECT entity, persona, count(*) AS n FROM docs GROUP BY ALL),
pv AS (SELECT wv.entity, wv.persona, wv.pos, sum(CAST(value AS DOUBLE)) / any_value(nd.n) AS v
       FROM wv JOIN nd USING (entity, persona) GROUP BY wv.entity, wv.persona, wv.pos),
pn AS (SELECT entity, persona, sqrt(sum(v * v)) AS norm FROM pv GROUP BY ALL),
pairs AS ({B.SQL_INFERENCE_PAIRS}),
dots AS (SELECT p.entity1, p.persona1, p.entity2, p.persona2, sum(a.v * b.v) AS dot
         FROM pairs p JOIN pv a ON a.entity = p.entity1 AND a.persona = p.persona1
         JOIN pv b ON b.entity = p.entity2 AND b.persona = p.persona2 AND b.pos = a.pos GROUP BY ALL)
SELECT d.entity1, d.persona1, d.entity2, d.persona2, round(d.dot / (n1.norm * n2.norm), 6) AS match_score
FROM dots d JOIN pn n1 ON n1.entity = d.entity1 AND n1.persona = d.persona1
JOIN pn n2 ON n2.entity = d.entity2 AND n2.persona = d.persona2""")
def q_infer_embedding_model(spark, sf_dir):
    """M9 + E2 with a model of 96 numbers: the width comes with the vectors."""
    source = B.persona_documents(spark, sf_dir)
    docs = readers.validate_documents(source.select("entity", "persona", "text"))
    scores = scoring.run_inference("EMBEDDING_MODEL", docs, B.inference_pairs(source), embedder=B.WIDE_MODEL)
    return rounded(scores.drop("pair_id"))


@register("project_embeddings", """
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings),
w1 AS (SELECT o, i, ((7 * o + 3 * i) % 11 - 5) / 10.0 AS w FROM range(16) a(o), range(64) b(i)),
h AS (SELECT x.vec_id, w1.o, greatest(sum(CAST(x.v AS DOUBLE) * w1.w) + ((w1.o % 5) - 2) / 10.0, 0.0) AS h
      FROM x JOIN w1 ON w1.i = x.i GROUP BY x.vec_id, w1.o),
w2 AS (SELECT o, i, ((7 * o + 3 * i) % 11 - 5) / 10.0 AS w FROM range(8) a(o), range(16) b(i))
SELECT h.vec_id, CAST(w2.o AS INTEGER) AS pos, round(sum(h.h * w2.w) + ((w2.o % 5) - 2) / 10.0, 6) AS value
FROM h JOIN w2 ON w2.i = h.o GROUP BY h.vec_id, w2.o""")
def q_project_embeddings(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = V.project(e, projection_layers(), "embedding", "projected")
    return rounded(out.select("vec_id", F.posexplode("projected").alias("pos", "value")))


@register("embedding_pairs", f"""WITH {SQL_VECS},
p AS (SELECT author, max(CASE WHEN slot = 0 THEN embedding END) AS e0, max(CASE WHEN slot = 1 THEN embedding END) AS e1
      FROM vecs GROUP BY author)
SELECT author, round(list_dot_product(CAST(e0 AS DOUBLE[]), CAST(e1 AS DOUBLE[])), 6) AS dot FROM p""")
def q_embedding_pairs(spark, sf_dir):
    from penprint.functions.columns import dot
    pairs = P.persona_pairs(B.persona_vectors(spark, sf_dir), "author", "slot", "embedding")
    return rounded(pairs.select("author", dot("embedding_0", "embedding_1").alias("dot")))


SQL_ALL_PAIRS = f"""{SQL_VECS},
cs AS (SELECT CASE WHEN a.author = b.author THEN 1 ELSE 0 END AS label,
              list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS value
       FROM vecs a JOIN vecs b ON (a.author, a.slot) < (b.author, b.slot))"""


@register("cosine_all_pairs", f"""WITH {SQL_ALL_PAIRS}
SELECT label, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min_value,
       round(max(value), 6) AS max_value FROM cs GROUP BY label""")
def q_cosine_all_pairs(spark, sf_dir):
    s = V.cosine_all_pairs(B.persona_vectors(spark, sf_dir))
    return rounded(s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                          F.min("value").alias("min_value"), F.max("value").alias("max_value")))


@register("similarity_summary", f"""WITH {SQL_ALL_PAIRS}
SELECT label, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
       round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM cs GROUP BY label""")
def q_similarity_summary(spark, sf_dir):
    return rounded(SIM.summary(B.persona_vectors(spark, sf_dir)))


@register("similarity_histogram", f"""WITH {SQL_ALL_PAIRS},
r AS (SELECT label, min(value) AS lo, max(value) AS hi, count(*) AS n FROM cs GROUP BY label),
b AS (SELECT cs.label, r.n, r.lo, r.hi,
             least(greatest(CAST(floor((cs.value - r.lo) * 20.0 / (r.hi - r.lo)) AS INTEGER) + 1, 1), 20) AS bin
      FROM cs JOIN r USING (label))
SELECT label, bin, count(*) AS count, round(count(*) / (any_value(n) * ((any_value(hi) - any_value(lo)) / 20)), 6) AS density
FROM b GROUP BY label, bin""")
def q_similarity_histogram(spark, sf_dir):
    return rounded(SIM.histogram(B.persona_vectors(spark, sf_dir), 20))


@register("similarity_report", f"""WITH {SQL_ALL_PAIRS},
r AS (SELECT label, min(value) AS lo, max(value) AS hi FROM cs GROUP BY label),
b AS (SELECT cs.label, least(greatest(CAST(floor((cs.value - r.lo) * 20.0 / (r.hi - r.lo)) AS INTEGER) + 1, 1), 20) AS bin
      FROM cs JOIN r USING (label))
SELECT 'mean' AS part, label, 0 AS cell, round(avg(value), 6) AS value FROM cs GROUP BY label
UNION ALL SELECT 'median', label, 0, round(median(value), 6) FROM cs GROUP BY label
UNION ALL SELECT 'bin', label, bin, CAST(count(*) AS DOUBLE) FROM b GROUP BY label, bin
UNION ALL SELECT 'above', label, 0, CAST(count(*) FILTER (WHERE value > 0.5) AS DOUBLE) FROM cs GROUP BY label
UNION ALL SELECT 'below', label, 0, CAST(count(*) FILTER (WHERE value < 0.5) AS DOUBLE) FROM cs GROUP BY label""")
def q_similarity_report(spark, sf_dir):
    """A19, A20 and A22 from one stream of blocks and, for what needs the range, a second one."""
    parts = SIM.report(B.persona_vectors(spark, sf_dir), 20, 5, 0.5, 0.3, 0.0, 5)
    summary, counts = parts["summary"], parts["threshold"]

    def rows(df, part, label, cell, value):
        return df.select(F.lit(part).alias("part"), label.cast("int").alias("label"), cell.cast("int").alias("cell"),
                         value.cast("double").alias("value"))

    out = rows(parts["histogram"], "bin", F.col("label"), F.col("bin"), F.col("count"))
    for part in ("mean", "median"):
        out = out.unionByName(rows(summary, part, F.col("label"), F.lit(0), F.col(part)))
    for side in ("above", "below"):
        for label, name in ((1, "match"), (0, "mismatch")):
            out = out.unionByName(rows(counts, side, F.lit(label), F.lit(0), F.col(f"n_{name}_{side}")))
    return rounded(out)


@register("similarity_best_cutoff", f"""WITH {SQL_ALL_PAIRS},
st AS (SELECT label, min(value) - 3 * stddev_pop(value) AS lo, max(value) + 3 * stddev_pop(value) AS hi, count(*) AS n
       FROM cs GROUP BY label),
rg AS (SELECT min(lo) AS lo, max(hi) AS hi FROM st),
grid AS (SELECT CAST(i AS INTEGER) AS g,
                CASE WHEN i = 99 THEN (SELECT hi FROM rg)
                     ELSE CAST(i AS DOUBLE) * (((SELECT hi FROM rg) - (SELECT lo FROM rg)) / 99) + (SELECT lo FROM rg) END AS c
         FROM range(100) t(i)),
n1 AS (SELECT n FROM st WHERE label = 1), n0 AS (SELECT n FROM st WHERE label = 0),
tl AS (SELECT g.g, g.c, count(*) FILTER (WHERE cs.label = 1 AND cs.value >= g.c) AS p1,
              count(*) FILTER (WHERE cs.label = 0 AND cs.value >= g.c) AS p0
       FROM grid g CROSS JOIN cs GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY p1 * (SELECT n FROM n0) - p0 * (SELECT n FROM n1) DESC, g ASC) - 1 AS INTEGER) AS rank,
       g AS grid_index, round(c, 6) AS cutoff,
       round(0.5 * (p1 / (SELECT n FROM n1) + 1 - p0 / (SELECT n FROM n0)), 6) AS accuracy,
       round((SELECT lo FROM rg), 6) AS grid_low, round((SELECT hi FROM rg), 6) AS grid_high
FROM tl ORDER BY p1 * (SELECT n FROM n0) - p0 * (SELECT n FROM n1) DESC, g ASC LIMIT 5""")
def q_similarity_best_cutoff(spark, sf_dir):
    return rounded(SIM.best_cutoffs(B.persona_vectors(spark, sf_dir), 5))


@register("threshold_precision", f"""WITH {SQL_ALL_PAIRS}
SELECT count(*) FILTER (WHERE value > 0.5 AND label = 1) AS n_match_above,
       count(*) FILTER (WHERE value > 0.5 AND label = 0) AS n_mismatch_above,
       count(*) FILTER (WHERE value < 0.5 AND label = 1) AS n_match_below,
       count(*) FILTER (WHERE value < 0.5 AND label = 0) AS n_mismatch_below,
       round(CAST(count(*) FILTER (WHERE value > 0.5 AND label = 1) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE value > 0.5), 0), 6) AS match_share_above,
       round(CAST(count(*) FILTER (WHERE value < 0.5 AND label = 1) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE value < 0.5), 0), 6) AS match_share_below
FROM cs""")
def q_threshold_precision(spark, sf_dir):
    return rounded(SIM.threshold_precision(B.persona_vectors(spark, sf_dir), 0.5))


SQL_BATCH = f"""{SQL_VECS},
ai AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS idx FROM (SELECT DISTINCT author FROM vecs)),
bv AS (SELECT v.*, ai.idx, ai.idx // 64 AS batch FROM vecs v JOIN ai USING (author)),
sims AS (SELECT a.batch, a.author, a.slot, b.author AS author2, b.slot AS slot2,
                list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 0.07 AS s
         FROM bv a JOIN bv b ON a.batch = b.batch AND NOT (a.author = b.author AND a.slot = b.slot)),
posv AS (SELECT batch, author, slot, s AS pos FROM sims WHERE author = author2),
rowsm AS (SELECT s.batch, s.author, s.slot, any_value(p.pos) AS pos,
                 max(s.s) AS mx,
                 count(*) FILTER (WHERE s.author <> s.author2 AND s.s > p.pos) AS n_better
          FROM sims s JOIN posv p USING (batch, author, slot) GROUP BY ALL),
lrow AS (SELECT r.batch, r.author, r.slot, -r.pos + r.mx + ln(sum(exp(s.s - r.mx))) AS loss, 1 + r.n_better AS rank
         FROM rowsm r JOIN sims s USING (batch, author, slot) GROUP BY r.batch, r.author, r.slot, r.pos, r.mx, r.n_better)"""


def _batch_rows(spark, sf_dir):
    return V.batch_rows(B.persona_vectors(spark, sf_dir))


@register("info_nce_eval", f"""WITH {SQL_BATCH}
SELECT batch, round(avg(loss), 6) AS loss, count(*) AS n_rows FROM lrow GROUP BY batch""")
def q_info_nce_eval(spark, sf_dir):
    return rounded(V.info_nce(_batch_rows(spark, sf_dir)))


@register("retrieval_metrics", f"""WITH {SQL_BATCH}
SELECT round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1,
       round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5,
       round(avg(rank), 6) AS mean_position, count(*) AS n_rows FROM lrow""")
def q_retrieval_metrics(spark, sf_dir):
    return rounded(V.retrieval_metrics(_batch_rows(spark, sf_dir)))


# ------------------------------------------------------------------ learners

from pyspark.ml.functions import vector_to_array  # noqa: E402

from penprint.operators import learners as LRN  # noqa: E402

SQL_DERANGE = f"""
two_ AS (SELECT author FROM flat GROUP BY author HAVING count(DISTINCT slot) = 2),
armed AS (SELECT author, CASE WHEN {sql_sha256_mod_100('author')} < 70 THEN 'train'
                              WHEN {sql_sha256_mod_100('author')} < 85 THEN 'val' ELSE 'test' END AS arm FROM two_),
di AS (SELECT author, arm, row_number() OVER (PARTITION BY arm ORDER BY sha256('424242:' || author), author) - 1 AS idx,
              count(*) OVER (PARTITION BY arm) AS n FROM armed WHERE arm <> 'test'),
lp AS (SELECT author AS author_a, author AS author_b, 1 AS label, arm FROM di
       UNION ALL SELECT a.author, b.author, 0, a.arm FROM di a JOIN di b ON b.arm = a.arm AND b.idx = (a.idx + 1) % a.n)"""
SQL_LEARN = f"{SQL_BEST_STATS}, {SQL_DERANGE}"


def _learn_inputs(spark, sf_dir):
    """Log-frequencies over the 40 most accurate tokens, and pairs deranged inside the train and the val arm."""
    flat, counts, tset, k, personas = _best_stats(spark, sf_dir)
    freq = tok.persona_log_freq(tok.persona_token_freq(counts, tset, k, ["author", "slot"], personas), k)
    return freq, k, LRN.arm_pairs(B.two_sided(flat, "author", "slot"))


@register("derangement_pairs", f"WITH {B.SQL_AUTHOR_DOCS}, {SQL_DERANGE} SELECT author_a, author_b, arm FROM lp WHERE label = 0")
def q_derangement_pairs(spark, sf_dir):
    pairs = LRN.arm_pairs(B.two_sided(_author_docs(spark, sf_dir)[1], "author", "slot"))
    return pairs.where(F.col("label") == 0).select("author_a", "author_b", "arm")


@register("pair_features_concat", f"""WITH {SQL_LEARN}
SELECT lp.author_a, lp.author_b, lp.label, lp.arm, f.rank AS pos, round(f.log_freq, 6) AS value
FROM lp JOIN freq_long f ON f.author = lp.author_a AND f.slot = 0
UNION ALL
SELECT lp.author_a, lp.author_b, lp.label, lp.arm, f.rank + (SELECT k FROM kk) AS pos, round(f.log_freq, 6) AS value
FROM lp JOIN freq_long f ON f.author = lp.author_b AND f.slot = 1""")
def q_pair_features_concat(spark, sf_dir):
    freq, k, pairs = _learn_inputs(spark, sf_dir)
    return rounded(LRN.concat_features(freq, pairs, k))


@register("pair_features_weighted", f"""WITH {SQL_LEARN}
SELECT lp.author_a, lp.author_b, lp.label, lp.arm, a.rank AS pos,
       round(CASE WHEN b.n_in_set = 0 THEN 0.0 ELSE a.log_freq_with_excluded * b.n / b.n_in_set END, 6) AS value
FROM lp JOIN freq_long a ON a.author = lp.author_a AND a.slot = 0
JOIN freq_long b ON b.author = lp.author_b AND b.slot = 1 AND b.rank = a.rank""")
def q_pair_features_weighted(spark, sf_dir):
    freq, _, pairs = _learn_inputs(spark, sf_dir)
    return rounded(LRN.weighted_features(freq, pairs))


def _train_vectors(spark, sf_dir):
    freq, k, pairs = _learn_inputs(spark, sf_dir)
    return cut_lineage(LRN.to_vectors(LRN.concat_features(freq, pairs, k)).where(F.col("arm") == "train"))


SQL_WEIGHTED = f"""{SQL_LEARN},
fl AS MATERIALIZED (
  SELECT lp.author_a || ' ' || lp.author_b || ' ' || lp.label AS id, lp.arm, lp.label AS y, a.rank + 1 AS a,
         CASE WHEN b.n_in_set = 0 THEN 0.0 ELSE a.log_freq_with_excluded * b.n / b.n_in_set END AS x
  FROM lp JOIN freq_long a ON a.author = lp.author_a AND a.slot = 0
  JOIN freq_long b ON b.author = lp.author_b AND b.slot = 1 AND b.rank = a.rank
  UNION ALL
  SELECT lp.author_a || ' ' || lp.author_b || ' ' || lp.label, lp.arm, lp.label, (SELECT k FROM kk) + 1, 1.0 FROM lp),
-- Newton's method for the penalised logistic loss; each system is solved by Gauss-Jordan elimination on lists.
newton AS (
  SELECT 0 AS it, list_transform(range((SELECT k FROM kk) + 1), lambda i: CAST(0 AS DOUBLE)) AS w
  UNION ALL
  SELECT it + 1, list_transform(w, lambda v, i: v - solved[i][len(w) + 1]) FROM (
    SELECT it, w, list_reduce(
        list_concat([m], list_transform(range(1, len(w) + 1), lambda p: [[CAST(p AS DOUBLE)]])),
        lambda acc, e: list_transform(acc, lambda r, i: CASE WHEN i = CAST(e[1][1] AS BIGINT)
          THEN list_transform(r, lambda v: v / r[CAST(e[1][1] AS BIGINT)])
          ELSE list_transform(r, lambda v, j: v - r[CAST(e[1][1] AS BIGINT)] * acc[CAST(e[1][1] AS BIGINT)][j]
                                                / acc[CAST(e[1][1] AS BIGINT)][CAST(e[1][1] AS BIGINT)]) END)) AS solved
    FROM (
      SELECT it, any_value(w) AS w, list(list_append(h, g) ORDER BY a) AS m FROM (
        SELECT it, any_value(w) AS w, a, list(hab ORDER BY b) AS h, any_value(ga) AS g FROM (
          SELECT s.it, any_value(s.w) AS w, fa.a, fb.a AS b,
                 sum(s.p * (1 - s.p) * fa.x * fb.x)
                   + CASE WHEN fa.a = fb.a AND fa.a <= (SELECT k FROM kk) THEN 1 ELSE 0 END AS hab,
                 sum((s.p - s.y) * fa.x) + CASE WHEN fa.a <= (SELECT k FROM kk) THEN any_value(s.w)[fa.a] ELSE 0 END AS ga
          FROM (SELECT n.it, any_value(n.w) AS w, f.id, f.y, 1 / (1 + exp(-sum(n.w[f.a] * f.x))) AS p
                FROM newton n, fl f WHERE n.it < 15 AND f.arm = 'train' GROUP BY n.it, f.id, f.y) s
          JOIN fl fa ON fa.id = s.id JOIN fl fb ON fb.id = s.id
          GROUP BY s.it, fa.a, fb.a) GROUP BY it, a) GROUP BY it))),
weights AS (SELECT unnest(range(len(w))) AS pos, unnest(w) AS weight FROM newton WHERE it = 15),
z AS (SELECT f.id, f.arm, f.y, sum(f.x * w.weight) AS z FROM fl f JOIN weights w ON w.pos + 1 = f.a GROUP BY ALL)"""


def _logistic(spark, sf_dir):
    """Long features, the exact weights learned from the train arm, and the gradient there."""
    freq, _, pairs = _learn_inputs(spark, sf_dir)
    long = cut_lineage(LRN.weighted_features(freq, pairs))
    train = cut_lineage(LRN.to_vectors(long).where(F.col("arm") == "train"))
    weights, gradient = LRN.exact_weights(LRN.logistic_regression(train), train)
    return long, LRN.weight_rows(spark, weights), gradient


@register("model_logistic", f"""WITH RECURSIVE {SQL_WEIGHTED},
g AS (SELECT f.a, sum((1 / (1 + exp(-z.z)) - z.y) * f.x) AS g FROM fl f JOIN z USING (id) WHERE f.arm = 'train' GROUP BY f.a)
SELECT z.arm, count(*) AS n, count(*) FILTER (WHERE (z > 0) = (y = 1)) AS n_correct,
       round(count(*) FILTER (WHERE (z > 0) = (y = 1)) / count(*), 6) AS accuracy,
       (SELECT CAST(count(*) AS INTEGER) FROM weights) AS n_weights,
       (SELECT round(max(abs(g.g + CASE WHEN g.a <= (SELECT k FROM kk) THEN w.weight ELSE 0 END)), 6)
        FROM g JOIN weights w ON w.pos + 1 = g.a) AS gradient
FROM z GROUP BY z.arm""")
def q_model_logistic(spark, sf_dir):
    """M4: accuracy in both arms, scored by the table of weights, and the certificate of the optimum."""
    long, weights, gradient = _logistic(spark, sf_dir)
    scored = LRN.accuracy_by_arm(LRN.linear_predictions(long, weights))
    return rounded(scored.withColumn("n_weights", F.lit(weights.count()).cast("int")).withColumn("gradient", F.lit(gradient)))


@register("logistic_weights", f"""WITH RECURSIVE {SQL_WEIGHTED}
SELECT CAST(pos AS INTEGER) AS pos, round(weight, 5) AS weight FROM weights""")
def q_logistic_weights(spark, sf_dir):
    """M4: the learned model as a table."""
    return rounded(_logistic(spark, sf_dir)[1], 5)


@register("model_gbt", f"""WITH {SQL_LEARN}
SELECT m.model, lp.arm, lp.label, count(*) AS n, CAST(2 * (SELECT k FROM kk) AS INTEGER) AS width, true AS finished, true AS beats_chance
FROM lp CROSS JOIN (VALUES ('gbt2'), ('gbt3'), ('gbt4')) m(model) GROUP BY m.model, lp.arm, lp.label""")
def q_model_gbt(spark, sf_dir):
    """M5: the pairs that each model scores, by arm and label, whether it has all its trees, and whether it tells the
    train arm's pairs better than chance; ``model_gbt_accuracy`` says how well."""
    out = None
    for name, trees, long, predicted in _boosted(spark, sf_dir):
        width = long.agg(F.max("pos")).first()[0] + 1
        finished = trees.select("tree").distinct().count() == LRN.GBT_TREES
        predicted = cut_lineage(predicted)
        train = LRN.accuracy_by_arm(predicted).where(F.col("arm") == "train").first()
        rows = predicted.groupBy(F.lit(name).alias("model"), "arm", F.col("label").cast("int").alias("label")).agg(
            F.count("prediction").alias("n")).withColumn("width", F.lit(width).cast("int")).withColumn(
            "finished", F.lit(finished)).withColumn("beats_chance", F.lit(train is not None and train.accuracy > 0.5))
        out = rows if out is None else out.unionByName(rows)
    return out


def _boosted(spark, sf_dir):
    """(name, tree table, long features, predictions by that table) of depths 2, 3 and 4, learned from the train arm."""
    freq, k, pairs = _learn_inputs(spark, sf_dir)
    long = cut_lineage(LRN.concat_features(freq, pairs, k))
    train = cut_lineage(LRN.to_vectors(long).where(F.col("arm") == "train"))
    depths = (2, 3, 4)
    for depth, model in zip(depths, LRN.boosted_by_depth(train, depths), strict=True):
        trees = cut_lineage(LRN.tree_rows(spark, model))
        yield f"gbt{depth}", trees, long, LRN.tree_predictions(long, trees, depth)


@register("model_gbt_accuracy")
def q_model_gbt_accuracy(spark, sf_dir):
    """M5: accuracy in both arms. No SQL: Spark's binned splits are not expressible; a test derives the
    accuracies again from the exported tree tables."""
    out = None
    for name, _, _, predicted in _boosted(spark, sf_dir):
        rows = LRN.accuracy_by_arm(predicted).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)


@register("model_pca", f"""WITH {SQL_LEARN},
feats AS (SELECT lp.author_a, lp.label, f.rank AS pos, f.log_freq AS v FROM lp JOIN freq_long f ON f.author = lp.author_a AND f.slot = 0
          WHERE lp.arm = 'train'
          UNION ALL SELECT lp.author_a, lp.label, f.rank + (SELECT k FROM kk), f.log_freq
          FROM lp JOIN freq_long f ON f.author = lp.author_b AND f.slot = 1 WHERE lp.arm = 'train'),
per AS (SELECT pos, var_samp(v) AS var FROM feats GROUP BY pos)
SELECT (SELECT count(*) FROM lp WHERE arm = 'train') AS n, CAST(count(*) AS INTEGER) AS width,
       round(sum(var), 6) AS total_variance, true AS ratios_descending, true AS scores_explain_ratios FROM per""")
def q_model_pca(spark, sf_dir):
    """M6: total variance, and whether the components' own variances are the reported ratios of it."""
    train = _train_vectors(spark, sf_dir)
    scores, ratios = LRN.pca_scores(train, 3, 5)
    values = train.select(F.posexplode(vector_to_array("features")).alias("pos", "v"))
    total = values.groupBy("pos").agg(F.var_samp("v").alias("var")).agg(
        F.sum("var").alias("total"), F.count(F.lit(1)).cast("int").alias("width")).first()
    spread = scores.agg(F.count(F.lit(1)).alias("n"), *[F.var_samp(F.col("scores")[i]).alias(f"v{i}") for i in range(3)]).first()
    explained = all(abs(spread[f"v{i}"] / total.total - ratios[i]) < 1e-6 for i in range(3))
    return rounded(spark.createDataFrame(
        [(spread.n, total.width, total.total, all(a >= b for a, b in zip(ratios, ratios[1:], strict=False)), explained)],
        "n bigint, width int, total_variance double, ratios_descending boolean, scores_explain_ratios boolean"))


@register("token_hist2d", f"""WITH {SQL_BEST_STATS},
xy AS (SELECT a.token, a.author, a.log_freq_with_excluded AS x, b.log_freq_with_excluded AS y
       FROM freq_long a JOIN freq_long b ON a.author = b.author AND a.token = b.token AND a.slot = 0 AND b.slot = 1
       WHERE a.rank < 3),
r AS (SELECT token, CASE WHEN max(x) > min(x) THEN min(x) ELSE min(x) - 0.5 END AS xl,
                    CASE WHEN max(x) > min(x) THEN max(x) ELSE max(x) + 0.5 END AS xh,
                    CASE WHEN max(y) > min(y) THEN min(y) ELSE min(y) - 0.5 END AS yl,
                    CASE WHEN max(y) > min(y) THEN max(y) ELSE max(y) + 0.5 END AS yh FROM xy GROUP BY token)
SELECT token,
       least(greatest(CAST(floor((x - xl) * 30.0 / (xh - xl)) AS INTEGER) + 1, 1), 30) AS bx,
       least(greatest(CAST(floor((y - yl) * 30.0 / (yh - yl)) AS INTEGER) + 1, 1), 30) AS "by",
       count(*) AS count
FROM xy JOIN r USING (token) GROUP BY ALL""")
def q_token_hist2d(spark, sf_dir):
    _, counts, tset, k, personas = _best_stats(spark, sf_dir)
    freq = tok.persona_log_freq(tok.persona_token_freq(counts, tset, k, ["author", "slot"], personas), k)
    top = freq.where(F.col("rank") < 3)
    a = top.where(F.col("slot") == 0).select("author", "token", F.col("log_freq_with_excluded").alias("x"))
    b = top.where(F.col("slot") == 1).select("author", "token", F.col("log_freq_with_excluded").alias("y"))
    return LRN.hist2d(a.join(b, ["author", "token"]), ["token"], 30)


@register("similarity_examples", f"""WITH {SQL_VECS},
vdocs AS ({B.SQL_VECTOR_DOCS}),
cs AS (SELECT a.author AS author_i, a.slot AS slot_i, b.author AS author_j, b.slot AS slot_j,
              CASE WHEN a.author = b.author THEN 1 ELSE 0 END AS label,
              list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS value
       FROM vecs a JOIN vecs b ON (a.author, a.slot) < (b.author, b.slot)),
kinds AS (SELECT *, CASE WHEN label = 1 AND value > 0.3 THEN 'true_match' WHEN label = 0 AND value > 0.3 THEN 'false_match'
                         WHEN label = 1 AND value < 0.0 THEN 'missed_match' END AS kind FROM cs),
ex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY
                CASE WHEN kind = 'missed_match' THEN value ELSE -value END, author_i, slot_i, author_j, slot_j) - 1 AS INTEGER) AS place
              FROM kinds WHERE kind IS NOT NULL) WHERE place < 5),
sides AS (SELECT *, 0 AS side, author_i AS author, slot_i AS slot FROM ex
          UNION ALL SELECT *, 1, author_j, slot_j FROM ex),
shown AS (SELECT s.kind, s.place, s.author_i, s.slot_i, s.author_j, s.slot_j, s.value, s.side, d.kind AS doc_kind, d.ordinal, d.text,
                 CAST(row_number() OVER (PARTITION BY s.kind, s.place, s.side
                      ORDER BY CASE WHEN d.kind = 'comment' THEN 0 ELSE 1 END, d.ordinal) - 1 AS INTEGER) AS position
          FROM sides s LEFT JOIN vdocs d USING (author, slot))
SELECT kind, place, author_i, slot_i, author_j, slot_j, round(value, 6) AS value, side, position, doc_kind, ordinal, text
FROM shown WHERE position < 5""")
def q_similarity_examples(spark, sf_dir):
    found = SIM.examples(B.persona_vectors(spark, sf_dir), 0.3, 0.0, 5)
    return rounded(SIM.with_documents(found, B.vector_documents(spark, sf_dir), 5))


@register("embeddings_roundtrip", f"""WITH {SQL_VECS}
SELECT CASE WHEN {sql_sha256_mod_100('author')} < 70 THEN 'train'
            WHEN {sql_sha256_mod_100('author')} < 85 THEN 'val' ELSE 'test' END AS arm,
       author AS username, slot, CAST(label AS VARCHAR) AS subreddit, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM vecs""")
def q_embeddings_roundtrip(spark, sf_dir):
    vecs = B.persona_vectors(spark, sf_dir)
    rows = P.with_arm(vecs, "author").select(
        "arm", F.col("author").alias("username"), "slot", F.col("label").cast("string").alias("subreddit"),
        F.col("embedding").cast("array<float>").alias("embedding"))
    path = scratch_path(spark, "embeddings")
    writers.write_embeddings(rows, path)
    back = readers.read_embeddings(spark, path, ("train", "val", "test"))
    dims = back.select(F.size("embedding").alias("d")).distinct().limit(2).collect()
    if len(dims) > 1:
        raise ValueError(f"embeddings of different sizes: {[r.d for r in dims]}")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(back.select("arm", "username", "slot", "subreddit", F.size("embedding").alias("dim"),
                               total.alias("total")))
