"""Explicit schemas for every table the pipeline reads or writes (no inference)."""

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SUBMISSION = _struct(("author", S), ("id", S), ("subreddit", S), ("subreddit_id", S),
                     ("subreddit_name_prefixed", S), ("selftext", S), ("title", S),
                     ("over_18", B), ("url", S))
RAW_SUBMISSION = T.StructType(SUBMISSION.fields + [T.StructField("created_utc", L, True)])

COMMENT = _struct(("author", S), ("body", S), ("id", S), ("subreddit", S), ("subreddit_id", S),
                  ("subreddit_name_prefixed", S), ("permalink", S))
RAW_COMMENT = T.StructType(COMMENT.fields + [T.StructField("created_utc", L, True)])

NSFW_FLAG = _struct(("subreddit", S), ("flagged", B))

AUTHOR_SUBREDDIT_STATS = _struct(("author", S), ("subreddit", S), ("num_characters", L),
                                 ("num_comments", L), ("num_posts", L))

SUBMISSION_INFO = _struct(("title", S), ("selftext", S), ("url", S))
COMMENT_INFO = _struct(("body", S), ("permalink", S))
# slot, first_* and chunk are null in files that hold one record per author.
PERSONA_INFO = _struct(("subreddit", S), ("submissions", T.ArrayType(SUBMISSION_INFO)),
                       ("comments", T.ArrayType(COMMENT_INFO)), ("slot", I), ("first_submission", L),
                       ("first_comment", L))
AUTHOR_INFO = _struct(("username", S), ("chunk", I), ("personas", T.ArrayType(PERSONA_INFO)))

TOKEN_COUNT = _struct(("rank", I), ("token", S), ("n", L))
TOKEN_ACCURACY = _struct(("rank", I), ("accuracy", D), ("token", S))

MODEL_TOKEN = _struct(("token_index", I), ("string", S))
LOG_LIKELIHOOD_PARAMS = _struct(("tokens", T.ArrayType(MODEL_TOKEN)))
EMBEDDING_PARAMS = _struct(("embedding_model", S), ("embedding_strategy", S),
                           ("embedding_model_checkpoint_path", S))
MODEL_TYPES = {"LOG_LIKELIHOOD_MODEL": LOG_LIKELIHOOD_PARAMS, "EMBEDDING_MODEL": EMBEDDING_PARAMS}

PERSONA_EMBEDDING = _struct(("arm", S), ("username", S), ("slot", I), ("subreddit", S),
                            ("embedding", T.ArrayType(T.FloatType())))

DOCUMENT_COLUMNS = ("entity", "persona", "text")
PAIR_COLUMNS = ("entity1", "persona1", "entity2", "persona2")

# One row per document of a persona; a persona without documents has one row with null kind.
AUTHOR_DOCUMENT = _struct(("author", S), ("slot", I), ("subreddit", S), ("kind", S), ("ordinal", L), ("title", S),
                          ("selftext", S), ("url", S), ("body", S), ("permalink", S))
