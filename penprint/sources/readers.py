"""Typed readers for every input the pipeline takes.

All readers use an explicit schema, so nothing is inferred and a wrong file
fails fast instead of silently changing types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.sources import schemas


# Place of a row in its input: file name, first byte of its piece of the file, position inside the piece.
FILE_ORDER = "file_order"


def with_file_order(rows: DataFrame, column: str = FILE_ORDER, source: str = "text") -> DataFrame:
    """Add the rows' place in the files they are scanned from, as one sortable struct.

    Files count in name order, rows in the order in which they stand in their
    file, however Spark packs files and pieces of files into tasks. ``rows`` is a
    scan, or a selection or filter of one. Parquet rows carry their number in the file; the rows
    of a text or JSON file have the first byte of their piece, and inside it
    the task's running number, which only grows along a piece.
    """
    meta = F.col("_metadata")
    if source == "parquet":
        place = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("piece"), F.lit(0).cast("bigint").alias("row"))
    else:
        place = F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("piece"),
                         F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(column))


def read_submissions(spark: SparkSession, path: str, raw: bool = False, file_order: str | None = None) -> DataFrame:
    """Newline-delimited JSON posts (splittable text scan); ``file_order`` names a column for their place."""
    rows = _json(spark, schemas.RAW_SUBMISSION if raw else schemas.SUBMISSION, path)
    return with_file_order(rows, file_order) if file_order else rows


def _json(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A damaged line is an error that names its file, never a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_comments(spark: SparkSession, path: str, raw: bool = False, file_order: str | None = None) -> DataFrame:
    """Newline-delimited JSON comments; ``file_order`` names a column for their place."""
    rows = _json(spark, schemas.RAW_COMMENT if raw else schemas.COMMENT, path)
    return with_file_order(rows, file_order) if file_order else rows


def read_nsfw_flags(spark: SparkSession, path: str, single_object: bool = False) -> DataFrame:
    """S3: flag table (subreddit, flagged).

    ``single_object=True`` reads the interchange form: one JSON object mapping
    subreddit -> flag. Any truthy value counts as flagged. That form is one
    record by construction; the row form written by ``write_nsfw_flags`` is the
    one to use at scale.
    """
    if not single_object:
        return _json(spark, schemas.NSFW_FLAG, path)
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "MAP<STRING,STRING>")).alias("subreddit", "v"))
    falsy = F.lower(F.trim(F.col("v"))).isin("false", "0", "0.0", "", "null")
    return entries.select("subreddit", (F.col("v").isNotNull() & ~falsy).alias("flagged"))


def read_count_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Two-column CSV with header (key, count). No null-value conversion of names."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("count", T.LongType())])
    return spark.read.schema(schema).option("header", True).option("nullValue", None).csv(path)


def read_line_list(spark: SparkSession, path: str, column: str = "author") -> DataFrame:
    """One name per line, white space of any kind trimmed, deduplicated."""
    trimmed = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return spark.read.text(path).select(trimmed.alias(column)).distinct()


def read_author_subreddit_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per (author, subreddit) counts as written by K4. Of repeated keys the last line of the last file stands."""
    return last_of(with_file_order(_json(spark, schemas.AUTHOR_SUBREDDIT_STATS, path)), ["author", "subreddit"])


def last_of(rows: DataFrame, keys: list[str], order: str = FILE_ORDER) -> DataFrame:
    """The last row of every key; combined map-side, so repeated keys are reduced before the shuffle."""
    values = [c for c in rows.columns if c not in (*keys, order)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in rows.columns if c != order])


def read_author_infos(spark: SparkSession, path: str) -> DataFrame:
    """Nested author documents; a malformed record is an error."""
    return _json(spark, schemas.AUTHOR_INFO, path)


def read_arms(spark: SparkSession, path: str, arms: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Arm-partitioned flat author documents; the arm filter prunes partitions."""
    schema = T.StructType(schemas.AUTHOR_DOCUMENT.fields + [T.StructField("arm", T.StringType())])
    return _json(spark, schema, path).where(F.col("arm").isin(*arms))


def _require_string_columns(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    types = dict(df.dtypes)
    missing = [c for c in columns if c not in types]
    if missing:
        raise ValueError(f"{what} is missing required columns {missing}")
    wrong = [c for c in columns if types[c] != "string"]
    if wrong:
        raise ValueError(f"{what} columns {wrong} must be strings, got {[types[c] for c in wrong]}")


def validate_documents(df: DataFrame) -> DataFrame:
    """P8 for documents: entity, persona, text must exist and be strings."""
    _require_string_columns(df, schemas.DOCUMENT_COLUMNS, "documents")
    return df


def validate_pairs(df: DataFrame) -> DataFrame:
    """P8 for pairs: the four id columns must exist and be strings."""
    _require_string_columns(df, schemas.PAIR_COLUMNS, "pairs")
    return df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents Parquet; only the three used columns are read (column pruning), null keys dropped.

    ``with_file_order`` adds each document's place in its files.
    """
    docs = validate_documents(spark.read.parquet(path)).select(*schemas.DOCUMENT_COLUMNS)
    return docs.where(F.col("entity").isNotNull() & F.col("persona").isNotNull())


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs Parquet; duplicates kept."""
    return validate_pairs(spark.read.parquet(path)).select(*schemas.PAIR_COLUMNS)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """K14 read back: pairs with their scores."""
    return spark.read.parquet(path).select(*schemas.PAIR_COLUMNS, "match_score")


def read_token_counts(spark: SparkSession, path: str) -> DataFrame:
    """Ranked token counts (rank, token, n)."""
    return spark.read.schema(schemas.TOKEN_COUNT).parquet(path)


def read_token_accuracies(spark: SparkSession, path: str) -> DataFrame:
    """Token accuracies, by accuracy descending then rank."""
    return (spark.read.schema(schemas.TOKEN_ACCURACY).parquet(path)
            .orderBy(F.col("accuracy").desc(), F.col("rank")))


def read_model(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """A saved model: returns (model_type, parameter table).

    For a log-likelihood model the table is the ranked token list
    (token_index, string); for an embedding model it is one parameter row.
    The model type is checked against the known kinds; unknown kinds raise.
    """
    # One short record: its size is a parameter of the model.
    raw = spark.read.text(path).select(F.from_json("value", "MAP<STRING,STRING>").alias("m"))
    records = raw.select(F.col("m")["model_type"].alias("kind"), F.map_keys("m").alias("fields"),
                         F.map_keys(F.from_json(F.col("m")["model_params"], "MAP<STRING,STRING>")).alias("params"),
                         F.from_json(F.from_json(F.col("m")["model_params"], "MAP<STRING,STRING>")["tokens"],
                                     "ARRAY<MAP<STRING,STRING>>").alias("tokens")).select(
        "kind", "fields", "params", F.array_distinct(F.flatten(F.transform("tokens", F.map_keys))).alias("token_fields"))
    found = records.distinct().limit(2).collect()
    if len(found) != 1 or found[0].kind not in schemas.MODEL_TYPES:
        raise ValueError(f"unknown or mixed model type: {[r.kind for r in found]}")
    kind = found[0].kind
    params = schemas.MODEL_TYPES[kind]
    unknown = set(found[0].fields or []) - {"model_type", "model_params"} | set(found[0].params or []) - set(params.names)
    unknown |= set(found[0].token_fields or []) - {"token_index", "string"}
    if unknown:
        raise ValueError(f"unknown fields in a model file: {sorted(unknown)}")
    full = _json(spark, T.StructType([T.StructField("model_type", T.StringType()),
                                      T.StructField("model_params", params)]), path)
    if kind == "LOG_LIKELIHOOD_MODEL":
        return kind, full.select(F.posexplode("model_params.tokens").alias("rank", "t")).select(
            "rank", F.col("t.token_index").alias("token_index"), F.col("t.string").alias("token"))
    return kind, full.select("model_params.*")


def read_embeddings(spark: SparkSession, path: str, arms: tuple[str, ...] | None = None) -> DataFrame:
    """Persona embeddings, partitioned by arm."""
    df = spark.read.schema(schemas.PERSONA_EMBEDDING).parquet(path)
    return df.where(F.col("arm").isin(*arms)) if arms else df
