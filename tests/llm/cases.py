"""Tables of odd rows that every operator has to take."""

import random

from pyspark.sql import DataFrame, SparkSession

CLASHES = ("id", "text_crc32", "n_words", "class", "row", "key", "score", "shard", "ids", "block", "bucket", "hashes",
           "label", "host", "curve", "digest", "kept", "n", "empty")


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abdegilmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = base + " one more word"
    shared = prose(2, 60)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "Two words"), (5, base), (6, base), (7, near), (8, base.upper()),
        (9, prose(3, 30) + " " + shared + " " + prose(4, 30)), (10, prose(5, 30) + " " + shared), (11, "Two words"),
        (12, prose(6, 40_000)), (13, "x" * 300_000), (14, "ß漢字 🙂 naïve text <|endoftext|> and more"),
        (None, prose(7, 50)), (None, None), (15, prose(8, 80)), (15, prose(8, 80)), (16, prose(9, 40)),
        (16, prose(10, 40)), (17, "spam " * 200),
    ]


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    """The rows with all columns of documents, nulls among them, and columns whose names operators might use."""
    data = rows() if data is None else data
    full = [(i, t, None if k % 3 else "en", None if k % 4 else f"src{k % 2}", None if t is None else len(t),
             *(f"{c}{k}" for c in CLASHES)) for k, (i, t) in enumerate(data)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                 + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()
