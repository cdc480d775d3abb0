"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame expressions only.

Base rules count words, characters, symbols, repeated lines and repeated
five-word windows. The method compares two multinomials over hashed n-grams:
the trusted target (documents labelled good) and the raw corpus (all
documents). A document's verdict is its log-likelihood ratio divided by the
number of its n-grams: it stays if that mean is at least ``CUT``, a fixed
number, so equal texts always get equal verdicts. N-grams are single words,
pairs of neighbouring words and the last three characters of each word, hashed
into ``BUCKETS`` buckets; both multinomials are counted over whole tables.

Counting partially aggregates in every task, so what is shuffled is at most
one row per bucket and task (and the texts once, to find the trusted ones);
scoring needs no shuffle: the ratios are one array of BUCKETS numbers.

Defined cases: a null, empty or white-space-only text has no words, fails the
base rules and is not kept; a null id is judged but cannot be trusted; a label
given several times is trusted only if it is 1 every time; repeated rows are
counted and judged each; without trusted documents only the base rules decide;
an empty table gives an empty result; other columns are ignored by ``judge``
and kept by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.tables import constant_array, stored

# The characters that separate words, and those that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
# A power of two.
BUCKETS = 1 << 16
SMOOTHING = 1.0
CUT = -0.4


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def with_hashes(rows: DataFrame) -> DataFrame:
    """Adds to (.., text): ``words``, and the hashes of words, word pairs, five-word windows and word ends.

    Every array is a column of its own, built from the one before by joining
    it with itself shifted, so no step looks up positions.
    """
    def joined(a: str, b: str, shift: int, short: int) -> Column:
        """Hashes of a[i] with b[i + shift], ``short`` fewer than there are words."""
        n = F.greatest(F.size("words") - short, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))

    return (rows.withColumn("words", words_of(F.col("text")))
            .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
            .withColumn("ends", F.transform("words", lambda w: F.xxhash64(F.lit("end"), F.substring(w, -3, 3))))
            .withColumn("pairs", joined("hashes", "hashes", 1, 1))
            .withColumn("fours", joined("pairs", "pairs", 2, 3))
            .withColumn("windows", joined("fours", "hashes", 4, 4)))


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, given the windows' hashes."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _let(by_hash, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
        lambda x: x["i"])))
    covered = _let(twice, lambda at: F.aggregate(
        F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(width)), F.lit(width))),
        F.lit(0).cast("bigint"), lambda total, x: total + x))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(covered, F.lit(0).cast("bigint")))


def mean_ratio(ratio: Column, buckets: int = BUCKETS) -> Column:
    """Sum of the n-grams' ratios divided by their number; 0 without words."""
    def total(name: str) -> Column:
        return F.aggregate(name, F.lit(0.0), lambda acc, h: acc + F.get(ratio, h.bitwiseAND(F.lit(buckets - 1))))

    n = F.size("words")
    return F.when(n == 0, F.lit(0.0)).otherwise((total("hashes") + total("pairs") + total("ends")) / (3 * n - 1))


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality", buckets: int = BUCKETS) -> Column:
    """Constant array of log(target / raw) by bucket, to four decimals; zeros when nothing is trusted."""
    trusted = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
               .where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
               .where("label = 1").select("id", F.lit(True).alias("good")))
    # Labels grow with the corpus: the same shuffled join at every size, no broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(trusted.hint("merge"), "id", "left")
    each = with_hashes(rows).select("good", F.explode(F.concat("hashes", "pairs", "ends")).alias("gram")).select(
        "good", F.col("gram").bitwiseAND(F.lit(buckets - 1)).alias("bucket"))
    counts = stored(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("good")), "grams")
    raw, good = counts.agg(F.sum("raw"), F.sum("good")).first()
    spark = docs.sparkSession
    if not good:
        return F.array_repeat(F.lit(0.0), buckets)
    share = lambda c, total: (F.coalesce(c, F.lit(0)) + SMOOTHING) / F.lit(total + SMOOTHING * buckets)
    table = spark.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left").select(
        "id", F.round(F.log(share(F.col("good"), good) / share(F.col("raw"), raw)), 4).alias("ratio"))
    return constant_array(table, "id", "ratio", "array<double>")


def measured(docs: DataFrame, ratio: Column, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """All counts and the mean log ratio of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(SPACES)) != "")
    rows = with_hashes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.select(
        F.col("id"), F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"), mean_ratio(ratio, buckets).alias("score"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT,
          buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row."""
    rows = measured(docs, ratios(docs, labels, id_col, text_col, buckets=buckets), id_col, text_col, buckets)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & (F.col("score") >= cut)).alias("kept"), "score")
