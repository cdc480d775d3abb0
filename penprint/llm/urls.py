"""URL filter: allow and block rules, and a character model ratio for the URLs no rule fits.

Two variable-order Markov models over characters are counted, one over the
URLs that an allow rule accepts and one over those that a block rule rejects.
The probability of a character after its context is interpolated over context
lengths 0 to ``ORDER`` (each level is smoothed towards the shorter context).
Counts are exact, in a table by n-gram that grows with the URLs. The estimate
at a place depends on the window of the last ``ORDER`` + 1 characters alone, so
every distinct window is valued once and joined to the windows of each distinct
host and path; nothing passes through the driver. A URL's score is the difference of its log-likelihoods under
the two models divided by its length; the cut is calibrated halfway between
the mean score of the accepted and of the rejected URLs. DataFrame expressions
only; the pages' other columns (the page itself) are never read.

Defined cases: null, or no ``://``: host and path are empty, no rule fits and
the score is 0 for an empty URL; a null id is judged; repeated rows are
counted and judged each; without URLs of both kinds there is no model and what
no rule fits is allowed; a score at the cut is allowed; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.tables import stored

# The rules of the registered query, (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
ORDER = 4
# Estimates are added up as whole numbers of this fraction, so that the order of rows changes no score.
UNITS = 10 ** 10
# Weight of the shorter context's estimate, in characters.
PULL = 2.0
ALPHABET = 256


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _windows(texts: DataFrame) -> DataFrame:
    """The window that ends at every character of ``host`` and ``path``: at most ORDER + 1 characters, fewer at the start."""
    chars = F.filter(F.split(F.concat("host", "path"), ""), lambda c: c != "")
    return (texts.withColumn("chars", chars).where(F.size("chars") > 0)
            .withColumn("window", F.explode(F.transform("chars", lambda c, i: F.concat(
                *[F.coalesce(F.get(F.col("chars"), i - j), F.lit("")) for j in range(ORDER, 0, -1)], c))))
            .drop("chars"))


def _gram(window: Column, k: int, back: int = 0) -> Column:
    """The k characters of ``window`` that end ``back`` before its end; null if it is shorter."""
    n = F.char_length(window)
    return F.when(n >= k + back, F.substring(window, n - (k + back - 1), F.lit(k)))


def _valued(windows: DataFrame, counts: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """(window, value): the log ratio, in UNITS, of the last character of every distinct window."""
    window = F.col("window")
    # Role k is the n-gram of k characters at the window's end, -k the one before the last character, its context.
    roles = [(k, _gram(window, k)) for k in range(1, ORDER + 2)] + [(-k, _gram(window, k, 1)) for k in range(1, ORDER + 1)]
    asked = windows.select("window", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), g.alias("gram"))
                                                         for k, g in roles])).alias("x")).select("window", "x.*")
    met = asked.where("gram is not null").join(counts.hint("merge"), "gram", "left")

    def count(side: str, role: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col(side))), F.lit(0))

    sides = [(side, total) for side, total in zip(("allowed", "blocked"), totals, strict=True)]
    wide = met.groupBy("window").agg(*[count(side, role).alias(f"{side}{role}") for side, _ in sides for role, _ in roles])

    def log_p(side: str, total: int) -> Column:
        p = (F.col(f"{side}1") + PULL / ALPHABET) / F.lit(total + PULL)
        for k in range(1, ORDER + 1):
            p = (F.col(f"{side}{k + 1}") + PULL * p) / (F.col(f"{side}{-k}") + PULL)
        return F.log(p)

    return wide.select("window", F.round((log_p(*sides[0]) - log_p(*sides[1])) * UNITS).cast("bigint").alias("value"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
          buckets: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row. ``buckets`` is not used: counts are exact."""
    url = F.col("url")
    rows = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
            .select("id", host_of(F.coalesce(url, F.lit(""))).alias("host"),
                    path_of(F.coalesce(url, F.lit(""))).alias("path"))
            .withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)))
    texts = stored(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    windows = _windows(texts.withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)["verdict"]))
    seen = stored(windows.groupBy("window").agg(
        *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(c)
          for v, c in (("allow", "allowed"), ("block", "blocked"))]), "urlwindows")
    counts = stored(seen.where("allowed + blocked > 0").select(
        F.explode(F.array(*[_gram(F.col("window"), k) for k in range(1, ORDER + 2)])).alias("gram"), "allowed", "blocked")
        .where("gram is not null").groupBy("gram").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")),
        "urlgrams")
    totals = tuple(seen.agg(F.sum("allowed"), F.sum("blocked")).first())
    if not totals[0] or not totals[1]:
        scored, cut = rows.withColumn("score", F.lit(0.0)), -math.inf
    else:
        # Both sides grow with the URLs: the same shuffled join at every size, no broadcast.
        values = stored(_valued(seen, counts, totals), "urlvalues")
        sums = (_windows(texts.select("host", "path")).join(values.hint("merge"), "window").groupBy("host", "path")
                .agg((F.sum("value") / F.lit(float(UNITS)) / F.count(F.lit(1))).alias("score")))
        scored = stored(rows.join(sums.hint("merge"), ["host", "path"], "left").select(
            "id", "host", "path", "fits", F.coalesce("score", F.lit(0.0)).alias("score")), "urlscores")
        means = {r[0]: r[1] for r in scored.where("fits is not null").groupBy("fits.verdict").agg(F.avg("score")).collect()}
        cut = round((means["allow"] + means["block"]) / 2, 6)
    learned = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("fits.rule").alias("rule"),
                         F.coalesce("fits.verdict", learned).alias("verdict"), "score")
