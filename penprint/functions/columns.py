"""Column expressions shared by the operators.

Everything here is a built-in Spark expression (JVM side, inside whole-stage
codegen where Spark supports it). No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the results depend on.
# Default word splitter: runs of letters (with combining marks), runs of digits,
# runs of anything else that is not whitespace. Case is kept. Whitespace is
# spelled out so Java regex and RE2 agree on it.
TOKEN_PATTERN = r"[\p{L}\p{M}]+|\p{N}+|[^\t\n\x0B\f\r \p{L}\p{M}\p{N}]+"
# z for a two-sided 95% Wilson interval.
WILSON_Z = 1.96
# Arm boundaries on sha256(name) mod 100: below 70 train, below 85 val, else test.
ARM_TRAIN_BELOW = 70
ARM_VAL_BELOW = 85
# 2**32 mod 100, used to reduce the 256-bit hash 32 bits at a time.
_TWO_POW_32_MOD_100 = 96


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column, pattern: str = TOKEN_PATTERN) -> Column:
    """ARRAY<STRING> of tokens of one text segment (null text -> empty)."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(0))


def sha256_mod_100(name: str | Column) -> Column:
    """int(sha256(name).hexdigest(), 16) % 100, exactly, with 32-bit steps."""
    digest = F.sha2(col(name), 256)
    acc = F.lit(0).cast("bigint")
    for i in range(8):
        chunk = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(_TWO_POW_32_MOD_100) + chunk) % F.lit(100)
    return acc


def arm_of(bucket: str | Column) -> Column:
    b = col(bucket)
    return (F.when(b < ARM_TRAIN_BELOW, F.lit("train"))
            .when(b < ARM_VAL_BELOW, F.lit("val"))
            .otherwise(F.lit("test")))


def utc_day_of_month(epoch_seconds: str | Column) -> Column:
    """Day of month in UTC, independent of the session time zone."""
    days = F.floor(col(epoch_seconds) / F.lit(86400)).cast("int")
    return F.dayofmonth(F.date_from_unix_date(days))


def smoothed_log2_freq(count: str | Column, total_in_set: str | Column, set_size: str | Column | int,
                       excluded: str | Column | None = None) -> Column:
    """log2(c + 0.5) - log2(sum over the set of (c + 0.5) [+ excluded + 0.5])."""
    k = F.lit(set_size) if isinstance(set_size, int) else col(set_size)
    denom = col(total_in_set) + F.lit(0.5) * k
    if excluded is not None:
        denom = denom + col(excluded) + F.lit(0.5)
    return F.log2(col(count) + F.lit(0.5)) - F.log2(denom)


def safe_freq(count: str | Column, total: str | Column) -> Column:
    """count / total, or the count itself when the total is 0."""
    return F.when(col(total) == 0, col(count).cast("double")).otherwise(
        col(count).cast("double") / col(total))


def wilson_bounds(freq: str | Column, total: str | Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """(lower, upper) of the Wilson interval, clipped to [0, 1]; null if total is 0."""
    f, n = col(freq).cast("double"), col(total).cast("double")
    z2 = F.lit(z * z)
    scale = F.try_divide(F.lit(1.0), F.lit(1.0) + F.try_divide(z2, n))
    half = scale * F.try_divide(F.lit(z), F.lit(2.0) * n) * F.sqrt(F.lit(4.0) * n * f * (F.lit(1.0) - f) + z2)
    centre = scale * (f + F.try_divide(z2 / F.lit(2.0), n))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clip(centre - half), clip(centre + half)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two arrays; null when either has zero length."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(None).cast("double")).otherwise(dot(a, b) / (na * nb))


def capped_bucket(x: str | Column, lo: str | Column, hi: str | Column, n: int) -> Column:
    """1-based equal-width bucket over [lo, hi]; x == hi falls in the last bucket.

    A degenerate range (lo == hi) is widened to [lo - 0.5, hi + 0.5].
    """
    lo_c, hi_c = col(lo), col(hi)
    lo2 = F.when(hi_c > lo_c, lo_c).otherwise(lo_c - F.lit(0.5))
    hi2 = F.when(hi_c > lo_c, hi_c).otherwise(hi_c + F.lit(0.5))
    raw = F.floor((col(x) - lo2) * F.lit(float(n)) / (hi2 - lo2)).cast("int") + F.lit(1)
    return F.least(F.greatest(raw, F.lit(1)), F.lit(n))
