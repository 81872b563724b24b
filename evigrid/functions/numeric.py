"""Numbers: log odds, intervals, hash-based draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def clamp(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON))


def logit(p: Column) -> Column:
    return F.log(clamp(p) / (F.lit(1.0) - clamp(p)))


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval, inside 0 to 1; null without trials."""
    n, k = F.nullif(total.cast("double"), F.lit(0.0)), successes.cast("double")
    p = k / n
    centre, half, below = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), (centre - half) / below)), F.when(n.isNotNull(), F.least(F.lit(1.0), (centre + half) / below))


def draw(*parts: Column) -> Column:
    """32 bits of md5 over the parts as a BIGINT: the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    return draw(*parts) / F.lit(4294967296.0)


def percentile(values: Column, share: float) -> Column:
    """Nearest rank: the value at rank ceil(share * n), at least the first."""
    return F.try_element_at(F.sort_array(F.collect_list(values)), F.greatest(F.lit(1), F.ceil(F.lit(share) * F.count(values)).cast("int")))
