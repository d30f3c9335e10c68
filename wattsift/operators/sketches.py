"""Distinct counts from stored sketches: one small sketch per part of the data, merged on reading over any of the parts.

A new day adds its own sketches and reads no earlier rows. Theta sketches also tell what two groups share, which counts
alone cannot.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^14 hashes a sketch: 128 KB at most, whatever it has seen.
LG = 14


def error(lg: int = LG, deviations: float = 4.0) -> float:
    """Stated relative error of an estimate: ``deviations`` standard errors of 1 / sqrt(2^lg). Up to 2^lg distinct values
    the sketch holds all of their hashes, and the estimate is exact."""
    return deviations / 2 ** (lg / 2)


def sketch(df: DataFrame, parts: list[str], column: str, lg: int = LG) -> DataFrame:
    """One row per part: rows ``n``, and a ``sketch`` of the distinct values. NULLs count as rows only. Write it as a
    table; partial sketches merge before the shuffle, so a part that holds most rows costs no more than others."""
    return df.groupBy(*parts).agg(F.count("*").alias("n"), F.theta_sketch_agg(column, lg).alias("sketch"))


def merge(sketches: DataFrame, keys: list[str], lg: int = LG) -> DataFrame:
    """Sketches of finer parts as one per key: of all days, say, or of some that were filtered before."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.theta_union_agg("sketch", lg).alias("sketch"))


def _bounded(value: Column, of: Column, lg: int) -> list[Column]:
    """An estimate with the ends of its stated error, which is relative to the estimate ``of``."""
    slack = F.when(of <= 2**lg, F.lit(0.0)).otherwise(of * F.lit(error(lg)))
    return [
        value.alias("estimate"),
        F.greatest(F.lit(0), F.floor(value - slack)).cast("bigint").alias("at_least"),
        F.ceil(value + slack).cast("bigint").alias("at_most"),
    ]


def distinct(sketches: DataFrame, keys: list[str], lg: int = LG) -> DataFrame:
    """Per key: n, estimate, at_least, at_most of its distinct values."""
    size = F.theta_sketch_estimate("sketch")
    return merge(sketches, keys, lg).select(*keys, "n", *_bounded(size, size, lg))


def shared(sketches: DataFrame, keys: list[str], group: str, a: str, b: str, lg: int = LG) -> DataFrame:
    """Per key: estimate, at_least, at_most of the distinct values that groups ``a`` and ``b`` both hold; the error is
    relative to what either holds. Keys with one of the groups alone share none."""
    of = lambda value: F.theta_union_agg(F.when(F.col(group) == value, F.col("sketch")), lg)
    sides = sketches.filter(F.col(group).isin(a, b)).groupBy(*keys).agg(
        of(a).alias("__a"), of(b).alias("__b"), F.theta_union_agg("sketch", lg).alias("__either")
    )
    both = F.coalesce(F.theta_sketch_estimate(F.theta_intersection("__a", "__b")), F.lit(0))
    either = F.theta_sketch_estimate("__either")
    return sides.select(*keys, *_bounded(both, either, lg))
