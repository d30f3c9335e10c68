"""Filters, expectations and audits."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.functions import metrics as M


def expect(df: DataFrame, rules: dict[str, tuple[Column, int]]) -> DataFrame:
    """All rules ``{name: (aggregate, expected)}`` in one pass: rule, expected, actual, ok."""
    totals = df.agg(*[actual.cast("bigint").alias(name) for name, (actual, _) in rules.items()])
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.lit(expected).cast("bigint").alias("expected"),
                F.col(name).alias("actual"),
                (F.col(name) == F.lit(expected)).alias("ok"),
            )
            for name, (_, expected) in rules.items()
        ]
    )
    return totals.select(F.inline(checks))


def balanced(df: DataFrame, stratum: str, expected: int) -> DataFrame:
    return df.groupBy(stratum).agg(
        F.count("*").alias("n"),
        F.lit(expected).cast("bigint").alias("expected"),
        (F.count("*") == F.lit(expected)).alias("ok"),
    )


def flag_valid(df: DataFrame, rule: Column) -> DataFrame:
    """The rule's outcome as a column; a NULL outcome is not valid."""
    return df.withColumn("valid", F.coalesce(rule, F.lit(False)))


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the rule, and the quarantined rest."""
    flagged = flag_valid(df, rule)
    return flagged.filter("valid").drop("valid"), flagged.filter("NOT valid").drop("valid")


def audit(df: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """Stored power and efficiency against values recomputed from the stored inputs; failing rows only.

    A value that is stored but can't be recomputed, or the other way round, fails too.
    """
    recomputed = {
        "power_net_w": M.per_unit(F.col("net_energy_j"), F.col("latency_s")),
        "lpw": M.efficiency(F.col("q_ped"), F.col("net_energy_j"), F.col("latency_s")),
    }
    errors = {f"{c}_error": F.abs(F.col(c) - recomputed[c]) for c in tolerances}
    failed = reduce(
        lambda a, b: a | b,
        [
            F.coalesce(F.col(f"{c}_error") > F.lit(t), F.col(c).isNull() != recomputed[c].isNull())
            for c, t in tolerances.items()
        ],
    )
    return df.withColumns(errors).filter(failed)


def implied_idle(df: DataFrame, key: str, floor: float) -> DataFrame:
    """Range of (gross - net) / latency per device over rows that did not hit the energy floor."""
    measured = df.filter((F.col("latency_s") > 0) & (F.col("net_energy_j") > floor))
    idle = (F.col("gross_energy_j") - F.col("net_energy_j")) / F.col("latency_s")
    return measured.groupBy(key).agg(F.min(idle).alias("idle_min_w"), F.max(idle).alias("idle_max_w"))
