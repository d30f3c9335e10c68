"""Exact interpolated quantiles without gathering a group in one task.

``median``/``percentile`` keep every distinct value of a group in one buffer. Here a mergeable sketch
brackets each quantile first; the second scan only counts what lies below a bracket and ranks the
values inside it, about a thousandth of the rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.operators.ordered import running
from wattsift.session import written

ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, keys: list[str], column: str, probs: list[float], name: str = "quantile",
    accuracy: int = ACCURACY, slots: int = 64, reach: float = 5.0,
) -> DataFrame:
    """One row per group and probability: keys, ``prob``, ``n``, ``name``.

    The sketch is off by at most n / accuracy ranks and brackets reach ``reach`` times as far. Groups too
    small for that to cover the neighbouring rank are bracketed whole. Should a rank still lie outside
    its bracket, its group is read once more with a bracket that reaches to the end of that side.
    """
    rows = df.select(*keys, F.col(column).alias("__v"))
    margin = reach / accuracy
    marks = [m for p in probs for m in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count("__v").alias("n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", marks, accuracy).alias("__m"),
    )
    small = F.col("n") * F.lit(margin) < 4 if margin > 0 else F.lit(False)

    def bracket(i: int, p: float):
        return F.struct(
            F.lit(float(p)).alias("prob"),
            F.when(small, F.col("__min")).otherwise(F.col("__m")[2 * i]).alias("low"),
            F.when(small, F.col("__max")).otherwise(F.col("__m")[2 * i + 1]).alias("high"),
        )

    brackets = sketch.select(*keys, "n", F.array(*[bracket(i, p) for i, p in enumerate(probs)]).alias("__b"))
    picked = written(_picked(rows, brackets, keys, slots), "quantiles-picked")
    missed = F.col("__a").isNull() | F.col("__z").isNull()
    found = picked.filter(~missed)
    if not (again := picked.filter(missed)).isEmpty():
        # The counts tell on which side a rank lies, and a bracket that reaches to the end of that side cannot miss it.
        ends = _attach(again, sketch.select(*keys, "__min", "__max"), keys)
        wider = F.struct(
            "prob",
            F.when(F.col("__first") < F.col("__below"), F.col("__min")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("__second") >= F.col("__within"), F.col("__max")).otherwise(F.col("high")).alias("high"),
        )
        widened = ends.groupBy(*keys, "n").agg(F.collect_list(wider).alias("__b"))
        found = found.unionByName(_picked(rows, widened, keys, slots))
    value = F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__part")
    return found.select(*keys, "prob", "n", value.alias(name))


def _picked(rows: DataFrame, brackets: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """Per group and probability the values at both neighbouring ranks, NULL where a rank lies outside of its bracket, and
    how many values are below the bracket and up to its end."""
    # Rows above a bracket drop out, rows below it fold into one count, rows inside fold per value.
    needed = F.filter("__b", lambda b: F.col("__v") <= b["high"])
    counted = (
        _attach(rows, brackets, keys)
        .select(*keys, "n", "__v", F.explode_outer(needed).alias("b"))
        .filter(F.col("b").isNotNull())
        .select(*keys, "n", "b.*", F.when(F.col("__v") >= F.col("b.low"), F.col("__v")).alias("__v"))
        .groupBy(*keys, "n", "prob", "low", "high", "__v")
        .agg(F.count("*").alias("__c"))
    )
    # What is left is small and read twice below, so it is written once instead of scanning twice more.
    counted = written(counted, "quantiles")
    width = F.col("high") - F.col("low")
    place = F.when(width > 0, F.floor((F.col("__v") - F.col("low")) / width * slots)).otherwise(F.lit(0))
    slot = F.when(F.col("__v").isNull(), F.lit(-1)).otherwise(place)
    ranked = running(counted, [*keys, "prob"], ["__v"], {"__upto": F.col("__c")}, slot)

    # A value covers the 0-based ranks [upto - count, upto).
    position = (F.col("n") - 1) * F.col("prob")
    first = F.floor(position)
    second = F.least(first + 1, F.col("n") - 1)

    def at(rank):
        covers = (F.col("__upto") - F.col("__c") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(covers, F.col("__v")))

    return ranked.groupBy(*keys, "prob", "n", "low", "high").agg(
        at(first).alias("__a"), at(second).alias("__z"), F.max(position - first).alias("__part"),
        F.max(first).alias("__first"), F.max(second).alias("__second"),
        F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__c"))), F.lit(0)).alias("__below"),
        F.sum("__c").alias("__within"),
    )


def _attach(left: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row per group back to its rows; NULL is a group too, and no keys at all are one group."""
    if not keys:
        one = F.lit(1).alias("__one")
        return left.select("*", one).join(per_group.select("*", one), "__one").drop("__one")
    renamed = per_group.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"__k_{k}" for k in keys])
