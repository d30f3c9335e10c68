"""Rating panels: means per dimension, hybrid quality, outstanding ratings, blind sheets."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.schemas import AI_RATERS, DIMENSIONS, HUMAN_RATERS, HUMAN_WEIGHT


def _mean(kind: str, extra: Column | None = None) -> Column:
    test = F.col("rater_kind") == kind
    return F.avg(F.when(test if extra is None else test & extra, F.col("score")))


def panel_means(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Both panels per item and dimension in one aggregate (no join of two)."""
    return scores.groupBy(*keys, "dim").agg(
        _mean("human").alias("human_mean"),
        _mean("ai").alias("ai_mean"),
        F.count_if(F.col("rater_kind") == "human").alias("n_human"),
        F.count_if(F.col("rater_kind") == "ai").alias("n_ai"),
    )


def weighted(human: Column, ai: Column, w_human: float | Column = HUMAN_WEIGHT) -> Column:
    """Hybrid score; NULL when either panel is empty."""
    w = w_human if isinstance(w_human, Column) else F.lit(w_human)
    return w * human + (F.lit(1.0) - w) * ai


def hybrid(panel: DataFrame, w_human: float = HUMAN_WEIGHT) -> DataFrame:
    return panel.withColumn("weighted", weighted(F.col("human_mean"), F.col("ai_mean"), w_human))


def q_ped(hybrid_rows: DataFrame, keys: list[str], dims: int = len(DIMENSIONS)) -> DataFrame:
    """Mean of the weighted dimensions, for items where all of them are present."""
    return (
        hybrid_rows.groupBy(*keys)
        .agg(F.avg("weighted").alias("q_ped"), F.count("weighted").alias("n_dims"))
        .filter(F.col("n_dims") == dims)
    )


def quality_wide(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Both panel means of every dimension side by side: one shuffle straight from the scores."""
    means = [_mean(kind, F.col("dim") == d).alias(f"{kind}_{d}") for d in DIMENSIONS for kind in ("human", "ai")]
    return scores.groupBy(*keys).agg(*means)


def quality_of(w_human: float | Column = HUMAN_WEIGHT) -> Column:
    """Q over ``quality_wide`` columns; NULL unless every dimension has both panels."""
    parts = [weighted(F.col(f"human_{d}"), F.col(f"ai_{d}"), w_human) for d in DIMENSIONS]
    return reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts)))


def quality(scores: DataFrame, keys: list[str], w_human: float = HUMAN_WEIGHT) -> DataFrame:
    wide = quality_wide(scores, keys)
    return wide.select(*keys, quality_of(w_human).alias("q_ped")).filter(F.col("q_ped").isNotNull())


def weight_sweep(scores: DataFrame, keys: list[str], weights: list[float]) -> DataFrame:
    """Quality of every item under each human weight; the grid is expanded after aggregation."""
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("w_human")
    wide = quality_wide(scores, keys).select("*", grid)
    return wide.select(*keys, "w_human", quality_of(F.col("w_human")).alias("q_ped")).filter(
        F.col("q_ped").isNotNull()
    )


def wide_rubric(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rater's sheet: the four dimensions as columns and their plain mean."""
    wide = scores.groupBy(*keys).pivot("dim", DIMENSIONS).agg(F.max("score"))
    total = reduce(lambda a, b: a + b, [F.col(d) for d in DIMENSIONS])
    return wide.withColumn("q_single", total / F.lit(float(len(DIMENSIONS))))


def long_rubric(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Sheets back to one row per score; blank cells are no score."""
    rows = wide.unpivot(ids, DIMENSIONS, "dim", "score")
    return rows.filter(F.col("score").isNotNull())


def outstanding(
    scores: DataFrame, keys: list[str], items: DataFrame | None = None, roster: int = HUMAN_RATERS + AI_RATERS
) -> DataFrame:
    """Ratings still to be done: every roster member not yet seen on an item.

    The raters seen are folded per item (at most ``roster`` of them) and subtracted from the roster,
    so neither a product of raters and items nor an anti join of it is shuffled. ``items`` may name items
    that nobody has rated yet, one row each; without it they are the items of ``scores``, in one aggregate.
    """
    known = F.when(F.col("rater_id").between(0, roster - 1), F.col("rater_id"))
    seen = scores.groupBy(*keys).agg(F.collect_set(known).alias("__seen"))
    everyone = F.sequence(F.lit(0).cast("bigint"), F.lit(roster - 1).cast("bigint"))
    none_yet = F.array().cast("array<bigint>")
    missing = F.array_except(everyone, F.coalesce("__seen", none_yet))
    asked = seen if items is None else items.select(*keys).join(seen, keys, "left")
    return asked.select(*keys, F.explode(missing).alias("rater_id"))


def blind_sheet(df: DataFrame, item: str, config: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """A sheet without the configuration, ordered by a salted hash, and its key table."""
    blind_id = F.md5(F.concat_ws("|", F.lit(salt), F.col(item).cast("string"), F.col(config)))
    keyed = df.withColumn("blind_id", blind_id)
    blanks = [F.lit(None).cast("int").alias(d) for d in DIMENSIONS]
    shown = [c for c in df.columns if c not in (item, config)]
    sheet = keyed.select("blind_id", *shown, *blanks, F.lit(None).cast("string").alias("Notes"))
    return sheet, keyed.select("blind_id", item, config)


def unblind(sheet: DataFrame, key: DataFrame) -> DataFrame:
    return sheet.join(key, "blind_id").drop("blind_id")
