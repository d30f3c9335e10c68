"""Prompt ids, samples, corpora and configuration grids."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.operators.ordered import fill_forward, running, top_per_group


def stratified_first(df: DataFrame, stratum: str, order: str, k: int) -> DataFrame:
    return top_per_group(df, [stratum], [F.col(order)], k, F.col(order))


def stratified_hash(df: DataFrame, stratum: str, key: str, k: int, salt: str) -> DataFrame:
    """A repeatable random sample: the first k of each stratum by salted hash."""
    rank = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    return top_per_group(df.withColumn("draw", rank), [stratum], [F.col("draw"), F.col(key)], k, F.col(key))


def concatenate(parts: list[DataFrame], order: str) -> DataFrame:
    """Ordered concatenation: every row keeps its part number and its place in the part."""
    numbered = [p.withColumns({"part": F.lit(i), "pos": F.col(order)}) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return out


def corpus_intersection(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values in both; copies fold on each side before the sides meet."""
    return a.select(column).distinct().intersect(b.select(column).distinct())


def corpus_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).distinct().subtract(b.select(column).distinct())


def grid(rows: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every row under every declared value; the copies are bounded by the declared list."""
    return rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def fits(models: DataFrame, platforms: DataFrame, need: str, have: str, step: float = 4.0, salts: int = 4) -> DataFrame:
    """(model, platform) pairs with need <= have, as an equi join on memory steps.

    A platform is listed once per step up to its capacity and a model has one step, so only pairs
    that fit (or miss within the last step) meet, and a popular model size is spread over the salts.
    """
    levels = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col(have) / F.lit(step)))
    right = platforms.withColumn("__step", F.explode(levels)).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    left = models.withColumns(
        {
            "__step": F.floor(F.col(need) / F.lit(step)),
            "__salt": F.pmod(F.xxhash64(*models.columns), F.lit(salts)).cast("int"),
        }
    )
    pairs = left.join(right, ["__step", "__salt"]).filter(F.col(need) <= F.col(have))
    return pairs.drop("__step", "__salt")


def ranked_capacities(platforms: DataFrame, have: str, step: float = 4.0) -> DataFrame:
    """The platforms with their ``rank`` by capacity, from 1 upwards; equal capacities share the lowest. A NULL capacity
    fits nothing and has no rank."""
    below = _capacities(platforms, have, step).select(F.col("at").alias("__at"), F.col("rank"))
    return platforms.join(below, F.col(have) == F.col("__at"), "left").drop("__at")


def fit_ranks(models: DataFrame, platforms: DataFrame, need: str, have: str, step: float = 4.0) -> DataFrame:
    """Every model with ``first_rank``, the rank of the smallest platform that it fits, and ``n_fit``, how many it fits.

    With the ranked platforms this says all that the pairs of ``fits`` say, in as many rows as there are models: a model
    fits the platforms of its first rank and above. Needs are read off the ordered capacities, the next one as great or
    greater, chunk by chunk of ``step``. A model that fits none, or whose need is NULL, has a NULL rank and n_fit 0.
    """
    sizes = _capacities(platforms, have, step).select(
        (-F.col("at")).alias("at"), F.lit(0).alias("kind"), F.struct(F.col("rank").alias("first_rank"), "n_fit").alias("size")
    )
    needs = models.filter(F.col(need).isNotNull()).select((-F.col(need).cast("double")).alias("at"), F.lit(1).alias("kind"))
    # From the greatest down, and capacities before needs of their size, the last capacity seen is the one that fits.
    series = sizes.unionByName(needs.distinct(), allowMissingColumns=True).withColumn("all", F.lit(1))
    read = fill_forward(series, ["all"], ["at", "kind"], "size", "seen", F.floor(F.col("at") / F.lit(step)))
    found = read.filter(F.col("kind") == 1).select((-F.col("at")).alias("__at"), "seen.first_rank", "seen.n_fit")
    joined = models.join(found, F.col(need).cast("double") == F.col("__at"), "left").drop("__at")
    return joined.withColumn("n_fit", F.coalesce("n_fit", F.lit(0).cast("bigint")))


def _capacities(platforms: DataFrame, have: str, step: float) -> DataFrame:
    """Distinct capacities ``at`` with the rank of the first platform that has it and the number that have as much or more."""
    sizes = platforms.filter(F.col(have).isNotNull()).groupBy(F.col(have).cast("double").alias("at")).agg(F.count("*").alias("n"))
    sizes = sizes.withColumns({"all": F.lit(1), "down": -F.col("at")})
    upto = running(sizes, ["all"], ["at"], {"__upto": F.col("n")}, F.floor(F.col("at") / F.lit(step)))
    both = running(upto, ["all"], ["down"], {"n_fit": F.col("n")}, F.floor(F.col("down") / F.lit(step)))
    return both.select("at", (F.col("__upto") - F.col("n") + 1).alias("rank"), "n_fit")


def distinct_counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows, distinct values and surplus copies per key; copies fold before the keys meet."""
    folded = df.groupBy(*keys, column).agg(F.count("*").alias("__c"))
    return folded.groupBy(*keys).agg(
        F.sum("__c").alias("n"),
        F.count(column).alias("n_distinct"),
        (F.sum("__c") - F.count("*")).alias("n_surplus"),
    )


def approximate_distinct(df: DataFrame, keys: list[str], column: str, error: float = 0.02) -> DataFrame:
    return df.groupBy(*keys).agg(F.approx_count_distinct(column, error).alias("n_distinct_approx"))

