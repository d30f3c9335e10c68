"""Summaries and comparisons of configurations, platforms and categories."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattsift.functions.metrics import per_unit
from wattsift.operators.quantiles import exact_quantiles
from wattsift.session import written


def summarise(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and sample deviation of latency, and the published means, per group.

    ``lpw_mean`` is the mean of the rows' ratios, not a ratio of means.
    """
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("latency_s").alias("latency_mean"),
        F.stddev_samp("latency_s").alias("latency_std"),
        F.avg("net_energy_j").alias("net_energy_mean"),
        F.avg("power_net_w").alias("power_mean"),
        F.avg("q_ped").alias("q_ped_mean"),
        F.avg("lpw").alias("lpw_mean"),
        F.avg("tokens_per_s").alias("tokens_per_sec"),
    )


def means(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def ranges(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    low_high = [f(c).alias(f"{p}_{c}") for c in columns for f, p in ((F.min, "min"), (F.max, "max"))]
    return df.groupBy(*keys).agg(*low_high)


def _partials(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums and counts at the finest grain, so that grouping sets expand groups and not rows."""
    parts = [f(c).alias(f"__{p}_{c}") for c in columns for f, p in ((F.sum, "s"), (F.count, "c"))]
    return df.groupBy(*keys).agg(F.count("*").alias("__n"), *parts)


def _merged(columns: list[str]) -> list[Column]:
    return [F.sum("__n").alias("n")] + [
        F.try_divide(F.sum(f"__s_{c}"), F.sum(f"__c_{c}")).alias(f"avg_{c}") for c in columns
    ]


def rollup_report(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overall and per-key means in one pass over the rows; ``level`` 0 is the finest grain."""
    partial = _partials(df, keys, columns)
    return partial.rollup(*keys).agg(F.grouping_id().cast("bigint").alias("level"), *_merged(columns))


def cube_report(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    partial = _partials(df, keys, columns)
    return partial.cube(*keys).agg(F.grouping_id().cast("bigint").alias("level"), *_merged(columns))


def sets_report(df: DataFrame, keys: list[str], sets: list[list[str]], columns: list[str]) -> DataFrame:
    partial = _partials(df, keys, columns)
    grouped = partial.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().cast("bigint").alias("level"), *_merged(columns))


def pivot_config(df: DataFrame, rows: str, config: str, values: list[str], metrics: list[str]) -> DataFrame:
    """One row per ``rows`` value and a mean per (configuration, metric); values are listed, so no extra job."""
    return df.groupBy(rows).pivot(config, values).agg(*[F.avg(m).alias(m) for m in metrics])


def _of(config: str, value: str, metric: str) -> Column:
    return F.avg(F.when(F.col(config) == value, F.col(metric)))


def paired(df: DataFrame, key: str, config: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """Both configurations of each key side by side, keys measured under both only.

    One aggregate in place of a self join: repeated runs of a key are averaged, never multiplied.
    """
    sides = [_of(config, v, m).alias(f"{m}_{s}") for m in metrics for s, v in (("a", a), ("b", b))]
    both = (F.count_if(F.col(config) == a) > 0) & (F.count_if(F.col(config) == b) > 0)
    return df.groupBy(key).agg(*sides, both.alias("__both")).filter("__both").drop("__both")


def paired_statistics(pairs: DataFrame, metric: str) -> DataFrame:
    """Mean, median and sample deviation of a - b, mean ratio, and the share where a exceeds b.

    The pairs are written once, three numbers each, as the moments and the exact median read them several times.
    """
    a, b = F.col(f"{metric}_a"), F.col(f"{metric}_b")
    rows = pairs.select((a - b).alias("diff"), F.try_divide(a, b).alias("ratio"), (a > b).cast("double").alias("wins"))
    rows = written(rows, "pairs")
    moments = rows.agg(
        F.count("diff").alias("n_pairs"),
        F.avg("diff").alias("diff_mean"),
        F.stddev_samp("diff").alias("diff_std"),
        F.avg("ratio").alias("ratio_mean"),
        F.avg("wins").alias("share_a_above_b"),
    )
    median = exact_quantiles(rows, [], "diff", [0.5], "diff_median").select("diff_median")
    one = F.lit(1).alias("__one")
    return moments.select("*", one).join(median.select("*", one), "__one").drop("__one")


def fold_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Runs as one row per key: count, and totals of latency, energy and 1 / (energy x latency), each with the
    number of runs that have it.

    Quality is one value per rated item, so efficiency follows from these totals after the runs are
    folded: a popular item shrinks on the map side before it meets its quality.
    """
    per_js = per_unit(F.lit(1.0), F.col("net_energy_j") * F.col("latency_s"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.sum("latency_s").alias("latency_total"),
        F.count("latency_s").alias("latency_runs"),
        F.sum("net_energy_j").alias("energy_total"),
        F.count("net_energy_j").alias("energy_runs"),
        F.sum(per_js).alias("per_js_total"),
        F.count(per_js).alias("per_js_runs"),
    )


def ratio_table(folded: DataFrame, keys: list[str], config: str, base: str, other: str) -> DataFrame:
    """Ratios of configuration means over folded runs with ``q_ped``; percentages are relative to ``base``."""

    def mean(value: str, parts: tuple[Column, Column]) -> Column:
        chosen = F.col(config) == value
        total, runs = parts
        return F.try_divide(F.sum(F.when(chosen, total)), F.sum(F.when(chosen, runs)))

    def rated(runs: str) -> Column:
        return F.when(F.col("q_ped").isNotNull(), F.col(runs))

    latency, energy = ((F.col(f"{c}_total"), F.col(f"{c}_runs")) for c in ("latency", "energy"))
    quality = F.col("q_ped") * F.col("runs"), rated("runs")
    lpw = F.col("q_ped") * F.col("per_js_total"), rated("per_js_runs")
    return folded.groupBy(*keys).agg(
        F.try_divide(mean(other, latency), mean(base, latency)).alias("latency_ratio"),
        (F.try_divide(mean(other, energy) - mean(base, energy), mean(base, energy)) * 100.0).alias(
            "energy_pct_of_base"
        ),
        (mean(other, quality) - mean(base, quality)).alias("quality_diff"),
        F.try_divide(mean(other, lpw), mean(base, lpw)).alias("lpw_ratio"),
    )


def ratio_of_ratios(df: DataFrame, regime: str, on: str, off: str, config: str, a: str, b: str, metric: str) -> DataFrame:
    """a/b under each regime, and how many times larger it is under ``off``."""

    def ratio(r: str) -> Column:
        def mean(value: str) -> Column:
            return F.avg(F.when((F.col(regime) == r) & (F.col(config) == value), F.col(metric)))

        return F.try_divide(mean(a), mean(b))

    both = df.agg(ratio(on).alias("ratio_on"), ratio(off).alias("ratio_off"))
    return both.withColumn("overstatement", F.try_divide("ratio_off", "ratio_on"))


def winner(df: DataFrame, platform: str, config: str, metric: str, reference) -> DataFrame:
    """Best configuration per platform and whether it differs from the reference platform's."""
    per_config = df.groupBy(platform, config).agg(F.avg(metric).alias("__m"))
    best = per_config.groupBy(platform).agg(
        F.max_by(config, F.struct("__m", config)).alias("winner"), F.max("__m").alias(f"{metric}_best")
    )
    # One row per platform is left here, so a window over all of them is a window over a dimension.
    of_reference = F.max(F.when(F.col(platform) == F.lit(reference), F.col("winner"))).over(Window.partitionBy())
    return best.withColumn("reversed", F.col("winner") != of_reference)


def histogram(df: DataFrame, keys: list[str], column: str, low: float, high: float, bins: int) -> DataFrame:
    """Fixed-width bins; bin 0 lies below ``low`` and bin ``bins + 1`` at or above ``high``."""
    slot = F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("bigint")
    rows = df.filter(F.col(column).isNotNull())
    return rows.groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("n"))


def relative_to(summary: DataFrame, within: str, config: str, base: str, metric: str) -> DataFrame:
    """Each summary row's metric over that of the base configuration in the same platform."""
    base_value = F.max(F.when(F.col(config) == base, F.col(metric))).over(Window.partitionBy(within))
    return summary.withColumn(f"{metric}_vs_base", F.try_divide(F.col(metric), base_value))


def ranked(summary: DataFrame, metric: str, *tie: str) -> DataFrame:
    """Dense rank over an aggregated table: one row per configuration, however many runs are behind it."""
    order = Window.orderBy(F.desc(metric), *tie)
    return summary.withColumn("rank", F.dense_rank().over(order).cast("bigint"))


def bandwidth_table(summary: DataFrame, platforms: DataFrame, baseline) -> DataFrame:
    """Memory-bandwidth and latency ratios of every platform against a baseline platform."""
    specs = summary.join(platforms, "platform")
    at_base = F.col("platform") == F.lit(baseline)
    per_config = Window.partitionBy("precision")

    def base(c: str) -> Column:
        return F.max(F.when(at_base, F.col(c))).over(per_config)

    ratios = specs.select(
        "platform",
        "precision",
        F.try_divide(F.col("mem_bw_gbs"), base("mem_bw_gbs")).alias("bw_ratio"),
        F.try_divide(base("latency_mean"), F.col("latency_mean")).alias("speed_ratio"),
    )
    return ratios.withColumn("speed_per_bw", F.try_divide("speed_ratio", "bw_ratio"))
