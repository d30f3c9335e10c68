"""Row-level columns of an execution table; the same functions serve batch and stream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.functions import metrics as M
from wattsift.schemas import CATEGORY_BANDS, ENERGY_FLOOR_J, ROUNDING, THROTTLE_MHZ, TOKEN_CAP


def with_net_energy(df: DataFrame, floor: float = ENERGY_FLOOR_J) -> DataFrame:
    return df.withColumn(
        "net_energy_j", M.net_energy(F.col("gross_energy_j"), F.col("idle_w"), F.col("latency_s"), floor)
    )


def with_power(df: DataFrame) -> DataFrame:
    """Net and gross power: published tables use either, so both are kept."""
    latency = F.col("latency_s")
    return df.withColumns(
        {
            "power_net_w": M.per_unit(F.col("net_energy_j"), latency),
            "power_gross_w": M.per_unit(F.col("gross_energy_j"), latency),
        }
    )


def with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens_per_s", M.per_unit(F.col("output_tokens").cast("double"), F.col("latency_s")))


def with_efficiency(df: DataFrame, scale: float = 1.0, name: str = "lpw") -> DataFrame:
    value = M.efficiency(F.col("q_ped"), F.col("net_energy_j"), F.col("latency_s"), scale)
    return df.withColumn(name, value)


def with_metrics(df: DataFrame) -> DataFrame:
    return df.transform(with_net_energy).transform(with_power).transform(with_rate).transform(with_efficiency)


def impute_energy(df: DataFrame, watts: float) -> DataFrame:
    """Unmeasured energy becomes latency x an assumed constant power, flagged."""
    assumed = F.col("latency_s") * F.lit(watts)
    return df.withColumns(
        {
            "is_imputed": F.col("net_energy_j").isNull() & F.col("latency_s").isNotNull(),
            "net_energy_j": F.coalesce("net_energy_j", assumed),
        }
    )


def with_throttled(df: DataFrame, limit: float = THROTTLE_MHZ) -> DataFrame:
    return df.withColumn("throttled", M.throttled(F.col("cpu_freq_mhz"), limit))


def cap_tokens(df: DataFrame, limit: int = TOKEN_CAP, column: str = "output_tokens") -> DataFrame:
    """Cap a token count, or cut a token array, and flag the rows that reached the cap."""
    value = F.col(column)
    if df.schema[column].dataType.typeName() == "array":
        capped, size = F.slice(value, 1, limit), F.size(value)
    else:
        capped, size = F.least(value, F.lit(limit)), value
    return df.withColumns({"cap_hit": size >= F.lit(limit), column: capped})


def round_columns(df: DataFrame, spec: dict[str, int] = ROUNDING) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in spec.items() if c in df.columns})


def tag(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def band_category(position: Column, bands: list[tuple[int, str]] = CATEGORY_BANDS) -> Column:
    """Category of a 0-based position; the last band takes everything past it."""
    *inner, (_, last) = bands
    chain = None
    for upper, label in inner:
        test = position < F.lit(upper)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return F.lit(last) if chain is None else chain.otherwise(F.lit(last))
