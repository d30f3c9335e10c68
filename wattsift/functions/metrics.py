"""Energy, power, rate and efficiency of one execution."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift.schemas import ENERGY_FLOOR_J, JOULES_PER_KWH, THROTTLE_MHZ


def joules(kwh: Column) -> Column:
    return kwh * F.lit(JOULES_PER_KWH)


def net_energy(gross: Column, idle_w: Column, latency: Column, floor: float = ENERGY_FLOOR_J) -> Column:
    """Energy above idle, floored. ``greatest`` skips NULLs, so missing inputs are kept NULL here."""
    known = gross.isNotNull() & idle_w.isNotNull() & latency.isNotNull()
    return F.when(known, F.greatest(gross - idle_w * latency, F.lit(floor)))


def per_unit(amount: Column, base: Column) -> Column:
    """amount / base, 0.0 where the base is not positive, NULL where either is missing."""
    return F.when(base > 0, amount / base).when(base.isNotNull() & amount.isNotNull(), F.lit(0.0))


def efficiency(quality: Column, energy: Column, latency: Column, scale: float = 1.0) -> Column:
    """Quality per joule-second; NULL while unscored."""
    value = per_unit(quality, energy * latency)
    return value if scale == 1.0 else value * F.lit(scale)


def throttled(freq_mhz: Column, limit: float = THROTTLE_MHZ) -> Column:
    return F.coalesce(freq_mhz < F.lit(limit), F.lit(False))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)
