"""Raw board sensor replies to numbers; the first source that parses wins."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*(-?\d+)\s*$", 1), F.lit("")).try_cast("bigint")


def clock_mhz(reply: Column, sysfs: Column) -> Column:
    """``frequency(n)=<Hz>`` first, plain kHz second."""
    hz = F.nullif(F.regexp_extract(reply, r"^[^=]*=\s*(\d+)\s*(?:=.*)?$", 1), F.lit("")).try_cast("bigint")
    return F.coalesce(F.round(hz / F.lit(1e6), 0), F.round(_digits(sysfs) / F.lit(1e3), 0))


def celsius(reply: Column, sysfs: Column) -> Column:
    """``temp=<C>'C`` first, plain milli-degrees second."""
    shown = F.regexp_extract(reply, r"^[^=]*=\s*(-?\d+(?:\.\d+)?)(?:'C)?\s*(?:=.*)?$", 1)
    return F.coalesce(
        F.nullif(shown, F.lit("")).try_cast("double"),
        F.round(_digits(sysfs) / F.lit(1e3), 1),
    )
