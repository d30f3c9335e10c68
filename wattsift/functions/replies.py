"""Scores in judge and rubric replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift.functions.text import strip_ws
from wattsift.schemas import DIMENSIONS

_OBJECT = r"(?s)^\{.*\}$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def strict_json(reply: Column) -> Column:
    """The reply as a one-element VARIANT array, NULL unless the whole text is one JSON value.

    ``try_parse_json`` ignores what follows a complete value. Inside an array anything after it is an
    error, except a bracket that closes the array early, which in turn is an error inside an object.
    """
    text = strip_ws(reply)
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"r":'), text, F.lit("}")))
    alone = as_field.isNotNull() & F.try_variant_get(as_item, "$[1]", "string").isNull()
    return F.when(text.rlike(_OBJECT) & alone, as_item)


def whole_number(value: Column, is_text: Column) -> Column:
    """Number as an integer: fractions are cut, quoted numbers must be whole."""
    whole = F.when(value.rlike(_INTEGER), F.trim(value).try_cast("bigint"))
    return F.coalesce(whole, F.when(~is_text, value.try_cast("double").try_cast("bigint")))


def rubric(reply: Column) -> Column:
    """struct of the four integer dimensions, each NULL when absent; all NULL unless the whole reply is one object."""
    parsed = F.from_json(F.when(strict_json(reply).isNotNull(), reply), ", ".join(f"{d} BIGINT" for d in DIMENSIONS))
    return F.struct(*[parsed[d].alias(d) for d in DIMENSIONS])


def valid_score(score: Column) -> Column:
    return F.coalesce(score.between(1, 10), F.lit(False))


def band(score: Column) -> Column:
    return F.when(valid_score(score), F.ceil(score / F.lit(2.0)).cast("bigint"))


def band_label(score: Column) -> Column:
    """The rubric's five score ranges."""
    labels = ["1-2", "3-4", "5-6", "7-8", "9-10"]
    return F.element_at(F.array(*map(F.lit, labels)), band(score).cast("int"))
