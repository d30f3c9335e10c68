"""Judge replies to score, reason and parse_ok columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.functions.replies import strict_json, whole_number
from wattsift.schemas import JUDGE_FALLBACK, JUDGE_FALLBACK_REASON


def parse_judge(df: DataFrame, column: str = "reply", fallback: int = JUDGE_FALLBACK) -> DataFrame:
    """A reply that fails to parse gets the fallback score; there is no range check here.

    Each step is a projection of its own, so that a reply is parsed once and not once per use.
    """
    parsed = df.withColumn("__doc", strict_json(F.col(column)))
    read = parsed.withColumns(
        {
            "__raw": F.try_variant_get("__doc", "$[0].score", "string"),
            "__type": F.schema_of_variant(F.try_variant_get("__doc", "$[0].score", "variant")),
            "__reason": F.try_variant_get("__doc", "$[0].reason", "string"),
        }
    )
    scored = read.withColumn("__score", whole_number(F.col("__raw"), F.coalesce("__type", F.lit("")) == "STRING"))
    ok = F.col("__score").isNotNull()
    return scored.withColumns(
        {
            "score": F.coalesce("__score", F.lit(fallback).cast("bigint")),
            "reason": F.when(ok, F.coalesce("__reason", F.lit(""))).otherwise(F.lit(JUDGE_FALLBACK_REASON)),
            "parse_ok": ok,
        }
    ).drop("__doc", "__raw", "__type", "__reason", "__score")
