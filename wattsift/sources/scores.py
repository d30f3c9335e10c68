"""Completed scoring sheets, one folder per rater kind."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.operators.panel import long_rubric
from wattsift.schemas import DIMENSIONS, SCORING_SHEET
from wattsift.sources.files import write_csv
from wattsift.sources.quoted import read_quoted


def read_scores(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Sheets of one kind of rater as long scores; blank cells are no score. Columns are found by name."""
    wide = read_quoted(spark, path, SCORING_SHEET)
    ids = ["item_id", "precision", "rater_id"]
    rows = long_rubric(wide.select(*ids, *DIMENSIONS), ids)
    return rows.select(*ids, F.lit(kind).alias("rater_kind"), "dim", F.col("score").cast("bigint").alias("score"))


def write_scores(wide: DataFrame, path: str) -> None:
    columns = ["item_id", "precision", "rater_id", *DIMENSIONS]
    write_csv(wide.select(*columns, F.lit(None).cast("string").alias("Notes")), path)
