"""The nested summary document: platform -> {platform, results: precision -> stats or note}."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.schemas import SUMMARY

STATS = [
    "n", "latency_mean", "latency_std", "net_energy_mean", "power_mean", "q_ped_mean", "lpw_mean", "tokens_per_sec",
]

def read_summary(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One row per (platform, precision); cells without stats keep their note.

    The file is lines of one platform each, or with ``whole`` one document.
    """
    text = spark.read.text(path, wholetext=whole)
    document = text.select(F.from_json("value", SUMMARY).alias("doc"))
    platforms = document.select(F.explode("doc").alias("platform_key", "entry"))
    cells = platforms.select(
        "platform_key", F.col("entry.platform").alias("platform"), F.explode("entry.results").alias("precision", "s")
    )
    return cells.select("platform_key", "platform", "precision", *[f"s.{c}" for c in STATS], "s.note")


def summary_lines(summary: DataFrame) -> DataFrame:
    """One JSON text row per platform, its precisions in order: as many lines as platforms, however many there are."""
    stats = F.struct(*STATS, "note")
    per_platform = summary.groupBy("platform_key").agg(
        F.max("platform").alias("platform"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("precision", stats.alias("stats"))))).alias("results"),
    )
    entry = F.create_map("platform_key", F.struct("platform", "results"))
    return per_platform.select(F.to_json(entry).alias("value"))


def summary_document(summary: DataFrame) -> DataFrame:
    """All platforms in one JSON object, keys in order: an explicit export of a table that fits one row."""
    inside = F.expr("substring(value, 2, length(value) - 2)")
    joined = F.array_join(F.array_sort(F.collect_list(inside)), ",")
    return summary_lines(summary).agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("value"))


def write_summary(summary: DataFrame, path: str) -> None:
    summary_lines(summary).write.text(path)
