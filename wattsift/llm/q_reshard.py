"""Query op6: all documents from 12 content-addressed shards to 16 of near equal bytes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.registry import query, table
from wattsift.llm.reshard import reshard


@query("op6_reshard")
def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
