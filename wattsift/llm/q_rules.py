"""Query op4: the quality rules on every document."""

from pyspark.sql import DataFrame, SparkSession

from wattsift.llm.registry import query, table
from wattsift.llm.rules import judge


@query("op4_rules")
def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).drop("text")
