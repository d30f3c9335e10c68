"""Query op10: the quality of every document."""

from pyspark.sql import DataFrame, SparkSession

from wattsift.llm.quality import classify
from wattsift.llm.registry import query, table


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text", "lang", "source")
