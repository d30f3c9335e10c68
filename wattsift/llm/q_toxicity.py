"""Query op7: the toxicity of every document."""

from pyspark.sql import DataFrame, SparkSession

from wattsift.llm.registry import query, table
from wattsift.llm.toxicity import score


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
