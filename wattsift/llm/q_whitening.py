"""Query op12: embeddings along the leading components of their covariance."""

from pyspark.sql import DataFrame, SparkSession

from wattsift.llm.registry import query, table
from wattsift.llm.whitening import RESULTS, whiten


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of embeddings on four whitened components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(rows).select("vec_id", *RESULTS)
