"""Query op2: license notices in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.licenses import find_licenses
from wattsift.llm.registry import query, table


@query("op2_licenses")
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"))
    exact = F.filter("licenses", lambda s: (s["missing"] == 0) & (s["added"] == 0))
    return docs.select(
        "doc_id",
        F.size("licenses").cast("bigint").alias("n_licenses"),
        F.size(exact).cast("bigint").alias("n_exact"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["license"]))), ",").alias("names"),
        F.array_join(F.transform("licenses", span), ",").alias("spans"),
    )
