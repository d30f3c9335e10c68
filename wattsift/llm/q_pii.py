"""Query op3: personal data in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.pii import find_pii
from wattsift.llm.registry import query, table
from wattsift.llm.tagger import KINDS


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    of_kind = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    base = F.filter("pii", lambda s: ~s["kind"].startswith("likely_"))
    return docs.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
