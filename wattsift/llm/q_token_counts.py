"""Query op11: tokens of every document."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattsift.llm.registry import query, table
from wattsift.llm.token_counts import count_tokens


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of documents, by the byte-pair vocabulary of 32,000 pieces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
