"""Query op8: secrets in every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.registry import query, table
from wattsift.llm.secrets import RULES, Rule, find_secrets

BASE = ("assign", "access", "hex")


def _found(rank: int, rule: Rule) -> str:
    regex = "'" + rule.regex.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, start, start + len(m[i]) AS stop, len(s[i]) AS size FROM (
    SELECT doc_id, m, s, i, coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0)
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(text, {regex}) AS g, regexp_extract_all(text, {regex}) AS m,
        regexp_extract_all(text, {regex}, {rule.group}) AS s FROM documents)))
  WHERE size >= {rule.least}"""


SQL = f"""
WITH found AS ({" UNION ALL ".join(_found(k, r) for k, r in enumerate(RULES))}),
named AS (SELECT *, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)) AS span FROM found),
sums AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    string_agg(span, ',' ORDER BY start, rank, stop) FILTER (rank < {len(BASE)}) AS base,
    string_agg(span, ',' ORDER BY start, rank, stop) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN sums USING (doc_id)
"""


@query("op8_secrets", SQL)
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    of_kind = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return docs.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
