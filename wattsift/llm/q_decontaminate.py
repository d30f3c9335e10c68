"""Query op1: every document against all benchmark items."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.decontaminate import find_contamination
from wattsift.llm.frames import sql_ascii_lower
from wattsift.llm.registry import query, table

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({sql_ascii_lower("text")}, {WORDS}), []) AS w FROM documents),
i AS (
  SELECT item_id, coalesce(regexp_extract_all({sql_ascii_lower("text")}, {WORDS}), []) AS w FROM benchmark
  WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM sized)),
dw AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM d JOIN (SELECT DISTINCT k FROM sized) ON len(w) >= k)),
hits AS (SELECT doc_id, item_id, p, k FROM dw JOIN iw USING (k, s)),
words_hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id),
item_hits AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN item_hits USING (doc_id)
"""


@query("op1_decontaminate", SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
