"""Query op5: how often the mix takes each document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.mixing import mix
from wattsift.llm.registry import query, table

DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2}
SHARE, MAX_EPOCHS, SEED = (8, 10), 3, 7


def domain_of(source: str = "source"):
    """Sources src0, src1, .. in four domains by their number; others in a domain without a name."""
    number = F.regexp_extract(source, "^src([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.substring(number, -4, 4).cast("int") % 4).cast("string"))).otherwise(F.lit(""))


def weights_of() -> dict:
    def by(column: str, table: dict[str, int]):
        out = F.lit(1)
        for name, weight in table.items():
            out = F.when(F.col(column) == name, F.lit(weight)).otherwise(out)
        return out

    return {"domain": by("domain", DOMAIN_WEIGHTS), "lang": by("lang", LANG_WEIGHTS), "source": F.lit(1)}


def _case(column: str, table: dict[str, int]) -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END AS BIGINT)"


def _fill(children: str, parent: str, child: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT *, CASE WHEN is_full THEN cap
    ELSE least(cap, CAST(floor(CAST(budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0) AS DOUBLE)
      / (sum(weight) OVER ({part}) - coalesce(sum(weight) FILTER (is_full) OVER ({part}), 0)) * weight) AS BIGINT)) END AS given
  FROM (
    SELECT *, coalesce(sum(cap) OVER before, 0) + CAST(cap AS DOUBLE) / weight
      * (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER before, 0)) <= budget AS is_full
    FROM {children}
    WINDOW before AS ({part} ORDER BY CAST(cap AS DOUBLE) / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


SQL = rf"""
WITH rows_ AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '^src([0-9]+)$', 1) <> ''
      THEN concat('d', CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS BIGINT) % 4) ELSE '' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS cap
  FROM rows_ GROUP BY ALL),
tops AS (
  SELECT domain, sum(cap) AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS weight,
    (SELECT CAST(sum(tokens) * {SHARE[0]} // {SHARE[1]} AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY domain),
top_given AS ({_fill("tops", "", "domain")}),
mids AS (
  SELECT l.domain, l.lang, sum(l.cap) AS cap, {_case("l.lang", LANG_WEIGHTS)} AS weight, any_value(t.given) AS budget
  FROM leaves l JOIN top_given t USING (domain) GROUP BY l.domain, l.lang),
mid_given AS ({_fill("mids", "domain", "lang")}),
lows AS (
  SELECT l.*, CAST(1 AS BIGINT) AS weight, m.given AS budget
  FROM leaves l JOIN (SELECT domain, lang, given FROM mid_given) m USING (domain, lang)),
low_given AS ({_fill("lows", "domain, lang", "source")}),
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS full_epochs,
    CASE WHEN tokens > 0 THEN given % tokens ELSE given END AS rest FROM low_given),
keyed AS (
  SELECT r.*, p.full_epochs, p.rest, md5(concat('{SEED}:', CAST(p.full_epochs AS BIGINT), ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
  FROM rows_ r JOIN plan p USING (domain, lang, source)),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed)
SELECT doc_id, domain AS mix_domain, lang AS mix_lang, source AS mix_source,
  CAST(full_epochs + CASE WHEN full_epochs < {MAX_EPOCHS} AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM upto
"""


@query("op5_mixing", SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, domain_of(), weights_of(), SHARE, MAX_EPOCHS, SEED)
    return mixed.select("doc_id", "mix_domain", "mix_lang", "mix_source", "copies")
