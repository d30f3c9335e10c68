"""All queries of this subpackage."""

from wattsift.llm import (  # noqa: F401  (they register)
    q_decontaminate,
    q_hard_negatives,
    q_licenses,
    q_mixing,
    q_ngram_join,
    q_pii,
    q_quality,
    q_reshard,
    q_rules,
    q_secrets,
    q_token_counts,
    q_toxicity,
    q_whitening,
)
from wattsift.llm.registry import QUERIES, TWINS


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(TWINS)
