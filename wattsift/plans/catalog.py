"""All registered queries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattsift.plans import files, groups, joins, rows, streams  # noqa: F401  (registers their queries)
from wattsift.plans.registry import PLANS, TWINS, runner


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(plan) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
