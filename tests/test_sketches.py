"""Stored sketches merged on reading."""

import pytest
from pyspark.sql import functions as F

from wattsift.operators import sketches as S
from wattsift.session import written

LG = 10


@pytest.fixture(scope="module")
def days(spark):
    n = F.col("id")
    return spark.range(60_000).select(
        (n % 7).alias("day"), F.when(n % 3 == 0, "a").otherwise("b").alias("g"),
        F.when(n % 5 > 0, (n % 9000).cast("string")).alias("v"),
    )


def within(row, exact, lg):
    assert row.at_least <= exact <= row.at_most
    assert row.at_most - row.at_least <= 2 * S.error(lg) * max(row.estimate, exact) * 1.5 + 2


@pytest.mark.parametrize("lg", [LG, S.LG])
def test_merged_days_lie_within_the_stated_error(days, lg):
    stored = written(S.sketch(days, ["day", "g"], "v", lg), "sketches")
    assert stored.count() == 14
    for some in (F.lit(True), F.col("day") < 3):
        want = {r.g: r for r in days.filter(some).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()}
        got = S.distinct(stored.filter(some), ["g"], lg).collect()
        assert {r.g: r.n for r in got} == {g: r.n for g, r in want.items()}
        for r in got:
            within(r, want[r.g].d, lg)


def test_merging_is_one_sketch_of_all(days):
    stored = S.sketch(days, ["day", "g"], "v", LG)
    at_once = S.distinct(S.sketch(days, ["g"], "v", LG), ["g"], LG)
    twice = S.distinct(S.merge(stored.unionByName(stored.filter("day = 1")), ["g", "day"], LG), ["g"], LG)
    assert {r.g: r.estimate for r in twice.collect()} == {r.g: r.estimate for r in at_once.collect()}


def test_shared_values(days):
    stored = S.sketch(days.withColumn("k", F.col("day") % 2), ["day", "k", "g"], "v")
    got = {r.k: r for r in S.shared(stored, ["k"], "g", "a", "b").collect()}
    rows = days.withColumn("k", F.col("day") % 2)
    for k in (0, 1):
        side = lambda g: rows.filter((F.col("k") == k) & (F.col("g") == g) & F.col("v").isNotNull()).select("v")
        within(got[k], side("a").intersect(side("b")).count(), S.LG)


def test_edges(rows):
    none = rows("k int, g string, v string")
    assert S.distinct(S.sketch(none, ["k"], "v"), ["k"]).count() == 0
    df = rows("k int, g string, v string", (1, "a", None), (1, "a", None), (None, "a", "x"), (2, "a", "y"), (2, "b", "y"), (3, "b", "z"))
    got = {r.k: (r.n, r.estimate, r.at_least, r.at_most) for r in S.distinct(S.sketch(df, ["k"], "v"), ["k"]).collect()}
    assert got == {1: (2, 0, 0, 0), None: (1, 1, 1, 1), 2: (2, 1, 1, 1), 3: (1, 1, 1, 1)}
    both = {r.k: r.estimate for r in S.shared(S.sketch(df, ["k", "g"], "v"), ["k"], "g", "a", "b").collect()}
    assert both == {1: 0, None: 0, 2: 1, 3: 0}
