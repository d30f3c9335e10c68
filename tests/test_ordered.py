"""Chunked operators against plain windows, with chunks small enough that every carry matters."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import collected
from wattsift.operators import ordered as O
from wattsift.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def series(spark):
    """A hot key with most rows, sparse keys, gaps longer than a chunk, NULL values and a NULL key."""
    rng = random.Random(5)
    data = []
    for i in range(400):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.5 else float(rng.randint(0, 9))
        data.append((i if i < 200 else i + 500, key, value))
    return spark.createDataFrame(data, "id long, k string, v double").repartition(7)



def chunk():
    return O.id_chunk("id", 10)


def by_id():
    return Window.partitionBy("k").orderBy("id")


def so_far():
    return by_id().rowsBetween(Window.unboundedPreceding, 0)


def test_previous_row(series):
    got = O.previous_row(series, ["k"], ["id"], {"pv": "v", "pid": "id"}, chunk())
    want = series.withColumns({"pv": F.lag("v").over(by_id()), "pid": F.lag("id").over(by_id())})
    assert collected(got, "id", "k", "v", "pv", "pid") == collected(want, "id", "k", "v", "pv", "pid")


def test_fill_forward(series):
    got = O.fill_forward(series, ["k"], ["id"], "v", "seen", chunk())
    want = series.withColumn("seen", F.last("v", ignorenulls=True).over(so_far()))
    assert collected(got, "id", "k", "v", "seen") == collected(want, "id", "k", "v", "seen")


def test_running_totals(series):
    got = O.running(series, ["k"], ["id"], {"n": F.lit(1).cast("long"), "s": F.coalesce("v", F.lit(0.0))}, chunk())
    want = series.withColumns({"n": F.count("*").over(so_far()), "s": F.sum(F.coalesce("v", F.lit(0.0))).over(so_far())})
    assert collected(got, "id", "k", "n", "s") == collected(want, "id", "k", "n", "s")


def test_numbering_without_keys(series):
    got = O.number_rows(series, [], ["id"], "n", chunk())
    assert [r.n for r in got.orderBy("id").collect()] == list(range(1, 401))


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_moving_mean_crosses_blocks(series, block):
    got = O.moving(series, ["k"], ["id"], 3, {"m": F.col("v")}, chunk(), block=block)
    want = series.withColumn("m", F.avg("v").over(by_id().rowsBetween(-2, 0)))
    assert collected(got, "id", "k", "m") == collected(want, "id", "k", "m")


def test_chunks_split_a_hot_key(series):
    """The window's shuffle is by key and chunk, also when the input is already partitioned by the key."""
    plan = O.previous_row(series.repartition("k"), ["k"], ["id"], {"pv": "v"}, chunk())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in text and "__chunk#" in text.split("REPARTITION_BY_COL")[0]


def test_latest_and_top(rows):
    df = rows("k string, t int, v string", ("a", 1, "old"), ("a", 2, "new"), ("b", 5, "only"))
    assert collected(O.latest(df, ["k"], [F.col("t")]), "k", "v") == [("a", "new"), ("b", "only")]
    many = rows("k string, i int", *[("hot" if i % 4 else "cold", i) for i in range(100)])
    got = O.top_per_group(many, ["k"], [F.col("i")], 3, F.col("i"))
    assert collected(got, "k", "i", "position") == [
        ("cold", 0, 1), ("cold", 4, 2), ("cold", 8, 3), ("hot", 1, 1), ("hot", 2, 2), ("hot", 3, 3),
    ]


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_exact_quantiles_match_percentile(spark, accuracy):
    """Coarse sketches make the brackets and the chunked ranking do the work."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 != 1, "rest").alias("k"),
        F.pow(F.rand(3) * 10, F.lit(3)).alias("v"),
    ).withColumn("v", F.when(F.col("v") < 1, 0.5).when(F.col("v") < 900, F.col("v")))
    probs = [0.05, 0.5, 0.75]
    got = exact_quantiles(df, ["k"], "v", probs, "q", accuracy=accuracy, slots=5)
    want = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    found = {(r.k, r.prob): r.q for r in got.collect()}
    expected = {(r.k, p): q for r in want.collect() for p, q in zip(probs, r.q, strict=True)}
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, rel=1e-12)


def test_quantiles_of_tiny_groups(rows):
    df = rows("k string, v double", ("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 7.0), ("c", None))
    got = exact_quantiles(df, ["k"], "v", [0.5], "m")
    assert collected(got, "k", "m") == [("a", 2.5), ("b", 7.0)]


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]])
def test_ranks_outside_their_brackets_are_read_again(spark, probs):
    """A sketch of 4 bins with brackets that reach nowhere misses most ranks; none of them may be wrong or fail."""
    n = F.col("id")
    df = spark.range(4000).select((n % 3).alias("k"), F.when(n % 11 > 0, (n * 7919 % 4001) / 3).alias("v"))
    got = exact_quantiles(df, ["k"], "v", probs, "q", accuracy=4, reach=0.0)
    want = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("w")).collect()
    exact = {(r.k, p): q for r in want for p, q in zip(probs, r.w, strict=True)}
    found = got.collect()
    assert len(found) == len(exact) and got.columns == ["k", "prob", "n", "q"]
    assert all(r.q == pytest.approx(exact[r.k, r.prob], rel=1e-12) for r in found)
    alone = exact_quantiles(df, [], "v", probs, "q", accuracy=4, reach=0.0).collect()
    whole = df.agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("w")).first().w
    assert {r.prob: r.q for r in alone} == pytest.approx(dict(zip(probs, whole, strict=True)))
