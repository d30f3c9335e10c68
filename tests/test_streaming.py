"""Streams against their batch forms, over several micro-batches and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import collected
from wattsift.operators.power import counter_delta
from wattsift.streaming import event_time, jobs
from wattsift.streaming import operators as S
from wattsift.streaming.first_copies import block_filter, counts, first_copies, possible

START = dt.datetime(2024, 1, 1)
POWER = "device long, sample_id long, ts timestamp_ntz, counter_kwh double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def readings(rows):
    return rows(POWER, *[(i % 3 if i % 5 else 0, i, at(i * 7), float(i * i)) for i in range(300)])


def arrive(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_each_file_is_ingested_once(spark, readings, tmp_path):
    folder, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for low in (0, 100, 200):
        arrive(readings.filter(F.col("sample_id").between(low, low + 99)), folder)
        out = jobs.run_available(jobs.ingest(spark, folder, readings.schema), sink, checkpoint)
        assert out.count() == low + 100
    again = jobs.run_available(jobs.ingest(spark, folder, readings.schema), sink, checkpoint)
    assert collected(again) == collected(readings)


STEPS = ["device", "sample_id", "delta_kwh", "elapsed_s"]


def steps_after(spark, parts, tmp_path, delay_s):
    """The outcome after each part has arrived."""
    folder, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for part in parts:
        arrive(part, folder)
        yield event_time.delta_stream(jobs.ingest(spark, folder, part.schema), delay_s, out, checkpoint)


def tally(outcome):
    return tuple(outcome.counts().first())


@pytest.mark.parametrize("delay_s", (0, 600, 10**7))
def test_delta_stream_equals_batch(spark, readings, tmp_path, delay_s):
    parts = [readings.filter(F.col("sample_id").between(*ids)) for ids in ((0, 39), (40, 199), (200, 299))]
    seen = 0
    for part, out in zip(parts, steps_after(spark, parts, tmp_path, delay_s)):
        seen += part.count()
        so_far = readings.filter(F.col("sample_id") < seen)
        assert collected(out.all(), *STEPS) == collected(counter_delta(so_far), *STEPS)
        assert out.open.count() == so_far.filter(F.col("ts") >= at((seen - 1) * 7) - dt.timedelta(seconds=delay_s)).count()
    assert tally(out) == (300, 300, 0, 0)


def test_shuffled_arrivals_give_the_steps_of_the_batch(spark, readings, tmp_path):
    """Rows come up to 90 readings after their time; the delay covers that, so none is late."""
    arrival = F.col("sample_id") + F.pmod(F.xxhash64("sample_id"), F.lit(90))
    parts = [readings.filter(F.floor(arrival / 60) == k) for k in range(7)]
    for out in steps_after(spark, parts, tmp_path, 90 * 7 * 60):
        pass
    assert collected(out.all(), *STEPS) == collected(counter_delta(readings), *STEPS)
    assert 0 < out.open.count() <= 91  # only the last readings wait
    assert tally(out) == (300, 300, 0, 0)
    final = collected(out.final, *STEPS)
    assert set(final) <= set(collected(counter_delta(readings), *STEPS))


def test_readings_that_come_late_or_without_a_time_are_set_aside(spark, rows, tmp_path):
    row = lambda k: (1, k, at(k), float(k))
    parts = [rows(POWER, row(1), row(3)), rows(POWER, row(2), row(4), (1, 9, None, 9.0)), rows(POWER, row(5))]
    outs = list(steps_after(spark, parts, tmp_path / "patient", 600))
    assert collected(outs[0].all(), "sample_id", "delta_kwh") == [(1, None), (3, 2.0)]
    assert collected(outs[2].all(), "sample_id", "delta_kwh") == [(1, None), (2, 1.0), (3, 1.0), (4, 1.0), (5, 1.0)]
    assert tally(outs[2]) == (6, 5, 0, 1)
    hasty = list(steps_after(spark, parts, tmp_path / "hasty", 0))[2]
    assert collected(hasty.all(), "sample_id", "delta_kwh") == [(1, None), (3, 2.0), (4, 1.0), (5, 1.0)]
    assert tally(hasty) == (6, 4, 1, 1)
    assert collected(hasty.aside("late"), "sample_id", "batch") == [(2, 1)]
    assert collected(hasty.aside("untimed"), "sample_id") == [(9,)]


def test_a_batch_that_is_done_again_changes_nothing(spark, readings, tmp_path):
    """A batch that failed before its commit runs again, over what it had written."""
    import shutil

    parts = [readings.filter("sample_id < 100"), readings.filter("sample_id >= 100")]
    for out in steps_after(spark, parts, tmp_path, 3600):
        pass
    before = collected(out.all(), *STEPS), tally(out)
    shutil.rmtree(f"{tmp_path}/check/commits")
    (tmp_path / "check" / "commits").mkdir()
    again = event_time.delta_stream(jobs.ingest(spark, f"{tmp_path}/in", readings.schema), 3600, f"{tmp_path}/out", f"{tmp_path}/check")
    assert (collected(again.all(), *STEPS), tally(again)) == before


def test_a_stream_without_rows_has_no_steps(spark, readings, tmp_path):
    arrive(readings.limit(0), f"{tmp_path}/in")
    stream = jobs.ingest(spark, f"{tmp_path}/in", readings.schema)
    out = event_time.delta_stream(stream, 60, f"{tmp_path}/out", f"{tmp_path}/check")
    assert out.all().count() == 0 and tally(out) == (0, 0, 0, 0)


WINDOWS = {
    "hours": (lambda r: S.windowed(S.timed(r, "ts", "900 seconds"), "ts", "1 hour", ["device"], [F.count("*").alias("n")]), event_time.fixed("ts", 3600)),
    "sliding": (
        lambda r: S.windowed(S.timed(r, "ts", "900 seconds"), "ts", "2 hours", ["device"], [F.count("*").alias("n")], slide="30 minutes"),
        event_time.fixed("ts", 7200),
    ),
    "sessions": (
        lambda r: S.sessions(S.timed(r, "ts", "900 seconds"), "ts", "10 minutes", ["device"], [F.count("*").alias("n")]),
        event_time.by_session("ts", ["device"]),
    ),
}


@pytest.mark.parametrize("name", WINDOWS)
def test_windows_keep_late_and_read_rows_add_up(spark, readings, tmp_path, name):
    """Rows come in disorder, some beyond the delay, some without a time; what is kept gives the windows of the batch,
    before the end of the collection and after it."""
    build, still_open = WINDOWS[name]
    schema = readings.schema
    odd = readings.withColumn("ts", F.when(F.col("sample_id") % 50 != 7, F.col("ts")))
    arrival = F.col("sample_id") + F.pmod(F.xxhash64("sample_id"), F.lit(6))
    read = 0
    for k in range(3):
        part = odd.filter(F.floor(arrival / 102) == k)
        read += part.count()
        arrive(part, f"{tmp_path}/in")
        stream = jobs.ingest(spark, f"{tmp_path}/in", schema)
        out = event_time.run_windows(stream, "ts", 900, build, still_open, f"{tmp_path}/w")
        kept = event_time.kept_rows(spark, f"{tmp_path}/w/gate", schema)
        columns = ["window_start", "window_end", "device", "n"]
        assert collected(out.all(), *columns) == collected(build(kept), *columns)
        n_read, n_kept, n_late, n_untimed = tally(out)
        assert n_read == read == n_kept + n_late + n_untimed and n_kept == kept.count()
        assert out.aside("late").count() == n_late and out.aside("untimed").count() == n_untimed
    assert n_late > 0 and n_untimed == 6 and out.final.count() > 0


def test_late_rows_are_flagged_and_kept(spark, rows, tmp_path):
    folder, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    schema = "id int, ts timestamp_ntz"
    for part in ([(1, at(0)), (2, at(100))], [(3, at(80)), (4, at(99)), (5, at(200))], [(6, at(150)), (7, at(195))]):
        df = rows(schema, *part)
        arrive(df, folder)
        out = S.late_split(jobs.ingest(spark, folder, df.schema), "ts", 600, sink, checkpoint)
    assert collected(out, "id", "late") == [
        (1, False), (2, False), (3, True), (4, False), (5, False), (6, True), (7, False),
    ]


def test_watermark_drops_what_is_late_and_closes_windows(spark, rows, tmp_path):
    folder, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    schema = "id int, ts timestamp_ntz"
    for part in ([(1, at(0)), (2, at(30)), (3, at(200))], [(4, at(10)), (5, at(190)), (6, at(400))]):
        df = rows(schema, *part)
        arrive(df, folder)
        stream = S.timed(jobs.ingest(spark, folder, df.schema), "ts", "10 minutes")
        windows = S.windowed(stream, "ts", "1 hour", [], [F.count("*").alias("n")])
        out = jobs.run_available(windows, sink, checkpoint)
    # Row 4 came after its window was closed; row 5's window was still open.
    assert collected(out, "window_start", "n") == [(at(0), 2), (at(180), 2)]


def test_dedupe_over_restarts(spark, readings, tmp_path):
    folder, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for upper in (100, 250, 300):
        arrive(readings.filter(F.col("sample_id") < upper), folder)
        stream = S.timed(jobs.ingest(spark, folder, readings.schema), "ts", "30 days")
        out = jobs.run_available(S.dedupe(stream, ["sample_id"]), sink, checkpoint)
    assert collected(out, "sample_id", "counter_kwh") == collected(readings, "sample_id", "counter_kwh")


@pytest.mark.parametrize("expected", (1, 10**6))
def test_first_copies_over_any_time(spark, rows, tmp_path, expected):
    """Repeats come in the same batch, the next one and a year later; with a filter far too small all are compared."""
    schema = "id long, kind string, ts timestamp_ntz, v int"
    year = 365 * 1440
    parts = [
        [(1, "a", at(0), 1), (1, "b", at(0), 2), (None, "a", at(1), 3), (2, None, None, 4), (1, "a", at(9), 1)],
        [(1, "a", at(20), 1), (3, "a", at(21), 5), (None, "a", at(22), 3)],
        [],
        [(1, "b", at(year), 2), (4, "c", at(year), 6), (2, None, at(year), 4), (None, None, at(year), 7)],
    ]
    seen, out = set(), None
    for part in parts:
        arrive(rows(schema, *part), f"{tmp_path}/in")
        stream = jobs.ingest(spark, f"{tmp_path}/in", rows(schema, *parts[0]).schema)
        out = first_copies(stream, ["id", "kind"], f"{tmp_path}/out", f"{tmp_path}/check", expected)
        seen |= {(r[0], r[1], r[3]) for r in part}
        assert collected(out, "id", "kind", "v") == sorted(seen, key=repr)
    n_read, n_new, n_candidates = counts(spark, f"{tmp_path}/out").first()
    assert (n_read, n_new) == (sum(map(len, parts)), len(seen)) and n_candidates >= 4


def test_first_copies_of_a_batch_done_again(spark, readings, tmp_path):
    import shutil

    run = lambda: first_copies(
        jobs.ingest(spark, f"{tmp_path}/in", readings.schema), ["sample_id"], f"{tmp_path}/out", f"{tmp_path}/check", 1000
    )
    for upper in (100, 250, 300):
        arrive(readings.filter(F.col("sample_id") < upper), f"{tmp_path}/in")
        out = run()
    assert collected(out) == collected(readings)
    shutil.rmtree(f"{tmp_path}/check/commits")
    (tmp_path / "check" / "commits").mkdir()
    assert collected(run()) == collected(readings)
    assert tuple(counts(spark, f"{tmp_path}/out").first())[:2] == (650, 300)


def test_the_filter_knows_its_keys_and_few_others(spark):
    keys = spark.range(3000).selectExpr("id", "cast(id % 7 as string) AS s")
    made = block_filter(keys, ["id", "s"], 2)
    others = spark.range(10_000, 13_000).selectExpr("id", "'x' AS s")
    hits = lambda df: possible(df, ["id", "s"], 2, made).filter("maybe").count()
    assert hits(keys) == 3000 and hits(others) < 150
    grown = block_filter(others, ["id", "s"], 2, made)
    assert possible(keys.unionByName(others), ["id", "s"], 2, grown).filter("maybe").count() == 6000


def test_snapshots_return_the_newest_also_without_new_data(spark, readings, tmp_path):
    folder, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))

    def run():
        stream = jobs.ingest(spark, folder, readings.schema)
        return jobs.run_snapshots(stream.groupBy("device").agg(F.count("*").alias("n")), sink, checkpoint)

    arrive(readings.limit(0), folder)
    assert collected(run()) == []
    arrive(readings.filter("sample_id < 100"), folder)
    run()
    arrive(readings.filter("sample_id >= 100"), folder)
    want = collected(readings.groupBy("device").agg(F.count("*").alias("n")))
    assert collected(run()) == want
    assert collected(run()) == want


def test_sessions_split_at_the_gap(spark, rows, tmp_path):
    df = rows("device long, ts timestamp_ntz", (1, at(0)), (1, at(20)), (1, at(60)), (2, at(0)), (1, at(2000)))
    arrive(df, f"{tmp_path}/in")
    stream = S.timed(jobs.ingest(spark, f"{tmp_path}/in", df.schema), "ts", "1 minute")
    out = jobs.run_available(
        S.sessions(stream, "ts", "30 minutes", ["device"], [F.count("*").alias("n")]),
        f"{tmp_path}/out", f"{tmp_path}/check",
    )
    assert collected(out, "device", "window_start", "n") == [(1, at(0), 2), (1, at(60), 1), (2, at(0), 1)]


@pytest.mark.parametrize("name", ["t2_stream_enrichment", "t4_tumbling_power", "t5_sliding_rates", "t6_collection_sessions",
                                  "t9_running_means", "t10_throttle_alarm", "t11_stream_dimension_join"])
def test_a_table_in_many_files_gives_the_rows_of_one(spark, tmp_path_factory, name):
    from wattsift.plans import catalog

    one = "/root/testdata/sf0.001"
    many = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{one}/events.parquet").repartition(3).write.parquet(f"{many}/events.parquet")
    spark.read.parquet(f"{one}/region.parquet").write.parquet(f"{many}/region.parquet")
    run = catalog.queries()[name]
    assert collected(run(spark, str(many))) == collected(run(spark, one))


def test_rows_without_a_time_are_kept(spark, rows):
    from wattsift.plans.streams import halves

    df = rows("id int, ts timestamp_ntz", (1, at(0)), (2, None), (3, at(100)))
    assert [collected(h, "id") for h in halves(df, "ts")] == [[(1,)], [(2,), (3,)]]
    untimed = df.filter("ts IS NULL")
    assert [h.count() for h in halves(untimed, "ts")] == [0, 1]
