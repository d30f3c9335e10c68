"""Power samples and energy counters: deltas, integration, idle baselines, range and as-of joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.functions.metrics import joules, seconds_between
from wattsift.operators.ordered import fill_forward, previous_row, running, time_chunk
from wattsift.schemas import IDLE_SECONDS

SAMPLE_ORDER = ["ts", "sample_id"]


def counter_delta(power: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Counter step and elapsed seconds since the device's previous reading; NULL on its first."""
    rows = previous_row(
        power, ["device"], SAMPLE_ORDER, {"prev_kwh": "counter_kwh", "prev_ts": "ts"},
        time_chunk("ts") if chunk is None else chunk,
    )
    return rows.withColumns(
        {
            "delta_kwh": F.col("counter_kwh") - F.col("prev_kwh"),
            "elapsed_s": seconds_between(F.col("prev_ts"), F.col("ts")),
        }
    )


def integrate(power: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Trapezoid energy of the watt samples per device."""
    rows = previous_row(
        power, ["device"], SAMPLE_ORDER, {"prev_w": "watts", "prev_ts": "ts"},
        time_chunk("ts") if chunk is None else chunk,
    )
    area = (F.col("watts") + F.col("prev_w")) / 2.0 * seconds_between(F.col("prev_ts"), F.col("ts"))
    return rows.groupBy("device").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("energy_j"), F.count("*").alias("n"))


def idle_baseline(power: DataFrame, windows: DataFrame, seconds: float = IDLE_SECONDS) -> DataFrame:
    """Idle watts per device over its idle window (device, t0, t1); 0.0 where nothing was read in it.

    Readings meet the window in time buckets as long as it: a busy device's other readings fall into buckets without one.
    """
    inside = range_join(windows, power, max(1, int(seconds)), id="ts")
    watts = joules(F.max("counter_kwh") - F.min("counter_kwh")) / F.lit(seconds)
    measured = inside.groupBy("device").agg(watts.alias("__w"))
    idle = F.coalesce("__w", F.lit(0.0)).alias("idle_w")
    return windows.select("device").distinct().join(measured, "device", "left").select("device", idle)


def range_join(executions: DataFrame, power: DataFrame, bucket_s: int, salts: int = 4, id: str = "sample_id") -> DataFrame:
    """Samples with t0 <= ts <= t1 on the same device, one row per (execution, sample).

    Executions are copied into the time buckets they touch, samples fall into one, and the equi join
    runs on (device, bucket, salt): a busy device is spread over its buckets, a busy bucket over the
    salts, by ``id``. A bucket about as long as an execution keeps both the copies and the misses few.
    """
    spread = F.sequence(time_chunk("t0", bucket_s), time_chunk("t1", bucket_s))
    left = executions.withColumn("__bucket", F.explode(spread)).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    right = power.withColumns(
        {
            "__bucket": time_chunk("ts", bucket_s),
            "__salt": F.pmod(F.xxhash64(id), F.lit(salts)).cast("int"),
        }
    )
    joined = left.join(right, ["device", "__bucket", "__salt"])
    return joined.filter(F.col("ts").between(F.col("t0"), F.col("t1"))).drop("__bucket", "__salt")


def asof_join(executions: DataFrame, power: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Counter at or before t0 and t1 of each execution; a reading exactly at t counts.

    Readings and query times are one ordered series per device, filled forward chunk by chunk.
    """
    readings = power.select("device", "ts", F.lit(0).alias("kind"), F.col("sample_id").alias("id"), "counter_kwh")
    times = executions.select(
        "device",
        F.col("run_id").alias("id"),
        F.inline(F.array(F.struct(F.col("t0").alias("ts"), F.lit(1).alias("kind")),
                         F.struct(F.col("t1").alias("ts"), F.lit(2).alias("kind")))),
    )
    series = readings.unionByName(times, allowMissingColumns=True)
    filled = fill_forward(
        series, ["device"], ["ts", "kind", "id"], "counter_kwh", "seen_kwh",
        time_chunk("ts") if chunk is None else chunk,
    )
    asked = filled.filter(F.col("kind") > 0)
    return asked.groupBy(F.col("id").alias("run_id")).agg(
        F.max("device").alias("device"),
        F.max(F.when(F.col("kind") == 1, F.col("seen_kwh"))).alias("kwh_before"),
        F.max(F.when(F.col("kind") == 2, F.col("seen_kwh"))).alias("kwh_after"),
    ).withColumn("gross_energy_j", joules(F.col("kwh_after") - F.col("kwh_before")))


def energy_index(power: DataFrame, chunk: Column) -> DataFrame:
    """Each watt sample with the energy of its device before it: an index that any interval is read from.

    (device, ts, sample_id, at, uw, next_at, next_uw, twice): time in microseconds, watts in millionths, the same of the
    next sample, and twice the trapezoid energy up to the sample, exact in millionths of a watt times a microsecond.
    Samples without a time or a reading are left out.
    """
    samples = power.filter(F.col("ts").isNotNull() & F.col("watts").isNotNull()).select(
        "device", "ts", "sample_id", _micros("ts").alias("at"), F.round(F.col("watts") * 1e6).cast("bigint").alias("uw"), chunk.alias("__span"),
    )
    mirrored = samples.withColumns({"__back": -F.col("at"), "__back_id": -F.col("sample_id")})
    following = previous_row(
        mirrored, ["device"], ["__back", "__back_id"], {"next_at": "at", "next_uw": "uw"}, -F.col("__span")
    ).drop("__back", "__back_id")
    area = (F.col("uw") + F.col("next_uw")).cast("decimal(20,0)") * (F.col("next_at") - F.col("at")).cast("decimal(18,0)")
    area = F.coalesce(area, F.lit(0)).cast("decimal(38,0)")
    summed = running(following, ["device"], SAMPLE_ORDER, {"twice": area}, F.col("__span"))
    return summed.withColumn("twice", (F.col("twice") - area).cast("decimal(38,0)"))


def energy_between(executions: DataFrame, index: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Energy of each execution (run_id, device, t0, t1) from watt samples, straight lines between them: energy_j, covered.

    ``index`` is the samples' ``energy_index``, best written as a table: it is read twice, and serves any executions.

    Two readings of the energy index take the place of a join with every sample inside: samples and the two times of an
    execution are one ordered series per device, filled forward chunk by chunk, and the last sample before a time
    tells the rest up to it. The rows stay as many as samples and executions.

    Outside of a device's samples nothing is added, and ``covered`` tells whether both times lie between them. A time
    that is missing, or an end before the begin, gives NULL energy.
    """
    if chunk is None:
        chunk = time_chunk("ts")
    sample = ["at", "uw", "next_at", "next_uw", "twice"]
    index = index.select(
        "device", "ts", F.lit(0).alias("kind"), F.col("sample_id").alias("id"), F.struct(*sample).alias("sample")
    )
    valid = F.coalesce(F.col("t0") <= F.col("t1"), F.lit(False))
    asked = executions.filter(valid).select(
        "device", F.col("run_id").alias("id"),
        F.inline(F.array(F.struct(F.col("t0").alias("ts"), F.lit(1).alias("kind")),
                         F.struct(F.col("t1").alias("ts"), F.lit(2).alias("kind")))),
    )
    series = index.unionByName(asked, allowMissingColumns=True)
    read = fill_forward(series, ["device"], ["ts", "kind", "id"], "sample", "seen", chunk).filter(F.col("kind") > 0)
    since = (_micros("ts") - F.col("seen.at")).cast("double")
    rest = since * (
        2.0 * F.col("seen.uw") + (F.col("seen.next_uw") - F.col("seen.uw")) * since / (F.col("seen.next_at") - F.col("seen.at"))
    )
    inside = F.col("seen").isNotNull() & (F.col("seen.next_at").isNotNull() | (since == 0) | (F.col("kind") == 1))
    # the whole part is subtracted exactly, before it becomes a double
    at_time = F.struct(
        F.coalesce(F.col("seen.twice"), F.lit(0)).cast("decimal(38,0)").alias("twice"),
        F.coalesce(F.when(F.col("seen.next_at").isNotNull(), rest), F.lit(0.0)).alias("rest"),
        F.coalesce(inside, F.lit(False)).alias("inside"),
    )
    pair = read.groupBy(F.col("id").alias("run_id"), "device").agg(
        F.max_by(at_time, F.col("kind")).alias("b"), F.min_by(at_time, F.col("kind")).alias("a")
    )
    twice = (F.col("b.twice") - F.col("a.twice")).cast("double") + (F.col("b.rest") - F.col("a.rest"))
    found = pair.select("run_id", "device", (twice / 2e12).alias("energy_j"), (F.col("a.inside") & F.col("b.inside")).alias("covered"))
    missing = executions.filter(~valid).select("run_id", "device", F.lit(None).cast("double").alias("energy_j"), F.lit(False).alias("covered"))
    return found.unionByName(missing)


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
