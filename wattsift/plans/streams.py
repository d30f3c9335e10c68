"""Streaming plans, each run over everything available and read back, and the apply plans.

The twins are the batch queries: they have the final windows and those still open at the end of the data.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.operators.apply import apply_judge, apply_model
from wattsift.operators.batched import Calls, ask_judge, ask_model
from wattsift.operators.ordered import DAY, HOUR
from wattsift.plans.registry import query
from wattsift.plans.tables import Tables, runs_of
from wattsift.plans.twins import PLATFORMS, POWER, RAW, RUNS, TURNS, twin, words
from wattsift.session import work_dir, written
from wattsift.streaming import event_time, jobs
from wattsift.streaming import operators as S
from wattsift.streaming.first_copies import first_copies


HALF_DAY = DAY // 2


def events_stream(t: Tables) -> DataFrame:
    """The table's folder of part files as a stream, or the one file that it is."""
    events = t.read("events")
    if [f.rsplit("/", 1)[-1] for f in events.inputFiles()] == ["events.parquet"]:
        return jobs.ingest(t.spark, t.sf_dir, events.schema, name_filter="events.parquet")
    return jobs.ingest(t.spark, f"{t.sf_dir}/events.parquet", events.schema)


def all_windows(t: Tables, rows: DataFrame, ts: str, label: str, build, still_open) -> DataFrame:
    """A windowed stream with all its windows, also those open at the end of the data; rows may be an hour late."""
    timed = lambda r: build(S.timed(r, ts, f"{HOUR} seconds"))
    return event_time.run_windows(rows, ts, HOUR, timed, still_open, work_dir(t.spark, label)).all()


def runs_stream(t: Tables) -> DataFrame:
    return S.enrich(runs_of(events_stream(t)))


def available(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    return jobs.run_available(stream, work_dir(t.spark, label), work_dir(t.spark, f"{label}-checkpoint"))


def in_sessions(t: Tables, parts: list[DataFrame], label: str, run) -> DataFrame:
    """Collection in several sessions: each part arrives in the folder, then the stream runs on the same checkpoint."""
    folder = work_dir(t.spark, f"{label}-arrivals")
    out = None
    for part in parts:
        part.write.mode("append").parquet(folder)
        out = run(jobs.ingest(t.spark, folder, part.schema))
    return out


def scattered(rows: DataFrame, ts: str, id: str, within_s: int, sessions: int = 3) -> list[DataFrame]:
    """Sessions of a collection whose rows arrive up to ``within_s`` seconds after their time, each row on its own."""
    low, high = rows.agg(F.min(ts).cast("string"), F.max(ts).cast("string")).first()
    wait = F.make_dt_interval(secs=F.pmod(F.xxhash64(id), F.lit(within_s)))
    start, end = (F.lit(x).cast("timestamp_ntz") for x in (low, high))
    span = F.timestamp_diff("SECOND", start, end) + F.lit(within_s + 1)
    passed = F.timestamp_diff("SECOND", start, F.col(ts) + wait)
    session = F.least(F.floor(passed * sessions / span), F.lit(sessions - 1))
    return [rows.filter(F.coalesce(session, F.lit(sessions - 1)) == k) for k in range(sessions)]


def halves(rows: DataFrame, ts: str) -> list[DataFrame]:
    """Two sessions of a collection: what lies before the middle of its time, and the rest, also rows without a time."""
    low, high = rows.agg(F.min(ts).cast("string"), F.max(ts).cast("string")).first()
    span = F.timestamp_diff("SECOND", F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))
    middle = F.timestamp_add("SECOND", (span / 2).cast("bigint"), F.lit(low).cast("timestamp_ntz"))
    first = F.coalesce(F.col(ts) < middle, F.lit(False))
    return [rows.filter(first), rows.filter(~first)]


@query("t1_resumed_ingest", twin(RAW, body="SELECT run_id, precision, category, latency_s FROM raw_runs"))
def resumed_ingest(t):
    rows = t.raw_runs().select("run_id", "precision", "category", "latency_s", "started_at")
    sink, checkpoint = work_dir(t.spark, "t1"), work_dir(t.spark, "t1-checkpoint")
    out = in_sessions(t, halves(rows, "started_at"), "t1", lambda s: jobs.run_available(s, sink, checkpoint))
    return out.drop("started_at")


@query("t2_stream_enrichment", twin(RUNS, body="""
SELECT run_id, net_energy_j, power_net_w, tokens_per_s, lpw, throttled FROM runs"""))
def stream_enrichment(t):
    rows = runs_stream(t).select("run_id", "net_energy_j", "power_net_w", "tokens_per_s", "lpw", "throttled")
    return available(t, rows, "t2")


@query("t3_stateful_delta", twin(POWER, body="""
SELECT device, sample_id, counter_kwh - prev_kwh AS delta_kwh FROM steps"""))
def stateful_delta(t):
    """Readings arrive up to half a day after their time and out of order."""
    folder, checkpoint = work_dir(t.spark, "t3"), work_dir(t.spark, "t3-checkpoint")
    parts = scattered(written(t.power().select(*event_time.READINGS), "t3-readings"), "ts", "sample_id", HALF_DAY)
    out = in_sessions(t, parts, "t3", lambda s: event_time.delta_stream(s, HALF_DAY, folder, checkpoint))
    return out.all().select("device", "sample_id", "delta_kwh")


@query("t4_tumbling_power", """
WITH days AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, user_id AS device, value, ts FROM events)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, device, count(*) AS n, round(avg(value), 6) AS mean_w,
       max(value) AS max_w
FROM days GROUP BY window_start, device""".strip())
def tumbling_power(t):
    rows = events_stream(t).select("ts", F.col("user_id").alias("device"), "value")
    values = [
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_w"), F.max("value").alias("max_w"),
    ]
    days = event_time.fixed("ts", DAY)
    return all_windows(t, rows, "ts", "t4", lambda r: S.windowed(r, "ts", "1 day", ["device"], values), days)


@query("t5_sliding_rates", twin(RUNS, body="""
, spans AS (
  SELECT unnest([date_trunc('day', started_at), date_trunc('day', started_at) - INTERVAL 1 DAY]) AS w, * FROM runs)
SELECT CAST(w AS TIMESTAMP) AS window_start, CAST(w + INTERVAL 2 DAY AS TIMESTAMP) AS window_end, precision,
       round(avg(latency_s), 6) AS mean_latency_s, round(avg(tokens_per_s), 6) AS mean_tokens_per_s
FROM spans GROUP BY w, precision"""))
def sliding_rates(t):
    values = [
        F.round(F.avg("latency_s"), 6).alias("mean_latency_s"),
        F.round(F.avg("tokens_per_s"), 6).alias("mean_tokens_per_s"),
    ]

    def windows(rows):
        return S.windowed(rows, "started_at", "2 days", ["precision"], values, slide="1 day")

    rows = runs_stream(t).select("started_at", "precision", "latency_s", "tokens_per_s")
    return all_windows(t, rows, "started_at", "t5", windows, event_time.fixed("started_at", 2 * DAY))


@query("t6_collection_sessions", twin(RAW, body="""
, gaps AS (
  SELECT device, started_at, CASE WHEN started_at < lag(started_at) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
  FROM raw_runs WINDOW w AS (PARTITION BY device ORDER BY started_at)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY device ORDER BY started_at RANGE UNBOUNDED PRECEDING) AS session FROM gaps)
SELECT min(started_at) AS window_start, max(started_at) + INTERVAL 6 HOUR AS window_end, device, count(*) AS n
FROM numbered GROUP BY device, session"""))
def collection_sessions(t):
    rows = runs_of(events_stream(t)).select("started_at", "device")

    def sessions(rows):
        return S.sessions(rows, "started_at", "6 hours", ["device"], [F.count("*").alias("n")])

    return all_windows(t, rows, "started_at", "t6", sessions, event_time.by_session("started_at", ["device"]))


@query("t7_late_rows", twin(RAW, body="""
, arrivals AS (SELECT run_id, started_at, coalesce(generated_tokens >= 150, false) AS first_session FROM raw_runs)
SELECT run_id, NOT first_session AND started_at < (SELECT max(started_at) FROM arrivals WHERE first_session) - INTERVAL 2 DAY AS late
FROM arrivals"""))
def late_rows(t):
    """Rows with short answers arrive in a second session, most of them behind the watermark."""
    rows = t.raw_runs().select("run_id", "started_at", "generated_tokens")
    long_answer = F.coalesce(F.col("generated_tokens") >= 150, F.lit(False))
    sink, checkpoint = work_dir(t.spark, "t7"), work_dir(t.spark, "t7-checkpoint")

    def run(stream):
        return S.late_split(stream, "started_at", 2 * 86_400, sink, checkpoint)

    return in_sessions(t, [rows.filter(long_answer), rows.filter(~long_answer)], "t7", run).select("run_id", "late")


@query("t8_stream_dedupe", twin(RAW, body="SELECT run_id, category, latency_s FROM raw_runs"))
def stream_dedupe(t):
    """A cumulative checkpoint repeats the rows of the one before it; each run is kept once."""
    rows = t.raw_runs().select("run_id", "category", "latency_s", "started_at")
    first, _ = halves(rows, "started_at")
    folder, checkpoint = work_dir(t.spark, "t8"), work_dir(t.spark, "t8-checkpoint")
    out = in_sessions(t, [first, rows], "t8", lambda s: first_copies(s, ["run_id"], folder, checkpoint, 1_000_000))
    return out.drop("started_at")


@query("t9_running_means", twin(RUNS, body="""
SELECT category, count(*) AS n, round(avg(latency_s), 6) AS avg_latency_s, round(avg(net_energy_j), 6) AS avg_net_energy_j
FROM runs GROUP BY category"""))
def running_means(t):
    grouped = runs_stream(t).groupBy("category").agg(
        F.count("*").alias("n"),
        F.round(F.avg("latency_s"), 6).alias("avg_latency_s"),
        F.round(F.avg("net_energy_j"), 6).alias("avg_net_energy_j"),
    )
    return jobs.run_snapshots(grouped, work_dir(t.spark, "t9"), work_dir(t.spark, "t9-checkpoint"))


@query("t10_throttle_alarm", twin(RUNS, body="""
, days AS (SELECT *, CAST(date_trunc('day', started_at) AS TIMESTAMP) AS window_start FROM runs)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, platform, count(*) FILTER (throttled) AS n_throttled
FROM days GROUP BY window_start, platform
HAVING count(*) FILTER (throttled) > 10"""))
def throttle_alarm(t):
    rows = runs_stream(t).select("started_at", "platform", "throttled")
    counted = [F.count_if("throttled").alias("n_throttled")]

    def alarms(rows):
        return S.alarm(S.windowed(rows, "started_at", "1 day", ["platform"], counted), 10)

    return all_windows(t, rows, "started_at", "t10", alarms, event_time.fixed("started_at", DAY))


@query("t11_stream_dimension_join", twin(RUNS, PLATFORMS, body="""
SELECT run_id, platform_name, mem_bw_gbs, tokens_per_s / mem_bw_gbs AS tokens_per_gb FROM runs JOIN platforms USING (platform)"""))
def stream_dimension_join(t):
    rows = runs_stream(t).join(t.platforms(), "platform").select(
        "run_id", "platform_name", "mem_bw_gbs", (F.col("tokens_per_s") / F.col("mem_bw_gbs")).alias("tokens_per_gb")
    )
    return available(t, rows, "t11")


def echo_model():
    return lambda prompt: (f"echo: {prompt}", len(prompt.split()), len(prompt.split()) + 1)


@query("x1_apply_model", twin(TURNS, body=f"""
SELECT conv_id, turn, 'echo: ' || prompt AS response, CAST(len({words('prompt')}) AS BIGINT) AS input_tokens,
       CAST(len({words('prompt')}) + 1 AS BIGINT) AS output_tokens, true AS timed
FROM turns"""))
def apply_a_model(t):
    rows = apply_model(t.turns().select("conv_id", "turn", "prompt"), echo_model)
    return rows.select(
        "conv_id", "turn", "response", "input_tokens", "output_tokens", (F.col("latency_s") >= 0).alias("timed")
    )


def length_judge():
    return lambda prompt, response: f'{{"score": {1 + len(response) % 12}, "reason": "length"}}'


@query("x2_apply_judge", twin(TURNS, body="""
SELECT conv_id, turn, CASE WHEN response IS NULL THEN 7 ELSE 1 + length(response) % 12 END AS score,
       CASE WHEN response IS NULL THEN 'scoring_failed' ELSE 'length' END AS reason, response IS NOT NULL AS parse_ok,
       coalesce(1 + length(response) % 12 <= 10, true) AS score_ok
FROM turns"""))
def apply_a_judge(t):
    """Turns without a response make the judge raise; they get the fallback score."""
    rows = apply_judge(t.turns(), length_judge)
    return rows.select("conv_id", "turn", "score", "reason", "parse_ok", "score_ok")


def refusing_model():
    """Answers in batches; a prompt of a length divisible by 7 is refused, and the batch that holds it with it."""

    def ask(prompts):
        for prompt in prompts:
            if len(prompt) % 7 == 0:
                raise ValueError("refused")
        return [("echo: " + p, len(p.split()), len(p.split()) + 1) for p in prompts]

    return ask


@query("x1_batched_model", twin(TURNS, body=f"""
SELECT conv_id, turn, CASE WHEN length(prompt) % 7 <> 0 THEN 'echo: ' || prompt END AS response,
       CASE WHEN length(prompt) % 7 <> 0 THEN CAST(len({words('prompt')}) AS BIGINT) END AS input_tokens,
       CASE WHEN length(prompt) % 7 = 0 THEN 'ValueError: refused' END AS error
FROM turns"""))
def ask_a_model(t):
    """Every text is asked once, however many turns hold it; refused ones say so and cost their batch no answer."""
    rows = ask_model(t.turns().select("conv_id", "turn", "prompt"), refusing_model, how=Calls(wait_s=0.0))
    return rows.select("conv_id", "turn", "response", "input_tokens", "error")


def failing_judge():
    return lambda pairs: [f'{{"score": {1 + 60 // (len(r) % 5) % 12}, "reason": "length"}}' for _, r in pairs]


@query("x2_batched_judge", twin(TURNS, body="""
, r AS (SELECT *, length(response) % 5 AS k FROM turns)
SELECT conv_id, turn, coalesce(CASE WHEN k > 0 THEN 1 + (60 // k) % 12 END, 7) AS score, coalesce(k > 0, false) AS parse_ok,
       CASE WHEN k IS NULL THEN 'no response' WHEN k = 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS error
FROM r"""))
def ask_a_judge(t):
    """Fallback scores with their cause: turns without a response, and replies that the judge failed to give."""
    rows = ask_judge(t.turns(), failing_judge, Calls(wait_s=0.0))
    return rows.select("conv_id", "turn", "score", "parse_ok", "error")
