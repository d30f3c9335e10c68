"""Source and sink plans: every one writes tables to the work folder and reads them back."""

from pyspark.sql import functions as F

from wattsift.operators import compare, panel
from wattsift.operators.ordered import latest
from wattsift.plans.groups import ITEM, SUMMARY_MEANS, SUMMARY_SQL, rounded
from wattsift.plans.registry import query
from wattsift.plans.twins import PLATFORMS, PROMPTS, RAW, RUNS, SCORES, TURNS, twin
from wattsift.session import work_dir
from wattsift.sources import batches, checkpoints, files, scores, summary
from wattsift.sources.quoted import read_quoted

NAME_SQL = "concat('Board ', CAST(platform AS VARCHAR), ' 4GB (chip, core)')"
RESPONSE_SQL = "concat('He said \"', category, '\",', chr(10), 'then stopped. ')"


def _platform_name():
    return F.concat(F.lit("Board "), F.col("platform").cast("string"), F.lit(" 4GB (chip, core)"))


def _response():
    return F.concat(F.lit('He said "'), F.col("category"), F.lit('",\nthen stopped. '))


def _prompt_file(t):
    return t.prompts().select(
        F.col("prompt_id").alias("ID"), F.col("category").alias("CATEGORY"), F.col("prompt").alias("PROMPT")
    )


def _board_file(t):
    """The board variant: quoted commas, line breaks, doubled quotes, blank scores."""
    return t.runs().select(
        F.col("run_id").alias("ID"),
        _platform_name().alias("HW_Platform"),
        F.lit("llama.cpp").alias("Backend"),
        F.col("precision").alias("Precision"),
        F.col("category").alias("Category"),
        F.concat(F.lit("Explain, please: "), "category").alias("Prompt"),
        _response().alias("Response"),
        F.col("output_tokens").alias("Output_Tokens"),
        F.col("latency_s").alias("Latency_s"),
        F.col("tokens_per_s").alias("Tokens_per_sec"),
        F.col("gross_energy_j").alias("Gross_Energy_J"),
        F.col("net_energy_j").alias("Net_Energy_J"),
        F.col("power_net_w").alias("Power_W"),
        F.col("cpu_freq_mhz").alias("CPU_Freq_MHz"),
        F.lit(None).cast("double").alias("CPU_Temp_C"),
        F.col("throttled").alias("Throttled"),
        F.coalesce(F.col("q_ped").cast("string"), F.lit("")).alias("Q_ped"),
        F.lit("").alias("LpW"),
    )


@query("s1_read_prompt_csv", twin(PROMPTS, body="SELECT prompt_id, category, prompt FROM prompts"))
def read_prompt_csv(t):
    path = work_dir(t.spark, "prompts")
    files.write_csv(_prompt_file(t), path)
    return files.read_prompts(t.spark, path)


@query("s2_read_results_csv", twin(RUNS, body=f"""
SELECT run_id, {NAME_SQL} AS platform, precision, {RESPONSE_SQL} AS response, output_tokens, latency_s,
       net_energy_j, cpu_freq_mhz, throttled, q_ped, CAST(NULL AS DOUBLE) AS lpw
FROM runs"""))
def read_results_csv(t):
    path = work_dir(t.spark, "results")
    files.write_csv(_board_file(t), path)
    return files.read_runs(t.spark, path, "board").select(
        "run_id", "platform", "precision", "response", "output_tokens", "latency_s", "net_energy_j", "cpu_freq_mhz",
        "throttled", "q_ped", "lpw",
    )


def _summary_rows(t):
    stats = rounded(compare.summarise(t.runs(), ["platform", "precision"]), SUMMARY_MEANS)
    named = t.platforms().select("platform", F.col("platform_name").alias("name"))
    # A platform with too little memory has a note in place of measurements.
    note = F.lit("F32 omitted: exceeds the platform's RAM")
    measured = stats.join(named, "platform").withColumn("note", F.lit(None).cast("string"))
    missing = named.select("platform", "name", F.lit("F32").alias("precision"), note.alias("note"))
    rows = measured.unionByName(missing, allowMissingColumns=True)
    return rows.withColumn("platform_key", F.concat(F.lit("P"), F.col("platform").cast("string"))).drop(
        "platform"
    ).withColumnRenamed("name", "platform")


SUMMARY_TWIN = twin(RUNS, PLATFORMS, body=f"""
SELECT concat('P', CAST(platform AS VARCHAR)) AS platform_key, any_value(platform_name) AS platform, precision, {SUMMARY_SQL},
       CAST(NULL AS VARCHAR) AS note
FROM runs JOIN platforms USING (platform) GROUP BY runs.platform, precision
UNION ALL
SELECT concat('P', CAST(platform AS VARCHAR)), platform_name, 'F32', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       'F32 omitted: exceeds the platform''s RAM'
FROM platforms""")


@query("s3_read_summary_json", SUMMARY_TWIN)
def read_summary_json(t):
    path = work_dir(t.spark, "summary")
    summary.write_summary(_summary_rows(t), path)
    return summary.read_summary(t.spark, path)


@query("f6_feasible_only", f"SELECT platform_key, platform, precision, n FROM ({SUMMARY_TWIN}) WHERE note IS NULL")
def feasible_only(t):
    """Configurations without a note in place of their measurements."""
    return _summary_rows(t).filter(F.col("note").isNull()).select("platform_key", "platform", "precision", "n")


@query("s4_read_checkpoints", twin(RUNS, body="SELECT run_id, precision, latency_s, q_ped FROM runs"))
def read_checkpoints(t):
    """An early unscored checkpoint and a later one repeating its rows with scores; the later row counts."""
    rows = t.raw_runs().select("run_id", "precision", "latency_s", "q_ped")
    early, late = work_dir(t.spark, "checkpoint-1"), work_dir(t.spark, "checkpoint-2")
    rows.withColumn("q_ped", F.lit(None).cast("double")).write.parquet(early)
    rows.write.parquet(late)
    both = checkpoints.read_checkpoints(t.spark, [early, late], rows.schema)
    newer = F.col("source_file").contains("checkpoint-2")
    return latest(both.withColumn("newer", newer), ["run_id"], [F.col("newer")]).drop("source_file", "newer")


@query("s5_read_score_sheets", twin(SCORES, body="SELECT item_id, precision, rater_id, rater_kind, dim, score FROM scores"))
def read_score_sheets(t):
    wide = panel.wide_rubric(t.scores(), [*ITEM, "rater_id", "rater_kind"])
    root = work_dir(t.spark, "sheets")
    kinds = ["human", "ai"]
    for kind in kinds:
        scores.write_scores(wide.filter(F.col("rater_kind") == kind), f"{root}/{kind}")
    human, ai = (scores.read_scores(t.spark, f"{root}/{kind}", kind) for kind in kinds)
    return human.unionByName(ai)


@query("s6_harmonise_variants", twin(RUNS, body=f"""
SELECT run_id, precision, category, latency_s, net_energy_j, q_ped, CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS BIGINT) AS output_tokens
FROM runs WHERE precision = 'F16'
UNION ALL
SELECT run_id, precision, category, latency_s, net_energy_j, CAST(NULL AS DOUBLE), {NAME_SQL}, output_tokens
FROM runs WHERE precision = 'Q4_K_M'"""))
def harmonise_variants(t):
    runs = t.runs()
    judged = runs.filter(F.col("precision") == "F16").select(
        F.col("run_id").alias("ID"),
        F.lit("F16_GGUF").alias("Precision"),
        F.concat(F.lit(" "), "category").alias("Category"),
        F.col("latency_s").alias("Latency_s"),
        F.col("net_energy_j").alias("Net_Energy_J"),
        F.col("q_ped").alias("Qped"),
    )
    desktop = runs.filter(F.col("precision") == "Q4_K_M").select(
        F.col("run_id").alias("ID"),
        _platform_name().alias("HW_Platform"),
        F.lower("precision").alias("Precision"),
        F.concat("category", F.lit("\n")).alias("Category"),
        F.col("output_tokens").alias("Output_Tokens"),
        F.col("latency_s").alias("Latency_s"),
        F.col("net_energy_j").alias("Net_Energy_J"),
    )
    return files.harmonise(judged, desktop)


@query("s7_write_results", twin(RUNS, body="""
SELECT run_id, precision, category, round(latency_s, 4) AS latency_s, round(net_energy_j, 4) AS net_energy_j, throttled FROM runs"""))
def write_results(t):
    """The CSV export and the parquet table partitioned by configuration; a difference would add rows."""
    runs = t.runs().select(
        "run_id", "precision", "category",
        F.round("latency_s", 4).alias("latency_s"), F.round("net_energy_j", 4).alias("net_energy_j"), "throttled",
    )
    csv, table = work_dir(t.spark, "runs-csv"), work_dir(t.spark, "runs")
    files.write_runs(runs, csv, "csv")
    files.write_runs(runs, table, partition_by=["precision"])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    exported = read_quoted(t.spark, csv, types)
    kept = t.spark.read.parquet(table).select(*runs.columns)
    return exported.unionByName(kept).distinct()


@query("s8_bom_csv", twin(TURNS, body="""
SELECT conv_id * 1000 + turn AS "ID", nullif(prompt, '') AS "Prompt", nullif(response, '') AS "Response" FROM turns"""))
def bom_csv(t):
    rows = t.turns().select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ID"),
        F.col("prompt").alias("Prompt"),
        F.col("response").alias("Response"),
    )
    path = work_dir(t.spark, "bom")
    files.write_csv(rows, path, bom=True)
    return read_quoted(t.spark, path, "ID BIGINT, Prompt STRING, Response STRING")


@query("s9_checkpoint_batches", twin(RAW, body="""
SELECT run_id, precision, latency_s, CAST(ceil((run_id + 1) / 1000e0) AS BIGINT) AS batch FROM raw_runs"""))
def checkpoint_batches(t):
    """Three sessions of a collection, one of them tried twice, put together and then read back."""
    rows = t.raw_runs().select("run_id", "precision", "latency_s", (F.col("run_id") + 1).alias("task_id"))
    schema = checkpoints.with_batch(rows, "task_id", 1000).schema
    path = work_dir(t.spark, "batches")
    for session in (0, 1, 1, 2):
        part = rows.filter(F.expr("(task_id - 1) div 1000 % 3") == session)
        checkpoints.write_checkpoints(part, path, "task_id", 1000, f"session-{session}")
    batches.compact(t.spark, path, schema, ["batch", "task_id"])
    stored = batches.read_batches(t.spark, path, schema)
    return stored.select("run_id", "precision", "latency_s", "batch")


@query("s10_write_summary_json")
def write_summary_json(t):
    return summary.summary_lines(_summary_rows(t))


@query("s11_blind_sheet", twin(RAW, body="""
SELECT md5('salt-1|' || CAST(run_id AS VARCHAR) || '|' || precision) AS blind_id, category, CAST(NULL AS INT) AS "CA",
       CAST(NULL AS INT) AS "CC", CAST(NULL AS INT) AS "SQ", CAST(NULL AS INT) AS "LA", CAST(NULL AS VARCHAR) AS "Notes"
FROM raw_runs ORDER BY blind_id"""))
def blind_sheet(t):
    rows = t.raw_runs().select("run_id", "precision", "category")
    sheet, _ = panel.blind_sheet(rows, "run_id", "precision", "salt-1")
    return sheet.orderBy("blind_id")
