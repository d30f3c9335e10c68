"""Row-level plans: projections, filters and checks."""

from pyspark.sql import functions as F

from wattsift.functions import metrics as M
from wattsift.functions import replies as R
from wattsift.functions import sensors as S
from wattsift.functions import text as X
from wattsift.operators import checks, enrich, panel
from wattsift.operators.judging import parse_judge
from wattsift.operators.ordered import DAY, id_chunk, number_rows, time_chunk
from wattsift.operators.power import counter_delta
from wattsift.plans.registry import query
from wattsift.plans.tables import F16
from wattsift.plans.twins import (
    MODELS, POWER, PROMPTS, RAW, REPLIES, RUNS, SCORES, TURNS, decimal_round, twin, words,
)
from wattsift.schemas import CATEGORY_BANDS, ROUNDING

BAND_SQL = " ".join(f"WHEN prompt_id % 500 < {upper} THEN '{label}'" for upper, label in CATEGORY_BANDS)


@query("p1_row_ids", twin(PROMPTS, body="""
SELECT prompt_id, corpus, row_number() OVER (PARTITION BY corpus ORDER BY prompt_id) AS task_id FROM prompts"""))
def row_ids(t):
    prompts = t.prompts().select("prompt_id", "corpus")
    return number_rows(prompts, ["corpus"], ["prompt_id"], "task_id", id_chunk("prompt_id"))


@query("p2_category_by_position", twin(RAW, body=f"""
SELECT run_id, prompt_id, CASE {BAND_SQL} END AS band_category FROM raw_runs"""))
def category_by_position(t):
    return t.raw_runs().select(
        "run_id", "prompt_id", enrich.band_category(F.col("prompt_id") % 500).alias("band_category")
    )


@query("p3_normalise_labels", twin(RAW, body="""
SELECT run_id, trim(lower(category_raw)) AS category_clean,
       CASE CASE WHEN run_id % 3 = 0 THEN precision || '_GGUF' ELSE lower(precision) END
         WHEN 'F16_GGUF' THEN 'F16' WHEN 'f16' THEN 'F16' WHEN 'q4_k_m' THEN 'Q4_K_M'
         ELSE precision || '_GGUF' END AS precision_clean
FROM raw_runs"""))
def normalise_labels(t):
    known = {c: c for c in ["click", "error", "purchase", "signup", "view"]}
    injected = F.when(F.col("run_id") % 3 == 0, F.concat("precision", F.lit("_GGUF"))).otherwise(F.lower("precision"))
    return t.raw_runs().select(
        "run_id",
        X.category_label(F.col("category_raw"), known).alias("category_clean"),
        X.precision_label(injected).alias("precision_clean"),
    )


@query("p4_split_model_label", twin(MODELS, body=r"""
SELECT model_id, regexp_extract(model_label, '^(.*\S)\s+(FP16|NF4|F16|Q4_K_M)$', 1) AS model,
       regexp_extract(model_label, '^(.*\S)\s+(FP16|NF4|F16|Q4_K_M)$', 2) AS precision
FROM models"""))
def split_model_label(t):
    label = F.col("model_label")
    return t.models().select(
        "model_id", X.model_name(label).alias("model"), X.model_precision(label).alias("precision")
    )


@query("p5_chat_template", twin(TURNS, body="""
SELECT conv_id, turn, '<|user|>' || chr(10) || prompt || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS formatted
FROM turns"""))
def chat_template(t):
    return t.turns().select("conv_id", "turn", X.chat_prompt(F.col("prompt")).alias("formatted"))


@query("p6_judge_request", twin(TURNS, body="""
SELECT conv_id, turn, 'PROMPT: ' || prompt || chr(10) || chr(10) || 'AI RESPONSE: ' || response AS request
FROM turns WHERE response IS NOT NULL"""))
def judge_request(t):
    rows = t.turns().filter(F.col("response").isNotNull())
    return rows.select("conv_id", "turn", X.judge_request(F.col("prompt"), F.col("response")).alias("request"))


@query("p7_strip_whitespace", twin(PROMPTS, body=r"""
SELECT prompt_id, regexp_replace(chr(9) || prompt || ' ' || chr(10), '^\s+|\s+$', '', 'g') AS stripped FROM prompts"""))
def strip_whitespace(t):
    padded = F.concat(F.lit("\t"), "prompt", F.lit(" \n"))
    return t.prompts().select("prompt_id", X.strip_ws(padded).alias("stripped"))


@query("p8_drop_prompt_prefix", twin(TURNS, body=f"""
SELECT conv_id, turn, array_to_string(list_concat(p, r)[len(p) + 1:], ' ') AS continuation
FROM (SELECT conv_id, turn, {words('prompt')} AS p, {words("coalesce(response, '')")} AS r FROM turns)"""))
def drop_prompt_prefix(t):
    prompt, response = X.tokens(F.col("prompt")), X.tokens(F.coalesce("response", F.lit("")))
    rows = t.turns().select("conv_id", "turn", prompt.alias("p"), F.concat(prompt, response).alias("sequence"))
    kept = X.drop_prefix(F.col("sequence"), F.size("p"))
    return rows.select("conv_id", "turn", F.array_join(kept, " ").alias("continuation"))


@query("p9_token_counts", twin(TURNS, body=f"""
SELECT conv_id, turn, CAST(len({words('prompt')}) AS BIGINT) AS input_tokens,
       CAST(len({words("coalesce(response, '')")}) AS BIGINT) AS output_tokens
FROM turns"""))
def token_counts(t):
    def count(column):
        return F.size(X.tokens(column)).cast("bigint")

    return t.turns().select(
        "conv_id", "turn",
        count(F.col("prompt")).alias("input_tokens"),
        count(F.coalesce("response", F.lit(""))).alias("output_tokens"),
    )


@query("p10_token_cap", twin(RAW, body="""
SELECT run_id, least(generated_tokens, 200) AS generated_tokens, generated_tokens >= 200 AS cap_hit FROM raw_runs"""))
def token_cap(t):
    rows = t.raw_runs().select("run_id", "generated_tokens")
    return enrich.cap_tokens(rows, column="generated_tokens")


@query("p11_tokens_per_second", twin(RUNS, body="SELECT run_id, tokens_per_s FROM runs"))
def tokens_per_second(t):
    return enrich.with_rate(t.raw_runs()).select("run_id", "tokens_per_s")


@query("p12_gross_energy", twin(POWER, body="""
SELECT device, sample_id, (counter_kwh - prev_kwh) * 3.6e6 AS gross_energy_j FROM steps"""))
def gross_energy(t):
    steps = counter_delta(t.power(), time_chunk("ts", DAY))
    return steps.select("device", "sample_id", M.joules(F.col("delta_kwh")).alias("gross_energy_j"))


@query("p13_net_energy", twin(RUNS, body="SELECT run_id, net_energy_j FROM runs"))
def net_energy(t):
    return enrich.with_net_energy(t.raw_runs()).select("run_id", "net_energy_j")


@query("p14_power", twin(RUNS, body="SELECT run_id, power_net_w, power_gross_w FROM runs"))
def power(t):
    rows = t.raw_runs().transform(enrich.with_net_energy).transform(enrich.with_power)
    return rows.select("run_id", "power_net_w", "power_gross_w")


@query("p15_efficiency", twin(RUNS, body="SELECT run_id, q_ped, lpw FROM runs"))
def efficiency(t):
    rows = t.raw_runs().transform(enrich.with_net_energy).transform(enrich.with_efficiency)
    return rows.select("run_id", "q_ped", "lpw")


@query("p16_scaled_efficiency", twin(RUNS, body="""
SELECT run_id, lpw * 1e3 AS lpw_x1e3, lpw * 1e4 AS lpw_x1e4 FROM runs"""))
def scaled_efficiency(t):
    rows = t.runs()
    for scale, name in ((1e3, "lpw_x1e3"), (1e4, "lpw_x1e4")):
        rows = enrich.with_efficiency(rows, scale, name)
    return rows.select("run_id", "lpw_x1e3", "lpw_x1e4")


@query("p17_impute_energy", twin(RUNS, body="""
SELECT run_id, run_id % 7 = 0 AS is_imputed,
       CASE WHEN run_id % 7 = 0 THEN latency_s * 20e0 ELSE net_energy_j END AS net_energy_j
FROM runs"""))
def impute_energy(t):
    measured = F.when(F.col("run_id") % 7 != 0, F.col("net_energy_j"))
    rows = t.runs().withColumn("net_energy_j", measured)
    return enrich.impute_energy(rows, 20.0).select("run_id", "is_imputed", "net_energy_j")


@query("p18_round_columns", twin(RUNS, body="SELECT run_id, " + ", ".join(
    f"{decimal_round(c, ROUNDING[c])} AS {c}" for c in ROUNDING) + " FROM runs"))
def round_columns(t):
    return enrich.round_columns(t.runs().select("run_id", *ROUNDING))


@query("p19_constant_tags", twin(RAW, body="""
SELECT run_id, 'llama.cpp' AS backend, true AS use_cache FROM raw_runs"""))
def constant_tags(t):
    return enrich.tag(t.raw_runs().select("run_id"), backend="llama.cpp", use_cache=True)


@query("p20_throttled", twin(RUNS, body="SELECT run_id, cpu_freq_mhz, throttled FROM runs"))
def throttled(t):
    return enrich.with_throttled(t.raw_runs()).select("run_id", "cpu_freq_mhz", "throttled")


@query("p21_sensor_replies", twin(RAW, body=r"""
, sensed AS (
  SELECT run_id,
    CASE run_id % 4 WHEN 0 THEN concat('frequency(48)=', CAST((1800 + generated_tokens) * 1000000 AS VARCHAR), chr(10))
                    WHEN 1 THEN 'VCHI initialization failed' END AS clock_reply,
    CASE run_id % 3 WHEN 0 THEN concat(CAST((1800 + generated_tokens) * 1000 + 400 AS VARCHAR), chr(10))
                    WHEN 1 THEN 'n/a' END AS clock_sysfs,
    CASE run_id % 4 WHEN 0 THEN concat('temp=', CAST(40 + output_tokens % 40 AS VARCHAR), '.',
                                       CAST(run_id % 10 AS VARCHAR), '''C', chr(10))
                    WHEN 1 THEN 'error' END AS temp_reply,
    CASE run_id % 3 WHEN 0 THEN CAST(40000 + output_tokens * 100 AS VARCHAR) END AS temp_sysfs
  FROM raw_runs)
SELECT run_id,
  coalesce(round(TRY_CAST(regexp_extract(clock_reply, '=\s*(\d+)\s*$', 1) AS BIGINT) / 1e6, 0),
           round(TRY_CAST(regexp_extract(clock_sysfs, '^\s*(\d+)\s*$', 1) AS BIGINT) / 1e3, 0)) AS cpu_freq_mhz,
  coalesce(TRY_CAST(regexp_extract(temp_reply, '=([0-9.]+)', 1) AS DOUBLE),
           round(TRY_CAST(temp_sysfs AS BIGINT) / 1e3, 1)) AS cpu_temp_c
FROM sensed"""))
def sensor_replies(t):
    run, made, out = F.col("run_id"), F.col("generated_tokens"), F.col("output_tokens")

    def text(number):
        return number.cast("bigint").cast("string")

    clock = F.concat(F.lit("frequency(48)="), text((1800 + made) * 1000000), F.lit("\n"))
    temp = F.concat(F.lit("temp="), text(40 + out % 40), F.lit("."), text(run % 10), F.lit("'C\n"))
    sensed = t.raw_runs().select(
        "run_id",
        F.when(run % 4 == 0, clock).when(run % 4 == 1, "VCHI initialization failed").alias("clock_reply"),
        F.when(run % 3 == 0, F.concat(text((1800 + made) * 1000 + 400), F.lit("\n")))
        .when(run % 3 == 1, "n/a")
        .alias("clock_sysfs"),
        F.when(run % 4 == 0, temp).when(run % 4 == 1, "error").alias("temp_reply"),
        F.when(run % 3 == 0, text(40000 + out * 100)).alias("temp_sysfs"),
    )
    return sensed.select(
        "run_id",
        S.clock_mhz(F.col("clock_reply"), F.col("clock_sysfs")).alias("cpu_freq_mhz"),
        S.celsius(F.col("temp_reply"), F.col("temp_sysfs")).alias("cpu_temp_c"),
    )


@query("p22_judge_reply", twin(REPLIES, body="SELECT run_id, score, reason, parse_ok FROM judged"))
def judge_reply(t):
    return parse_judge(t.replies()).drop("reply")


@query("p23_rubric_reply", twin(REPLIES, body="""
SELECT run_id, CAST(json_extract_string(doc, '$.CA') AS BIGINT) AS CA, CAST(json_extract_string(doc, '$.CC') AS BIGINT) AS CC,
       CAST(json_extract_string(doc, '$.SQ') AS BIGINT) AS SQ, CAST(json_extract_string(doc, '$.LA') AS BIGINT) AS LA
FROM objects"""))
def rubric_reply(t):
    rows = t.replies().withColumn("r", R.rubric(F.col("reply")))
    return rows.select("run_id", "r.CA", "r.CC", "r.SQ", "r.LA")


@query("p24_score_band", twin(SCORES, body="""
SELECT item_id, precision, rater_id, dim, score, CAST(ceil(score / 2e0) AS BIGINT) AS band,
       CASE CAST(ceil(score / 2e0) AS BIGINT) WHEN 1 THEN '1-2' WHEN 2 THEN '3-4' WHEN 3 THEN '5-6'
            WHEN 4 THEN '7-8' ELSE '9-10' END AS band_label
FROM scores"""))
def score_band(t):
    score = F.col("score")
    return t.scores().select(
        "item_id", "precision", "rater_id", "dim", "score",
        R.band(score).alias("band"), R.band_label(score).alias("band_label"),
    )


@query("p25_single_rater_quality", twin(SCORES, body="""
, wide AS (
  SELECT item_id, precision, rater_id, max(score) FILTER (dim = 'CA') AS CA, max(score) FILTER (dim = 'CC') AS CC,
         max(score) FILTER (dim = 'SQ') AS SQ, max(score) FILTER (dim = 'LA') AS LA
  FROM scores GROUP BY ALL)
SELECT *, (CA + CC + SQ + LA) / 4e0 AS q_single FROM wide"""))
def single_rater_quality(t):
    return panel.wide_rubric(t.scores(), ["item_id", "precision", "rater_id"])


@query("p26_blank_to_null", twin(RAW, body="""
SELECT run_id, q_ped, CAST(run_id AS VARCHAR) AS run_label FROM raw_runs"""))
def blank_to_null(t):
    blank = F.when(F.col("run_id") % 2 == 0, F.lit("")).otherwise(F.lit("  "))
    written = t.raw_runs().select("run_id", F.coalesce(F.col("q_ped").cast("string"), blank).alias("written"))
    return written.select(
        "run_id", X.number_or_null(F.col("written")).alias("q_ped"), F.col("run_id").cast("string").alias("run_label")
    )


@query("p27_projected_hours", twin(RAW, body="""
SELECT platform, precision, round(500 * avg(latency_s) / 3600e0, 6) AS projected_hours FROM raw_runs GROUP BY ALL"""))
def projected_hours(t):
    hours = F.lit(500) * F.avg("latency_s") / 3600.0
    return t.raw_runs().groupBy("platform", "precision").agg(F.round(hours, 6).alias("projected_hours"))


@query("f1_one_configuration", twin(RUNS, body="""
SELECT run_id, latency_s, lpw FROM runs WHERE precision = 'F16' AND platform = 2"""))
def one_configuration(t):
    chosen = (F.col("precision") == F16) & (F.col("platform") == 2)
    return t.runs().filter(chosen).select("run_id", "latency_s", "lpw")


@query("f2_first_prompts", twin(RAW, body="SELECT run_id, prompt_id, category FROM raw_runs WHERE prompt_id < 100"))
def first_prompts(t):
    """The study's own subset operator: the first 100 prompts of the corpus."""
    return t.raw_runs().filter(F.col("prompt_id") < 100).select("run_id", "prompt_id", "category")


@query("f3_exclude_throttled", twin(RUNS, body="SELECT run_id, latency_s, cpu_freq_mhz FROM runs WHERE NOT throttled"))
def exclude_throttled(t):
    return t.runs().filter(~F.col("throttled")).select("run_id", "latency_s", "cpu_freq_mhz")


@query("f4_scored_only", twin(RUNS, body="SELECT run_id, q_ped, lpw FROM runs WHERE q_ped IS NOT NULL"))
def scored_only(t):
    return t.runs().filter(F.col("q_ped").isNotNull()).select("run_id", "q_ped", "lpw")


@query("f5_response_present", twin(TURNS, body="SELECT conv_id, turn, response FROM turns WHERE response <> ''"))
def response_present(t):
    return t.turns().filter(F.col("response") != "").select("conv_id", "turn", "response")


@query("q1_row_expectations", twin(RAW, body="""
, totals AS (
  SELECT count(*) AS n_rows, count(DISTINCT category) AS n_categories,
         count(*) FILTER (q_ped IS NULL) AS n_unscored FROM raw_runs)
SELECT r.rule, CAST(r.expected AS BIGINT) AS expected, r.actual, r.actual = r.expected AS ok FROM (
  SELECT 'rows' AS rule, 10000 AS expected, n_rows AS actual FROM totals
  UNION ALL SELECT 'categories', 5, n_categories FROM totals
  UNION ALL SELECT 'unscored', 0, n_unscored FROM totals) r"""))
def row_expectations(t):
    return checks.expect(
        t.raw_runs(),
        {
            "rows": (F.count("*"), 10_000),
            "categories": (F.count_distinct("category"), 5),
            "unscored": (F.count_if(F.col("q_ped").isNull()), 0),
        },
    )


@query("q2_balanced_strata", twin(RAW, body="""
SELECT category, count(*) AS n, CAST(2000 AS BIGINT) AS expected, count(*) = 2000 AS ok FROM raw_runs GROUP BY category"""))
def balanced_strata(t):
    return checks.balanced(t.raw_runs(), "category", 2000)


@query("q3_score_validity", twin(REPLIES, body="""
SELECT run_id, score, parse_ok, score BETWEEN 1 AND 10 AS valid FROM judged"""))
def score_validity(t):
    rows = parse_judge(t.replies()).select("run_id", "score", "parse_ok")
    return checks.flag_valid(rows, R.valid_score(F.col("score")))


@query("q4_recompute_audit", twin(RUNS, body="""
, stored AS (
  SELECT run_id, latency_s, net_energy_j, q_ped, round(power_net_w, 2) + CASE WHEN run_id % 13 = 0 THEN 1 ELSE 0 END AS power_net_w,
         round(lpw, 8) + CASE WHEN run_id % 17 = 0 THEN 1 ELSE 0 END AS lpw
  FROM runs),
errors AS (
  SELECT s.run_id, abs(s.power_net_w - r.power_net_w) AS power_net_w_error, abs(s.lpw - r.lpw) AS lpw_error
  FROM stored s JOIN runs r USING (run_id))
SELECT run_id, round(power_net_w_error, 6) AS power_net_w_error, round(lpw_error, 6) AS lpw_error
FROM errors WHERE coalesce(power_net_w_error > 0.006e0, false) OR coalesce(lpw_error > 1e-6, false)"""))
def recompute_audit(t):
    def spoiled(every):
        return F.when(F.col("run_id") % every == 0, 1.0).otherwise(0.0)

    stored = t.runs().withColumns(
        {"power_net_w": F.round("power_net_w", 2) + spoiled(13), "lpw": F.round("lpw", 8) + spoiled(17)}
    )
    columns = ["run_id", "latency_s", "net_energy_j", "q_ped", "power_net_w", "lpw"]
    failed = checks.audit(stored.select(*columns), {"power_net_w": 0.006, "lpw": 1e-6})
    return failed.select(
        "run_id",
        F.round("power_net_w_error", 6).alias("power_net_w_error"),
        F.round("lpw_error", 6).alias("lpw_error"),
    )


@query("q5_implied_idle", twin(RUNS, body="""
SELECT device, round(min((gross_energy_j - net_energy_j) / latency_s), 6) AS idle_min_w,
       round(max((gross_energy_j - net_energy_j) / latency_s), 6) AS idle_max_w
FROM runs WHERE latency_s > 0 AND net_energy_j > 0.01e0 GROUP BY device"""))
def implied_idle(t):
    found = checks.implied_idle(t.runs(), "device", 0.01)
    return found.withColumns({c: F.round(c, 6) for c in ("idle_min_w", "idle_max_w")})
