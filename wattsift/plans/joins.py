"""Join, set-operation and sampling plans."""

from pyspark.sql import functions as F

from wattsift.operators import compare, panel, power, sampling
from wattsift.operators.enrich import with_efficiency
from wattsift.operators.ordered import DAY, fill_forward, id_chunk, moving, running, time_chunk
from wattsift.operators.reconcile import prompt_classes, reconcile
from wattsift.plans.registry import query
from wattsift.plans.tables import F16, PRECISIONS, Q4
from wattsift.plans.twins import (
    EXECUTIONS, MODELS, PANEL, PLATFORMS, POWER, PROMPTS, RAW, RUNS, SCORES, TURNS, seconds, twin,
)

ITEM = ["item_id", "precision"]


@query("j1_results_with_scores", twin(RUNS, PANEL, body="""
SELECT run_id, r.item_id, precision, round(q.q_ped, 6) AS q_ped,
       round(CASE WHEN net_energy_j * latency_s > 0 THEN q.q_ped / (net_energy_j * latency_s) ELSE 0e0 END, 6) AS lpw
FROM runs r JOIN quality q USING (item_id, precision)"""))
def results_with_scores(t):
    """Scores are folded to one row per item first, so a run meets at most one of them."""
    runs = t.runs().drop("q_ped", "lpw")
    scored = runs.join(panel.quality(t.scores(), ITEM), ITEM)
    return with_efficiency(scored).select("run_id", *ITEM, F.round("q_ped", 6).alias("q_ped"), F.round("lpw", 6).alias("lpw"))


@query("j2_paired_configurations", twin(RUNS, body="""
SELECT a.prompt_id, a.latency_s AS latency_s_a, b.latency_s AS latency_s_b,
       a.net_energy_j AS net_energy_j_a, b.net_energy_j AS net_energy_j_b
FROM runs a JOIN runs b ON a.prompt_id = b.prompt_id AND a.precision = 'F16' AND b.precision = 'Q4_K_M'"""))
def paired_configurations(t):
    return compare.paired(t.runs(), "prompt_id", "precision", F16, Q4, ["latency_s", "net_energy_j"])


@query("j3_platform_dimension", twin(RAW, PLATFORMS, body="""
SELECT run_id, platform_name, mem_bw_gbs, ram_gb, latency_s FROM raw_runs JOIN platforms USING (platform)"""))
def platform_dimension(t):
    """No broadcast hint: the dimension is broadcast only while its size stays under Spark's threshold."""
    rows = t.raw_runs().select("run_id", "platform", "latency_s").join(t.platforms(), "platform")
    return rows.drop("platform")


@query("j4_attach_prompt_text", """
SELECT a.conv_id, a.turn, a.text AS response, u.text AS prompt, u.text IS NOT NULL AS matched
FROM conversations a LEFT JOIN conversations u
  ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
WHERE a.role = 'assistant'""".strip())
def attach_prompt_text(t):
    talk = t.read("conversations")
    results = talk.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    prompts = talk.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    joined = results.join(prompts, ["conv_id", "turn"], "left")
    return joined.withColumn("matched", F.col("prompt").isNotNull())


@query("j5_optional_scores", twin(RUNS, PANEL, body="""
SELECT run_id, round(q.q_ped, 6) AS q_ped,
       round(CASE WHEN q.q_ped IS NULL THEN NULL
            WHEN net_energy_j * latency_s > 0 THEN q.q_ped / (net_energy_j * latency_s) ELSE 0e0 END, 6) AS lpw
FROM runs r LEFT JOIN quality q USING (item_id, precision)"""))
def optional_scores(t):
    runs = t.runs().drop("q_ped", "lpw")
    rows = with_efficiency(runs.join(panel.quality(t.scores(), ITEM), ITEM, "left"))
    return rows.select("run_id", F.round("q_ped", 6).alias("q_ped"), F.round("lpw", 6).alias("lpw"))


@query("j6_prompts_without_result", """
SELECT u.conv_id, u.turn FROM conversations u WHERE u.role = 'user' AND NOT EXISTS (
  SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""".strip())
def prompts_without_result(t):
    talk = t.read("conversations")
    asked = talk.filter(F.col("role") == "user").select("conv_id", "turn")
    answered = talk.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return asked.join(answered, ["conv_id", "turn"], "left_anti")


@query("j7_sample_in_corpus", twin(PROMPTS, body="""
SELECT prompt_id, category FROM prompts s WHERE corpus = 'B'
  AND EXISTS (SELECT 1 FROM prompts c WHERE c.corpus = 'A' AND c.prompt = s.prompt)"""))
def sample_in_corpus(t):
    corpus = t.corpus("A").select("prompt").distinct()
    return t.corpus("B").join(corpus, "prompt", "left_semi").select("prompt_id", "category")


@query("j8_fits_in_memory", twin(MODELS, PLATFORMS, body="""
SELECT model_id, model_label, platform, platform_name, ram_needed_gb, ram_gb
FROM models JOIN platforms ON ram_needed_gb <= ram_gb"""))
def fits_in_memory(t):
    pairs = sampling.fits(t.models(), t.platforms(), "ram_needed_gb", "ram_gb")
    return pairs.select("model_id", "model_label", "platform", "platform_name", "ram_needed_gb", "ram_gb")


@query("j8_fit_ranks", twin(MODELS, PLATFORMS, body="""
SELECT model_id, model_label, ram_needed_gb, 1 + (SELECT count(*) FROM platforms WHERE ram_gb < m.first_gb) AS first_rank, n_fit
FROM (SELECT model_id, any_value(model_label) AS model_label, ram_needed_gb, min(ram_gb) AS first_gb, count(ram_gb) AS n_fit
      FROM models LEFT JOIN platforms ON ram_needed_gb <= ram_gb GROUP BY model_id, ram_needed_gb) m WHERE n_fit > 0
UNION ALL
SELECT model_id, model_label, ram_needed_gb, NULL, 0 FROM models
WHERE ram_needed_gb IS NULL OR NOT EXISTS (SELECT 1 FROM platforms WHERE ram_gb >= ram_needed_gb)"""))
def fit_ranks(t):
    """The same as the pairs, in as many rows as models: each model's smallest platform by rank, and how many it fits."""
    ranks = sampling.fit_ranks(t.models(), t.platforms(), "ram_needed_gb", "ram_gb")
    return ranks.select("model_id", "model_label", "ram_needed_gb", "first_rank", "n_fit")


@query("j9_missing_cells", twin(RUNS, PLATFORMS, body="""
SELECT p.platform, p.platform_name, g.precision, coalesce(s.n, 0) AS n, round(s.lpw_mean, 6) AS lpw_mean,
       s.n IS NULL AS missing
FROM platforms p CROSS JOIN (SELECT unnest(['F16', 'Q4_K_M', 'NF4']) AS precision) g
LEFT JOIN (SELECT platform, precision, count(*) AS n, avg(lpw) AS lpw_mean FROM runs GROUP BY ALL) s
  ON s.platform = p.platform AND s.precision = g.precision"""))
def missing_cells(t):
    cells = sampling.grid(t.platforms().select("platform", "platform_name"), "precision", [*PRECISIONS, "NF4"])
    stats = compare.summarise(t.runs(), ["platform", "precision"]).select("platform", "precision", "n", "lpw_mean")
    joined = cells.join(stats, ["platform", "precision"], "left")
    return joined.select(
        "platform", "platform_name", "precision",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.round("lpw_mean", 6).alias("lpw_mean"),
        F.col("n").isNull().alias("missing"),
    )


@query("j10_outstanding_ratings", twin(SCORES, body="""
SELECT i.item_id, i.precision, r.rater_id
FROM (SELECT DISTINCT item_id, precision FROM scores) i CROSS JOIN (SELECT unnest(range(13)) AS rater_id) r
WHERE NOT EXISTS (SELECT 1 FROM scores s
                  WHERE s.item_id = i.item_id AND s.precision = i.precision AND s.rater_id = r.rater_id)"""))
def outstanding_ratings(t):
    return panel.outstanding(t.votes(), ITEM)


@query("j11_human_against_ai", twin(PANEL, body="""
SELECT item_id, precision, dim, round(human_mean, 6) AS human_mean, round(ai_mean, 6) AS ai_mean,
       round(human_mean - ai_mean, 6) AS gap
FROM panel WHERE n_human > 0 AND n_ai > 0"""))
def human_against_ai(t):
    both = panel.panel_means(t.scores(), ITEM).filter((F.col("n_human") > 0) & (F.col("n_ai") > 0))
    return both.select(
        *ITEM, "dim",
        F.round("human_mean", 6).alias("human_mean"),
        F.round("ai_mean", 6).alias("ai_mean"),
        F.round(F.col("human_mean") - F.col("ai_mean"), 6).alias("gap"),
    )


# The letters beyond ASCII in the given texts are Latin ones, which the twin can fold too.
FOLDED = r"trim(regexp_replace(replace(strip_accents(lower(prompt)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("j12_reconcile_prompts", twin(PROMPTS, body=f"""
, folded AS (
  SELECT corpus, norm, min(prompt_id) AS id FROM (
    SELECT corpus, prompt_id, {FOLDED} AS norm FROM prompts) WHERE norm <> '' GROUP BY ALL),
a AS (SELECT * FROM folded WHERE corpus = 'A'),
b AS (SELECT * FROM folded WHERE corpus = 'B')
SELECT a.id AS id_a, b.id AS id_b, CAST(0 AS BIGINT) AS distance FROM a JOIN b USING (norm)
UNION ALL
SELECT a.id, b.id, levenshtein(a.norm, b.norm) FROM a JOIN b ON abs(length(a.norm) - length(b.norm)) <= 6
WHERE a.norm NOT IN (SELECT norm FROM b) AND b.norm NOT IN (SELECT norm FROM a) AND levenshtein(a.norm, b.norm) <= 6"""))
def reconcile_prompts(t):
    return reconcile(t.corpus("A"), t.corpus("B"), max_distance=6)


@query("j12_prompt_classes", twin(PROMPTS, body=f"""
SELECT prompt_id, CASE WHEN norm <> '' THEN min(prompt_id) OVER (PARTITION BY norm) END AS id
FROM (SELECT prompt_id, {FOLDED} AS norm FROM prompts)"""))
def classes_of_prompts(t):
    """Every prompt of both corpora with the lowest id among its copies, also those that differ in case or accents."""
    return prompt_classes(t.prompts())


@query("j13_samples_in_execution", twin(POWER, EXECUTIONS, body="""
SELECT run_id, e.device, count(*) AS n_samples, round(avg(watts), 6) AS mean_w, min(watts) AS min_w, max(watts) AS max_w
FROM executions e JOIN power p ON p.device = e.device AND p.ts BETWEEN e.t0 AND e.t1 GROUP BY ALL"""))
def samples_in_execution(t):
    pairs = power.range_join(t.executions(), t.samples(), bucket_s=6 * 3600)
    return pairs.groupBy("run_id", "device").agg(
        F.count("*").alias("n_samples"),
        F.round(F.avg("watts"), 6).alias("mean_w"),
        F.min("watts").alias("min_w"),
        F.max("watts").alias("max_w"),
    )


@query("j14_counter_as_of", twin(POWER, EXECUTIONS, body="""
SELECT e.run_id, e.device, b.counter_kwh AS kwh_before, f.counter_kwh AS kwh_after,
       (f.counter_kwh - b.counter_kwh) * 3.6e6 AS gross_energy_j
FROM executions e ASOF LEFT JOIN power b ON b.device = e.device AND b.ts <= e.t0
ASOF LEFT JOIN power f ON f.device = e.device AND f.ts <= e.t1"""))
def counter_as_of(t):
    return power.asof_join(t.executions(), t.power(), time_chunk("ts", DAY))


@query("j15_unblind", twin(RAW, body="""
SELECT run_id, precision, q_ped AS given FROM raw_runs WHERE q_ped IS NOT NULL"""))
def unblind(t):
    rows = t.raw_runs().select("run_id", "precision", "q_ped")
    sheet, key = panel.blind_sheet(rows.withColumnRenamed("q_ped", "given"), "run_id", "precision", "salt-1")
    filled = sheet.filter(F.col("given").isNotNull()).select("blind_id", "given")
    return panel.unblind(filled, key)


@query("w1_first_k_per_stratum", twin(RAW, body="""
SELECT category, run_id, rn AS position FROM (
  SELECT category, run_id, row_number() OVER (PARTITION BY category ORDER BY run_id) AS rn FROM raw_runs) WHERE rn <= 20"""))
def first_k_per_stratum(t):
    picked = sampling.stratified_first(t.raw_runs().select("category", "run_id"), "category", "run_id", 20)
    return picked.withColumn("position", F.col("position").cast("bigint"))


@query("w2_random_k_per_stratum", twin(RAW, body="""
SELECT category, run_id, rn AS position FROM (
  SELECT category, run_id, row_number() OVER (PARTITION BY category
         ORDER BY md5('seed-7' || CAST(run_id AS VARCHAR)), run_id) AS rn FROM raw_runs) WHERE rn <= 20"""))
def random_k_per_stratum(t):
    rows = t.raw_runs().select("category", "run_id")
    picked = sampling.stratified_hash(rows, "category", "run_id", 20, "seed-7")
    return picked.select("category", "run_id", F.col("position").cast("bigint").alias("position"))


@query("w3_counter_delta", twin(POWER, body=f"""
SELECT device, sample_id, counter_kwh - prev_kwh AS delta_kwh, {seconds('prev_ts', 'ts')} AS elapsed_s FROM steps"""))
def counter_delta(t):
    return power.counter_delta(t.power(), time_chunk("ts", DAY)).select("device", "sample_id", "delta_kwh", "elapsed_s")


@query("w4_running_totals", twin(RUNS, body="""
SELECT precision, run_id, count(*) OVER w AS n_so_far,
       round(sum(latency_s) OVER w, 3) / count(*) OVER w AS mean_latency_so_far,
       CAST(sum(output_tokens) OVER w AS BIGINT) AS tokens_so_far
FROM runs WINDOW w AS (PARTITION BY precision ORDER BY run_id ROWS UNBOUNDED PRECEDING)"""))
def running_totals(t):
    rows = t.raw_runs().select("precision", "run_id", "latency_s", "output_tokens")
    sums = {
        "n_so_far": F.lit(1).cast("bigint"),
        "latency_so_far": F.col("latency_s"),
        "tokens_so_far": F.col("output_tokens"),
    }
    totals = running(rows, ["precision"], ["run_id"], sums, id_chunk("run_id"))
    # Latencies have three decimals, so their sum is rounded to three before the division.
    mean = F.round("latency_so_far", 3) / F.col("n_so_far")
    return totals.select("precision", "run_id", "n_so_far", mean.alias("mean_latency_so_far"), "tokens_so_far")


@query("w5_rank_configurations", twin(RUNS, body="""
SELECT platform, precision, round(lpw_mean, 6) AS lpw_mean, dense_rank() OVER (ORDER BY lpw_mean DESC, platform, precision) AS rank
FROM (SELECT platform, precision, avg(lpw) AS lpw_mean FROM runs GROUP BY ALL)"""))
def rank_configurations(t):
    summary = compare.summarise(t.runs(), ["platform", "precision"])
    placed = compare.ranked(summary, "lpw_mean", "platform", "precision")
    return placed.select("platform", "precision", F.round("lpw_mean", 6).alias("lpw_mean"), "rank")


@query("w6_latest_per_key", twin(SCORES, body="SELECT * FROM scores"))
def latest_per_key(t):
    return t.scores()


@query("w7_ratio_to_baseline", twin(RUNS, body="""
SELECT platform, precision, round(lpw_mean / max(CASE WHEN precision = 'F16' THEN lpw_mean END) OVER (PARTITION BY platform), 6)
       AS lpw_mean_vs_base
FROM (SELECT platform, precision, avg(lpw) AS lpw_mean FROM runs GROUP BY ALL)"""))
def ratio_to_baseline(t):
    summary = compare.summarise(t.runs(), ["platform", "precision"])
    rel = compare.relative_to(summary, "platform", "precision", F16, "lpw_mean")
    return rel.select("platform", "precision", F.round("lpw_mean_vs_base", 6).alias("lpw_mean_vs_base"))


@query("w8_forward_fill", twin(RAW, body="""
SELECT device, run_id, last_value(cpu_freq_mhz IGNORE NULLS) OVER (PARTITION BY device ORDER BY started_at, run_id
       ROWS UNBOUNDED PRECEDING) AS last_freq_mhz
FROM raw_runs"""))
def forward_fill(t):
    rows = t.raw_runs().select("device", "run_id", "started_at", "cpu_freq_mhz")
    filled = fill_forward(
        rows, ["device"], ["started_at", "run_id"], "cpu_freq_mhz", "last_freq_mhz", time_chunk("started_at", DAY)
    )
    return filled.select("device", "run_id", "last_freq_mhz")


@query("w9_moving_average", twin(RUNS, body="""
SELECT precision, run_id, round(avg(latency_s) OVER w, 6) AS moving_latency_s, round(avg(tokens_per_s) OVER w, 6) AS moving_tokens_per_s
FROM runs WINDOW w AS (PARTITION BY precision ORDER BY run_id ROWS 9 PRECEDING)"""))
def moving_average(t):
    rows = t.runs().select("precision", "run_id", "latency_s", "tokens_per_s")
    values = {"moving_latency_s": F.col("latency_s"), "moving_tokens_per_s": F.col("tokens_per_s")}
    means = moving(rows, ["precision"], ["run_id"], 10, values, id_chunk("run_id"))
    return means.select("precision", "run_id", *[F.round(c, 6).alias(c) for c in values])


@query("o1_order_by_id", twin(RAW, body="SELECT run_id, category, latency_s FROM raw_runs ORDER BY run_id"))
def order_by_id(t):
    return t.raw_runs().select("run_id", "category", "latency_s").orderBy("run_id")


@query("o2_sorted_report", twin(RUNS, body="""
SELECT category, round(avg(latency_s), 2) AS avg_latency_s, round(avg(net_energy_j), 2) AS avg_net_energy_j
FROM runs GROUP BY category ORDER BY category"""))
def sorted_report(t):
    report = compare.means(t.runs(), ["category"], ["latency_s", "net_energy_j"])
    return report.select("category", *[F.round(c, 2).alias(c) for c in ("avg_latency_s", "avg_net_energy_j")]).orderBy(
        "category"
    )


@query("o3_best_prompts", twin(RUNS, body="""
SELECT run_id, precision, lpw FROM runs WHERE lpw IS NOT NULL ORDER BY lpw DESC, run_id LIMIT 25"""))
def best_prompts(t):
    scored = t.runs().filter(F.col("lpw").isNotNull()).select("run_id", "precision", "lpw")
    return scored.orderBy(F.desc("lpw"), "run_id").limit(25)


@query("u1_union_of_runs", twin(RAW, body="""
SELECT run_id, precision, latency_s FROM raw_runs WHERE precision = 'F16'
UNION ALL SELECT run_id, precision, latency_s FROM raw_runs WHERE precision = 'Q4_K_M'"""))
def union_of_runs(t):
    runs = t.raw_runs().select("run_id", "precision", "latency_s")
    one, other = (runs.filter(F.col("precision") == p) for p in PRECISIONS)
    return one.unionByName(other)


@query("u2_concatenated_corpora", twin(PROMPTS, body="""
SELECT prompt_id, prompt, CASE corpus WHEN 'A' THEN 0 ELSE 1 END AS part, prompt_id AS pos FROM prompts"""))
def concatenated_corpora(t):
    parts = [t.corpus(c).select("prompt_id", "prompt") for c in ("A", "B")]
    return sampling.concatenate(parts, "prompt_id")


@query("u3_corpus_intersection", twin(PROMPTS, body="""
SELECT prompt FROM prompts WHERE corpus = 'A' INTERSECT SELECT prompt FROM prompts WHERE corpus = 'B'"""))
def corpus_intersection(t):
    return sampling.corpus_intersection(t.corpus("A"), t.corpus("B"), "prompt")


@query("u4_corpus_difference", twin(PROMPTS, body="""
SELECT prompt FROM prompts WHERE corpus = 'A' EXCEPT SELECT prompt FROM prompts WHERE corpus = 'B'"""))
def corpus_difference(t):
    return sampling.corpus_difference(t.corpus("A"), t.corpus("B"), "prompt")
