"""Aggregation plans: summaries, panels, comparisons, distributions and energy totals."""

from pyspark.sql import functions as F

from wattsift.operators import compare, panel, power, sampling, sketches
from wattsift.operators.ordered import DAY, time_chunk
from wattsift.operators.quantiles import exact_quantiles
from wattsift.plans.registry import query
from wattsift.plans.tables import F16, PRECISIONS, Q4
from wattsift.plans.twins import EXECUTIONS, PANEL, PLATFORMS, POWER, PROMPTS, RUNS, SCORES, seconds, twin
from wattsift.session import written

ITEM = ["item_id", "precision"]
METRICS = ["latency_s", "net_energy_j", "power_net_w", "tokens_per_s"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
WEIGHTS = [0.0, 0.25, 0.5, 0.6, 0.75, 1.0]


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def avg_sql(columns):
    return ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in columns)


SUMMARY_SQL = """count(*) AS n, round(avg(latency_s), 6) AS latency_mean, round(stddev_samp(latency_s), 6) AS latency_std,
       round(avg(net_energy_j), 6) AS net_energy_mean, round(avg(power_net_w), 6) AS power_mean,
       round(avg(q_ped), 6) AS q_ped_mean, round(avg(lpw), 6) AS lpw_mean, round(avg(tokens_per_s), 6) AS tokens_per_sec"""
SUMMARY_MEANS = [
    "latency_mean", "latency_std", "net_energy_mean", "power_mean", "q_ped_mean", "lpw_mean", "tokens_per_sec",
]


@query("a1_global_means", twin(RUNS, body=f"SELECT count(*) AS n, {avg_sql(METRICS)} FROM runs"))
def global_means(t):
    return rounded(compare.means(t.runs(), [], METRICS), [f"avg_{c}" for c in METRICS])


@query("a2_ranges", twin(RUNS, body="""
SELECT min(latency_s) AS min_latency_s, max(latency_s) AS max_latency_s, min(net_energy_j) AS min_net_energy_j,
       max(net_energy_j) AS max_net_energy_j, min(q_ped) AS min_q_ped, max(q_ped) AS max_q_ped
FROM runs"""))
def ranges(t):
    return compare.ranges(t.runs(), [], ["latency_s", "net_energy_j", "q_ped"])


@query("a3_median", twin(RUNS, body="""
SELECT category, count(lpw) AS n, round(median(lpw), 6) AS lpw_median FROM runs GROUP BY category"""))
def median(t):
    return rounded(exact_quantiles(t.runs(), ["category"], "lpw", [0.5], "lpw_median").drop("prob"), ["lpw_median"])


@query("a4_category_means", twin(RUNS, body=f"""
SELECT category, count(*) AS n, {avg_sql(METRICS)} FROM runs GROUP BY category ORDER BY category"""))
def category_means(t):
    report = compare.means(t.runs(), ["category"], METRICS)
    return rounded(report, [f"avg_{c}" for c in METRICS]).orderBy("category")


@query("a5_configuration_summary", twin(RUNS, body=f"""
SELECT platform, precision, {SUMMARY_SQL} FROM runs GROUP BY platform, precision"""))
def configuration_summary(t):
    return rounded(compare.summarise(t.runs(), ["platform", "precision"]), SUMMARY_MEANS)


@query("a6_model_comparison", twin(RUNS, SCORES, body="""
, dims AS (
  SELECT precision, avg(score) FILTER (dim = 'CA') AS ca, avg(score) FILTER (dim = 'CC') AS cc,
         avg(score) FILTER (dim = 'SQ') AS sq, avg(score) FILTER (dim = 'LA') AS la
  FROM scores GROUP BY precision)
SELECT precision AS model, round(any_value(ca), 6) AS ca_mean, round(any_value(cc), 6) AS cc_mean,
       round(any_value(sq), 6) AS sq_mean, round(any_value(la), 6) AS la_mean, round(avg(q_ped), 6) AS q_ped_mean,
       round(avg(latency_s), 6) AS latency_mean, round(avg(net_energy_j), 6) AS net_energy_mean,
       round(avg(lpw), 6) AS lpw_mean
FROM runs JOIN dims USING (precision) GROUP BY precision"""))
def model_comparison(t):
    """Rubric and run means are both folded per model before they meet."""
    per_dim = [
        F.avg(F.when(F.col("dim") == d, F.col("score"))).alias(f"{d.lower()}_mean") for d in ("CA", "CC", "SQ", "LA")
    ]
    rubric = t.scores().groupBy("precision").agg(*per_dim)
    runs = compare.summarise(t.runs(), ["precision"])
    columns = [
        "ca_mean", "cc_mean", "sq_mean", "la_mean", "q_ped_mean", "latency_mean", "net_energy_mean", "lpw_mean",
    ]
    both = rubric.join(runs, "precision").select(F.col("precision").alias("model"), *columns)
    return rounded(both, columns)


@query("a7_mean_of_ratios", twin(RUNS, body="""
SELECT precision, round(avg(lpw), 6) AS mean_of_ratios,
       round(avg(q_ped) / (avg(net_energy_j) * avg(latency_s)), 6) AS ratio_of_means
FROM runs GROUP BY precision"""))
def mean_of_ratios(t):
    of_means = F.try_divide(F.avg("q_ped"), F.avg("net_energy_j") * F.avg("latency_s"))
    return t.runs().groupBy("precision").agg(
        F.round(F.avg("lpw"), 6).alias("mean_of_ratios"), F.round(of_means, 6).alias("ratio_of_means")
    )


@query("a8_conditional_counts", twin(RUNS, body="""
SELECT platform, count(*) AS n, count(*) FILTER (throttled) AS n_throttled, count(*) FILTER (output_tokens >= 200) AS n_capped,
       count(*) FILTER (q_ped IS NOT NULL) AS n_scored, count(*) FILTER (latency_s <= 0) AS n_zero_latency
FROM runs GROUP BY platform"""))
def conditional_counts(t):
    return t.runs().groupBy("platform").agg(
        F.count("*").alias("n"),
        F.count_if("throttled").alias("n_throttled"),
        F.count_if(F.col("output_tokens") >= 200).alias("n_capped"),
        F.count_if(F.col("q_ped").isNotNull()).alias("n_scored"),
        F.count_if(F.col("latency_s") <= 0).alias("n_zero_latency"),
    )


@query("a9_throttle_alarm", twin(RUNS, body="""
SELECT device, count(*) FILTER (throttled) AS n_throttled FROM runs GROUP BY device HAVING count(*) FILTER (throttled) > 10"""))
def throttle_alarm(t):
    counts = t.runs().groupBy("device").agg(F.count_if("throttled").alias("n_throttled"))
    return counts.filter(F.col("n_throttled") > 10)


REPORT = ["latency_s", "net_energy_j", "lpw"]


@query("a10_overall_and_category", twin(RUNS, body=f"""
SELECT category, CAST(grouping_id(category) AS BIGINT) AS level, count(*) AS n, {avg_sql(REPORT)}
FROM runs GROUP BY ROLLUP (category)"""))
def overall_and_category(t):
    return rounded(compare.rollup_report(t.runs(), ["category"], REPORT), [f"avg_{c}" for c in REPORT])


@query("a11_cube", twin(RUNS, body=f"""
SELECT precision, category, CAST(grouping_id(precision, category) AS BIGINT) AS level, count(*) AS n, {avg_sql(REPORT)}
FROM runs GROUP BY CUBE (precision, category)"""))
def cube(t):
    return rounded(compare.cube_report(t.runs(), ["precision", "category"], REPORT), [f"avg_{c}" for c in REPORT])


@query("a11_grouping_sets", twin(RUNS, body=f"""
SELECT platform, precision, category, CAST(grouping_id(platform, precision, category) AS BIGINT) AS level, count(*) AS n, {avg_sql(REPORT)}
FROM runs GROUP BY GROUPING SETS ((platform, precision), (precision, category), (platform), ())"""))
def grouping_sets(t):
    sets = [["platform", "precision"], ["precision", "category"], ["platform"], []]
    report = compare.sets_report(t.runs(), ["platform", "precision", "category"], sets, REPORT)
    return rounded(report, [f"avg_{c}" for c in REPORT])


@query("a12_pivot", twin(RUNS, body="""
SELECT platform, """ + ", ".join(
    f"""round(avg({m}) FILTER (precision = '{p}'), 6) AS "{p}_{m}\"""" for p in PRECISIONS for m in ("lpw", "latency_s")
) + " FROM runs GROUP BY platform"))
def pivot(t):
    wide = compare.pivot_config(t.runs(), "platform", "precision", PRECISIONS, ["lpw", "latency_s"])
    return rounded(wide, [c for c in wide.columns if c != "platform"])


@query("a13_panel_means", twin(PANEL, body="""
SELECT item_id, precision, dim, round(human_mean, 6) AS human_mean, round(ai_mean, 6) AS ai_mean, n_human, n_ai FROM panel"""))
def panel_means(t):
    return rounded(panel.panel_means(t.scores(), ITEM), ["human_mean", "ai_mean"])


@query("a14_hybrid_score", twin(PANEL, body="""
SELECT item_id, precision, dim, round(0.6e0 * human_mean + 0.4e0 * ai_mean, 6) AS weighted FROM panel"""))
def hybrid_score(t):
    rows = panel.hybrid(panel.panel_means(t.scores(), ITEM))
    return rows.select(*ITEM, "dim", F.round("weighted", 6).alias("weighted"))


@query("a15_quality", twin(PANEL, body="SELECT item_id, precision, round(q_ped, 6) AS q_ped FROM quality"))
def quality(t):
    rows = panel.q_ped(panel.hybrid(panel.panel_means(t.scores(), ITEM)), ITEM)
    return rows.select(*ITEM, F.round("q_ped", 6).alias("q_ped"))


@query("a16_ratio_table", twin(RUNS, PANEL, body="""
, scored AS (
  SELECT r.platform, r.precision, r.latency_s, r.net_energy_j, q.q_ped,
         CASE WHEN net_energy_j * latency_s > 0 THEN q.q_ped / (net_energy_j * latency_s) ELSE 0e0 END AS lpw
  FROM runs r JOIN quality q USING (item_id, precision)),
sides AS (
  SELECT platform, avg(latency_s) FILTER (precision = 'F16') AS la, avg(latency_s) FILTER (precision = 'Q4_K_M') AS lb,
         avg(net_energy_j) FILTER (precision = 'F16') AS ea, avg(net_energy_j) FILTER (precision = 'Q4_K_M') AS eb,
         avg(q_ped) FILTER (precision = 'F16') AS qa, avg(q_ped) FILTER (precision = 'Q4_K_M') AS qb,
         avg(lpw) FILTER (precision = 'F16') AS wa, avg(lpw) FILTER (precision = 'Q4_K_M') AS wb
  FROM scored GROUP BY platform)
SELECT platform, round(lb / la, 6) AS latency_ratio, round((eb - ea) / ea * 100e0, 6) AS energy_pct_of_base,
       round(qb - qa, 6) AS quality_diff, round(wb / wa, 6) AS lpw_ratio
FROM sides"""))
def ratio_table(t):
    """Scores to panels to item quality, joined to folded runs, compared per platform."""
    folded = compare.fold_runs(t.runs(), ["platform", *ITEM])
    scored = folded.join(panel.quality(t.scores(), ITEM), ITEM)
    table = compare.ratio_table(scored, ["platform"], "precision", F16, Q4)
    return rounded(table, ["latency_ratio", "energy_pct_of_base", "quality_diff", "lpw_ratio"])


@query("a17_paired_differences", twin(RUNS, body="""
, pairs AS (
  SELECT a.latency_s - b.latency_s AS diff, CASE WHEN b.latency_s <> 0 THEN a.latency_s / b.latency_s END AS ratio,
         CAST(a.latency_s > b.latency_s AS INT) AS wins
  FROM runs a JOIN runs b ON a.prompt_id = b.prompt_id AND a.precision = 'F16' AND b.precision = 'Q4_K_M')
SELECT count(diff) AS n_pairs, round(avg(diff), 6) AS diff_mean, round(stddev_samp(diff), 6) AS diff_std,
       round(avg(ratio), 6) AS ratio_mean, round(avg(wins), 6) AS share_a_above_b, round(median(diff), 6) AS diff_median
FROM pairs"""))
def paired_differences(t):
    pairs = compare.paired(t.runs(), "prompt_id", "precision", F16, Q4, ["latency_s"])
    stats = compare.paired_statistics(pairs, "latency_s")
    return rounded(stats, ["diff_mean", "diff_std", "ratio_mean", "share_a_above_b", "diff_median"])


@query("a18_ratio_of_ratios", twin(RUNS, body="""
, r AS (
  SELECT avg(lpw) FILTER (regime = 'cache_on' AND precision = 'F16') / avg(lpw) FILTER (regime = 'cache_on' AND precision = 'Q4_K_M') AS ratio_on,
         avg(lpw) FILTER (regime = 'cache_off' AND precision = 'F16') / avg(lpw) FILTER (regime = 'cache_off' AND precision = 'Q4_K_M') AS ratio_off
  FROM runs)
SELECT round(ratio_on, 6) AS ratio_on, round(ratio_off, 6) AS ratio_off, round(ratio_off / ratio_on, 6) AS overstatement FROM r"""))
def ratio_of_ratios(t):
    table = compare.ratio_of_ratios(t.runs(), "regime", "cache_on", "cache_off", "precision", F16, Q4, "lpw")
    return rounded(table, ["ratio_on", "ratio_off", "overstatement"])


@query("a19_winner", twin(RUNS, body="""
, m AS (SELECT platform, precision, avg(lpw) AS lpw FROM runs GROUP BY ALL),
best AS (SELECT platform, arg_max(precision, lpw) AS winner, max(lpw) AS lpw_best FROM m GROUP BY platform)
SELECT platform, winner, round(lpw_best, 6) AS lpw_best,
       winner <> (SELECT winner FROM best WHERE platform = 0) AS reversed
FROM best"""))
def winner(t):
    return rounded(compare.winner(t.runs(), "platform", "precision", "lpw", 0), ["lpw_best"])


@query("a20_histogram", twin(RUNS, body="""
SELECT precision, CASE WHEN lpw < 0 THEN 0 WHEN lpw >= 2 THEN 21 ELSE CAST(floor(lpw / 2e0 * 20) AS BIGINT) + 1 END AS bin,
       count(*) AS n
FROM runs WHERE lpw IS NOT NULL GROUP BY ALL"""))
def histogram(t):
    return compare.histogram(t.runs(), ["precision"], "lpw", 0.0, 2.0, 20)


@query("a20_quantiles", twin(RUNS, body="UNION ALL ".join(f"""
SELECT precision, {p}e0 AS prob, count(lpw) AS n, round(quantile_cont(lpw, {p}), 6) AS lpw FROM runs GROUP BY precision
""" for p in PROBS)))
def quantiles(t):
    return rounded(exact_quantiles(t.runs(), ["precision"], "lpw", PROBS, "lpw"), ["lpw"])


@query("a21_weight_sweep", twin(RUNS, PANEL, body=f"""
, weights AS (SELECT unnest([{', '.join(f'{w}e0' for w in WEIGHTS)}]) AS w_human),
swept AS (
  SELECT item_id, precision, w_human, avg(w_human * human_mean + (1e0 - w_human) * ai_mean) AS q
  FROM panel, weights GROUP BY ALL HAVING count(w_human * human_mean + (1e0 - w_human) * ai_mean) = 4)
SELECT precision, w_human, count(*) AS n_runs, round(avg(q), 6) AS q_ped_mean,
       round(avg(CASE WHEN net_energy_j * latency_s > 0 THEN q / (net_energy_j * latency_s) ELSE 0e0 END), 6) AS lpw_mean
FROM runs JOIN swept USING (item_id, precision) GROUP BY ALL"""))
def weight_sweep(t):
    """Runs are folded to one row per item before the weights multiply anything."""
    runs = compare.fold_runs(t.runs(), ITEM)
    swept = panel.weight_sweep(t.scores(), ITEM, WEIGHTS).join(runs, ITEM)
    n = F.sum("runs")
    return swept.groupBy("precision", "w_human").agg(
        n.alias("n_runs"),
        F.round(F.sum(F.col("q_ped") * F.col("runs")) / n, 6).alias("q_ped_mean"),
        F.round(F.try_divide(F.sum(F.col("q_ped") * F.col("per_js_total")), F.sum("per_js_runs")), 6).alias("lpw_mean"),
    )


@query("a22_bandwidth", twin(RUNS, PLATFORMS, body="""
, s AS (SELECT platform, precision, avg(latency_s) AS lat, any_value(mem_bw_gbs) AS bw
        FROM runs JOIN platforms USING (platform) GROUP BY ALL)
SELECT s.platform, s.precision, round(s.bw / b.bw, 6) AS bw_ratio, round(b.lat / s.lat, 6) AS speed_ratio,
       round((b.lat / s.lat) / (s.bw / b.bw), 6) AS speed_per_bw
FROM s JOIN s b ON b.platform = 1 AND b.precision = s.precision"""))
def bandwidth(t):
    summary = compare.summarise(t.runs(), ["platform", "precision"])
    table = compare.bandwidth_table(summary, t.platforms(), 1)
    return rounded(table, ["bw_ratio", "speed_ratio", "speed_per_bw"])


@query("a23_integrated_energy", twin(POWER, body=f"""
SELECT device, round(coalesce(sum((watts + prev_w) / 2e0 * ({seconds('prev_ts', 'ts')})), 0e0), 3) AS energy_j, count(*) AS n
FROM steps GROUP BY device"""))
def integrated_energy(t):
    return rounded(power.integrate(t.samples(), time_chunk("ts", DAY)), ["energy_j"], 3)


@query("a23_energy_per_execution", twin(POWER, EXECUTIONS, body="""
, micro AS (
  SELECT device, sample_id, epoch_us(ts) AS us, CAST(round(watts * 1e6) AS BIGINT) AS uw FROM power),
parts AS (
  SELECT *, lead(us) OVER w AS next_us, lead(uw) OVER w AS next_uw
  FROM micro WINDOW w AS (PARTITION BY device ORDER BY us, sample_id)),
lines AS (SELECT *, (next_uw - uw) / CAST(next_us - us AS DOUBLE) AS slope FROM parts WHERE next_us > us),
asked AS (SELECT run_id, device, epoch_us(t0) AS t0, epoch_us(t1) AS t1 FROM executions),
cut AS (
  SELECT run_id, us >= t0 AND next_us <= t1 AS whole, CAST(uw + next_uw AS HUGEINT) * (next_us - us) AS twice,
         greatest(us, t0) - us AS x, least(next_us, t1) - us AS y, uw, slope
  FROM asked e JOIN lines s ON s.device = e.device AND s.next_us > e.t0 AND s.us < e.t1),
sums AS (
  SELECT run_id, coalesce(sum(twice) FILTER (whole), 0) AS inner_twice,
         coalesce(sum((y - x) * (2e0 * uw + slope * (x + y))) FILTER (NOT whole), 0e0) AS ends_twice
  FROM cut GROUP BY run_id),
span AS (SELECT device, min(us) AS first, max(us) AS last FROM micro GROUP BY device)
SELECT e.run_id, e.device, round((coalesce(CAST(inner_twice AS DOUBLE), 0e0) + coalesce(ends_twice, 0e0)) / 2e12, 2) AS energy_j,
       coalesce(first <= t0 AND t1 <= last, false) AS covered
FROM asked e LEFT JOIN sums USING (run_id) LEFT JOIN span USING (device)"""))
def energy_per_execution(t):
    """Energy of every execution out of the power samples of its device."""
    days = time_chunk("ts", DAY)
    index = written(power.energy_index(t.samples(), days), "energy-index")
    return rounded(power.energy_between(t.executions(), index, days), ["energy_j"], 2)


@query("a24_idle_baseline", twin(POWER, body="""
, windows AS (SELECT device, min(ts) AS t0, min(ts) + INTERVAL 1 DAY AS t1 FROM power GROUP BY device)
SELECT w.device, coalesce((max(counter_kwh) - min(counter_kwh)) * 3.6e6 / 86400e0, 0e0) AS idle_w
FROM windows w LEFT JOIN power p ON p.device = w.device AND p.ts BETWEEN w.t0 AND w.t1 GROUP BY w.device"""))
def idle_baseline(t):
    samples = t.power()
    first = F.min("ts")
    windows = t.samples().groupBy("device").agg(
        first.alias("t0"), (first + F.expr("INTERVAL 1 DAY")).alias("t1")
    )
    return power.idle_baseline(samples, windows, 86_400.0)


@query("a25_distinct_prompts", twin(PROMPTS, body="""
SELECT corpus, count(*) AS n, count(DISTINCT prompt) AS n_distinct, count(*) - count(DISTINCT prompt) AS n_surplus
FROM prompts GROUP BY corpus"""))
def distinct_prompts(t):
    return sampling.distinct_counts(t.prompts(), ["corpus"], "prompt")


@query("a25_distinct_prompts_approx")
def distinct_prompts_approx(t):
    return sampling.approximate_distinct(t.prompts(), ["corpus"], "prompt")


@query("a25_sketched_prompts", twin(PROMPTS, body="""
SELECT corpus, count(*) AS n, count(DISTINCT prompt) AS n_distinct, true AS within FROM prompts GROUP BY corpus
UNION ALL
SELECT 'both' AS corpus, count(*) AS n, count(*) AS n_distinct, true AS within
FROM (SELECT prompt FROM prompts WHERE corpus = 'A' INTERSECT SELECT prompt FROM prompts WHERE corpus = 'B') shared
WHERE prompt IS NOT NULL"""))
def sketched_prompts(t):
    """Distinct prompts of each corpus, and those of both, out of stored sketches per category: ``within`` tells whether the
    exact number lies within the error that the sketches state."""
    stored = written(sketches.sketch(t.prompts(), ["corpus", "category"], "prompt"), "sketches")
    estimated = sketches.distinct(stored, ["corpus"]).drop("n")
    both = sketches.shared(stored, [], "corpus", "A", "B").select(F.lit("both").alias("corpus"), "*")
    folded = t.prompts().groupBy("prompt").agg(
        F.count_if(F.col("corpus") == "A").alias("A"), F.count_if(F.col("corpus") == "B").alias("B")
    )
    text = F.col("prompt").isNotNull()
    held = lambda of: F.count_if(of & text)
    shared = (F.col("A") > 0) & (F.col("B") > 0)
    entry = lambda name, n, d: F.struct(F.lit(name).alias("corpus"), n.alias("n"), d.alias("n_distinct"))
    exact = folded.agg(
        F.array(
            entry("A", F.sum("A"), held(F.col("A") > 0)), entry("B", F.sum("B"), held(F.col("B") > 0)),
            entry("both", held(shared), held(shared)),
        ).alias("e")
    ).select(F.inline("e"))
    within = F.col("n_distinct").between(F.col("at_least"), F.col("at_most"))
    return exact.join(estimated.unionByName(both), "corpus").select("corpus", "n", "n_distinct", within.alias("within"))
