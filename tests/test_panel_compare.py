import pytest
from pyspark.sql import functions as F

from tests.conftest import collected
from wattsift.operators import compare, panel, sampling

SCORE = "item_id long, rater_id long, rater_kind string, dim string, score long"


def full_item(item, human, ai):
    out = []
    for dim in ("CA", "CC", "SQ", "LA"):
        out += [(item, r, "human", dim, human) for r in range(10)]
        out += [(item, r, "ai", dim, ai) for r in range(10, 13)]
    return out


def test_hybrid_quality(rows):
    incomplete = [s for s in full_item(2, 6, 6) if s[3] != "LA"]
    no_ai = [s for s in full_item(3, 6, 6) if s[2] == "human"]
    scores = rows(SCORE, *full_item(1, 8, 6), *incomplete, *no_ai)
    expected = [(1, pytest.approx(0.6 * 8 + 0.4 * 6))]
    by_steps = panel.q_ped(panel.hybrid(panel.panel_means(scores, ["item_id"])), ["item_id"])
    assert collected(by_steps, "item_id", "q_ped") == expected
    assert collected(panel.quality(scores, ["item_id"]), "item_id", "q_ped") == expected
    means = panel.panel_means(scores.filter("item_id = 3 AND dim = 'CA'"), ["item_id"])
    assert collected(panel.hybrid(means), "ai_mean", "weighted", "n_ai") == [(None, None, 0)]


def test_weight_sweep_spans_the_panels(rows):
    swept = panel.weight_sweep(rows(SCORE, *full_item(1, 8, 6)), ["item_id"], [0.0, 0.6, 1.0])
    assert collected(swept, "w_human", "q_ped") == [(0.0, 6.0), (0.6, pytest.approx(7.2)), (1.0, 8.0)]


def test_outstanding_ratings(rows):
    items = rows("item_id long", (1,), (2,))
    scores = rows(SCORE, *[(1, r, "human", "CA", 5) for r in range(13) if r not in (3, 11)], (1, 99, "human", "CA", 5))
    got = panel.outstanding(scores, ["item_id"], items)
    assert collected(got) == [(1, 11), (1, 3)] + sorted([(2, r) for r in range(13)], key=repr)


def test_blind_sheet_hides_and_restores_the_configuration(rows):
    df = rows("run_id long, precision string, response string", (1, "F16", "x"), (1, "Q4", "y"), (2, "F16", "z"))
    sheet, key = panel.blind_sheet(df, "run_id", "precision", "s")
    assert sheet.columns == ["blind_id", "response", "CA", "CC", "SQ", "LA", "Notes"]
    assert sheet.select("blind_id").distinct().count() == 3
    back = panel.unblind(sheet, key)
    assert collected(back, "run_id", "precision", "response") == collected(df)


def test_rubric_reshapes_both_ways(rows):
    scores = rows(SCORE, *[s for s in full_item(1, 8, 6) if s[1] in (0, 12)], (2, 0, "human", "CA", 4))
    wide = panel.wide_rubric(scores, ["item_id", "rater_id", "rater_kind"])
    assert collected(wide.filter("item_id = 2"), "CA", "CC", "q_single") == [(4, None, None)]
    long = panel.long_rubric(wide.drop("q_single"), ["item_id", "rater_id", "rater_kind"])
    assert collected(long.select("item_id", "rater_id", "rater_kind", "dim", "score")) == collected(scores)


RUN = "prompt_id long, platform long, precision string, latency_s double, net_energy_j double, power_net_w double, q_ped double, lpw double, tokens_per_s double"


@pytest.fixture
def runs(rows):
    return rows(
        RUN,
        (1, 0, "A", 2.0, 10.0, 5.0, 8.0, 0.4, 10.0),
        (1, 0, "B", 4.0, 5.0, 1.25, 6.0, 0.3, 5.0),
        (2, 1, "A", 4.0, 20.0, 5.0, None, None, 5.0),
        (2, 1, "B", 1.0, 10.0, 10.0, 9.0, 0.9, 20.0),
        (2, 1, "B", 3.0, 10.0, 10.0, 9.0, 0.3, 20.0),
        (3, 1, "A", 9.0, 9.0, 1.0, 9.0, 0.1, 1.0),
    )


def test_summary_uses_sample_deviation_and_mean_of_ratios(runs):
    got = compare.summarise(runs.filter("precision = 'B'"), ["precision"]).first()
    assert got.n == 3
    assert got.latency_std == pytest.approx(1.5275252316519465)
    assert got.lpw_mean == pytest.approx(0.5)


def test_pairs_average_repeats_and_need_both_sides(runs):
    got = compare.paired(runs, "prompt_id", "precision", "A", "B", ["latency_s"])
    assert collected(got) == [(1, 2.0, 4.0), (2, 4.0, 2.0)]
    stats = compare.paired_statistics(got, "latency_s").first()
    assert (stats.n_pairs, stats.diff_mean, stats.diff_median, stats.share_a_above_b) == (2, 0.0, 0.0, 0.5)


def test_rollup_total_equals_the_plain_mean(runs):
    report = compare.rollup_report(runs, ["precision"], ["latency_s", "q_ped"])
    total = report.filter("level = 1").first()
    plain = compare.means(runs, [], ["latency_s", "q_ped"]).first()
    assert (total.n, total.avg_latency_s, total.avg_q_ped) == (plain.n, plain.avg_latency_s, plain.avg_q_ped)
    cube = compare.cube_report(runs, ["platform", "precision"], ["latency_s"])
    assert cube.count() == 4 + 2 + 2 + 1


def test_ratio_table_names_its_base(runs):
    folded = compare.fold_runs(runs.filter("prompt_id = 1"), ["platform", "precision", "q_ped"])
    got = compare.ratio_table(folded, ["platform"], "precision", "A", "B").first()
    assert (got.latency_ratio, got.energy_pct_of_base, got.quality_diff) == (2.0, -50.0, -2.0)
    assert got.lpw_ratio == pytest.approx(0.75)


def test_missing_energy_stays_out_of_ratios(rows):
    runs = rows(
        "platform int, precision string, q_ped double, latency_s double, net_energy_j double",
        (0, "F16", 8.0, 1.0, 4.0), (0, "F16", 8.0, 1.0, None), (0, "Q4", 8.0, 1.0, 2.0), (0, "Q4", 8.0, None, 1.0),
    )
    folded = compare.fold_runs(runs, ["platform", "precision", "q_ped"])
    got = compare.ratio_table(folded, ["platform"], "precision", "F16", "Q4").first()
    assert (got.latency_ratio, got.energy_pct_of_base, got.quality_diff, got.lpw_ratio) == (1.0, -62.5, 0.0, 2.0)


def test_winner_and_reversal(runs):
    got = compare.winner(runs, "platform", "precision", "lpw", 0)
    assert collected(got, "platform", "winner", "reversed") == [(0, "A", False), (1, "B", True)]


def test_rank_relative_and_histogram(runs):
    summary = compare.summarise(runs, ["platform", "precision"])
    ranked = compare.ranked(summary, "lpw_mean", "platform")
    assert collected(ranked, "rank", "platform", "precision") == [(1, 1, "B"), (2, 0, "A"), (3, 0, "B"), (4, 1, "A")]
    relative = compare.relative_to(summary, "platform", "precision", "A", "lpw_mean")
    assert collected(relative.filter("platform = 0 AND precision = 'B'"), "lpw_mean_vs_base") == [(pytest.approx(0.75),)]
    bins = compare.histogram(runs, ["precision"], "lpw", 0.0, 0.8, 2)
    assert collected(bins.filter("precision = 'B'"), "bin", "n") == [(1, 2), (3, 1)]


def test_memory_fit_is_complete_and_salted(spark):
    models = spark.range(200).select(F.col("id").alias("m"), (F.col("id") % 23 * 1.5).alias("need"))
    platforms = spark.range(1, 7).select(F.col("id").alias("p"), (F.col("id") * 5.0 - 1).alias("have"))
    got = sampling.fits(models, platforms, "need", "have", step=2.0, salts=3)
    want = models.join(platforms, F.expr("need <= have"))
    assert collected(got, "m", "p") == collected(want, "m", "p")


def test_samples_and_distinct(rows):
    df = rows("c string, id long", *[("x" if i % 3 else "y", i) for i in range(30)])
    assert collected(sampling.stratified_first(df, "c", "id", 2), "c", "id") == [("x", 1), ("x", 2), ("y", 0), ("y", 3)]
    once = collected(sampling.stratified_hash(df, "c", "id", 4, "s"), "c", "id")
    assert once == collected(sampling.stratified_hash(df.repartition(5), "c", "id", 4, "s"), "c", "id")
    assert len(once) == 8
    texts = rows("c string, t string", ("x", "a"), ("x", "a"), ("x", "b"), ("y", "a"))
    assert collected(sampling.distinct_counts(texts, ["c"], "t")) == [("x", 3, 2, 1), ("y", 1, 1, 0)]


def test_votes_fold_by_hash(spark):
    from wattsift.plans.tables import Tables

    plan = Tables(spark, "/root/testdata/sf0.001").scores()._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_ranks_say_what_the_pairs_say(rows):
    needs = [0.5, 2.0, 2.0, 7.99, 8.0, 8.01, 64.0, 65.0, None]
    have = [4.0, 8.0, 8.0, 2.0, 64.0, 16.0, None]
    models = rows("m int, need double", *enumerate(needs))
    platforms = rows("p int, have double", *enumerate(have))
    ranked = sampling.ranked_capacities(platforms, "have", step=3.0)
    assert collected(ranked, "p", "rank") == sorted([(0, 2), (1, 3), (2, 3), (3, 1), (4, 6), (5, 5), (6, None)], key=repr)
    got = sampling.fit_ranks(models, platforms, "need", "have", step=3.0)
    ranks = {r.p: r["rank"] for r in ranked.collect() if r["rank"]}
    pairs = sorted((r.m, p) for r in got.collect() if r.first_rank for p, rank in ranks.items() if rank >= r.first_rank)
    assert pairs == sorted((m, p) for m, n in enumerate(needs) for p, h in enumerate(have) if n is not None and h is not None and n <= h)
    assert collected(got, "m", "n_fit") == [(m, sum(1 for h in have if n is not None and h is not None and h >= n)) for m, n in enumerate(needs)]
    assert sampling.fit_ranks(models, platforms.limit(0), "need", "have").filter("first_rank IS NOT NULL OR n_fit <> 0").count() == 0
