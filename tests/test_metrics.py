import pytest
from pyspark.sql import functions as F

from wattsift.functions import metrics as M
from wattsift.functions import sensors as S
from wattsift.functions import text as X
from wattsift.operators import checks, enrich

RUN = "gross_energy_j double, idle_w double, latency_s double, output_tokens int, q_ped double"


def one(df):
    return df.first().asDict()


def test_metrics_of_a_plain_run(rows):
    got = one(enrich.with_metrics(rows(RUN, (100.0, 2.0, 10.0, 50, 8.0))))
    assert got["net_energy_j"] == 80.0
    assert got["power_net_w"] == 8.0 and got["power_gross_w"] == 10.0
    assert got["tokens_per_s"] == 5.0
    assert got["lpw"] == pytest.approx(0.01)


def test_energy_floor_and_zero_latency(rows):
    floored = one(enrich.with_metrics(rows(RUN, (1.0, 2.0, 10.0, 50, 8.0))))
    assert floored["net_energy_j"] == 0.01
    still = one(enrich.with_metrics(rows(RUN, (1.0, 2.0, 0.0, 50, 8.0))))
    assert still["power_net_w"] == 0.0 and still["tokens_per_s"] == 0.0 and still["lpw"] == 0.0


def test_missing_inputs_stay_missing(rows):
    unmeasured = one(enrich.with_metrics(rows(RUN, (None, 2.0, 10.0, 50, 8.0))))
    assert unmeasured["net_energy_j"] is None and unmeasured["lpw"] is None
    unscored = one(enrich.with_metrics(rows(RUN, (100.0, 2.0, 10.0, 50, None))))
    assert unscored["lpw"] is None and unscored["net_energy_j"] == 80.0


def test_imputed_energy_is_flagged(rows):
    df = rows("net_energy_j double, latency_s double", (None, 3.0), (5.0, 3.0))
    got = [tuple(r) for r in enrich.impute_energy(df, 20.0).collect()]
    assert got == [(60.0, 3.0, True), (5.0, 3.0, False)]


def test_throttle_needs_a_known_frequency(rows):
    df = enrich.with_throttled(rows("cpu_freq_mhz double", (2099.0,), (2100.0,), (None,)))
    assert [r.throttled for r in df.collect()] == [True, False, False]


def test_token_cap_on_counts_and_arrays(rows):
    counts = enrich.cap_tokens(rows("output_tokens int", (199,), (200,), (250,)))
    assert [(r.output_tokens, r.cap_hit) for r in counts.collect()] == [(199, False), (200, True), (200, True)]
    arrays = enrich.cap_tokens(rows("t array<string>", (["a", "b", "c"],), (["a"],)), 2, "t")
    assert [(r.t, r.cap_hit) for r in arrays.collect()] == [(["a", "b"], True), (["a"], False)]


def test_category_bands(rows):
    df = rows("i int", (0,), (99,), (100,), (399,), (400,), (499,)).select(enrich.band_category(F.col("i")).alias("c"))
    expected = ["Mathematics", "Mathematics", "Science", "Humanities", "Meta-cognition", "Meta-cognition"]
    assert [r.c for r in df.collect()] == expected


def test_rounding_is_half_up_in_decimal(rows):
    df = enrich.round_columns(rows("latency_s double, power_net_w double", (1.00005, 2.675)))
    assert tuple(df.first()) == (1.0001, 2.68)


def test_text_helpers(rows):
    df = rows("t string", ("\n\t a  b \n",), ("",), (None,))
    got = df.select(X.strip_ws(F.col("t")).alias("s"), X.tokens(F.col("t")).alias("w")).collect()
    assert [tuple(r) for r in got] == [("a  b", ["a", "b"]), ("", []), (None, None)]


def test_labels(rows):
    df = rows("c string, p string", ("Programming_CS", "F16_GGUF"), (" metacognition", "nf4"), ("Other ", "INT8"))
    got = df.select(X.category_label(F.col("c")), X.precision_label(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("Programming-CS", "F16"), ("Meta-cognition", "NF4"), ("Other", "INT8")]


def test_model_label_split(rows):
    df = rows("m string", ("Some Model 3B FP16",), ("Other v0.3",))
    got = df.select(X.model_name(F.col("m")), X.model_precision(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("Some Model 3B", "FP16"), ("Other v0.3", None)]


def test_blank_numbers(rows):
    df = rows("t string", ("",), ("  ",), ("1.5",), ("x",)).select(X.number_or_null(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [None, None, 1.5, None]


def test_sensor_replies_fall_back(rows):
    df = rows(
        "c string, cs string, t string, ts string",
        ("frequency(48)=2400000000\n", None, "temp=51.5'C\n", None),
        ("error", "1800400\n", "error", "48312\n"),
        (None, "n/a", None, None),
    )
    got = df.select(S.clock_mhz(F.col("c"), F.col("cs")), S.celsius(F.col("t"), F.col("ts"))).collect()
    assert [tuple(r) for r in got] == [(2400.0, 51.5), (1800.0, 48.3), (None, None)]


def test_expectations_and_split(rows):
    df = rows("x int", (1,), (2,), (None,))
    checked = {r["rule"]: (r["actual"], r["ok"]) for r in checks.expect(df, {"rows": (F.count("*"), 3), "x": (F.count("x"), 3)}).collect()}
    assert checked == {"rows": (3, True), "x": (2, False)}
    good, bad = checks.split_valid(df, F.col("x") > 1)
    assert (good.count(), bad.count()) == (1, 2)


def test_audit_finds_changed_values(rows):
    schema = "run_id int, latency_s double, net_energy_j double, q_ped double, power_net_w double, lpw double"
    df = rows(schema, (1, 2.0, 10.0, 8.0, 5.0, 0.4), (2, 2.0, 10.0, 8.0, 5.1, 0.4), (3, 2.0, 10.0, None, 5.0, None))
    failed = checks.audit(df, {"power_net_w": 0.01, "lpw": 1e-8}).collect()
    assert [r.run_id for r in failed] == [2]


def test_joules_and_seconds(spark):
    assert spark.range(1).select(M.joules(F.lit(0.001))).first()[0] == pytest.approx(3600.0)
