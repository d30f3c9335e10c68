import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import collected
from wattsift import session
from wattsift.functions.replies import rubric
from wattsift.operators.apply import apply_judge, apply_model
from wattsift.operators.judging import parse_judge
from wattsift.sources import batches, checkpoints, files, scores, summary

PROMPT = "ID int, CATEGORY string, PROMPT string"


def test_prompt_csv_keeps_commas_quotes_breaks_and_blanks(spark, rows, tmp_path):
    df = rows(PROMPT, (1, "Science", 'He said "x, y"\nand left'), (2, "Math", "  padded  "), (3, "Math", "a\r\nb"))
    files.write_csv(df, f"{tmp_path}/p")
    assert collected(files.read_prompts(spark, f"{tmp_path}/p")) == collected(df)


@pytest.mark.parametrize("text", ['﻿ID,CATEGORY,PROMPT\r\n1,Math,"a, b"\r\n', 'ID,CATEGORY,PROMPT\n1,Math,"a, b"\n'])
def test_byte_order_mark_is_ignored(spark, tmp_path, text):
    (tmp_path / "p.csv").write_text(text, encoding="utf-8", newline="")
    assert collected(files.read_prompts(spark, f"{tmp_path}/p.csv")) == [(1, "Math", "a, b")]


def test_ids_beyond_32_bits_and_strange_headers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ID,CATEGORY,PROMPT\n3000000000,Math,a\n")
    assert collected(files.read_prompts(spark, f"{tmp_path}/p.csv")) == [(3_000_000_000, "Math", "a")]
    (tmp_path / "q.csv").write_text("CATEGORY,ID,PROMPT\nMath,1,a\n")
    assert collected(files.read_prompts(spark, f"{tmp_path}/q.csv")) == [(1, "Math", "a")]
    (tmp_path / "q.csv").write_text("KIND,ID,PROMPT\nMath,1,a\n")
    with pytest.raises(Exception, match="header|schema"):
        files.read_prompts(spark, f"{tmp_path}/q.csv").collect()


VARIANTS = {
    "gpu": ("1,FP16,Math,p,r,5,6,1.5,4.0,9,8,5.3,true", "run_id", 1),
    "judged": ("1,FP16,Math,p,r,1.5,8,5.3,7.5,ok,0.1", "q_ped", 7.5),
    "unscored": ("1,FP16,Math,p,r,1.5,8,5.3,,", "q_ped", None),
    "laptop": ("1,F16,Math,p,r,5,6,1.5,4.0,Laptop", "platform", "Laptop"),
    "desktop": ("1,Box,cpu,F16,Math,p,r,6,1.5,4.0,9,8,5.3,true,,", "output_tokens", 6),
    "board": ("1,Board,cpu,F16,Math,p,r,6,1.5,4.0,9,8,5.3,2000,50,true,,", "throttled", True),
    "published": ("1,Board,cpu,F16,Math,6,1.5,9,8,5.3,7.5,0.1", "lpw", 0.1),
    "models": ("Tiny Q4_K_M,Math,7,8,9,6,7.5,1.5,8,0.1,1000", "model", "Tiny Q4_K_M"),
}


@pytest.mark.parametrize("variant", sorted(VARIANTS))
def test_every_result_variant(spark, tmp_path, variant):
    from wattsift.schemas import RESULT_FILES

    line, column, value = VARIANTS[variant]
    header = ",".join(c.split()[0] for c in RESULT_FILES[variant].split(", "))
    (tmp_path / "r.csv").write_text(f"{header}\n{line}\n")
    got = files.read_runs(spark, f"{tmp_path}/r.csv", variant).collect()
    assert len(got) == 1 and got[0][column] == value and got[0].latency_s == 1.5


def test_variants_unite(spark, tmp_path):
    from wattsift.schemas import RESULT_FILES

    tables = []
    for variant in ("judged", "desktop", "published", "models"):
        header = ",".join(c.split()[0] for c in RESULT_FILES[variant].split(", "))
        (tmp_path / f"{variant}.csv").write_text(f"{header}\n{VARIANTS[variant][0]}\n")
        tables.append(files.read_csv(spark, f"{tmp_path}/{variant}.csv", RESULT_FILES[variant]))
    got = files.harmonise(*tables)
    assert collected(got, "model", "precision", "q_ped") == [
        ("Tiny", "Q4_K_M", 7.5), (None, "F16", 7.5), (None, "F16", None), (None, "FP16", 7.5),
    ]


def test_bom_is_written(rows, tmp_path):
    files.write_csv(rows(PROMPT, (1, "Math", "é")).coalesce(1), f"{tmp_path}/p", bom=True)
    part = next((tmp_path / "p").glob("*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfID,CATEGORY,PROMPT")


def test_unscored_file_has_null_scores(spark, tmp_path):
    header = "ID,Precision,Category,Prompt,Response,Latency_s,Net_Energy_J,Power_W,Qped,LpW\n"
    (tmp_path / "r.csv").write_text(header + '1,FP16,Science,"p","r\nr",1.5,2.0,1.3,,\n2,FP16,Science,p,r,1,2,2,7.5,\n')
    got = files.read_runs(spark, f"{tmp_path}/r.csv", "unscored")
    assert collected(got, "run_id", "response", "q_ped", "lpw") == [(1, "r\nr", None, None), (2, "r", 7.5, None)]


def test_unreadable_cells_of_results_are_kept(spark, tmp_path):
    header = "Precision,ID,Category,Prompt,Response,Latency_s,Net_Energy_J,Power_W,LpW,Qped\n"
    (tmp_path / "r.csv").write_text(header + "FP16,1,Science,p,r,fast,2.0,1.3,,\nFP16,2,Science,p,r,1,2,2,,good\nFP16,3,Science,p,r,1,2,2,,7\n")
    got = files.read_runs(spark, f"{tmp_path}/r.csv", "unscored")
    assert collected(got, "run_id", "latency_s", "q_ped", "unreadable") == [
        (1, None, None, "FP16,1,Science,p,r,fast,2.0,1.3,,"), (2, 1.0, None, "q_ped: good"), (3, 1.0, 7.0, None),
    ]


def test_harmonised_variants(rows):
    one = rows("ID long, Precision string, Category string, Qped int", (1, "F16_GGUF", "Programming_CS", 7))
    two = rows("ID long, HW_Platform string, Precision string, CATEGORY string", (2, "Board, 4GB", "f16", "Science "))
    got = files.harmonise(one, two).select("run_id", "platform", "precision", "category", "q_ped")
    assert collected(got) == [(1, None, "F16", "Programming-CS", 7), (2, "Board, 4GB", "F16", "Science", None)]


def test_summary_document_round_trip(spark, rows, tmp_path):
    document = {
        "BoardA": {
            "platform": "Board A, 4GB",
            "results": {"Q4": {"n": 3, "latency_mean": 1.5, "lpw_mean": 1e-4}, "F16": {"note": "needs 8GB"}},
        },
        "BoxB": {"platform": "Box B", "results": {"F16": {"n": 2, "tokens_per_sec": 4.0}}},
    }
    (tmp_path / "s.json").write_text(json.dumps(document, indent=2))
    table = summary.read_summary(spark, f"{tmp_path}/s.json", whole=True)
    assert collected(table, "platform_key", "precision", "n", "note") == [
        ("BoardA", "F16", None, "needs 8GB"), ("BoardA", "Q4", 3, None), ("BoxB", "F16", 2, None),
    ]
    summary.write_summary(table, f"{tmp_path}/out")
    assert collected(summary.read_summary(spark, f"{tmp_path}/out")) == collected(table)
    written = json.loads(summary.summary_document(table).first().value)
    assert written["BoxB"] == document["BoxB"]


def test_checkpoint_batches_and_files(spark, tmp_path):
    df = spark.range(1, 121).select(F.col("id").alias("task_id"))
    path = f"{tmp_path}/c"
    assert checkpoints.write_checkpoints(df.filter("task_id <= 70"), path, "task_id", session="a")
    assert not checkpoints.write_checkpoints(df.filter("task_id <= 70"), path, "task_id", session="a")
    assert checkpoints.write_checkpoints(df.filter("task_id > 70"), path, "task_id", session="b")
    got = batches.read_batches(spark, path, checkpoints.with_batch(df, "task_id").schema)
    assert collected(got.groupBy("batch").count()) == [(1, 50), (2, 50), (3, 20)]
    assert len(list((tmp_path / "c" / "data").iterdir())) == 2
    assert checkpoints.read_checkpoints(spark, f"{path}/data", df.schema).select("task_id").distinct().count() == 120


def test_score_sheets(spark, rows, tmp_path):
    wide = rows("item_id long, precision string, rater_id long, CA int, CC int, SQ int, LA int", (1, "F16", 4, 8, None, 7, 6))
    scores.write_scores(wide, f"{tmp_path}/human")
    got = scores.read_scores(spark, f"{tmp_path}/human", "human")
    assert collected(got, "rater_kind", "dim", "score") == [("human", "CA", 8), ("human", "LA", 6), ("human", "SQ", 7)]


REPLIES = [
    ('{"score": 8, "reason": "ok"}', (8, "ok", True)),
    (' \n{"score": 8}\n', (8, "", True)),
    ('{"score": 42, "reason": ""}', (42, "", True)),
    ('{"score": 8.9}', (8, "", True)),
    ('{"score": "9"}', (9, "", True)),
    ('{"score": "8.9"}', (7, "scoring_failed", False)),
    ('{"score": "high"}', (7, "scoring_failed", False)),
    ('{"score": null}', (7, "scoring_failed", False)),
    ('{"reason": "none"}', (7, "scoring_failed", False)),
    ('Sure! {"score": 8}', (7, "scoring_failed", False)),
    ('{"score": 8} {"score": 9}', (7, "scoring_failed", False)),
    ('{"score": 8}, {"score": 9}', (7, "scoring_failed", False)),
    ('{"score": 8}] }', (7, "scoring_failed", False)),
    ('{"score": 8}} }', (7, "scoring_failed", False)),
    ("{'score': 8}", (7, "scoring_failed", False)),
    ('{"score": 8, }', (7, "scoring_failed", False)),
    ("", (7, "scoring_failed", False)),
    (None, (7, "scoring_failed", False)),
]


def test_judge_replies(rows):
    df = rows("i int, reply string", *[(i, r) for i, (r, _) in enumerate(REPLIES)])
    got = parse_judge(df).orderBy("i").select("score", "reason", "parse_ok").collect()
    assert [tuple(r) for r in got] == [want for _, want in REPLIES]


def test_rubric_reply(rows):
    df = rows("r string", ('{"CA": 8, "CC": 7, "SQ": 6, "LA": 5}',), ('{"CA": 8}',), ("none",),
              ('{"CA":5,"CC":5,"SQ":5,"LA":5} and {"CA":1}',))
    got = df.select(rubric(F.col("r")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(8, 7, 6, 5), (8, None, None, None), (None,) * 4, (None,) * 4]


def test_model_is_loaded_once_per_partition(spark, rows, tmp_path):
    def loader():
        import uuid

        name = uuid.uuid4().hex
        (tmp_path / name).write_text("")
        return lambda prompt: (f"{name}:{prompt}", 1, 2)

    df = spark.range(50).select(F.col("id").cast("string").alias("prompt")).repartition(3)
    got = apply_model(df, loader).collect()
    assert len(got) == 50 and len(list(tmp_path.iterdir())) == 3
    assert len({r.response.split(":")[0] for r in got}) == 3
    assert all(r.latency_s >= 0 and r.output_tokens == 2 for r in got)


def test_missing_prompts_and_large_ids_pass_through(rows):
    big = 9_007_199_254_740_993
    df = rows("id long, prompt string, response string", (big, "p", "r"), (None, None, None))
    got = apply_model(df.drop("response"), lambda: lambda prompt: (prompt.upper(), 1, 2))
    assert collected(got, "id", "response", "output_tokens") == [(big, "P", 2), (None, None, None)]
    judged = apply_judge(df, lambda: lambda prompt, response: '{"score": 8}' if prompt else None)
    assert collected(judged, "id", "score", "parse_ok") == [(big, 8, True), (None, 7, False)]


def test_a_missing_stored_value_fails_the_audit(rows):
    from wattsift.operators.checks import audit

    schema = "id int, latency_s double, net_energy_j double, q_ped double, power_net_w double, lpw double"
    df = rows(schema, (1, 2.0, 4.0, 8.0, 2.0, 1.0), (2, 2.0, 4.0, 8.0, None, 1.0), (3, 2.0, None, 8.0, 2.0, None))
    assert collected(audit(df, {"power_net_w": 0.01, "lpw": 0.01}), "id") == [(2,), (3,)]


def test_a_failing_judge_falls_back_per_row(rows):
    def loader():
        return lambda prompt, response: f'{{"score": {10 // len(response)}}}'

    df = rows("prompt string, response string", ("p", "ab"), ("p", ""), ("p", "a" * 20))
    got = apply_judge(df, loader)
    assert collected(got, "score", "parse_ok", "score_ok") == [(0, True, False), (5, True, True), (7, False, True)]
    assert [r.error for r in got.filter("NOT parse_ok").collect()] == ["ZeroDivisionError: integer division or modulo by zero"]
    assert got.filter("parse_ok AND error IS NOT NULL").count() == 0


def test_work_folder_follows_the_cluster_setting(spark, monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        pass

    shared = Session()
    shared.conf = Conf(**{"spark.checkpoint.dir": "hdfs:///shared/", "spark.master": "yarn"})
    assert session.work_dir(shared, "x").startswith("hdfs:///shared/wattsift/x-")
    unset = Session()
    unset.conf = Conf(**{"spark.master": "yarn"})
    with pytest.raises(RuntimeError):
        session.work_dir(unset, "x")
