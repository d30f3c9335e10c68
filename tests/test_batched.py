"""Calls in batches: one question for equal rows, attempts, and the cause of every failure."""

import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import collected
from wattsift.operators.batched import Calls, ask_judge, ask_model, call

FAST = Calls(size=4, at_once=2, attempts=3, wait_s=0.0)


def test_attempts_until_the_way_is_free():
    seen = []

    def ask(questions):
        seen.append(list(questions))
        if len(seen) < 3:
            raise TimeoutError("slow")
        return [q.upper() for q in questions]

    assert call(ask, ["a", "b"], FAST) == [("A", 3, None), ("B", 3, None)]


def test_one_bad_question_costs_no_other_its_answer():
    def ask(questions):
        if "bad" in questions:
            raise KeyError("x")
        return questions

    got = call(ask, ["a", "bad", "b", "c", "d"], FAST)
    assert [(a, e) for a, _, e in got] == [("a", None), (None, "KeyError: 'x'"), ("b", None), ("c", None), ("d", None)]
    assert max(n for _, n, _ in got) <= 4


def test_attempts_are_bounded_and_waits_repeat():
    def ask(questions):
        raise ConnectionError("down")

    assert call(ask, ["a"], FAST) == [(None, 3, "ConnectionError: down")]
    how = Calls(wait_s=1.0, seed=3)
    waits = [how.wait("a", k) for k in range(3)]
    assert waits == [how.wait("a", k) for k in range(3)] != [how.wait("b", k) for k in range(3)]
    assert all(0.5 * 2**k <= w <= 2**k for k, w in enumerate(waits))


def test_a_wrong_number_of_answers_stops_the_job():
    with pytest.raises(ValueError, match="1 answers to 2"):
        call(lambda questions: questions[:1], ["a", "b"], FAST)


def test_equal_prompts_are_asked_once(spark, tmp_path):
    def loader():
        import uuid

        def ask(questions):
            assert len(questions) <= 4
            for q in questions:
                (tmp_path / f"{q or 'empty'}-{uuid.uuid4().hex}").write_text("")
            return [(q + "!", len(q), 1) for q in questions]

        return ask

    # one prompt holds a third of the rows; some are empty or NULL
    n = F.col("id")
    prompt = F.when(n % 3 == 0, "hot").when(n == 1, "").when(n != 2, (n % 20).cast("string"))
    rows = spark.range(300).select("id", prompt.alias("prompt"), F.lit("old").alias("error"))
    got = ask_model(rows, loader, how=FAST)
    assert got.count() == 300 and got.columns.count("error") == 1
    for r in got.collect():
        assert (r.response, r.input_tokens, r.error) == ((r.prompt + "!", len(r.prompt), None) if r.prompt is not None else (None,) * 3)
    asked = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()]
    assert len(asked) == len(set(asked)) == rows.select("prompt").dropna().distinct().count()


def test_calls_run_side_by_side_up_to_the_bound(spark):
    def loader():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def ask(questions):
            import time

            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.02)
            with lock:
                state["now"] -= 1
            return [(str(state["most"]), 0, 0) for _ in questions]

        return ask

    rows = spark.range(60).select(F.col("id").cast("string").alias("prompt")).coalesce(1)
    most = {int(r.response) for r in ask_model(rows, loader, how=FAST, partitions=1).collect()}
    assert max(most) == 2


def test_judge_keeps_the_cause_of_a_fallback(rows):
    def loader():
        def ask(pairs):
            return [f'{{"score": {10 // len(r)}, "reason": "x"}}' for _, r in pairs]

        return ask

    df = rows("prompt string, response string", ("p", "ab"), ("p", ""), ("p", "ab"), ("p", None), (None, "ab"))
    got = ask_judge(df, loader, FAST)
    fallback = "ZeroDivisionError: integer division or modulo by zero"
    assert collected(got, "prompt", "response", "score", "parse_ok", "error") == sorted([
        ("p", "ab", 5, True, None), ("p", "ab", 5, True, None), ("p", "", 7, False, fallback),
        ("p", None, 7, False, "no response"), (None, "ab", 7, False, "no prompt"),
    ], key=repr)


def test_no_rows(rows):
    got = ask_model(rows("prompt string"), lambda: lambda q: q, how=FAST)
    assert got.count() == 0 and got.columns == ["prompt", "response", "input_tokens", "output_tokens", "calls", "error"]
