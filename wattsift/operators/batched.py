"""Model and judge calls in batches: equal questions are asked once, failures are retried and their cause is kept."""

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.functions.replies import valid_score
from wattsift.operators.judging import parse_judge
from wattsift.session import written

#: Answers to a list of prompts, one (response, input tokens, output tokens) each.
BatchModel = Callable[[list[str]], Sequence[tuple[str, int, int]]]
#: Replies to a list of (prompt, response), one each.
BatchJudge = Callable[[list[tuple[str, str]]], Sequence[str]]

#: Failures of the way to a model, which another attempt may not meet: time-outs and refused or broken connections.
PASSING = (TimeoutError, ConnectionError)


@dataclass(frozen=True)
class Calls:
    """How a task calls: questions in one call, calls at a time, attempts at a call, and the wait before the next one,
    which doubles and is spread by a draw that the seed and the question decide."""

    size: int = 32
    at_once: int = 4
    attempts: int = 4
    wait_s: float = 0.5
    seed: int = 0
    passing: tuple[type[BaseException], ...] = PASSING

    def wait(self, question: object, attempt: int) -> float:
        return self.wait_s * 2**attempt * random.Random(f"{self.seed}:{attempt}:{question}").uniform(0.5, 1.0)


def call(ask: Callable, questions: list, how: Calls) -> list[tuple[object, int, str | None]]:
    """(answer or None, calls made, cause of the failure or None) of each question of a batch.

    A passing failure is met with further attempts. A batch that fails in another way, or at every attempt, is halved and
    asked again, so that one bad question costs its neighbours no answer; alone, it gets the cause. A number of answers
    other than that of the questions is an error of the caller's code and stops the job.
    """
    made, cause = 0, None
    for attempt in range(how.attempts):
        if attempt:
            time.sleep(how.wait(questions[0], attempt - 1))
        made += 1
        try:
            answers = list(ask(questions))
        except how.passing as e:
            cause = e
        except Exception as e:
            cause = e
            break
        else:
            if len(answers) != len(questions):
                raise ValueError(f"{len(answers)} answers to {len(questions)} questions")
            return [(a, made, None) for a in answers]
    if len(questions) == 1:
        return [(None, made, f"{type(cause).__name__}: {cause}")]
    half = len(questions) // 2
    return [(a, made + n, e) for part in (questions[:half], questions[half:]) for a, n, e in call(ask, part, how)]


def ask_once(
    rows: DataFrame, columns: list[str], loader: Callable[[], Callable], fields: list[tuple[str, pa.DataType, str]],
    how: Calls, partitions: int | None,
) -> DataFrame:
    """Add ``fields``, ``calls`` and ``error`` to every row; rows with equal values in ``columns`` share one question.

    Questions with a NULL are not asked and get NULLs, in ``calls`` too. The answers are written as a table before they
    meet the rows, so that neither a second reading nor an executor lost later asks again; a task that is lost while it
    asks does. A question that very many rows share folds on the map side, and its rows are split by AQE in the join.
    Columns of the added names are replaced.
    """
    added = [*(name for name, _, _ in fields), "calls", "error"]
    rows = rows.drop(*[c for c in added if c not in columns])
    asked = rows.select(*columns).dropna().distinct()
    if partitions:
        asked = asked.repartition(partitions, *columns)
    kinds = [k for _, k, _ in fields] + [pa.int32(), pa.string()]
    names = [f"__a{i}" for i in range(len(added))]
    types = [t for _, _, t in fields] + ["int", "string"]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema] + [f"{n} {t}" for n, t in zip(names, types, strict=True)]
    )
    single = len(columns) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = loader()
        with ThreadPoolExecutor(how.at_once) as pool:
            for batch in batches:
                values = [batch.column(c).to_pylist() for c in columns]
                questions = values[0] if single else list(zip(*values, strict=True))
                groups = [questions[k : k + how.size] for k in range(0, len(questions), how.size)]
                out: list[list] = [[] for _ in kinds]
                for group in pool.map(lambda g: call(ask, g, how), groups):
                    for answer, made, cause in group:
                        got = (None,) * len(fields) if cause else (answer,) if len(fields) == 1 else answer
                        for column, value in zip(out, (*got, made, cause), strict=True):
                            column.append(value)
                arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*columns, *names])

    answers = written(asked.mapInArrow(run, schema), "answers")
    keys = {c: f"__q{i}" for i, c in enumerate(columns)}
    same = [F.col(c) == F.col(k) for c, k in keys.items()]
    joined = rows.join(answers.withColumnsRenamed(keys), same, "left").drop(*keys.values())
    return joined.withColumnsRenamed(dict(zip(names, added, strict=True)))


def ask_model(
    prompts: DataFrame, loader: Callable[[], BatchModel], column: str = "prompt", how: Calls = Calls(), partitions: int | None = None
) -> DataFrame:
    """Add response, input_tokens, output_tokens, calls and error to every prompt, asking each text once.

    Empty prompts are asked; NULL ones get NULLs. ``error`` is the cause where no attempt gave an answer.
    """
    fields = [("response", pa.string(), "string"), ("input_tokens", pa.int64(), "bigint"), ("output_tokens", pa.int64(), "bigint")]
    return ask_once(prompts, [column], loader, fields, how, partitions)


def ask_judge(
    runs: DataFrame, loader: Callable[[], BatchJudge], how: Calls = Calls(), partitions: int | None = None
) -> DataFrame:
    """Add the judge's reply, calls, error, and the parsed score, reason, parse_ok and score_ok, asking each pair of prompt
    and response once. A pair with a NULL is not asked; like a failed one it gets the fallback score, and ``error`` says why."""
    judged = ask_once(runs, ["prompt", "response"], loader, [("reply", pa.string(), "string")], how, partitions)
    missing = F.when(F.col("prompt").isNull(), "no prompt").when(F.col("response").isNull(), "no response")
    judged = judged.withColumn("error", F.coalesce("error", missing))
    return parse_judge(judged).withColumn("score_ok", valid_score(F.col("score")))
