"""Run a user's model or judge over a table; the loader runs once per partition."""

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.functions.replies import valid_score
from wattsift.operators.judging import parse_judge

Model = Callable[[str], tuple[str, int, int]]
Judge = Callable[[str, str], str]


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def apply_model(
    prompts: DataFrame, loader: Callable[[], Model], column: str = "prompt", partitions: int | None = None
) -> DataFrame:
    """Add response, input_tokens, output_tokens and latency_s for every prompt.

    Other columns pass through as they are. A NULL prompt is not asked and gets NULLs. ``partitions`` spreads a slow model over that many tasks; the scan's own split is by bytes.
    """
    schema = T.StructType(
        [
            *prompts.schema.fields,
            T.StructField("response", T.StringType()),
            T.StructField("input_tokens", T.LongType()),
            T.StructField("output_tokens", T.LongType()),
            T.StructField("latency_s", T.DoubleType()),
        ]
    )

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader()
        for batch in batches:
            answers: list[list] = [[], [], [], []]
            for prompt in batch.column(column).to_pylist():
                start = time.perf_counter()
                row = (*model(prompt), time.perf_counter() - start) if prompt is not None else (None,) * 4
                for values, value in zip(answers, row, strict=True):
                    values.append(value)
            added = [pa.array(v, k) for v, k in zip(answers, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return _spread(prompts, partitions).mapInArrow(run, schema)


def apply_judge(runs: DataFrame, loader: Callable[[], Judge], partitions: int | None = None) -> DataFrame:
    """Add the judge's reply and its parsed score, reason, parse_ok and score_ok, and ``error``.

    A judge that raises leaves a NULL reply, which the parser turns into the fallback score, and its cause in ``error``.
    """
    schema = T.StructType([*runs.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = loader()

        def reply(prompt, response):
            try:
                return ask(prompt, response), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        for batch in batches:
            pairs = zip(batch.column("prompt").to_pylist(), batch.column("response").to_pylist(), strict=True)
            got = [reply(*pair) for pair in pairs]
            replies, errors = (pa.array([g[k] for g in got], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, replies, errors], names=schema.names)

    judged = _spread(runs, partitions).mapInArrow(run, schema)
    return parse_judge(judged).withColumn("score_ok", valid_score(F.col("score")))
