"""Small helpers on DataFrames shared by the operators."""

import pickle
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns called so in any case: an operator's own columns replace them."""
    clash = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in clash])


def plus(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of the frame with further fields behind."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(ddl).fields)


def plain(model: Any) -> dict:
    """A model as plain values and arrays. Broadcasts hold these: an executor need not have the package to read them."""
    return dict(vars(model))


def revived(kind: type, values: dict) -> Any:
    """The model again, in a task."""
    model = object.__new__(kind)
    model.__dict__.update(values)
    return model


def ascii_letters(low: bool) -> str:
    letters = "".join(map(chr, range(97, 123)))
    return letters if low else letters.upper()


def sql_ascii_lower(column: str) -> str:
    """DuckDB text that lower-cases A-Z only."""
    return f"translate({column}, '{ascii_letters(False)}', '{ascii_letters(True)}')"


BLANK = r"[\x20\x09-\x0D]+"
NON_BLANK = r"[^\x20\x09-\x0D]+"
BLANK_RE = re.compile(BLANK)


def fitted(sample: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """``fit`` of the rows of a bounded sample, worked out in one task and brought back; it returns plain values and
    arrays. Tasks run array code on one thread, and a lost executor only repeats the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else fit([])  # a sample known to be empty runs no task
