"""Quoted CSV whose fields hold line breaks, read by many tasks at once.

Spark deals a file's bytes to tasks and each task sees whole lines. Whether a line begins a record depends on the quotes
before it, back to the head of the file: an odd number of them leaves a field open. So the first pass reports, for every
stretch of a file that a task reads, the parity of its quotes and whether a record begins in it in either case; a
running parity over the stretches of each file then settles the case of each. The second pass puts records together,
each stretch on its own, and what a stretch begins or leaves open is joined to its other parts by a small shuffle.
"""

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.session import written

STRETCH = "path string, begin bigint, n_lines bigint, odd boolean, turns boolean, header string"
PIECE = "header int, chain bigint, part bigint, record string"
ATTEMPTS = 3
BOM = "﻿"
#: How records are parsed: doubled quotes stand for one, blanks and line breaks inside of quotes are data.
CELLS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Lines of one stretch at a time, as many as a batch has; lines come in the order of the file."""
    for batch in batches:
        begin = np.asarray(batch.column(2))
        paths = batch.column(1).dictionary_encode()
        codes = np.asarray(paths.indices)
        change = np.flatnonzero((begin[1:] != begin[:-1]) | (codes[1:] != codes[:-1])) + 1
        for a, b in zip([0, *change], [*change, len(begin)]):
            if b > a:
                yield paths.dictionary[codes[a]].as_py(), int(begin[a]), batch.column(0).slice(a, b - a)


def _open_before(lines: pa.Array, state: int) -> np.ndarray:
    """Whether a field is open (1) at the beginning of each line, and after the last one, given the state before."""
    quotes = np.asarray(pc.fill_null(pc.count_substring(lines, '"'), 0))
    return np.concatenate(([state], (state + np.cumsum(quotes)) & 1))


def _stretches(lines: DataFrame) -> DataFrame:
    """One row for each stretch; ``turns``: a field is open or closed by its own quotes before one of its lines. The
    stretch at the head of a file also has the first record."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for path, begin, some in _runs(batches):
            if now is None or (now["path"], now["begin"]) != (path, begin):
                now = {"path": path, "begin": begin, "n_lines": 0, "odd": False, "turns": False, "header": None, "head": begin == 0}
                rows.append(now)
            state = _open_before(some, int(now["odd"]))
            if now["head"]:
                closed = np.flatnonzero(state[1:] == 0)
                first = some.slice(0, int(closed[0]) + 1 if len(closed) else len(some)).to_pylist()
                now["header"] = "\n".join([*([now["header"]] if now["header"] is not None else []), *first])
                now["head"] = not len(closed)
            now["turns"] = now["turns"] or bool(state[:-1].any())
            now["n_lines"], now["odd"] = now["n_lines"] + len(some), bool(state[-1])
        for r in rows:
            if r.pop("head"):
                r["header"] = None  # the first record goes on into another stretch
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(STRETCH))

    return lines.mapInArrow(survey, STRETCH)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


@dataclass(frozen=True)
class Case:
    """How a stretch begins: whether a field is ``open``, the ``chain`` (number of the stretch) in which the record at its
    head began, and the number of its file's ``header``."""

    number: int
    open: int
    chain: int
    header: int


def cases(stretches: list[dict]) -> tuple[dict[tuple[str, int], Case], list[str]]:
    """The case of every stretch, by a running parity over the stretches of each file, and the distinct headers."""
    out, headers, state, chain, header, before = {}, [], 0, 0, 0, None
    for number, s in enumerate(sorted(stretches, key=lambda s: (s["path"], s["begin"]))):
        if s["path"] != before:
            if s["begin"] != 0 or s["header"] is None:
                raise ValueError(f"{s['path']}: the first record does not end in the first stretch")
            before, state = s["path"], 0
            head = s["header"].removeprefix(BOM).removesuffix("\r")
            headers += [head] if head not in headers else []
            header = headers.index(head)
        out[s["path"], s["begin"]] = Case(number, state, chain, header)
        # a record begins where a line has no field open before it
        if not state or s["turns"]:
            chain = number
        state ^= s["odd"]
    return out, headers


def _records(lines: DataFrame, known: dict) -> DataFrame:
    """Pieces of records: whole ones (chain NULL), and the parts of those that more than one stretch has."""
    sent = lines.sparkSession.sparkContext.broadcast({k: (c.number, c.open, c.chain, c.header) for k, c in known.items()})

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, header, state, chain, held, skip = None, 0, 0, 0, 0, [], False

        def pieces(texts: list[str], chain: int | None) -> pa.RecordBatch:
            n = len(texts)
            columns = [[header] * n, [chain] * n, [number] * n, texts]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def last() -> Iterator[pa.RecordBatch]:
            """What is held at the end of a stretch: a whole record, if it began and ended here."""
            if held and not skip:
                yield pieces(["\n".join(held)], chain if state or chain != number else None)

        for path, begin, some in _runs(batches):
            if now != (path, begin):
                yield from last()
                now = (path, begin)
                if now not in sent.value:
                    raise LookupError("the file was dealt in other stretches")
                number, state, chain, header = sent.value[now]
                chain, held, skip = chain if state else number, [], begin == 0
            opens = _open_before(some, state)
            state, starts, texts = int(opens[-1]), np.flatnonzero(opens[:-1] == 0), some.to_pylist()
            if not len(starts):
                held += texts
                continue
            held += texts[: starts[0]]
            if held:
                if chain != number:
                    yield pieces(["\n".join(held)], chain)
                elif not skip:
                    yield pieces(["\n".join(held)], None)
                skip = False
            whole = [texts[a] if b == a + 1 else "\n".join(texts[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            if skip and whole:
                whole, skip = whole[1:], False
            if whole:
                yield pieces(whole, None)
            chain, held = number, texts[starts[-1] :]
        yield from last()

    schema = _arrow(PIECE)
    return lines.mapInArrow(assemble, PIECE)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(header, record): the text of every record, and the number of its file's header among the headers that are
    returned. Blank records are left out.

    The records are written to the work folder. Both passes must see the files dealt alike, which they do unless the
    number of executors changes between them; then they are run again. What is sent to the tasks is a few numbers for
    each stretch of a file, 128 MB by Spark's default.
    """
    for attempt in range(ATTEMPTS):
        found = [r.asDict() for r in _stretches(_lines(spark, path)).collect()]
        known, headers = cases(found)
        try:
            pieces = written(_records(_lines(spark, path), known), "records")
        except PythonException as e:
            if "dealt in other stretches" not in str(e) or attempt + 1 == ATTEMPTS:
                raise
            continue
        parts = F.sort_array(F.collect_list(F.struct("part", "record")))
        torn = pieces.filter(F.col("chain").isNotNull()).groupBy("header", "chain").agg(
            F.concat_ws("\n", F.transform(parts, lambda p: p["record"])).alias("record")
        )
        whole = pieces.filter(F.col("chain").isNull()).select("header", "record").unionByName(torn.select("header", "record"))
        ended = whole.withColumn("record", F.regexp_replace("record", "\\r$", ""))
        return ended.filter(F.trim("record") != ""), headers
    raise AssertionError("unreachable")


def _names(header: str) -> list[str]:
    names = next(csv.reader([header]))
    if len(set(names)) < len(names):
        raise ValueError(f"the header repeats a column: {header}")
    return names


def read_quoted(spark: SparkSession, path: str, columns: str, corrupt: str | None = None) -> DataFrame:
    """Quoted CSV with header, files of any size, as the given columns (DDL), which are found by name in each file.

    Columns may stand in any order and beside others, which are not read; a file without one of them fails the read. A
    byte order mark is left out. An empty cell is NULL, with quotes or without, as in Spark's own reader. A cell that its
    type cannot hold is NULL as well, and then, as with a wrong number of cells, the column named ``corrupt`` has the
    text of the record; otherwise it is NULL. A file must hold its header within the first stretch that a task reads.
    """
    schema = T.StructType.fromDDL(columns)
    records, headers = read_records(spark, path)
    cells = F.lit(None)
    kind = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema], T.StructField("__torn", T.StringType())])
    for k, header in enumerate(headers):
        names = _names(header)
        missing = [f.name for f in schema if f.name not in names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in the header {header}")
        # places in place of names: a file's own names may be anything
        ddl = ", ".join(f"c{i} string" for i in range(len(names))) + ", torn string"
        row = F.from_csv("record", ddl, {**CELLS, "columnNameOfCorruptRecord": "torn"})
        picked = F.struct(*[row[f"c{names.index(f.name)}"].alias(f.name) for f in schema], row["torn"].alias("__torn"))
        cells = F.when(F.col("header") == k, picked).otherwise(cells if k else F.lit(None).cast(kind))
    rows = records.select("record", (cells if headers else F.lit(None).cast(kind)).alias("cells"))
    typed = {f.name: F.col("cells")[f.name] for f in schema}
    typed = {f.name: typed[f.name] if f.dataType == T.StringType() else typed[f.name].try_cast(f.dataType) for f in schema}
    unread = [
        typed[f.name].isNull() & (F.trim(F.col("cells")[f.name]) != "") for f in schema if f.dataType != T.StringType()
    ]
    bad = F.col("cells")["__torn"].isNotNull()
    for u in unread:
        bad = bad | F.coalesce(u, F.lit(False))
    more = [F.when(bad, F.col("record")).alias(corrupt)] if corrupt else []
    return rows.select(*[typed[f.name].alias(f.name) for f in schema], *more)
