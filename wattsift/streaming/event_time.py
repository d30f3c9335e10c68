"""Event time over several micro-batches: nothing is dropped without a trace, and nothing is closed before its time.

A row is late when it lies more than the delay behind the newest time of the batches before its own. Every batch is
written once, dealt by side: ``kept``, ``late`` and ``untimed`` (without a time), and its counts go into a table of marks.
What is built on the kept rows never meets a row that it would have to drop. What the watermark has not passed is worked
out anew on reading, apart from the final rows, so that a collection may go on afterwards.

Tables of a batch carry its number and are overwritten on a retry, from tables of the batch before, which stay.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.operators.power import counter_delta
from wattsift.streaming import jobs

SIDES = ("kept", "late", "untimed")
MARKS = "reached string, n_read bigint, n_kept bigint, n_late bigint, n_untimed bigint"
READINGS = ["device", "sample_id", "ts", "counter_kwh"]


@dataclass(frozen=True)
class Outcome:
    """``final`` rows stay as they are; ``open`` ones are what the rows so far give and may still change."""

    final: DataFrame
    open: DataFrame
    folder: str

    def all(self) -> DataFrame:
        return self.final.unionByName(self.open)

    def counts(self) -> DataFrame:
        """n_read, n_kept, n_late, n_untimed over all batches; the last three add up to the first."""
        marks = _marks(self.final.sparkSession, self.folder)
        return marks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_read", "n_kept", "n_late", "n_untimed")])

    def aside(self, side: str) -> DataFrame:
        """Rows that were set aside, with the batch that they came in."""
        return self.final.sparkSession.read.parquet(f"{self.folder}/rows").filter(F.col("side") == side).drop("side")


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    schema = f"{MARKS}, after bigint"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/marks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # no batch has run yet


def _back(reached: str | None, delay_s: int, kind: T.DataType) -> Column:
    """The watermark of a newest time, which is carried as text: a Python datetime would go through a time zone."""
    return F.lit(reached).cast(kind) - F.make_dt_interval(secs=F.lit(delay_s))


def _deal(batch: DataFrame, batch_id: int, ts: str, delay_s: int, folder: str) -> str | None:
    """Write the batch by side; the newest time reached up to and with it. The mark is left to the caller."""
    spark, kind = batch.sparkSession, batch.schema[ts].dataType
    before = _reached(spark, folder, batch_id - 1)
    late = F.coalesce(F.col(ts) < _back(before, delay_s, kind), F.lit(False))
    side = F.when(F.col(ts).isNull(), "untimed").when(late, "late").otherwise("kept")
    batch.withColumn("side", side).write.mode("overwrite").partitionBy("side").parquet(f"{folder}/rows/batch={batch_id}")
    return before


def _mark(spark: SparkSession, batch_id: int, ts: str, folder: str, schema: T.StructType, before: str | None) -> str | None:
    """Count what was written of a batch and note the newest time; the batch counts as done with this."""
    dealt = T.StructType([*schema.fields, T.StructField("side", T.StringType())])
    rows = spark.read.schema(dealt).parquet(f"{folder}/rows/batch={batch_id}")
    newest = F.greatest(F.max(ts), F.lit(before).cast(schema[ts].dataType)).cast("string").alias("reached")
    sides = [F.count_if(F.col("side") == side).alias(f"n_{side}") for side in SIDES]
    mark = rows.agg(newest, F.count("*").alias("n_read"), *sides)
    mark.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/after={batch_id}")
    return _reached(spark, folder, batch_id)


def _reached(spark: SparkSession, folder: str, batch_id: int) -> str | None:
    return spark.read.schema(MARKS).parquet(f"{folder}/marks/after={batch_id}").first()[0] if batch_id >= 0 else None


def gate(stream: DataFrame, ts: str, delay_s: int, folder: str, checkpoint: str) -> DataFrame:
    """Deal everything available by side below ``folder``; the kept rows as a stream.

    A stream of these with the same delay has no late rows: its own batches hold those of this one in order, so its
    watermark is never ahead. Run it after this one has ended, as here, so that no retried batch is read twice.
    """
    schema, spark = stream.schema, stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        before = _deal(batch, batch_id, ts, delay_s, folder)
        _mark(batch.sparkSession, batch_id, ts, folder, schema, before)

    jobs.run_batches(stream, checkpoint, step)
    return jobs.ingest(spark, f"{folder}/rows/batch=*/side=kept", schema)


def kept_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All kept rows so far as a table."""
    try:
        return spark.read.schema(schema).parquet(f"{folder}/rows/batch=*/side=kept")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_windows(
    rows: DataFrame, ts: str, delay_s: int, build: Callable[[DataFrame], DataFrame], still_open: Callable, folder: str
) -> Outcome:
    """Windows over a stream, and those that the watermark has not passed.

    ``build`` makes windows (with window_start and window_end) of rows whose ``ts`` has the watermark; it is also used on
    the table of rows that belong to open windows. ``still_open(build, kept, final)`` gives these windows:
    ``fixed(...)`` for windows of a given span, ``by_session(...)`` for sessions.
    """
    kept = gate(rows, ts, delay_s, f"{folder}/gate", f"{folder}/gate-checkpoint")
    final = jobs.run_available(build(kept), f"{folder}/final", f"{folder}/final-checkpoint")
    table = kept_rows(rows.sparkSession, f"{folder}/gate", rows.schema)
    return Outcome(final, still_open(build, table, final), f"{folder}/gate")


def fixed(ts: str, span_s: int) -> Callable:
    """Open tumbling or sliding windows of ``span_s`` seconds: all windows that end by the last final end are final."""

    def still_open(build, kept: DataFrame, final: DataFrame) -> DataFrame:
        last = final.agg(F.max("window_end").cast("string")).first()[0]
        if last is None:
            return build(kept)
        end = F.lit(last).cast("timestamp_ntz")
        recent = kept.filter(F.col(ts) >= _back(last, span_s, kept.schema[ts].dataType))
        return build(recent).filter(F.col("window_end") > end)

    return still_open


def by_session(ts: str, keys: list[str]) -> Callable:
    """Open sessions: made of the rows behind the last final session of their key."""

    def still_open(build, kept: DataFrame, final: DataFrame) -> DataFrame:
        ends = final.groupBy(*keys).agg(F.max("window_end").alias("__end"))
        behind = F.col("__end").isNull() | (F.col(ts) >= F.col("__end"))
        return build(kept.join(ends, keys, "left").filter(behind).drop("__end"))

    return still_open


def delta_stream(stream: DataFrame, delay_s: int, folder: str, checkpoint: str) -> Outcome:
    """Counter steps in order of event time, whatever the order of arrival within the delay.

    Readings (device, sample_id, ts, counter_kwh) wait in a table until the watermark has passed them, so each gets its
    step against the reading before it, once. Between batches there are the waiting readings, those of the last
    ``delay_s`` seconds, and the last reading of every device that has left. Steps go through the chunked batch
    operator: a busy device is not one task's state. ``open`` has the steps of the readings that still wait.

    A reading later than the delay has no step and is set aside, as its neighbours have theirs; so is one without a time.
    """
    stream = stream.select(*READINGS)
    schema, spark = stream.schema, stream.sparkSession
    kind = schema["ts"].dataType

    def carried(spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/{name}/after={batch_id}")

    def steps_of(ready: DataFrame, before: DataFrame) -> DataFrame:
        rows = ready.withColumn("fresh", F.lit(True)).unionByName(before.withColumn("fresh", F.lit(False)))
        return counter_delta(rows).filter("fresh").drop("fresh")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _deal(batch, batch_id, "ts", delay_s, folder)
        fresh = _kept_of(spark, folder, batch_id, schema)
        newest = fresh.agg(F.greatest(F.max("ts"), F.lit(before).cast(kind)).cast("string")).first()[0]
        waiting = carried(spark, "waiting", batch_id - 1).unionByName(fresh)
        passed = F.coalesce(F.col("ts") < _back(newest, delay_s, kind), F.lit(False))
        last = carried(spark, "last", batch_id - 1)
        ready = waiting.filter(passed)
        steps_of(ready, last).write.mode("overwrite").parquet(f"{folder}/steps/batch={batch_id}")
        top = F.max_by(F.struct("sample_id", "ts", "counter_kwh"), F.struct("ts", "sample_id")).alias("r")
        left = ready.unionByName(last).groupBy("device").agg(top).select("device", "r.*")
        left.write.mode("overwrite").parquet(f"{folder}/last/after={batch_id}")
        waiting.filter(~passed).write.mode("overwrite").parquet(f"{folder}/waiting/after={batch_id}")
        _mark(spark, batch_id, "ts", folder, schema, before)

    jobs.run_batches(stream, checkpoint, step)
    done = _marks(spark, folder).agg(F.max("after")).first()[0]
    done = -1 if done is None else done
    now = steps_of(carried(spark, "waiting", done), carried(spark, "last", done))
    final = spark.read.schema(now.schema).parquet(f"{folder}/steps/batch=*") if done >= 0 else spark.createDataFrame([], now.schema)
    return Outcome(final, now, folder)


def _kept_of(spark: SparkSession, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
    dealt = T.StructType([*schema.fields, T.StructField("side", T.StringType())])
    rows = spark.read.schema(dealt).parquet(f"{folder}/rows/batch={batch_id}")
    return rows.filter(F.col("side") == "kept").drop("side")
