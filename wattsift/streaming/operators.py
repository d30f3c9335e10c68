"""Stream operators: enrichment, windows, sessions, dedupe, alarms, late rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.operators.enrich import with_metrics, with_throttled
from wattsift.streaming.jobs import run_batches


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def timed(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a zone-less event-time column, which is read as UTC whatever the session's zone is."""
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(column)))
    return stream.withColumn(column, instant).withWatermark(column, delay)


def _zoneless(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def enrich(stream: DataFrame) -> DataFrame:
    return stream.transform(with_metrics).transform(with_throttled)


def windowed(
    stream: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column], slide: str | None = None
) -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = stream.groupBy(span.alias("w"), *keys).agg(*aggregates)
    return _flat(grouped, keys)


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Sessions of rows less than ``gap`` apart."""
    grouped = stream.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates)
    return _flat(grouped, keys)


def _flat(grouped: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in grouped.columns if c not in ("w", *keys)]
    return grouped.select(
        _zoneless(F.col("w.start")).alias("window_start"),
        _zoneless(F.col("w.end")).alias("window_end"),
        *keys,
        *values,
    )


def dedupe(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First copy of each key; keys are forgotten once the watermark passes them."""
    return stream.dropDuplicatesWithinWatermark(keys)


def alarm(windows: DataFrame, limit: int, count: str = "n_throttled") -> DataFrame:
    return windows.filter(F.col(count) > limit)


def late_split(stream: DataFrame, ts: str, delay_s: int, sink: str, checkpoint: str) -> DataFrame:
    """Rows with a ``late`` flag instead of a silent drop, read back from ``sink``.

    A row is late when it lies more than the delay behind the newest time of the batches before its
    own. That time is one value, carried in a table beside the output.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id > 0:
            newest = batch.sparkSession.read.parquet(f"{sink}-newest/after={batch_id - 1}").first()[0]
        # Carried as text: a Python datetime would go through the process's own time zone.
        reached = F.lit(newest).cast(batch.schema[ts].dataType)
        late = F.coalesce(F.col(ts) < reached - F.make_dt_interval(secs=F.lit(delay_s)), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        top = batch.agg(F.greatest(F.max(ts), reached).cast("string").alias("newest"))
        top.write.mode("overwrite").parquet(f"{sink}-newest/after={batch_id}")

    run_batches(stream, checkpoint, step)
    return stream.sparkSession.read.parquet(sink).drop("batch")
