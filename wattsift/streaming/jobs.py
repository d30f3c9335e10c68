"""Reading a folder as a stream and running it to the end of what is there."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest(
    spark: SparkSession, path: str, schema: T.StructType, name_filter: str | None = None,
    max_files: int | None = None, fmt: str = "parquet",
) -> DataFrame:
    """Files of a folder as a stream; with a checkpoint each file is taken exactly once."""
    reader = spark.readStream.schema(schema).format(fmt)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Append everything available to a parquet sink and read the sink back."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    _finish(writer.trigger(availableNow=True).start(sink))
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def run_batches(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return _finish(writer.foreachBatch(write).trigger(availableNow=True).start())


def run_snapshots(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Run a complete-mode aggregate; each batch writes its snapshot, the newest one is returned."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run_batches(stream, checkpoint, write, "complete")
    spark = stream.sparkSession
    try:
        snapshots = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(sink)
        newest = snapshots.agg({"batch": "max"}).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None:  # no batch has run yet, or none had rows
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{sink}/batch={newest}")
