"""Batches written while a collection runs, and reading overlapping ones back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.sources.batches import append_batch

CHECKPOINT_ROWS = 50


def with_batch(df: DataFrame, id_column: str, every: int = CHECKPOINT_ROWS) -> DataFrame:
    """1-based batch of a 1-based id."""
    return df.withColumn("batch", F.ceil(F.col(id_column) / F.lit(every)).cast("bigint"))


def write_checkpoints(df: DataFrame, path: str, id_column: str, every: int = CHECKPOINT_ROWS, session: str = "all") -> bool:
    """The rows of one session with their batch of ``every`` ids, sorted by it, under the log of ``sources.batches``.

    Range partitioning puts a batch in one file, or splits it with its neighbours, and files tell the batches they hold,
    so reading one skips the others: neither files nor folders grow with the number of batches. False if the session
    had been written before.
    """
    batched = with_batch(df, id_column, every).repartitionByRange("batch", id_column)
    return append_batch(batched.sortWithinPartitions("batch", id_column), path, session)


def read_checkpoints(spark: SparkSession, paths: list[str] | str, schema: T.StructType) -> DataFrame:
    """All files of several checkpoints as one table with the file each row came from."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(
        *([paths] if isinstance(paths, str) else paths)
    )
    return rows.withColumn("source_file", F.col("_metadata.file_path"))
