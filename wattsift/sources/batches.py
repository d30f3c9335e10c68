"""Batches of a collection under a commit log: a batch counts once or not at all, however often it is tried.

    <path>/data/<uuid>      the files of one write
    <path>/log              one row for each batch that a write holds: batch, level, folder, rows

A write first fills a folder of its own and then adds its row to the log, one file that appears whole. Without the row
nobody reads the folder, so a write that dies may be tried again. Where a batch has several rows, as two tries at once
leave them, the highest level counts, and within it the least folder name. Folders follow the writes, not the ids.

Compaction rewrites the small folders as one, a level higher. Nothing is overwritten or deleted: readers that began
before it read on. Appends may run beside a compaction, but run one compaction at a time.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "batch string, level int, folder string, n_rows bigint"
FILE_ROWS = 5_000_000


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """The row of the log that counts for each batch."""
    try:
        rows = spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)  # no batch has been written yet
    key = F.struct((-F.col("level")).alias("down"), "folder", "n_rows", "level")
    return rows.groupBy("batch").agg(F.min(key).alias("row")).select("batch", "row.level", "row.folder", "row.n_rows")


def _fill(df: DataFrame, path: str) -> tuple[str, int]:
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder, df.sparkSession.read.schema(df.schema).parquet(folder).count()  # from the files' footers


def _commit(log: DataFrame, path: str) -> None:
    log.coalesce(1).write.mode("append").parquet(f"{path}/log")


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Write the rows as ``batch``; False, with nothing written, if that batch is in the log already.

    A batch without rows is entered too, so it is not asked for again.
    """
    spark = df.sparkSession
    if not log_of(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    folder, n_rows = _fill(df, path)
    _commit(spark.createDataFrame([(batch, 0, folder, n_rows)], LOG), path)
    return True


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The folders that hold the batches, with their rows; compaction keeps them few."""
    live = log_of(spark, path).groupBy("folder").agg(F.max("n_rows").alias("n_rows"))
    return sorted((r.folder, r.n_rows) for r in live.collect())


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches in the log; none without a log."""
    found = [folder for folder, n_rows in folders(spark, path) if n_rows]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*found)


def compact(spark: SparkSession, path: str, schema: T.StructType, order: list[str], small_rows: int = FILE_ROWS) -> int:
    """Rewrite the folders of fewer than ``small_rows`` rows as one, in files of about that many sorted by ``order``.

    Returns how many folders were put together; with one or none, nothing is written. A failure before the log's
    row leaves all batches where they were.
    """
    small = {folder: n for folder, n in folders(spark, path) if n < small_rows}
    if len(small) < 2:
        return 0
    old = log_of(spark, path).join(spark.createDataFrame([(f,) for f in small], "folder string"), "folder", "left_semi")
    rows = spark.read.schema(schema).parquet(*small)
    files = max(1, -(-sum(small.values()) // small_rows))
    folder, n_rows = _fill(rows.repartitionByRange(files, *order).sortWithinPartitions(*order), path)
    level = log_of(spark, path).agg(F.max("level")).first()[0] + 1
    held = old.select("batch", F.lit(level).alias("level"), F.lit(folder).alias("folder"), F.lit(n_rows).cast("bigint").alias("n_rows"))
    _commit(held, path)
    return len(small)
