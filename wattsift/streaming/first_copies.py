"""First copies of a stream's rows, however much later a repeat comes.

All keys seen so far are a table, written batch by batch. So that a batch need not be joined with all of it, a Bloom
filter goes ahead: blocks of 32,768 bits, as rows of a table. A key whose bits are not all set is new; only possible
repeats are compared with the keys themselves. There is no horizon, no watermark and no state in memory.
"""

from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.streaming import jobs

BLOCK_BITS = 1 << 15  # what Spark's bitmap functions hold in one value
HASHES, BITS_PER_KEY = 4, 12
FILTER = "block bigint, bits binary"
MARKS = "n_read bigint, n_new bigint, n_candidates bigint, after bigint"


def _block(keys: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("block")


def _positions(keys: list[str]) -> Column:
    """The key's bits inside its block."""
    second = F.xxhash64(F.lit("second"), *keys)
    return F.array(*[F.shiftright(second, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("bigint")) for k in range(HASHES)])


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(bits.substr(F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def block_filter(keys_seen: DataFrame, keys: list[str], blocks: int, before: DataFrame | None = None) -> DataFrame:
    """(block, bits) of the keys, and of the filter ``before``; a row for each block that has any."""
    bits = keys_seen.select(_block(keys, blocks), F.explode(_positions(keys)).alias("position"))
    made = bits.groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))
    both = made if before is None else made.unionByName(before)
    return both.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def possible(rows: DataFrame, keys: list[str], blocks: int, filter_rows: DataFrame) -> DataFrame:
    """Rows with ``maybe``: whether all bits of the key are set."""
    probed = rows.withColumn("__block", _block(keys, blocks)).join(
        filter_rows.select(F.col("block").alias("__block"), F.col("bits").alias("__bits")), "__block", "left"
    )
    every = F.forall(_positions(keys), lambda p: _is_set(F.col("__bits"), p))
    return probed.withColumn("maybe", F.coalesce(F.col("__bits").isNotNull() & every, F.lit(False))).drop("__block", "__bits")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """NULL is a key like any other."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def first_copies(stream: DataFrame, keys: list[str], folder: str, checkpoint: str, expected_keys: int = 50_000_000) -> DataFrame:
    """Run everything available; the first copy of every key over all batches so far, read back from ``folder``.

    Of copies in one batch any one stays. ``expected_keys`` sizes the filter (12 bits a key, one key in about a hundred is
    then compared in vain) and must stay the same for a folder; with more keys the answer is still right, and more of
    them are compared. The filter is written anew by every batch, the keys of a batch once.

    Tables of a batch carry its number and are overwritten on a retry; a batch only reads what earlier ones wrote.
    """
    blocks = max(1, ceil(expected_keys * BITS_PER_KEY / BLOCK_BITS))
    schema, spark = stream.schema, stream.sparkSession
    key_schema = stream.select(*keys).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(keys)
        path = f"{folder}/probed/batch={batch_id}"
        before = None
        if batch_id > 0:
            before = spark.read.schema(FILTER).parquet(f"{folder}/filter/after={batch_id - 1}")
        probed = once.withColumn("maybe", F.lit(False)) if before is None else possible(once, keys, blocks, before)
        probed.write.mode("overwrite").partitionBy("maybe").parquet(path)
        probed = spark.read.schema(probed.schema).parquet(path)
        surely = probed.filter(~F.col("maybe")).drop("maybe")
        candidates = probed.filter("maybe").drop("maybe")
        n_candidates = candidates.count()
        fresh = surely
        if n_candidates:  # otherwise the keys of the past are not read at all
            past = [f"{folder}/keys/batch={k}" for k in range(batch_id)]
            seen = spark.read.schema(key_schema).parquet(*past)
            fresh = surely.unionByName(candidates.join(seen, _same(candidates, seen, keys), "left_anti"))
        fresh.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        kept = spark.read.schema(schema).parquet(f"{folder}/rows/batch={batch_id}").select(*keys)
        kept.write.mode("overwrite").parquet(f"{folder}/keys/batch={batch_id}")
        block_filter(kept, keys, blocks, before).write.mode("overwrite").parquet(f"{folder}/filter/after={batch_id}")
        counted = kept.agg(F.lit(batch.count()).alias("n_read"), F.count("*").alias("n_new"), F.lit(n_candidates).cast("bigint").alias("n_candidates"))
        counted.select(F.col("n_read").cast("bigint"), "n_new", "n_candidates").write.mode("overwrite").parquet(f"{folder}/marks/after={batch_id}")

    jobs.run_batches(stream, checkpoint, step)
    return _stored(spark, f"{folder}/rows/batch=*", schema)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """n_read, n_new, n_candidates over all batches; what was read and is not new were repeats."""
    marks = _stored(spark, f"{folder}/marks", MARKS)
    return marks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_read", "n_new", "n_candidates")])
