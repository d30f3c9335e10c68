"""Ordered calculations (previous row, fill forward, running totals) that survive a hot key.

A window partitioned by a key alone puts the whole key in one task. Here every key is cut into
chunks along its order, so a window never sees more than one chunk. What a chunk needs from the
ones before it is aggregated per chunk (partial on the map side), shifted along the short list of
chunks, and put into the chunk as one seed row ahead of its data rows. Rows are shuffled once.

``chunk`` must not decrease along ``order``, and ``order`` must be total within a key.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000
HOUR, DAY = 3600, 86_400
_CHUNK, _SEED, _CARRY = "__chunk", "__seed", "__carry"


def id_chunk(column: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a whole-number id: at most ``rows`` ids each."""
    return F.floor(F.col(column) / F.lit(rows))


def time_chunk(column: str, seconds: int = HOUR) -> Column:
    """Chunk of a zone-less timestamp: spans of ``seconds``.

    Pick a span in which the busiest key's rows fit one task; the list of chunks a key has grows with
    the time covered over the span, not with the rows. Keys read a few times a day take ``DAY``.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, F.col(column)) / F.lit(seconds))


def _with_seeds(rows: DataFrame, keys: list[str], summary: Column, shift) -> DataFrame:
    """Rows plus one seed row per chunk whose ``__carry`` is ``shift`` over the earlier chunks.

    The explicit repartition matters: a window may otherwise reuse a coarser partitioning by the keys
    alone, which would put a hot key back into one task.
    """
    per_chunk = rows.groupBy(*keys, _CHUNK).agg(summary.alias(_CARRY))
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK)
    seeds = per_chunk.select(
        *keys, _CHUNK, shift(F.col(_CARRY), earlier).alias(_CARRY), F.lit(0).alias(_SEED)
    )
    seeded = rows.withColumn(_SEED, F.lit(1)).unionByName(seeds, allowMissingColumns=True)
    return seeded.repartition(*keys, _CHUNK)


def _in_chunk(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, _CHUNK).orderBy(_SEED, *order)


def _finish(df: DataFrame) -> DataFrame:
    return df.filter(F.col(_SEED) == 1).drop(_CHUNK, _SEED, _CARRY)


def _last_in(order: list[str], value: Column, present: Column | None = None) -> Column:
    by = F.struct(*order)
    return F.max_by(value, by if present is None else F.when(present, by))


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], chunk: Column
) -> DataFrame:
    """Add, under new names, columns of the row before (``{new: old}``); NULL on a key's first row."""
    rows = df.withColumn(_CHUNK, chunk)
    row = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    seeded = _with_seeds(rows, keys, _last_in(order, row), lambda c, w: F.lag(c).over(w))
    carried = F.when(F.col(_SEED) == 0, F.col(_CARRY)).otherwise(row)
    before = seeded.withColumn("__before", F.lag(carried).over(_in_chunk(keys, order)))
    return _finish(
        before.select("*", *[F.col("__before")[new].alias(new) for new in columns]).drop("__before")
    )


def fill_forward(
    df: DataFrame, keys: list[str], order: list[str], column: str, name: str, chunk: Column
) -> DataFrame:
    """Add ``name``: the last non-NULL ``column`` at or before the row."""
    rows = df.withColumn(_CHUNK, chunk)
    value = F.col(column)

    def shift(carry: Column, earlier) -> Column:
        return F.last(carry, ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1))

    seeded = _with_seeds(rows, keys, _last_in(order, value, value.isNotNull()), shift)
    carried = F.when(F.col(_SEED) == 0, F.col(_CARRY)).otherwise(value)
    so_far = _in_chunk(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _finish(seeded.withColumn(name, F.last(carried, ignorenulls=True).over(so_far)))


def running(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], chunk: Column
) -> DataFrame:
    """Add running totals ``{name: value}`` of every row up to and including itself."""
    named = [value.alias(f"__v_{name}") for name, value in sums.items()]
    rows = df.select("*", *named, chunk.alias(_CHUNK))
    totals = F.struct(*[F.sum(f"__v_{n}").alias(n) for n in sums])

    def shift(carry: Column, earlier) -> Column:
        before = earlier.rowsBetween(Window.unboundedPreceding, -1)
        return F.struct(*[F.sum(carry[n]).over(before).alias(n) for n in sums])

    seeded = _with_seeds(rows, keys, totals, shift)
    so_far = _in_chunk(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totalled = seeded.select(
        "*", *[F.sum(F.coalesce(f"__v_{n}", F.col(_CARRY)[n])).over(so_far).alias(n) for n in sums]
    )
    return _finish(totalled).drop(*[f"__v_{n}" for n in sums])


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, chunk: Column) -> DataFrame:
    """Add the 1-based position of each row within its key (no key: over the whole table)."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, chunk)


def moving(
    df: DataFrame, keys: list[str], order: list[str], n: int, values: dict[str, Column], chunk: Column,
    block: int = CHUNK_ROWS,
) -> DataFrame:
    """Add moving means ``{name: value}`` over the row and the ``n - 1`` before it.

    Rows are numbered first; each block of positions then also gets copies of the ``n - 1`` rows
    ahead of it, so the frame is whole inside one block.
    """
    block = max(block, n)
    placed = number_rows(df, keys, order, "__pos", chunk)
    home = F.floor((F.col("__pos") - 1) / F.lit(block))
    reach = F.floor((F.col("__pos") + F.lit(n - 2)) / F.lit(block))
    copies = placed.withColumn("__home", home).withColumn("__block", F.explode(F.sequence(home, reach)))
    frame = Window.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(-(n - 1), 0)
    means = copies.select("*", *[F.avg(value).over(frame).alias(name) for name, value in values.items()])
    return means.filter(F.col("__home") == F.col("__block")).drop("__pos", "__home", "__block")


def latest(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """The row of each key that is last in ``order``, or its ``keep`` columns.

    An aggregate rather than a ranking, so copies of a key fold on the map side.
    """
    rest = keep or [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salt: Column, salts: int = 16) -> DataFrame:
    """The first ``k`` rows of each group; each salt keeps its own first ``k`` before the group is put together."""
    spread = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    near = spread.withColumn("__rn", F.row_number().over(local)).filter(F.col("__rn") <= k)
    placed = near.withColumn("__rn", F.row_number().over(whole)).filter(F.col("__rn") <= k)
    return placed.withColumnRenamed("__rn", "position").drop("__salt")
