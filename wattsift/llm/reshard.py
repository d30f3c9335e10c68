"""Resharding by minimum-cost flow: which blocks of the old shards go to which new shard, with the fewest bytes moved.

Rows carry a block, a slice of their old shard by text hash, so equal texts share one. Block sizes, a number fixed by
parameters, come to the driver; there the flow between shards is solved and realised in blocks. Rows then look up
their block.
"""

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.llm.flow import cheapest_transfers
from wattsift.llm.frames import without
from wattsift.session import written


@dataclass(frozen=True)
class Layout:
    """``old`` and ``new`` shards; each old one is seen as ``blocks`` blocks. Blocks with more than 1 / ``heavy`` of a
    new shard in one group of equal texts keep that group as a block of its own, at most old + new x heavy of them."""

    old: int = 12
    new: int = 16
    blocks: int = 1024
    heavy: int = 64
    slot_rows: int = 10_000


def sized(docs: DataFrame, id: str, text: str, held: Column | None = None) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id).alias("id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("group"), *([] if held is None else [held.alias("held")]),
    )


def old_shard(group: Column, layout: Layout) -> Column:
    """Where the old, content-addressed layout has a text."""
    return F.pmod(group, F.lit(layout.old)).cast("int")


def _light_block(group: Column, layout: Layout, home: Column | None = None) -> Column:
    slice_ = F.pmod(F.shiftright(group, 20), F.lit(layout.blocks)).cast("bigint")
    return (old_shard(group, layout) if home is None else home).cast("bigint") * layout.blocks + slice_


def room_of(total: int, new: int, capacities: Sequence[int] | None = None) -> list[int]:
    """The bytes that each new shard is to have: near equal, where its capacity allows it; together all bytes."""
    if capacities is None:
        return [total // new + (j < total % new) for j in range(new)]
    if len(capacities) != new or sum(capacities) < total:
        raise ValueError(f"{new} shards need as many capacities, of {total} bytes together at least")
    room, rest = [0] * new, total
    for n, j in enumerate(sorted(range(new), key=lambda j: (capacities[j], -j))):
        room[j] = min(capacities[j], rest // (new - n))  # what a small one cannot take is dealt to the larger ones
        rest -= room[j]
    return room


def place_blocks(
    blocks: list[tuple[int, int, int]], old: int, new: int, capacities: Sequence[int] | None = None
) -> dict[int, int]:
    """Block -> new shard for blocks (block, old shard, bytes), along the cheapest transfers.

    Blocks go largest first. A block follows the transfer of its old shard with the most bytes left, staying if it
    can; where none has half of it left, it goes to the shard with the most room. Small blocks come last and level
    the shards. No shard gets more than its capacity; a ValueError says where blocks are too coarse for that.
    """
    sizes = [0] * old
    for _, shard, size in blocks:
        sizes[shard] += size
    total = sum(sizes)
    room = room_of(total, new, capacities)
    spare = list(capacities or [total] * new)
    left = cheapest_transfers(sizes, room)
    by_shard = [[j for j in range(new) if (i, j) in left] for i in range(old)]
    out = {}
    for block, i, size in sorted(blocks, key=lambda b: (-b[2], b[0])):
        ways = [j for j in by_shard[i] if left[i, j] * 2 >= size and room[j] >= size]
        fits = [j for j in range(new) if spare[j] >= size]
        if not fits:
            raise ValueError(f"no shard has {size} bytes left for block {block}; use more blocks or more capacity")
        j = max(ways, key=lambda j: (j == i, left[i, j], -j)) if ways else max(fits, key=lambda j: (room[j], j == i, -j))
        if (i, j) in left:
            left[i, j] -= size
        room[j] -= size
        spare[j] -= size
        out[block] = j
    return out


def with_home(docs: DataFrame, id: str, text: str, old: str, layout: Layout) -> DataFrame:
    """Sized rows with ``held``, the old shard that column ``old`` names, and ``home``, the one with most bytes of the
    row's group of equal texts, which the group counts as being in, so that it moves as one.

    Sums by group and shard are folded before the shuffle, so a text that is most of the rows makes one row a shard.
    """
    known = F.when(F.col(old).between(0, layout.old - 1), F.col(old).cast("int"))
    held = sized(docs.select(id, text, old), id, text, F.coalesce(known, old_shard(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), layout)))
    held = written(held, "sizes")
    sums = held.groupBy("group", "held").agg(F.sum("size").alias("bytes"))
    home = sums.groupBy("group").agg(F.max(F.struct("bytes", (-F.col("held")).alias("down"))).alias("most"))
    return written(held.join(home.select("group", (-F.col("most.down")).alias("home")), "group"), "homes")


def placement(rows: DataFrame, layout: Layout, capacities: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(heavy groups: group, block, pieces), (blocks: block, shard, subs); both at most a few thousand rows."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    fair = total / layout.new
    sums = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy = [tuple(r) for r in sums.where(F.col("bytes") > fair / layout.heavy).collect()]
    first = layout.old * layout.blocks
    groups = []
    for group, bytes_, _ in sorted(heavy):
        # a group that no shard has room for is cut by id, as the law on bytes goes before
        pieces = 1 if bytes_ <= fair else ceil(bytes_ / (fair / layout.heavy))
        groups.append((group, first, pieces))
        first += pieces
    held = spark.createDataFrame(groups, "group bigint, first_block bigint, pieces int")
    in_blocks = with_blocks(rows, held, layout).groupBy("block", "old_shard").agg(F.sum("size"), F.count("*")).collect()
    to = place_blocks([(b, i, s) for b, i, s, _ in in_blocks], layout.old, layout.new, capacities)
    subs = [(b, to[b], ceil(n / layout.slot_rows)) for b, _, _, n in in_blocks]
    return held, spark.createDataFrame(subs, "block bigint, shard int, subs int")


def with_blocks(rows: DataFrame, heavy: DataFrame, layout: Layout) -> DataFrame:
    piece = F.col("first_block") + F.pmod(F.xxhash64("id"), F.col("pieces"))
    home = F.col("home") if "home" in rows.columns else old_shard(F.col("group"), layout)
    marked = rows.join(F.broadcast(heavy), "group", "left").withColumn("old_shard", home)
    block = F.coalesce(piece.cast("bigint"), _light_block(F.col("group"), layout, home))
    return marked.withColumn("block", block).drop("first_block", "pieces")


def reshard(
    docs: DataFrame, layout: Layout = Layout(), id: str = "doc_id", text: str = "text", old: str | None = None,
    capacities: Sequence[int] | None = None,
) -> DataFrame:
    """(id, size, text_crc32, old_shard, shard, slot) of every row: new shards near equal in bytes, fewest bytes moved.

    A row's size is the UTF-8 bytes of its text, none for NULL, plus 1. Rows of equal texts stay together, unless all of
    them are more than a shard's fair part; such a group is cut by id. Shards differ by about a block: a fair part of
    all bytes over the number of blocks, or the longest text. Slots of a shard count from 0 without gaps, by block and
    id; rows that repeat id and text take neighbouring slots. An empty table gives no rows.

    ``old`` names a column with the shard each row is in now, 0 to layout.old - 1; rows without one, or with another,
    are taken to be where the content-addressed layout has their text, as all rows are without ``old``. Equal texts in
    several old shards move to the one place. ``capacities`` are the bytes each new shard can hold: shards are near
    equal as far as these allow, and none gets more; a ValueError says that they do not suffice.
    """
    rows = with_home(docs, id, text, old, layout) if old else written(sized(docs.select(id, text), id, text), "sizes")
    heavy, blocks = placement(rows, layout, capacities)
    placed = with_blocks(rows, heavy, layout).join(F.broadcast(blocks), "block")
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).drop("subs")
    chunk = ["shard", "block", "sub"]
    counts = placed.groupBy(*chunk).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*chunk, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy(*chunk).orderBy("id", "group"))
    slots = placed.withColumn("number", number).join(offsets, chunk)
    return slots.select(
        F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.col("held" if old else "old_shard").alias("old_shard"), "shard",
        (F.col("offset") + F.col("number") - 1).cast("bigint").alias("slot"),
    )


def rewrite_affected(
    spark: SparkSession, docs: DataFrame, path: str, layout: Layout = Layout(), id: str = "doc_id", text: str = "text"
) -> list[int]:
    """Write the new shards that gain or lose rows below ``path``; returns their numbers.

    Each call writes to a folder of its own below ``path/data``, and then, in ``path/manifest/version=V``, one row
    (shard, folder) for every shard that has rows: a shard whose rows all stay keeps the folder it had. Nothing is
    deleted or overwritten, and a call that dies before its manifest changes nothing. Without a manifest there is
    no folder to keep, and all shards are written. ``read_shards`` reads what the newest manifest names.

    NULL texts and ids, ties and repeated rows go as ``reshard`` deals them; columns called shard, old_shard, group or
    block are replaced. An empty table empties all shards.
    """
    version, had = manifest(spark, path)
    rows = written(sized(docs.select(id, text), id, text), "sizes")
    heavy, blocks = placement(rows, layout)
    base = without(docs, "shard", "old_shard", "group", "block")
    body = F.coalesce(F.col(text), F.lit(""))
    marked = base.withColumn("group", F.xxhash64(body))
    piece = F.col("first_block") + F.pmod(F.xxhash64(id), F.col("pieces"))
    marked = marked.join(F.broadcast(heavy), "group", "left")
    marked = marked.withColumn("block", F.coalesce(piece.cast("bigint"), _light_block(F.col("group"), layout)))
    marked = marked.withColumn("old_shard", old_shard(F.col("group"), layout)).join(F.broadcast(blocks.drop("subs")), "block")
    moved = marked.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    held = sorted(r[0] for r in blocks.select("shard").distinct().collect())
    affected = sorted({r[0] for r in moved.collect()} | set(had).difference(held))
    fresh = [n for n in held if n in affected or n not in had]
    folder = f"{path}/data/{uuid.uuid4().hex}"
    marked.where(F.col("shard").isin(fresh)).select(*base.columns, "shard").write.partitionBy("shard").parquet(folder)
    named = [(n, f"{folder}/shard={n}" if n in fresh else had[n]) for n in held]
    named.append((None, None))  # also a version without shards has a row
    spark.createDataFrame(named, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest/version={version + 1}")
    return affected


MANIFEST = "shard int, folder string"


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest version, 0 for none, and the folder of each of its shards."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = rows.agg(F.max("version")).first()[0]
    named = rows.where((F.col("version") == newest) & F.col("shard").isNotNull())
    return newest, {r.shard: r.folder for r in named.collect()}


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all shards as the newest manifest names them, with their shard."""
    folders = sorted(manifest(spark, path)[1].items())
    parts = [spark.read.schema(schema).parquet(folder).withColumn("shard", F.lit(n)) for n, folder in folders]
    empty = spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, parts, empty)
