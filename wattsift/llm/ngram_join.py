"""N-gram Jaccard join: prefix filtering under several global token orders, then exact verification.

Documents with the same shingle set fold into one set. Shingles travel to reducers in packed arrays, one row
for a run of documents and a range of shingle hashes, and come back to their sets only where two or more sets
hold them. A set whose shingles are mostly its own cannot reach the threshold and is gone by then. The others
have a prefix under each of three global orders; all of them put the rarer shingles first:

1. by the exact number of sets, then by hash,
2. by the magnitude of that number, then by another hash,
3. shingles of the frequent list last, else by a third hash.

Sets whose prefixes under the first order are chained together form a block for verification. In a block, only
pairs that fit in size and share a prefix shingle under all three orders are compared in full.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.connected import components
from wattsift.llm.frames import without
from wattsift.llm.words import NOT_BLANK, Words, mixed, slices
from wattsift.session import written

U64 = np.uint64
ORDERS = 3
PACKED = "target bigint, sets binary, sizes binary, counts binary, tokens binary, df binary"
FREQUENT_DF = 1 << 31
#: Shingles are told apart by the upper 48 bits of their hash, which travel as 6 bytes.
TOP_BITS = U64(0xFFFFFFFFFFFF0000)


def _sorted_sets(found, size: int) -> list[np.ndarray]:
    """For each text of a slice its distinct shingle hashes in order."""
    values, owner = found.windows(size)
    values &= TOP_BITS
    cuts = np.searchsorted(owner, np.arange(len(found.counts) + 1))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = np.sort(values[a:b])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def _six(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _batch(columns: list, ddl_names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=ddl_names)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["target", "sets", "sizes", "counts", "tokens", "df"]
    return _batch([list(c) for c in zip(*rows)] if rows else [[]] * 6, names, [pa.int64()] + [pa.binary()] * 5)


def profile(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """(id, n_shingles, set_id) of every document; set_id is NULL where there is no word."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(NOT_BLANK)
        for batch in batches:
            for part in slices(batch, text):
                sets = _sorted_sets(words.of(part.column(text)), size)
                ids = [_set_id(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64())],
                    names=["id", "n_shingles", "set_id"],
                )

    return docs.select(id, text).mapInArrow(run, f"id {kind}, n_shingles bigint, set_id bigint")


def frequent_shingles(docs: DataFrame, text: str, size: int, one_in: int, at_least: int, most: int) -> np.ndarray:
    """Shingles that many texts hold, from one text in ``one_in`` by its hash: at most about ``most`` of them.

    They only decide which shingles stand last in the orders; any list gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(NOT_BLANK)
        for batch in batches:
            for part in slices(batch, text):
                sets = [s for s in _sorted_sets(words.of(part.column(text)), size) if len(s)]
                if sets:
                    ids = np.repeat([_set_id(s) for s in sets], [len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sets).view(np.int64)), pa.array(ids, pa.int64())], names=["token", "set_id"]
                    )

    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0).mapInArrow(run, "token bigint, set_id bigint")
    held = written(sample.distinct().groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= at_least), "frequent")
    total = held.agg(F.sum("n")).first()[0] or 0
    rows = held.where(F.col("n") >= total // most).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().view(U64))


def _is_frequent(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return frequent[at] == tokens


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, stop) of the runs of a sorted array."""
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(keys[a]), int(a), int(b)


def _deal(docs: DataFrame, text: str, size: int, frequent, ranges: int, buckets: int) -> DataFrame:
    """Packed shingles to ranges 0.. and packed headers (set, size, its frequent shingles) to targets -1, -2, .."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, common = Words(NOT_BLANK), set(), frequent.value
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                sets, ids = [], []
                for s in _sorted_sets(words.of(part.column(text)), size):
                    if len(s) and (name := _set_id(s)) not in seen:
                        seen.add(name)
                        sets.append(s)
                        ids.append(name)
                if not sets:
                    continue
                ids, lengths = np.array(ids, np.int64), np.array([len(s) for s in sets])
                tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
                often = _is_frequent(tokens, common)
                rows = []
                bucket = (ids.view(U64) % U64(buckets)).astype(np.int64)
                owner_often, tokens_often = owner[often], tokens[often]
                n_often = np.bincount(owner_often, minlength=len(sets))
                order = np.argsort(bucket, kind="stable")
                for b, i, j in _by_key(bucket[order]):
                    own = order[i:j]
                    held = tokens_often[np.isin(owner_often, own)] if n_often[own].any() else tokens_often[:0]
                    rows.append((-1 - b, ids[own].tobytes(), lengths[own].astype(np.uint32).tobytes(),
                                 n_often[own].astype(np.uint32).tobytes(), _six(held), b""))
                tokens, owner = tokens[~often], owner[~often]
                target = ((tokens >> U64(16)) % U64(ranges)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                tokens, owner = tokens[order], owner[order]
                for r, i, j in _by_key(target[order]):
                    first = np.flatnonzero(np.concatenate(([True], owner[i + 1 : j] != owner[i : j - 1])))
                    counts = np.diff(np.append(first, j - i)).astype(np.uint32)
                    rows.append((r, ids[owner[i + first]].tobytes(), b"", counts.tobytes(), _six(tokens[i:j]), b""))
                yield _packed(rows)

    return docs.select(text).mapInArrow(run, PACKED)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``keys`` columns; one run at a time is held."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _gathered(rows: list[tuple], at: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), kind)


def _shared_only(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """From ranges of shingles to buckets of sets: those shingles that two or more sets hold, with their number."""
    for (target,), rows in _runs(batches, 1):
        if target < 0:
            yield _packed([(target, *r) for r in rows])
            continue
        sets = np.repeat(_gathered(rows, 0, np.int64), _gathered(rows, 2, np.uint32))
        tokens = _from_six(b"".join(r[3] for r in rows))
        order = np.argsort(tokens)
        sets, tokens = sets[order], tokens[order]
        same = tokens[1:] == tokens[:-1]
        more = np.concatenate((same, [False])) | np.concatenate(([False], same))
        sets, tokens = sets[more], tokens[more]
        order = np.lexsort((sets, tokens))
        sets, tokens = sets[order], tokens[order]
        fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])))[: len(tokens)]
        sets, tokens = sets[fresh], tokens[fresh]
        df = np.zeros(len(tokens), np.uint32)
        for _, i, j in _by_key(tokens):
            df[i:j] = min(j - i, FREQUENT_DF - 1)
        sets, tokens, df = sets[df > 1], tokens[df > 1], df[df > 1]
        bucket = (sets.view(U64) % U64(buckets)).astype(np.int64)
        order = np.lexsort((sets, bucket))
        sets, tokens, df, bucket = sets[order], tokens[order], df[order], bucket[order]
        out = []
        for b, i, j in _by_key(bucket):
            first = np.flatnonzero(np.concatenate(([True], sets[i + 1 : j] != sets[i : j - 1])))
            counts = np.diff(np.append(first, j - i)).astype(np.uint32)
            out.append((-1 - b, sets[i + first].tobytes(), b"", counts.tobytes(), _six(tokens[i:j]), df[i:j].tobytes()))
        if out:
            yield _packed(out)


def _orders(tokens: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
    last = df >= FREQUENT_DF
    other, third = mixed(tokens + U64(1)), mixed(tokens ^ U64(0xA5A5A5A5A5A5A5A5))
    magnitude = np.frexp(df.astype(np.float64))[1]
    return [np.lexsort((tokens, df)), np.lexsort((other, magnitude, last)), np.lexsort((third, last))]


SURVIVORS = "set_id bigint, n bigint, tokens binary, " + ", ".join(f"prefix{k} binary" for k in range(ORDERS)) + ", first array<bigint>"


def _survivors(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Sets whose prefix holds shared shingles, with all their shared shingles and the shared part of each prefix."""
    names = ["set_id", "n", "tokens", *(f"prefix{k}" for k in range(ORDERS)), "first"]
    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * (1 + ORDERS) + [pa.list_(pa.int64())]
    for _, rows in _runs(batches, 1):
        heads, lists = [r for r in rows if r[1]], [r for r in rows if not r[1]]
        ids, sizes = _gathered(heads, 0, np.int64), _gathered(heads, 1, np.uint32).astype(np.int64)
        n_often, often = _gathered(heads, 2, np.uint32), _from_six(b"".join(r[3] for r in heads))
        sets = np.concatenate((np.repeat(_gathered(lists, 0, np.int64), _gathered(lists, 2, np.uint32)), np.repeat(ids, n_often)))
        tokens = np.concatenate((_from_six(b"".join(r[3] for r in lists)), often))
        df = np.concatenate((_gathered(lists, 4, np.uint32), np.full(len(often), FREQUENT_DF, np.uint32)))
        ids, first = np.unique(ids, return_index=True)
        sizes = sizes[first]
        order = np.lexsort((tokens, sets))
        sets, tokens, df = sets[order], tokens[order], df[order]
        # copies of a set reach other tasks too; their frequent shingles count once
        fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])))[: len(tokens)]
        sets, tokens, df = sets[fresh], tokens[fresh], df[fresh]
        low, high = np.searchsorted(sets, ids, "left"), np.searchsorted(sets, ids, "right")
        prefix = sizes - (num * sizes + den - 1) // den + 1
        room = prefix - (sizes - (high - low))
        columns: list[list] = [[] for _ in names]
        for k in np.flatnonzero((room > 0) & (high > low)):
            own, own_df = tokens[low[k] : high[k]], df[low[k] : high[k]]
            prefixes = [own[o[: room[k]]] for o in _orders(own, own_df)]
            row = (int(ids[k]), int(sizes[k]), _six(own), *(_six(p) for p in prefixes), prefixes[0].view(np.int64).tolist())
            for c, value in zip(columns, row):
                c.append(value)
        if columns[0]:
            yield _batch(columns, names, kinds)


def _incidence(lists: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Sets by shingles as 0 and 1, for the shingles of more than one set, in pieces of columns."""
    tokens = np.concatenate(lists)
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    rows, column, width = rows[kept], rank[column[kept]], int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    step = 8192
    for start in range(0, width, step):
        i, j = np.searchsorted(column, [start, start + step])
        piece = np.zeros((len(lists), min(step, width - start)), np.float32)
        piece[rows[i:j], column[i:j] - start] = 1
        yield piece


def _overlaps(lists: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(lists), len(lists)), np.float64)
    for piece in _incidence(lists):
        out += piece @ piece.T
    return out


def linked_pairs(sizes: np.ndarray, prefixes: list[list[np.ndarray]], tokens: list[np.ndarray], across: np.ndarray, num: int, den: int):
    """Index pairs that pass the size filter and every order's prefix filter and reach the threshold exactly."""
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    may = across & (small * den >= num * large)
    for lists in prefixes:
        if not may.any():
            return []
        may &= _overlaps(lists) > 0
    rows = np.flatnonzero(may.any(axis=0) | may.any(axis=1))
    if not len(rows):
        return []
    both = _overlaps([tokens[i] for i in rows])
    union = np.add.outer(sizes[rows], sizes[rows]) - both
    a, b = np.nonzero(may[np.ix_(rows, rows)] & (den * both >= num * union))
    return list(zip(rows[a].tolist(), rows[b].tolist()))


def _verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links of each block pair as a forest: each linked set and one set of its local component."""
    for (_, low, high), rows in _runs(batches, 3):
        if len(rows) < 2:
            continue
        block, ids, sizes = (np.array([r[k] for r in rows]) for k in range(3))
        tokens = [_from_six(r[3]) for r in rows]
        prefixes = [[_from_six(r[4 + k]) for r in rows] for k in range(ORDERS)]
        across = np.less.outer(block, block) if low != high else np.triu(np.ones((len(rows), len(rows)), bool), 1)
        parent = list(range(len(rows)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in linked_pairs(sizes, prefixes, tokens, across, num, den):
            parent[root(a)] = root(b)
        moved = [i for i in range(len(rows)) if root(i) != i]
        if moved:
            yield _batch([ids[moved].tolist(), [int(ids[root(i)]) for i in moved]], ["u", "v"], [pa.int64()] * 2)


def set_links(
    docs: DataFrame, text: str, size: int, num: int, den: int, n_tokens: int, range_tokens: int, block_sets: int,
    block_tokens: int, one_in: int, at_least: int, most: int,
) -> DataFrame:
    """Edges (u, v) between set ids whose components are those of all links."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(tasks, n_tokens // range_tokens + 1)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, text, size, one_in, at_least, most))
    dealt = _deal(docs, text, size, frequent, ranges, ranges)
    tasks = ranges
    shared = (
        dealt.repartition(tasks, "target").sortWithinPartitions("target").mapInArrow(lambda b: _shared_only(b, ranges), PACKED)
    )
    sets = written(
        shared.repartition(tasks, "target").sortWithinPartitions("target").mapInArrow(lambda b: _survivors(b, num, den), SURVIVORS),
        "sets",
    )
    held = sets.select("set_id", F.explode("first").alias("token"))
    leader = held.groupBy("token").agg(F.min("set_id").alias("v"), F.max("set_id").alias("last")).where("v <> last").drop("last")
    chained = components(held.join(leader, "token").select(F.col("set_id").alias("u"), "v"))
    member = written(chained.join(sets.selectExpr("set_id AS node", "length(tokens) DIV 6 AS n_tokens"), "node"), "members")
    parts = F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n_tokens") / block_tokens)).cast("int")
    blocks = member.groupBy("root").agg(parts.alias("parts"))
    placed = (
        sets.drop("first")
        .join(member.drop("n_tokens"), sets["set_id"] == member["node"])
        .join(blocks, "root")
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    keyed = placed.select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set_id", "n",
        "tokens", *(f"prefix{k}" for k in range(ORDERS)),
    )
    key = ["root", "low", "high"]
    return (
        keyed.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(lambda b: _verified(b, num, den), "u bigint, v bigint")
    )


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, num: int = 75, den: int = 100,
    range_tokens: int = 2_000_000, block_sets: int = 256, block_tokens: int = 1_000_000, one_in: int = 32,
    at_least: int = 16, most: int = 1 << 20,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``: the least id reachable by links, its own included.

    The set of a document is its distinct shingles of ``size`` words (runs of characters other than blanks, A-Z as
    a-z); fewer words make one shingle. Two documents link when den * shared >= num * united. Copies always link.
    Without words the set is empty and links with nothing.

    ``range_tokens``, ``block_sets`` and ``block_tokens`` bound what a task holds; ``one_in``, ``at_least`` and ``most``
    make the list of frequent shingles (at most ``most`` by its construction, 8 bytes each, sent to executors). None
    of them changes the links. Shingles are told apart by 48 bits of hash, sets by 64.

    Rows that repeat an id each get a row. A NULL id never is a component's least; alone it gives NULL. Other columns
    of ``docs`` are not looked at.
    """
    rows = written(profile(without(docs.select(id, text)), id, text, size), "profile")
    classes = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("id").alias("least"), F.max("n_shingles").alias("n"))
    n_tokens = classes.agg(F.sum("n")).first()[0] or 0
    edges = set_links(docs, text, size, num, den, n_tokens, range_tokens, block_sets, block_tokens, one_in, at_least, most)
    linked = components(edges)
    named = linked.join(classes.select(F.col("set_id").alias("node"), "least"), "node")
    roots = named.groupBy("root").agg(F.min("least").alias("reached"))
    reach = linked.join(roots, "root").select(F.col("node").alias("set_id"), "reached")
    ids = classes.join(reach, "set_id", "left").select("set_id", F.coalesce("reached", "least").alias("component_id"))
    out = rows.join(ids, "set_id", "left")
    return out.select(F.col("id").alias(id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
