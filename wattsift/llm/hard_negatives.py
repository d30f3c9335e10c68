"""Hard negatives: for an anchor and a positive, the best other-label rows in a band below the positive's score.

Every anchor is compared with every row by one-bit codes; only pairs whose interval reaches into what is still wanted
are scored, exactly, on integers.
"""

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattsift.llm.bit_codes import LEVELS, Best, Queries, coded, inner, rotation
from wattsift.llm.vectors import LONG, largest, matrix, one_size, scaled, usable
from wattsift.session import work_dir, written

CODED = "id bigint, label bigint, x array<bigint>, codes array<bigint>, aligned array<double>, rest double"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
QUERIES, ROWS, SEED_ROWS = 128, 1024, 2048
LOWEST = LONG.min


def encode(rows: DataFrame, size: int, seed: int = 0, levels: int = LEVELS) -> DataFrame:
    """Rows (id, label, x) with their codes, alignments and the length of what is left."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(size, seed)
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(2), size)
            if largest(x) ** 2 * max(size, 1) > LONG.max:
                raise OverflowError("inner products beyond a long")
            codes, aligned, rest = coded(x, turn, levels)
            flat = codes.reshape(len(x), -1).view(np.int64)
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.from_numpy_dtype(v.dtype)))
                for v in (flat, aligned)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(rest)], names=["id", "label", "x", "codes", "aligned", "rest"])

    return rows.select("id", "label", "x").mapInArrow(code, CODED)


def _parts(batches: Iterator[pa.RecordBatch], size: int, levels: int):
    """Arrays (id, label, x, codes, aligned, rest) of up to ROWS rows."""
    for whole in batches:
        for k in range(0, len(whole), ROWS):
            batch = whole.slice(k, ROWS)
            n = len(batch)
            codes = np.asarray(batch.column(3).flatten()).reshape(n, levels, -1).view(np.uint64)
            aligned = np.asarray(batch.column(4).flatten()).reshape(n, levels)
            yield np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2), size), codes, aligned, np.asarray(batch.column(5))


def _found(best: Best) -> pa.RecordBatch:
    lists, scores, ids = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(scores), pa.array(ids)], names=["list", "score", "id"])


FOUND = "list int, score bigint, id bigint"


def _collected(found: DataFrame, most: int) -> Best:
    """The best of each list over all tasks. Lists are those of one block of anchors: a bounded number."""
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= most).toArrow()
    lists = np.asarray(rows.column("list").combine_chunks()) if len(rows) else np.empty(0, np.int32)
    best = Best(int(lists.max()) + 1 if len(lists) else 0, most, np.full(int(lists.max()) + 1 if len(lists) else 0, LOWEST))
    if len(lists):
        best.add(lists.astype(np.int64), np.asarray(rows.column("score").combine_chunks()), np.asarray(rows.column("id").combine_chunks()))
    return best


def _positives(coded_rows: DataFrame, sent, size: int, levels: int, most: int) -> DataFrame:
    """For each anchor of a block the best rows of its label: list (the anchor's number), score, id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q = (sent.value[k] for k in ("id", "label", "x"))
        queries = Queries(q, sent.value["turn"])
        best = Best(len(ids), most, sent.value["floor"])
        for row_ids, row_labels, x, codes, aligned, rest in _parts(batches, size, levels):
            for label in np.intersect1d(labels, row_labels):
                mine, own = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
                for k in range(0, len(mine), QUERIES):
                    some = mine[k : k + QUERIES]
                    _, high = queries.part(some).intervals(codes[own], aligned[own], rest[own])
                    a, r = np.nonzero((high >= best.least[some][:, None]) & (ids[some][:, None] != row_ids[own]))
                    a, r = some[a], own[r]
                    best.add(a, inner(q[a], x[r]), row_ids[r])
        yield _found(best)

    return coded_rows.mapInArrow(search, FOUND)


def _negatives(coded_rows: DataFrame, sent, size: int, levels: int, most: int) -> DataFrame:
    """For each window (an anchor and a positive) of a block the best other-label rows inside: list, score, id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, q = sent.value["label"], sent.value["x"]
        owner, top = sent.value["owner"], sent.value["top"]  # of each window; windows lie anchor by anchor
        queries = Queries(q, sent.value["turn"])
        best = Best(len(owner), most, sent.value["floor"])
        asked = np.unique(owner)
        begin, stop = np.searchsorted(owner, asked), np.searchsorted(owner, asked, "right")
        highest = np.maximum.reduceat(top, begin) if len(owner) else top
        for row_ids, row_labels, x, codes, aligned, rest in _parts(batches, size, levels):
            for k in range(0, len(asked), QUERIES):
                some = slice(k, k + QUERIES)
                who = asked[some]
                low, high = queries.part(who).intervals(codes, aligned, rest)
                least = np.minimum.reduceat(best.least, begin)[some]
                hit = (high >= least[:, None]) & (low <= highest[some][:, None]) & (labels[who][:, None] != row_labels)
                a, r = np.nonzero(hit)
                times = (stop - begin)[some][a]  # each pair meets every window of its anchor
                first = np.repeat(begin[some][a], times)
                window = first + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
                pair = np.repeat(np.arange(len(a)), times)
                inside = (high[a, r][pair] >= best.least[window]) & (low[a, r][pair] <= top[window])
                window, pair = window[inside], pair[inside]
                kept, at = np.unique(pair, return_inverse=True)
                scores = inner(q[who[a[kept]]], x[r[kept]])[at]
                fits = scores <= top[window]
                best.add(window[fits], scores[fits], row_ids[r[pair[fits]]])
        yield _found(best)

    return coded_rows.mapInArrow(search, FOUND)


def _seed_scores(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact scores of the block's anchors among some of them, which are rows like others: bounds to begin with."""
    some = slice(0, SEED_ROWS)
    x = block["x"]
    exact = largest(x) ** 2 * x.shape[1] < 1 << 53
    scores = (x.astype(float) @ x[some].astype(float).T).astype(np.int64) if exact else x @ x[some].T
    return scores, block["label"][some], block["id"][some]


def _nth(scores: np.ndarray, fit: np.ndarray, n: int) -> np.ndarray:
    """The n-th best fitting score of each row, the least long where fewer fit."""
    if scores.shape[1] < n:
        return np.full(len(scores), LOWEST)
    return np.partition(np.where(fit, scores, LOWEST), scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]


def hard_negatives(
    df: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, seed: int = 0, block_bytes: int = 4 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Entries become integers, floor(scale * entry); a score is the integer inner product. ``anchors`` tells, on the
    columns of ``df``, which rows are anchors. An anchor's positives are its first ``positives`` other rows of its
    label; for each, the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score are returned. Higher scores come first, ties by smaller id.

    Rows are coded once and written to the shared folder. The anchors, a stated query set, are taken in blocks of about
    ``block_bytes`` of vectors: a block is sent to the executors, every task compares it with its rows and keeps its own
    best of each list, and a shuffle of these finds the best of all. Bounds from exact scores inside the block let tasks
    drop what cannot be among the best before anything is shuffled. Each block's answer is written.

    Rows with a NULL id, label or vector, or with a NULL or non-finite entry, take no part. Rows that share an id count
    as one, the least by label, then vector. An anchor without positives, and a positive without rows in its band,
    have no rows. Vectors of differing sizes, and entries so large that a score may pass a long, are refused.
    """
    rows = df.where(F.col(id).isNotNull() & F.col(label).isNotNull() & usable(vector)).select(
        F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), scaled(vector, scale).alias("x"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.*")
    rows = written(rows, "negatives-rows")
    spark, size = df.sparkSession, one_size(rows, "x")
    path = work_dir(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(f"{path}/block=-1")
    if size:
        turn, levels = rotation(size, seed), LEVELS
        table = written(encode(rows, size, seed, levels), "negatives-codes")
        asked = rows.where("anchor")
        blocks = ceil(asked.count() * size * 8 / block_bytes)
        for k in range(blocks):
            _block(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k), table, f"{path}/block={k}", turn, levels, positives, negatives, low, high)
    return spark.read.schema(RESULT).parquet(*[f"{path}/block={k}" for k in range(-1, blocks if size else 0)])


def _block(asked: DataFrame, table: DataFrame, path: str, turn, levels: int, positives: int, negatives: int, low: int, high: int) -> None:
    spark, size = table.sparkSession, len(turn)
    got = asked.select("id", "label", "x").toArrow()
    block = {
        "id": np.asarray(got.column(0).combine_chunks()) if len(got) else np.empty(0, np.int64),
        "label": np.asarray(got.column(1).combine_chunks()) if len(got) else np.empty(0, np.int64),
        "x": matrix(got.column(2), size) if len(got) else np.empty((0, size), np.int64),
        "turn": turn,
    }
    scores, seed_labels, seed_ids = _seed_scores(block)
    same = block["label"][:, None] == seed_labels
    floor = _nth(scores, same & (block["id"][:, None] != seed_ids), positives)
    sent = spark.sparkContext.broadcast(block | {"floor": floor})
    best = _collected(_positives(table, sent, size, levels, positives), positives)
    owner, score, positive = best.rows()
    # integers between low and high per cent of the positive's score
    least, top = -((-low * score) // 100), (high * score) // 100
    some = least <= top
    owner, score, positive, least, top = owner[some], score[some], positive[some], least[some], top[some]
    floor = np.empty(len(owner), np.int64)
    for k in range(0, len(owner), 4096):
        w = slice(k, k + 4096)
        mine = scores[owner[w]]
        floor[w] = np.maximum(least[w], _nth(mine, ~same[owner[w]] & (mine <= top[w][:, None]), negatives))
    sent = spark.sparkContext.broadcast(block | {"floor": floor, "owner": owner, "top": top})
    found = _collected(_negatives(table, sent, size, levels, negatives), negatives)
    window, negative_score, negative = found.rows()
    rank = np.arange(len(window)) - np.searchsorted(window, window) + 1
    columns = [block["id"][owner[window]], positive[window], rank.astype(np.int32), negative, score[window], negative_score]
    names = [f.split()[0] for f in RESULT.split(", ")]
    out = pa.Table.from_arrays([pa.array(c) for c in columns], names=names)
    spark.createDataFrame(out, RESULT).write.parquet(path)
