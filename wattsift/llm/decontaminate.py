"""Benchmark decontamination: multi-pattern search for windows of test items in documents.

The patterns are windows of words, and the search moves over words. For each pattern length a shift table over
blocks of two words tells how far the search may jump; where the jump is zero, the block ends some pattern,
and the patterns in its bucket whose first block agrees as well are compared word for word.
"""

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import plain, plus, revived, without
from wattsift.llm.words import ALNUM, UPPER_TO_LOWER, Found, Words, mixed, slices

FOUND = "n_words bigint, hit_ranges array<struct<first:bigint,last:bigint>>, items array<string>"
LANE_WORDS = 128


def _joined(lower: bytes, found: Found, first: int, last: int) -> bytes:
    return b" ".join(lower[a:b] for a, b in zip(found.starts[first : last + 1], found.ends[first : last + 1]))


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each position; shorter ones at the beginning are void."""
    if size == 1:
        return hashes
    out = np.zeros(len(hashes), np.uint64)
    out[1:] = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])
    return out


class Patterns:
    """Search tables for the patterns of one length."""

    def __init__(self, length: int, windows: dict[bytes, tuple[np.ndarray, list[str]]]):
        self.length, self.block = length, min(2, length)
        self.texts = list(windows)
        self.items = [sorted(windows[t][1]) for t in self.texts]
        hashes = np.array([windows[t][0] for t in self.texts], np.uint64).reshape(-1, length)
        self.bits = max(16, int(np.log2(max(1, hashes.size))) + 3)
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int16)
        ending = np.stack([_blocks(row, self.block) for row in hashes])
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, self._slot(ending[:, j]), length - 1 - j)
        order = np.argsort(ending[:, -1], kind="stable")
        self.suffix, self.order = ending[order, -1], order
        self.prefix = ending[:, self.block - 1]

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def ends(self, blocks: np.ndarray) -> np.ndarray:
        """Word positions at which a pattern may end. Many lanes of the text jump side by side."""
        n = len(blocks)
        slot = self._slot(blocks)
        at = np.arange(self.length - 1, n, LANE_WORDS)
        stop = np.minimum(at + LANE_WORDS, n)
        seen = []
        while len(at):
            jump = self.shift[slot[at]]
            seen.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(seen) if seen else np.empty(0, np.int64)

    def occurrences(self, found: Found, hashes: np.ndarray, text: np.ndarray, lower: bytes):
        """(text, first word, last word, items) of every confirmed occurrence."""
        blocks = _blocks(hashes, self.block)
        ends = self.ends(blocks)
        ends = ends[text[ends - self.length + 1] == text[ends]]
        low = np.searchsorted(self.suffix, blocks[ends], "left")
        high = np.searchsorted(self.suffix, blocks[ends], "right")
        for end, a, b in zip(ends[high > low], low[high > low], high[high > low]):
            first = end - self.length + 1
            bucket = self.order[a:b]
            bucket = bucket[self.prefix[bucket] == blocks[first + self.block - 1]]
            if len(bucket):
                words = _joined(lower, found, first, end)
                for k in bucket:
                    if self.texts[k] == words:
                        yield text[end], first, end, self.items[k]


def compile_patterns(items: pa.Table, window: int) -> list[Patterns]:
    """Search tables, by length, for a table (item string, text string)."""
    by_length: dict[int, dict[bytes, tuple]] = defaultdict(dict)
    names, texts = items.column(0).to_pylist(), items.column(1).combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    found = Words(ALNUM).of(texts)
    hashes, lower = found.hashes(), UPPER_TO_LOWER[found.raw].tobytes()
    for name, a, b in zip(names, found.bounds[:-1], found.bounds[1:]):
        length = min(window, b - a)
        for first in range(a, b - length + 1) if length else ():
            words = _joined(lower, found, first, first + length - 1)
            _, named = by_length[int(length)].setdefault(words, (hashes[first : first + length], set()))
            named.add(name)
    return [Patterns(k, v) for k, v in sorted(by_length.items())]


def _scan(batch: pa.RecordBatch, words: Words, patterns: list[Patterns], text: str, keep: int) -> pa.RecordBatch:
    found = words.of(batch.column(text))
    counts = found.counts
    hashes = found.hashes()
    owner = np.repeat(np.arange(len(counts)), counts)
    lower = UPPER_TO_LOWER[found.raw].tobytes()
    ranges = [[(r["first"], r["last"]) for r in had] for had in batch.column("hit_ranges").to_pylist()]
    items = [set(had) for had in batch.column("items").to_pylist()]
    for p in patterns:
        for t, first, last, named in p.occurrences(found, hashes, owner, lower):
            start = found.bounds[t]
            ranges[t].append((int(first - start), int(last - start)))
            items[t].update(named)
    fields = plus_fields()
    return pa.RecordBatch.from_arrays(
        [
            *batch.columns[:keep],
            pa.array(counts, pa.int64()),
            pa.array([[{"first": a, "last": b} for a, b in _merged(r)] for r in ranges], fields[1].type),
            pa.array([sorted(i) for i in items], fields[2].type),
        ],
        names=[*batch.schema.names[:keep], *(f.name for f in fields)],
    )


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def plus_fields() -> list[pa.Field]:
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    return [pa.field("n_words", pa.int64()), pa.field("hit_ranges", pa.list_(span)), pa.field("items", pa.list_(pa.string()))]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 10, block_bytes: int = 32 << 20,
) -> DataFrame:
    """Add to each document n_words, hit_ranges (first and last word, merged, in order), items, n_hit, contaminated.

    Words are runs of letters a-z, digits and characters beyond ASCII, after lower-casing A-Z. Each window of
    ``window`` consecutive words of an item is a pattern; an item with fewer words is one. The test items are the
    stated query set: they are read in blocks of about ``block_bytes`` of text, each compiled on the driver, sent to
    the executors and searched for in all documents, with no shuffle.

    A NULL or empty text has no words and is clean. An item without words or with a NULL id has no patterns; items
    that share an id count as one. Repeated documents are answered each. Columns of these names are replaced.
    """
    base = without(docs, "n_words", "hit_ranges", "items", "n_hit", "contaminated")
    keep = len(base.columns)
    named = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(size / block_bytes))
    out = base.selectExpr(
        "*", "0L AS n_words", "cast(array() AS array<struct<first:bigint,last:bigint>>) AS hit_ranges", "cast(array() AS array<string>) AS items"
    )
    schema = plus(base, FOUND)
    for k in range(blocks):
        block = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow()
        patterns = docs.sparkSession.sparkContext.broadcast([plain(p) for p in compile_patterns(block, window)])

        def scan(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            words, tables = Words(ALNUM), [revived(Patterns, p) for p in patterns.value]
            for batch in batches:
                for part in slices(batch, text):
                    yield _scan(part, words, tables, text, keep)

        out = out.mapInArrow(scan, schema)
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)
