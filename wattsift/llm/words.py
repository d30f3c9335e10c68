"""Words and shingles of whole Arrow batches of text, in numpy on the UTF-8 bytes.

Tasks see texts as Arrow string columns. The bytes of all texts of a slice lie one behind the other, so
one pass of array operations finds and hashes the words of every text of it. NULL texts count as empty.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
RADIX = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20

UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32

#: Bytes of words, as in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words, as in ``[^\x20\x09-\x0D]+``.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text; a longer text comes alone, whole."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    total = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if wide.null_count:
        wide = pa.compute.fill_null(wide, "")
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int, radix: int) -> np.ndarray:
    """radix ** 0 .. radix ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U64(pow(radix, done, 1 << 64))
        done += more
    return out


class Words:
    """Finds the words of texts; one object serves all batches of a task."""

    def __init__(self, inside: np.ndarray):
        self.inside = inside
        self.codes = mixed(np.arange(1, 257, dtype=U64) * U64(RADIX))[UPPER_TO_LOWER]
        self.up = self.down = np.ones(1, U64)

    def of(self, column: pa.Array) -> "Found":
        raw, offsets = text_bytes(column)
        n = len(raw)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        word = self.inside[UPPER_TO_LOWER[raw]]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | first[1:])) + 1
        return Found(self, raw, offsets, starts, ends)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = _powers(n, RADIX)
            self.down = _powers(n, pow(RADIX, -1, 1 << 64))
        return self.up, self.down


class Found:
    """Words of one slice: bytes ``starts[i]:ends[i]`` of ``raw``; text t has words ``bounds[t]:bounds[t + 1]``."""

    def __init__(self, words: Words, raw, offsets, starts, ends):
        self.raw, self.offsets, self.starts, self.ends = raw, offsets, starts, ends
        self.bounds = np.searchsorted(starts, offsets)
        self._words = words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same wherever it stands; A-Z count as a-z."""
        n = len(self.raw)
        up, down = self._words.powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(self._words.codes[self.raw] * up[:n], out=sums[1:])
        lengths = (self.ends - self.starts).astype(U64)
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + lengths)

    def windows(self, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of every window of ``size`` words; a text with fewer words is one window."""
        h = self.hashes() if hashes is None else hashes
        counts = self.counts
        text = np.repeat(np.arange(len(counts)), counts)
        room = self.bounds[1:][text] - np.arange(len(h))
        full = np.flatnonzero(room >= size)
        mixed_up = np.zeros(len(full), U64)
        for i in range(size):
            mixed_up = mixed(mixed_up * U64(RADIX) + h[full + i])
        short = np.flatnonzero((counts > 0) & (counts < size))
        few = np.empty(len(short), U64)
        for k, t in enumerate(short):
            value = np.full(1, counts[t], U64)
            for x in h[self.bounds[t] : self.bounds[t + 1]]:
                value = mixed(value * U64(RADIX) + x)
            few[k] = value[0] ^ U64(RADIX)
        owner = np.concatenate((text[full], short))
        values = np.concatenate((mixed_up, few))
        order = np.argsort(owner, kind="stable")
        return values[order], owner[order]
