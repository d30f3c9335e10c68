"""One-bit codes of rotated vectors, and what they tell for certain about inner products.

A vector is rotated; the signs of its entries, as a unit vector b, are its code, and its alignment is t = <y, b>. What is
left, y - t b, is coded again, level by level. With queries rounded to a few bits a popcount of each bit plane gives the
inner product of a query with a code, and <q, x> = sum of t <z, b> + <z, rest>, where the last part is at most |q| |rest|.
"""

import numpy as np

LEVELS, PLANES = 4, 6
#: Covers the rounding of doubles, as a part of |q| |x|.
SLACK = 1e-9


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, the last one filled up with zeros."""
    wide = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 64), np.uint8)
    wide[..., : bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def coded(x: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), alignments (rows, levels) and the length of what is left of each row."""
    rest = x.astype(float) @ turn.T
    unit = 1 / np.sqrt(x.shape[1])
    codes, aligned = [], []
    for _ in range(levels):
        up = rest >= 0
        t = np.abs(rest).sum(axis=1) * unit
        rest = rest - np.where(up, unit, -unit) * t[:, None]
        codes.append(_packed(up))
        aligned.append(t)
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.sqrt((rest * rest).sum(axis=1))


class Queries:
    """Rotated queries as bit planes."""

    def __init__(self, q: np.ndarray, turn: np.ndarray, planes: int = PLANES):
        z = q.astype(float) @ turn.T
        low, high = z.min(axis=1, keepdims=True), z.max(axis=1, keepdims=True)
        self.step = np.where(high > low, (high - low) / (2**planes - 1), 1.0)
        level = np.rint((z - low) / self.step).astype(np.int64)
        self.low, self.size, self.count = low, z.shape[1], planes
        self.planes = np.stack([_packed((level >> p) & 1) for p in range(planes)], axis=1)
        self.sums = level.sum(axis=1, keepdims=True)
        self.length = np.sqrt((z * z).sum(axis=1, keepdims=True))
        #: |<z - rounded z, b>| is at most this, whatever the code
        self.rounding = np.abs(z - (low + level * self.step)).sum(axis=1, keepdims=True) / np.sqrt(self.size)

    def part(self, rows: np.ndarray | slice) -> "Queries":
        out = object.__new__(Queries)
        out.__dict__.update(self.__dict__)
        for name in ("step", "low", "planes", "sums", "length", "rounding"):
            setattr(out, name, getattr(self, name)[rows])
        return out

    def intervals(self, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible inner product of each query (row) with each coded vector (column)."""
        middle = np.zeros((len(self.planes), len(codes)))
        for k in range(codes.shape[1]):
            total = np.zeros(middle.shape, np.int32)
            for p in range(self.count):
                for w in range(codes.shape[2]):
                    total += np.bitwise_count(self.planes[:, p, w, None] & codes[:, k, w]).astype(np.int32) << p
            ones = np.bitwise_count(codes[:, k]).sum(axis=1, dtype=np.int64)
            with_code = self.step * (2 * total - self.sums) + self.low * (2 * ones - self.size)
            middle += with_code * (aligned[:, k] / np.sqrt(self.size))
        sums = aligned.sum(axis=1)
        radius = self.rounding * sums + self.length * (rest + SLACK * (sums + rest)) + SLACK
        return middle - radius, middle + radius


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, pair by pair."""
    out = np.empty(len(q), np.int64)
    for k in range(0, len(q), 1 << 16):
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", q[k : k + (1 << 16)], x[k : k + (1 << 16)])
    return out


class Best:
    """The ``most`` best (score falling, id rising) of each of ``lists`` lists; none below its ``floor``."""

    def __init__(self, lists: int, most: int, floor: np.ndarray):
        self.most, self.floor = most, floor
        self.score = np.full((lists, most), np.iinfo(np.int64).min)
        self.id = np.zeros((lists, most), np.int64)
        self.there = np.zeros((lists, most), bool)

    @property
    def least(self) -> np.ndarray:
        """A score that a newcomer must at least reach."""
        return np.where(self.there[:, -1], np.maximum(self.score[:, -1], self.floor), self.floor)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        new = scores >= self.least[lists]
        lists, scores, ids = lists[new], scores[new], ids[new]
        if not len(lists):
            return
        had = np.unique(lists)
        there = self.there[had]
        lists = np.concatenate((np.repeat(had, self.most)[there.ravel()], lists))
        scores = np.concatenate((self.score[had][there], scores))
        ids = np.concatenate((self.id[had][there], ids))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        rank = np.arange(len(lists)) - np.searchsorted(lists, lists)
        top = rank < self.most
        self.score[lists[top], rank[top]] = scores[top]
        self.id[lists[top], rank[top]] = ids[top]
        self.there[lists[top], rank[top]] = True

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, score and id of all that is held."""
        lists, _ = np.nonzero(self.there)
        return lists, self.score[self.there], self.id[self.there]
