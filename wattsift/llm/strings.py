"""Subsequence string kernel of order 3 with decaying gaps, for many short strings at once.

The kernel of two strings sums, over all subsequences of three symbols that both hold, decay ** (span in one + span in
the other). A string's feature vector is its weighted triples, so a weighted sum of kernels with fixed strings is a
table over triples, looked up for every triple of a string.
"""

from functools import lru_cache

import numpy as np

DECAY = 0.7
SYMBOLS = 91
MOST = 24
TABLE = SYMBOLS**3


def _symbol_table() -> np.ndarray:
    """Bytes to symbols: a-z (A-Z alike) 1 to 26, second bytes of accented letters 27 to 90, digits and signs that
    stand for letters as those; 0 for the rest, which only widens gaps."""
    out = np.zeros(256, np.uint8)
    for k in range(26):
        out[65 + k] = out[97 + k] = 1 + k
    out[128:192] = 27 + np.arange(64)
    for sign, letter in zip("013457@$", "oieastas"):
        out[ord(sign)] = ord(letter) - 96
    return out


SYMBOL = _symbol_table()


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = (x.astype(np.int64) for x in np.array([(i, j, k) for k in range(n) for j in range(k) for i in range(j)]).T)
    return i, j, k, DECAY ** (k - i + 1.0)


def _codes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple codes of strings of one length (rows), and weights, 0 for triples with an empty symbol."""
    i, j, k, weight = _triples(strings.shape[1])
    s = strings.astype(np.int64)
    codes = (s[:, i] * SYMBOLS + s[:, j]) * SYMBOLS + s[:, k]
    live = (s[:, i] > 0) & (s[:, j] > 0) & (s[:, k] > 0)
    return codes, np.where(live, weight, 0.0)


def triple_table(string: np.ndarray) -> np.ndarray:
    """A string's feature vector over all triples."""
    out = np.zeros(TABLE)
    if len(string) >= 3:
        codes, weight = _codes(string[None, :])
        np.add.at(out, codes[0], weight[0])
    return out


def dots(strings: np.ndarray, table: np.ndarray, step: int = 2000) -> np.ndarray:
    """For strings of one length, the inner product of their feature vectors with a table."""
    out = np.zeros(len(strings))
    if strings.shape[1] >= 3:
        for a in range(0, len(strings), step):
            codes, weight = _codes(strings[a : a + step])
            out[a : a + step] = np.einsum("ij,ij->i", table[codes], weight)
    return out


class Landmarks:
    """Feature vectors of unit length of a few strings, kept only at the triples that some of them have."""

    def __init__(self, strings: list[np.ndarray]):
        parts = [_codes(s[None, :]) for s in strings]
        self.used = np.unique(np.concatenate([c[0][w[0] > 0] for c, w in parts]))
        self.slot = np.zeros(TABLE, np.int32)
        self.slot[self.used] = np.arange(1, len(self.used) + 1)
        self.rows = np.zeros((len(strings), len(self.used) + 1))
        for row, (codes, weight) in zip(self.rows, parts):
            np.add.at(row, self.slot[codes[0]], weight[0])
            row[0] = 0
            row /= np.sqrt((row**2).sum())

    def products(self, strings: np.ndarray, step: int = 2000) -> np.ndarray:
        """For strings of one length, the inner product with each landmark."""
        out = np.zeros((len(strings), len(self.rows)))
        if strings.shape[1] >= 3:
            for a in range(0, len(strings), step):
                codes, weight = _codes(strings[a : a + step])
                at = self.slot[codes]
                for j, row in enumerate(self.rows):
                    out[a : a + step, j] = np.einsum("ij,ij->i", row[at], weight)
        return out

    def combined(self, coefficients: np.ndarray) -> np.ndarray:
        """The table of a weighted sum of landmarks."""
        out = np.zeros(TABLE)
        out[self.used] = coefficients @ self.rows[:, 1:]
        return out


def norms(strings: np.ndarray, step: int = 2000) -> np.ndarray:
    """For strings of one length, the length of their feature vectors; 1 for strings without a triple."""
    out = np.zeros(len(strings))
    if strings.shape[1] >= 3:
        for a in range(0, len(strings), step):
            codes, weight = _codes(strings[a : a + step])
            order = np.argsort(codes, axis=1)
            codes, weight = np.take_along_axis(codes, order, 1), np.take_along_axis(weight, order, 1)
            upto = np.cumsum(weight, axis=1)
            last = np.ones(codes.shape, bool)
            last[:, :-1] = codes[:, 1:] != codes[:, :-1]
            # sums of equal triples, as steps of the running sum at the last of each
            held = np.where(last, upto, 0.0)
            before = np.maximum.accumulate(np.concatenate((np.zeros((len(held), 1)), held[:, :-1]), axis=1), axis=1)
            out[a : a + step] = np.sqrt((np.where(last, upto - before, 0.0) ** 2).sum(1))
    return np.where(out > 0, out, 1.0)


def kernel(a: np.ndarray, b: np.ndarray) -> float:
    """The normalised kernel of two strings; 0 where one has no triple."""
    return float(dots(a[None, :], triple_table(b))[0] / (norms(a[None, :])[0] * norms(b[None, :])[0]))
