"""Edit distance up to a small limit, linear in the text length.

The built-in ``levenshtein`` fills a table over both texts even with a threshold, which takes seconds
for one pair of long texts; this one only follows the diagonals a few edits can reach.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _shared(a: str, b: str, i: int, j: int) -> int:
    """Length of the common run starting at a[i] and b[j]."""
    if i == len(a) or j == len(b) or a[i] != b[j]:
        return 0
    start, size = i, 32
    while a[i : i + size] == b[j : j + size] and i < len(a) and j < len(b):
        step = min(size, len(a) - i, len(b) - j)
        i, j, size = i + step, j + step, size * 2
    while size:
        if i + size <= len(a) and a[i : i + size] == b[j : j + size]:
            i, j = i + size, j + size
        size //= 2
    return i - start


def edits_within(a: str, b: str, limit: int) -> int:
    """Edit distance of a and b, or -1 when it is above ``limit``.

    Only the diagonals from which the edits left can reach the last one are followed.
    """
    goal = len(b) - len(a)
    if abs(goal) > limit:
        return -1
    reached = {0: _shared(a, b, 0, 0)}
    for edits in range(limit + 1):
        if reached.get(goal, -1) >= len(a):
            return edits
        further = {}
        spare = limit - edits - 1
        for k in range(max(-edits - 1, goal - spare), min(edits + 1, goal + spare) + 1):
            i = max(reached.get(k - 1, -1), reached.get(k, -2) + 1, reached.get(k + 1, -2) + 1)
            i = min(i, len(a), len(b) - k)
            if i >= 0 and i + k >= 0:
                further[k] = i + _shared(a, b, i, i + k)
        reached = further
    return -1


def edit_distance(limit: int) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("bigint")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits_within(x, y, limit) for x, y in zip(a, b, strict=True)], dtype="int64")

    return distance
