"""Whitening of embeddings along the leading eigenvectors of their covariance.

The covariance is over the distinct integer vectors and exact: tasks add up integers. Its eigenpairs, a problem of the
size of one vector, are solved on the driver by spectrum slicing.
"""

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import plus, without
from wattsift.llm.spectrum import leading
from wattsift.llm.vectors import LONG, largest, matrix, one_size, scaled, usable
from wattsift.session import written

RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
ROWS, LIMB = 4096, 64


def _products(x: np.ndarray) -> np.ndarray:
    """x' x of integers, exact."""
    most = largest(x) ** 2 * len(x)
    if most < 1 << 53:  # doubles hold every sum on the way
        return (x.T.astype(float) @ x.astype(float)).astype(np.int64).astype(object)
    return x.T @ x if most <= LONG.max else x.T.astype(object) @ x.astype(object)


def _moments(fit: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products over a table of integer vectors ``x``, as integers of any length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            rows = matrix(batch.column(0), size)
            for k in range(0, len(rows), ROWS):
                x = rows[k : k + ROWS]
                n += len(x)
                sums += x.sum(axis=0).astype(object) if largest(x) * len(x) <= LONG.max else x.astype(object).sum(axis=0)
                products += _products(x)
        if n:
            at = [(-1, -1), *((i, -1) for i in range(size)), *((i, j) for i in range(size) for j in range(i, size))]
            values = [n, *sums, *(products[i, j] for i, j in at[1 + size :])]
            low = [v & (1 << LIMB) - 1 for v in values]  # in two parts: products of longs have up to 38 digits
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in at], pa.int32()),
                    pa.array([j for _, j in at], pa.int32()),
                    pa.array([v >> LIMB for v in values], pa.decimal128(30)),
                    pa.array(low, pa.decimal128(30)),
                ],
                names=["i", "j", "high", "low"],
            )

    parts = fit.select("x").mapInArrow(partial, "i int, j int, high decimal(30,0), low decimal(30,0)")
    n, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
    for i, j, high, low in parts.groupBy("i", "j").agg(F.sum("high"), F.sum("low")).collect():  # at most (size + 2)^2 / 2 rows
        value = (int(high) << LIMB) + int(low)
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            products[i, j] = products[j, i] = value
    return n, sums, products


def _wide(numerator: int, denominator: int) -> np.longdouble:
    """numerator / denominator to extended precision."""
    quotient, rest = divmod(numerator << 80, denominator)
    high = quotient >> 64
    return np.ldexp(np.ldexp(np.longdouble(high), 64) + np.longdouble(quotient - (high << 64)), -80)


class _Law:
    """What whitening does: plain numbers, one law for all rows."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, components: int):
        self.n, self.sums = n, [int(s) for s in sums]
        self.mean = np.array([float(s / n) for s in self.sums])
        centred = n * products - np.outer(sums, sums)  # n^2 times the covariance, exact
        trace = sum(centred[i, i] for i in range(len(sums)))
        most = max((abs(v) for v in centred.ravel()), default=0)
        pairs = []
        if most:
            unit = np.array([_wide(int(v), int(most)) for v in centred.ravel()], np.longdouble).reshape(centred.shape)
            pairs = leading(unit, components)
        least = 64 * len(sums) * np.finfo(float).eps
        flat = min(components, len(sums)) - len(pairs)
        self.explained = [e * float(most / trace) for e, _ in pairs] + [None] * flat
        scale = float(most / n**2) if most else 0.0
        self.spread = [(e * scale) ** 0.5 if e > least else None for e, _ in pairs] + [None] * flat
        self.vectors = np.array([v for _, v in pairs] + [np.zeros(len(sums))] * flat).reshape(-1, len(sums))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN along components without spread."""
        spread = np.array([np.nan if s is None else s for s in self.spread])
        return ((x - self.mean) @ self.vectors.T) / spread

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None beyond the range of a long."""
        span = self.n * largest(x) + max(map(abs, self.sums), default=0)
        if span * span * max(1, x.shape[1]) <= LONG.max:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) if v <= LONG.max else None for v in (off * off).sum(axis=1)]


def _identity_error(fit: DataFrame, law: dict, size: int) -> float | None:
    """Largest entry of the covariance of the whitened fit list less the identity, over components with spread."""
    kept = [k for k, s in enumerate(law["spread"]) if s is not None]
    if not kept:
        return None
    names = [f"w{k}" for k in kept]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _law(law)
        for batch in batches:
            w = own.whitened(matrix(batch.column(0), size))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, k])) for k in kept], names=names)

    w = fit.select("x").mapInArrow(project, ", ".join(f"{name} double" for name in names))
    pairs = list(combinations_with_replacement(names, 2))
    row = w.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()  # centred as it is summed
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs))


def _law(plain: dict) -> _Law:
    law = object.__new__(_Law)
    law.__dict__.update(plain)
    return law


def whiten(df: DataFrame, vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """Rows with a usable vector, once for each of the leading components: ``RESULTS`` are added.

    Entries c become integers x = floor(scale * c). The fit list is every distinct x once: n vectors with sums S. Its
    covariance V (divisor n) has unit eigenvectors, numbered by falling eigenvalue e. deviation is the sum of
    (n x - S)^2, exact (NULL beyond the range of a long); whitened is (x - S / n) along the component over sqrt(e),
    explained is e / trace(V), identity_error the largest entry of whitened's covariance over the fit list less the
    identity, from one pass over that list.

    Copies meet in one shuffle of vectors that folds them before it sends them. Sums of products are made by tasks and
    added up by entry; the driver gets one row for each entry of V.

    Rows with a NULL vector or NULL or non-finite entries are dropped; repeated rows are answered each. Vectors of fewer
    entries than ``components`` have that many components. Along a component without spread (one distinct vector,
    linearly dependent entries) whitened is NULL, and with no spread at all explained and identity_error are NULL. A
    table without usable vectors gives no rows. Vectors of differing sizes are refused. Columns of these names, and of
    the name x, are replaced.
    """
    base = without(df, *RESULTS, "x").where(usable(vector)).withColumn("x", scaled(vector, scale))
    fit = written(base.select("x").distinct(), "distinct-vectors")
    size = one_size(fit, "x")
    kinds = "deviation bigint, along array<struct<component:int,whitened:double>>"
    if not size:
        return base.limit(0).selectExpr("*", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").drop("x")
    law = vars(_Law(*_moments(fit, size), components))
    error = _identity_error(fit, law, size)
    schema = plus(base.drop("x"), kinds)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _law(law)
        for batch in batches:
            x = matrix(batch.column(batch.schema.names.index("x")), size)
            w = own.whitened(x)
            count = w.shape[1]
            struct = pa.StructArray.from_arrays(
                [pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(w.ravel(), mask=np.isnan(w.ravel()))],
                names=["component", "whitened"],
            )
            along = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * count + 1, count, dtype=np.int32)), struct)
            rest = batch.drop_columns(["x"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(own.deviations(x), pa.int64()), along], names=schema.names)

    out = base.mapInArrow(project, schema)
    shares = F.array(*[F.lit(v).cast("double") for v in law["explained"]])
    return (
        out.select("*", F.inline("along"))
        .drop("along")
        .withColumn("n", F.lit(law["n"]).cast("bigint"))
        .withColumn("explained", F.element_at(shares, F.col("component")))
        .withColumn("identity_error", F.lit(error).cast("double"))
    )
