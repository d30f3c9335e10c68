"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs of the pivots of L D L' = A - s I count the eigenvalues above s. Halving by such counts encloses each wanted
eigenvalue alone, Rayleigh quotient iteration then converges to it cubically, and two more counts certify its number.
"""

import numpy as np

#: Pivots of two are taken where the diagonal is below this part of the column's largest entry.
BUNCH_KAUFMAN = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` lie above ``shift``: the positive pivots of a symmetric elimination."""
    m = a - shift * np.eye(len(a))
    positive = 0
    while len(m):
        column = np.abs(m[:, 0])
        column[0] = 0
        r = int(column.argmax())
        most = column[r]
        if most == 0:  # nothing to eliminate
            positive += m[0, 0] > 0
            m = m[1:, 1:]
            continue
        side = np.abs(m[:, r])
        side[r] = 0
        if abs(m[0, 0]) * side.max() >= BUNCH_KAUFMAN * most * most:
            size = 1
        elif abs(m[r, r]) >= BUNCH_KAUFMAN * side.max():
            size = 1
            m[[0, r]] = m[[r, 0]]
            m[:, [0, r]] = m[:, [r, 0]]
        else:
            size = 2
            m[[1, r]] = m[[r, 1]]
            m[:, [1, r]] = m[:, [r, 1]]
        pivot, below = m[:size, :size], m[size:, :size]
        if size == 1:
            positive += pivot[0, 0] > 0
        else:  # of one sign if the determinant is positive
            det = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] * pivot[1, 0]
            positive += 1 if det < 0 else 2 * (pivot[0, 0] > 0)
        m = m[size:, size:] - below @ np.linalg.solve(pivot, below.T)
        m = (m + m.T) / 2
    return int(positive)


def _solved(a: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(a - shift I)^-1 right, the shift moved by a rounding error where that is singular."""
    step = np.finfo(float).eps * max(1.0, float(np.abs(a).max()))
    while True:
        try:
            found = np.linalg.solve(a - shift * np.eye(len(a)), right)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        shift, step = shift + step, 2 * step


def _free(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in others:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _refined(exact: np.ndarray, v: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Newton steps on (A v = e v, |v| = 1) with residuals in extended precision: v to the last bits of a double."""
    d = len(v)
    wide, e = v.astype(np.longdouble), np.longdouble(value)
    for _ in range(3):
        wide = wide / np.sqrt(wide @ wide)
        e = wide @ (exact @ wide)
        system = np.zeros((d + 1, d + 1))
        system[:d, :d] = exact.astype(float) - float(e) * np.eye(d)
        system[:d, d] = system[d, :d] = wide.astype(float)
        residual = np.append((exact @ wide - e * wide).astype(float), 0.0)
        step = np.linalg.lstsq(system, -residual, rcond=None)[0][:d]
        if np.linalg.norm(step) > 1e-6:  # not alone: the vector is one of many of its space
            break
        wide = wide + step
    wide = wide / np.sqrt(wide @ wide)
    return wide.astype(float), float(wide @ (exact @ wide))


def leading(exact: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest eigenvalues of a symmetric matrix (extended precision, entries at most about 1) with unit
    vectors, falling. Where several eigenvalues agree to rounding, their vectors are an orthonormal basis of their
    space. Raises ArithmeticError where the counts do not confirm a number."""
    a = exact.astype(float)
    d = len(a)
    bound = float(np.abs(a).sum(axis=1).max()) or 1.0  # no eigenvalue lies outside of +-bound
    close = 64 * d * np.finfo(float).eps * bound
    found: list[tuple[float, np.ndarray]] = []
    for number in range(1, min(count, d) + 1):
        low, high, above_low, above_high = -bound - close, bound + close, d, 0
        start = np.random.default_rng(number).normal(size=d)  # its own, so that those found before do not hold it
        while True:
            middle = (low + high) / 2
            above = count_above(a, middle)
            if above >= number:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
            alone = above_low == number and above_high == number - 1
            if high - low <= close:
                break
            if alone and high - low <= 0.05 * bound:
                pair = _rayleigh(a, (low + high) / 2, start, [], low, high)
                if pair:
                    break
        near = [u for e, u in found if abs(e - (low + high) / 2) <= 4 * close]
        if high - low <= close:
            v = _free(start, near)
            for _ in range(6):
                v = _free(_solved(a, (low + high) / 2, v), near)
            pair = float(v @ a @ v), v
        else:
            value, v = pair
            pair = _refined(exact, v, value)[::-1]
        if count_above(a, pair[0] - 2 * close) < number or count_above(a, pair[0] + 2 * close) >= number:
            raise ArithmeticError(f"eigenvalue {number} could not be certified")
        found.append(pair)
    return found


def _rayleigh(a, shift: float, start: np.ndarray, others: list, low: float, high: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration into (low, high]; None where it leaves that interval."""
    v = _free(start, others)
    for _ in range(2):  # inverse iteration turns to the enclosed eigenvalue first
        v = _free(_solved(a, shift, v), others)
    value = shift
    for _ in range(12):
        before, value = value, float(v @ a @ v)
        if not low < value <= high:
            return None
        if abs(value - before) <= 4 * np.finfo(float).eps * np.abs(a).max():
            return value, v
        v = _free(_solved(a, value, v), others)
    return None
