"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST), counted by inertia.

The spectrum is sliced from above into intervals that hold few eigenvalues, whose numbers are known beforehand from
the signs of the pivots of a symmetric factorisation. For each interval a quadrature over a circle through its ends
sums solutions of complex shifted systems, which projects a block of vectors onto the eigenvectors inside; a
Rayleigh-Ritz step extracts them, and the block goes round again until they are exact and as many as were counted.
"""

from __future__ import annotations

import numpy as np

NODES = 8
PER_INTERVAL = 8
ROUNDS = 20
EPS = np.finfo(float).eps
#: Bunch and Parlett's bound between pivots of one and of two rows.
PIVOT_RATIO = (1 + 17 ** 0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than ``shift``: the positive part of the inertia of ``matrix - shift``."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        one = int(diagonal.argmax())
        off = size - np.diag(diagonal)
        row, column = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[one] == 0 and off[row, column] == 0:
            break
        pivots = [one] if diagonal[one] >= PIVOT_RATIO * off[row, column] else [int(row), int(column)]
        # A pivot of two rows is indefinite by the choice of the bound: one sign each.
        above += int(a[one, one] > 0) if len(pivots) == 1 else 1
        rest = np.delete(np.arange(len(a)), pivots)
        cross = a[np.ix_(rest, pivots)]
        a = a[np.ix_(rest, rest)] - cross @ np.linalg.solve(a[np.ix_(pivots, pivots)], cross.T)
        a = (a + a.T) / 2
    return above


def _cut(matrix: np.ndarray, low: float, high: float) -> float:
    """A point near the middle of an interval that no eigenvalue is close to, if there is one."""
    width = high - low
    for part in (0.5, 0.46, 0.54, 0.42, 0.58, 0.38, 0.62, 0.34, 0.66):
        at = low + part * width
        if count_above(matrix, at - width / 200) == count_above(matrix, at + width / 200):
            return at
    return low + width / 2


def slices(matrix: np.ndarray, wanted: int, floor: float, top: float) -> list[tuple[float, float, int]]:
    """Intervals from the top down, with their counts, that hold the ``wanted`` largest eigenvalues over ``floor``."""
    found, held = [], 0
    pending = [(floor, top, 0, count_above(matrix, floor))]
    while pending and held < wanted:
        low, high, over, upto = pending.pop()
        if upto == over:
            continue
        if upto - over <= PER_INTERVAL or high - low <= 1e-10 * top:
            found.append((low, high, upto - over))
            held += upto - over
            continue
        cut = _cut(matrix, low, high)
        middle = count_above(matrix, cut)
        pending += [(low, cut, middle, upto), (cut, high, over, middle)]
    return found


def inside(matrix: np.ndarray, low: float, high: float, count: int, scale: float) -> np.ndarray:
    """Orthonormal eigenvectors, as columns, of the ``count`` eigenvalues between ``low`` and ``high``."""
    dims = len(matrix)
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (1 - points))
    block = min(dims, 2 * count + 2)
    rng = np.random.default_rng(11)
    while True:
        y, best = rng.normal(size=(dims, block)), np.inf
        for _ in range(ROUNDS):
            if block < dims:
                y = sum((w / 2 * radius * turn * np.linalg.solve(
                    (centre + radius * turn) * np.eye(dims) - matrix, y.astype(complex))).real
                    for turn, w in zip(turns, weights, strict=True))
            basis, _ = np.linalg.qr(y)
            values, ritz = np.linalg.eigh(basis.T @ matrix @ basis)
            y = basis @ ritz
            own = (values > low) & (values <= high)
            error = np.linalg.norm(matrix @ y[:, own] - y[:, own] * values[own], axis=0).max(initial=0.0)
            exact = error <= 4 * EPS * scale * dims ** 0.5 or (error <= 1e-11 * scale and error >= best / 2)
            if own.sum() == count and exact:
                return y[:, own]
            best = min(best, error) if own.sum() == count else np.inf
        if block == dims:
            raise ArithmeticError(f"{int(own.sum())} of {count} eigenvalues found in {low} to {high}")
        block = min(dims, 2 * block)


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues that rounding cannot tell from zero are left out, so fewer may come back. The largest entry of a vector
    in magnitude is positive (the first of equal ones).
    """
    dims = len(matrix)
    top = np.abs(matrix).sum(axis=1).max(initial=0.0) * (1 + 1e-9)
    if top == 0:
        return np.zeros(0), np.zeros((dims, 0))
    intervals = slices(matrix, wanted, 4 * dims * EPS * top, top)
    if not intervals:
        return np.zeros(0), np.zeros((dims, 0))
    basis, _ = np.linalg.qr(np.hstack([inside(matrix, *interval, top) for interval in intervals]))
    values, ritz = np.linalg.eigh(basis.T @ matrix @ basis)
    if len(values) != count_above(matrix, intervals[-1][0]):
        raise ArithmeticError("the inertia counts more eigenvalues than were found")
    values, vectors = values[::-1][:wanted], (basis @ ritz)[:, ::-1][:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs
