"""Singular values and right singular vectors of a small matrix by qd transforms.

Householder reflections make the matrix bidiagonal; the dqds transform finds the
squared singular values to high relative accuracy (it only adds, multiplies and
divides positive numbers, apart from its shifts); a twisted factorisation of
B'B - e for each of them gives its vector. Vectors of close values are made
orthogonal to each other. Matrices here have as many rows as a vector has
components, so all of this is bounded by the dimension.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_TINY = np.finfo(float).tiny
# Relative distance below which values count as close, and sweeps of dqds per value.
_CLOSE, _SWEEPS = 1e-3, 200


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of B, and V, with matrix = U B V' for some orthogonal U."""
    work, n = np.array(matrix, float), matrix.shape[1]
    right = np.eye(n)
    for k in range(n):
        _reflect(work, k, k)
        if k < n - 2:
            v = _reflect(work.T, k + 1, k)
            if v is not None:
                right[:, k + 1 :] -= 2.0 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _reflect(work: np.ndarray, at: int, column: int) -> np.ndarray | None:
    """Make all of a column below row `at` zero; the reflection's unit vector."""
    x = work[at:, column]
    size = np.abs(x).max(initial=0.0)
    if size == 0.0 or not np.abs(x[1:]).max(initial=0.0):
        return None
    v = x / size
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    v /= np.linalg.norm(v)
    work[at:, column:] -= 2.0 * np.outer(v, v @ work[at:, column:])
    work[at + 1 :, column] = 0.0
    return v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One transform with a shift, and its smallest d; None if the shift is above the smallest value."""
    d = q[0] - shift
    new_q, new_e, least = [], [], d
    for i in range(len(e)):
        if d < 0.0:
            return None
        total = d + e[i]
        if total == 0.0:
            # Both are zero: the value here is zero, and so is everything that hangs on it.
            new_q.append(0.0)
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / total
            new_q.append(total)
            new_e.append(e[i] * ratio)
            d = d * ratio - shift
        least = min(least, d)
    if d < 0.0:
        return None
    new_q.append(d)
    return new_q, new_e, least


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, in falling order."""
    q, e = (a * a).tolist(), (b * b).tolist()
    found: list[float] = []
    scale = max([*q, *e, 0.0])
    if scale == 0.0:
        return np.zeros(len(q))
    q, e = [x / scale for x in q], [x / scale for x in e]
    # Blocks between zero off-diagonals are solved one by one.
    blocks, start = [], 0
    for i in range(len(e) + 1):
        if i == len(e) or e[i] == 0.0:
            blocks.append((q[start : i + 1], e[start:i], 0.0))
            start = i + 1
    while blocks:
        q, e, shifted = blocks.pop()
        least, stay = min(q), 0
        while len(q) > 1:
            # Off-diagonals too small to change a value by a rounding are dropped.
            at = next((i for i in reversed(range(len(e))) if e[i] <= (_EPS**2) * (shifted + q[i + 1])
                       or (shifted > 0.0 and e[i] <= _EPS * 0.01 * min(q[i], q[i + 1]) * _EPS)), None)
            if at == len(e) - 1:
                found.append(q.pop() + shifted)
                e.pop()
                least, stay = min(q), 0
                continue
            if at is not None:
                blocks.append((q[: at + 1], e[:at], shifted))
                q, e = q[at + 1 :], e[at + 1 :]
                least, stay = min(q), 0
                continue
            stay += 1
            # The smallest d is close below its end to the smallest value; failed shifts shrink to none.
            shift, out = least * (1.0 - 1e-3 / stay) if stay > 2 else 0.0, None
            for _ in range(6):
                out = _dqds(q, e, shift)
                if out is not None:
                    break
                shift *= 0.5
            if out is None:
                shift, out = 0.0, _dqds(q, e, 0.0)
            q, e, least = out
            shifted += shift
            least = max(least, 0.0)
            if stay > _SWEEPS * 50:
                raise ArithmeticError("the qd transform does not converge")
        found.append(q[0] + shifted)
    return np.sort(np.array(found))[::-1] * scale


def _twisted(a2: np.ndarray, ab: np.ndarray, b2: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """A unit vector z with (B'B - value) z nearly zero, or one step of inverse iteration from `start`.

    Stationary transform from the top, progressive from the bottom; where they meet
    with the smallest remainder is the twist.
    """
    n = len(a2)
    diag = a2 + np.concatenate([[0.0], b2]) - value
    floor = max(_EPS * max(a2.max(), np.abs(ab).max(initial=0.0)), _TINY)
    down, up = diag.copy(), diag.copy()
    for i in range(n - 1):
        if abs(down[i]) < floor:
            down[i] = np.copysign(floor, down[i])
        down[i + 1] -= ab[i] * ab[i] / down[i]
    for i in range(n - 1, 0, -1):
        if abs(up[i]) < floor:
            up[i] = np.copysign(floor, up[i])
        up[i - 1] -= ab[i - 1] * ab[i - 1] / up[i]
    twist = int(np.argmin(np.abs(down + up - diag)))
    z = np.zeros(n)
    if start is None:
        z[twist] = 1.0
    else:
        # The same factors solve for another right side.
        top, bottom = start.copy(), start.copy()
        for i in range(twist):
            top[i + 1] -= ab[i] / down[i] * top[i]
        for i in range(n - 1, twist, -1):
            bottom[i - 1] -= ab[i - 1] / up[i] * bottom[i]
        gamma = down[twist] + up[twist] - diag[twist]
        z[twist] = (top[twist] + bottom[twist] - start[twist]) / (gamma if abs(gamma) > floor else np.copysign(floor, gamma))
    for i in range(twist - 1, -1, -1):
        z[i] = ((top[i] if start is not None else 0.0) - ab[i] * z[i + 1]) / down[i]
    for i in range(twist + 1, n):
        z[i] = ((bottom[i] if start is not None else 0.0) - ab[i - 1] * z[i - 1]) / up[i]
    return z / np.linalg.norm(z)


def vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal matrix, as columns, for its first squared values."""
    n = len(a)
    a2, b2, ab = a * a, b * b, a[:-1] * b
    out = np.zeros((n, len(values)))
    rng = np.random.default_rng(11)
    top = values[0] if len(values) else 0.0
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > _CLOSE * top:
            first = k
        z = _twisted(a2, ab, b2, value)
        for _ in range(4):
            own = out[:, first:k]
            rest = z - own @ (own.T @ z)
            size = np.linalg.norm(rest)
            if size > 0.7:
                z = rest / size
                break
            # The same vector again: look in the space the others leave.
            start = rng.standard_normal(n)
            start -= own @ (own.T @ start)
            z = _twisted(a2, ab, b2, value, start / np.linalg.norm(start))
            rest = z - own @ (own.T @ z)
            z = rest / max(np.linalg.norm(rest), _TINY)
        z = z - out[:, :k] @ (out[:, :k].T @ z)
        out[:, k] = z / np.linalg.norm(z)
    return out


def right_vectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a matrix in falling order, and the first `count` right vectors as columns."""
    a, b, right = bidiagonal(matrix)
    values = squared_values(a, b)
    return values, right @ vectors(a, b, values[:count])
