"""Eigenpairs of a symmetric matrix in an interval by contour integration, with counts of eigenvalues by inertia."""

from __future__ import annotations

import numpy as np


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above the shift: the positive ones among the pivots of a symmetric factorization of matrix - shift (Sylvester's law of inertia), with pivots of one or two rows chosen from all that is left."""
    m, found = matrix - shift * np.eye(len(matrix)), 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        i = int(diagonal.argmax())
        off = np.abs(np.tril(m, -1))
        j, k = np.unravel_index(off.argmax(), off.shape)
        if diagonal[i] >= 0.64 * off[j, k]:
            if m[i, i] == 0:
                break
            pivots, found = [i], found + int(m[i, i] > 0)
        else:
            pivots, found = [int(j), int(k)], found + 1  # such a pair has one eigenvalue on either side
        rest = np.setdiff1d(np.arange(len(m)), pivots)
        side = m[np.ix_(rest, pivots)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(pivots, pivots)], side.T)
        m = (m + m.T) / 2
    return found


def slices(matrix: np.ndarray, wanted: int, most: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, count): neighbouring intervals from the top down that hold the wanted largest eigenvalues, each about `most` at a time.

    Bounds are bisected until their inertia counts are right; eigenvalues that are equal to rounding stay in one interval, so an interval (and the
    whole) can hold more than was asked for. Eigenvalues within rounding of zero are left out.
    """
    size = float(np.abs(matrix).sum(axis=1).max())
    floor, top = size * len(matrix) * 1e-15, size * (1 + 1e-9)
    total, done, high, out = above(matrix, floor), 0, top, []
    while done < min(wanted, total):
        goal = min(done + most, wanted, total)
        low, low_count, up, up_count = floor, total, high, done
        while low_count > goal and up - low > 1e-13 * size:
            middle = (low + up) / 2
            n = above(matrix, middle)
            if n >= goal:
                low, low_count = middle, n
            else:
                up, up_count = middle, n
        out.append((low, high, low_count - done))
        done, high = low_count, low
    return out


def interval(matrix: np.ndarray, low: float, high: float, count: int, nodes: int = 8, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the `count` eigenpairs in (low, high).

    A block of vectors goes through the resolvent (z - matrix)^-1, summed over Gauss points of a half circle around the interval (the other half is its
    conjugate), which damps all eigenvectors outside. Rayleigh-Ritz on the block gives pairs; rounds go on until residuals are at rounding and as many
    pairs as counted are inside. The block is enlarged when it doesn't get there.
    """
    d, size = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    points, shares = np.polynomial.legendre.leggauss(nodes)
    angles, radius, centre = np.pi / 2 * (1 + points), (high - low) / 2, (high + low) / 2
    turn = radius * np.exp(1j * angles)
    factors = [np.linalg.inv((centre + z) * np.eye(d) - matrix) for z in turn]
    columns = min(d, 2 * count + 4)
    while True:
        block = np.random.default_rng(7).standard_normal((d, columns))
        for _ in range(rounds):
            block = sum(share / 2 * (z * (f @ block)).real for share, z, f in zip(shares, turn, factors, strict=True))
            block, _ = np.linalg.qr(block)
            values, turned = np.linalg.eigh(block.T @ matrix @ block)
            block = block @ turned
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if inside.sum() == count and (residual <= 1e-14 * size * np.sqrt(d)).all():
                return values[inside], block[:, inside]
        if columns == d:
            raise ArithmeticError(f"found {int(inside.sum())} of {count} eigenvalues in ({low}, {high})")
        columns = min(d, 2 * columns)
