"""Eigendecompositions of scatter matrices, kept up to date by rank-one updates.

The state of some vectors is their number, mean, and the eigenvalues and eigenvectors of their centred
scatter. A new vector, and the difference of two means, change the scatter by a matrix of rank one; the new
eigenvalues are the roots of the secular equation between the old ones, the new eigenvectors follow from
the roots. Parts that the update leaves alone (deflation) are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps
#: Most steps of the root finder; it ends as soon as all roots stand.
STEPS = 60


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - x)) = 0`` for rising, different ``d`` and positive ``z2``: for
    each the pole it is measured from, and how far it lies from it, so that its distance to every pole is
    known to full precision.

    Between two poles the sum falls into the part of the poles below and that of the poles above; each is
    replaced by a constant and one pole that agree with it in value and slope, and the root of that is the
    next guess. A guess outside of what the signs have enclosed is replaced by the middle.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = right - d
    last = np.arange(k) == k - 1
    below = np.tri(k).T  # 1 for the poles up to the root's own
    with np.errstate(all="ignore"):
        term = z2[:, None] / (d[:, None] - (d + gap / 2))
        middle = 1 / rho + term.sum(0)
        from_right = (middle < 0) & ~last
        origin = np.where(from_right, right, d)
        delta = d[:, None] - origin
        own, after = np.where(from_right, -gap, 0.0), np.where(from_right, 0.0, gap)
        upper = middle < 0
        lo = np.where(upper, np.where(from_right, -gap / 2, gap / 2), 0.0)
        hi = np.where(upper, np.where(from_right, 0.0, gap), gap / 2)
        # first guess: the poles around the root as they are, the others as at the middle
        w, v = z2, np.where(last, 0.0, np.append(z2[1:], 0.0))
        c = middle + (w - v) / (gap / 2)
        t = _between(c, own, after, w, v, last)
        t = np.where((t > lo) & (t < hi), t, (lo + hi) / 2)
        for _ in range(STEPS):
            far = delta - t
            np.divide(z2[:, None], far, out=term)
            low, every = np.einsum("ij,ij->j", term, below), term.sum(0)
            np.divide(term, far, out=far)
            low_slope, slope = np.einsum("ij,ij->j", far, below), far.sum(0)
            high = every - low
            f = 1 / rho + every
            done = np.abs(f) <= 4 * EPS * (1 / rho + np.abs(low) + np.abs(high))
            less = f < 0
            lo, hi = np.where(less, t, lo), np.where(less, hi, t)
            done |= hi - lo <= 2 * EPS * np.minimum(np.abs(lo), np.abs(hi))
            if done.all():
                break
            a, b = own - t, after - t
            w, v = low_slope * a * a, np.where(last, 0.0, (slope - low_slope) * b * b)
            new = t + _between(f - w / a - np.where(last, 0.0, v / b), a, b, w, v, last)
            t = np.where(done, t, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return origin, t


def _between(c: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, v: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The root of ``c + w / (a - x) + v / (b - x)`` between ``a`` and ``b``; without the second pole for
    the last."""
    p = c * (a + b) + w + v
    q = c * a * b + w * b + v * a
    root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
    return np.where(last, a + w / c, np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root)))


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) of ``vectors diag(values) vectors' + rho v v'``,
    ``rho`` not negative."""
    z = vectors.T @ v
    square = float(z @ z)
    if not rho * square > 0:
        return values, vectors
    z, rho = z / np.sqrt(square), rho * square
    little = 8 * EPS * max(abs(values[0]), abs(values[-1]), rho)
    # equal eigenvalues: their space is turned so that one of its vectors takes the whole update
    ends = np.append(np.flatnonzero(np.diff(values) > little) + 1, len(values))
    if len(ends) < len(values):
        vectors, z, start = vectors.copy(), z.copy(), 0
        for end in ends.tolist():
            if end - start > 1:
                w = z[start:end].copy()
                norm = np.sqrt(w @ w)
                if norm > 0:
                    w[-1] += np.copysign(norm, w[-1])
                    w /= np.sqrt(w @ w)
                    vectors[:, start:end] -= np.outer(vectors[:, start:end] @ w, 2 * w)
                    z[start:end] = vectors[:, start:end].T @ (v / np.sqrt(square))
                    z[start : end - 1] = 0
            start = end
    live = rho * np.abs(z) > little
    if not live.any():
        return values, vectors
    d, zl = values[live], z[live]
    origin, t = secular_roots(d, zl * zl, rho)
    far = (d[:, None] - origin) - t  # pole less root
    # the update that has exactly these roots: its eigenvectors are orthogonal however near the roots lie
    k = len(d)
    apart = d[:, None] - d
    ratio = np.ones((k, k))
    np.divide(far, apart, out=ratio, where=apart != 0)
    with np.errstate(all="ignore"):
        zl = np.copysign(np.sqrt(np.abs(-np.diagonal(far) * ratio.prod(1) / rho)), zl)
        made = zl[:, None] / far
        made /= np.sqrt((made * made).sum(0))
    values, vectors = values.copy(), vectors.copy()
    values[live] = origin + t
    vectors[:, live] = vectors[:, live] @ made
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """What is known of some vectors: their number, their mean, and their centred scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray, copies: int = 1) -> None:
        """A vector, so many times: a centred update of rank one."""
        off = x - self.mean
        total = self.n + copies
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / total * copies)
        self.mean, self.n = self.mean + off * (copies / total), total

    def join(self, other: Spectrum) -> None:
        """The vectors of another: each of its eigenpairs is an update, and so is the difference of the
        means."""
        if not other.n:
            return
        off, total = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / total * other.n)
        self.mean, self.n = self.mean + off * (other.n / total), total
