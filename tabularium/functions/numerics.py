"""Numerical tools that run on the driver or inside grouped functions: integrals, roots, minima, interpolation and cosine transforms."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_coarse, _fine = np.polynomial.legendre.leggauss(10), np.polynomial.legendre.leggauss(21)


def integrate(f: Callable[[np.ndarray], np.ndarray], a: float, b: float, rtol: float = 1e-10, atol: float = 1e-14, pieces: int = 2000) -> tuple[float, float]:
    """Integral and error estimate of a vectorised function by halving the worst piece; infinite ends are mapped to finite ones."""
    if np.isinf(a) or np.isinf(b):
        inner = f
        lo, hi = (np.arctan(a) if np.isfinite(a) else np.sign(a) * np.pi / 2), (np.arctan(b) if np.isfinite(b) else np.sign(b) * np.pi / 2)
        return integrate(lambda t: inner(np.tan(t)) / np.cos(t) ** 2, lo, hi, rtol, atol, pieces)

    def piece(lo: float, hi: float) -> tuple[float, float, float, float]:
        mid, half = (lo + hi) / 2, (hi - lo) / 2
        values = [float((w * f(mid + half * x)).sum() * half) for x, w in (_coarse, _fine)]
        return (-abs(values[1] - values[0]), lo, hi, values[1])

    heap = [piece(a, b)]
    while len(heap) < pieces:
        total, error = sum(p[3] for p in heap), -sum(p[0] for p in heap)
        if error <= max(atol, rtol * abs(total)):
            break
        _, lo, hi, _ = heapq.heappop(heap)
        for x in (piece(lo, (lo + hi) / 2), piece((lo + hi) / 2, hi)):
            heapq.heappush(heap, x)
    return sum(p[3] for p in heap), -sum(p[0] for p in heap)


def find_root(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-12, rounds: int = 200) -> float:
    """A root between two ends of unlike sign: secant steps that fall back to bisection."""
    a, b, fa, fb = lo, hi, f(lo), f(hi)
    if fa * fb > 0:
        raise ValueError("the ends have the same sign")
    for _ in range(rounds):
        if fb == 0 or abs(b - a) <= tol * max(1.0, abs(b)):
            return b
        x = b - fb * (b - a) / (fb - fa)
        mid = (a + b) / 2
        if not min(mid, b) < x < max(mid, b):
            x = mid
        fx = f(x)
        if fx * fb <= 0:
            a, fa = b, fb
        else:
            fa = fa / 2 if a != b else fa
        b, fb = x, fx
        if fa * fb > 0:
            raise ArithmeticError("the root was lost")
    return b


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, tol: float = 1e-10, rounds: int = 5000) -> tuple[np.ndarray, float]:
    """A local minimum by a simplex of n + 1 points that is reflected, stretched and shrunk."""
    x0 = np.asarray(start, dtype=float)
    points = np.vstack([x0, x0 + np.diag(np.where(x0 != 0, step * np.abs(x0), step))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tol * (abs(values[0]) + tol) and np.ptp(points, axis=0).max() <= 1e-7 * (1 + np.abs(points[0]).max()):
            break
        centre = points[:-1].mean(axis=0)

        def at(t: float, centre=centre, worst=points[-1]) -> tuple[np.ndarray, float]:
            p = centre + t * (centre - worst)
            return p, f(p)

        p, v = at(1.0)
        if v < values[0]:
            q, w = at(2.0)
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            p, v = at(0.5 if v < values[-1] else -0.5)
            if v >= min(values[-1], v + 1 if v < values[-1] else values[-1]):
                points[1:] = points[0] + (points[1:] - points[0]) / 2
                values[1:] = [f(x) for x in points[1:]]
                continue
        points[-1], values[-1] = p, v
    return points[0], float(values[0])


def natural_spline(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The cubic spline with no curvature at its ends; NaN outside."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, h = len(x), np.diff(x)
    m = np.zeros(n)
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        m[1:-1] = np.linalg.solve(a, 6 * np.diff(np.diff(y) / h))

    def value(q: np.ndarray) -> np.ndarray:
        q = np.asarray(q, float)
        i = np.clip(np.searchsorted(x, q, side="right") - 1, 0, n - 2)
        l, r = x[i + 1] - q, q - x[i]
        out = (m[i] * l**3 + m[i + 1] * r**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * l + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * r
        return np.where((q >= x[0]) & (q <= x[-1]), out, np.nan)

    return value


def interpolate(c: Column, x: np.ndarray, y: np.ndarray, kind: str = "linear") -> Column:
    """A column's values on a tabulated curve; null outside the table."""
    if len(x) < 2 or (np.diff(x) <= 0).any():
        raise ValueError("a curve has two places at least, in rising order")
    curve = natural_spline(x, y) if kind == "cubic" else lambda q: np.interp(q, x, y, left=np.nan, right=np.nan)

    @F.pandas_udf("double")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(curve(b.to_numpy(float, na_value=np.nan)))

    return compute(c.cast("double"))


def dct2(x: np.ndarray) -> np.ndarray:
    """The cosine transform of type II, unnormalised, through a Fourier transform of the even extension."""
    n = len(x)
    f = np.fft.fft(np.concatenate([x, x[::-1]]))[:n]
    return np.real(f * np.exp(-1j * np.pi * np.arange(n) / (2 * n)))


def dct3(x: np.ndarray) -> np.ndarray:
    """The cosine transform of type III, unnormalised: dct3(dct2(x)) is 2 n x."""
    n = len(x)
    f = np.exp(1j * np.pi * np.arange(n) / (2 * n)) * x
    f[0] /= 2
    out = np.fft.ifft(f, 2 * n)[:n]
    return 4 * n * np.real(out)
