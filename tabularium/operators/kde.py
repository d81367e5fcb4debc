"""Kernel density estimates; the bandwidth is the kernel's standard deviation whatever the kernel."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numerics import dct2
from .stats import bin_linear, percentiles, population

#: Cells of the improved Sheather-Jones rule, and the order of the derivative that its chain of estimates starts from.
CELLS, ORDER = 16384, 7

#: Reach of each kernel in bandwidths.
REACH = {"gaussian": 5.0, "epanechnikov": math.sqrt(5), "bspline": 2 * math.sqrt(3), "box": math.sqrt(3)}


def kernel(name: str, u: np.ndarray) -> np.ndarray:
    """Value at u bandwidths from the centre: unit area and unit variance; the Gaussian is cut at its reach and renormalised."""
    a, r = np.abs(u), REACH[name]
    if name == "gaussian":
        out = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi) / math.erf(r / math.sqrt(2))
    elif name == "epanechnikov":
        out = 3 / (4 * r) * (1 - (a / r) ** 2)
    elif name == "box":
        out = np.full_like(a, 1 / (2 * r))
    else:  # the cubic B-spline, whose variance is a third of its spacing's square
        s = a / math.sqrt(3)
        out = np.where(s < 1, (4 - 6 * s**2 + 3 * s**3) / 6, np.maximum(2 - s, 0) ** 3 / 6) / math.sqrt(3)
    return np.where(a <= r, out, 0.0)


def _column(name: str, u: Column) -> Column:
    a, r = F.abs(u), REACH[name]
    if name == "gaussian":
        out = F.exp(-0.5 * a * a) / (math.sqrt(2 * math.pi) * math.erf(r / math.sqrt(2)))
    elif name == "epanechnikov":
        out = F.lit(3 / (4 * r)) * (1 - a * a / 5)
    elif name == "box":
        out = F.lit(1 / (2 * r))
    else:
        s = a / math.sqrt(3)
        t = F.greatest(2 - s, F.lit(0.0))
        out = F.when(s < 1, (4 - 6 * s * s + 3 * s * s * s) / 6).otherwise(t * t * t / 6) / math.sqrt(3)
    return F.when(a <= r, out).otherwise(0.0)


def _within(p: DataFrame, lower: float | None, upper: float | None) -> DataFrame:
    for bad, text in ((lower is not None and not math.isfinite(lower), "lower"), (upper is not None and not math.isfinite(upper), "upper")):
        if bad:
            raise ValueError(f"{text} is not finite")
    if lower is not None and upper is not None and lower >= upper:
        raise ValueError("lower has to be less than upper")
    if lower is not None:
        p = p.where(F.col("x") >= float(lower))
    return p if upper is None else p.where(F.col("x") <= float(upper))


def sheather_jones(counts: np.ndarray, n: float) -> float | None:
    """The bandwidth, as a part of the cells' whole range, at the fixed point of the improved Sheather-Jones rule; None without one.

    ``n`` is the effective number of values. The squared norm of each derivative's estimate gives the time that the one below is smoothed by.
    """
    k2 = np.arange(1, len(counts), dtype=np.float64) ** 2
    a2 = (dct2(counts / counts.sum())[1:] / 2) ** 2

    def norm(s: int, t: float) -> float:
        return 2 * math.pi ** (2 * s) * float(np.sum(k2**s * a2 * np.exp(-k2 * math.pi**2 * t)))

    def excess(t: float) -> float:
        f = norm(ORDER, t)
        for s in range(ORDER - 1, 1, -1):
            odd = math.prod(range(1, 2 * s, 2)) / math.sqrt(2 * math.pi)
            f = norm(s, (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / (n * f)) ** (2 / (3 + 2 * s))) if f > 0 else 0
        return t - (2 * n * math.sqrt(math.pi) * f) ** -0.4 if f > 0 else math.nan

    # the least root of a cell's width or more: the first change of sign on a rising ladder of times, then halved down
    ladder = np.geomspace(1 / len(counts) ** 2, 0.1, 200)
    below = None
    for t in ladder.tolist():
        e = excess(t)
        if e == 0:
            return math.sqrt(t)
        if e > 0:
            if below is None:
                return None
            for _ in range(80):
                middle = (below + t) / 2
                below, t = (middle, t) if excess(middle) < 0 else (below, middle)
            return math.sqrt((below + t) / 2)
        if e < 0:
            below = t
    return None


def _resolved(p: DataFrame, h: float) -> bool:
    """Whether two distinct values are less than h apart; h is a cell or more, so few rows reach the driver."""
    cells = sorted(p.groupBy(F.floor(F.col("x") / h).alias("c")).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect(), key=lambda r: r["c"])
    return any(r["lo"] < r["hi"] for r in cells) or any(b["lo"] - a["hi"] < h for a, b in zip(cells, cells[1:]))


def bandwidth(df: DataFrame, name: str, rule: str | None = "silverman", weight: str | None = None, adjust: float = 1.0, lower: float | None = None, upper: float | None = None) -> float:
    """By Silverman's or Scott's rule of the spread and the effective number of values, or the improved Sheather-Jones rule (``isj``).

    The last bins the values onto CELLS cells, over their range widened by a tenth on each side but not beyond the bounds, in one
    aggregate; it raises ValueError where it finds no bandwidth, or one finer than the closest two distinct values. No rule (None) is
    that one, or Silverman's where it finds none.
    """
    if rule is None:
        try:
            return bandwidth(df, name, "isj", weight, adjust, lower, upper)
        except ValueError:
            rule = "silverman"
    p = _within(population(df, name, weight), lower, upper)
    w, x = F.col("w"), F.col("x")
    if rule == "isj":
        s, ss, lo, hi = p.agg(F.sum(w), F.sum(w * w), F.min(x), F.max(x)).first()
        if not s or not hi > lo:
            raise ValueError("no spread to take a bandwidth from")
        edge = (hi - lo) / 10
        lo, hi = (lo - edge if lower is None else max(lo - edge, lower)), (hi + edge if upper is None else min(hi + edge, upper))
        cell = F.least(F.floor((x - lo) / ((hi - lo) / CELLS)), F.lit(CELLS - 1))
        counts = np.zeros(CELLS)
        for r in p.groupBy(cell.cast("int").alias("cell")).agg(F.sum(w).alias("w")).collect():
            counts[r["cell"]] = r["w"]
        found = sheather_jones(counts, s * s / ss)
        h = (found or 0) * (hi - lo)
        if found is None or not _resolved(p, h):
            raise ValueError("the improved Sheather-Jones rule finds no bandwidth")
        return adjust * h
    s, ss, sx, sxx = p.agg(F.sum(w), F.sum(w * w), F.sum(w * x), F.sum(w * x * x)).first()
    if not s:
        raise ValueError("no value to take a bandwidth from")
    q1, q3 = percentiles(p, [0.25, 0.75])
    std, n = math.sqrt(max(sxx / s - (sx / s) ** 2, 0) * (s / max(s - ss / s, 1e-300))), s * s / ss
    iqr = (q3 - q1) / 1.349
    spread = min(std, iqr) if iqr > 0 else std
    return adjust * {"silverman": 0.9, "scott": (4 / 3) ** 0.2}[rule] * spread * n**-0.2


def density(
    df: DataFrame, name: str, at: Sequence[float], h: float, shape: str = "bspline", weight: str | None = None, lower: float | None = None, upper: float | None = None
) -> DataFrame:
    """``at, density``, exact: each place sums the kernel over the values, one aggregate a place, in one pass.

    With bounds the values beyond them take no part, the density is 0 there, and the mass of a kernel that crosses a bound is mirrored
    back; a support narrower than a kernel's reach is refused.
    """
    p = _within(population(df, name, weight), lower, upper)
    if lower is not None and upper is not None and upper - lower < REACH[shape] * h:
        raise ValueError("the support is narrower than the kernel's reach")
    x = F.col("x")
    images = [x, *[2 * float(b) - x for b in (lower, upper) if b is not None]]

    def mass(a: float) -> Column:
        if (lower is not None and a < lower) or (upper is not None and a > upper):
            return F.lit(0.0)
        out = _column(shape, (images[0] - a) / h)
        for image in images[1:]:
            out = out + _column(shape, (image - a) / h)
        return out

    sums = p.agg(F.sum("w").alias("total"), *[F.sum(F.col("w") * mass(float(a))).alias(f"s{i}") for i, a in enumerate(at)])
    rows = F.array(*[F.struct(F.lit(float(a)).alias("at"), (F.col(f"s{i}") / (F.col("total") * h)).alias("density")) for i, a in enumerate(at)])
    return sums.select(F.explode(rows).alias("r")).select("r.at", "r.density")


def grid(df: DataFrame, name: str, h: float, cells: int = 512, shape: str = "bspline", weight: str | None = None) -> DataFrame:
    """``at, density`` on a grid over the values and the kernel's reach: cells are filled in one pass, then smoothed on the driver (a grid of bounded size)."""
    lo, hi = population(df, name, weight).agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "at double, density double")
    lo, hi = lo - REACH[shape] * h, hi + REACH[shape] * h
    width = (hi - lo) / cells
    if weight:
        raise ValueError("weights are for the exact form")
    held = np.zeros(cells)
    for r in bin_linear(df, name, lo, hi, cells).collect():
        held[r["cell"] - 1] = r["value"]
    reach = int(math.ceil(REACH[shape] * h / width))
    k = kernel(shape, np.arange(-reach, reach + 1) * width / h)
    k /= k.sum() * width
    out = np.convolve(held / held.sum(), k, mode="full")[reach : reach + cells]
    return df.sparkSession.createDataFrame([(lo + (i + 0.5) * width, float(v)) for i, v in enumerate(out)], "at double, density double")
