"""HEALPix pixels in both schemes, vectorised over numpy arrays, and as columns.

A direction is (theta, phi) in radians, theta the colatitude. Indices out of range and directions outside the domain give -1 or NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .sky import healpix_nest

# Ring and phase of each base pixel.
_RING = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
_PHASE = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def npix(nside: int) -> int:
    return 12 * nside * nside


def nside_of(pixels: int) -> int:
    """The resolution of a pixel count, or -1."""
    n = round((pixels / 12) ** 0.5)
    return n if n > 0 and npix(n) == pixels and n & (n - 1) == 0 else -1


def pixel_area(nside: int) -> float:
    return 4 * np.pi / npix(nside)


def resolution(nside: int) -> float:
    return float(np.sqrt(pixel_area(nside)))


def _gather(v: np.ndarray) -> np.ndarray:
    """The even bits, put together."""
    v = v.astype(np.uint64) & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> np.uint64(shift))) & np.uint64(mask)
    return v.astype(np.int64)


def nest_to_face(pix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    face, inner = pix // (nside * nside), pix % (nside * nside)
    return face, _gather(inner), _gather(inner >> 1)


def _place(pix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ring (1 to 4 nside - 1), pixels in its quarter, and the pixel's doubled place in the ring, from NESTED indices."""
    face, x, y = nest_to_face(pix, nside)
    ring = _RING[face] * nside - x - y - 1
    quarter = np.minimum(np.minimum(ring, 4 * nside - ring), nside)
    place = _PHASE[face] * quarter + x - y
    return ring, quarter, np.where(place < 0, place + 8 * quarter, place)


def _checked(pix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    pix = np.asarray(pix, dtype=np.int64)
    ok = (pix >= 0) & (pix < npix(nside))
    return np.where(ok, pix, 0), ok


def ring_z(ring: np.ndarray, nside: int) -> np.ndarray:
    near = np.minimum(ring, 4 * nside - ring)
    cap = 1 - near.astype(float) ** 2 / (3 * nside * nside)
    return np.where(near < nside, np.where(ring < 2 * nside, cap, -cap), (2 * nside - ring) * 2 / (3 * nside))


def nest_to_angles(pix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    p, ok = _checked(pix, nside)
    ring, quarter, place = _place(p, nside)
    return np.where(ok, np.arccos(ring_z(ring, nside)), np.nan), np.where(ok, np.pi / 4 * place / quarter, np.nan)


def _before(ring: np.ndarray, nside: int) -> np.ndarray:
    """Pixels on the rings north of a ring."""
    south = 4 * nside - ring
    return np.where(ring < nside, 2 * ring * (ring - 1), np.where(ring <= 3 * nside, 2 * nside * (nside - 1) + (ring - nside) * 4 * nside, npix(nside) - 2 * south * (south + 1)))


def nest_to_ring(pix: np.ndarray, nside: int) -> np.ndarray:
    p, ok = _checked(pix, nside)
    ring, quarter, place = _place(p, nside)
    # places on a ring are odd if its first pixel is half a step off the meridian, else even
    return np.where(ok, _before(ring, nside) + place // 2, -1)


def ring_to_angles(pix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    p, ok = _checked(pix, nside)
    cap = 2 * nside * (nside - 1)
    north = ((1 + np.sqrt(1 + 2 * p.astype(float))) / 2).astype(np.int64)
    south_p = npix(nside) - 1 - p
    south = ((1 + np.sqrt(1 + 2 * south_p.astype(float))) / 2).astype(np.int64)
    # a root may round to the neighbouring ring
    fix = lambda r, q: r + (q >= 2 * r * (r + 1)).astype(np.int64) - (q < 2 * r * (r - 1)).astype(np.int64)
    ring = np.where(p < cap, fix(north, p), np.where(p < npix(nside) - cap, (p - cap) // (4 * nside) + nside, 4 * nside - fix(south, south_p)))
    quarter = np.minimum(np.minimum(ring, 4 * nside - ring), nside)
    shift = np.where((ring < nside) | (ring > 3 * nside) | ((ring - nside) % 2 == 0), 0.5, 0.0)
    phi = (p - _before(ring, nside) + shift) * np.pi / 2 / quarter
    return np.where(ok, np.arccos(ring_z(ring, nside)), np.nan), np.where(ok, phi, np.nan)


def ring_to_nest(pix: np.ndarray, nside: int) -> np.ndarray:
    return healpix_nest(*ring_to_angles(pix, nside), nside)


def angles_to_ring(theta: np.ndarray, phi: np.ndarray, nside: int) -> np.ndarray:
    return nest_to_ring(healpix_nest(theta, phi, nside), nside)


def unit_vectors(theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    s = np.sin(theta)
    return np.stack([s * np.cos(phi), s * np.sin(phi), np.cos(theta)], axis=-1)


def max_pixel_radius(nside: int) -> float:
    """From the centre to the farthest corner of the pixels next to the poles' caps, where it is greatest."""
    a = unit_vectors(np.arccos(2 / 3), np.pi / (4 * nside))
    t = (1 - 1 / nside) ** 2
    b = unit_vectors(np.arccos(1 - t / 3), 0.0)
    return float(np.arccos(np.clip(a @ b, -1, 1)))


def query_disc(theta: float, phi: float, radius: float, nside: int, inclusive: bool = False) -> np.ndarray:
    """RING pixels whose centres lie within the radius, ascending; inclusive: within the radius and a pixel's own. Rings out of reach aren't looked at."""
    reach = radius + (max_pixel_radius(nside) if inclusive else 0.0)
    rings = np.arange(1, 4 * nside)
    colat = np.arccos(ring_z(rings, nside))
    rings = rings[np.abs(colat - theta) <= reach + 1e-12]
    if not len(rings):
        return np.zeros(0, dtype=np.int64)
    pix = np.arange(_before(rings[:1], nside)[0], _before(rings[-1:] + 1, nside)[0] if rings[-1] < 4 * nside - 1 else npix(nside))
    v = unit_vectors(*ring_to_angles(pix, nside))
    c = unit_vectors(np.float64(theta), np.float64(phi))
    chord2 = ((v - c) ** 2).sum(axis=1)
    return pix[chord2 <= (2 * np.sin(min(reach, np.pi) / 2)) ** 2]


def change_resolution(pix: Column, order: int, to: int) -> Column:
    """The NESTED pixel that holds the pixel at a coarser order, or its first child at a finer one."""
    return F.shiftright(pix, 2 * (order - to)) if to <= order else F.shiftleft(pix, 2 * (to - order))


def _column(f: Callable, *cols: Column) -> Column:
    @F.pandas_udf("long")
    def compute(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(f(*[x.to_numpy(float, na_value=np.nan) for x in b]))

    return compute(*cols)


def ring_pixel(lon: Column, lat: Column, order: int) -> Column:
    """RING pixel of longitude and latitude in degrees."""
    return _column(lambda a, b: angles_to_ring(np.radians(90 - b), np.radians(a), 1 << order), lon, lat)


def disc_rows(df: DataFrame, pixel: str, lon: float, lat: float, radius: float, order: int) -> DataFrame:
    """Rows whose RING pixel is in the inclusive disc (degrees): a semi join with the disc's pixels."""
    pix = query_disc(np.radians(90 - lat), np.radians(lon), np.radians(radius), 1 << order, inclusive=True)
    wanted = df.sparkSession.createDataFrame(pd.DataFrame({"__pix": pix}))
    return df.join(wanted, F.col(pixel) == F.col("__pix"), "left_semi")
