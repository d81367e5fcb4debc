"""Positions on the sphere: separations, unit vectors, frames and pixels. Degrees in and out; longitudes in [0, 360)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.spatial import cross_pairs

# J2000 position of the north Galactic pole and the longitude of the celestial pole; mean obliquity (degrees).
POLE_RA, POLE_DEC, POLE_L, OBLIQUITY = 192.85948, 27.12825, 122.93192, 23.4392911
# The supergalactic north pole in galactic coordinates, and the longitude there of the galactic one.
SUPERGALACTIC = (47.37, 6.32, 90.0)
SPEED_OF_LIGHT = 299792.458


def wrap360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def wrap180(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


def to_angles(v: Sequence[Column]) -> tuple[Column, Column]:
    return wrap360(F.degrees(F.atan2(v[1], v[0]))), F.degrees(F.atan2(v[2], F.hypot(v[0], v[1])))


def separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by atan2(|cross|, dot); exactly 0 for a position against itself."""
    a, b = unit_vector(lon1, lat1), unit_vector(lon2, lat2)
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = F.sqrt(reduce(Column.__add__, [c * c for c in cross]))
    return F.degrees(F.atan2(size, reduce(Column.__add__, [x * y for x, y in zip(a, b, strict=True)])))


def position_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """East of north, in [0, 360)."""
    d, p, q = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    return wrap360(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))))


def pole_matrix(lon: float, lat: float, own: float) -> list[list[float]]:
    """The rotation into the system whose north pole is at (lon, lat), and in which this system's north pole has the longitude ``own``; in degrees."""
    a, d, t = map(math.radians, (lon, lat, own))
    rot = lambda axis, x: np.array({"z": [[math.cos(x), math.sin(x), 0], [-math.sin(x), math.cos(x), 0], [0, 0, 1]], "y": [[math.cos(x), 0, -math.sin(x)], [0, 1, 0], [math.sin(x), 0, math.cos(x)]]}[axis])
    return (rot("z", math.pi - t) @ rot("y", math.pi / 2 - d) @ rot("z", a)).tolist()


def galactic_matrix() -> list[list[float]]:
    return pole_matrix(POLE_RA, POLE_DEC, POLE_L)


def supergalactic_matrix() -> list[list[float]]:
    """From galactic coordinates."""
    return pole_matrix(*SUPERGALACTIC)


def ecliptic_matrix() -> list[list[float]]:
    e = math.radians(OBLIQUITY)
    return [[1, 0, 0], [0, math.cos(e), math.sin(e)], [0, -math.sin(e), math.cos(e)]]


def rotate(lon: Column, lat: Column, matrix: Sequence[Sequence[float]], inverse: bool = False) -> tuple[Column, Column]:
    v = unit_vector(lon, lat)
    m = np.array(matrix).T.tolist() if inverse else matrix
    return to_angles([reduce(Column.__add__, [F.lit(float(m[i][j])) * v[j] for j in range(3)]) for i in range(3)])


def to_galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    return rotate(ra, dec, galactic_matrix())


def from_galactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, galactic_matrix(), inverse=True)


def galactic_to_supergalactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, supergalactic_matrix())


def supergalactic_to_galactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, supergalactic_matrix(), inverse=True)


def to_supergalactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Both rotations as one."""
    return rotate(ra, dec, (np.array(supergalactic_matrix()) @ np.array(galactic_matrix())).tolist())


def to_ecliptic(ra: Column, dec: Column) -> tuple[Column, Column]:
    return rotate(ra, dec, ecliptic_matrix())


def chord(degrees: float) -> float:
    return 2 * math.sin(math.radians(degrees) / 2)


def sky_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, lon: str, lat: str, radius: float) -> DataFrame:
    """``a, b, separation`` of all positions within the radius (degrees), by a grid over unit vectors."""
    place = lambda df, i: df.select(F.col(i), *[v.alias(n) for n, v in zip("xyz", unit_vector(F.col(lon), F.col(lat)), strict=True)])
    reach = chord(radius) * (1 + 1e-12) + 1e-15
    found = cross_pairs(place(left, left_id), place(right, right_id), left_id, right_id, ["x", "y", "z"], reach)
    return found.select("a", "b", F.degrees(2 * F.asin(F.least(F.col("distance") / 2, F.lit(1.0)))).alias("separation"))


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits moved to the even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def healpix_nest(theta: np.ndarray, phi: np.ndarray, nside: int) -> np.ndarray:
    """NESTED pixel of each colatitude and longitude (radians); -1 outside the domain."""
    ok = np.isfinite(theta) & np.isfinite(phi) & (theta >= 0) & (theta <= np.pi)
    z, t = np.cos(np.where(ok, theta, 0.5)), np.mod(np.where(ok, phi, 0), 2 * np.pi) / (np.pi / 2)
    za = np.abs(z)
    # the equatorial belt: places along the two diagonals of the base pixels
    up, down = nside * (0.5 + t), nside * z * 0.75
    jp, jm = np.floor(up - down).astype(np.int64), np.floor(up + down).astype(np.int64)
    fp, fm = jp // nside, jm // nside
    belt_face = np.where(fp == fm, (fp & 3) + 4, np.where(fp < fm, fp & 3, (fm & 3) + 8))
    belt_x, belt_y = jm & (nside - 1), nside - 1 - (jp & (nside - 1))
    # the caps
    nt = np.minimum(np.floor(t).astype(np.int64), 3)
    f = t - nt
    s = np.sin(np.where(ok, theta, 0.5))
    r = nside * s / np.sqrt((1 + za) / 3)
    cp, cm = np.minimum((f * r).astype(np.int64), nside - 1), np.minimum(((1 - f) * r).astype(np.int64), nside - 1)
    north = z >= 0
    cap_face = np.where(north, nt, nt + 8)
    cap_x, cap_y = np.where(north, nside - 1 - cm, cp), np.where(north, nside - 1 - cp, cm)
    belt = za <= 2 / 3
    face, x, y = np.where(belt, belt_face, cap_face), np.where(belt, belt_x, cap_x), np.where(belt, belt_y, cap_y)
    pix = face.astype(np.uint64) * np.uint64(nside * nside) + _spread(x) + (_spread(y) << np.uint64(1))
    return np.where(ok, pix.astype(np.int64), -1)


def healpix(lon: Column, lat: Column, order: int) -> Column:
    """NESTED pixel at nside = 2**order of longitude and latitude in degrees."""
    nside = 1 << order

    @F.pandas_udf("long")
    def pixel(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(healpix_nest(np.radians(90.0 - b.to_numpy(float, na_value=np.nan)), np.radians(a.to_numpy(float, na_value=np.nan)), nside))

    return pixel(lon, lat)


def z_cmb(z: Column, lon: Column, lat: Column, speed: float, apex_lon: float, apex_lat: float) -> Column:
    """Redshift in the frame of the background, for an observer's speed (km/s) towards the apex."""
    beta = speed / SPEED_OF_LIGHT
    cos = F.cos(F.radians(separation(lon, lat, F.lit(apex_lon), F.lit(apex_lat))))
    return (1 + z) / ((1 - F.lit(beta) * cos) / math.sqrt(1 - beta * beta)) - 1
