"""Distances and times of flat or curved expanding universes with matter, radiation and a dark energy of constant density."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Speed of light (km/s), seconds a gigayear, kilometres a megaparsec.
C, GYR, MPC = 299792.458, 3.15576e16, 3.0856775814913673e19

# Fixed value: the Sun's mass times the constant of gravity (m^3/s^2).
GM_SUN = 1.3271244e20

# Hubble constant and matter density of named models.
MODELS = {"planck18": (67.66, 0.30966), "planck15": (67.74, 0.3075), "planck13": (67.77, 0.30712), "wmap9": (69.32, 0.2865), "wmap7": (70.4, 0.272), "wmap5": (70.2, 0.277)}


def z_to_zeta(z: Column) -> Column:
    """log(1 + z)."""
    return F.log1p(z)


def zeta_to_z(zeta: Column) -> Column:
    return F.expm1(zeta)


def z_combine(z1: Column, z2: Column) -> Column:
    """A shift on top of another, without cancellation."""
    return z1 + z2 + z1 * z2


#: Values computed at a time.
ROWS = 2048

_nodes, _weights = np.polynomial.legendre.leggauss(48)


@dataclass(frozen=True)
class Cosmology:
    """H0 in km/s/Mpc; the densities and the curvature's add up to one."""

    h0: float = 67.66
    matter: float = 0.30966
    radiation: float = 0.0
    dark: float | None = None

    @staticmethod
    def named(name: str) -> Cosmology:
        return Cosmology(*MODELS[name.lower()])

    @property
    def energy(self) -> float:
        return 1 - self.matter - self.radiation if self.dark is None else self.dark

    @property
    def curvature(self) -> float:
        return 1 - self.matter - self.radiation - self.energy

    def efunc(self, z: np.ndarray) -> np.ndarray:
        a = 1 + z
        return np.sqrt(self.matter * a**3 + self.radiation * a**4 + self.curvature * a**2 + self.energy)

    def _integral(self, z: np.ndarray, power: int) -> np.ndarray:
        """Of 1 / ((1 + z)^power E) from 0, in the variable log(1 + z)."""
        top = np.log1p(z)[..., None]
        u = top * (_nodes + 1) / 2
        x = np.expm1(u)
        return (np.exp(u) ** (1 - power) / self.efunc(x) * _weights).sum(axis=-1) * top[..., 0] / 2

    def comoving(self, z: np.ndarray) -> np.ndarray:
        """Line-of-sight distance, Mpc."""
        return C / self.h0 * self._integral(z, 0)

    def transverse(self, z: np.ndarray) -> np.ndarray:
        d, k = self.comoving(z), self.curvature
        if abs(k) < 1e-14:
            return d
        s = np.sqrt(abs(k)) * self.h0 / C
        return (np.sinh if k > 0 else np.sin)(s * d) / s

    def luminosity(self, z: np.ndarray) -> np.ndarray:
        return self.transverse(z) * (1 + z)

    def angular(self, z: np.ndarray) -> np.ndarray:
        return self.transverse(z) / (1 + z)

    def modulus(self, z: np.ndarray) -> np.ndarray:
        return 5 * np.log10(np.maximum(self.luminosity(z), 1e-300)) + 25

    def lookback(self, z: np.ndarray) -> np.ndarray:
        """Time since the light left, Gyr."""
        return self._integral(z, 1) * MPC / self.h0 / GYR

    def volume(self, z: np.ndarray) -> np.ndarray:
        """Comoving volume of the whole sky within z, Mpc^3."""
        d, k, h = self.transverse(z), self.curvature, C / self.h0
        if abs(k) < 1e-4:
            # the series of the closed form, which cancels here
            return 4 * np.pi / 3 * d**3 * (1 - 3 * k / 10 * (d / h) ** 2)
        r = np.sqrt(abs(k))
        angle = (np.arcsinh if k > 0 else np.arcsin)(r * d / h) / r
        return 2 * np.pi * h**3 / k * (d / h * np.sqrt(1 + k * (d / h) ** 2) - angle)

    def differential_volume(self, z: np.ndarray) -> np.ndarray:
        """Comoving volume a unit of z and a steradian, Mpc^3."""
        return C / self.h0 * self.transverse(z) ** 2 / self.efunc(z)

    def inv_efunc(self, z: np.ndarray) -> np.ndarray:
        return 1 / self.efunc(z)

    def hubble(self, z: np.ndarray) -> np.ndarray:
        """Expansion rate, km/s/Mpc."""
        return self.h0 * self.efunc(z)

    def scale_factor(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + z)

    def om(self, z: np.ndarray) -> np.ndarray:
        """Matter's share of the critical density."""
        return self.matter * (1 + z) ** 3 / self.efunc(z) ** 2

    def ode(self, z: np.ndarray) -> np.ndarray:
        """Dark energy's share."""
        return self.energy / self.efunc(z) ** 2

    def ok(self, z: np.ndarray) -> np.ndarray:
        """The curvature's share."""
        return self.curvature * (1 + z) ** 2 / self.efunc(z) ** 2

    def otot(self, z: np.ndarray) -> np.ndarray:
        return 1 - self.ok(z)

    def critical_density(self, z: np.ndarray) -> np.ndarray:
        """Solar masses a cubic megaparsec."""
        rate = self.hubble(z) / MPC
        return 3 * rate**2 / (8 * np.pi * GM_SUN) * (MPC * 1e3) ** 3

    def _from_start(self, z: np.ndarray, f) -> np.ndarray:
        """Integral of f(a, E) over the scale factor from 0, by its square root, in which integrands of matter are smooth."""
        top = (1 / (1 + z))[..., None]
        x = (_nodes + 1) / 2
        a = top * x**2
        return (f(a, self.efunc(1 / a - 1)) * 2 * top * x * _weights).sum(axis=-1) / 2

    def age(self, z: np.ndarray) -> np.ndarray:
        """Time since the beginning, Gyr."""
        return self._from_start(z, lambda a, e: 1 / (a * e)) * MPC / self.h0 / GYR

    def lookback_distance(self, z: np.ndarray) -> np.ndarray:
        """The lookback time as a distance, Mpc."""
        return C / self.h0 * self._integral(z, 1)

    def absorption_distance(self, z: np.ndarray) -> np.ndarray:
        return self._integral(z, -2)

    def kpc_proper_per_arcmin(self, z: np.ndarray) -> np.ndarray:
        return self.angular(z) * 1000 * np.pi / 10800

    def kpc_comoving_per_arcmin(self, z: np.ndarray) -> np.ndarray:
        return self.transverse(z) * 1000 * np.pi / 10800

    def arcsec_per_kpc_proper(self, z: np.ndarray) -> np.ndarray:
        return 60 / self.kpc_proper_per_arcmin(z)

    def arcsec_per_kpc_comoving(self, z: np.ndarray) -> np.ndarray:
        return 60 / self.kpc_comoving_per_arcmin(z)

    def _growing(self, z: np.ndarray) -> np.ndarray:
        if self.radiation:
            raise ValueError("growth is for universes without radiation")
        return self.efunc(z) * self._from_start(z, lambda a, e: (a * e) ** -3.0)

    def growth_factor(self, z: np.ndarray) -> np.ndarray:
        """Of linear perturbations of matter, 1 today; without radiation only."""
        return self._growing(z) / self._growing(np.zeros(1))[0]

    def growth_rate(self, z: np.ndarray) -> np.ndarray:
        """Logarithmic slope of the growth factor over the scale factor."""
        e2, a = self.efunc(z) ** 2, 1 + z
        slope = -(3 * self.matter * a**3 + 2 * self.curvature * a**2) / (2 * e2)
        return slope + a**2 / (e2 * self._growing(z))

    def comoving_between(self, z1: np.ndarray, z2: np.ndarray) -> np.ndarray:
        """Line-of-sight distance from z1 to z2, negative if z2 is the lesser."""
        return self.comoving(z2) - self.comoving(z1)

    def z_at_age(self, gyr: np.ndarray, highest: float = 1000.0) -> np.ndarray:
        """The z at which the universe was that old."""
        return self.inverse("lookback", self.age(np.zeros(1))[0] - gyr, highest)

    def inverse(self, quantity: str, values: np.ndarray, highest: float = 1000.0) -> np.ndarray:
        """The smallest z at which a rising quantity takes each value, by bisection; NaN beyond."""
        f, lo, hi = getattr(self, quantity), np.zeros_like(values), np.full_like(values, highest)
        inside = (values >= f(lo)) & (values <= f(hi))
        for _ in range(80):
            mid = (lo + hi) / 2
            below = f(mid) < values
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return np.where(inside, (lo + hi) / 2, np.nan)

    def _values(self, quantity: str, z: np.ndarray) -> np.ndarray:
        """In runs of ROWS, so that the integrals' nodes take little memory whatever a batch has."""
        out = np.empty(len(z))
        for i in range(0, len(z), ROWS):
            out[i : i + ROWS] = getattr(self, quantity)(z[i : i + ROWS])
        return out

    def column(self, quantity: str, z: Column) -> Column:
        own = self

        @F.pandas_udf("double")
        def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(own._values(quantity, b.to_numpy(float, na_value=np.nan)))

        return compute(z.cast("double"))

    def with_columns(self, df: DataFrame, z: str, quantities: Sequence[str]) -> DataFrame:
        """All quantities come from one function: each function by itself is a Python process more for every running task."""
        own, names = self, list(dict.fromkeys(quantities))
        if not names:
            return df

        @F.pandas_udf(", ".join(f"{q} double" for q in names))
        def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                held = b.to_numpy(float, na_value=np.nan)
                yield pd.DataFrame({q: own._values(q, held) for q in names})

        found = df.withColumn("__cosmic", compute(F.col(z).cast("double")))
        return found.withColumns({q: F.col("__cosmic")[q] for q in names}).drop("__cosmic")
