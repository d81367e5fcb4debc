import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.functions import healpix as H, numerics as N, temporal as T
from tabularium.functions.sky import healpix_nest


@pytest.mark.parametrize("nside", [1, 2, 4, 16])
def test_pixels_round_trip(nside):
    pix = np.arange(H.npix(nside))
    assert (healpix_nest(*H.nest_to_angles(pix, nside), nside) == pix).all()
    assert (H.angles_to_ring(*H.ring_to_angles(pix, nside), nside) == pix).all()
    assert (H.nest_to_ring(H.ring_to_nest(pix, nside), nside) == pix).all()
    theta, phi = H.ring_to_angles(pix, nside)
    assert (np.diff(theta) > -1e-12).all()
    assert H.nside_of(H.npix(nside)) == nside and H.nside_of(13) == -1
    assert np.isnan(H.nest_to_angles(np.array([-1, H.npix(nside)]), nside)[0]).all()


def test_disc_equals_brute_force():
    for nside, theta, phi, r in ((4, 0.1, 1.0, 0.4), (8, 1.5, 6.2, 0.3), (8, 3.1, 0.0, 0.5), (4, 1.0, 1.0, 0.0)):
        v = H.unit_vectors(*H.ring_to_angles(np.arange(H.npix(nside)), nside))
        d = np.arccos(np.clip(v @ H.unit_vectors(np.float64(theta), np.float64(phi)), -1, 1))
        assert H.query_disc(theta, phi, r, nside).tolist() == np.flatnonzero(d <= r).tolist()
        assert set(np.flatnonzero(d <= r)) <= set(H.query_disc(theta, phi, r, nside, inclusive=True).tolist())


def test_temporal(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 1, 12), dt.date(2000, 1, 1), 3_600_000_000_000 + 500_000_000), (None, None, None)], "ts timestamp_ntz, d date, t long")
    ts, d, t = F.col("ts"), F.col("d"), F.col("t")
    r = df.select(
        T.to_jd(ts).alias("jd"), T.to_mjd(ts).alias("mjd"), T.date_to_mjd(d).alias("dm"), T.mjd_to_date(T.date_to_mjd(d)).alias("db"), T.from_jd(T.to_jd(ts)).alias("tb"), T.to_unix(ts, "ms").alias("ms"), T.from_unix(T.to_unix(ts, "ns"), "ns").alias("nb"),
        T.time_to_string(t).alias("s"), T.parse_time(T.time_to_string(t)).alias("p"), T.diff_seconds(ts, ts).alias("z"), T.offset(ts, 1500).alias("o"), T.make_time(F.lit(1), F.lit(2), F.lit(3)).alias("k"),
    ).collect()
    a = r[0]
    assert (a["jd"], a["mjd"], a["dm"], a["ms"]) == (2451545.0, 51544.5, 51544, 946728000000)
    assert a["db"] == dt.date(2000, 1, 1) and a["tb"] == a["nb"] == dt.datetime(2000, 1, 1, 12)
    assert a["s"] == "01:00:00.5" and a["p"] == 3_600_500_000_000 and a["z"] == 0 and a["o"].microsecond == 1 and a["k"] == 3_723_000_000_000
    assert r[1]["jd"] is None and r[1]["s"] is None and r[1]["db"] is None


def test_numerics(spark):
    assert abs(N.integrate(lambda x: np.exp(-x * x), -np.inf, np.inf)[0] - np.sqrt(np.pi)) < 1e-9
    assert abs(N.integrate(np.sqrt, 0.0, 1.0)[0] - 2 / 3) < 1e-9
    assert abs(N.find_root(lambda x: x**3 - 2, 0, 2) - 2 ** (1 / 3)) < 1e-10
    with pytest.raises(ValueError):
        N.find_root(lambda x: 1 + x * x, 0, 1)
    p, v = N.minimise(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2, np.array([0.0, 0.0]))
    assert np.allclose(p, [1, -2], atol=1e-4)
    x = np.random.default_rng(0).random(16)
    k, n = np.meshgrid(np.arange(16), np.arange(16), indexing="ij")
    assert np.allclose(N.dct2(x), 2 * (np.cos(np.pi * k * (2 * n + 1) / 32) @ x)) and np.allclose(N.dct3(N.dct2(x)), 32 * x)
    grid = np.linspace(0, 3, 40)
    assert abs(N.natural_spline(grid, np.sin(grid))(np.array([1.51]))[0] - np.sin(1.51)) < 1e-5
    df = spark.createDataFrame([(0.5,), (9.0,), (None,)], "x double")
    got = [r[0] for r in df.select(N.interpolate(F.col("x"), np.array([0.0, 1.0]), np.array([0.0, 10.0]))).collect()]
    assert got == [5.0, None, None]
