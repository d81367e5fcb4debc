import math
import posixpath
import random
from statistics import NormalDist, mean

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabularium.functions import sky as sky_functions, text
from tabularium.functions.cosmology import Cosmology
from tabularium.operators import kde, spatial, stats
from tabularium.sources import parquet

PATHS = ["", "/", "//", "a", "a/", "/a", "a/b.c", "a//b.tar.gz", "/a.b/c", ".hidden", "..", "...", ".a.b", "x/.a", "x/..b.c", "a.", "a.b.", "//a/b//", "é/ü.ö", "a b/c d.e f", None]


def test_paths(spark):
    c = F.col("p")
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", text.dirname(c), text.basename(c), text.path_ext(c), text.path_stem(c), text.path_add_suffix(c, "_x"), text.join_path(F.lit("r"), c)).collect()
    for p, *got in rows:
        if p is None:
            assert got == [None] * 6
            continue
        stem, ext = posixpath.splitext(posixpath.basename(p))
        folder = p[: len(p) - len(stem) - len(ext)]
        assert got == [posixpath.dirname(p), posixpath.basename(p), ext, stem, folder + stem + "_x" + ext, posixpath.join("r", p)], p


def test_text(spark):
    df = spark.createDataFrame([(1, "ÄbC"), (2, ""), (3, None), (4, "ÄbC"), (5, " x ")], "row int, s string")
    assert [r[0] for r in df.select(text.to_lower(F.col("s"))).collect()] == ["Äbc", "", None, "Äbc", " x "]
    assert [r[0] for r in df.select(text.to_upper(F.col("s"))).collect()] == ["ÄBC", "", None, "ÄBC", " X "]
    assert text.find(df, "s", "ÄbC", "row") == 1 and text.find(df, "s", "ÄbC", "row", last=True) == 4 and text.find(df, "s", "q", "row") is None
    assert tuple(text.summary(df, "s").first()) == (5, 1, 1, 11, 0, 4)
    assert tuple(text.summary(df.limit(0), "s").first()) == (0, 0, 0, 0, None, None)


def test_safe_div_and_angles(spark):
    inf, nan = math.inf, math.nan
    cases = [(1.0, 0.0, inf), (-1.0, 0.0, -inf), (1.0, -0.0, -inf), (0.0, 0.0, nan), (nan, 0.0, nan), (3.0, 2.0, 1.5), (None, 0.0, None), (1.0, None, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double")
    for (q,), (_, _, want) in zip(df.select(text.safe_div(F.col("a"), F.col("b"))).collect(), cases, strict=True):
        assert q == want or (want is not None and math.isnan(want) and math.isnan(q))
    x = F.col("x")
    for v, w, p in spark.createDataFrame([(float(v),) for v in (-7, -math.pi, 0, 3, math.pi, 100)], "x double").select(x, text.wrap_rad(x), text.wrap_pi(x)).collect():
        assert 0 <= w < 2 * math.pi and -math.pi <= p < math.pi
        assert math.cos(w) == pytest.approx(math.cos(v)) and math.sin(p) == pytest.approx(math.sin(v), abs=1e-12)
    z = F.col("z")
    for v, pdf, cdf, sf in spark.createDataFrame([(-2.0,), (0.0,), (1.5,)], "z double").select(z, text.norm_pdf(z), text.norm_cdf(z), text.norm_sf(z)).collect():
        n = NormalDist()
        assert (pdf, cdf, sf) == pytest.approx((n.pdf(v), n.cdf(v), 1 - n.cdf(v)))
    got = spark.range(1).select(text.cross_product(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(5.0), F.lit(6.0)))).first()[0]
    assert got == [-3.0, 6.0, -3.0]


def test_probit(spark):
    rng = random.Random(5)
    values = [round(rng.gauss(10, 2), 1) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "x double")
    inv, n = NormalDist().inv_cdf, len(values)
    z = [inv((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    y, mz, my = sorted(values), mean(z), mean(values)
    sigma = sum((a - mz) * (b - my) for a, b in zip(z, y, strict=True)) / sum((a - mz) ** 2 for a in z)
    fit = stats.probit_fit(df, "x").first()
    assert (fit["sigma"], fit["loc"]) == pytest.approx((sigma, my - sigma * mz)) and 0.99 < fit["corr"] <= 1
    assert stats.probit_scale(df, "x").first()[0] == pytest.approx(2, rel=0.2)
    p = spark.createDataFrame([(0.1, 1.0), (0.7, 2.0), (0.9, 0.0)], "p double, w double")
    assert stats.probit_mean(p, "p", "w").first()[0] == pytest.approx(NormalDist().cdf((inv(0.1) + 2 * inv(0.7)) / 3))
    assert stats.probit_mean(p.limit(0), "p").first()[0] is None and stats.probit_fit(df.limit(0), "x").first()["loc"] is None
    with pytest.raises(ValueError):
        stats.probit_scale(df, "x", 0.5)


def sky(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        far = rng.choice([0.3, 1, 2, 7, 40]) * rng.uniform(0.9, 1.1)
        v = [rng.gauss(0, 1) for _ in range(3)]
        d = math.sqrt(sum(c * c for c in v))
        out.append((i, *[far * c / d for c in v], rng.choice([0.0, 0.1, 0.2, 0.4]), rng.uniform(0, 3)))
    return [*out, (n, 0.0, 0.0, 0.0, 1.0, 1.0), (n + 1, None, 1.0, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("los", [None, "l"])
@pytest.mark.parametrize("combine", ["max", "min", "mean", "sum"])
def test_line_of_sight_pairs(spark, los, combine):
    rows = sky(250, 7)
    mix = {"max": max, "min": min, "mean": lambda a, b: (a + b) / 2, "sum": lambda a, b: a + b}[combine]
    want = set()
    for r in rows[:250]:
        for s in rows[: r[0]]:
            dr, ds = math.dist(r[1:4], (0, 0, 0)), math.dist(s[1:4], (0, 0, 0))
            chord = math.dist([c / dr for c in r[1:4]], [c / ds for c in s[1:4]])
            if chord * (dr + ds) / 2 <= mix(r[4], s[4]) and abs(r[5] - s[5] if los else dr - ds) <= 0.5:
                want.add((s[0], r[0]))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, p double, l double")
    got = [tuple(r) for r in spatial.line_of_sight_pairs(df, "id", ["x", "y", "z"], "p", 0.5, los=los, combine=combine).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (want or combine == "min")


def test_linked_pairs(spark):
    rows = sky(200, 9)
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, p double, l double")
    for combine, mix in (("max", max), ("min", min), ("mean", lambda a, b: (a + b) / 2), ("sum", lambda a, b: a + b)):
        want = {(s[0], r[0]) for r in rows[:201] for s in rows[: r[0]] if math.dist(r[1:4], s[1:4]) <= mix(r[4], s[4])}
        got = [tuple(r) for r in spatial.linked_pairs(df, "id", ["x", "y", "z"], "p", combine).select("a", "b").collect()]
        assert len(got) == len(want) and set(got) == want
    assert spatial.linked_pairs(df.limit(0), "id", ["x", "y", "z"], "p").isEmpty()
    assert spatial.line_of_sight_pairs(df.limit(0), "id", ["x", "y", "z"], 1.0, 1.0).isEmpty()
    with pytest.raises(ValueError):
        spatial.linked_pairs(df, "id", ["x", "y", "z"], "p", "other")


def test_row_groups_and_footers(spark, tmp_path):
    path = str(tmp_path / "a b.parquet")
    held = pa.table({"n": list(range(10))}).replace_schema_metadata({"origin": "elsewhere"})
    pq.write_table(held, path, row_group_size=4)
    assert [tuple(r)[1:4] for r in parquet.row_group_bounds(spark, path).orderBy("row_group").collect()] == [(1, 1, 4), (2, 5, 8), (3, 9, 10)]
    assert [tuple(r) for r in parquet.read_row_group(spark, path, 2, ["n"]).orderBy("row").collect()] == [(4, 5), (5, 6), (6, 7), (7, 8)]
    assert parquet.footer_metadata(spark, path)["origin"] == "elsewhere"
    with pytest.raises(ValueError):
        parquet.read_row_group(spark, path, 4)


def test_names_on_write(spark, tmp_path):
    df = spark.range(3).withColumn("b", F.lit(1))
    parquet.write_table(df, str(tmp_path / "t"), col_map={"id": "number"})
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["number", "b"]
    with pytest.raises(KeyError):
        parquet.write_table(df, str(tmp_path / "u"), col_map={"q": "z"})
    with pytest.raises(ValueError):
        parquet.write_table(df, str(tmp_path / "u"), col_map={"id": "b"})


def test_cosmology_quantities():
    z = np.array([0.0, 0.3, 1.0, 3.0])
    flat, open_, closed = Cosmology(70, 0.3), Cosmology(70, 0.3, 0.0, 0.2), Cosmology(70, 0.4, 0.0, 0.8)
    for c in (flat, open_, closed):
        assert c.om(z) + c.ode(z) + c.ok(z) == pytest.approx(np.ones(4))
        assert c.age(z) + c.lookback(z) == pytest.approx(np.full(4, c.age(np.zeros(1))[0]), rel=1e-9)
        assert c.z_at_age(c.age(z)) == pytest.approx(z, abs=1e-9)
        step = 1e-4
        assert (c.volume(z[1:] + step) - c.volume(z[1:] - step)) / (2 * step) / (4 * math.pi) == pytest.approx(c.differential_volume(z[1:]), rel=1e-6)
        assert -(np.log(c.growth_factor(z + step)) - np.log(c.growth_factor(np.maximum(z - step, -step)))) / (2 * step) * (1 + z) == pytest.approx(c.growth_rate(z), rel=1e-5)
        assert c.comoving_between(z[1:], z[:1]) == pytest.approx(-c.comoving(z[1:]))
    empty = Cosmology(70, 1.0)
    assert empty.growth_factor(z) == pytest.approx(1 / (1 + z)) and empty.growth_rate(z) == pytest.approx(np.ones(4))
    # matter alone: INT (1 + z)^(1/2) dz, and an age of 2 / (3 H)
    assert empty.absorption_distance(z) == pytest.approx(((1 + z) ** 1.5 - 1) / 1.5)
    assert flat.critical_density(np.zeros(1))[0] == pytest.approx(2.77536627e11 * 0.49, rel=1e-4)
    assert Cosmology(70, 0.3, 0.0, 0.7 - 1.1e-4).volume(z) == pytest.approx(Cosmology(70, 0.3, 0.0, 0.7 - 0.9e-4).volume(z), rel=1e-4)
    with pytest.raises(ValueError):
        Cosmology(70, 0.3, 1e-4).growth_factor(z)


def test_supergalactic(spark):
    x, y = F.col("x"), F.col("y")
    df = spark.createDataFrame([(137.37, 0.0), (47.37, 6.32), (10.0, -70.0)], "x double, y double")
    got = df.select("x", "y", *sky_functions.galactic_to_supergalactic(x, y)).toDF("x", "y", "l", "b").select("*", *sky_functions.supergalactic_to_galactic(F.col("l"), F.col("b"))).collect()
    assert abs(math.sin(math.radians(got[0][2]))) < 1e-9 and got[0][2] % 360 == pytest.approx(0, abs=1e-6) or got[0][2] == pytest.approx(360, abs=1e-6)
    assert got[0][3] == pytest.approx(0, abs=1e-9) and got[1][3] == pytest.approx(90, abs=1e-5)
    assert got[2][4:] == pytest.approx((10.0, -70.0))
    one = df.select(*sky_functions.from_galactic(x, y)).toDF("r", "d").select(*sky_functions.to_supergalactic(F.col("r"), F.col("d"))).collect()
    assert tuple(one[2]) == pytest.approx((got[2][2], got[2][3]))


def test_sheather_jones_bandwidth(spark):
    rng = np.random.default_rng(8)

    def frame(values):
        return spark.createDataFrame([(float(v),) for v in values], "x double")

    one = frame(rng.normal(5, 2, 4000))
    assert kde.bandwidth(one, "x", "isj") == pytest.approx(1.06 * 2 * 4000**-0.2, rel=0.15)
    assert kde.bandwidth(one, "x", "isj", adjust=0.5) == pytest.approx(kde.bandwidth(one, "x", "isj") / 2)
    two = frame(np.r_[rng.normal(0, 0.1, 2000), rng.normal(50, 0.1, 2000)])
    assert kde.bandwidth(two, "x", "isj") < kde.bandwidth(two, "x", "silverman") / 10
    # whole numbers leave nothing finer than their step; without a rule Silverman's takes over
    steps = frame(rng.integers(0, 3, 900))
    with pytest.raises(ValueError):
        kde.bandwidth(steps, "x", "isj")
    assert kde.bandwidth(steps, "x", None) == kde.bandwidth(steps, "x", "silverman")
    for values in ([], [3.0], [3.0, 3.0]):
        with pytest.raises(ValueError):
            kde.bandwidth(frame(values), "x", "isj")


def test_reflected_density_has_unit_mass(spark):
    rng = np.random.default_rng(9)
    x = rng.exponential(1, 500)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (-4.0,), (90.0,)], "x double")
    at = np.linspace(0, 4, 161)
    kept = x[x <= 4]
    for shape in kde.REACH:
        got = np.array([r["density"] for r in kde.density(df, "x", at, 0.3, shape, lower=0, upper=4).collect()])
        want = sum(kde.kernel(shape, (at[:, None] - image[None]) / 0.3).sum(axis=1) for image in (kept, -kept, 8 - kept)) / (0.3 * len(kept))
        assert np.allclose(got, want, atol=1e-9)
        assert np.trapezoid(got, at) == pytest.approx(1, abs=0.02)
    assert [r["density"] for r in kde.density(df, "x", [-1.0, 5.0], 0.3, lower=0, upper=4).collect()] == [0, 0]
    for lower, upper in ((0, 0.1), (2, 1), (float("nan"), None)):
        with pytest.raises(ValueError):
            kde.density(df, "x", [0.0], 0.3, lower=lower, upper=upper)


def test_line_of_sight_copies_are_not_broadcast(spark):
    rows = sky(100, 7)
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, p double, l double")
    plan = spatial.line_of_sight_pairs(df, "id", ["x", "y", "z"], 0.4, 0.25, los="l")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_copies_to_cells_are_not_broadcast(spark):
    df = spark.createDataFrame(sky(100, 9), "id long, x double, y double, z double, p double, l double").select("id", "x", "y", "z", "p")
    axes = ["x", "y", "z"]
    for out in (spatial.linked_pairs(df, "id", axes, "p", "sum"), spatial.pairs(df, "id", axes, 0.3), spatial.cross_pairs(df, df, "id", "id", axes, 0.3)):
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("box", [None, [1.0, 1.0], [0.45, 1.0]])
def test_pairs_by_half_of_the_cells(spark, box):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-1, 1) if box is None else rng.uniform(0, box[0]), rng.random()) for i in range(300)] + [(300, None, 0.5), (301, float("nan"), 0.5), (302, 0.25, 0.5), (303, 0.25, 0.5)]
    gap = lambda a, b, w: abs(a - b) if w is None else min(abs(a - b), w - abs(a - b))
    near = lambda r, s: math.hypot(*[gap(r[i + 1], s[i + 1], box and box[i]) for i in range(2)]) <= 0.2
    held = [r for r in rows if r[0] not in (300, 301)]
    want = sorted((s[0], r[0]) for r in held for s in held if s[0] < r[0] and near(r, s))
    df = spark.createDataFrame(rows, "id long, x double, y double")
    assert sorted((r["a"], r["b"]) for r in spatial.pairs(df, "id", ["x", "y"], 0.2, box).collect()) == want
    both = sorted((r["a"], r["b"]) for r in spatial.pairs(df, "id", ["x", "y"], 0.2, box, directed=True).collect())
    assert both == sorted(want + [(b, a) for a, b in want])


@pytest.fixture
def no_percentile(monkeypatch):
    """Spark's exact percentile gathers all distinct values in one aggregate."""

    def gathered(*args):
        raise AssertionError("F.percentile")

    monkeypatch.setattr(F, "percentile", gathered)


def test_quantiles_of_columns_are_not_gathered(spark, no_percentile):
    values = [random.Random(2).choice([0.0, 1.5, 2.0, 7.0, 9.25]) + i % 7 for i in range(101)] + [None, float("nan"), -3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    held = np.array([v for v in values if v is not None and v == v])
    for prob in (0.25, 0.1):
        wide = np.quantile(held, 1 - prob) - np.quantile(held, prob)
        assert stats.probit_scale(df, "v", prob).first()[0] == pytest.approx(wide / (-2 * NormalDist().inv_cdf(prob)), rel=1e-12)
    assert stats.percentiles(stats.population(df, "v"), [0.0, 1 / 3, 0.5, 1.0]) == pytest.approx(np.quantile(held, [0, 1 / 3, 0.5, 1]), rel=1e-12)
    assert stats.probit_scale(df.where("v is null"), "v").first()[0] is None
    assert stats.sigma_clip(df, "v", 50)["median"] == np.median(held)


def test_bandwidth_gathers_no_values(spark, no_percentile):
    held = np.array([i % 50 + (i % 7) / 10 for i in range(300)])
    df = spark.createDataFrame([(float(v),) for v in held], "v double")
    spread = min(held.std(ddof=1), (np.quantile(held, 0.75) - np.quantile(held, 0.25)) / 1.349)
    assert kde.bandwidth(df, "v") == pytest.approx(0.9 * spread * 300**-0.2, rel=1e-9)


def test_quantities_share_a_python_process(spark):
    df = spark.range(6000).select("id", (F.col("id") % 40 / 10).alias("z"))
    model = Cosmology(70, 0.3)
    out = model.with_columns(df, "z", ["age", "comoving", "hubble"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and out.columns == ["id", "z", "age", "comoving", "hubble"]
    found = out.toPandas()
    for q in ("age", "comoving", "hubble"):
        assert (found[q] == getattr(model, q)(found["z"].to_numpy())).all()
    assert out.where("z is null").isEmpty() and model.with_columns(df, "z", []).columns == ["id", "z"]


def test_nearest_meets_few_rows_however_dense(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, 0.5, 0.5) for i in range(400)] + [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400, 800)] + [(800, 40.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    met, whole = [], spatial.cross_pairs

    def counted(*args):
        out = whole(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "cross_pairs", counted)
    got = sorted(tuple(r) for r in spatial.knn(df, "id", ["x", "y"], 3, 2.0).collect())
    want = []
    for a, *p in rows:
        near = sorted((math.sqrt((p[0] - x) * (p[0] - x) + (p[1] - y) * (p[1] - y)), b) for b, x, y in rows if b != a)[:3]
        want += [(a, i + 1, b, d) for i, (d, b) in enumerate(near)]
    assert got == want
    # all pairs within the radius are over a quarter of a million
    assert sum(met) < 40_000
