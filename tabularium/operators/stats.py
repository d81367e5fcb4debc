"""Statistics of a column: moments, robust measures, relations, bins and running folds.

Nulls leave the population, NaN is skipped unless ``skipnan`` is false, a zero weight removes its row, and a statistic without
an answer is null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import norm_cdf
from .grouping import MAD_SCALE, valid
from .sorting import argsort, ranged


def population(df: DataFrame, name: str, weight: str | None = None, skipnan: bool = True) -> DataFrame:
    """``x, w`` of the rows that take part."""
    x = valid(df, name) if skipnan else F.col(f"`{name}`").cast("double")
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    return df.select(x.alias("x"), w.alias("w")).where("x is not null and w > 0")


def describe(df: DataFrame, name: str, weight: str | None = None, ddof: float = 1, frequency: bool = False, skipnan: bool = True) -> DataFrame:
    """One row: count, sum, mean, var, std, sem, skewness, kurtosis, min, max (bias-corrected, excess kurtosis), and the counts of nulls and NaNs.

    Spark's own moments are one-pass and mergeable; weighted sums are taken about the mean in a second pass.
    """
    c = F.col(f"`{name}`")
    nan = F.isnan(c.cast("double"))
    excluded = df.agg(F.count_if(c.isNull()).alias("n_null"), F.count_if(nan).alias("n_nan"))
    p = population(df, name, weight, skipnan)
    if weight is None:
        n = F.count("x")
        g1, g2 = F.skewness("x"), F.kurtosis("x")
        var = F.var_pop("x") * n / F.when(n > ddof, n - ddof)
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        out = p.agg(n.alias("count"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("sum"), F.avg("x").alias("mean"), var.alias("var"), F.sqrt(var).alias("std"), F.sqrt(var / n).alias("sem"), skew.alias("skewness"), kurt.alias("kurtosis"), F.min("x").alias("min"), F.max("x").alias("max"))
    else:
        s = p.agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"))
        d = p.join(F.broadcast(s)).select("w", (F.col("x") - F.col("m")).alias("d"))  # one row of totals beside each row
        m2 = d.agg(F.sum(F.col("w") * F.col("d") * F.col("d")).alias("m2"))
        free = F.col("s") - F.lit(ddof) * (F.lit(1.0) if frequency else F.col("ss") / F.col("s"))
        var = F.col("m2") / F.when(free > 0, free)
        out = s.join(m2).select("count", (F.col("s") * F.col("m")).alias("sum"), F.col("m").alias("mean"), var.alias("var"), F.sqrt(var).alias("std"), (F.sqrt(var / F.col("s")) if frequency else F.sqrt(var * F.col("ss")) / F.col("s")).alias("sem"), "min", "max")
    return out.join(excluded)


def means(df: DataFrame, name: str) -> DataFrame:
    """Geometric and harmonic mean of positive values; null if a value is not positive."""
    p = population(df, name)
    ok = F.min("x") > 0
    return p.agg(F.when(ok, F.exp(F.avg(F.log(F.when(F.col("x") > 0, F.col("x")))))).alias("gmean"), F.when(ok, F.count("x") / F.sum(1 / F.when(F.col("x") > 0, F.col("x")))).alias("hmean"))


def quantiles(df: DataFrame, name: str, qs: Sequence[float], method: str = "linear") -> DataFrame:
    """``q, value``: positions picked from a distributed sort, never from one task's list; the linear rule weighs two of them. Null without values."""
    return _picked(population(df, name).select("x"), qs, method)


def _picked(p: DataFrame, qs: Sequence[float], method: str = "linear") -> DataFrame:
    n = p.count()
    if not n:
        return p.sparkSession.createDataFrame([(float(q), None) for q in qs], "q double, value double")
    need: dict[float, list[tuple[int, float]]] = {}
    for q in qs:
        at = (n - 1) * q
        lo, hi = math.floor(at), math.ceil(at)
        need[q] = {
            "linear": [(lo, 1 - (at - lo)), (hi, at - lo)] if hi > lo else [(lo, 1.0)], "lower": [(lo, 1.0)], "higher": [(hi, 1.0)], "midpoint": [(lo, 0.5), (hi, 0.5)],
            "nearest": [(round(at), 1.0)], "inverted_cdf": [(max(math.ceil(n * q) - 1, 0), 1.0)],
        }[method]
    spots = p.sparkSession.createDataFrame([(float(q), i + 1, w) for q, v in need.items() for i, w in v], "q double, place long, share double")
    placed = argsort(p.withColumn("r", F.monotonically_increasing_id()), ["x"], "r", "place")
    return placed.join(F.broadcast(spots), "place").groupBy("q").agg(F.sum(F.col("x") * F.col("share")).alias("value"))


def percentiles(p: DataFrame, qs: Sequence[float]) -> list[float | None]:
    """Exact quantiles of ``x`` by the linear rule; None without values.

    Equal values are counted, the counts range-partitioned, and only the partitions that hold a wanted place are summed up in order. ``F.percentile``
    sends every task's distinct values to one aggregate.
    """
    parts = ranged(p.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n")), [F.col("x")])
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("__part").agg(F.sum("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return [None for _ in qs]
    spots = {i for q in qs for i in (math.floor((total - 1) * q), math.ceil((total - 1) * q))}
    held, before = [], 0
    for part, n in sizes:
        held += [(part, i, i - before) for i in spots if before <= i < before + n]
        before += n
    wanted = p.sparkSession.createDataFrame(held, "__part int, spot long, place long")
    upto = F.sum("n").over(Window.partitionBy("__part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    run = parts.where(F.col("__part").isin(sorted({h[0] for h in held}))).withColumn("upto", upto)
    found = run.join(F.broadcast(wanted), "__part").where("place < upto and place >= upto - n")
    at = {r["spot"]: r["x"] for r in found.select("spot", "x").collect()}
    out = []
    for q in qs:
        place = (total - 1) * q
        lo, hi = math.floor(place), math.ceil(place)
        out.append(at[lo] if lo == hi or at[lo] == at[hi] else (hi - place) * at[lo] + (place - lo) * at[hi])
    return out


def weighted_quantile(df: DataFrame, name: str, weight: str, q: float) -> DataFrame:
    """The least value at which the cumulative weight reaches q of the total: equal values are merged first, and sums run within range partitions."""
    p = population(df, name, weight).groupBy("x").agg(F.sum("w").alias("w"))
    parts = ranged(p, [F.col("x")]).withColumnRenamed("__part", "p")
    sums = parts.groupBy("p").agg(F.sum("w").alias("s"))
    before = sums.select("p", (F.sum("s").over(Window.orderBy("p")) - F.col("s")).alias("b"), F.sum("s").over(Window.partitionBy()).alias("total"))
    run = F.sum("w").over(Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    reached = parts.withColumn("r", run).join(F.broadcast(before), "p").where(F.col("b") + F.col("r") >= F.lit(q) * F.col("total") * (1 - 1e-12))
    return reached.agg(F.min("x").alias("value"))


def mad(df: DataFrame, name: str, scaled: bool = True, center: float | None = None) -> DataFrame:
    p = population(df, name)
    if center is None:
        p = p.join(F.broadcast(_picked(p.select("x"), [0.5]).select(F.col("value").alias("m"))))
    else:
        p = p.withColumn("m", F.lit(center))
    away = _picked(p.select(F.abs(F.col("x") - F.col("m")).alias("x")), [0.5])
    return away.select((F.col("value") * F.lit(MAD_SCALE if scaled else 1.0)).alias("mad"))


def mode(df: DataFrame, name: str) -> DataFrame:
    """The most frequent value, ties to the smallest."""
    return population(df, name).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").limit(1).select(F.col("x").alias("mode"), "n")


def trim_mean(df: DataFrame, name: str, fraction: float) -> DataFrame:
    """Mean without the floor(fraction * n) least and greatest values."""
    p = population(df, name).select("x")
    n = p.count()
    k = int(fraction * n)
    placed = argsort(p.withColumn("r", F.monotonically_increasing_id()), ["x"], "r", "place")
    return placed.where(F.col("place").between(k + 1, n - k)).agg(F.avg("x").alias("trim_mean"))


def percentile_of_score(df: DataFrame, name: str, score: float) -> DataFrame:
    """Percentage of values below the score, those equal to it counted half."""
    x = F.col("x")
    return population(df, name).agg((F.avg(F.when(x < score, 1.0).when(x == score, 0.5).otherwise(0.0)) * 100).alias("percentile"))


def sigma_clip(df: DataFrame, name: str, sigma: float = 3.0, max_rounds: int = 10) -> dict:
    """Mean, median and standard deviation of what lies within sigma deviations of the median, repeated until it holds."""
    p, lo, hi, last = population(df, name).select("x"), -math.inf, math.inf, None
    for rounds in range(max_rounds + 1):
        inside = p.where(F.col("x").between(lo, hi))
        r = inside.agg(F.count("x"), F.avg("x"), F.stddev_pop("x")).first()
        r = [r[0], r[1], percentiles(inside, [0.5])[0], r[2]]
        if not r[0] or r[0] == last or rounds == max_rounds:
            return {"count": r[0], "mean": r[1], "median": r[2], "std": r[3], "rounds": rounds}
        last, lo, hi = r[0], max(lo, r[2] - sigma * r[3]), min(hi, r[2] + sigma * r[3])


def midranks(df: DataFrame, name: str, to: str) -> DataFrame:
    """Average ranks. Equal values are counted first, and the running total over distinct values runs within range partitions."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    parts = ranged(counts, [F.col("__x")]).withColumnRenamed("__part", "__p")
    sums = parts.groupBy("__p").agg(F.sum("__n").alias("__s"))
    before = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__b"))
    run = F.sum("__n").over(Window.partitionBy("__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    ranks = parts.withColumn("__r", run).join(F.broadcast(before), "__p").select("__x", (F.col("__b") + F.col("__r") - (F.col("__n") - 1) / 2).alias(to))
    return df.join(ranks, F.col(name).eqNullSafe(F.col("__x")), "left").drop("__x")


def relate(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """Covariance and correlation over the rows where both are values."""
    both = df.select(valid(df, a).alias("a"), valid(df, b).alias("b")).where("a is not null and b is not null")
    if method == "spearman":
        both = midranks(midranks(both, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    return both.agg(F.covar_samp("a", "b").alias("cov"), F.corr("a", "b").alias("corr"))


@F.pandas_udf(T.DoubleType())
def probit(p: pd.Series) -> pd.Series:
    """Inverse of the normal distribution function."""
    inv = NormalDist().inv_cdf
    return p.map(lambda q: inv(q) if q is not None and 0 < q < 1 else float("nan") if q is None or not 0 <= q <= 1 else math.copysign(math.inf, q - 0.5))


def normal_scores(df: DataFrame, name: str, to: str = "score", offset: float = 0.375) -> DataFrame:
    """Blom's scores by default: probit((rank - offset) / (n + 1 - 2 * offset)) of the midranks."""
    n = df.where(F.col(name).isNotNull()).count()
    return midranks(df, name, "__rank").withColumn(to, probit((F.col("__rank") - offset) / (n + 1 - 2 * offset))).drop("__rank")


def probit_mean(df: DataFrame, name: str, weight: str | None = None) -> DataFrame:
    """Mean of probabilities on the probit scale: the normal share below the weighted mean of their quantiles.

    A certain 0 or 1 gives that, both of them or a value outside 0 to 1 a NaN, no value null.
    """
    z = population(df, name, weight).select(probit(F.col("x")).alias("z"), "w")
    row = z.agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("m"))
    return row.select(norm_cdf(F.col("m")).alias("probit_mean"))


def probit_fit(df: DataFrame, name: str, offset: float = 0.375) -> DataFrame:
    """``loc, sigma, corr``: the least-squares line of the sorted values over the normal scores of their places.

    Equal values take consecutive places, so a value that occurs often is summed over its places: the places of all rows come from one
    range-partitioned order.
    """
    p = population(df, name).select("x", F.monotonically_increasing_id().alias("row"))
    placed = argsort(p, ["x"], "row", "r")
    n = placed.count()
    scored = placed.select("x", probit((F.col("r") - offset) / (n + 1 - 2 * offset)).alias("z"))
    return scored.agg(F.regr_intercept("x", "z").alias("loc"), F.regr_slope("x", "z").alias("sigma"), F.corr("x", "z").alias("corr"))


def probit_scale(df: DataFrame, name: str, prob: float = 0.25) -> DataFrame:
    """Standard deviation by two quantiles: their distance over that of the normal distribution's."""
    if not 0 < prob < 0.5:
        raise ValueError("prob lies between 0 and 0.5")
    wide = -2 * NormalDist().inv_cdf(prob)
    low, high = percentiles(population(df, name), [prob, 1 - prob])
    return df.sparkSession.createDataFrame([(None if low is None else (high - low) / wide,)], "sigma double")


def bucket(x: Column, edges: Sequence[float], right: bool = False) -> Column:
    """1-based bin of a value, 0 for none; bins are closed below (the last also above), or mirrored if ``right``."""
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges increase strictly, and there are two at least")
    e = F.array(*[F.lit(float(v)) for v in edges])
    n = len(edges) - 1
    if len(edges) > 3 and all(abs((b - a) - (edges[1] - edges[0])) <= 1e-12 * abs(edges[-1] - edges[0]) for a, b in zip(edges, edges[1:], strict=False)) and not any(map(math.isinf, edges)):
        near = F.floor((x - edges[0]) / ((edges[-1] - edges[0]) / n)).cast("int") + 1  # then put right by its own edges
        near = F.least(F.greatest(near, F.lit(1)), F.lit(n))
        at = lambda i: F.element_at(e, i)
        if right:
            code = near + F.when(x <= at(near), -1).when(x > at(near + 1), 1).otherwise(0)
        else:
            code = near + F.when(x < at(near), -1).when(x >= at(near + 1), 1).otherwise(0)
        code = F.least(F.greatest(code, F.lit(1)), F.lit(n))
    else:
        code = F.aggregate(e, F.lit(0), lambda acc, v: acc + (v < x if right else v <= x).cast("int"))
        code = F.least(F.greatest(code, F.lit(1)), F.lit(n))
    inside = (x >= edges[0]) & (x <= edges[-1]) & ~F.isnan(x)
    return F.when(inside, code).otherwise(0)


def histogram(df: DataFrame, name: str, edges: Sequence[float], right: bool = False, density: bool = False, weight: str | None = None) -> DataFrame:
    """``bin, lower, upper, value`` for every bin, the empty ones too."""
    p = population(df, name, weight)
    counts = p.select(bucket(F.col("x"), edges, right).alias("bin"), "w").where("bin > 0").groupBy("bin").agg(F.sum("w").alias("n"))
    bins = df.sparkSession.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lower double, upper double")
    out = bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    if density:
        total = counts.agg(F.sum("n").alias("__t"))
        out = out.join(F.broadcast(total)).withColumn("n", F.col("n") / F.col("__t") / (F.col("upper") - F.col("lower")))
    return out.select("bin", "lower", "upper", F.col("n").alias("value"))


def bin_edges(df: DataFrame, name: str, bins: int) -> list[float]:
    lo, hi = population(df, name).agg(F.min("x"), F.max("x")).first()
    if lo is None:
        raise ValueError("no value to lay edges over")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]


def bin_linear(df: DataFrame, name: str, lo: float, hi: float, cells: int) -> DataFrame:
    """Cloud-in-cell deposit: each value is shared between the two nearest cell centres."""
    width = (hi - lo) / cells
    u = (F.col("x") - lo) / width - 0.5
    k = F.floor(u)
    parts = population(df, name).where(F.col("x").between(lo, hi)).select("w", k.alias("k"), (u - k).alias("f"))
    shares = parts.select(F.explode(F.array(F.struct(F.col("k").alias("c"), (F.col("w") * (1 - F.col("f"))).alias("v")), F.struct((F.col("k") + 1).alias("c"), (F.col("w") * F.col("f")).alias("v")))).alias("z"))
    return shares.select((F.least(F.greatest(F.col("z.c"), F.lit(0)), F.lit(cells - 1)) + 1).cast("int").alias("cell"), F.col("z.v").alias("v")).groupBy("cell").agg(F.sum("v").alias("value"))


def running(df: DataFrame, name: str, kind: str, row: str, to: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative sum, prod, max or min in row order within groups; an excluded element is null and the fold goes on past it.

    Without groups the fold runs within range partitions and takes on the folds of those before.
    """
    x = valid(df, name)
    fold = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}[kind]
    if not by:
        held = ranged(df.withColumn("__x", x), [F.col(row)])
        parts = held.groupBy("__part").agg(fold("__x").alias("__f"))
        before = parts.select("__part", fold("__f").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
        upto = Window.partitionBy("__part").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
        own = held.withColumn("__f", F.when(F.col("__x").isNotNull(), fold("__x").over(upto))).join(F.broadcast(before), "__part")
        f, b = F.col("__f"), F.col("__b")
        joined = {"sum": f + F.coalesce(b, F.lit(0.0)), "prod": f * F.coalesce(b, F.lit(1.0)), "max": F.greatest(f, b), "min": F.least(f, b)}[kind]
        return own.withColumn(to, F.when(f.isNotNull(), joined)).drop("__part", "__x", "__f", "__b")
    w = Window.partitionBy(*by).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.when(x.isNotNull(), fold(x).over(w)))


def zscore(df: DataFrame, name: str, to: str, ddof: int = 1) -> DataFrame:
    x = valid(df, name)
    s = df.agg(F.avg(x).alias("__m"), (F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)).alias("__s"))
    return df.join(F.broadcast(s)).withColumn(to, (x - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s"))).drop("__m", "__s")
