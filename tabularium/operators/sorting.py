"""Ordering with absolute tiers (values, then NaN, then null, whatever the direction), ranks and selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut, shuffle_partitions

MAX_KEYS, MAX_KEY = 16, 320


def parse_keys(keys: str | Sequence[str]) -> list[tuple[str, bool, bool]]:
    """(name, descending, nulls first) of "ra", "dec desc", "-dec", "x nulls_first"."""
    out = []
    for key in keys.split(",") if isinstance(keys, str) else keys:
        if len(key) > MAX_KEY:
            raise ValueError(f"a sort key has at most {MAX_KEY} characters")
        name, *words = key.split()
        descending = name.startswith("-")
        for w in map(str.lower, words):
            if w not in ("asc", "desc", "nulls_first", "nulls_last"):
                raise ValueError(f"unknown sort option {w!r}")
            descending |= w == "desc"
        out.append((name.lstrip("-"), descending, "nulls_first" in map(str.lower, words)))
    if not 1 <= len(out) <= MAX_KEYS:
        raise ValueError(f"between 1 and {MAX_KEYS} sort keys are needed")
    return out


def order(df: DataFrame, keys: str | Sequence[str]) -> list[Column]:
    """Sort columns. NaN has a tier of its own only in floating-point columns; ascending order has it last already."""
    out: list[Column] = []
    for name, descending, first in parse_keys(keys):
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.FloatType, T.DoubleType)) and descending:
            out += [c.isNull().desc() if first else c.isNull().asc(), F.coalesce(F.isnan(c), F.lit(False)).asc(), c.desc()]
        else:
            out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def sort_by(df: DataFrame, keys: str | Sequence[str], tie: str | None = None) -> DataFrame:
    """Globally sorted; ``tie`` names a row number that makes the order stable."""
    return df.orderBy(*order(df, keys), *([F.col(tie)] if tie else []))


def top_n(df: DataFrame, keys: str | Sequence[str], n: int, tie: str | None = None) -> DataFrame:
    """The first n rows of the order, without a full sort."""
    return sort_by(df, keys, tie).limit(max(0, n))


def ranged(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """The rows in range partitions of the keys, numbered in ``__part``; stored, so that every later use sees the same partitions."""
    return cut(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("__part", F.spark_partition_id()))


def argsort(df: DataFrame, keys: str | Sequence[str], row: str, name: str = "position") -> DataFrame:
    """Each row's 1-based place in the order: places within range partitions plus the sizes of those before."""
    held = ranged(df, [*order(df, keys), F.col(row)])
    inside = Window.partitionBy("__part").orderBy(*order(df, keys), F.col(row))
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = held.withColumn("__nth", F.row_number().over(inside)).join(F.broadcast(before), "__part")
    return placed.withColumn(name, (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__nth", "__before")


def is_sorted_by(df: DataFrame, keys: str | Sequence[str], row: str) -> bool:
    """Whether the rows, in the order of ``row``, are in the order of the keys: positions agree everywhere."""
    a = argsort(df, keys, row, "__a").select(row, "__a")
    b = argsort(df, [row], row, "__b").select(F.col(row).alias("__row"), "__b")
    return a.join(b, F.col(row) == F.col("__row")).where("__a != __b").isEmpty()


def rank(df: DataFrame, name: str, method: str = "competition", to: str = "rank", by: Sequence[str] = (), row: str | None = None) -> DataFrame:
    """Ranks of a column's values, within groups of ``by``; a null has rank 0, NaN comes last.

    Without groups the ranks come from the counts of the distinct values, so neither the table nor a frequent value is held by one task.
    """
    if method not in ("competition", "dense", "average", "ordinal"):
        raise ValueError(f"unknown method {method!r}")
    if not by:
        return _rank_all(df, name, method, to, row)
    c, null = F.col(name), F.col(name).isNull()
    w = Window.partitionBy(*by, null)
    if method == "ordinal":
        if row is None:
            raise ValueError("ordinal ranks need a row number for ties")
        value = F.row_number().over(w.orderBy(c.asc(), F.col(row)))
    elif method in ("competition", "dense"):
        value = (F.rank() if method == "competition" else F.dense_rank()).over(w.orderBy(c.asc()))
    else:
        value = F.rank().over(w.orderBy(c.asc())) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    return df.withColumn(to, F.when(null, F.lit(0)).otherwise(value))


def nth_element(df: DataFrame, name: str, k: int) -> DataFrame:
    """The k-th smallest non-null value, as one row."""
    return sort_by(df.where(F.col(name).isNotNull()).select(name), [name]).limit(k).orderBy(F.col(name).desc()).limit(1)


def _rank_all(df: DataFrame, name: str, method: str, to: str, row: str | None) -> DataFrame:
    c = F.col(f"`{name}`")
    if method == "ordinal":
        if row is None:
            raise ValueError("ordinal ranks need a row number for ties")
        return argsort(df, [name], row, to).withColumn(to, F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.col(to)))
    counts = df.where(c.isNotNull()).groupBy(c.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    held = ranged(counts, [F.col("__v").asc()])
    totals = held.groupBy("__part").agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__values"))
    upto = Window.orderBy("__part")
    before = totals.select("__part", (F.sum("__rows").over(upto) - F.col("__rows")).alias("__b"), (F.sum("__values").over(upto) - F.col("__values")).alias("__d"))
    inside = Window.partitionBy("__part").orderBy(F.col("__v").asc())
    first = F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    placed = held.withColumn("__first", first).withColumn("__nth", F.row_number().over(inside)).join(F.broadcast(before), "__part")
    at = F.col("__b") + F.col("__first") + 1
    value = {"competition": at, "dense": F.col("__d") + F.col("__nth"), "average": at + (F.col("__n") - 1) / 2}[method]
    found = placed.select("__v", value.alias(to))
    return df.drop(to).join(found, c.eqNullSafe(F.col("__v")), "left").withColumn(to, F.coalesce(F.col(to), F.lit(0))).drop("__v")


def nth_quantile(df: DataFrame, name: str, q: float, rounding: str = "floor") -> DataFrame:
    """The element at place q of the sorted non-null values, as one row: (n - 1) * q rounded down, up or to the nearest; never a mean of two."""
    rules = {"floor": math.floor, "ceil": math.ceil, "nearest": round}
    if rounding not in rules or not 0 <= q <= 1:
        raise ValueError("rounding is floor, ceil or nearest, and q lies between 0 and 1")
    n = df.where(F.col(f"`{name}`").isNotNull()).count()
    return nth_element(df, name, rules[rounding]((n - 1) * q) + 1) if n else df.select(name).limit(0)


def unique(df: DataFrame, name: str) -> DataFrame:
    """The distinct non-null values in order; all NaNs are one value and come last."""
    return df.where(F.col(f"`{name}`").isNotNull()).select(name).distinct().orderBy(F.col(f"`{name}`").asc())


def unique_count(df: DataFrame, name: str) -> DataFrame:
    """How many distinct non-null values there are, as one row."""
    return df.where(F.col(f"`{name}`").isNotNull()).select(name).distinct().agg(F.count(F.lit(1)).alias("n"))


def merge(left: DataFrame, right: DataFrame, keys: str | Sequence[str], row: str) -> DataFrame:
    """The rows of both, sorted; on ties the left side's come first, each side's by ``row``. ``side`` is 0 or 1."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return both.orderBy(*order(both, keys), "side", row)
