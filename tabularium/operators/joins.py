"""Joins with merged keys, suffixes, cardinality requirements and match diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


class JoinError(ValueError):
    """A join that is refused."""


def _names(x: str | Sequence[str]) -> list[str]:
    return [n.strip() for n in x.split(",")] if isinstance(x, str) else list(x)


def _check(left: DataFrame, right: DataFrame, on: list[str], other_on: list[str], require: str, max_rows: int | None, how: str) -> None:
    """Counts of the keys on both sides, aggregated and then joined: refuses a matched key that repeats where it must not, or a result that is too large."""
    if require not in ("1:1", "1:m", "m:1", "m:m"):
        raise JoinError(f"unknown requirement {require!r}")
    if require == "m:m" and max_rows is None:
        return
    a = left.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(on)]).agg(F.count(F.lit(1)).alias("__a"))
    b = right.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(other_on)]).agg(F.count(F.lit(1)).alias("__b"))
    keys = [f"__k{i}" for i in range(len(on))]
    if max_rows is None:
        row = a.join(b, keys).agg(F.max("__a"), F.max("__b")).first()
    else:
        both = a.join(b, keys, "full").select("__a", "__b")
        a_n, b_n = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
        out = {
            "inner": a_n * b_n,
            "left": a_n * F.greatest(b_n, F.lit(1)),
            "right": F.greatest(a_n, F.lit(1)) * b_n,
            "outer": F.when(a_n == 0, b_n).when(b_n == 0, a_n).otherwise(a_n * b_n),
            "semi": F.when(b_n > 0, a_n).otherwise(0),
            "anti": F.when(b_n == 0, a_n).otherwise(0),
        }[how]
        hit = F.col("__a").isNotNull() & F.col("__b").isNotNull()
        row = both.agg(F.max(F.when(hit, F.col("__a"))), F.max(F.when(hit, F.col("__b"))), F.sum(out)).first()
        if (row[2] or 0) > max_rows:
            raise JoinError(f"the join has {row[2]} rows, more than {max_rows}")
    if require[0] == "1" and (row[0] or 0) > 1:
        raise JoinError(f"{require} is required, but a matched key repeats on the left")
    if require[2] == "1" and (row[1] or 0) > 1:
        raise JoinError(f"{require} is required, but a matched key repeats on the right")


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    other_on: str | Sequence[str] | None = None,
    how: str = "inner",
    columns: Sequence[str] | None = None,
    other_suffix: str = "_2",
    require: str = "m:m",
    order: str | None = None,
    max_rows: int | None = None,
    left_row: str | None = None,
    right_row: str | None = None,
    pairs: bool = False,
) -> DataFrame:
    """Equi-join. Null keys never match, NaN matches NaN, -0.0 matches 0.0.

    Keys of one name are merged (filled from the right where the left has none), clashing names get the suffix until they are free, key
    types have to be equal. ``order`` needs the row-number columns ``left_row`` and ``right_row``: "left" keeps left row order, then right,
    with unmatched right rows last; "key" sorts by key first. ``pairs`` adds ``pair`` and ``other_pair``, the row numbers or 0.
    """
    on = _names(on)
    other_on = _names(other_on) if other_on else on
    how = how.lower()
    if how not in _HOW:
        raise JoinError(f"unknown join {how!r}")
    if len(on) != len(other_on):
        raise JoinError("both sides need as many keys")
    if not other_suffix.strip():
        raise JoinError("the suffix is blank")
    for a, b in zip(on, other_on, strict=True):
        if left.schema[a].dataType != right.schema[b].dataType:
            raise JoinError(f"keys {a} and {b} are of different types")
    if (order or pairs) and (left_row is None or right_row is None and how not in ("semi", "anti")):
        raise JoinError("an order or pairs need row numbers")
    _check(left, right, on, other_on, require, max_rows, how)
    l, r = left.alias("__l"), right.alias("__r")
    lc, rc = lambda n: F.col(f"__l.`{n}`"), lambda n: F.col(f"__r.`{n}`")
    joined = l.join(r, reduce(Column.__and__, [lc(a) == rc(b) for a, b in zip(on, other_on, strict=True)]), _HOW[how])
    if how in ("semi", "anti"):
        if columns is not None:
            raise JoinError("a semi or anti join carries no columns")
        return joined.orderBy(F.col(left_row)) if order else joined
    merged = {a for a, b in zip(on, other_on, strict=True) if a == b}
    carried = [c for c in (right.columns if columns is None else columns) if c not in other_on or c not in merged]
    out, taken = [], set(left.columns)
    for c in left.columns:
        out.append(F.coalesce(lc(c), rc(c)).alias(c) if c in merged and how in ("right", "outer") else lc(c).alias(c))
    for c in carried:
        name = c
        while name in taken:
            name += other_suffix
        taken.add(name)
        out.append(rc(c).alias(name))
    if pairs:
        out += [F.coalesce(lc(left_row), F.lit(0)).alias("pair"), F.coalesce(rc(right_row), F.lit(0)).alias("other_pair")]
    if order == "left":
        joined = joined.orderBy(lc(left_row).asc_nulls_last(), rc(right_row).asc_nulls_last())
    elif order == "key":
        joined = joined.orderBy(*[F.coalesce(lc(a), rc(b)).asc_nulls_last() for a, b in zip(on, other_on, strict=True)], lc(left_row).asc_nulls_last(), rc(right_row).asc_nulls_last())
    elif order is not None:
        raise JoinError("order is left or key")
    return joined.select(*out)


def matched(left: DataFrame, right: DataFrame, on: str | Sequence[str], other_on: str | Sequence[str] | None = None, to: str = "matched") -> DataFrame:
    """Left rows with whether their key occurs on the right; the right side is reduced to its distinct keys first."""
    on = _names(on)
    other_on = _names(other_on) if other_on else on
    keys = right.select(*[F.col(f"`{b}`").alias(f"__k{i}") for i, b in enumerate(other_on)]).distinct().withColumn("__hit", F.lit(True))
    cond = reduce(Column.__and__, [F.col(f"`{a}`") == F.col(f"__k{i}") for i, a in enumerate(on)])
    return left.join(keys, cond, "left").withColumn(to, F.coalesce("__hit", F.lit(False))).drop("__hit", *[f"__k{i}" for i in range(len(on))])
