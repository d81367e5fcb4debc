"""Text, path and small numeric helpers, as columns.

Case, trimming and comparison are of bytes: only A-Z and a-z change case, only spaces are trimmed. Paths follow the rules of
POSIX: the last slash parts directory and name, and a name's leading dots begin no extension. Null gives null throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_SMALL, _CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A directory with its slashes, and the name.
_PATH = r"(?s)^(.*/)?([^/]*)$"
#: A name's stem, with its leading dots, and the extension.
_NAME = r"(?s)^(\.*[^.].*?|\.*)(\.[^.]*)?$"


def to_lower(c: Column) -> Column:
    return F.translate(c, _CAPITAL, _SMALL)


def to_upper(c: Column) -> Column:
    return F.translate(c, _SMALL, _CAPITAL)


def strip(c: Column) -> Column:
    return F.trim(c)


def trim_end(c: Column) -> Column:
    return F.rtrim(c)


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def find(df: DataFrame, name: str, text: str, row: str, last: bool = False) -> int | None:
    """The first, or last, row that holds exactly this text; None if none does."""
    return df.where(F.col(f"`{name}`") == F.lit(text)).agg((F.max if last else F.min)(row)).first()[0]


def summary(df: DataFrame, name: str) -> DataFrame:
    """One row: ``n, n_null, n_empty, characters, shortest, longest``, lengths in bytes."""
    c = F.col(f"`{name}`")
    size = F.octet_length(c)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("n_null"), F.count_if(size == 0).alias("n_empty"),
        F.coalesce(F.sum(size.cast("long")), F.lit(0).cast("long")).alias("characters"), F.min(size).alias("shortest"), F.max(size).alias("longest"),
    )


def dirname(c: Column) -> Column:
    """What stands before the last slash, without its own closing slashes unless there is nothing else."""
    head = F.regexp_extract(c, _PATH, 1)
    return F.when(head.rlike("^/*$"), head).otherwise(F.regexp_replace(head, "/+$", ""))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, _PATH, 2)


def path_ext(c: Column) -> Column:
    """The name's extension with its dot, or nothing."""
    return F.regexp_extract(basename(c), _NAME, 2)


def path_stem(c: Column) -> Column:
    return F.regexp_extract(basename(c), _NAME, 1)


def split_path(c: Column) -> dict[str, Column]:
    return {"directory": dirname(c), "stem": path_stem(c), "extension": path_ext(c)}


def path_add_suffix(c: Column, suffix: str) -> Column:
    """The suffix goes in before the extension."""
    return F.concat(F.regexp_extract(c, _PATH, 1), path_stem(c), F.lit(suffix), path_ext(c))


def join_path(first: Column, *parts: Column) -> Column:
    """Parts with one slash between them; a part that begins with a slash starts anew."""
    out = first
    for p in parts:
        out = F.when(p.startswith("/"), p).when((out == "") | out.endswith("/"), F.concat(out, p)).otherwise(F.concat(out, F.lit("/"), p))
    return out


def safe_div(a: Column, b: Column) -> Column:
    """The IEEE quotient: infinite or NaN where the divisor is zero."""
    a, b = a.cast("double"), b.cast("double")
    sign = F.when(F.isnan(a) | (a == 0), float("nan")).when((a > 0) == F.coalesce(~b.cast("string").startswith("-"), F.lit(True)), float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, F.when(a.isNotNull(), sign)).otherwise(F.try_divide(a, b))


def wrap_rad(x: Column) -> Column:
    """To [0, 2 pi)."""
    r = F.pmod(x, F.lit(2 * math.pi))
    return F.when(r >= 2 * math.pi, 0.0).otherwise(r)


def wrap_pi(x: Column) -> Column:
    """To [-pi, pi)."""
    r = wrap_rad(x)
    return F.when(r >= math.pi, r - 2 * math.pi).otherwise(r)


def cross_product(a: Column, b: Column) -> Column:
    """Of two arrays of three numbers."""
    x, y = [F.get(a, F.lit(i)) for i in range(3)], [F.get(b, F.lit(i)) for i in range(3)]
    return F.array(*[x[i] * y[j] - x[j] * y[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def norm_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


@F.pandas_udf(T.DoubleType())
def _upper_tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for z in batches:
        yield z.map(lambda v: math.erfc(v / math.sqrt(2)) / 2, na_action="ignore")


def norm_sf(z: Column) -> Column:
    """The share of a normal distribution above z."""
    return _upper_tail(z.cast("double"))


def norm_cdf(z: Column) -> Column:
    """The share below z."""
    return _upper_tail(-z.cast("double"))
