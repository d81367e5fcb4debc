"""Column, row, fill and conversion operations of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .sorting import ranged

_RANGE = {T.ByteType: (-(2**7), 2**7 - 1), T.ShortType: (-(2**15), 2**15 - 1), T.IntegerType: (-(2**31), 2**31 - 1), T.LongType: (-(2**63), 2**63 - 1)}


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(df, names)
    return df.select(*[F.col(f"`{n}`") for n in names])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require_columns(df, names)
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require_columns(df, [old])
    if new in df.columns:
        raise ValueError(f"a column {new} exists")
    return df.withColumnRenamed(old, new)


def add_column(df: DataFrame, name: str, value: Column, unit: str | None = None, force: bool = False) -> DataFrame:
    if name in df.columns and not force:
        raise ValueError(f"a column {name} exists")
    return df.withColumn(name, value) if unit is None else df.withColumn(name, value).withMetadata(name, {"unit": unit})


def matrix(df: DataFrame, names: Sequence[str], to: str) -> DataFrame:
    """Scalar columns as one vector column, whose width is kept as metadata."""
    return df.withColumn(to, F.array(*[F.col(f"`{n}`") for n in names])).withMetadata(to, {"width": len(names)})


def set_where(df: DataFrame, name: str, condition: Column, value) -> DataFrame:
    c = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(name, F.when(condition, c.cast(df.schema[name].dataType)).otherwise(F.col(f"`{name}`")))


def set_null(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return set_where(df, name, condition, F.lit(None))


def delete_rows(df: DataFrame, row: str, numbers: DataFrame | Sequence[int]) -> DataFrame:
    """Without the rows of the given numbers."""
    gone = numbers if isinstance(numbers, DataFrame) else df.sparkSession.createDataFrame([(int(n),) for n in numbers], "__n long")
    return df.join(gone.toDF("__n"), F.col(row) == F.col("__n"), "left_anti")


def truncate(df: DataFrame, row: str, n: int) -> DataFrame:
    return df.where(F.col(row) <= n)


def cast(df: DataFrame, name: str, kind: T.DataType, exact: bool = False) -> DataFrame:
    """Checked numeric cast: overflow, a fraction, a NaN or an infinity raise; lost digits only if ``exact``."""
    source, c = df.schema[name].dataType, F.col(f"`{name}`")
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{name}: {why}: "), c.cast("string"))).cast(kind)
    out = c.cast(kind)
    floats = (T.FloatType, T.DoubleType)
    if type(kind) in _RANGE:
        lo, hi = _RANGE[type(kind)]
        if isinstance(source, floats):
            d = c.cast("double")
            inside = (d >= float(lo)) & (d < float(hi) + (1.0 if hi < 2**53 else 0.0)) & ~F.isnan(d)
            out = F.when(c.isNull(), F.lit(None).cast(kind)).when(~inside, fail("out of range")).when(d != F.floor(F.when(inside, d)), fail("has a fraction")).otherwise(F.when(inside, d).cast(kind))
        elif isinstance(source, T.NumericType):
            out = F.when(c.isNull() | c.between(lo, hi), F.when(c.between(lo, hi), c).cast(kind)).otherwise(fail("out of range"))
    elif isinstance(kind, floats):
        if isinstance(kind, T.FloatType):
            over = (F.abs(c.cast("double")) > 3.4028234663852886e38) & (F.abs(c.cast("double")) < float("inf"))
            out = F.when(over, fail("out of range")).otherwise(c.cast(kind))
        if exact:
            back = c.cast(kind).cast("decimal(38,6)") != c.cast("decimal(38,6)") if isinstance(source, T.IntegralType) else (c.cast(kind).cast("double") != c.cast("double"))
            out = F.when(back, fail("loses digits")).otherwise(out)
    return df.withColumn(name, out)


def parse_column(df: DataFrame, name: str, kind: T.DataType, invalid: str = "error") -> DataFrame:
    """Text to numbers, dates or timestamps; the whole text has to be one."""
    c = F.col(f"`{name}`")
    strict = {
        T.IntegerType: r"^[+-]?\d+$", T.LongType: r"^[+-]?\d+$", T.DateType: r"^\d{4}-\d\d-\d\d$", T.TimestampNTZType: r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\d(\.\d{1,6})?)?$",
        T.DoubleType: r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$",
    }
    ok = c.rlike(strict[type(kind)]) if type(kind) in strict else F.lit(True)
    value = F.when(ok, c.try_cast(kind))
    if invalid == "error":
        value = F.when(c.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{name}: can't parse "), c)).cast(kind)).otherwise(value)
    elif invalid != "null":
        raise ValueError("invalid is error or null")
    return df.withColumn(name, value)


def format_column(df: DataFrame, name: str, pattern: str | None = None) -> DataFrame:
    """Numbers by a printf pattern, dates and timestamps by a date pattern, or the plain text form; null stays null."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if pattern is None:
        out = c.cast("string")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c, pattern)
    else:
        out = F.format_string(pattern, c)
    return df.withColumn(name, F.when(c.isNotNull(), out))


def explode_counts(df: DataFrame, counts: str, keep_empty: bool = True, origin: str | None = None, row: str | None = None) -> DataFrame:
    """Each row as often as its count says; null and 0 count once if ``keep_empty``, else not at all; a negative count raises."""
    n = F.col(f"`{counts}`")
    times = F.when(n < 0, F.raise_error(F.lit("a count is negative")).cast("int")).otherwise(F.greatest(F.coalesce(n, F.lit(0)).cast("int"), F.lit(1 if keep_empty else 0)))
    out = df if origin is None else df.withColumn(origin, F.col(row))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).drop("__copy")


def append(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Union of rows by name: missing columns are null, an extra or differently typed column is refused."""
    for f in bottom.schema:
        if f.name not in top.columns:
            raise ValueError(f"the table has no column {f.name}")
        if top.schema[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name} is of another type")
    return top.unionByName(bottom, allowMissingColumns=True).select(*top.columns)


def append_null_rows(df: DataFrame, n: int) -> DataFrame:
    nulls = df.sparkSession.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.union(nulls)


def clone_structure(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def _filler(value: Column):
    return lambda x: F.coalesce(x, value)


def fillna(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Typed fill of nulls, element-wise in vectors; a NaN is a value and stays."""
    new = {}
    for name, v in values.items():
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, T.ArrayType):
            new[name] = F.transform(c, _filler(F.lit(v).cast(kind.elementType)))
        else:
            new[name] = F.coalesce(c, F.lit(v).cast(kind))
    return df.withColumns(new)


def dropna(df: DataFrame, names: Sequence[str] | None = None, how: str = "any", min_valid: int | None = None) -> DataFrame:
    names = list(names or df.columns)
    need = min_valid if min_valid is not None else {"any": len(names), "all": 1}[how]
    return df.where(reduce(Column.__add__, [F.col(f"`{n}`").isNotNull().cast("int") for n in names]) >= need)


def _fill(df: DataFrame, name: str, row: str, by: Sequence[str], limit: int | None, back: bool) -> DataFrame:
    c, r = F.col(f"`{name}`"), F.col(row)
    if not by:
        return _fill_all(df, name, row, limit, back)
    w = Window.partitionBy(*by).orderBy(r.desc() if back else r.asc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(c, ignorenulls=True).over(upto)
    if limit is None:
        return df.withColumn(name, value)
    place = F.row_number().over(w)
    seen = df.withColumn("__place", place)
    last = F.last(F.when(c.isNotNull(), F.col("__place")), ignorenulls=True).over(upto)
    return seen.withColumn(name, F.when(F.col("__place") - last <= limit, value)).drop("__place")


def _fill_all(df: DataFrame, name: str, row: str, limit: int | None, back: bool) -> DataFrame:
    """The fill of a whole table: within range partitions, with the last value, and its place, carried over from the partitions before."""
    c, r = F.col(f"`{name}`"), F.col(row)
    along = r.desc() if back else r.asc()
    inside = Window.partitionBy("__part").orderBy(along)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    held = ranged(df, [along]).withColumn("__place", F.row_number().over(inside))
    full = F.when(c.isNotNull(), F.col("__place"))
    parts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.max(full).alias("__last"), F.max_by(c, full).alias("__value"))
    order = Window.orderBy("__part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    spread = parts.withColumn("__start", F.sum("__n").over(order) - F.col("__n"))
    carried = spread.select("__part", "__start", F.last("__value", ignorenulls=True).over(earlier).alias("__carried"), F.last(F.col("__start") + F.col("__last"), ignorenulls=True).over(earlier).alias("__from"))
    joined = held.withColumn("__own", F.last(c, ignorenulls=True).over(upto)).withColumn("__at", F.last(full, ignorenulls=True).over(upto)).join(F.broadcast(carried), "__part")
    value = F.coalesce("__own", "__carried")
    if limit is not None:
        away = F.col("__start") + F.col("__place") - F.coalesce(F.col("__start") + F.col("__at"), F.col("__from"))
        value = F.when(away <= limit, value)
    return joined.withColumn(name, value).drop("__part", "__place", "__start", "__own", "__at", "__carried", "__from")


def ffill(df: DataFrame, name: str, row: str, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Nulls take the last value before them in row order, within groups of ``by``, at most ``limit`` in a run."""
    return _fill(df, name, row, by, limit, False)


def bfill(df: DataFrame, name: str, row: str, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    return _fill(df, name, row, by, limit, True)
