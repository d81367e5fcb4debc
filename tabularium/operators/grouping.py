"""Grouping and the statistics vocabulary of groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Fixed value: turns a median absolute deviation into a standard deviation of a normal sample.
MAD_SCALE = 1.4826022185056018

STATS = {"size", "count", "sum", "mean", "var", "std", "sem", "min", "max", "range", "median", "quantile", "iqr", "mad", "first", "last", "nunique"}
EXACT = {"size", "count", "nunique", "sum", "min", "max", "first", "last"}
_KEEPS_UNIT = {"sum", "mean", "min", "max", "range", "median", "quantile", "iqr", "mad", "std", "sem", "first", "last"}
_TAKES = {"q": {"quantile"}, "method": {"median", "quantile", "iqr"}, "ddof": {"var", "std", "sem"}, "scale": {"mad"}}


def valid(df: DataFrame, name: str) -> Column:
    """The column as a double without NaN (null instead)."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} is neither numeric nor boolean")
    return F.when(~F.isnan(c), c.cast("double")) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.cast("double")


def quantile(x: Column, q: float, method: str = "linear") -> Column:
    """Aggregate: a quantile of the non-null values by one of six rules."""
    if not 0 <= q <= 1:
        raise ValueError("q lies between 0 and 1")
    if method == "linear":
        return F.percentile(x, F.lit(q))
    held = F.sort_array(F.collect_list(x))
    at = (F.size(held) - 1) * F.lit(q)
    pick = lambda i: F.get(held, i.cast("int"))
    if method == "lower":
        return pick(F.floor(at))
    if method == "higher":
        return pick(F.ceil(at))
    if method == "midpoint":
        return (pick(F.floor(at)) + pick(F.ceil(at))) / 2
    if method == "nearest":
        return pick(F.rint(at))
    if method == "inverted_cdf":
        return pick(F.greatest(F.ceil(F.size(held) * F.lit(q)) - 1, F.lit(0)))
    raise ValueError(f"unknown method {method!r}")


class Grouping:
    """Groups by key columns; a null in any key drops the row unless ``dropna`` is false."""

    def __init__(self, df: DataFrame, keys: str | Sequence[str], dropna: bool = True, row: str | None = None):
        self.keys = [k.strip() for k in keys.split(",")] if isinstance(keys, str) else list(keys)
        self.all, self.row, self.dropna = df, row, dropna
        some = [F.col(f"`{k}`").isNotNull() for k in self.keys]
        self.df = df.where(reduce(Column.__and__, some)) if dropna else df

    def ordered(self, out: DataFrame) -> DataFrame:
        """Groups by key: values, NaN, null."""
        return out.orderBy(*[F.col(f"`{k}`").asc_nulls_last() for k in self.keys])

    def stat(self, name: str | None, stat: str, exact: bool = False, weight: str | None = None, **options) -> Column:
        """The aggregate column of a statistic, without its refusals' data checks."""
        if stat not in STATS:
            raise ValueError(f"unknown statistic {stat!r}")
        for option, value in options.items():
            if value is not None and stat not in _TAKES.get(option, ()):
                raise ValueError(f"{stat} does not take {option}")
        if exact:
            if stat not in EXACT or weight or any(v is not None for v in options.values()):
                raise ValueError(f"{stat} has no exact form with these options")
            return self._exact(name, stat)
        if stat == "size":
            return F.count(F.lit(1)).cast("double")
        raw, x = F.col(f"`{name}`"), valid(self.df, name)
        if stat == "nunique":
            return F.count_distinct(raw).cast("double")
        if stat in ("first", "last"):
            if self.row is None:
                raise ValueError("first and last need a row number")
            pick = F.min_by if stat == "first" else F.max_by
            return pick(raw.cast("double"), F.when(raw.isNotNull(), F.col(self.row)))
        if weight:
            return self._weighted(x, F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), stat, **options)
        n = F.count(x)
        ddof = options.get("ddof") if options.get("ddof") is not None else 1
        method, q = options.get("method") or "linear", options.get("q")
        centred = F.var_pop(x) * n / F.when(n > ddof, n - ddof)
        table = {
            "count": lambda: n.cast("double"),
            "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
            "mean": lambda: F.avg(x),
            "var": lambda: F.var_samp(x) if ddof == 1 else centred,
            "std": lambda: F.stddev_samp(x) if ddof == 1 else F.sqrt(centred),
            "sem": lambda: F.stddev_samp(x) / F.sqrt(n) if ddof == 1 else F.sqrt(centred / n),
            "min": lambda: F.min(x),
            "max": lambda: F.max(x),
            "range": lambda: F.max(x) - F.min(x),
            "median": lambda: quantile(x, 0.5, method),
            "quantile": lambda: quantile(x, q, method),
            "iqr": lambda: quantile(x, 0.75, method) - quantile(x, 0.25, method),
        }
        if stat == "quantile" and q is None:
            raise ValueError("quantile needs q")
        if stat == "mad":
            raise ValueError("mad takes two passes; use agg")
        return table[stat]()

    def _exact(self, name: str | None, stat: str) -> Column:
        if stat == "size":
            return F.count(F.lit(1))
        kind = self.df.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)) or not isinstance(kind, (T.IntegralType, T.BooleanType)):
            raise TypeError("the exact family is for integer and boolean columns")
        c = F.col(f"`{name}`").cast("int").cast("long") if isinstance(kind, T.BooleanType) else F.col(f"`{name}`").cast("long")
        if stat in ("first", "last"):
            if self.row is None:
                raise ValueError("first and last need a row number")
            value = (F.min_by if stat == "first" else F.max_by)(c, F.when(c.isNotNull(), F.col(self.row)))
        else:
            value = {"count": F.count, "nunique": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max}[stat](c)
        if stat == "sum":
            return F.coalesce(value, F.lit(0).cast("long"))
        return value if stat in ("count", "nunique") else F.coalesce(value, F.raise_error(F.lit(f"{stat} of a group without values")).cast("long"))

    @staticmethod
    def _weighted(x: Column, w: Column, stat: str, ddof: float | None = None, **_) -> Column:
        bad = F.raise_error(F.lit("a weight is negative or not finite")).cast("double")
        w = F.when((w >= 0) & (w < float("inf")) & ~F.isnan(w), w).otherwise(bad)
        w = F.when(x.isNotNull() & (w > 0), w)
        x = F.when(w.isNotNull(), x)
        s, ss, mean = F.sum(w), F.sum(w * w), F.sum(w * x) / F.sum(w)
        d = 1 if ddof is None else ddof
        var = F.greatest(F.sum(w * x * x) - s * mean * mean, F.lit(0.0)) / F.when(s > d * ss / s, s - d * ss / s)
        table = {"count": F.count(w).cast("double"), "sum": F.coalesce(F.sum(w * x), F.lit(0.0)), "mean": mean, "var": var, "std": F.sqrt(var), "sem": F.sqrt(var * ss) / s, "min": F.min(x), "max": F.max(x), "range": F.max(x) - F.min(x)}
        if stat not in table:
            raise ValueError(f"{stat} takes no weights here")
        return table[stat]

    def agg(self, specs: Sequence[tuple]) -> DataFrame:
        """One row a group, in key order. A spec is (column, statistic, name) with an optional dict of options."""
        plain, parts, units = [], [], {}
        for name, stat, to, *rest in specs:
            options = dict(rest[0]) if rest else {}
            unit = options.pop("unit", None)
            if unit is None and stat in _KEEPS_UNIT and name:
                unit = self.df.schema[name].metadata.get("unit")
            if unit:
                units[to] = unit
            if stat == "mad":
                parts.append(self._mad(name, to, options.get("scale")))
            else:
                plain.append(self.stat(name, stat, **options).alias(to))
        if plain or not parts:
            parts.insert(0, self.df.groupBy(*self.keys).agg(*(plain or [F.count(F.lit(1)).alias("__n")])))
        out = reduce(self._beside, parts)
        names = self.keys + [s[2] for s in specs]
        return self.ordered(out.select(*[F.col(f"`{n}`").alias(n, metadata={"unit": units[n]}) if n in units else F.col(f"`{n}`") for n in names]))

    def _mad(self, name: str, to: str, scale: str | None) -> DataFrame:
        held = self.df.select(*self.keys, valid(self.df, name).alias("__x"))
        centre = held.groupBy(*self.keys).agg(F.percentile("__x", F.lit(0.5)).alias("__m"))
        both = self._beside(held, centre).withColumn("__d", F.abs(F.col("__x") - F.col("__m")))
        return both.groupBy(*self.keys).agg((F.percentile("__d", F.lit(0.5)) * F.lit(1.0 if scale == "raw" else MAD_SCALE)).alias(to))

    def _beside(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """The columns of both for each key; null keys meet."""
        renamed = b.select(*[F.col(f"`{k}`").alias(f"__k{i}") if k in self.keys else F.col(f"`{k}`") for i, k in sorted(((self.keys.index(c) if c in self.keys else -1, c) for c in b.columns), key=lambda x: x[0])])
        on = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        return a.join(renamed, on).drop(*[f"__k{i}" for i in range(len(self.keys))])

    def size(self, to: str = "size") -> DataFrame:
        return self.ordered(self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(to)))

    key_table = size

    def count(self, name: str, to: str = "count") -> DataFrame:
        """Rows that aren't null; a NaN counts."""
        return self.ordered(self.df.groupBy(*self.keys).agg(F.count(f"`{name}`").alias(to)))

    def nunique(self, name: str, to: str = "nunique", dropna: bool = True) -> DataFrame:
        c = F.col(f"`{name}`")
        n = F.count_distinct(c)
        return self.ordered(self.df.groupBy(*self.keys).agg((n if dropna else n + F.max(c.isNull().cast("int"))).cast("long").alias(to)))

    def csr(self) -> DataFrame:
        """Row numbers of each group, ascending, and the first and the last."""
        r = F.col(self.row)
        rows = F.sort_array(F.collect_list(r))
        return self.ordered(self.df.groupBy(*self.keys).agg(rows.alias("rows"), F.min(r).alias("first_row"), F.max(r).alias("last_row")))

    def _numbered(self) -> DataFrame:
        """The keys with ``group``, their 1-based place in key order."""
        from .sorting import argsort

        keys = self.df.select(*self.keys).distinct().withColumn("__row", F.monotonically_increasing_id())
        return argsort(keys, [f"{k}" for k in self.keys], "__row", "group").drop("__row")

    def group_ids(self, to: str = "group") -> DataFrame:
        """Every row with its group's 1-based number in key order; null for rows in no group."""
        found = self._numbered().select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.keys)], F.col("group").alias(to))
        on = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        return self.all.join(found, on, "left").drop(*[f"__k{i}" for i in range(len(self.keys))])

    def gather(self, name: str, group: int) -> DataFrame:
        """The values of one group, by its number, in row order."""
        return self.group_ids("__group").where(F.col("__group") == group).orderBy(self.row).select(self.row, name)

    def shape(self) -> DataFrame:
        """``ngroups, max_size``, as one row."""
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("ngroups"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"))

    def reduce(self, name: str, func, to: str, weight: str | None = None) -> DataFrame:
        """A number for each group from ``func(values, is_valid, weights)``, numpy arrays in row order; a group has to fit a task.

        Values are doubles, 0 where the column is null; weights are None without a weight column. A reducer may be any object that can be
        pickled and called, and so may hold parameters of its own.
        """
        keys = list(self.keys)
        x = F.col(f"`{name}`").cast("double")
        held = self.df.select(*[F.col(f"`{k}`") for k in keys], F.col(self.row).alias("__row"), x.isNotNull().alias("__ok"), F.coalesce(x, F.lit(0.0)).alias("__x"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("__w"))

        def run(frame):
            frame = frame.sort_values("__row")
            value = func(frame["__x"].to_numpy(), frame["__ok"].to_numpy(), frame["__w"].to_numpy() if weight else None)
            return frame[keys].iloc[:1].assign(**{to: None if value is None else float(value)})

        schema = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys) + f", `{to}` double"
        return self.ordered(held.groupBy(*keys).applyInPandas(run, schema))

    def broadcast(self, name: str, stat: str, to: str, **options) -> DataFrame:
        """Every row with its group's statistic, by joining the aggregate back (no group is held in one task)."""
        found = self.agg([(name, stat, to, options)]) if options else self.agg([(name, stat, to)])
        found = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], to)
        on = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        return self.all.join(found, on, "left").drop(*[f"__k{i}" for i in range(len(self.keys))])

    def apply(self, func, schema: str) -> DataFrame:
        """A Python reducer over each group's rows (a pandas frame in, a frame out); a group has to fit a task."""
        return self.df.groupBy(*self.keys).applyInPandas(func, schema)


def value_counts(df: DataFrame, name: str, dropna: bool = True, to: str = "count") -> DataFrame:
    """Values by falling count, ties by rising value, null last."""
    c = F.col(f"`{name}`")
    held = df.where(c.isNotNull()) if dropna else df
    return held.groupBy(name).agg(F.count(F.lit(1)).alias(to)).orderBy(c.isNull().asc(), F.desc(to), c.asc())


def drop_duplicates(df: DataFrame, keys: Sequence[str], keep: str, row: str) -> DataFrame:
    """First, last or no row of each key; nulls are equal, NaNs are equal."""
    r = F.col(row)
    pick = {"first": F.min(r), "last": F.max(r), "none": F.when(F.count(F.lit(1)) == 1, F.min(r))}
    if keep not in pick:
        raise ValueError("keep is first, last or none")
    kept = df.groupBy(*keys).agg(pick[keep].alias("__keep")).select("__keep")
    return df.join(kept, r == F.col("__keep"), "left_semi")


def duplicated(df: DataFrame, keys: Sequence[str], keep: str, row: str, to: str = "duplicated") -> DataFrame:
    """Whether a row is left out by drop_duplicates; the kept rows are joined back, so no key's rows are held in one task."""
    kept = drop_duplicates(df, keys, keep, row).select(F.col(row).alias("__keep"))
    return df.join(kept, F.col(row) == F.col("__keep"), "left").withColumn(to, F.col("__keep").isNull()).drop("__keep")
