"""Matching and searching values of one table in another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .sorting import ranged


def match(left: DataFrame, key: str, right: DataFrame, other: str, row: str, to: str = "match") -> DataFrame:
    """The smallest right row number with the key, 0 for none."""
    least = right.where(F.col(other).isNotNull()).groupBy(F.col(other).alias("__key")).agg(F.min(row).alias("__row"))
    return left.join(least, F.col(key) == F.col("__key"), "left").withColumn(to, F.coalesce("__row", F.lit(0))).drop("__key", "__row")


def match_all(left: DataFrame, key: str, left_row: str, right: DataFrame, other: str, row: str) -> DataFrame:
    """Every matching pair of row numbers, one a row (the flat form of an offsets list)."""
    a = left.select(F.col(left_row).alias("left_row"), F.col(key).alias("__a"))
    b = right.select(F.col(row).alias("right_row"), F.col(other).alias("__b"))
    return a.join(b, F.col("__a") == F.col("__b")).select("left_row", "right_row")


def is_in(left: DataFrame, key: str, right: DataFrame, other: str, to: str = "found") -> DataFrame:
    keys = right.select(F.col(other).alias("__key")).where("__key is not null").distinct().withColumn("__hit", F.lit(True))
    return left.join(keys, F.col(key) == F.col("__key"), "left").withColumn(to, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def remap(df: DataFrame, name: str, table: DataFrame, source: str, target: str, to: str, default=None, strict: bool = True) -> DataFrame:
    """Values replaced by a table's; a repeated source raises, and so does a value without one unless there is a default."""
    unique = table.groupBy(F.col(source).alias("__from")).agg(F.min(target).alias("__to"), F.count(F.lit(1)).alias("__n"))
    checked = unique.withColumn("__to", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{source} repeats a value")).cast(table.schema[target].dataType)).otherwise(F.col("__to")))
    joined = df.join(checked, F.col(name) == F.col("__from"), "left")
    missing = F.lit(default) if default is not None else F.raise_error(F.lit(f"a value of {name} has no target")) if strict else F.lit(None)
    kind = table.schema[target].dataType
    value = F.when(F.col("__n").isNotNull(), F.col("__to")).when(F.col(name).isNull(), F.lit(None).cast(kind)).otherwise(missing.cast(kind))
    return joined.withColumn(to, value).drop("__from", "__to", "__n")


def bounds(data: DataFrame, value: str, targets: DataFrame, target: str) -> DataFrame:
    """``target, lower, upper``: the number of values below and not above each distinct target.

    Both sets are cut at the same range boundaries: values and targets are sorted together once, and counts run within
    range partitions plus the totals of the partitions before.
    """
    v = data.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    t = targets.select(F.col(target).alias("x")).where("x is not null").distinct().withColumn("t", F.lit(1))
    both = v.join(t, "x", "full").select("x", F.coalesce("n", F.lit(0)).alias("n"), F.col("t").isNotNull().alias("t"))
    parts = ranged(both, [F.col("x")]).withColumnRenamed("__part", "p")
    sums = parts.groupBy("p").agg(F.sum("n").alias("s"))
    before = sums.select("p", (F.sum("s").over(Window.orderBy("p")) - F.col("s")).alias("b"))
    run = F.sum("n").over(Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("r", run).join(F.broadcast(before), "p").where("t").select(F.col("x").alias("target"), (F.col("b") + F.col("r") - F.col("n")).alias("lower"), (F.col("b") + F.col("r")).alias("upper"))


def minmax(df: DataFrame, name: str, row: str | None = None) -> DataFrame:
    """Least and greatest value, nulls and NaNs skipped, and the first rows they occur in."""
    x = F.when(~F.isnan(F.col(name).cast("double")), F.col(name))
    out = [F.min(x).alias("min"), F.max(x).alias("max")]
    if row:
        r = F.when(x.isNotNull(), F.struct(x.alias("x"), F.col(row).alias("r")))
        out += [F.min(r)["r"].alias("argmin"), (-F.max(F.when(x.isNotNull(), F.struct(x.alias("x"), (-F.col(row)).alias("r"))))["r"]).alias("argmax")]
    return df.agg(*out)


class Index:
    """Lookup by key columns; ``unique`` refuses a repeated key when the index is made."""

    def __init__(self, df: DataFrame, keys: list[str], row: str, unique: bool = False):
        self.df, self.keys, self.row = df.where(" and ".join(f"`{k}` is not null" for k in keys)), keys, row
        if unique and not self.df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a key repeats")

    def find(self, *key):
        """The smallest row number with the key, 0 for none."""
        got = self.df.where(self._at(key)).agg(F.min(self.row)).first()[0]
        return got or 0

    def find_all(self, *key) -> DataFrame:
        return self.df.where(self._at(key)).select(self.row).orderBy(self.row)

    def count(self, *key) -> int:
        return self.df.where(self._at(key)).count()

    def find_many(self, wanted: DataFrame, to: str = "found") -> DataFrame:
        least = self.df.groupBy(*self.keys).agg(F.min(self.row).alias(to))
        return wanted.join(least, self.keys, "left").withColumn(to, F.coalesce(to, F.lit(0)))

    def _at(self, key):
        cond = F.lit(True)
        for k, v in zip(self.keys, key, strict=True):
            cond = cond & (F.col(k) == F.lit(v))
        return cond
