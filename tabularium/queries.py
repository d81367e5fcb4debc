"""The registered queries of the library, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions import cosmology, filters, random, sky, text
from .operators import grouping, joins, kde, search, sorting, spatial, stats, table as tables
from .sources import parquet
from .streaming import writer

Query = Callable[[SparkSession, str], DataFrame]

_found: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def keep(f: Query) -> Query:
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with x: null where the line number is 7, NaN where it is 6, else the quantity."""
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").withColumn("x", F.when(n == 6, F.lit(float("nan"))).when(n != 7, F.col("l_quantity")))


HOLED = "(select *, case when l_linenumber = 7 then null when l_linenumber = 6 then cast('NaN' as double) else l_quantity end as x from lineitem)"


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as mean_price,
  round(quantile_cont(l_extendedprice, 0.5), 4) as median_price, round(stddev_samp(l_extendedprice), 4) as std_price
  from lineitem where l_shipdate >= timestamp '1998-01-01' and l_quantity > 10 group by 1, 2""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parquet.read_table(spark, f"{sf_dir}/lineitem.parquet", rule='l_shipdate >= "1998-01-01" and l_quantity > 10')
    g = grouping.Grouping(df, "l_returnflag,l_linestatus")
    out = g.agg([(None, "size", "n", {"exact": True}), ("l_quantity", "sum", "sum_qty"), ("l_extendedprice", "mean", "mean_price"), ("l_extendedprice", "median", "median_price"), ("l_extendedprice", "std", "std_price")])
    return rounded(rounded(out, "sum_qty", digits=2), "mean_price", "median_price", "std_price")


# -- filters --------------------------------------------------------------------------------------------------------


def _filter(name: str, rule: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.filter_rows(holed(spark, sf_dir), rule).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("tax"))

    run.__name__ = f"filter_{name}"
    query(f"select l_linenumber, count(*) as n, round(sum(l_tax), 4) as tax from {HOLED} where {where} group by 1")(run)


_filter("greater", "x > 20", "x > 20 and not isnan(x)")
_filter("not_greater", "not x > 20", "not (x > 20 and not isnan(x))")
_filter("precedence", "x < 5 or x >= 45 and l_tax > 0.04", "x < 5 or (x >= 45 and not isnan(x) and l_tax > 0.04)")
_filter("not_equal", "x /= 5", "x <> 5")
_filter("in_list", 'l_linenumber in (1, 3, 6) and l_returnflag not_in ("A", "N")', "l_linenumber in (1, 3, 6) and l_returnflag not in ('A', 'N')")
_filter("not_in_nan", "x not_in (1, 2, 3)", "x not in (1, 2, 3)")
_filter("null", "x is_null or x is_nan", "x is null or isnan(x)")
_filter("finite", "x is_finite", "x is not null and isfinite(x)")
_filter("not_finite", "x is_not_finite", "x is not null and not isfinite(x)")
_filter("temporal", 'l_shipdate >= "1997-03-01" and l_shipdate < "1998-01-01T12:00:00"', "l_shipdate >= timestamp '1997-03-01' and l_shipdate < timestamp '1998-01-01 12:00:00'")


@query("select event_type, count(*) as n from events where starts_with(event_type, 'p') or contains(props, '1') and not ends_with(event_type, 'w') group by 1")
def filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_rows(read(spark, sf_dir, "events"), 'event_type starts_with "p" or props contains "1" and not event_type ends_with "w"').groupBy("event_type").agg(F.count("*").alias("n"))


@query("select count(*) as n, cast(sum(l_orderkey) as bigint) as keys from lineitem where l_orderkey in (select range * 3 from range(2000)) and l_partkey not in (select range from range(500))")
def filter_bound_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filters.Filter().bind("wanted", range(0, 6000, 3)).bind("bad", range(500)).add("l_orderkey in @wanted").add("l_partkey not_in @bad")
    return filters.filter_rows(read(spark, sf_dir, "lineitem"), f).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query(f"select coalesce(x > 20 and not isnan(x), false) as mask, count(*) as n from {HOLED} group by 1")
def row_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.row_mask(holed(spark, sf_dir), "x > 20").groupBy("mask").agg(F.count("*").alias("n"))


# -- scans, sampling and random numbers -----------------------------------------------------------------------------


@query("select * from (select o_orderkey, o_totalprice from orders) where o_totalprice > 300000")
def scan_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read_table(spark, f"{sf_dir}/orders.parquet", rule="o_totalprice > 300000", columns=["o_orderkey", "o_totalprice"])


@query("select * from (select *, row_number() over () as row from orders) where row between 11 and 60")
def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read_table(spark, f"{sf_dir}/orders.parquet", rows=(11, 60), row_index="row")


@query()
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read_table(spark, f"{sf_dir}/orders.parquet", fraction=0.2, seed=42, row_index="row")


@query()
def random_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", random.uniform(F.col("event_id") + 1, 7).alias("u"), random.exponential(F.col("event_id") + 1, 7).alias("e"), random.normal(F.col("event_id") + 1, 7).alias("z"))


@query()
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random.permutation(read(spark, sf_dir, "events").select("event_id"), "event_id", 3)


@query()
def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random.subset(read(spark, sf_dir, "events").select("event_id", "value"), "event_id", 100, 3)


@query()
def random_weighted_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random.weighted_subset(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100, 3)


@query()
def random_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parquet.read_table(spark, f"{sf_dir}/nation.parquet", row_index="row")
    return random.resample(df, "row", 25, 200, 5)


# -- sorting and ranks ----------------------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.top_n(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice desc", 50, "o_orderkey")


@query("select o_orderkey, row_number() over (order by o_orderpriority desc, o_totalprice, o_orderkey) as position from orders")
def argsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.argsort(read(spark, sf_dir, "orders"), ["-o_orderpriority", "o_totalprice"], "o_orderkey").select("o_orderkey", "position")


@query(f"""select l_linenumber, count(*) as n from (select *, row_number() over (order by x is null, coalesce(isnan(x), false), x desc) as r from {HOLED}) where r > (select count(*) from lineitem where l_linenumber < 6) group by 1""")
def sort_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands behind the values in falling order: NaN, then null."""
    df = holed(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    placed = sorting.argsort(df, ["x desc"], "id")
    n = df.where("l_linenumber < 6").count()
    return placed.where(F.col("position") > n).groupBy("l_linenumber").agg(F.count("*").alias("n"))


def _rank(method: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sorting.rank(read(spark, sf_dir, "part"), "p_size", method, by=["p_brand"], row="p_partkey").select("p_partkey", F.col("rank").cast("double").alias("rank"))

    run.__name__ = f"rank_{method}"
    query(f"select p_partkey, cast({sql} as double) as rank from part")(run)


_rank("competition", "rank() over (partition by p_brand order by p_size)")
_rank("dense", "dense_rank() over (partition by p_brand order by p_size)")
_rank("ordinal", "row_number() over (partition by p_brand order by p_size, p_partkey)")
_rank("average", "rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2")


# -- groups ---------------------------------------------------------------------------------------------------------


@query(f"""select l_returnflag, cast(count(*) as double) as size, cast(count(case when not isnan(x) then 1 end) as double) as count, round(sum(case when not isnan(x) then x end), 2) as sum,
  round(avg(case when not isnan(x) then x end), 6) as mean, round(var_samp(case when not isnan(x) then x end), 4) as var, round(stddev_samp(case when not isnan(x) then x end), 5) as std,
  round(stddev_samp(case when not isnan(x) then x end) / sqrt(count(case when not isnan(x) then 1 end)), 6) as sem, min(case when not isnan(x) then x end) as min, max(case when not isnan(x) then x end) as max,
  max(case when not isnan(x) then x end) - min(case when not isnan(x) then x end) as range, quantile_cont(case when not isnan(x) then x end, 0.5) as median,
  round(quantile_cont(case when not isnan(x) then x end, 0.9), 4) as q90, quantile_cont(case when not isnan(x) then x end, 0.75) - quantile_cont(case when not isnan(x) then x end, 0.25) as iqr,
  round(mad(case when not isnan(x) then x end) * 1.4826022185056018, 6) as mad, cast(count(distinct x) as double) as nunique from {HOLED} group by 1""")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouping.Grouping(holed(spark, sf_dir), "l_returnflag")
    names = ["size", "count", "sum", "mean", "var", "std", "sem", "min", "max", "range", "median"]
    out = g.agg([("x", n, n) for n in names] + [("x", "quantile", "q90", {"q": 0.9}), ("x", "iqr", "iqr"), ("x", "mad", "mad"), ("x", "nunique", "nunique")])
    return rounded(rounded(rounded(rounded(out, "sum", digits=2), "var", "q90"), "std", digits=5), "mean", "sem", "mad", digits=6)


@query("""select event_type, arg_min(value, event_id) as first, arg_max(value, event_id) as last, count(*) as size, min(user_id) as least, cast(sum(user_id) as bigint) as total from events group by 1""")
def group_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouping.Grouping(read(spark, sf_dir, "events"), "event_type", row="event_id")
    return g.agg([("value", "first", "first"), ("value", "last", "last"), (None, "size", "size", {"exact": True}), ("user_id", "min", "least", {"exact": True}), ("user_id", "sum", "total", {"exact": True})])


@query(f"select x, count(*) as size from {HOLED} where x is not null group by 1")
def group_by_nan_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.Grouping(holed(spark, sf_dir), "x").size()


@query("""select l_returnflag, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) as mean, round(sqrt((sum(l_quantity * l_tax * l_tax) - sum(l_quantity) * power(sum(l_tax * l_quantity) / sum(l_quantity), 2))
  / (sum(l_quantity) - sum(l_quantity * l_quantity) / sum(l_quantity))), 6) as std from lineitem group by 1""")
def group_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouping.Grouping(read(spark, sf_dir, "lineitem"), "l_returnflag")
    return rounded(g.agg([("l_tax", "mean", "mean", {"weight": "l_quantity"}), ("l_tax", "std", "std", {"weight": "l_quantity"})]), "mean", "std", digits=6)


@query(f"select l_returnflag, count(distinct x) + 1 as nunique from {HOLED} group by 1")
def group_nunique_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.Grouping(holed(spark, sf_dir), "l_returnflag").nunique("x", dropna=False)


@query("select o_custkey, list(o_orderkey order by o_orderkey) as rows, min(o_orderkey) as first_row, max(o_orderkey) as last_row from orders group by 1")
def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.Grouping(read(spark, sf_dir, "orders"), "o_custkey", row="o_orderkey").csr()


@query("select p_partkey, round(avg(p_retailprice) over (partition by p_brand), 4) as brand_mean from part")
def group_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grouping.Grouping(read(spark, sf_dir, "part"), "p_brand").broadcast("p_retailprice", "mean", "brand_mean").select("p_partkey", "brand_mean"), "brand_mean")


@query("select event_type, round(max(value) - min(value), 6) as span from events group by 1")
def group_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(rows):
        return rows.groupby("event_type", as_index=False).agg(span=("value", lambda v: round(float(v.max() - v.min()), 6)))

    return grouping.Grouping(read(spark, sf_dir, "events").select("event_type", "value"), "event_type").apply(span, "event_type string, span double")


@query("select p_type, count(*) as count from part group by 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.value_counts(read(spark, sf_dir, "part"), "p_type")


def _dedup(keep: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grouping.drop_duplicates(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], keep, "o_orderkey").select("o_orderkey", "o_custkey")

    run.__name__ = f"drop_duplicates_{keep}"
    query(f"select o_orderkey, o_custkey from (select *, {sql} as good from orders) where good")(run)


_dedup("first", "o_orderkey = min(o_orderkey) over (partition by o_custkey, o_orderstatus)")
_dedup("last", "o_orderkey = max(o_orderkey) over (partition by o_custkey, o_orderstatus)")
_dedup("none", "count(*) over (partition by o_custkey, o_orderstatus) = 1")


# -- joins ----------------------------------------------------------------------------------------------------------


def _join(how: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
        right = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("v"))
        return joins.join(left, right, "key", how=how, require="1:m")

    run.__name__ = f"join_{how}"
    query(f"with l as (select c_custkey as key, c_acctbal as v from customer where c_acctbal > 0), r as (select o_custkey as key, o_totalprice as v from orders where o_totalprice > 200000) {sql}")(run)


for _how, _on in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("outer", "full join")):
    _join(_how, f"select coalesce(l.key, r.key) as key, l.v as v, r.v as v_2 from l {_on} r on l.key = r.key")
_join("semi", "select * from l where exists (select 1 from r where r.key = l.key)")
_join("anti", "select * from l where not exists (select 1 from r where r.key = l.key)")


@query("select s_suppkey, s_nationkey in (select c_nationkey from customer where c_acctbal > 9900) as matched from supplier")
def join_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.matched(read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer").where("c_acctbal > 9900"), "s_nationkey", "c_nationkey").select("s_suppkey", "matched")


@query("select c_custkey, o_orderkey, c_custkey as pair, coalesce(o_orderkey, 0) as other_pair from customer left join orders on c_custkey = o_custkey")
def join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return joins.join(left, right, "c_custkey", "o_custkey", how="left", left_row="c_custkey", right_row="o_orderkey", pairs=True, columns=["o_orderkey"])


# -- table operations -----------------------------------------------------------------------------------------------


@query(f"select l_linenumber, count(*) as n, count(coalesce(x, -1)) as filled, count(case when isnan(coalesce(x, -1)) then 1 end) as nan from {HOLED} group by 1")
def fillna(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.fillna(holed(spark, sf_dir), {"x": -1.0})
    return df.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("x").alias("filled"), F.count_if(F.isnan("x")).alias("nan"))


@query(f"select l_linenumber, count(*) as n from {HOLED} where x is not null group by 1")
def dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dropna(holed(spark, sf_dir), ["x", "l_tax"]).groupBy("l_linenumber").agg(F.count("*").alias("n"))


GAPPY = "(select event_id, user_id, case when event_id % 3 = 0 then value end as v from events)"


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))


@query(f"select event_id, last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as v from {GAPPY}")
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ffill(gappy(spark, sf_dir), "v", "event_id", ["user_id"]).select("event_id", "v")


@query(f"select event_id, last_value(v ignore nulls) over (partition by user_id order by event_id desc rows between 1 preceding and current row) as v from {GAPPY}")
def bfill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bfill(gappy(spark, sf_dir), "v", "event_id", ["user_id"], limit=1).select("event_id", "v")


@query("select o_orderkey, cast(o_totalprice as varchar) is not null as has, o_orderkey as back from orders")
def parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("back"), F.col("o_totalprice").alias("p"))
    df = tables.format_column(tables.parse_column(df, "back", T.LongType()), "p")
    return df.select("o_orderkey", F.col("p").isNotNull().alias("has"), "back")


@query("select l_orderkey, cast(l_quantity as integer) as q from lineitem")
def checked_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cast(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("q")), "q", T.IntegerType())


@query("select p_partkey, count(*) as n from (select p_partkey, unnest(range(greatest(p_size % 4, 1))) from part) group by 1")
def explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("n"))
    return tables.explode_counts(df, "n").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("select c_custkey as key, c_name as name, c_acctbal as bal from customer union all select s_suppkey, s_name, null from supplier")
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return tables.append(top, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("select event_id, [value, 2 * value] as v from events where event_id not in (3, 5, 7)")
def matrix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "value", (2 * F.col("value")).alias("w"))
    return tables.delete_rows(tables.matrix(df, ["value", "w"], "v"), "event_id", [3, 5, 7]).select("event_id", "v")


# -- search ---------------------------------------------------------------------------------------------------------


@query("select c_custkey, coalesce((select min(o_orderkey) from orders where o_custkey = c_custkey), 0) as match from customer")
def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("select c_custkey as left_row, o_orderkey as right_row from customer join orders on c_custkey = o_custkey")
def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_all(read(spark, sf_dir, "customer"), "c_custkey", "c_custkey", read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as found from customer")
def is_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.is_in(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey")


@query("select s_suppkey, n_name as nation from supplier join nation on s_nationkey = n_nationkey")
def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.remap(read(spark, sf_dir, "supplier"), "s_nationkey", read(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query("select distinct cast(p_size as double) * 1000 as target, (select count(*) from orders where o_totalprice < p_size * 1000) as lower, (select count(*) from orders where o_totalprice <= p_size * 1000) as upper from part")
def search_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bounds(read(spark, sf_dir, "orders"), "o_totalprice", read(spark, sf_dir, "part").select((F.col("p_size").cast("double") * 1000).alias("t")), "t")


@query("select min(value) as min, max(value) as max, arg_min(event_id, (value, event_id)) as argmin, arg_max(event_id, (value, -event_id)) as argmax from events")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.minmax(read(spark, sf_dir, "events"), "value", "event_id")


# -- statistics -----------------------------------------------------------------------------------------------------


@query(f"""with p as (select x from {HOLED} where not isnan(x)) select count(x) as count, round(sum(x), 2) as sum, round(avg(x), 6) as mean, round(var_samp(x), 5) as var, round(skewness(x), 5) as skewness,
  round(kurtosis(x), 5) as kurtosis, min(x) as min, max(x) as max, (select count(*) from {HOLED} where x is null) as n_null, (select count(*) from {HOLED} where isnan(x)) as n_nan from p""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.describe(holed(spark, sf_dir), "x").drop("std", "sem")
    return rounded(rounded(rounded(out, "sum", digits=2), "mean", digits=6), "var", "skewness", "kurtosis", digits=5)


@query("select unnest([0.1::double, 0.5, 0.99]) as q, round(unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.99])), 4) as value from lineitem")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.quantiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99]), "value")


@query("select unnest([0.1::double, 0.5, 0.99]) as q, unnest(quantile_disc(l_extendedprice, [0.1, 0.5, 0.99])) as value from lineitem")
def quantiles_inverted_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99], "inverted_cdf")


@query("with c as (select l_extendedprice as x, sum(l_quantity) over (order by l_extendedprice) as s, sum(l_quantity) over () as t from lineitem) select min(x) as value from c where s >= 0.3 * t")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_quantile(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 0.3)


@query("select round(mad(l_extendedprice) * 1.4826022185056018, 4) as mad from lineitem")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mad(read(spark, sf_dir, "lineitem"), "l_extendedprice"), "mad")


@query("select l_quantity as mode, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 1")
def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mode(read(spark, sf_dir, "lineitem"), "l_quantity")


@query("select round(exp(avg(ln(l_quantity))), 6) as gmean, round(count(*) / sum(1 / l_quantity), 6) as hmean from lineitem")
def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.means(read(spark, sf_dir, "lineitem"), "l_quantity"), "gmean", "hmean", digits=6)


@query("with r as (select l_extendedprice as x, row_number() over (order by l_extendedprice) as r, count(*) over () as n from lineitem) select round(avg(x), 4) as trim_mean from r where r > floor(0.1 * n) and r <= n - floor(0.1 * n)")
def trim_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.trim_mean(read(spark, sf_dir, "lineitem"), "l_extendedprice", 0.1), "trim_mean")


@query("select round(100 * avg(case when l_quantity < 30 then 1.0 when l_quantity = 30 then 0.5 else 0 end), 6) as percentile from lineitem")
def percentile_of_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.percentile_of_score(read(spark, sf_dir, "lineitem"), "l_quantity", 30.0), "percentile", digits=6)


@query("select round(covar_samp(l_quantity, l_extendedprice), 3) as cov, round(corr(l_quantity, l_extendedprice), 8) as corr from lineitem")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(stats.relate(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "cov", digits=3), "corr", digits=8)


@query("""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as b from lineitem)
  select round(corr(a, b), 8) as corr from r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.relate(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "spearman"), "corr", digits=8).select("corr")


@query("""with e(bin, lower, upper) as (values (1, 0.0::double, 10.0::double), (2, 10.0, 25.0), (3, 25.0, 40.0), (4, 40.0, 50.0))
  select bin, lower, upper, (select cast(count(*) as double) from lineitem where l_quantity >= lower and (l_quantity < upper or upper = 50 and l_quantity = 50)) as value from e""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(read(spark, sf_dir, "lineitem"), "l_quantity", [0, 10, 25, 40, 50])


@query("""select cell, round(sum(v), 6) as value from (select unnest([least(greatest(k, 0), 9) + 1, least(greatest(k + 1, 0), 9) + 1])::integer as cell, unnest([1 - (u - k), u - k]) as v
  from (select l_quantity / 5 - 0.5 as u, cast(floor(l_quantity / 5 - 0.5) as bigint) as k from lineitem where l_quantity between 0 and 50)) group by 1""")
def bin_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.bin_linear(read(spark, sf_dir, "lineitem"), "l_quantity", 0, 50, 10), "value", digits=6)


@query("select event_id, round(sum(value) over (partition by user_id order by event_id), 6) as total, max(value) over (partition by user_id order by event_id) as peak from events")
def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.running(read(spark, sf_dir, "events"), "value", "sum", "event_id", "total", ["user_id"])
    return rounded(stats.running(df, "value", "max", "event_id", "peak", ["user_id"]).select("event_id", "total", "peak"), "total", digits=6)


@query("select event_id, round((value - avg(value) over ()) / stddev_samp(value) over (), 6) as z from events")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.zscore(read(spark, sf_dir, "events"), "value", "z").select("event_id", "z"), "z", digits=6)


@query()
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normal_scores(read(spark, sf_dir, "events").select("event_id", "value"), "value")


@query()
def sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([stats.sigma_clip(read(spark, sf_dir, "events"), "value")], "count long, mean double, median double, std double, rounds int")


@query("select count(value) as n, round(avg(value), 8) as mean, round(var_pop(value) * count(value), 3) as m2, min(value) as min, max(value) as max from events")
def merged_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    parts = writer.partial_moments(events.where("event_id % 2 = 0"), "value").union(writer.partial_moments(events.where("event_id % 2 = 1"), "value"))
    return rounded(rounded(writer.merge_moments(parts), "mean", digits=8), "m2", digits=3)


# -- space and sky --------------------------------------------------------------------------------------------------

POINTS = "(select vec_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyz")])


@query(f"select vec_id from {POINTS} where sqrt(x * x + y * y + z * z) <= 0.15")
def ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.ball(points(spark, sf_dir), ["x", "y", "z"], [0, 0, 0], 0.15).select("vec_id")


@query(f"select a.vec_id as a, b.vec_id as b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 8) as distance from {POINTS} a join {POINTS} b on a.vec_id < b.vec_id and sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 0.05")
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.pairs(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.05), "distance", digits=8)


@query(f"""select a, cast(rank as integer) as rank, b from (select a.vec_id as a, b.vec_id as b, row_number() over (partition by a.vec_id order by sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), b.vec_id) as rank
  from {POINTS} a join {POINTS} b on a.vec_id <> b.vec_id) where rank <= 3""")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.knn(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 3, 0.05).select("a", "rank", "b")


@query(f"""with recursive e as (select a.vec_id as a, b.vec_id as b from {POINTS} a join {POINTS} b on sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 0.04),
  c(vec_id, g) as (select a, b from e union select c.vec_id, e.b from c join e on c.g = e.a), l as (select vec_id, min(g) as "group" from c group by 1)
  select vec_id, "group", count(*) over (partition by "group") as size from l""")
def friends_of_friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.friends(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.04)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", sky.wrap360(F.col("x") * 400).alias("lon"), (F.col("y") * 150).alias("lat"))


SKY = f"(select vec_id, ((x * 400) % 360 + 360) % 360 as lon, y * 150 as lat from {POINTS})"


@query(f"""with v as (select vec_id, cos(radians(lat)) * cos(radians(lon)) as x, cos(radians(lat)) * sin(radians(lon)) as y, sin(radians(lat)) as z from {SKY})
  select a.vec_id as a, b.vec_id as b, round(degrees(2 * asin(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 2)), 6) as separation
  from v a join v b on a.vec_id <> b.vec_id and degrees(2 * asin(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 2)) <= 5""")
def sky_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    return rounded(sky.sky_pairs(p, p, "vec_id", "vec_id", "lon", "lat", 5.0).where("a != b"), "separation", digits=6)


@query()
def sky_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    lon, lat = F.col("lon"), F.col("lat")
    g, e = sky.to_galactic(lon, lat), sky.to_ecliptic(lon, lat)
    return p.select("vec_id", g[0].alias("l"), g[1].alias("b"), e[0].alias("elon"), e[1].alias("elat"), sky.healpix(lon, lat, 8).alias("pixel"))


# -- densities and cosmology ----------------------------------------------------------------------------------------


@query("""select g.at as at, round((select sum(case when abs(u) <= sqrt(5) then 3 / (4 * sqrt(5)) * (1 - u * u / 5) else 0 end) from (select (g.at - l_quantity) / 2 as u from lineitem)) / (2 * (select count(*) from lineitem)), 8) as density
  from (select cast(unnest([5, 15, 25, 35, 45]) as double) as at) g""")
def kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kde.density(read(spark, sf_dir, "lineitem"), "l_quantity", [5.0, 15.0, 25.0, 35.0, 45.0], 2.0, "epanechnikov"), "density", digits=8)


@query("""select g.at as at, round((select sum(case when abs(u) <= sqrt(5) then 3 / (4 * sqrt(5)) * (1 - u * u / 5) else 0 end)
    from (select unnest([g.at - l_quantity, g.at - (2 * 4.0 - l_quantity), g.at - (2 * 40.0 - l_quantity)]) / 3 as u from lineitem where l_quantity between 4 and 40))
    / (3 * (select count(*) from lineitem where l_quantity between 4 and 40)), 8) as density
  from (select cast(unnest([4, 6, 15, 38, 40]) as double) as at) g union all select 41.0, 0.0""")
def density_reflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kde.density(read(spark, sf_dir, "lineitem"), "l_quantity", [4.0, 6.0, 15.0, 38.0, 40.0, 41.0], 3.0, "epanechnikov", lower=4.0, upper=40.0)
    return rounded(found, "density", digits=8)


@query()
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return kde.grid(df, "l_extendedprice", kde.bandwidth(df, "l_extendedprice"), 128)


@query()
def cosmic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("p_size") / 25).alias("z")
    return cosmology.Cosmology().with_columns(read(spark, sf_dir, "part").select("p_partkey", z), "z", ["comoving", "luminosity", "angular", "lookback"])


# -- whole tables and groups -----------------------------------------------------------------------------------------


@query("select event_id, round(sum(value) over (order by event_id), 4) as total, max(value) over (order by event_id) as peak from events")
def running_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stats.running(read(spark, sf_dir, "events"), "value", "sum", "event_id", "total")
    return rounded(stats.running(df, "value", "max", "event_id", "peak").select("event_id", "total", "peak"), "total")


@query("""with g as (select event_id, case when event_id % 7 < 3 then value end as v from events)
  select event_id, last_value(v ignore nulls) over (order by event_id) as ahead, case when v is not null or lead(v) over (order by event_id) is not null then coalesce(v, lead(v) over (order by event_id)) end as back from g""")
def fill_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 < 3, F.col("value"))
    df = read(spark, sf_dir, "events").select("event_id", v.alias("ahead"), v.alias("back"))
    return tables.bfill(tables.ffill(df, "ahead", "event_id"), "back", "event_id", limit=1).select("event_id", "ahead", "back")


@query("""select p_partkey, rank() over (order by p_size) as competition, dense_rank() over (order by p_size) as dense,
  rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2 as average, row_number() over (order by p_size, p_partkey) as ordinal from part""")
def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    for method in ("competition", "dense", "average", "ordinal"):
        df = sorting.rank(df, "p_size", method, method, row="p_partkey")
    return df.select("p_partkey", "competition", "dense", "average", "ordinal")


@query("select distinct p_size from part")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.unique(read(spark, sf_dir, "part"), "p_size")


@query(f"select cast(count(distinct x) as bigint) as n from {HOLED}")
def unique_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.unique_count(holed(spark, sf_dir), "x")


@query("""select o_orderkey, o_totalprice, side from (select o_orderkey, o_totalprice, 0 as side from orders where o_orderstatus = 'F'
  union all select o_orderkey, o_totalprice, 1 from orders where o_orderstatus = 'O')""")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    left, right = (df.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice") for s in "FO")
    return sorting.merge(left, right, "o_totalprice", "o_orderkey")


@query("select quantile_disc(o_totalprice, 1.0) as o_totalprice from (select o_totalprice from orders order by o_totalprice limit (select cast(floor((count(*) - 1) * 0.75) + 1 as bigint) from orders))")
def nth_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.nth_quantile(read(spark, sf_dir, "orders"), "o_totalprice", 0.75)


@query("select p_partkey, dense_rank() over (order by p_brand, p_type) as \"group\" from part")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.Grouping(read(spark, sf_dir, "part"), "p_brand, p_type").group_ids().select("p_partkey", "group")


@query("select p_partkey, p_retailprice from part where p_brand = (select p_brand from (select distinct p_brand from part order by 1 limit 3) order by 1 desc limit 1)")
def group_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.Grouping(read(spark, sf_dir, "part"), "p_brand", row="p_partkey").gather("p_retailprice", 3)


@query("select count(*) as ngroups, max(n) as max_size from (select count(*) as n from part group by p_brand)")
def group_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.Grouping(read(spark, sf_dir, "part"), "p_brand").shape()


class _Spread:
    """A reducer with a parameter of its own: the weighted mean distance from a fixed value."""

    def __init__(self, centre: float):
        self.centre = centre

    def __call__(self, values, is_valid, weights):
        w = weights * is_valid
        return (abs(values - self.centre) * w).sum() / w.sum()


@query("select p_brand, round(sum(abs(p_retailprice - 1000) * p_size) / sum(p_size), 6) as spread from part group by 1")
def group_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grouping.Grouping(read(spark, sf_dir, "part"), "p_brand", row="p_partkey").reduce("p_retailprice", _Spread(1000.0), "spread", "p_size"), "spread", digits=6)


@query("""select customer.c_custkey, translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, translate(c_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as high,
  strlen(c_name) as bytes from customer""")
def text_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", text.to_lower(c).alias("low"), text.to_upper(c).alias("high"), text.byte_length(c).cast("long").alias("bytes"))


@query("""select count(*) as n, count(*) filter (where lang is null) as n_null, count(*) filter (where strlen(lang) = 0) as n_empty, cast(coalesce(sum(strlen(lang)), 0) as bigint) as characters,
  cast(min(strlen(lang)) as integer) as shortest, cast(max(strlen(lang)) as integer) as longest from documents""")
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.summary(read(spark, sf_dir, "documents"), "lang")


@query("""select url, regexp_replace(regexp_extract(url, '^(.*/)[^/]*$', 1), '/+$', '') as directory, regexp_extract(url, '([^/]*)$', 1) as name,
  regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\\.[^.]*)$', 1) as extension from pages""")
def text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("url")
    return read(spark, sf_dir, "pages").select("url", text.dirname(c).alias("directory"), text.basename(c).alias("name"), text.path_ext(c).alias("extension"))


@query("""select l_orderkey, l_linenumber, case when l_linenumber = 4 then 'infinity'::double else l_quantity / (l_linenumber - 4) end as ratio, round(exp(-l_discount * l_discount / 2) / sqrt(2 * pi()), 9) as pdf,
  round(l_quantity - 2 * pi() * floor(l_quantity / (2 * pi())), 9) as angle from lineitem""")
def safe_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    out = df.select("l_orderkey", "l_linenumber", text.safe_div(F.col("l_quantity"), F.col("l_linenumber") - 4).alias("ratio"), text.norm_pdf(F.col("l_discount")).alias("pdf"), text.wrap_rad(F.col("l_quantity")).alias("angle"))
    return rounded(out, "pdf", "angle", digits=9)


@query("select round((quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 1.3489795003921634, 4) as sigma from lineitem")
def probit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.probit_scale(read(spark, sf_dir, "lineitem"), "l_extendedprice"), "sigma")


@query()
def probit_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.probit_fit(read(spark, sf_dir, "lineitem"), "l_extendedprice"), "loc", "sigma", "corr")


@query()
def probit_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.probit_mean(read(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") / 51), "p", "l_extendedprice"), "probit_mean", digits=9)


SHELL = "(select c_custkey as id, c_acctbal / 1000 as x, (c_custkey % 97) / 10.0::double as y, (c_custkey % 89) / 10.0::double as z, (c_custkey % 5) / 20.0::double as reach, (c_custkey % 13) / 10.0::double as depth from customer)"


def shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_acctbal") / 1000).alias("x"), ((k % 97) / 10.0).alias("y"), ((k % 89) / 10.0).alias("z"), ((k % 5) / 20.0).alias("reach"), ((k % 13) / 10.0).alias("depth"))


@query(f"""select p.id as a, q.id as b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) as distance from {SHELL} p, {SHELL} q
  where p.id < q.id and sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) <= p.reach + q.reach""")
def linked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.linked_pairs(shell(spark, sf_dir), "id", ["x", "y", "z"], "reach", "sum"), "distance", digits=6)


@query(f"""with s as (select *, sqrt(x * x + y * y + z * z) as d from {SHELL}),
  m as (select p.id as a, q.id as b, sqrt((p.x / p.d - q.x / q.d) ** 2 + (p.y / p.d - q.y / q.d) ** 2 + (p.z / p.d - q.z / q.d) ** 2) * (p.d + q.d) / 2 as across, abs(p.depth - q.depth) as along from s p, s q where p.id < q.id)
  select a, b, round(across, 6) as across, round(along, 6) as along from m where across <= 0.4 and along <= 0.25""")
def line_of_sight_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.line_of_sight_pairs(shell(spark, sf_dir), "id", ["x", "y", "z"], 0.4, 0.25, los="depth"), "across", "along", digits=6)


@query("select count(*) as n_rows, 1::bigint as first_row, count(*) as last_row from lineitem")
def row_group_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = parquet.row_group_bounds(spark, f"{sf_dir}/lineitem.parquet")
    return held.agg(F.sum(F.col("last_row") - F.col("first_row") + 1).alias("n_rows"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"))


@query("select l_orderkey, l_linenumber, case when l_quantity > 45 then 45 when l_linenumber = 2 then null else l_quantity end as l_quantity from lineitem")
def cell_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.set_null(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", (F.col("l_linenumber") == 2) & (F.col("l_quantity") <= 45))
    return tables.set_where(df, "l_quantity", F.col("l_quantity") > 45, 45)


@query("select r_regionkey, r_name from region union all select null, null from range(3)")
def append_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.append_null_rows(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), 3)


@query("""with p as (select event_id, (event_id % 50) / 10.0::double as z from events), e as (select *, sqrt(0.3 * (1 + z) ** 3 + 0.7) as e from p)
  select event_id, round(70 * e, 6) as hubble, round(0.3 * (1 + z) ** 3 / (e * e), 8) as om, round(1 / (1 + z), 8) as scale_factor,
    round(2 / (3 * sqrt(0.7)) * asinh(sqrt(0.7 / 0.3) * (1 + z) ** -1.5) * 3.0856775814913673e19 / 70 / 3.15576e16, 6) as age from e""")
def cosmic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = cosmology.Cosmology(70, 0.3)
    df = read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 50) / 10.0).alias("z"))
    out = model.with_columns(df, "z", ["hubble", "om", "scale_factor", "age"]).drop("z")
    return rounded(rounded(out, "hubble", "age", digits=6), "om", "scale_factor", digits=8)
