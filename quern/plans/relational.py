"""Relational queries over the star schema, each with the SQL that gives the same rows.

They are DataFrame or SQL plans without Python on the data path: Catalyst prunes columns,
pushes filters to the scan and picks each join's strategy from sizes that it knows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query("""
select r_name, n_name, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where l_quantity > 10 group by r_name, n_name
""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem").filter("l_quantity > 10")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """SQL over tables of the folder, passed as arguments: no names are left in the catalog."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


@query("""
select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue,
  round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, case when l_discount >= 0.05 then 'high' when l_discount > 0 then 'low' else 'none' end as band
from lineitem where l_returnflag in ('A', 'R') and l_quantity between 10 and 20 and l_tax is not null
""")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R") & F.col("l_quantity").between(10, 20) & F.col("l_tax").isNotNull())
    band = F.when(F.col("l_discount") >= 0.05, "high").when(F.col("l_discount") > 0, "low").otherwise("none")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", band.alias("band"))


@query("""
select c_custkey, count(o_orderkey) as n_orders, round(coalesce(sum(o_totalprice), 0), 2) as total
from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by c_custkey
""")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("t"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("""
select o_orderkey, o_orderpriority from orders
where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)
  and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'N')
""")
def semi_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, on = table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")
    rows = table(spark, sf_dir, "orders").join(lines.filter("l_quantity > 45"), on, "left_semi").join(lines.filter("l_returnflag = 'N'"), on, "left_anti")
    return rows.select("o_orderkey", "o_orderpriority")


@query("""
select coalesce(s_nationkey, c_nationkey) as nation, coalesce(n_s, 0) as n_suppliers, coalesce(n_c, 0) as n_customers
from (select s_nationkey, count(*) as n_s from supplier where s_acctbal > 5000 group by s_nationkey)
full join (select c_nationkey, count(*) as n_c from customer where c_acctbal < 0 group by c_nationkey) on s_nationkey = c_nationkey
""")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("n_s"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("n_c"))
    rows = s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full")
    return rows.select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), F.coalesce("n_s", F.lit(0)).alias("n_suppliers"), F.coalesce("n_c", F.lit(0)).alias("n_customers"))


_SETS = """
select cast(grouping(event_type) * 2 + grouping(day) as bigint) as level, event_type, day, count(*) as n, round(sum(value), 2) as value
from (select event_type, cast(cast(ts as date) as string) as day, value from {events}) as x group by grouping sets ((event_type, day), (event_type), ())
"""


@query(_SETS.replace("{events}", "events"))
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _SETS, "events")


@query("""
select event_type, count(distinct user_id) as users, count(distinct cast(ts as date)) as days, count(*) filter (value > 50) as large from events group by event_type
""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("ts").cast("date")).alias("days"), F.count_if(F.col("value") > 50).alias("large"))


@query("""
select o_custkey, o_orderkey, o_totalprice, cast(r as bigint) as r, round(s, 2) as running, p as before from (
  select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r,
    sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as s,
    lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders)
""")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    running = F.round(F.sum("o_totalprice").over(by_date.rowsBetween(Window.unboundedPreceding, 0)), 2)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", r.alias("r"), running.alias("running"), F.lag("o_orderkey").over(by_date).alias("before"))


@query("""
select n_name, c_custkey, c_acctbal from (
  select n_name, c_custkey, c_acctbal, row_number() over (partition by n_name order by c_acctbal desc, c_custkey) as r from customer join nation on c_nationkey = n_nationkey)
where r <= 3
""")
def top_of_each_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return rows.withColumn("r", r).filter("r <= 3").select("n_name", "c_custkey", "c_acctbal")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("""
select o_custkey as k, 'both' as side from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O')
union all
select o_custkey, 'closed' from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O')
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    f, o = (orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return f.intersect(o).withColumn("side", F.lit("both")).unionAll(f.subtract(o).withColumn("side", F.lit("closed")))


@query("""
select c_custkey, c_acctbal from customer c
where c_acctbal > (select avg(c_acctbal) from customer d where d.c_nationkey = c.c_nationkey) and c_mktsegment = 'BUILDING'
""")
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, """
    select c_custkey, c_acctbal from {customer} c
    where c_acctbal > (select avg(c_acctbal) from {customer} d where d.c_nationkey = c.c_nationkey) and c_mktsegment = 'BUILDING'
    """, "customer")  # fmt: skip


@query("""
select p_partkey, upper(substring(p_name, 1, 5)) as head, cast(length(p_name) as bigint) as n, replace(p_brand, '#', '-') as brand, p_type like 'S%' as s
from part where p_name like '%a%'
""")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").filter(F.col("p_name").contains("a"))
    return rows.select("p_partkey", F.upper(F.substring("p_name", 1, 5)).alias("head"), F.length("p_name").cast("long").alias("n"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.col("p_type").startswith("S").alias("s"))


@query("""
select o_orderpriority, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as q, count(*) as n, max(o_orderdate) as last
from orders group by all
""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year(d).cast("long").alias("y"), F.quarter(d).cast("long").alias("q")).agg(F.count("*").alias("n"), F.max(d).alias("last"))


@query("""
select event_type, cast(json_extract_string(props, '$.k') as bigint) % 10 as k, count(*) as n from events group by 1, 2
""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("""
select o_orderstatus, cast(count(*) filter (o_orderpriority = '1-URGENT') as bigint) as urgent, cast(count(*) filter (o_orderpriority = '5-LOW') as bigint) as low from orders group by o_orderstatus
""")
def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return rows.select("o_orderstatus", F.coalesce(F.col("1-URGENT"), F.lit(0)).alias("urgent"), F.coalesce(F.col("5-LOW"), F.lit(0)).alias("low"))


@query("""
select p.event_id, p.user_id, v.event_id as view_id
from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts
""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before each purchase: one pass over both sides, dealt by user."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    before = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("view_id", F.last(view, ignorenulls=True).over(before)).filter("event_type = 'purchase'").select("event_id", "user_id", "view_id")


@query("""
select user_id, min(ts) as start, count(*) as n from (
  select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as s from (
    select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events))
group by user_id, s
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(by_user) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(by_user))
    return rows.groupBy("user_id", "s").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("s")


@query("""
select a.o_orderkey, count(*) as n_recent, round(sum(b.o_totalprice), 2) as recent
from orders a join orders b on a.o_custkey = b.o_custkey and b.o_orderdate between a.o_orderdate - interval 90 day and a.o_orderdate
group by a.o_orderkey
""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer ordered in the 90 days up to each order: a range frame, where a join would meet all pairs of a customer."""
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    recent = Window.partitionBy("o_custkey").orderBy(seconds).rangeBetween(-90 * 86_400, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(recent).alias("n_recent"), F.round(F.sum("o_totalprice").over(recent), 2).alias("recent"))


@query("""
select r_name, n_name, cast(count(*) as bigint) as n, round(sum(c_acctbal), 2) as balance
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)
""")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_DAYS = """
with recursive days(day) as (select cast('2024-01-01' as date) union all select cast(day + interval '1' day as date) from days where day < cast('2024-01-30' as date))
select day, count(event_id) as n from days left join {events} as e on cast(e.ts as date) = day and e.event_type = 'error' group by day
"""


@query(_DAYS.replace("{events}", "events"))
def recursive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _DAYS, "events")


@query("""
select vec_id, label, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))), 4) as norm, cast(len(embedding) as bigint) as n
from embeddings
""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(square, 4).alias("norm"), F.size("embedding").cast("long").alias("n"))
