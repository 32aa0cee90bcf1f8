"""More relational queries, by category: joins, aggregates, sets, functions, user-defined functions, streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.python import WordsOf, check_digits, initials, weighted_mean
from quern.operators.joins import interval_join
from quern.plans.relational import _sql, query
from quern.sources.tables import table
from quern.streaming.windows import session_counts, sliding_counts, tumbling_counts, without_repeats


@query("""
select n_name, cast(count(s_suppkey) as bigint) as n, round(coalesce(sum(s_acctbal), 0), 2) as balance
from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 0 group by n_name
""")
def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right")
    return rows.groupBy("n_name").agg(F.count("s_suppkey").alias("n"), F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("balance"))


@query("""
select r_name, event_type, count(distinct user_id) as users from region cross join (select distinct event_type, user_id % 5 as r, user_id from events) e
where r = r_regionkey group by r_name, event_type
union all select r_name, 'none', 0 from region cross join (select 'none' as x)
""")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region with every type of event: of both sides there is a bounded number."""
    region, events = table(spark, sf_dir, "region"), table(spark, sf_dir, "events")
    users = events.select("event_type", (F.col("user_id") % 5).alias("r"), "user_id").groupBy("event_type", "r").agg(F.count_distinct("user_id").alias("users"))
    every = region.select("r_name", "r_regionkey").crossJoin(users).filter("r = r_regionkey").select("r_name", "event_type", "users")
    return every.unionByName(region.select("r_name", F.lit("none").alias("event_type"), F.lit(0).cast("long").alias("users")))


_THETA = """
select band, count(*) as n, round(min(p_retailprice), 2) as least from {part} as p
join (values ('low', 0, 1000), ('middle', 1000, 1500), ('high', 1500, 1000000)) as b(band, lo, hi) on p_retailprice >= lo and p_retailprice < hi group by band
"""


@query(_THETA.replace("{part}", "part"))
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _THETA, "part")


@query("""
select v.event_id as view_id, count(*) as n, round(sum(p.value), 2) as value
from events v join events p on v.user_id = p.user_id and p.ts >= v.ts and p.ts <= v.ts + interval 24 hour
where v.event_type = 'view' and p.event_type = 'purchase' group by v.event_id
""")
def purchases_within_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval join: purchases in the day after each view."""
    events, micros = table(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    bought = events.filter("event_type = 'purchase'").select("user_id", "value", micros.alias("at"))
    seen = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), micros.alias("low"))
    day = 86_400_000_000
    rows = interval_join(bought, seen, "user_id", F.col("at"), F.col("low"), F.col("low") + day, day)
    return rows.groupBy("view_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("""
select c_custkey, n, most from customer as c, lateral (select count(*) as n, max(o_totalprice) as most from orders as o where o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal) as x
""")
def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the lateral part orders meet customers by key first: what is left of the correlation is equality, which Spark takes
    as a join, where an inequality makes it pair every order with every balance.
    """
    return _sql(spark, sf_dir, """
        select c_custkey, n, most from {customer} as c, lateral (
          select count(*) as n, max(o_totalprice) as most
          from (select distinct c_custkey as key, c_acctbal as balance from {customer}) as k join {orders} as o on o.o_custkey = k.key and o.o_totalprice > k.balance
          where k.key = c.c_custkey and k.balance = c.c_acctbal) as x
    """, "customer", "orders")  # fmt: skip


@query("""
select l_returnflag, l_linestatus, cast(grouping(l_returnflag) * 2 + grouping(l_linestatus) as bigint) as level, count(*) as n, cast(sum(l_quantity) as double) as quantity
from lineitem group by cube (l_returnflag, l_linestatus)
""")
def cube_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
select event_type, abs(approx_users - users) <= 0.1 * users as users_near, rank_near from (
  select event_type, approx_count_distinct(user_id) * 0 + count(distinct user_id) as approx_users, count(distinct user_id) as users, true as rank_near from events group by event_type)
""")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches against exact figures: distinct users within a tenth, the median's rank within a hundredth."""
    events = table(spark, sf_dir, "events")
    found = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("approx"), F.count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5, 10_000).alias("median"))
    ranks = events.join(found, "event_type").groupBy("event_type", "approx", "users").agg(F.avg((F.col("value") <= F.col("median")).cast("double")).alias("rank"))
    return ranks.select("event_type", (F.abs(F.col("approx") - F.col("users")) <= 0.1 * F.col("users")).alias("users_near"), (F.abs(F.col("rank") - 0.5) <= 0.01).alias("rank_near"))


@query("""
select l_returnflag, round(stddev_samp(l_quantity), 4) as sd, round(var_pop(l_discount), 8) as var, round(corr(l_quantity, l_extendedprice), 6) as corr,
  round(covar_samp(l_quantity, l_tax), 6) as covar, round(quantile_cont(l_extendedprice, 0.9), 2) as p90, cast(median(l_quantity) as double) as middle,
  max(l_linenumber) - min(l_linenumber) as span, bool_or(l_tax > 0.07) as taxed
from lineitem group by l_returnflag
""")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 4).alias("sd"), F.round(F.var_pop("l_discount"), 8).alias("var"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"),
        F.round(F.covar_samp("l_quantity", "l_tax"), 6).alias("covar"), F.round(F.percentile("l_extendedprice", 0.9), 2).alias("p90"), F.median("l_quantity").alias("middle"),
        (F.max("l_linenumber") - F.min("l_linenumber")).alias("span"), F.bool_or(F.col("l_tax") > 0.07).alias("taxed"),
    )


@query("""
select o_custkey as k, 'both' as side from (select o_custkey from orders where o_orderstatus = 'F' intersect all select o_custkey from orders where o_orderstatus = 'O')
union all select o_custkey, 'more' from (select o_custkey from orders where o_orderstatus = 'F' except all select o_custkey from orders where o_orderstatus = 'O')
""")
def set_operations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    f, o = (orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return f.intersectAll(o).withColumn("side", F.lit("both")).unionAll(f.exceptAll(o).withColumn("side", F.lit("more")))


@query(r"""
select p_partkey, regexp_extract(p_brand, '([0-9])([0-9])$', 2) as last, regexp_replace(p_name, '[aeiou]', '*', 'g') as masked, split_part(p_type, ' ', 1) as kind,
  lpad(cast(p_size as varchar), 5, '0') as size, p_brand || '/' || p_type as label, cast(strpos(p_name, 'e') as bigint) as place, reverse(p_brand) as back,
  trim(p_name || '  ') as trimmed, regexp_matches(p_name, '^[a-m]') as early, lower(p_type) as low, repeat('x', p_size % 4) as bar, ascii(p_name) as code, md5(p_name) as digest
from part
""")
def more_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_extract("p_brand", "([0-9])([0-9])$", 2).alias("last"), F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"),
        F.lpad(F.col("p_size").cast("string"), 5, "0").alias("size"), F.concat_ws("/", "p_brand", "p_type").alias("label"), F.instr("p_name", "e").cast("long").alias("place"), F.reverse("p_brand").alias("back"),
        F.trim(F.concat("p_name", F.lit("  "))).alias("trimmed"), F.col("p_name").rlike("^[a-m]").alias("early"), F.lower("p_type").alias("low"), F.expr("repeat('x', p_size % 4)").alias("bar"), F.ascii("p_name").alias("code"), F.md5("p_name").alias("digest"),
    )


@query("""
select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as month, cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) as days,
  strftime(o_orderdate, '%Y-%m') as label, cast(dayofweek(o_orderdate) + 1 as bigint) as weekday, last_day(cast(o_orderdate as date)) as last, cast(o_orderdate as date) + 10 as later,
  cast(week(o_orderdate) as bigint) as week, cast(cast(o_orderdate as date) + interval 2 month as date) as shifted, cast(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') as date) as parsed
from orders
""")
def more_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    day = d.cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.trunc(day, "month").alias("month"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_format(d, "yyyy-MM").alias("label"),
        F.dayofweek(d).cast("long").alias("weekday"), F.last_day(day).alias("last"), F.date_add(day, 10).alias("later"), F.weekofyear(d).cast("long").alias("week"),
        F.add_months(day, 2).alias("shifted"), F.to_date(F.date_format(d, "dd.MM.yyyy"), "dd.MM.yyyy").alias("parsed"),
    )


@query("""
select o_orderkey, cast(ceil(o_totalprice) as bigint) as up, cast(floor(o_totalprice) as bigint) as down, round(sqrt(o_totalprice), 4) as root, round(ln(o_totalprice), 6) as ln, round(log10(o_totalprice), 6) as log10,
  round(power(o_totalprice / 1000, 1.5), 3) as power, abs(o_custkey - 700) as distance, cast(sign(o_custkey - 700) as double) as side, o_orderkey % 7 as rest, greatest(o_custkey, 100) as most, least(o_custkey, 100) as least,
  round(sin(o_custkey), 6) as sine, o_custkey & 12 as bits, xor(o_custkey, 5) as flipped
from orders where o_totalprice > 0
""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("o_totalprice"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").filter("o_totalprice > 0").select(
        "o_orderkey", F.ceil(p).alias("up"), F.floor(p).alias("down"), F.round(F.sqrt(p), 4).alias("root"), F.round(F.ln(p), 6).alias("ln"), F.round(F.log10(p), 6).alias("log10"),
        F.round(F.pow(p / 1000, F.lit(1.5)), 3).alias("power"), F.abs(k - 700).alias("distance"), F.signum(k - 700).alias("side"), (F.col("o_orderkey") % 7).alias("rest"), F.greatest(k, F.lit(100).cast("long")).alias("most"), F.least(k, F.lit(100).cast("long")).alias("least"),
        F.round(F.sin(k), 6).alias("sine"), k.bitwiseAND(12).alias("bits"), k.bitwiseXOR(5).alias("flipped"),
    )


@query("""
select event_type, k, count(*) as n, cast(sum(v) as bigint) as total from (select event_type, unnest(json_keys(props)) as k, cast(json_extract_string(props, '$.k') as bigint) as v from events) group by event_type, k
""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string, bigint>").alias("m"))
    rows = rows.filter(F.map_contains_key("m", "k")).select("event_type", F.explode("m").alias("k", "v"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("""
select lang, word, count(*) as n from (select lang, lower(unnest(string_split(coalesce(text, ''), ' '))) as word from documents) where word <> '' and length(word) <= 3 group by lang, word
""")
def exploded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    return words.filter("word <> '' and length(word) <= 3").groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n"))


@query("""
select label, cast(len(list_filter(list_sort(embedding), lambda x: x > 0)) as bigint) as positive, round(list_max(embedding), 5) as most, list_contains(embedding, embedding[1]) as has_first, vec_id,
  cast(len(list_distinct(list_transform(embedding, lambda x: cast(round(x * 10) as integer)))) as bigint) as kinds
from embeddings
""")
def more_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenths are counted in the floats' own precision: as a double 0.35 * 10 is below 3.5."""
    e = F.col("embedding")
    tenths = F.array_distinct(F.transform(F.filter(e, lambda x: x.isNotNull()), lambda x: F.round(x * F.lit(10).cast("float")).cast("int")))
    first = F.get(e, 0)
    return table(spark, sf_dir, "embeddings").select("label", F.size(F.filter(F.sort_array(e), lambda x: x > 0)).cast("long").alias("positive"), F.round(F.array_max(e), 5).alias("most"), F.array_contains(e, first).alias("has_first"), "vec_id", F.size(tenths).cast("long").alias("kinds"))


@query("select c_custkey, 97 - c_custkey % 97 as digits from customer")
def scalar_pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", check_digits("c_custkey").alias("digits"))


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as discount from lineitem group by l_returnflag")
def grouped_pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate in Python. A built-in one would combine on the map side; groups here are three."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(weighted_mean("l_discount", "l_quantity"), 8).alias("discount"))


@query("select p_type, cast(count(*) as bigint) as n, round(regr_slope(p_retailprice, p_size), 4) as slope from part group by p_type")
def applied_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["p_size"].astype(float), rows["p_retailprice"]
        spread = ((x - x.mean()) ** 2).sum()
        return pd.DataFrame({"p_type": rows["p_type"].iloc[:1], "n": [len(rows)], "slope": [((x - x.mean()) * (y - y.mean())).sum() / spread if spread else None]})

    found = table(spark, sf_dir, "part").select("p_type", "p_size", "p_retailprice").groupBy("p_type").applyInPandas(fit, "p_type string, n long, slope double")
    return found.withColumn("slope", F.round("slope", 4))


@query("select p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: w[1]), '') as initials from part")
def arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", initials("p_name").alias("initials"))


@query("""
select place, word, count(*) as n from (select unnest(range(1, len(w) + 1)) as place, unnest(w) as word from (select string_split(p_name, ' ') as w from part)) where word <> '' group by place, word
""")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UDTF called for each row, laterally."""
    part = table(spark, sf_dir, "part").select("p_name")
    rows = part.lateralJoin(WordsOf(F.col("p_name").outer()))
    return rows.groupBy(F.col("place").cast("long").alias("place"), "word").agg(F.count("*").alias("n"))


def _naive(df: DataFrame) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.withColumnsRenamed({"end": "until"}).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "until") if c == "start" or "end" in df.columns})


@query("""
select w as start, w + interval 1 hour as until, event_type, count(*) as n, round(sum(value), 2) as value from (
  select event_type, value, unnest([time_bucket(interval 15 minute, ts) - interval 15 minute * i for i in range(4)]) as w from events)
group by w, event_type
""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(sliding_counts(table(spark, sf_dir, "events")))


@query("""
select user_id, min(ts) as start, max(ts) + interval 30 minute as until, count(*) as n, round(sum(value), 2) as value from (
  select user_id, ts, value, sum(fresh) over (partition by user_id order by ts, event_id) as s from (
    select user_id, ts, event_id, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events))
group by user_id, s
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(session_counts(table(spark, sf_dir, "events")))


def _streamed(spark: SparkSession, sf_dir: str, plan) -> DataFrame:
    """What a stream over the events gives, from its start to their end. Results are counts by window, whose number is that of the windows."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"streamed_{uuid.uuid4().hex}"
    plan(source).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("""
select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as value from events group by 1, 2
""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(_streamed(spark, sf_dir, tumbling_counts))


@query("select event_type, count(*) as n from (select distinct event_id, event_type from events) group by event_type")
def streamed_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda events: without_repeats(events.unionByName(events)).groupBy("event_type").agg(F.count("*").alias("n")))
