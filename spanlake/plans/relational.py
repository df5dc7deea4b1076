"""Thin coverage of general relational and event-time operators, which Spark has built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table


@query("""select n_name, c_mktsegment, count(*) as orders, sum(round(l_extendedprice * 100)::bigint * (100 - round(l_discount * 100)::bigint))::bigint as revenue
from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey
where o_orderdate >= timestamp '1995-01-01' group by n_name, c_mktsegment""")
def rel_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    o = o.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey)
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))).alias("revenue"))


@query("""select 'with' as kind, count(*) as customers from customer where c_custkey in (select o_custkey from orders) union all
select 'without', count(*) from customer where c_custkey not in (select o_custkey from orders)""")
def rel_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how, name: c.join(o, "c_custkey", how).agg(F.count("*").alias("customers")).select(F.lit(name).alias("kind"), "customers")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, grouping(l_returnflag) * 2 + grouping(l_linestatus) as level, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "level", "n", "quantity")


@query("select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("""select o_custkey, o_orderkey, r, prev, quarter from (select o_custkey, o_orderkey, row_number() over w as r, lag(o_orderkey) over w as prev, ntile(4) over w as quarter from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where r <= 5""")
def rel_window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r"), F.lag("o_orderkey").over(w).alias("prev"), F.ntile(4).over(w).alias("quarter"))
    return rows.where("r <= 5").select("o_custkey", "o_orderkey", F.col("r").cast("long").alias("r"), "prev", F.col("quarter").cast("long").alias("quarter"))


@query("""select 'union' as op, count(*) as n from (select c_nationkey from customer union select s_nationkey from supplier) union all
select 'intersect', count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier) union all
select 'except', count(*) from (select n_nationkey from nation except select s_nationkey from supplier)""")
def rel_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return count(c.union(s).distinct(), "union").unionByName(count(c.intersect(s), "intersect")).unionByName(count(n.subtract(s), "except"))


@query("select n_name, r_name, coalesce(suppliers, 0)::bigint as suppliers from nation full join region on n_regionkey = r_regionkey left join (select s_nationkey, count(*) as suppliers from supplier group by s_nationkey) on s_nationkey = n_nationkey")
def rel_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey, "full").join(s, n.n_nationkey == s.s_nationkey, "left")
    return rows.select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant for a time stamp, as event-time operators need it (session zone UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select strftime(time_bucket(interval 1 day, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def evt_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("""select strftime(s, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from (select time_bucket(interval 6 hours, ts) - to_hours((6 * i)::int) as s from events, (select unnest(range(0, 4)) as i)) group by s""")
def evt_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hours then 0 else 1 end as fresh, event_id from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, s""")
def evt_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""with p as (select user_id, event_id, ts from events where event_type = 'purchase'), c as (select user_id, event_id, ts from events where event_type = 'click')
select p.event_id as event_id, c.event_id as last_click from p asof left join (select user_id, ts, max(event_id) as event_id from c group by user_id, ts) c on p.user_id = c.user_id and p.ts >= c.ts""")
def evt_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's last click before it: one pass over the union of both sides in order of time, no range join."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    side = F.when(F.col("event_type") == "click", 0).otherwise(1)
    w = Window.partitionBy("user_id").orderBy("ts", side, "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = e.withColumn("last_click", F.last(click, ignorenulls=True).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", "last_click")


@query("select event_type, count(distinct user_id) as users, (props::json ->> 'k')::int % 2 as parity from events group by event_type, parity")
def evt_json_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("parity", F.from_json("props", "k int")["k"] % 2)
    return e.groupBy("event_type", "parity").agg(F.countDistinct("user_id").alias("users"))
