"""Queries around the engine's own: event time, rollups and as-of joins over the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.plans.registry import query
from threadloom.sources import tables as src


@query("ext_event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_event_windows(spark, d):
    e = src.read(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("ext_sessions", "with g as (select user_id, ts, sum(case when ts - p < interval '30 minutes' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events)) select user_id, min(ts) as first_ts, count(*) as n from g group by user_id, s")
def ext_sessions(spark, d):
    e = src.read(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return e.select("user_id", "first_ts", "n")


@query("ext_rollup", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return src.read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_asof", "select e.event_id, p.event_id as last_purchase from (select * from events where event_type = 'error') e asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts")
def ext_asof(spark, d):
    """As-of by one sort: the last purchase carried forward over the union of both sides."""
    e = src.read(spark, d, "events").filter("event_type in ('error', 'purchase')").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("asks"))
    order = Window.partitionBy("user_id").orderBy("ts", "asks", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("asks"), F.col("event_id")), ignorenulls=True).over(order)
    return e.withColumn("last_purchase", last).filter("asks").select("event_id", "last_purchase")
