"""General relational queries over the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamis.operators import ordered


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def pricing_summary(spark, d):
    lines = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.count("*").alias("n"))


def revenue_rollup(spark, d):
    """Order value by region and nation with subtotals."""
    names = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


def orphan_customers(spark, d):
    """Customers without an order."""
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


def busy_parents(spark, d):
    """Orders with at least six lines, and what they hold."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty")).where("lines >= 6")
    return lines.join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "o_custkey", "lines", "qty")


def top_customers(spark, d):
    """Three best customers of each segment by order value."""
    value = _t(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    joined = value.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("value"), "o_custkey"))
    return joined.withColumn("rank", rank).where("rank <= 3").select("c_mktsegment", "rank", "o_custkey", "value")


def event_hours(spark, d):
    """Tumbling hours by event type."""
    return _t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def event_sessions(spark, d):
    """Sessions of a user: a gap of over an hour begins a new one."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(by_user) > 3_600_000_000, 1).otherwise(0)
    marked = _t(spark, d, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(by_user))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def event_props(spark, d):
    """A field of the JSON column by type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"), F.count(k).alias("n"))


def era_lookup(spark, d):
    """Orders by the era that holds on their date: each era holds until the next begins."""
    at = F.to_date("o_orderdate")
    era = F.when(at < F.lit("1995-01-01").cast("date"), "first").when(at < F.lit("1997-07-01").cast("date"), "second").otherwise("third")
    return _t(spark, d, "orders").groupBy(era.alias("era"), "o_orderstatus").agg(F.count("*").alias("n"))


def coverage_matrix(spark, d):
    """Orders by priority and status, a column for each status."""
    return _t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


def key_overlap(spark, d):
    """Customer and supplier keys: in both, and in one only."""
    a, b = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    parts = (("both", a.intersect(b)), ("customer", a.exceptAll(b)), ("supplier", b.exceptAll(a)))
    out = None
    for name, rows in parts:
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


def value_quantiles(spark, d):
    """Exact quantiles of order value by priority."""
    found = ordered.quantiles(_t(spark, d, "orders"), "o_orderpriority", "o_totalprice", [0.1, 0.5, 0.9])
    return found.select("o_orderpriority", *(F.round(f"q{i}", 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def nested_mean(spark, d):
    """Mean over nations of the mean over customers of their mean order value, by region."""
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = orders.groupBy("n_regionkey", "n_nationkey", "c_custkey").agg(F.avg("o_totalprice").alias("m"))
    two = one.groupBy("n_regionkey", "n_nationkey").agg(F.avg("m").alias("m"))
    return two.groupBy("n_regionkey").agg(F.round(F.avg("m"), 4).alias("mean_value"))


ORACLES = {
    "pricing_summary": """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net, count(*) as n
        from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
    "revenue_rollup": """select r_name, n_name, count(*) as orders, round(sum(o_totalprice), 2) as value from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""",
    "orphan_customers": "select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "busy_parents": """select l_orderkey, o_custkey, count(*) as lines, round(sum(l_quantity), 2) as qty from lineitem join orders on l_orderkey = o_orderkey
        group by 1, 2 having count(*) >= 6""",
    "top_customers": """with v as (select o_custkey, round(sum(o_totalprice), 2) as value from orders group by 1)
        select c_mktsegment, cast(row_number() over (partition by c_mktsegment order by value desc, o_custkey) as integer) as rank, o_custkey, value
        from v join customer on o_custkey = c_custkey qualify rank <= 3""",
    "event_hours": "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 2) as value from events group by 1, 2",
    "event_sessions": """with f as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w > 3600000000 then 1 else 0 end as fresh from events
            window w as (partition by user_id order by ts, event_id)),
        s as (select *, cast(sum(fresh) over (partition by user_id order by ts, event_id) as bigint) as session from f)
        select user_id, session, count(*) as events, min(ts) as began, max(ts) as ended from s group by 1, 2""",
    "event_props": """select event_type, cast(sum(cast(json_extract(props, '$.k') as integer)) as bigint) as total, max(cast(json_extract(props, '$.k') as integer)) as most,
        count(json_extract(props, '$.k')) as n from events group by 1""",
    "era_lookup": """select case when o_orderdate < '1995-01-01' then 'first' when o_orderdate < '1997-07-01' then 'second' else 'third' end as era, o_orderstatus, count(*) as n
        from orders group by 1, 2""",
    "coverage_matrix": """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o,
        count(*) filter (o_orderstatus = 'P') as p from orders group by 1""",
    "key_overlap": """select 'both' as part, count(*) as n from customer join supplier on c_custkey = s_suppkey
        union all select 'customer', count(*) from customer where c_custkey not in (select s_suppkey from supplier)
        union all select 'supplier', count(*) from supplier where s_suppkey not in (select c_custkey from customer)""",
    "value_quantiles": """select o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) as p10, round(quantile_cont(o_totalprice, 0.5), 4) as p50,
        round(quantile_cont(o_totalprice, 0.9), 4) as p90 from orders group by 1""",
    "nested_mean": """with one as (select n_regionkey, n_nationkey, c_custkey, avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey
            join nation on c_nationkey = n_nationkey group by all), two as (select n_regionkey, n_nationkey, avg(m) as m from one group by all)
        select n_regionkey, round(avg(m), 4) as mean_value from two group by 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
