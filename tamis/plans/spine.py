"""Relational forms that the other families don't show by themselves: range and as-of joins, cubes, frames, sliding windows, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Balance bands of customers: (name, least, below).
BANDS = (("debt", -1e9, 0.0), ("low", 0.0, 2500.0), ("middle", 2500.0, 7500.0), ("high", 7500.0, 1e9))


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def join_range(spark, d):
    """Customers by nation and balance band: a join on an interval, whose side of four rows is broadcast."""
    bands = F.broadcast(spark.createDataFrame(BANDS, "band string, least double, below double"))
    rows = _t(spark, d, "customer").join(bands, (F.col("c_acctbal") >= F.col("least")) & (F.col("c_acctbal") < F.col("below")))
    return rows.groupBy("c_nationkey", "band").agg(F.count("*").alias("customers"))


def join_asof(spark, d):
    """Each purchase with the last sign-up or click of its user before it: one sort by user instead of a join."""
    earlier = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") != "purchase", F.struct("event_id", "event_type")), ignorenulls=True).over(earlier)
    found = _t(spark, d, "events").withColumn("last", last).where("event_type = 'purchase'")
    return found.select("event_id", F.col("last.event_id").alias("before_id"), F.col("last.event_type").alias("before_type"))


def agg_cube(spark, d):
    """Lines by flag and status with all subtotals."""
    cube = _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("hundredths"))
    return cube.select("l_returnflag", "l_linestatus", "lines", "hundredths")


def agg_grouping_sets(spark, d):
    """Orders by status alone and by priority alone, and which of the two a row is."""
    sets = _t(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority")
    return sets.agg(F.count("*").alias("orders"), F.grouping_id().cast("long").alias("gid"))


def window_frame_rows(spark, d):
    """Mean size of a customer's last three orders at each order, in cents."""
    three = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return _t(spark, d, "orders").select("o_orderkey", F.sum(cents).over(three).alias("cents"), F.count("*").over(three).alias("n"))


def window_frame_range(spark, d):
    """A customer's orders in the 90 days that end with each order's day."""
    days = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.to_date("o_orderdate"))).rangeBetween(-90, 0)
    return _t(spark, d, "orders").select("o_orderkey", F.count("*").over(days).alias("n"))


def window_rank(spark, d):
    """Parts by size within brand: rank, dense rank and quarter."""
    by = Window.partitionBy("p_brand").orderBy("p_size")
    whole = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return _t(spark, d, "part").select("p_partkey", F.rank().over(by).alias("rank"), F.dense_rank().over(by).alias("dense"), F.ntile(4).over(whole).alias("quarter"))


def window_lag_lead(spark, d):
    """Seconds to a user's event before and after each event."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return _t(spark, d, "events").select("event_id", (at - F.lag(at).over(by)).alias("since"), (F.lead(at).over(by) - at).alias("until"))


def sliding_windows(spark, d):
    """Events by type in windows of six hours that begin every two."""
    windows = F.window(F.col("ts").cast("timestamp"), "6 hours", "2 hours")
    counted = _t(spark, d, "events").groupBy(windows.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n")


def session_windows(spark, d):
    """Sessions of a user that end after half an hour without an event."""
    held = _t(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    counted = held.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "events")


def union_distinct(spark, d):
    """Nations that have customers or suppliers."""
    a, b = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.union(b).distinct()


def intersect_except(spark, d):
    """Sizes of parts above and below a price: in both, and above only."""
    dear, cheap = _t(spark, d, "part").where("p_retailprice >= 1500").select("p_size"), _t(spark, d, "part").where("p_retailprice < 1500").select("p_size")
    both = dear.intersect(cheap).select("p_size", F.lit("both").alias("part"))
    return both.unionByName(dear.exceptAll(cheap).distinct().select("p_size", F.lit("more_above").alias("part")))


def array_ops(spark, d):
    """Least, largest and sum of each vector's components in 64ths, and how many are positive."""
    e = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    v = _t(spark, d, "embeddings").select("vec_id", e.alias("e"))
    return v.select("vec_id", F.array_min("e").alias("least"), F.array_max("e").alias("most"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("e", lambda x: x > 0)).alias("positive"))


def label_means(spark, d):
    """Each label's mean vector, component by component."""
    parts = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    return parts.groupBy("label", "at").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def sort_limit(spark, d):
    """The 50 dearest lines, ties by key."""
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net")).orderBy(F.desc("net"), "l_orderkey", "l_linenumber").limit(50)


def join_left(spark, d):
    """Suppliers with the customers of their nation, none included."""
    c = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    s = _t(spark, d, "supplier")
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("customers"))


def join_semi(spark, d):
    """Orders with a line that was sent back."""
    back = _t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return _t(spark, d, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def approx_distinct(spark, d):
    """About how many customers order in each priority; rows only, as the estimate is Spark's own."""
    return _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


_SETS = "select {} from part where p_retailprice {} 1500"
ORACLES = {
    "join_range": f"""with b(band, least, below) as (values {", ".join(f"('{n}', {a}, {b})" for n, a, b in BANDS)})
        select c_nationkey, band, count(*) as customers from customer join b on c_acctbal >= least and c_acctbal < below group by 1, 2""",
    "join_asof": """
        with s as (select *, last_value(case when event_type <> 'purchase' then struct_pack(i := event_id, t := event_type) end ignore nulls)
                       over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as l from events)
        select event_id, l.i as before_id, l.t as before_type from s where event_type = 'purchase'""",
    "agg_cube": "select l_returnflag, l_linestatus, count(*) as lines, cast(sum(cast(round(l_quantity * 100) as bigint)) as bigint) as hundredths from lineitem group by cube (1, 2)",
    "agg_grouping_sets": """select o_orderstatus, o_orderpriority, count(*) as orders, grouping_id(o_orderstatus, o_orderpriority) as gid from orders
        group by grouping sets ((o_orderstatus), (o_orderpriority))""",
    "window_frame_rows": """select o_orderkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) over w as bigint) as cents, count(*) over w as n from orders
        window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row)""",
    "window_frame_range": """select o_orderkey, count(*) over (partition by o_custkey order by cast(o_orderdate as date) - date '1970-01-01' range between 90 preceding and current row) as n from orders""",
    "window_rank": """select p_partkey, cast(rank() over w as integer) as rank, cast(dense_rank() over w as integer) as dense,
        cast(ntile(4) over (partition by p_brand order by p_size, p_partkey) as integer) as quarter from part window w as (partition by p_brand order by p_size)""",
    "window_lag_lead": """select event_id, epoch_us(ts) - lag(epoch_us(ts)) over w as since, lead(epoch_us(ts)) over w - epoch_us(ts) as until from events
        window w as (partition by user_id order by ts, event_id)""",
    "sliding_windows": """
        with e as (select event_type, time_bucket(interval '2 hours', ts, timestamp '1970-01-01') as slot from events),
        w as (select event_type, slot - to_hours(2 * cast(i as integer)) as began from e, range(3) r(i))
        select began, event_type, count(*) as n from w group by 1, 2""",
    "session_windows": """
        with f as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w >= 1800000000 then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from f)
        select user_id, min(ts) as began, count(*) as events from s group by user_id, s""",
    "union_distinct": "select c_nationkey as nation from customer union select s_nationkey from supplier",
    "intersect_except": f"""({_SETS.format("p_size, 'both' as part", ">=")} intersect {_SETS.format("p_size, 'both'", "<")})
        union all (select distinct p_size, 'more_above' from ({_SETS.format("p_size", ">=")} except all {_SETS.format("p_size", "<")}))""",
    "array_ops": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 64) as bigint)) as e from embeddings)
        select vec_id, list_min(e) as least, list_max(e) as most, cast(list_sum(e) as bigint) as total, cast(len(list_filter(e, lambda x: x > 0)) as integer) as positive from v""",
    "label_means": """
        with p as (select label, unnest(range(len(embedding))) as place, unnest(embedding) as x from embeddings)
        select label, cast(place as integer) as "at", round(avg(cast(x as double)), 6) as mean from p group by label, place""",
    "sort_limit": """select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 2) as net from lineitem order by net desc, l_orderkey, l_linenumber limit 50""",
    "join_left": """
        with c as (select c_nationkey, count(*) as n from customer where c_mktsegment = 'BUILDING' group by 1)
        select s_suppkey, coalesce(n, 0) as customers from supplier left join c on s_nationkey = c_nationkey""",
    "join_semi": "select o_orderstatus, count(*) as orders from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "approx_distinct")}
