"""Relational breadth on the star schema: joins, grouping sets, windows, set operations, approximations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import catalog
from .registry import query


def t(spark, folder, name):
    return catalog.table(spark, folder, name)


@query("rel_pricing_summary", "AGG-17 SRT-01", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing(spark, folder):
    li = t(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("rel_joins", "JN-09", """
SELECT n_name, r_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def joins(spark, folder):
    li = t(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = t(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c, n, r = t(spark, folder, "customer").select("c_custkey", "c_nationkey"), t(spark, folder, "nation"), t(spark, folder, "region")
    held = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return held.groupBy("n_name", "r_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("rel_semi_anti", "JN-09", """
SELECT c_custkey, 'none' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'large' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def semi_anti(spark, folder):
    c, o = t(spark, folder, "customer").select("c_custkey"), t(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    none = c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("none"))
    return none.unionByName(c.join(o.where("o_totalprice > 400000"), "c_custkey", "left_semi").withColumn("kind", F.lit("large")))


@query("rel_full_outer", "JN-09", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer(spark, folder):
    c = t(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    s = t(spark, folder, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("rel_range_join", "JN-09", "SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1 hour' GROUP BY a.event_id")
def range_join(spark, folder):
    # Hour bins bound each side's candidates to two bins of the same user.
    e = t(spark, folder, "events").select("event_id", "user_id", "ts", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("bin"))
    b = e.select("user_id", F.col("ts").alias("ts2"), F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"))
    near = e.join(b, ["user_id", "bin"]).where("ts2 > ts AND ts2 <= ts + INTERVAL 1 HOUR")
    return near.groupBy("event_id").agg(F.count("*").alias("near"))


@query("rel_cube", "AGG-17", "SELECT c_mktsegment, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_name)")
def cube(spark, folder):
    c = t(spark, folder, "customer").join(t(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("rel_rollup_having", "AGG-17", "SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS sizes FROM part GROUP BY ROLLUP (p_brand, p_type) HAVING count(*) > 5")
def rollup(spark, folder):
    return t(spark, folder, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_distinct("p_size").alias("sizes")).where("n > 5")


@query("rel_windows", "WIN-07", """
SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS drnk, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quart, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), -1) AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def windows(spark, folder):
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, folder, "orders").select("o_orderkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("drnk"), F.ntile(4).over(v).alias("quart"), F.coalesce(F.lead("o_orderkey").over(v), F.lit(-1)).alias("nxt"))


@query("rel_topn_per_group", "WIN-05 WIN-07", "SELECT c_nationkey, c_custkey, r FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def topn(spark, folder):
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t(spark, folder, "customer").select("c_nationkey", "c_custkey", r.alias("r")).where("r <= 3")


@query("rel_setops", "SET-06", """
SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT p_size AS k FROM part EXCEPT SELECT c_nationkey FROM customer)""")
def setops(spark, folder):
    c, s, p = (t(spark, folder, n).select(F.col(k).alias("k")) for n, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("part", "p_size")))
    return c.intersect(s).select(F.lit("both").alias("kind"), "k").unionByName(p.subtract(c).select(F.lit("only").alias("kind"), "k"))


@query("rel_bag_setops", "SET-06", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def bag_setops(spark, folder):
    c, s = (t(spark, folder, n).select(F.col(k).alias("k")) for n, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return c.exceptAll(s).groupBy("k").agg(F.count("*").alias("n"))


@query("rel_pivot", "AGG-17 PRJ-02", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def pivot(spark, folder):
    p = t(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("rel_approx", "AGG-17")
def approx(spark, folder):
    return t(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_percentile("l_extendedprice", [0.5, 0.9], 1000).alias("q"))


@query("rel_scalar_functions", "SC-17 SC-11", """
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS mon, datediff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, round(ln(o_totalprice), 6) AS lg, o_orderkey & 255 AS low, round(sin(o_totalprice), 6) AS s FROM orders""")
def scalars(spark, folder):
    d = F.col("o_orderdate")
    return t(spark, folder, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.date_trunc("month", d.cast("timestamp")).cast("timestamp_ntz").alias("mon"), F.datediff(d, F.lit("1992-01-01").cast("date")).alias("days"), F.round(F.ln("o_totalprice"), 6).alias("lg"), F.col("o_orderkey").bitwiseAND(255).alias("low"), F.round(F.sin("o_totalprice"), 6).alias("s"))


@query("rel_correlated", "JN-09 AGG-17", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated(spark, folder):
    mean = F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))
    return t(spark, folder, "orders").select("o_orderkey", "o_totalprice", mean.alias("m")).where("o_totalprice > 2 * m").select("o_orderkey")
