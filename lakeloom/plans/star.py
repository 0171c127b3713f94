"""Classic relational queries over the star schema; money is summed in whole cents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.session import table


def _t(spark, sf, name):
    return table(spark, sf, name)


def _cents(c):
    return F.round(c * 100).cast("long")


def _revenue():
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")


_REV = "round(l_extendedprice * (1 - l_discount) * 100)::BIGINT"


def star_pricing_summary(spark, sf):
    d = _t(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(_cents(F.col("l_extendedprice"))).alias("sum_base"), F.sum(_revenue()).alias("sum_disc"), F.count(F.lit(1)).alias("n"),
    )


def star_topk_customers(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    d = _t(spark, sf, "lineitem").select("l_orderkey", _revenue().alias("rev")).groupBy("l_orderkey").agg(F.sum("rev").alias("rev"))
    by = d.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("rev").alias("rev"))
    c = _t(spark, sf, "customer").select("c_custkey", "c_name")
    return by.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "rev").orderBy(F.desc("rev"), "c_custkey").limit(20)


def _geo(spark, sf):
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))


def star_rollup_region(spark, sf):
    return _geo(spark, sf).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.sum(_cents(F.col("c_acctbal"))).alias("balance"), F.grouping_id().alias("level"))


def star_cube(spark, sf):
    return _t(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum(_cents(F.col("o_totalprice"))).alias("total"))


def star_semi_anti(spark, sf):
    late = _t(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    c = _t(spark, sf, "customer")
    some = c.join(late, F.col("c_custkey") == F.col("k"), "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("with_final"))
    none = c.join(late, F.col("c_custkey") == F.col("k"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("without_final"))
    return some.join(none, "c_mktsegment", "full_outer")


def star_setops(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    parts = [("both", c.intersect(s)), ("customers_only", c.exceptAll(s)), ("either", c.union(s).distinct())]
    out = None
    for name, d in parts:
        one = d.agg(F.count(F.lit(1)).alias("nations")).select(F.lit(name).alias("part"), "nations")
        out = one if out is None else out.unionByName(one)
    return out


def star_running_total(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = _t(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).withColumn("run", F.sum(_cents(F.col("o_totalprice"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.filter("rn <= 3").select("o_custkey", "o_orderkey", "rn", "run")


def star_asof(spark, sf):
    """For every event, the user's latest purchase at or before it: one sort per user, no pairing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = _t(spark, sf, "events").withColumn("p", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return e.filter("event_type <> 'purchase'").select("event_id", F.col("p").alias("purchase_id"))


def star_range_join(spark, sf):
    """Line items by price band: a bounded dimension of bands."""
    bands = spark.createDataFrame([(0, 0, 10000), (1, 10000, 40000), (2, 40000, 10**9)], "band int, low long, high long")
    d = _t(spark, sf, "lineitem").join(F.broadcast(bands), (F.col("l_extendedprice") >= F.col("low")) & (F.col("l_extendedprice") < F.col("high")))
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"))


def star_part_revenue_share(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_brand")
    d = _t(spark, sf, "lineitem").select("l_partkey", _revenue().alias("rev")).groupBy("l_partkey").agg(F.sum("rev").alias("rev"))
    by = d.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("rev").alias("rev"))
    return by.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("rev"))).cast("long"))


def star_pivot_status(spark, sf):
    d = _t(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return d.na.fill(0).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


def star_supplier_nation_volume(spark, sf):
    s = _t(spark, sf, "supplier").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    o = _t(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", _revenue().alias("rev"))
    return d.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name", "year").agg(F.sum("rev").alias("rev"))


QUERIES = {
    "star_pricing_summary": (star_pricing_summary, f"SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum_base, sum({_REV})::BIGINT AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "star_topk_customers": (star_topk_customers, f"SELECT c_custkey, c_name, sum({_REV})::BIGINT AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY rev DESC, c_custkey LIMIT 20"),
    "star_rollup_region": (star_rollup_region, "SELECT r_name, n_name, count(*) AS customers, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS balance, grouping_id(r_name, n_name) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"),
    "star_cube": (star_cube, "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "star_semi_anti": (star_semi_anti, "WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT c_mktsegment, nullif(count(*) FILTER (c_custkey IN (SELECT k FROM f)), 0) AS with_final, nullif(count(*) FILTER (c_custkey NOT IN (SELECT k FROM f)), 0) AS without_final FROM customer GROUP BY 1"),
    "star_setops": (star_setops, "WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT 'both' AS part, count(*) AS nations FROM (SELECT * FROM c INTERSECT SELECT * FROM s) UNION ALL SELECT 'customers_only', count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM c UNION SELECT * FROM s)"),
    "star_running_total": (star_running_total, "SELECT o_custkey, o_orderkey, row_number() OVER w::INT AS rn, (sum(round(o_totalprice * 100)::BIGINT) OVER w)::BIGINT AS run FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) QUALIFY rn <= 3"),
    "star_asof": (star_asof, "WITH e AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase_id FROM events) SELECT event_id, purchase_id FROM e WHERE event_type <> 'purchase'"),
    "star_range_join": (star_range_join, "SELECT CASE WHEN l_extendedprice < 10000 THEN 0 WHEN l_extendedprice < 40000 THEN 1 ELSE 2 END AS band, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1"),
    "star_part_revenue_share": (star_part_revenue_share, f"WITH b AS (SELECT p_brand, sum({_REV})::BIGINT AS rev FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT *, dense_rank() OVER (ORDER BY rev DESC) AS rank FROM b"),
    "star_pivot_status": (star_pivot_status, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"),
    "star_supplier_nation_volume": (star_supplier_nation_volume, f"SELECT n_name, year(o_orderdate) AS year, sum({_REV})::BIGINT AS rev FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"),
}
