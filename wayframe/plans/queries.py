"""Queries over the star-schema tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import agg, geo
from ..functions.text import branch_of, contains_ignoring_case, line_of, natural_number
from ..operators import relational as rel
from ..operators.checkpoints import checkpointed
from ..policy import BottleneckPolicy, BunchingPolicy, DemandPolicy, RevenuePolicy, TransferPolicy
from ..sources import files
from ..streaming import bottlenecks, bunching
from . import audit, catalog, demand, feed, simulation, streets, transfers
from . import proxy as px
from .proxy import hav_sql, table, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r4(c):
    return F.round(c, 4)


# projections and predicates


@query("SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_discount, 0), -1) AS discount, GREATEST(l_quantity, 25.0) AS at_least, LEAST(l_tax, 0.04) AS at_most, CAST(round_even(l_quantity/4, 0) AS BIGINT) AS quarter FROM lineitem")
def p01_projection(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.coalesce(F.nullif(F.col("l_discount"), F.lit(0.0)), F.lit(-1.0)).alias("discount"), F.greatest("l_quantity", F.lit(25.0)).alias("at_least"),
        F.least("l_tax", F.lit(0.04)).alias("at_most"), F.bround(F.col("l_quantity") / 4).cast("long").alias("quarter"),
    )


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS' THEN 'brass' WHEN p_size > 25 THEN 'large' ELSE 'other' END AS kind,
       CASE WHEN p_retailprice <= 1000 THEN 0 WHEN p_retailprice <= 1200 THEN 1 WHEN p_retailprice <= 1500 THEN 2 ELSE 3 END AS band FROM part""")
def p03_case_and_bands(spark, d):
    kind = F.when(F.col("p_type").endswith("BRASS"), "brass").when(F.col("p_size") > 25, "large").otherwise("other")
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), audit.band(F.col("p_retailprice"), [1000, 1200, 1500]).alias("band"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000")
def p04_optional_filters(spark, d):
    given = {"priority": ("1-URGENT", F.col("o_orderpriority") == "1-URGENT"), "status": (None, F.col("o_orderstatus") == "F"), "price": (1000, F.col("o_totalprice") > 1000)}
    return rel.optional_filters(table(spark, d, "orders"), given).select("o_orderkey", "o_totalprice")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p_partkey, NULLIF(p_size % 5, 0) AS k FROM part) a
       JOIN (SELECT p_partkey, NULLIF(p_size % 5, 0) AS k FROM part) b ON a.k IS NOT DISTINCT FROM b.k AND b.p_partkey = a.p_partkey + 5""")
def p05_null_safe_equality(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("k"))
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("k").alias("ka")), p.select(F.col("p_partkey").alias("b"), F.col("k").alias("kb"))
    return a.join(b, F.col("ka").eqNullSafe(F.col("kb")) & (F.col("b") == F.col("a") + 5)).select("a", "b")


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%page=2%' OR url ILIKE '%utm\\_source%' ESCAPE '\\'")
def p06_escaped_search(spark, d):
    return table(spark, d, "pages").where(contains_ignoring_case(F.col("url"), "PAGE=2") | contains_ignoring_case(F.col("url"), "utm_source")).select("page_id", "url")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-19'")
def p07_half_open_window(spark, d):
    lo, hi = F.to_timestamp(F.lit("2024-01-10")), F.to_timestamp(F.lit("2024-01-20"))
    rows = table(spark, d, "events").where((F.col("ts") >= lo) & (F.col("ts") < hi))
    return rows.where(F.to_date("ts").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-19").cast("date"))).select("event_id", "user_id")


@query("""SELECT o_orderkey, CAST(COUNT(*) AS BIGINT) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE o_orderdate < TIMESTAMP '1995-07-01' AND COALESCE(l_shipdate, o_orderdate) >= TIMESTAMP '1995-01-01' GROUP BY o_orderkey""")
def p08_interval_overlap(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    stamp = lambda s: F.to_timestamp(F.lit(s))
    return rows.where(rel.overlaps(F.col("o_orderdate"), F.col("l_shipdate"), F.col("o_orderdate"), stamp("1995-01-01"), stamp("1995-07-01"))).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT c_custkey FROM customer WHERE list_contains(['BUILDING','MACHINERY'], c_mktsegment) AND c_nationkey IN (1, 3, 5, 7)")
def p10_membership(spark, d):
    return table(spark, d, "customer").where(F.array_contains(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("c_mktsegment")) & F.col("c_nationkey").isin(1, 3, 5, 7)).select("c_custkey")


@query(with_("routes") + """SELECT route_id, upper(NULLIF(regexp_extract(short_name, '^\\s*(\\d+|[A-Za-z]+)', 1), '')) AS line,
       COALESCE(NULLIF(trim(regexp_replace(short_name, '^\\s*(\\d+|[A-Za-z]+)', '')), ''), 'TRONCAL') AS branch FROM routes""")
def p11_line_and_branch(spark, d):
    n = F.col("short_name")
    return px.routes(spark, d).select("route_id", line_of(n).alias("line"), branch_of(n).alias("branch"))


@query(with_("stops") + "SELECT stop_id FROM stops WHERE lon BETWEEN -58.6 AND -58.3 AND lat BETWEEN -34.7 AND -34.5")
def p12_bounding_box(spark, d):
    return catalog.stops_in_box(px.stops(spark, d), (-58.6, -34.7, -58.3, -34.5)).select("stop_id")


@query(with_("stops") + """SELECT a.stop_id, CAST(least(x, 360 - x) AS DOUBLE) AS turn FROM (SELECT stop_id, abs(((stop_id*37)%360) - ((stop_id*91)%360)) % 360 AS x FROM stops) a WHERE least(x, 360 - x) <= 60""")
def p14_angle_tolerance(spark, d):
    x = geo.angle_diff((F.col("stop_id") * 37 % 360).cast("double"), (F.col("stop_id") * 91 % 360).cast("double"))
    return px.stops(spark, d).select("stop_id", r4(x).alias("turn")).where("turn <= 60")


# joins


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j01_inner_star(spark, d):
    t = lambda n: table(spark, d, n)
    return (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS seq FROM lineitem GROUP BY 1),
       k AS (SELECT seq, CAST(COUNT(*) AS BIGINT) AS same FROM s GROUP BY 1) SELECT l_orderkey, same FROM s JOIN k USING (seq)""")
def j02_array_key(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("seq"))
    return s.join(s.groupBy("seq").agg(F.count(F.lit(1)).alias("same")), "seq").select("l_orderkey", "same")


@query("SELECT c_custkey, CAST(COUNT(o_orderkey) AS BIGINT) AS orders, COALESCE(MAX(o_totalprice), 0) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j03_left_outer(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("most"))
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("most", F.lit(0.0)).alias("most"))


@query("""SELECT COALESCE(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey + 3 AS k, COUNT(*) AS n FROM customer GROUP BY 1) a
       FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def j04_full_outer(spark, d):
    a = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 3).alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY)")
def j05_semi(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"))
    return o.join(li, late, "left_semi").select("o_orderkey")


@query("SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1, 2, 3")
def j08_ordered_pairs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = rel.ordered_pairs(li, ["l_orderkey"], "l_linenumber", ["l_partkey"])
    return pairs.groupBy("l_orderkey", F.col("a_l_linenumber").alias("a"), F.col("b_l_linenumber").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(with_("route_stops") + "SELECT a.route_id, a.stop_seq AS a, b.stop_seq AS b FROM route_stops a JOIN route_stops b ON a.route_id = b.route_id AND b.stop_seq BETWEEN a.stop_seq + 1 AND a.stop_seq + 6")
def j09_band_on_ordinal(spark, d):
    s = px.route_stops(spark, d)
    a, b = s.select("route_id", F.col("stop_seq").alias("a")), s.select("route_id", F.col("stop_seq").alias("b"))
    return a.join(b, "route_id").where(F.col("b").between(F.col("a") + 1, F.col("a") + 6))


@query(with_("stops", "spots") + f"SELECT stop_id, spot_id, round({hav_sql('lon', 'lat', 'r_lon', 'r_lat')}, 4) AS metres FROM stops, spots WHERE {hav_sql('lon', 'lat', 'r_lon', 'r_lat')} <= 4000")
def j10_distance_join(spark, d):
    return rel.distance_join(px.stops(spark, d), px.spots(spark, d), 4000.0).select("stop_id", "spot_id", r4("distance_m").alias("metres"))


@query("""WITH bands AS (SELECT * FROM (VALUES (0, 100, 3), (100, 500, 5), (500, NULL, 9)) t(low, high, fee))
       SELECT o_orderkey, fee FROM orders JOIN bands ON o_totalprice/100 >= low AND (high IS NULL OR o_totalprice/100 < high)""")
def j12_band_lookup(spark, d):
    bands = spark.createDataFrame([(0, 100, 3), (100, 500, 5), (500, None, 9)], "low int, high int, fee int")
    rows = table(spark, d, "orders").withColumn("value", F.col("o_totalprice") / 100)
    return rel.band_lookup(rows, bands, "value", "low", "high").select("o_orderkey", "fee")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def j13_latest_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return rel.first_per_key(e, ["user_id"], ["ts", "event_id"], descending=True).select("user_id", "event_id", "event_type")


@query("""SELECT e.event_id, p.event_id AS purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type <> 'purchase'
       QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC) = 1""")
def j13_as_of(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase"))
    return rel.as_of_latest(e.where("event_type <> 'purchase'"), bought, ["user_id"], "ts", "bought", ["purchase"]).select("event_id", "purchase")


@query(with_("stops", "spots") + f"SELECT stop_id, spot_id, round({hav_sql('lon', 'lat', 'r_lon', 'r_lat')}, 3) AS metres FROM stops, spots QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY {hav_sql('lon', 'lat', 'r_lon', 'r_lat')}, spot_id) = 1")
def j14_nearest(spark, d):
    return rel.nearest(px.stops(spark, d), px.spots(spark, d), ["stop_id"], 6000.0, ["spot_id"]).select("stop_id", "spot_id", F.round("distance_m", 3).alias("metres"))


@query("""SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) o""")
def j15_top_k_per_row(spark, d):
    o = rel.top_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, round(o_totalprice / (SELECT MAX(o_totalprice) FROM orders), 6) AS share FROM orders")
def j17_scalar_subquery(spark, d):
    o = table(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.max("o_totalprice").alias("most")))).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("most"), 6).alias("share"))


@query("""SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey OR (n_regionkey = 1 AND s_suppkey % 25 = n_nationkey)
       GROUP BY ALL""")
def j21_or_condition(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    a = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey")
    b = s.withColumn("k", (F.col("s_suppkey") % 25).cast("int")).join(n.where("n_regionkey = 1"), F.col("k") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey")
    return a.union(b).distinct()


# aggregates


@query("""SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, round(SUM(l_extendedprice*(1-l_discount)), 2) AS revenue, round(AVG(l_discount), 6) AS avg_disc, MIN(l_shipdate) AS first_ship, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def a01_group_by(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.min("l_shipdate").cast("timestamp_ntz").alias("first_ship"), F.count(F.lit(1)).alias("n"),
    )


@query("SELECT c_nationkey, CAST(COUNT(DISTINCT (c_mktsegment, NULLIF(c_custkey % 4, 0))) AS BIGINT) AS kinds FROM customer GROUP BY 1")
def a03_distinct_rows(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_distinct(F.struct("c_mktsegment", F.nullif(F.col("c_custkey") % 4, F.lit(0)))).alias("kinds"))


@query("SELECT event_type, CAST(COUNT(*) FILTER (WHERE value > 50) AS BIGINT) AS high, SUM(value) FILTER (WHERE user_id % 2 = 0) IS NOT NULL AS has_even, bool_or(value > 99) AS any_top FROM events GROUP BY 1")
def a04_filtered(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))).isNotNull().alias("has_even"), F.bool_or(F.col("value") > 99).alias("any_top"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.9), 4) AS q9 FROM lineitem GROUP BY 1""")
def a05_percentile_cont(spark, d):
    p = lambda s: r4(agg.percentile_cont(F.col("l_extendedprice"), s))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(p(0.25).alias("q1"), p(0.5).alias("q2"), p(0.9).alias("q9"))


@query("SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS parts FROM lineitem GROUP BY 1")
def a07_ordered_list(spark, d):
    keys = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(agg.ordered_list(F.col("l_partkey"), *keys).cast("array<string>"), ",").alias("parts"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1")
def a08_distinct_list(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1")
def a09_first_by(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(agg.first_by(F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderkey")).alias("first_order"))


@query("SELECT l_orderkey, CASE WHEN COUNT(*) FILTER (WHERE l_returnflag='R') = 1 THEN MAX(l_partkey) FILTER (WHERE l_returnflag='R') END AS returned FROM lineitem GROUP BY 1")
def a10_only_one(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(agg.only_one(F.col("l_partkey"), F.col("l_returnflag") == "R").alias("returned"))


@query("SELECT l_partkey, round(GREATEST(SUM(l_quantity*l_discount)/NULLIF(SUM(l_quantity),0), 0.05), 6) AS mean FROM lineitem GROUP BY 1 HAVING COUNT(*) > 5")
def a11_weighted_mean_floor(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.greatest(agg.weighted_mean(F.col("l_discount"), F.col("l_quantity")), F.lit(0.05)), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 5").select("l_partkey", "mean")


@query("SELECT round(quantile_cont(r, 0.5), 6) AS median_pace FROM (SELECT l_suppkey, SUM(l_extendedprice)/SUM(l_quantity) AS r FROM lineitem GROUP BY 1)")
def a12_median_of_ratios(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("r"))
    return per.agg(F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_pace"))


@query("""WITH w AS (SELECT l_suppkey, l_extendedprice AS v, l_partkey AS k, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
       c AS (SELECT *, SUM(q) OVER (PARTITION BY l_suppkey ORDER BY v, k ROWS UNBOUNDED PRECEDING) AS run, SUM(q) OVER (PARTITION BY l_suppkey) AS total FROM w)
       SELECT l_suppkey, MIN(v) AS median FROM c WHERE run >= total/2 GROUP BY 1""")
def a20_weighted_median(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("median"), "l_quantity", "l_partkey")
    return agg.weighted_median(rows, ["l_suppkey"], "median", "l_quantity", "l_partkey")


@query("SELECT event_type, list_sort(list(value))[CAST(floor((COUNT(*)-1)*0.9) AS INTEGER)+1] AS p90 FROM events GROUP BY 1")
def a24_index_percentile(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(agg.index_percentile(F.col("value"), 0.9).alias("p90"))


@query("SELECT hour(ts) AS hour, CAST(COUNT(*) AS BIGINT) AS pairs FROM (SELECT user_id, hour(ts) AS h, ts FROM events) GROUP BY 1 HAVING COUNT(DISTINCT CAST(ts AS DATE)) > 1")
def a28_multi_date_hours(spark, d):
    e = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(F.to_date("ts")).alias("dates"))
    return e.where("dates > 1").select("hour", "pairs")


@query("""SELECT event_type, CAST(COUNT(DISTINCT least(19, CAST(floor(value/5) AS BIGINT))) AS DOUBLE)/20 AS bins, CAST(COUNT(*) FILTER (WHERE value >= 1) AS BIGINT) AS at_1, CAST(COUNT(*) FILTER (WHERE value >= 10) AS BIGINT) AS at_10 FROM events GROUP BY 1""")
def a30_bins_and_cuts(spark, d):
    bins = F.count_distinct(F.least(F.lit(19), F.floor(F.col("value") / 5))) / F.lit(20.0)
    return table(spark, d, "events").groupBy("event_type").agg(bins.alias("bins"), F.count_if(F.col("value") >= 1).alias("at_1"), F.count_if(F.col("value") >= 10).alias("at_10"))


# windows


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER w AS INTEGER) AS ordinal, CAST(COUNT(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS lines FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def w02_ordinal_and_count(spark, d):
    by = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("ordinal"), F.count(F.lit(1)).over(by).alias("lines"))


@query("SELECT event_id, lag(event_id) OVER w AS before, lag(event_id, 3) OVER w AS third, lead(value) OVER w AS after, lag(value > 50, 1, FALSE) OVER w AS was_high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w04_lead_lag(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lag("event_id", 3).over(w).alias("third"), F.lead("value").over(w).alias("after"), F.lag(F.col("value") > 50, 1, False).over(w).alias("was_high"))


@query(with_("route_stops") + "SELECT route_id, stop_seq, CAST(COALESCE(SUM(stop_id) OVER (PARTITION BY route_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM route_stops")
def w07_prefix_sum(spark, d):
    return rel.prefix_sum(px.route_stops(spark, d), ["route_id"], ["stop_seq"], "stop_id", "before").select("route_id", "stop_seq", "before")


@query("SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, CAST(COUNT(*) FILTER (WHERE value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM events")
def w08_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("high"), F.count_if(F.col("value") > 50).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


@query("""SELECT user_id, run, MIN(event_type) AS event_type, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT *, CAST(SUM(CASE WHEN event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
       FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY 1, 2""")
def w10_gaps_and_islands(spark, d):
    keys, order = ["user_id"], ["ts", "event_id"]
    e = table(spark, d, "events").withColumn("breaks", rel.changed("event_type", keys, order))
    return rel.runs(e, keys, order, F.col("breaks")).groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, n, value FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY n))
       WHERE (b IS NULL OR value < b) AND (a IS NULL OR value <= a)""")
def w12_local_minima(spark, d):
    e = table(spark, d, "events").select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("n"))
    return rel.local_minima(e, ["user_id"], "n", "value")


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS t, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE t = event_type AND (v - 50) * (value - 50) < 0")
def w13_reversal(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumns({"t": F.lag("event_type").over(w), "v": F.lag("value").over(w)})
    return e.where((F.col("t") == F.col("event_type")) & ((F.col("v") - 50) * (F.col("value") - 50) < 0)).select("event_id")


@query("SELECT p_brand, p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 10")
def w16_top_n(spark, d):
    return rel.top_n(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 10, rank="rank").select("p_brand", "p_partkey", "rank")


# order, sets


@query(with_("routes") + "SELECT route_id, short_name FROM routes ORDER BY TRY_CAST(regexp_extract(short_name, '^\\s*(\\d{1,9})', 1) AS INTEGER) NULLS LAST, short_name, route_id LIMIT 20 OFFSET 5")
def o01_natural_page(spark, d):
    n = F.col("short_name")
    return rel.page(px.routes(spark, d), [natural_number(n).asc_nulls_last(), n.asc_nulls_last(), F.asc("route_id")], 20, 5).select("route_id", "short_name")


@query("SELECT p_partkey FROM part ORDER BY LEAST(p_size, p_retailprice/40) DESC, GREATEST(p_size, p_retailprice/40) DESC, p_partkey LIMIT 25")
def o03_weakest_of_two(spark, d):
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice") / 40
    return rel.page(table(spark, d, "part"), [F.least(a, b).desc(), F.greatest(a, b).desc(), F.asc("p_partkey")], 25).select("p_partkey")


@query("SELECT o_custkey AS k, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def u01_union_all(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u02_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


RECURSIVE = """WITH RECURSIVE steps(route_id, stop_seq, place) AS (
  SELECT route_id, stop_seq, CAST(stop_id % 97 AS DOUBLE) / 97 FROM route_stops WHERE stop_seq = 1
  UNION ALL
  SELECT r.route_id, r.stop_seq, s.place + (1 - s.place) * (CAST(r.stop_id % 97 AS DOUBLE) / 97) / 10 FROM steps s JOIN route_stops r ON r.route_id = s.route_id AND r.stop_seq = s.stop_seq + 1)
SELECT route_id, stop_seq, round(place, 6) AS place FROM steps"""


@query(with_("route_stops").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + RECURSIVE.split("WITH RECURSIVE ", 1)[1])
def u03_recursive(spark, d):
    rows = px.route_stops(spark, d)
    return spark.sql(RECURSIVE.replace("route_stops", "{route_stops}"), route_stops=rows.select("route_id", "stop_seq", "stop_id"))


# scalar functions, JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind, md5(CAST(event_id AS VARCHAR)) AS digest, CAST(epoch_us(ts) AS BIGINT) AS us, strftime(ts, '%Y-%m-%d %H') AS hour FROM events")
def x01_scalars(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"), F.upper("event_type").alias("kind"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("digest"),
        F.unix_micros("ts").alias("us"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
    )


@query("SELECT page_id, split_part(url, '/', 3) AS host, CAST(length(url) AS INTEGER) AS n, url LIKE '%.html' AS is_html, regexp_replace(url, '[0-9]+', '#') AS shape FROM pages")
def x02_strings(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), F.length(u).alias("n"), u.like("%.html").alias("is_html"), F.concat(F.regexp_extract(u, "^([^0-9]*)", 1), F.when(u.rlike("[0-9]"), F.concat(F.lit("#"), F.regexp_extract(u, "^[^0-9]*[0-9]+(.*)$", 1))).otherwise("")).alias("shape"))


@query("SELECT capture, CAST(COUNT(*) AS BIGINT) AS rows FROM (SELECT unnest(generate_series(CAST(MIN(ts) AS DATE)::TIMESTAMP, CAST(MAX(ts) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS capture FROM events) s JOIN events e ON CAST(e.ts AS DATE) = CAST(capture AS DATE) GROUP BY 1")
def s16_series(spark, d):
    e = table(spark, d, "events")
    days = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day"))
    return days.join(e, F.to_date("ts") == F.col("day")).groupBy(F.col("day").cast("timestamp_ntz").alias("capture")).agg(F.count(F.lit(1)).alias("rows"))


@query(with_("stops") + """SELECT CAST(floor((lon+180)/360*4096) AS BIGINT) AS x, CAST(floor((1-asinh(tan(radians(lat)))/pi())/2*4096) AS BIGINT) AS y, CAST(COUNT(*) AS BIGINT) AS stops FROM stops GROUP BY 1, 2""")
def s10_tiles(spark, d):
    return px.stops(spark, d).groupBy(geo.tile_x(F.col("lon"), 12).alias("x"), geo.tile_y(F.col("lat"), 12).alias("y")).agg(F.count(F.lit(1)).alias("stops"))


@query("""WITH p AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts)/1e6/3600) AS BIGINT) AS c, CAST(floor(epoch_us(ts)/1e6) AS BIGINT) AS t, value FROM events)
       SELECT c AS capture_id, CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(*) FILTER (WHERE value > 90) AS BIGINT) AS rejected, CAST(COUNT(DISTINCT CASE WHEN value <= 90 THEN (user_id, t) END) AS BIGINT) AS accepted FROM p GROUP BY 1""")
def s07_snapshot_decode(spark, d):
    e = table(spark, d, "events").withColumn("t", F.floor(F.unix_micros("ts") / 1e6).cast("long"))
    row = F.struct(
        F.lit("r").alias("route_id"), F.when(F.col("value") > 90, 95.0).otherwise(-34.6).alias("latitude"), F.lit(-58.4).alias("longitude"), F.lit(5.0).alias("speed"), F.col("t").alias("timestamp"),
        F.col("user_id").cast("string").alias("id"), F.lit(0).alias("direction"),
    )
    bodies = e.groupBy(F.floor(F.col("t") / 3600).cast("long").alias("capture_id")).agg(F.to_json(F.collect_list(row)).alias("body"))
    _, counters = files.decode_snapshots(bodies.withColumn("received_at", (F.col("capture_id") + 1) * 3600))
    return counters.select("capture_id", "rows", "rejected", "accepted")


# geography


@query(with_("route_stops") + f"""SELECT route_id, round(SUM({hav_sql('lon', 'lat', 'nx', 'ny')}), 3) AS metres FROM (SELECT *, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny FROM route_stops WINDOW w AS (PARTITION BY route_id ORDER BY stop_seq)) WHERE nx IS NOT NULL GROUP BY 1""")
def g02_path_length(spark, d):
    p = px.route_stops(spark, d).groupBy("route_id").agg(geo.path_points(F.col("stop_seq"), F.col("lon"), F.col("lat")).alias("path"))
    return p.where(F.size("path") > 1).select("route_id", F.round(geo.path_length(F.col("path")), 3).alias("metres"))


@query(with_("route_stops") + """SELECT route_id, stop_seq, round((degrees(atan2(sin(radians(nx-lon))*cos(radians(ny)), cos(radians(lat))*sin(radians(ny))-sin(radians(lat))*cos(radians(ny))*cos(radians(nx-lon))))+360)%360, 4) AS bearing
       FROM (SELECT *, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny FROM route_stops WINDOW w AS (PARTITION BY route_id ORDER BY stop_seq)) WHERE nx IS NOT NULL""")
def g11_bearing(spark, d):
    w = Window.partitionBy("route_id").orderBy("stop_seq")
    rows = px.route_stops(spark, d).withColumns({"nx": F.lead("lon").over(w), "ny": F.lead("lat").over(w)}).where("nx IS NOT NULL")
    return rows.select("route_id", "stop_seq", r4(geo.bearing(F.col("lon"), F.col("lat"), F.col("nx"), F.col("ny"))).alias("bearing"))


@query(with_("stops") + """SELECT a.stop_id, round(degrees(atan2(y, x)), 4) AS lon, round(degrees(atan2(z, sqrt(x*x+y*y))), 4) AS lat FROM (SELECT s.stop_id, cos(radians(s.lat))*cos(radians(s.lon))+cos(radians(t.lat))*cos(radians(t.lon)) AS x,
       cos(radians(s.lat))*sin(radians(s.lon))+cos(radians(t.lat))*sin(radians(t.lon)) AS y, sin(radians(s.lat))+sin(radians(t.lat)) AS z FROM stops s JOIN stops t ON t.stop_id = s.stop_id + 1) a""")
def g15_midpoint(spark, d):
    s = px.stops(spark, d)
    t = s.select((F.col("stop_id") - 1).alias("stop_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    lon, lat = geo.midpoint(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return s.join(t, "stop_id").select("stop_id", r4(lon).alias("lon"), r4(lat).alias("lat"))


HEX = geo.HexGrid()


@query(with_("stops") + f"""SELECT CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR) AS cell, CAST(COUNT(*) AS BIGINT) AS stops
       FROM (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds FROM (SELECT q, r, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM (SELECT (x * sqrt(3)/3 - y/3)/{HEX.edge_m}::DOUBLE AS q, y*2/3/{HEX.edge_m}::DOUBLE AS r
       FROM (SELECT (lon - {HEX.lon0}::DOUBLE)*{geo.DEGREE_M!r}::DOUBLE*cos(radians({HEX.lat0}::DOUBLE)) AS x, (lat - {HEX.lat0}::DOUBLE)*{geo.DEGREE_M!r}::DOUBLE AS y FROM stops)))) GROUP BY 1""")
def g14_hex_cells(spark, d):
    return px.stops(spark, d).groupBy(HEX.cell(F.col("lon"), F.col("lat")).alias("cell")).agg(F.count(F.lit(1)).alias("stops"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey + 3 + (s_suppkey % 2) * 4 AS b FROM supplier WHERE s_suppkey % 5 <> 0), v AS (SELECT s_suppkey AS id FROM supplier),
       sym AS (SELECT a, b FROM e WHERE b IN (SELECT id FROM v) UNION SELECT b, a FROM e WHERE b IN (SELECT id FROM v)),
       r(id, root) AS (SELECT id, id FROM v UNION SELECT sym.b, r.root FROM r JOIN sym ON sym.a = r.id) SELECT id, MIN(root) AS component FROM r GROUP BY 1""")
def r02_components(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    e = s.where("id % 5 <> 0").select(F.col("id").alias("source"), (F.col("id") + 3 + (F.col("id") % 2) * 4).alias("target"))
    return rel.connected_components(s, e.join(s.withColumnRenamed("id", "target"), "target", "left_semi"))


@query("SELECT p_brand AS kind, CAST(COUNT(*) AS BIGINT) AS edges, CAST(COUNT(*) FILTER (WHERE p_size % 3 = 0) AS BIGINT) AS one_way, round(SUM(p_retailprice)/1000, 4) AS km FROM part GROUP BY 1")
def r19_network_report(spark, d):
    e = table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_retailprice").alias("cost"), F.when(F.col("p_size") % 3 == 0, -1.0).otherwise(F.col("p_retailprice")).alias("reverse_cost"))
    return streets.coverage(e).withColumn("km", r4("km"))


# mutations


@query("SELECT user_id, hour_id, MIN(event_id) AS event_id FROM (SELECT user_id, CAST(floor(epoch_us(ts)/1e6/3600) AS BIGINT) AS hour_id, event_id FROM events) i WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, CAST(floor(epoch_us(ts)/1e6/3600) AS BIGINT) AS hour_id FROM events WHERE event_type = 'view') x WHERE x.user_id = i.user_id AND x.hour_id = i.hour_id) GROUP BY 1, 2")
def m01_insert_absent(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(F.unix_micros("ts") / 1e6 / 3600).cast("long").alias("hour_id"), "event_id", "event_type")
    return rel.insert_absent(e.where("event_type = 'view'"), e.select("user_id", "hour_id", "event_id"), ["user_id", "hour_id"], ["event_id"])


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def m02_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return rel.upsert(old, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@query("SELECT p_partkey, CASE WHEN p_size IS NOT DISTINCT FROM p_partkey % 50 + 1 THEN 0 ELSE p_size END AS p_size FROM part")
def m03_guarded_update(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    changes = p.select("p_partkey", (F.col("p_partkey") % 50 + 1).cast("int").alias("was"), F.lit(0).alias("new"))
    return rel.guarded_update(p, changes, ["p_partkey"], "p_size", "was", "new")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1995-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def m05_delete_unreferenced(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey"), "o_orderdate")
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.delete_unreferenced(o, refs, "o_orderkey", F.col("o_orderdate") < F.to_timestamp(F.lit("1995-01-01"))).select("o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, rule FROM (SELECT *, unnest(['discount', 'quantity']) AS rule FROM lineitem) WHERE (rule = 'discount' AND NOT l_discount <= 0.08) OR (rule = 'quantity' AND NOT l_quantity < 45)""")
def m08_violations(spark, d):
    return rel.violations(table(spark, d, "lineitem"), {"discount": F.col("l_discount") <= 0.08, "quantity": F.col("l_quantity") < 45}, ["l_orderkey", "l_linenumber", "l_partkey"])


# feed and trips

TRIP = """t AS (SELECT l_orderkey AS trip_id, (l_orderkey % 40) AS route_id, CAST(l_orderkey % 2 AS INTEGER) AS direction_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS stop_sequence,
       CAST(l_orderkey % 40 * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS stop_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 300 + l_partkey % 120 AS BIGINT) AS arrival_s,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 300 + l_partkey % 120 + 20 AS BIGINT) AS departure_s FROM lineitem),
       st AS (SELECT trip_id, ANY_VALUE(route_id) AS route_id, ANY_VALUE(direction_id) AS direction_id, CAST(COUNT(*) AS BIGINT) AS stops, GREATEST(MAX(arrival_s) - MIN(departure_s), 0) AS duration_s FROM t GROUP BY 1)"""


def _trips(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    t = table(spark, d, "lineitem").withColumn("stop_sequence", F.row_number().over(w))
    at = (F.col("stop_sequence") * 300 + F.col("l_partkey") % 120).cast("long")
    times = t.select(F.col("l_orderkey").alias("trip_id"), "stop_sequence", (F.col("l_orderkey") % 40 * 100 + F.col("stop_sequence")).alias("stop_id"), at.alias("arrival_s"), (at + 20).alias("departure_s"))
    trips = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id")).distinct().withColumns({"route_id": F.col("trip_id") % 40, "direction_id": (F.col("trip_id") % 2).cast("int")})
    return trips, times


@query(f"WITH {TRIP} SELECT route_id, direction_id, trip_id, stops, duration_s FROM st QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY stops DESC, duration_s DESC, trip_id) = 1")
def e01_canonical_trip(spark, d):
    trips, times = _trips(spark, d)
    return feed.canonical_trips(trips, feed.trip_stats(times)).select("route_id", "direction_id", "trip_id", "stops", "duration_s")


@query(f"WITH {TRIP} SELECT route_id, direction_id, CAST(round_even(quantile_cont(duration_s, 0.5)/60, 0) AS INTEGER) AS minutes FROM st GROUP BY 1, 2")
def e02_route_minutes(spark, d):
    trips, times = _trips(spark, d)
    return feed.route_minutes(trips, feed.trip_stats(times))


@query(f"""WITH {TRIP}, c AS (SELECT route_id, direction_id, stops FROM st QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY stops DESC, duration_s DESC, trip_id) = 1),
       x AS (SELECT t.*, c.stops, lead(departure_s) OVER w AS nd, lead(arrival_s) OVER w AS na FROM t JOIN st USING (trip_id) JOIN c ON c.route_id = st.route_id AND c.direction_id = st.direction_id AND c.stops = st.stops WINDOW w AS (PARTITION BY t.trip_id ORDER BY stop_sequence)),
       y AS (SELECT route_id, direction_id, stop_sequence, CASE WHEN stop_sequence + 1 = stops THEN na ELSE nd END - departure_s AS s FROM x WHERE nd IS NOT NULL)
       SELECT route_id, direction_id, stop_sequence, round(quantile_cont(s, 0.25), 4) AS off_peak_s, round(quantile_cont(s, 0.5), 4) AS typical_s, round(quantile_cont(s, 0.75), 4) AS peak_s FROM y WHERE s > 0 GROUP BY 1, 2, 3""")
def e03_segment_times(spark, d):
    trips, times = _trips(spark, d)
    stats = feed.trip_stats(times)
    rows = feed.segment_times(trips, times, stats, feed.canonical_trips(trips, stats))
    return rows.select("route_id", "direction_id", "stop_sequence", *[r4(c).alias(c) for c in ("off_peak_s", "typical_s", "peak_s")])


def _survey(spark, d):
    return demand.trips_to_cells(px.survey(spark, d), px.GRID)


@query(with_("trips") + "SELECT origin AS cell, CAST(COUNT(*) AS BIGINT) AS trips FROM trips GROUP BY 1")
def e09_trip_cells(spark, d):
    return _survey(spark, d).groupBy(F.col("origin").alias("cell")).agg(F.count(F.lit(1)).alias("trips"))


@query(with_("cells") + "SELECT cell, round(lon, 6) AS lon, round(lat, 6) AS lat FROM cells")
def e10_hotspots(spark, d):
    return demand.hotspots(_survey(spark, d)).select("cell", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(with_("od") + "SELECT origin, dest, round(trips, 4) AS trips FROM od")
def e11_od_matrix(spark, d):
    return demand.od_matrix(_survey(spark, d)).withColumn("trips", r4("trips"))


@query(with_("trips") + "SELECT origin, dest, hour, round(COALESCE(SUM(weight), 0), 4) AS trips FROM trips WHERE stages > 1 AND stages = bus_stages GROUP BY 1, 2, 3")
def e12_transfer_od(spark, d):
    return demand.transfer_od(_survey(spark, d)).withColumn("trips", r4("trips"))


WALK = f"""walk AS (SELECT a.route_id AS r1, b.route_id AS r2, a.stop_id AS from_stop, b.stop_id AS to_stop, {hav_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m FROM route_stops a JOIN route_stops b ON a.route_id <> b.route_id
       AND abs(a.lat - b.lat) < 0.02 AND {hav_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 1500 QUALIFY row_number() OVER (PARTITION BY a.route_id, b.route_id ORDER BY m, a.stop_id, b.stop_id) = 1)"""
RANK_POLICY = TransferPolicy(walk_m=1500.0, access_m=4000.0)


@query(with_("route_stops", more=WALK) + "SELECT r1, r2, from_stop, to_stop, CAST(round_even(m, 0) AS BIGINT) AS walk_m FROM walk")
def e08_transfer_points(spark, d):
    s = px.stops(spark, d)
    return transfers.transfer_points(px.route_stops(spark, d), s, RANK_POLICY)


SERVICE = f"""service AS (SELECT cell, route_id, MIN(stop_seq) AS min_seq, MAX(stop_seq) AS max_seq FROM cells c JOIN route_stops s ON abs(c.lat - s.lat) < 0.05 AND {hav_sql('c.lon', 'c.lat', 's.lon', 's.lat')} <= 4000 GROUP BY 1, 2),
       tod AS (SELECT origin, dest, hour, COALESCE(SUM(weight), 0) AS trips FROM trips WHERE stages > 1 AND stages = bus_stages GROUP BY 1, 2, 3),
       pairs AS (SELECT DISTINCT origin, dest FROM tod),
       direct AS (SELECT DISTINCT origin, dest FROM pairs JOIN service o ON o.cell = origin JOIN service e ON e.cell = dest AND e.route_id = o.route_id AND e.max_seq > o.min_seq),
       iti AS (SELECT p.origin, p.dest, w.r1, w.r2 FROM (SELECT * FROM pairs ANTI JOIN direct USING (origin, dest)) p JOIN service o ON o.cell = p.origin JOIN walk w ON w.r1 = o.route_id JOIN service e ON e.cell = p.dest AND e.route_id = w.r2
               JOIN route_stops f ON f.route_id = w.r1 AND f.stop_id = w.from_stop JOIN route_stops g ON g.route_id = w.r2 AND g.stop_id = w.to_stop WHERE f.stop_seq > o.min_seq AND g.stop_seq < e.max_seq),
       n AS (SELECT origin, dest, COUNT(*) AS n FROM iti GROUP BY 1, 2 HAVING COUNT(*) <= 10),
       att AS (SELECT i.origin, i.dest, i.r1, i.r2, t.hour, n.n, t.trips / n.n AS trips FROM iti i JOIN n USING (origin, dest) JOIN tod t USING (origin, dest))"""


def _ranking(spark, d):
    """The ranking, and the cells with their points."""
    ends, od = demand.ends_and_transfers(_survey(spark, d))
    s, cells = px.stops(spark, d), checkpointed(ends)
    return transfers.build_ranking(od, cells, px.route_stops(spark, d), s, RANK_POLICY), cells


@query(with_("cells", "route_stops", more=WALK + ",\n" + SERVICE + """,
       hr AS (SELECT r1, r2, hour, round(SUM(trips), 4) AS trips, round(GREATEST(SUM(trips*n)/NULLIF(SUM(trips),0), 1), 4) AS alternatives, CAST(COUNT(DISTINCT (origin, dest)) AS BIGINT) AS od_pairs, hour AS peak_hour FROM att GROUP BY 1, 2, 3),
       dy AS (SELECT r1, r2, NULL::INTEGER AS hour, round(SUM(trips), 4) AS trips, round(GREATEST(SUM(trips*n)/NULLIF(SUM(trips),0), 1), 4) AS alternatives, CAST(COUNT(DISTINCT (origin, dest)) AS BIGINT) AS od_pairs, arg_min(hour, (-trips, hour)) AS peak_hour FROM att GROUP BY 1, 2)""")
       + "SELECT * FROM hr UNION ALL SELECT * FROM dy")
def e13_transfer_ranking(spark, d):
    rows, _ = _ranking(spark, d)
    return rows.select("r1", "r2", "hour", r4("trips").alias("trips"), r4(F.coalesce("alternatives", F.lit(1.0))).alias("alternatives"), "od_pairs", "peak_hour")


# estimators

D_POLICY = DemandPolicy(access_m=4000.0)
ASSIGN = f"""cand AS (SELECT route_id, stop_order, stop_id, cell, {hav_sql('s.lon', 's.lat', 'c.lon', 'c.lat')} AS m FROM route_stops s JOIN cells c ON abs(s.lat - c.lat) < 0.05 AND
       abs(CAST(split_part(cell, ':', 1) AS BIGINT) - CAST(floor(s.lon/{px.GRID.step}::DOUBLE) AS BIGINT)) <= 1 AND abs(CAST(split_part(cell, ':', 2) AS BIGINT) - CAST(floor(s.lat/{px.GRID.step}::DOUBLE) AS BIGINT)) <= 1 WHERE {hav_sql('s.lon', 's.lat', 'c.lon', 'c.lat')} < 4000),
       asg AS (SELECT *, GREATEST(0, 1 - m/4000) AS a FROM cand QUALIFY row_number() OVER (PARTITION BY route_id, cell ORDER BY m, stop_order, stop_id) = 1),
       pd AS (SELECT o.route_id, o.stop_order AS origin_order, o.stop_id AS origin_id, e.stop_order AS dest_order, e.stop_id AS dest_id, SUM(trips) AS gross, SUM(trips*o.a*e.a) AS potential FROM od JOIN asg o ON o.cell = od.origin JOIN asg e ON e.cell = od.dest AND e.route_id = o.route_id
              WHERE o.stop_order < e.stop_order GROUP BY 1, 2, 3, 4, 5)"""


@query(with_("cells", "route_stops", more=ASSIGN.split(",\n       asg")[0]) + "SELECT route_id, stop_order, cell, round(m, 3) AS metres FROM cand")
def d02_cell_candidates(spark, d):
    rows = demand.cell_candidates(px.route_stops(spark, d), demand.hotspots(_survey(spark, d)), px.GRID, D_POLICY)
    return rows.select("route_id", "stop_order", "cell", F.round("distance_m", 3).alias("metres"))


@query(with_("cells", "route_stops", more=ASSIGN.split(",\n       pd")[0]) + "SELECT route_id, cell, stop_order, stop_id, round(a, 4) AS accessibility FROM asg")
def d03_cell_assignment(spark, d):
    rows = demand.assign_cells(demand.cell_candidates(px.route_stops(spark, d), demand.hotspots(_survey(spark, d)), px.GRID, D_POLICY), D_POLICY)
    return rows.select("route_id", "cell", "stop_order", "stop_id", r4("accessibility").alias("accessibility"))


def _pairs(spark, d):
    trips = _survey(spark, d)
    return demand.route_demand(px.route_stops(spark, d), demand.hotspots(trips), demand.od_matrix(trips), px.GRID, D_POLICY)


@query(with_("cells", "od", "route_stops", more=ASSIGN) + "SELECT route_id, origin_order, origin_id, dest_order, dest_id, round(gross, 3) AS gross, round(potential, 3) AS potential FROM pd")
def d05_pair_demand(spark, d):
    return _pairs(spark, d).withColumns({"gross": F.round("gross", 3), "potential": F.round("potential", 3)})


METRES = "(100 + (stop_id * 37) % 900)"
BANDS = [("city", 0, 3000, 37000, 59000), ("city", 3000, 6000, 41000, 66000), ("city", 6000, None, 45000, 72000), ("national", 0, None, 50000, 50000)]
BANDS_SQL = "bands AS (SELECT * FROM (VALUES " + ", ".join(f"('{j}', {a}, {'NULL' if b is None else b}, {r}, {u})" for j, a, b, r, u in BANDS) + ") v(jurisdiction, min_m, max_m, reg, unreg))"
REVENUE = f"""seg AS (SELECT route_id, stop_order, CAST({METRES} AS DOUBLE) AS metres FROM route_stops), pre AS (SELECT route_id, stop_order, COALESCE(SUM(metres) OVER (PARTITION BY route_id ORDER BY stop_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM seg), {BANDS_SQL},
       rev AS (SELECT pd.*, b.at - a.at AS distance_m, 0.9*reg + 0.1*unreg AS fare, potential*(0.9*reg + 0.1*unreg)*0.8 AS revenue FROM pd JOIN pre a ON a.route_id = pd.route_id AND a.stop_order = origin_order JOIN pre b ON b.route_id = pd.route_id AND b.stop_order = dest_order
               JOIN bands ON jurisdiction = 'city' AND b.at - a.at >= min_m AND (max_m IS NULL OR b.at - a.at < max_m))"""
R_POLICY = RevenuePolicy(capture=0.8, registered_share=0.9)


def _bands(spark):
    return spark.createDataFrame(BANDS, "jurisdiction string, min_m int, max_m int, registered_cents int, unregistered_cents int")


def _segments(spark, d):
    return px.route_stops(spark, d).select("route_id", F.col("stop_order").alias("segment"), (100 + F.col("stop_id") * 37 % 900).cast("double").alias("metres"))


def _revenue(spark, d):
    return simulation.pair_revenue(simulation.pair_distances(_pairs(spark, d), _segments(spark, d)), _bands(spark), "city", R_POLICY)


@query(with_("cells", "od", "route_stops", more=ASSIGN + ", " + REVENUE) + "SELECT route_id, origin_order, dest_order, round(distance_m, 2) AS distance_m, CAST(round(fare, 2) AS DOUBLE) AS fare_cents, round(revenue, 0) AS revenue_cents FROM rev")
def d11_revenue(spark, d):
    return _revenue(spark, d).select("route_id", "origin_order", "dest_order", F.round("distance_m", 2).alias("distance_m"), F.round("fare_cents", 2).alias("fare_cents"), F.round("revenue_cents", 0).alias("revenue_cents"))


@query(with_("cells", "od", "route_stops", more=ASSIGN) + """SELECT s.route_id, s.stop_order, s.stop_id, round(COALESCE(o.v, 0), 3) AS as_origin, round(COALESCE(e.v, 0), 3) AS as_dest FROM route_stops s LEFT JOIN (SELECT route_id, origin_order AS k, SUM(potential) AS v FROM pd GROUP BY 1, 2) o ON o.route_id = s.route_id AND o.k = s.stop_order
       LEFT JOIN (SELECT route_id, dest_order AS k, SUM(potential) AS v FROM pd GROUP BY 1, 2) e ON e.route_id = s.route_id AND e.k = s.stop_order""")
def d12_contributions(spark, d):
    return demand.stop_contributions(px.route_stops(spark, d), _pairs(spark, d)).withColumns({c: F.round(c, 3) for c in ("as_origin", "as_dest")})


TIMED = "timed AS (SELECT l_suppkey AS route_id, l_quantity * 10 AS metres, l_extendedprice / 500 AS off_peak_s, l_extendedprice / 400 AS typical_s, l_extendedprice / 300 AS peak_s FROM lineitem)"


@query(f"WITH {TIMED} SELECT round(quantile_cont(a, 0.5), 6) AS off_peak, round(quantile_cont(b, 0.5), 6) AS typical, round(quantile_cont(c, 0.5), 6) AS peak FROM (SELECT SUM(off_peak_s)/SUM(metres) AS a, SUM(typical_s)/SUM(metres) AS b, SUM(peak_s)/SUM(metres) AS c FROM timed WHERE metres > 0 AND typical_s > 0 GROUP BY route_id)")
def d09_global_paces(spark, d):
    return simulation.global_paces(_timed(spark, d)).select(*[F.round(p, 6).alias(p) for p in simulation.PACES])


def _timed(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("route_id"), (F.col("l_quantity") * 10).alias("metres"), (x / 500).alias("off_peak_s"), (x / 400).alias("typical_s"), (x / 300).alias("peak_s"))


REFS = """refs AS (SELECT l_orderkey AS route_id, l_linenumber AS segment, 500.0::DOUBLE AS length, CASE l_partkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 300.0 ELSE 800.0 END::DOUBLE AS radius, l_suppkey AS ref_route, (l_partkey % 90)::DOUBLE AS distance, (l_quantity * 12)::DOUBLE AS overlap,
       l_discount + 0.1 AS off_peak, l_discount + 0.15 AS typical, l_discount + 0.2 AS peak FROM lineitem),
       w AS (SELECT *, LEAST(1, overlap/length)/(1+distance/radius) AS w FROM refs WHERE overlap > 0),
       pr AS (SELECT route_id, segment, radius, ref_route, SUM(typical*w)/SUM(w) AS typical, LEAST(SUM(w), 1) AS w FROM w GROUP BY 1, 2, 3, 4),
       ok AS (SELECT route_id, segment, MIN(radius) AS radius FROM (SELECT route_id, segment, radius FROM pr GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3 OR radius = 800) GROUP BY 1, 2),
       cu AS (SELECT pr.*, SUM(w) OVER (PARTITION BY route_id, segment ORDER BY typical, ref_route ROWS UNBOUNDED PRECEDING) AS run, SUM(w) OVER (PARTITION BY route_id, segment) AS total FROM pr JOIN ok USING (route_id, segment, radius))"""


@query(f"WITH {REFS} SELECT route_id, segment, any_value(radius) AS radius, round(MIN(typical), 6) AS typical FROM cu WHERE run >= total/2 GROUP BY 1, 2")
def d08_consolidated_paces(spark, d):
    r = F.when(F.col("l_partkey") % 3 == 0, 100.0).when(F.col("l_partkey") % 3 == 1, 300.0).otherwise(800.0)
    x = F.col("l_discount")
    refs = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("segment"), F.lit(500.0).alias("length"), r.alias("radius"), F.col("l_suppkey").alias("ref_route"), (F.col("l_partkey") % 90).cast("double").alias("distance"),
        (F.col("l_quantity") * 12).alias("overlap"), (x + 0.1).alias("off_peak"), (x + 0.15).alias("typical"), (x + 0.2).alias("peak"),
    )
    return simulation.consolidate(refs).select("route_id", "segment", "radius", F.round("typical", 6).alias("typical"))


@query("""WITH b AS (SELECT l_suppkey AS route_id, SUM(l_quantity) FILTER (WHERE l_linenumber <= 3) AS potential, CAST(COUNT(*) AS DOUBLE) AS stops FROM lineitem GROUP BY 1), p AS (SELECT l_suppkey AS route_id, SUM(l_quantity) FILTER (WHERE l_linenumber > 3) AS potential, CAST(COUNT(*) - 1 AS DOUBLE) AS stops FROM lineitem GROUP BY 1)
       SELECT route_id, round(p.potential - b.potential, 4) AS d_potential, round((p.potential - b.potential)/NULLIF(b.potential, 0), 6) AS r_potential, p.stops - b.stops AS d_stops FROM b JOIN p USING (route_id)""")
def d14_comparison(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("route_id"))
    b = li.agg(F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_quantity"))).alias("potential"), F.count(F.lit(1)).alias("stops"))
    p = li.agg(F.sum(F.when(F.col("l_linenumber") > 3, F.col("l_quantity"))).alias("potential"), (F.count(F.lit(1)) - 1).alias("stops"))
    c = simulation.compare(b, p, ["potential", "stops"])
    return c.select("route_id", r4("potential.absolute").alias("d_potential"), F.round("potential.relative", 6).alias("r_potential"), F.col("stops.absolute").alias("d_stops"))


@query()
def d13_simulation(spark, d):
    trips = _survey(spark, d)
    rs = px.route_stops(spark, d).withColumn("metres", (100 + F.col("stop_id") * 37 % 900).cast("double"))
    last = F.max("stop_order").over(Window.partitionBy("route_id"))
    rs = rs.withColumn("metres", F.when(F.col("stop_order") < last, F.col("metres")))
    paces = rs.where("stop_order % 3 <> 0").select("route_id", F.col("stop_order").alias("segment"), F.lit(0.2).alias("off_peak"), F.lit(0.25).alias("typical"), F.lit(0.3).alias("peak"), F.lit("high").alias("confidence"))
    return simulation.simulate(rs, demand.hotspots(trips), demand.od_matrix(trips), _bands(spark), "city", paces, simulation.global_paces(_timed(spark, d)), px.GRID, D_POLICY, R_POLICY)


@query(with_("routes") + """SELECT route_id, relevance, total FROM (SELECT route_id, short_name, CASE WHEN lower(line) = '1' THEN 0 WHEN lower(line) LIKE '1%' THEN 1 WHEN branch ILIKE '%1%' OR headsign ILIKE '%1%' THEN 2 ELSE 3 END AS relevance, COUNT(*) OVER () AS total, line, branch
       FROM (SELECT *, upper(NULLIF(regexp_extract(short_name, '^\\s*(\\d+|[A-Za-z]+)', 1), '')) AS line, COALESCE(NULLIF(trim(regexp_replace(short_name, '^\\s*(\\d+|[A-Za-z]+)', '')), ''), 'TRONCAL') AS branch FROM routes)
       WHERE concat_ws(' ', line, branch, headsign) ILIKE '%1%') ORDER BY relevance, TRY_CAST(regexp_extract(line, '^\\s*(\\d{1,9})', 1) AS INTEGER) NULLS LAST, line, branch, route_id LIMIT 50""")
def d17_list_lines(spark, d):
    r = feed.named_routes(px.routes(spark, d), "short_name")
    return catalog.list_lines(r, "1").select("route_id", "relevance", "total")


@query()
def d19_similar_lines(spark, d):
    p = px.route_stops(spark, d).groupBy("route_id").agg(geo.path_points(F.col("stop_seq"), F.col("lon"), F.col("lat")).alias("path")).where(F.size("path") > 1)
    # compact routes from one of 20 common starts, so that corridors of many routes overlap
    first, k = F.element_at("path", 1), F.col("route_id") % 20
    small = F.transform("path", lambda q: F.struct((-58.4 + k * 0.01 + (q["lon"] - first["lon"]) * 0.02).alias("lon"), (-34.6 + (q["lat"] - first["lat"]) * 0.02).alias("lat")))
    p = p.withColumn("path", small)
    return catalog.similar_lines(p, p).select("route_id", "other_id", "rank", r4("own").alias("own"), r4("theirs").alias("theirs"))


@query()
def d20_ranking_page(spark, d):
    r = feed.named_routes(px.routes(spark, d), "short_name")
    rows, cells = _ranking(spark, d)
    return transfers.ranking_page(rows, r, cells, None, 10)


# operations


@query()
def t08_bunching_fold(spark, d):
    p, policy = px.positions(spark, d), BunchingPolicy(max_age_s=7200.0, max_skew_s=0.0)
    c = px.captures(spark, d)
    snaps = bunching.snapshot(c, p, policy).select("capture_id", "vehicle", "scope", "observed_at", "lon", "lat", "speed_mps")
    return bunching.fold_episodes(bunching.key_steps(snaps, bunching.novelty(snaps, c), policy), policy)


@query(with_("captures") + f"""SELECT capture_id, a.scope, a.vehicle AS a, b.vehicle AS b, round({hav_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS distance FROM (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY capture_id, vehicle ORDER BY observed_at DESC, lon DESC, lat DESC) = 1) a
       JOIN (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY capture_id, vehicle ORDER BY observed_at DESC, lon DESC, lat DESC) = 1) b USING (capture_id) WHERE a.scope = b.scope AND a.vehicle < b.vehicle AND {hav_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 100""")
def t07_near_pairs(spark, d):
    policy = BunchingPolicy(max_age_s=7200.0, max_skew_s=0.0)
    snaps = bunching.snapshot(px.captures(spark, d), px.positions(spark, d), policy)
    return bunching.near_pairs(snaps, policy).withColumn("distance", F.round("distance", 3))


EPISODES = """ep AS (SELECT event_type AS scope, CAST(user_id AS VARCHAR) AS a, CAST(user_id + 1 AS VARCHAR) AS b, epoch_us(ts)/1e6 AS first_at, epoch_us(ts)/1e6 + value * 120 AS last_at, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts)/1e6 + value * 120 + 60 END AS closed_at,
       CAST(1 + event_id % 5 AS INTEGER) AS observations, value / 10 AS max_speed_a, value / 20 AS max_speed_b FROM events), pub AS (SELECT * FROM ep WHERE observations >= 2 AND last_at - first_at >= 900 AND max_speed_a >= 1 AND max_speed_b >= 1)"""
NOW = 1_706_000_000.0


def _episodes(spark, d):
    t = F.unix_micros("ts") / 1e6
    return table(spark, d, "events").select(
        F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("a"), (F.col("user_id") + 1).cast("string").alias("b"), t.alias("first_at"), (t + F.col("value") * 120).alias("last_at"),
        F.when(F.col("event_id") % 4 != 0, t + F.col("value") * 120 + 60).alias("closed_at"), (1 + F.col("event_id") % 5).cast("int").alias("observations"), (F.col("value") / 10).alias("max_speed_a"), (F.col("value") / 20).alias("max_speed_b"),
    )


@query(f"WITH {EPISODES} SELECT scope, a, round(first_at, 3) AS first_at, CASE WHEN closed_at IS NULL THEN 'open' ELSE 'closed' END AS state, CAST(COUNT(*) OVER () AS BIGINT) AS total FROM pub WHERE first_at < {NOW} AND COALESCE(closed_at, last_at) >= {NOW} - 864000 ORDER BY first_at DESC, scope, a, b LIMIT 50")
def t11_history(spark, d):
    return bunching.history(_episodes(spark, d), NOW - 864_000, NOW).select("scope", "a", F.round("first_at", 3).alias("first_at"), "state", "total")


@query(f"""WITH {EPISODES}, cl AS (SELECT scope, a, b, first_at, greatest(first_at, {NOW} - 604800) AS s, least(last_at, {NOW}) AS e FROM pub WHERE first_at < {NOW} AND last_at >= {NOW} - 604800),
       h AS (SELECT *, unnest(generate_series(CAST(floor(s/3600) AS BIGINT), CAST(floor(CASE WHEN e > s THEN e - 0.000001 ELSE s END/3600) AS BIGINT))) AS k FROM cl)
       SELECT scope, CAST(k % 24 AS INTEGER) AS hour, CAST(COUNT(DISTINCT (a, b, first_at)) AS BIGINT) AS episodes, CAST(COUNT(DISTINCT k // 24) AS BIGINT) AS dates, COUNT(DISTINCT k // 24) >= 2 AS recurrent FROM h GROUP BY 1, 2""")
def t12_recurrence(spark, d):
    return bunching.recurrence(_episodes(spark, d), NOW)


K_POLICY = BottleneckPolicy(sector_m=500.0, max_gap_s=86_400.0, max_kmh=1.0)
PROGRESS = """pr AS (SELECT user_id AS vehicle, epoch_us(ts)/1e6 AS t, SUM(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS p FROM events),
       b AS (SELECT unnest(generate_series(0, (SELECT CAST(ceil(MAX(p)/500) AS BIGINT) FROM pr)))*500.0::DOUBLE AS bound),
       ed AS (SELECT *, lag(t) OVER w AS t0, lag(p) OVER w AS p0 FROM pr WINDOW w AS (PARTITION BY vehicle ORDER BY t)),
       ok AS (SELECT *, COALESCE(t - t0 > 0 AND t - t0 <= 86400 AND p >= p0 AND (p - p0)/(t - t0)*3.6 <= 1, FALSE) AS ok FROM ed),
       rn AS (SELECT *, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM ok),
       cr AS (SELECT vehicle, run, bound, CASE WHEN bound = p THEN t ELSE t0 + (t - t0)*(bound - p0)/(p - p0) END AS tx FROM rn JOIN b ON bound > p0 AND bound <= p WHERE ok UNION ALL SELECT vehicle, run, bound, t FROM rn JOIN b ON bound = p WHERE NOT ok),
       px AS (SELECT *, lead(bound) OVER w AS nb, lead(tx) OVER w AS e FROM cr WINDOW w AS (PARTITION BY vehicle, run ORDER BY tx, bound))"""


def _progress(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "events").select(F.col("user_id").alias("vehicle"), (F.unix_micros("ts") / 1e6).alias("observed_at"), F.sum(F.round("value").cast("long")).over(w).cast("double").alias("progress_m"))
    top = rows.agg(F.ceil(F.max("progress_m") / 500).alias("n"))
    ends = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("sector")).select(F.col("sector").cast("int").alias("sector"), (F.col("sector") * 500.0).alias("start_m"), ((F.col("sector") + 1) * 500.0).alias("end_m"))
    return rows, ends


@query(f"WITH {PROGRESS} SELECT vehicle, CAST(nb/500 - 1 AS INTEGER) AS sector, round(tx, 2) AS entered_at, round(e - tx, 2) AS duration_s, round(500/(e - tx)*3.6, 4) AS kmh FROM px WHERE nb = bound + 500 AND e > tx")
def k06_passages(spark, d):
    rows, ends = _progress(spark, d)
    out = bottlenecks.passages_relational(rows, ends, K_POLICY)
    return out.select("vehicle", "sector", F.round("entered_at", 2).alias("entered_at"), F.round("duration_s", 2).alias("duration_s"), r4("kmh").alias("kmh"))


@query(f"""WITH {PROGRESS}, ps AS (SELECT CAST(nb/500 - 1 AS INTEGER) AS sector, 500/(e - tx)*3.6 AS kmh FROM px WHERE nb = bound + 500 AND e > tx), n AS (SELECT CAST(ceil(MAX(p)/500) AS INTEGER) AS n FROM pr)
       SELECT sector, CAST(COUNT(*) AS BIGINT) AS passages, CAST(COUNT(*) FILTER (WHERE kmh < 0.01) AS BIGINT) AS slow, round(quantile_cont(kmh, 0.5), 5) AS median_kmh, round(COUNT(*) FILTER (WHERE kmh < 0.01)*100.0/COUNT(*), 3) AS percent, sector = 0 OR sector = (SELECT n - 1 FROM n) AS route_end FROM ps GROUP BY 1 HAVING COUNT(*) FILTER (WHERE kmh < 0.01) >= 2""")
def t23_slow_sectors(spark, d):
    rows, ends = _progress(spark, d)
    policy = BottleneckPolicy(sector_m=500.0, max_gap_s=86_400.0, max_kmh=1.0, slow_kmh=0.01)
    ps = bottlenecks.passages_relational(rows, ends, policy).withColumn("shape_id", F.lit("all"))
    sectors = ends.crossJoin(F.broadcast(ends.agg((F.max("sector") + 1).alias("count")))).withColumn("shape_id", F.lit("all"))
    out = bottlenecks.slow_sectors(ps, sectors, 0.0, 1e12, policy)
    return out.select("sector", "passages", "slow", F.round("median_kmh", 5).alias("median_kmh"), F.round("percent", 3).alias("percent"), "route_end")


@query("""WITH s AS (SELECT p_partkey AS shape_id, p_retailprice * 3 AS len FROM part), c AS (SELECT *, CAST(GREATEST(floor(len/500) + CASE WHEN len - floor(len/500)*500 >= 250 THEN 1 ELSE 0 END, 1) AS INTEGER) AS n FROM s), x AS (SELECT *, unnest(generate_series(0, n - 1)) AS sector FROM c)
       SELECT shape_id, CAST(sector AS INTEGER) AS sector, CAST(sector*500.0 AS DOUBLE) AS start_m, round(CASE WHEN sector = n - 1 THEN len ELSE (sector+1)*500.0 END, 4) AS end_m FROM x""")
def t13_layout(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("shape_id"), (F.col("p_retailprice") * 3).alias("length_m"))
    return bottlenecks.layout(s).select("shape_id", "sector", r4("start_m").alias("start_m"), r4("end_m").alias("end_m"))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS positions, round(quantile_cont(a, 0.1), 3) AS p10, round(quantile_cont(a, 0.5), 3) AS p50, round(quantile_cont(a, 0.9), 3) AS p90, CAST(COUNT(*) FILTER (WHERE t < m) AS BIGINT) AS reordered FROM (SELECT *, r - t AS a, MAX(t) OVER (PARTITION BY user_id ORDER BY r, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT user_id, event_id, epoch_us(ts)/1e6 AS t, epoch_us(ts)/1e6 + (event_id*7919%100000) AS r FROM events))")
def k03_gps_delay(spark, d):
    t = F.unix_micros("ts") / 1e6
    p = table(spark, d, "events").select(F.col("user_id").alias("vehicle"), t.alias("observed_at"), (t + F.col("event_id") * 7919 % 100000).alias("received_at"), F.col("event_id").alias("capture_id"))
    return audit.age_profile(p).select("positions", *[F.round(c, 3).alias(c) for c in ("p10", "p50", "p90")], "reordered")


@query(with_("captures") + """, o AS (SELECT capture_id, SUM(CASE WHEN NOT partial THEN 1 ELSE 0 END) OVER (ORDER BY capture_id ROWS UNBOUNDED PRECEDING) AS n FROM captures), g AS (SELECT n - lag(n) OVER (PARTITION BY vehicle ORDER BY capture_id) - 1 AS missed FROM (SELECT DISTINCT vehicle, capture_id FROM positions) JOIN o USING (capture_id))
       SELECT CAST(COUNT(missed) AS BIGINT) AS updates, CAST(COUNT(*) FILTER (WHERE missed >= 3) AS BIGINT) AS after_3, CAST(COUNT(*) FILTER (WHERE missed >= 4) AS BIGINT) AS after_4 FROM g""")
def k05_update_gaps(spark, d):
    return audit.update_gaps(px.positions(spark, d), px.captures(spark, d))


@query("SELECT CAST(CASE WHEN value <= 25 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 100 THEN 2 WHEN value <= 200 THEN 3 ELSE 4 END AS INTEGER) AS band, CAST(COUNT(*) AS BIGINT) AS positions, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS vehicles FROM events GROUP BY 1")
def k04_distance_bands(spark, d):
    return audit.distance_bands(table(spark, d, "events").select(F.col("value").alias("distance_m"), F.col("user_id").alias("vehicle")))


@query("SELECT COUNT(*)::BIGINT AS n, SUM(quality)::BIGINT AS good FROM labels l SEMI JOIN documents d ON l.doc_id = d.doc_id")
def j05_labelled_documents(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))
