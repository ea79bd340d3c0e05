"""Queries over feeds, streets, prices and estimators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import DEGREE_M
from ..operators.checkpoints import checkpointed
from ..policy import DetourPolicy, ShapePolicy
from . import catalog, feed, identity, routing, simulation, streets, transfers
from . import proxy as px
from .proxy import hav_sql, table, with_
from .queries import ASSIGN, METRES, REVENUE, SERVICE, TIMED, WALK, _ranking, _segments, _timed, query, r4
from .queries_sources import EDGES, IMPORT, RUNS, bearing_sql, imported, paths, point_edge_sql

# feed


@query(with_("route_stops", more=EDGES) + f"SELECT route_id AS shape_id, CAST(round_even(SUM({hav_sql('lon', 'lat', 'nx', 'ny')}), 0) AS BIGINT) AS length_m, CAST(COUNT(*) + 1 AS INTEGER) AS points FROM ed GROUP BY 1")
def e04_shape_paths(spark, d):
    rows = px.route_stops(spark, d).select(F.col("route_id").alias("shape_id"), F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"), F.col("stop_seq").alias("shape_pt_sequence"))
    return feed.shapes_to_paths(rows).where(F.size("path") > 1).select("shape_id", "length_m", F.size("path").alias("points"))


@query(with_("route_stops", more=RUNS) + "SELECT route_id, stop_seq, round(run/total, 5) AS fraction FROM ru UNION ALL SELECT route_id, MAX(stop_seq) + 1, 1.0 FROM ru GROUP BY 1")
def e05_stop_projection(spark, d):
    shapes = paths(spark, d)
    rows = feed.project_stops(shapes, px.route_stops(spark, d).join(shapes.select("route_id"), "route_id", "left_semi"))
    return rows.select("route_id", "stop_seq", F.round("fraction", 5).alias("fraction"))


S_POLICY = ShapePolicy(max_edge_m=60_000.0, adjacent_edge_m=20_000.0)


@query(with_("route_stops", more=EDGES + f", ln AS (SELECT route_id, stop_seq, {hav_sql('lon', 'lat', 'nx', 'ny')} AS m FROM ed), gn AS (SELECT *, m > 60000 AS gone FROM ln), bs AS (SELECT *, COALESCE(lag(gone) OVER w, FALSE) OR COALESCE(lead(gone) OVER w, FALSE) AS beside FROM gn WINDOW w AS (PARTITION BY route_id ORDER BY stop_seq))")
       + "SELECT route_id, stop_seq, NOT gone AND NOT (beside AND m > 20000) AS kept FROM bs")
def e06_segment_paths(spark, d):
    shapes = paths(spark, d)
    at = shapes.select("route_id", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("k"), F.size("path").alias("n"), "path")
    runs = at.select("route_id", (F.col("k") + 1).alias("stop_seq"), (geo._planar_runs(F.col("path"))[F.col("k")] / F.element_at(geo._planar_runs(F.col("path")), -1)).alias("fraction"), (F.col("k") < F.col("n") - 1).alias("inner"))
    rows = feed.segment_paths(runs.withColumn("fraction", F.when(F.col("inner"), F.col("fraction")).otherwise(1.0)), shapes, S_POLICY)
    first = px.route_stops(spark, d).groupBy("route_id").agg((F.min("stop_seq") - 1).alias("s"))
    return rows.where("inner").join(first, "route_id").select("route_id", (F.col("stop_seq") + F.col("s")).alias("stop_seq"), F.col("path_to_next").isNotNull().alias("kept"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS route_id, CAST(l_linenumber AS SMALLINT) AS direction_id, problem FROM (SELECT l_orderkey, l_linenumber, 'several shapes' AS problem FROM lineitem GROUP BY 1, 2 HAVING COUNT(DISTINCT l_partkey) > 1 UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 'direction' FROM lineitem WHERE l_linenumber NOT IN (0, 1))")
def m09_feed_problems(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("route_id"), F.col("l_linenumber").cast("short").alias("direction_id"), F.col("l_partkey").cast("string").alias("shape_id"))
    return feed.integrity_problems(t)


# streets

DIRECTED = IMPORT + """, us AS (SELECT * FROM imp WHERE way_id % 4 <> 0),
       dg AS (SELECT edge_id, way_id, CASE way_id % 4 WHEN 2 THEN target ELSE source END AS source, CASE way_id % 4 WHEN 2 THEN source ELSE target END AS target, way_id % 4 IN (1, 2) AS one_way FROM us)"""


def street_edges(spark, d):
    vertices, edges = imported(spark, d)
    return vertices, checkpointed(streets.directed_edges(streets.usable_ways(edges)))


@query(with_("route_stops", "routes", more=DIRECTED + """, sym AS (SELECT source AS a, target AS b FROM dg UNION SELECT target, source FROM dg), vs AS (SELECT DISTINCT a AS id FROM sym),
       reach(id, root) AS (SELECT id, id FROM vs UNION SELECT sym.b, r.root FROM reach r JOIN sym ON sym.a = r.id), co AS (SELECT id, MIN(root) AS root FROM reach GROUP BY 1),
       best AS (SELECT root FROM co GROUP BY 1 ORDER BY COUNT(*) DESC, root LIMIT 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT edge_id, source, target, one_way FROM dg WHERE source IN (SELECT id FROM co WHERE root = (SELECT root FROM best))")
def e14_street_graph(spark, d):
    vertices, edges = imported(spark, d)
    _, kept = streets.street_graph(edges, vertices)
    return kept.select("edge_id", "source", "target", (F.col("reverse_cost") < 0).alias("one_way"))


@query(with_("route_stops", "routes", more=DIRECTED + """, rl AS (SELECT s.route_id AS from_way, s.route_id AS to_way, (s.route_id // 4) % 2 = 0 AS banned, s.stop_id AS via FROM route_stops s WHERE s.stop_seq = 8),
       ou AS (SELECT source AS via, way_id, edge_id FROM dg UNION SELECT target, way_id, edge_id FROM dg WHERE NOT one_way), it AS (SELECT target AS via, way_id, edge_id FROM dg UNION SELECT source, way_id, edge_id FROM dg WHERE NOT one_way),
       fi AS (SELECT via, from_way, to_way, banned, MIN(i.edge_id) AS from_edge FROM (SELECT via, from_way - 1 AS from_way, to_way, banned FROM rl) r JOIN it i USING (via) WHERE i.way_id = from_way GROUP BY 1, 2, 3, 4 HAVING COUNT(DISTINCT i.edge_id) = 1),
       ft AS (SELECT via, from_edge, banned, MIN(o.edge_id) AS only_edge FROM fi JOIN ou o USING (via) WHERE o.way_id = to_way GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT o.edge_id) = 1)""")
       + "SELECT from_edge, only_edge AS to_edge, via FROM ft WHERE banned UNION SELECT from_edge, o.edge_id, via FROM ft JOIN ou o USING (via) WHERE NOT banned AND o.edge_id <> only_edge")
def e15_turn_restrictions(spark, d):
    _, edges = street_edges(spark, d)
    at = px.route_stops(spark, d).where("stop_seq = 8")
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    tag = F.when(F.floor(F.col("route_id") / 4) % 2 == 0, "no_left_turn").otherwise("only_straight_on")
    relations = at.select(
        F.col("stop_id").alias("relation_id"), F.create_map(F.lit("restriction:bus"), tag, F.lit("restriction"), F.lit("no_u_turn")).alias("tags"),
        F.array(member("w", F.col("route_id") - 1, "from"), member("n", F.col("stop_id"), "via"), member("w", F.col("route_id"), "to")).alias("members"),
    )
    return streets.turn_restrictions(relations, edges).select("from_edge", "to_edge", "via")


@query("""SELECT * FROM (SELECT 'cost' AS problem, CAST(COUNT(*) FILTER (WHERE NOT (p_size - 10) > 0) AS BIGINT) AS n FROM part UNION ALL SELECT 'reverse_cost', COUNT(*) FILTER (WHERE p_size % 7 - 1 <= 0 AND p_size % 7 - 1 <> -1) FROM part
       UNION ALL SELECT 'path', COUNT(*) FILTER (WHERE p_size % 3 = 0) FROM part UNION ALL SELECT 'unknown vertex', COUNT(*) FROM (SELECT p_partkey % 300 AS v FROM part UNION ALL SELECT p_partkey % 200 FROM part) WHERE v >= 250) WHERE n > 0""")
def r04_network_problems(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    point = lambda x: F.struct(F.lit(x).alias("lon"), F.lit(0.0).alias("lat"))
    e = table(spark, d, "part").select((k % 300).alias("source"), (k % 200).alias("target"), (size - 10).cast("double").alias("cost"), (size % 7 - 1).cast("double").alias("reverse_cost"), F.when(size % 3 == 0, F.array(point(0.0))).otherwise(F.array(point(0.0), point(0.1))).alias("path"))
    return streets.network_problems(spark.range(250), e)


# prices: short edges, with traffic segments around them

KINDS = ["primary", "residential", "motorway_link", "service"]
SHORT = """sh AS (SELECT stop_id AS edge_id, ['primary','residential','motorway_link','service'][stop_id % 4 + 1] AS kind, 100.0::DOUBLE + stop_id % 50 AS cost, CASE WHEN stop_id % 3 = 0 THEN -1.0::DOUBLE ELSE 100.0 + stop_id % 50 END AS reverse_cost, stop_id % 29 = 0 AS blocked,
       -58.4::DOUBLE + (stop_id % 40) * 0.004::DOUBLE AS a, -34.6::DOUBLE + (stop_id // 40) * 0.004::DOUBLE AS b, -58.4::DOUBLE + (stop_id % 40) * 0.004::DOUBLE + 0.003::DOUBLE AS c, -34.6::DOUBLE + (stop_id // 40) * 0.004::DOUBLE + (stop_id % 5) * 0.0005::DOUBLE AS d FROM stops),
       tf AS (SELECT stop_id AS ordinal, 's' || CAST(stop_id // 2 AS VARCHAR) AS source_id, ['primary','street','motorway','trunk'][stop_id % 4 + 1] AS road_category, CASE WHEN stop_id % 2 = 0 THEN 'full' ELSE 'one_side' END AS road_coverage, (stop_id % 7) * 9.0::DOUBLE AS speed_kph, stop_id % 11 <> 0 AS has_speed, stop_id % 13 = 0 AS closure,
       a + 0.0005::DOUBLE * (stop_id % 2) AS ta, b + 0.00005::DOUBLE * (stop_id % 6) AS tb, c AS tc, d + 0.00005::DOUBLE * (stop_id % 6) AS td FROM sh JOIN stops ON stop_id = edge_id),
       tx AS (SELECT ordinal, source_id, road_category, road_coverage, has_speed, closure, speed_kph, CASE WHEN ordinal % 3 = 0 THEN tc ELSE ta END AS p, CASE WHEN ordinal % 3 = 0 THEN td ELSE tb END AS q, CASE WHEN ordinal % 3 = 0 THEN ta ELSE tc END AS r, CASE WHEN ordinal % 3 = 0 THEN tb ELSE td END AS s FROM tf)"""


def short_edges(spark, d):
    k = F.col("stop_id")
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    a, b = -58.4 + (k % 40) * 0.004, -34.6 + F.floor(k / 40) * 0.004
    c, e = -58.4 + (k % 40) * 0.004 + 0.003, -34.6 + F.floor(k / 40) * 0.004 + (k % 5) * 0.0005
    cost = 100.0 + k % 50
    edges = px.stops(spark, d).select(k.alias("edge_id"), F.array(*map(F.lit, KINDS))[(k % 4).cast("int")].alias("kind"), cost.alias("cost"), F.when(k % 3 == 0, -1.0).otherwise(cost).alias("reverse_cost"), (k % 29 == 0).alias("blocked"), F.array(point(a, b), point(c, e)).alias("path"))
    one, two = point(a + 0.0005 * (k % 2), b + 0.00005 * (k % 6)), point(c, e + 0.00005 * (k % 6))
    traffic = px.stops(spark, d).select(
        k.alias("ordinal"), F.concat(F.lit("s"), F.floor(k / 2).cast("string")).alias("source_id"), F.array(*map(F.lit, ["primary", "street", "motorway", "trunk"]))[(k % 4).cast("int")].alias("road_category"),
        F.when(k % 2 == 0, "full").otherwise("one_side").alias("road_coverage"), ((k % 7) * 9.0).alias("speed_kph"), (k % 11 != 0).alias("has_speed"), (k % 13 == 0).alias("closure"), F.when(k % 3 == 0, F.array(two, one)).otherwise(F.array(one, two)).alias("path"),
    )
    return edges, traffic


def _side(a, b, c, d, x, y):
    return f"sign(({c}-{a})*({y}-{b})-({d}-{b})*({x}-{a}))"


CROSS = f"{_side('a', 'b', 'c', 'd', 'p', 'q')}*{_side('a', 'b', 'c', 'd', 'r', 's')} < 0 AND {_side('p', 'q', 'r', 's', 'a', 'b')}*{_side('p', 'q', 'r', 's', 'c', 'd')} < 0"
PRICED = SHORT + f""", nr AS (SELECT *, least({point_edge_sql('a', 'b', 'p', 'q', 'r', 's')}, {point_edge_sql('c', 'd', 'p', 'q', 'r', 's')}, {point_edge_sql('p', 'q', 'a', 'b', 'c', 'd')}, {point_edge_sql('r', 's', 'a', 'b', 'c', 'd')}) AS m0, {CROSS} AS crossed,
       {bearing_sql('a', 'b', 'c', 'd')} AS b1, {bearing_sql('p', 'q', 'r', 's')} AS b2 FROM sh JOIN tx ON abs(sh.a - tx.p) < 0.02 AND abs(sh.b - tx.q) < 0.02),
       nm AS (SELECT *, CASE WHEN crossed THEN 0 ELSE m0 END AS m, CASE WHEN abs(b1-b2) > 180 THEN 360 - abs(b1-b2) ELSE abs(b1-b2) END AS ang, CASE WHEN has_speed AND NOT closure AND speed_kph > 0 THEN speed_kph END AS kmh FROM nr), nn AS (SELECT * FROM nm WHERE m <= 300),
       fw AS (SELECT edge_id, kmh FROM nn WHERE m <= 15 AND least(ang, 180-ang) <= 45 AND (road_coverage = 'full' OR ang <= 90) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY m, ordinal) = 1),
       bw AS (SELECT edge_id, kmh FROM nn WHERE reverse_cost > 0 AND m <= 15 AND least(ang, 180-ang) <= 45 AND (road_coverage = 'full' OR ang > 90) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY m, ordinal) = 1),
       so AS (SELECT edge_id, source_id, m, kmh FROM nn WHERE kmh IS NOT NULL AND road_category = CASE kind WHEN 'primary' THEN 'primary' WHEN 'residential' THEN 'street' WHEN 'motorway_link' THEN 'motorway' END QUALIFY row_number() OVER (PARTITION BY edge_id, source_id ORDER BY m, kmh) = 1),
       nx AS (SELECT edge_id, quantile_cont(kmh, 0.5) AS kmh FROM (SELECT * FROM so QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY m, source_id) <= 5) GROUP BY 1 HAVING COUNT(*) >= 3),
       df AS (SELECT quantile_cont(speed_kph, 0.5) AS kmh FROM tx WHERE has_speed AND NOT closure)"""


@query(with_("stops", more=PRICED) + """SELECT sh.edge_id, round(CASE WHEN blocked THEN -1 ELSE cost/(COALESCE(fw.kmh, nx.kmh, df.kmh)/3.6) END, 3) AS seconds, round(CASE WHEN blocked OR reverse_cost <= 0 THEN -1 ELSE cost/(COALESCE(bw.kmh, nx.kmh, df.kmh)/3.6) END, 3) AS reverse_seconds,
       CASE WHEN blocked THEN 'blocked' WHEN fw.kmh IS NOT NULL THEN 'traffic' WHEN nx.kmh IS NOT NULL THEN 'nearby' ELSE 'default' END AS source_of_speed,
       CASE WHEN blocked OR reverse_cost <= 0 THEN 'not_allowed' WHEN bw.kmh IS NOT NULL THEN 'traffic' WHEN nx.kmh IS NOT NULL THEN 'nearby' ELSE 'default' END AS reverse_source FROM sh LEFT JOIN fw USING (edge_id) LEFT JOIN bw USING (edge_id) LEFT JOIN nx USING (edge_id) CROSS JOIN df""")
def r05_priced_edges(spark, d):
    rows = routing.priced_edges(*short_edges(spark, d))
    return rows.select("edge_id", F.round("seconds", 3).alias("seconds"), F.round("reverse_seconds", 3).alias("reverse_seconds"), "source_of_speed", "reverse_source")


def _plane(x, y, a, b, c, d):
    """Metres from (x, y) to an edge, on a plane scaled at the point's latitude."""
    k = f"cos(radians({y}))"
    t = f"greatest(0,least(1,((({x})-({a}))*(({c})-({a}))*{k}*{k}+(({y})-({b}))*(({d})-({b})))/(pow((({c})-({a}))*{k},2)+pow(({d})-({b}),2))))"
    return f"{DEGREE_M!r}::DOUBLE*sqrt(pow((({x})-({a})-{t}*(({c})-({a})))*{k},2)+pow(({y})-({b})-{t}*(({d})-({b})),2))"


@query(with_("stops", more=SHORT + """, pt AS (SELECT edge_id AS point_id, (a+c)/2 + 0.00001::DOUBLE*(edge_id % 9) AS x, (b+d)/2 + 0.00012::DOUBLE*(edge_id % 7) AS y, CASE WHEN edge_id % 4 <> 0 THEN (edge_id % 4) * 90.0::DOUBLE END AS heading FROM sh)""")
       + f""", ca AS (SELECT point_id, edge_id, blocked, {_plane('x', 'y', 'a', 'b', 'c', 'd')} AS m, greatest(0,least(1,((x-a)*(c-a)+(y-b)*(d-b))/(pow(c-a,2)+pow(d-b,2)))) AS f, CASE WHEN abs(heading-{bearing_sql('a', 'b', 'c', 'd')}) > 180 THEN 360 - abs(heading-{bearing_sql('a', 'b', 'c', 'd')}) ELSE abs(heading-{bearing_sql('a', 'b', 'c', 'd')}) END AS off, heading, reverse_cost FROM pt JOIN sh ON abs(x-a) < 0.01 AND abs(y-b) < 0.01),
       ok AS (SELECT * FROM ca WHERE m <= 50 AND (heading IS NULL OR CASE WHEN reverse_cost >= 0 THEN least(off, 180-off) ELSE off END <= 45) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(m, 6), edge_id) = 1)
       SELECT pt.point_id, CASE WHEN NOT blocked THEN edge_id END AS edge_id, CASE WHEN NOT blocked THEN round(f, 4) END AS fraction, CASE WHEN NOT blocked THEN round(m, 2) END AS snap_m, COALESCE(NOT blocked, FALSE) AS matched FROM pt LEFT JOIN ok USING (point_id)""")
def r06_snapped_points(spark, d):
    edges, _ = short_edges(spark, d)
    k, p, q = F.col("edge_id"), F.col("path")[0], F.col("path")[1]
    points = edges.select(k.alias("point_id"), ((p["lon"] + q["lon"]) / 2 + 0.00001 * (k % 9)).alias("lon"), ((p["lat"] + q["lat"]) / 2 + 0.00012 * (k % 7)).alias("lat"), F.when(k % 4 != 0, (k % 4) * 90.0).alias("heading"))
    rows = routing.snap(points, edges)
    return rows.select("point_id", "edge_id", r4("fraction").alias("fraction"), F.round("snap_m", 2).alias("snap_m"), "matched")


@query(with_("stops", more=PRICED) + """SELECT CASE WHEN blocked THEN 'blocked' WHEN fw.kmh IS NOT NULL THEN 'traffic' WHEN nx.kmh IS NOT NULL THEN 'nearby' ELSE 'default' END AS source_of_speed, CAST(COUNT(*) AS BIGINT) AS edges, CAST(COUNT(*) FILTER (WHERE blocked) AS BIGINT) AS blocked, CAST(COUNT(*) FILTER (WHERE blocked OR reverse_cost <= 0) AS BIGINT) AS one_way
       FROM sh LEFT JOIN fw USING (edge_id) LEFT JOIN nx USING (edge_id) GROUP BY 1""")
def r19_price_trace(spark, d):
    return routing.trace(routing.priced_edges(*short_edges(spark, d)))


@query("SELECT COALESCE(quantile_cont(l_quantity, 0.5) FILTER (WHERE l_linenumber <> 2 AND l_linenumber <> 3), 20.0) AS default_kmh FROM lineitem")
def r22_default_speed(spark, d):
    return routing.default_speed(table(spark, d, "lineitem").select(F.col("l_quantity").alias("speed_kph"), (F.col("l_linenumber") != 2).alias("has_speed"), (F.col("l_linenumber") == 3).alias("closure")))


C_POLICY = DetourPolicy(forced_m=5_000.0, optional_m=20_000.0)
CUT = (-58.5, -34.7, -58.3, -34.5)


@query(with_("stops", more=f"c AS (SELECT stop_id, {point_edge_sql('lon', 'lat', *[f'({v})::DOUBLE' for v in CUT])} AS m FROM stops)") + "SELECT stop_id, round(m, 1) AS cut_m, CASE WHEN m <= 5000 THEN 'forced' WHEN m <= 20000 THEN 'optional' ELSE 'required' END AS availability FROM c")
def r16_stop_classes(spark, d):
    point = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    rows = routing.classify_stops(px.stops(spark, d).withColumn("cut", F.array(point(*CUT[:2]), point(*CUT[2:]))), C_POLICY)
    return rows.select("stop_id", F.round("cut_m", 1).alias("cut_m"), "availability")


# ways along each route's stops, which are a graph of their own; some edges run one way, some have no time

CHAIN = """ch AS (SELECT route_id, stop_seq - 1 AS k, 10.0::DOUBLE + stop_id % 7 AS sec, stop_id % 37 = 0 AS one_way, stop_id % 43 = 0 AS untimed FROM ed WHERE stop_seq <= 24),
       su AS (SELECT route_id, SUM(CASE WHEN k IN (2, 20) THEN sec/2 ELSE sec END) AS cost, bool_or(one_way) AS one_way, bool_or(untimed) AS untimed FROM ch WHERE k BETWEEN 2 AND 20 GROUP BY 1 HAVING COUNT(*) = 19)"""


def chains(spark, d):
    w = Window.partitionBy("route_id").orderBy("stop_seq")
    rows = px.route_stops(spark, d).withColumn("target", F.lead("stop_id").over(w)).where("target IS NOT NULL AND stop_seq <= 24")
    seconds, timed = 10.0 + F.col("stop_id") % 7, F.col("stop_id") % 43 != 0
    one_way = F.col("stop_id") % 37 == 0
    return rows.select(
        F.col("route_id").alias("request_id"), (F.col("stop_seq") - 1).cast("long").alias("edge_id"), F.col("stop_id").alias("source"), "target", seconds.alias("cost"), F.when(one_way, -1.0).otherwise(seconds).alias("reverse_cost"),
        F.when(timed, seconds).otherwise(-1.0).alias("seconds"), F.when(timed & ~one_way, seconds).otherwise(-1.0).alias("reverse_seconds"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("path"),
    )


def _ends(edges):
    whole = edges.where("edge_id BETWEEN 2 AND 20").groupBy("request_id").count().where("count = 19").select("request_id")
    pair = lambda name, a, b: F.struct(F.lit(name).alias("pair_id"), F.lit(a).cast("long").alias("from_edge"), F.lit(0.5).alias("from_fraction"), F.lit(b).cast("long").alias("to_edge"), F.lit(0.5).alias("to_fraction"))
    return whole.select("request_id", F.explode(F.array(pair("ahead", 2, 20), pair("back", 20, 2), pair("lost", 2, None))).alias("p")).select("request_id", "p.*")


@query(with_("route_stops", more=EDGES + ", " + CHAIN) + """SELECT route_id AS request_id, 'ahead' AS pair_id, CASE WHEN untimed THEN 'no_coverage' ELSE 'reached' END AS state, CASE WHEN NOT untimed THEN round(cost, 4) END AS cost, CAST(CASE WHEN NOT untimed THEN 19 ELSE 0 END AS INTEGER) AS edges FROM su
       UNION ALL SELECT route_id, 'back', CASE WHEN one_way THEN 'no_path' WHEN untimed THEN 'no_coverage' ELSE 'reached' END, CASE WHEN NOT untimed AND NOT one_way THEN round(cost, 4) END, CASE WHEN NOT untimed AND NOT one_way THEN 19 ELSE 0 END FROM su UNION ALL SELECT route_id, 'lost', 'unmatched', NULL, 0 FROM su""")
def r07_solved_pairs(spark, d):
    edges = chains(spark, d)
    return routing.solve_pairs(edges, _ends(edges)).select("request_id", "pair_id", "state", r4("cost").alias("cost"), F.size("edges").alias("edges"))


@query(with_("route_stops", more=EDGES + ", " + CHAIN) + "SELECT route_id AS request_id, pair_id, 'reached' AS state, round(cost, 4) AS cost FROM su, (VALUES ('ahead'), ('back')) p(pair_id)")
def r11_undirected_pairs(spark, d):
    edges = chains(spark, d)
    return routing.solve_pairs(edges, _ends(edges).where("pair_id <> 'lost'"), cost="cost", reverse="reverse_cost", undirected=True).select("request_id", "pair_id", "state", r4("cost").alias("cost"))


@query(with_("route_stops", more=EDGES + ", " + CHAIN + """, tw AS (SELECT route_id, SUM(CASE WHEN k = 2 THEN sec/2 ELSE sec END) FILTER (WHERE k < 11) + SUM(CASE WHEN k = 11 THEN sec/4 END) AS one, SUM(CASE WHEN k = 11 THEN sec*3/4 WHEN k = 20 THEN sec/2 ELSE sec END) FILTER (WHERE k >= 11) AS two, bool_or(untimed) AS untimed FROM ch WHERE k BETWEEN 2 AND 20 GROUP BY 1 HAVING COUNT(*) = 19)""")
       + "SELECT route_id AS request_id, CASE WHEN untimed THEN 'no_path' ELSE 'reached' END AS state, CASE WHEN NOT untimed THEN round(one + two, 4) END AS cost FROM tw")
def r12_segment_routes(spark, d):
    edges = chains(spark, d)
    place = lambda n, e, f: F.struct(F.lit(n).alias("place"), F.lit(e).cast("long").alias("edge_id"), F.lit(f).alias("fraction"), F.lit(None).cast("double").alias("heading"))
    asked = _ends(edges).select("request_id").distinct().select("request_id", F.explode(F.array(place(0, 2, 0.5), place(1, 11, 0.25), place(2, 20, 0.5))).alias("p")).select("request_id", "p.*")
    return routing.segment_routes(edges, asked).select("request_id", "state", r4("cost").alias("cost"))


# identities


@query(with_("positions", "spots") + """, se AS (SELECT spot_id AS shape_id, -58.5::DOUBLE + (spot_id % 10) * 0.0004::DOUBLE AS a, -34.6::DOUBLE AS b, -58.5::DOUBLE + (spot_id % 10) * 0.0004::DOUBLE + 0.001::DOUBLE AS c, -34.6::DOUBLE + 0.02::DOUBLE AS d FROM spots WHERE spot_id <= 10),
       pr AS (SELECT obs_id, shape_id, a, b, c, d, lon, lat, cos(radians(lat)) AS k FROM positions JOIN se ON obs_id % 7 = 0),
       tt AS (SELECT *, greatest(0, least(1, -((a-lon)*k*(c-a)*k + (b-lat)*(d-b)) / (pow((c-a)*k, 2) + pow(d-b, 2)))) AS t FROM pr)"""
       + f"SELECT obs_id, shape_id, round({hav_sql('lon', 'lat', '(a+t*(c-a))', '(b+t*(d-b))')}, 2) AS off_m, round(t, 4) AS along FROM tt WHERE {hav_sql('lon', 'lat', '(a+t*(c-a))', '(b+t*(d-b))')} <= 150")
def g23_nearest_edges(spark, d):
    k = F.col("spot_id") % 10
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    a = -58.5 + k * 0.0004
    shapes = px.spots(spark, d).where("spot_id <= 10").select(F.col("spot_id").alias("shape_id"), F.array(point(a, F.lit(-34.6)), point(a + 0.001, F.lit(-34.6 + 0.02))).alias("path"))
    p = px.positions(spark, d).where("obs_id % 7 = 0").select("obs_id", F.col("vehicle").alias("identity"), "lon", "lat", F.lit(None).cast("double").alias("heading"))
    return identity.nearest_edges(p, shapes, 150.0).select("obs_id", "shape_id", F.round("off_m", 2).alias("off_m"), r4("along").alias("along"))


@query(with_("positions", "route_stops") + """, ix AS (SELECT DISTINCT route_id AS shape_id, CAST(floor((-58.5::DOUBLE + (stop_id % 9) * 0.0005::DOUBLE)/0.0005) AS BIGINT) AS x, CAST(floor((-34.6::DOUBLE + (stop_id % 6) * 0.0005::DOUBLE)/0.0005) AS BIGINT) AS y FROM route_stops WHERE stop_seq <= 2),
       pb AS (SELECT vehicle AS identity, obs_id, CAST(floor(lon/0.0005) AS BIGINT) + i AS x, CAST(floor(lat/0.0005) AS BIGINT) + j AS y FROM positions, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
       hi AS (SELECT identity, shape_id, CAST(COUNT(DISTINCT obs_id) AS BIGINT) AS hits FROM pb JOIN ix USING (x, y) GROUP BY 1, 2)
       SELECT identity, shape_id, hits, CAST(row_number() OVER (PARTITION BY identity ORDER BY hits DESC, shape_id) AS INTEGER) AS rank FROM hi QUALIFY rank <= 5""")
def g22_candidate_shapes(spark, d):
    at = px.route_stops(spark, d).where("stop_seq <= 2").select("route_id", "stop_seq", (-58.5 + (F.col("stop_id") % 9) * 0.0005).alias("lon"), (-34.6 + (F.col("stop_id") % 6) * 0.0005).alias("lat"))
    shapes = at.groupBy(F.col("route_id").alias("shape_id")).agg(geo.path_points(F.col("stop_seq"), F.col("lon"), F.col("lat")).alias("path"))
    p = px.positions(spark, d).select(F.col("vehicle").alias("identity"), "obs_id", "lon", "lat")
    return identity.candidate_shapes(p, shapes, 0.0005, 5).select("identity", "shape_id", "hits", "rank")


@query("""WITH s AS (SELECT user_id AS identity, event_type AS shape_id, round(AVG(value)/60, 6) AS score, round(AVG(value + event_id % 3)/60, 6) AS other FROM events GROUP BY 1, 2),
       r AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY identity ORDER BY score DESC, shape_id)), g AS (SELECT identity, shape_id AS again FROM s QUALIFY row_number() OVER (PARTITION BY identity ORDER BY other DESC, shape_id) = 1)
       SELECT r.identity, shape_id, score, CASE WHEN score < 0.8 THEN 'rejected' WHEN again <> shape_id THEN 'unstable' WHEN score - COALESCE(second, 0) < 0.05 THEN 'ambiguous' ELSE 'accepted' END AS state FROM r JOIN g USING (identity) WHERE rank = 1""")
def e18_identities(spark, d):
    v = F.col("value")
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("identity"), F.col("event_type").alias("shape_id")).agg(F.round(F.avg(v) / 60, 6).alias("score"), F.round(F.avg(v + F.col("event_id") % 3) / 60, 6).alias("other"))
    return identity.classify(rows.select("identity", "shape_id", "score"), rows.select("identity", "shape_id", F.col("other").alias("score"))).select("identity", "shape_id", "score", "state")


# estimators and catalogue


@query(with_("route_stops", more=EDGES + """, st AS (SELECT *, lead(lon) OVER w AS nx2, lead(stop_id) OVER w AS nid, MAX(stop_seq) OVER (PARTITION BY route_id) AS top, COUNT(*) OVER (PARTITION BY route_id) AS cnt FROM route_stops WINDOW w AS (PARTITION BY route_id ORDER BY stop_seq))""")
       + """SELECT DISTINCT route_id, rule FROM (SELECT route_id, 'path is missing' AS rule FROM st WHERE nid IS NOT NULL AND stop_id % 11 = 0 UNION ALL SELECT route_id, 'path is reversed' FROM st WHERE nid IS NOT NULL AND stop_id % 11 = 1 UNION ALL SELECT route_id, 'path after the last stop' FROM st WHERE nid IS NULL AND route_id % 3 = 0
       UNION ALL SELECT route_id, 'fewer than two stops' FROM st WHERE cnt < 2 UNION ALL SELECT route_id, 'jurisdiction is unknown' FROM st WHERE route_id % 5 = 4 UNION ALL SELECT route_id, 'path ends away from its stops' FROM st WHERE nid IS NOT NULL AND stop_id % 11 = 2)""")
def d01_route_problems(spark, d):
    w = Window.partitionBy("route_id").orderBy("stop_seq")
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    rows = px.route_stops(spark, d).withColumns({"nx": F.lead("lon").over(w), "ny": F.lead("lat").over(w)})
    here, there, k = point(F.col("lon"), F.col("lat")), point(F.col("nx"), F.col("ny")), F.col("stop_id") % 11
    away = point(F.col("lon") + 5.0, F.col("lat"))
    last = F.when(F.col("route_id") % 3 == 0, F.array(here, here))
    path = F.when(F.col("nx").isNull(), last).when(k == 0, None).when(k == 1, F.array(there, here)).when(k == 2, F.array(away, there)).otherwise(F.array(here, there))
    kind = F.when(F.col("route_id") % 5 == 4, "moon").otherwise("city")
    return simulation.route_problems(rows.select("route_id", "stop_order", "stop_id", "lon", "lat", path.alias("path_to_next"), kind.alias("jurisdiction")), simulation.JURISDICTIONS)


TIMES = f"""{TIMED}, gp AS (SELECT quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b, quantile_cont(c, 0.5) AS c FROM (SELECT SUM(off_peak_s)/SUM(metres) AS a, SUM(typical_s)/SUM(metres) AS b, SUM(peak_s)/SUM(metres) AS c FROM timed WHERE metres > 0 AND typical_s > 0 GROUP BY route_id)),
       sg AS (SELECT route_id, stop_order AS segment, CAST({METRES} AS DOUBLE) AS metres, stop_order % 3 <> 0 AS known FROM route_stops),
       tt AS (SELECT route_id, segment, metres, CAST(greatest(1, floor(metres * CASE WHEN known THEN 0.2 ELSE a END + 0.5)) AS BIGINT) AS off_peak_s, CAST(greatest(1, floor(metres * CASE WHEN known THEN 0.25 ELSE b END + 0.5)) AS BIGINT) AS typical_s, CAST(greatest(1, floor(metres * CASE WHEN known THEN 0.3 ELSE c END + 0.5)) AS BIGINT) AS peak_s, CASE WHEN known THEN 'high' ELSE 'low' END AS confidence FROM sg, gp)"""


def _paces(spark, d):
    return px.route_stops(spark, d).where("stop_order % 3 <> 0").select("route_id", F.col("stop_order").alias("segment"), F.lit(0.2).alias("off_peak"), F.lit(0.25).alias("typical"), F.lit(0.3).alias("peak"), F.lit("high").alias("confidence"))


def _times(spark, d):
    return simulation.travel_time(_segments(spark, d), _paces(spark, d), simulation.global_paces(_timed(spark, d)))


@query(with_("route_stops", more=TIMES) + "SELECT * FROM tt")
def d10_travel_time(spark, d):
    return _times(spark, d)


@query(with_("route_stops", more=TIMES) + "SELECT route_id, SUM(metres) AS metres, CAST(SUM(off_peak_s) AS BIGINT) AS off_peak_s, CAST(SUM(typical_s) AS BIGINT) AS typical_s, CAST(SUM(peak_s) AS BIGINT) AS peak_s, CASE WHEN bool_or(confidence = 'low') THEN 'low' ELSE 'high' END AS confidence FROM tt GROUP BY 1")
def d10_route_time(spark, d):
    return simulation.route_time(_times(spark, d))


SIMULATED = (
    with_("cells", "od", "route_stops", more=ASSIGN + ", " + REVENUE + ", " + TIMES)
    + """, la AS (SELECT route_id, MAX(stop_order) AS last, COUNT(*) AS stops FROM route_stops GROUP BY 1), tm AS (SELECT tt.route_id, SUM(metres) AS metres, SUM(typical_s) AS typical_s FROM tt JOIN la ON la.route_id = tt.route_id AND segment < last GROUP BY 1),
       mo AS (SELECT route_id, SUM(gross) AS gross, SUM(potential) AS potential, SUM(revenue) AS revenue FROM rev GROUP BY 1),
       sim AS (SELECT la.route_id, stops, metres, typical_s, COALESCE(gross, 0) AS gross, COALESCE(potential, 0) AS potential, COALESCE(revenue, 0) AS revenue FROM la LEFT JOIN tm USING (route_id) LEFT JOIN mo USING (route_id))"""
)


def _simulated(spark, d):
    from .queries import d13_simulation

    return d13_simulation(spark, d)


@query(SIMULATED + "SELECT route_id, CAST(stops AS BIGINT) AS stops, metres, CAST(typical_s AS BIGINT) AS typical_s, round(gross, 3) AS gross, round(potential, 3) AS potential, round(revenue/100, 0) AS revenue FROM sim")
def d13_simulated_routes(spark, d):
    return _simulated(spark, d).select("route_id", "stops", "metres", "typical_s", F.round("gross", 3).alias("gross"), F.round("potential", 3).alias("potential"), F.round(F.col("revenue_cents") / 100, 0).alias("revenue"))


@query(SIMULATED + """SELECT route_id, CASE WHEN route_id % 4 = 0 THEN CASE WHEN route_id % 3 = 0 THEN CAST(route_id AS BIGINT) END ELSE CAST(round_even(typical_s, 0) AS BIGINT) END AS typical_s, CASE WHEN route_id % 4 = 0 THEN 'skipped' WHEN metres IS NULL AND FALSE THEN 'failed' ELSE 'done' END AS status FROM sim""")
def e17_precomputed(spark, d):
    routes = px.routes(spark, d).select("route_id", (F.col("route_id") % 4 != 0).alias("simulable"))
    sims = _simulated(spark, d).where("route_id % 4 <> 0")
    old = routes.where("route_id % 3 = 0").select("route_id", F.lit(7).cast("long").alias("potential"), F.lit(8).cast("long").alias("revenue_cents"), F.col("route_id").alias("typical_s"))
    return simulation.precompute(routes, sims, old).select("route_id", "typical_s", "status")


@query(with_("route_stops") + """, n AS (SELECT route_id, stop_id, stop_seq, lead(stop_id) OVER (PARTITION BY route_id ORDER BY stop_seq) AS nid FROM route_stops)
       SELECT route_id, CAST(COUNT(*) AS INTEGER) AS stops, arg_min(CAST(stop_id AS VARCHAR), stop_seq) AS first_id, COUNT(*) FILTER (WHERE nid IS NOT NULL AND stop_id % 13 = 0) = 0 AS simulable FROM n GROUP BY 1""")
def d16_exported_lines(spark, d):
    w = Window.partitionBy("route_id").orderBy("stop_seq")
    rows = px.route_stops(spark, d).withColumns({"nx": F.lead("lon").over(w), "ny": F.lead("lat").over(w)})
    point = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    rows = rows.withColumn("path_to_next", F.when(F.col("nx").isNotNull() & (F.col("stop_id") % 13 != 0), F.array(point("lon", "lat"), point("nx", "ny"))))
    out = catalog.export_lines(rows.select("route_id", "stop_seq", "stop_id", "path_to_next"), px.stops(spark, d))
    return out.select("route_id", F.size("stops").alias("stops"), F.col("stops")[0]["id"].alias("first_id"), "simulable")


@query(with_("route_stops", "routes") + "SELECT route_id, stop_seq, stop_id, name FROM routes JOIN route_stops USING (route_id) WHERE route_id = 3")
def d18_line_detail(spark, d):
    rows = catalog.line_detail(px.routes(spark, d), px.route_stops(spark, d).select("route_id", "stop_id", "stop_seq"), px.stops(spark, d), 3)
    return rows.select("route_id", "stop_seq", "stop_id", "name")


@query(with_("cells", "route_stops", more=WALK + ",\n" + SERVICE + """,
       dy AS (SELECT r1, r2, SUM(trips) AS trips, GREATEST(SUM(trips*n)/NULLIF(SUM(trips),0), 1) AS alternatives, CAST(COUNT(DISTINCT (origin, dest)) AS BIGINT) AS od_pairs FROM att GROUP BY 1, 2)""")
       + "SELECT r1, r2, round(trips, 4) AS trips, od_pairs, round(trips/MAX(trips) OVER (), 5) AS share, COALESCE(alternatives, 1) > 5 AS weak, CAST(COUNT(*) OVER () AS BIGINT) AS total FROM dy ORDER BY round(trips, 6) DESC, r1, r2 LIMIT 10")
def d20_ranked_page(spark, d):
    r = feed.named_routes(px.routes(spark, d), "short_name")
    ranking, cells = _ranking(spark, d)
    rows = transfers.ranking_page(ranking.withColumn("trips", F.round("trips", 6)), r, cells, None, 10)
    return rows.select("r1", "r2", r4("trips").alias("trips"), "od_pairs", F.round("share", 5).alias("share"), "weak", "total")

