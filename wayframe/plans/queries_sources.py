"""Queries over sources, sinks and geometry, each with its SQL twin."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import agg, geo
from ..operators import relational as rel
from ..operators.checkpoints import checkpointed, scratch
from ..schemas import FILES, parsed
from ..sources import files, sinks
from . import proxy as px
from .proxy import hav_sql, table, with_
from .queries import query, r4


def paths(spark, d):
    rows = px.route_stops(spark, d).groupBy("route_id").agg(geo.path_points(F.col("stop_seq"), F.col("lon"), F.col("lat")).alias("path"))
    return rows.where(F.size("path") > 1)


EDGES = """ed AS (SELECT * FROM (SELECT route_id, stop_seq, stop_id, lon, lat, lead(lon) OVER w AS nx, lead(lat) OVER w AS ny, lead(stop_id) OVER w AS next_id, COUNT(*) OVER (PARTITION BY route_id) AS n
       FROM route_stops WINDOW w AS (PARTITION BY route_id ORDER BY stop_seq)) WHERE nx IS NOT NULL)"""
RUNS = EDGES + """, pl AS (SELECT *, sqrt(pow(nx-lon,2)+pow(ny-lat,2)) AS size FROM ed),
       ru AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY route_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, SUM(size) OVER (PARTITION BY route_id) AS total FROM pl)"""


# files


def _feed_stops(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.cast("string").alias("STOP_ID"), F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("Stop_Code"), F.col("c_mktsegment").alias("stop_name"),
        (F.col("c_acctbal")).alias("stop_lat"), F.when(k % 5 != 0, k / 8).alias("stop_lon"),
    )


@query("SELECT CAST(c_custkey AS VARCHAR) AS stop_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS stop_code, c_mktsegment AS stop_name, c_acctbal AS stop_lat, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey / 8 END AS stop_lon FROM customer")
def s01_strict_scan(spark, d):
    at = scratch(spark, "stops")
    _feed_stops(spark, d).write.csv(at, header=True, nullValue="", emptyValue="")
    return files.read_delimited(spark, at, "stops")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 2 THEN '4 columns instead of 5' WHEN 3 THEN 'column 2' END AS problem FROM nation")
def s02_header_check(spark, d):
    k = F.col("n_nationkey") % 4
    right = ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon"]
    header = F.when(k == 0, ",".join(right)).when(k == 1, "﻿" + ",".join(right).upper() + "\r").when(k == 2, ",".join(right[:4])).otherwise(",".join([right[0], "code", *right[2:]]))
    return files.header_problems(table(spark, d, "nation").withColumn("header", header), parsed(FILES["stops"])).select("n_nationkey", "problem")


@query("SELECT 'customer' AS name, CAST(COUNT(*) AS BIGINT) AS rows FROM customer UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'part', COUNT(*) FROM part")
def s03_bulk_load(spark, d):
    staged = sinks.bulk_load({n: table(spark, d, n) for n in ("customer", "orders", "part")}, scratch(spark, "staging"))
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, df in staged.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('agency', 6, 'agency_id'), ('routes', 6, 'route_id'), ('trips', 9, 'route_id'), ('stops', 5, 'stop_id'), ('stop_times', 7, 'trip_id'), ('shapes', 5, 'shape_id'), ('calendar_dates', 3, 'service_id'), ('survey', 17, 'card_id')) t(file, columns, first_column)")
def s04_registry(spark, d):
    rows = [(name, len(parsed(ddl)), parsed(ddl)[0].name) for name, ddl in FILES.items()]
    return spark.createDataFrame(rows, "file string, columns int, first_column string")


@query("""SELECT o_orderkey AS relation_id, CASE WHEN o_orderkey % 2 = 0 THEN 'no_left_turn' ELSE 'only_straight_on' END AS kind, o_orderstatus || ', ' || o_orderpriority AS note,
       o_custkey AS from_way, CAST(o_orderkey % 7 + 1 AS INTEGER) AS members FROM orders WHERE o_orderkey % 5 <> 0""")
def s05_restriction_lines(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "no_left_turn").otherwise("only_straight_on")
    note = F.regexp_replace(F.concat_ws("%2c%%20%", "o_orderstatus", "o_orderpriority"), " ", "%20%")
    more = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("o_orderkey") % 7 + 1), lambda k: F.when(k == 1, F.concat(F.lit("w"), F.col("o_custkey").cast("string"), F.lit("@from"))).otherwise(F.concat(F.lit("n"), k.cast("string"), F.lit("@via")))), ",")
    line = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "n").otherwise("r"), F.col("o_orderkey").cast("string"), F.lit(" v1 dV Ttype=restriction,restriction="), kind, F.lit(",note="), note, F.lit(" M"), more)
    rows = files.parse_relations(o.select(line.alias("value")))
    way = F.filter("members", lambda m: m["role"] == "from")[0]["ref"]
    return rows.select("relation_id", F.col("tags")["restriction"].alias("kind"), F.col("tags")["note"].alias("note"), way.alias("from_way"), F.size("members").alias("members"))


WAY_REFS = """refs AS (SELECT route_id AS way_id, stop_id AS ref, stop_seq AS pos FROM route_stops UNION ALL SELECT r.route_id, s.stop_id, 100 FROM routes r JOIN route_stops s ON s.route_id = r.route_id + 1 AND s.stop_seq = 8)"""


def network_lines(spark, d):
    """Lines of a street extract: a node for each stop, a way for each route, which ends inside the next route."""
    coordinate = lambda c: F.round(c, 7).cast("decimal(12,7)").cast("string")
    nodes = px.stops(spark, d).select(F.concat(F.lit("n"), F.col("stop_id").cast("string"), F.lit(" v1 x"), coordinate(F.col("lon")), F.lit(" y"), coordinate(F.col("lat"))).alias("value"))
    rs = px.route_stops(spark, d)
    end = rs.where("stop_seq = 8").select((F.col("route_id") - 1).alias("route_id"), F.lit(100).alias("stop_seq"), "stop_id").join(px.routes(spark, d).select("route_id"), "route_id", "left_semi")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stop_seq", "stop_id"))), lambda r: F.concat(F.lit("n"), r["stop_id"].cast("string"))), ",")
    ways = rs.select("route_id", "stop_seq", "stop_id").unionByName(end).groupBy("route_id").agg(listed.alias("refs"))
    tag = F.when(F.col("route_id") % 4 == 0, "highway=footway").when(F.col("route_id") % 4 == 1, "highway=primary,oneway=yes,name=Av%2c%%20%Uno").when(F.col("route_id") % 4 == 2, "highway=residential,oneway=-1").otherwise("highway=service,bus=designated")
    return nodes.unionByName(ways.select(F.concat(F.lit("w"), F.col("route_id").cast("string"), F.lit(" v1 T"), tag, F.lit(" N"), F.col("refs")).alias("value")))


def imported(spark, d):
    lines = network_lines(spark, d)
    nodes, ways = files.parse_nodes(lines), files.parse_ways(lines)
    from . import streets

    # written once, as a load would, for the many steps that read them
    vertices, edges = streets.import_network(checkpointed(nodes), checkpointed(ways))
    return checkpointed(vertices), checkpointed(edges)


IMPORT = WAY_REFS + """, used AS (SELECT ref, COUNT(*) > 1 AS shared FROM refs GROUP BY 1),
       cu AS (SELECT way_id, ref, pos, shared OR lag(ref) OVER w IS NULL OR lead(ref) OVER w IS NULL AS cut FROM refs JOIN used USING (ref) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
       pc AS (SELECT *, SUM(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS piece FROM cu),
       bo AS (SELECT way_id, piece, ref, pos FROM pc UNION ALL SELECT way_id, piece - 1, ref, pos FROM pc WHERE cut AND piece > 1),
       imp AS (SELECT CAST(way_id * 4096 + piece AS BIGINT) AS edge_id, way_id, arg_min(ref, pos) AS source, arg_max(ref, pos) AS target, CAST(COUNT(*) AS INTEGER) AS points FROM bo GROUP BY way_id, piece HAVING COUNT(*) > 1)"""


@query(with_("route_stops", "routes", more=IMPORT) + "SELECT * FROM imp")
def s06_street_import(spark, d):
    _, edges = imported(spark, d)
    return edges.select("edge_id", "way_id", "source", "target", F.size("path").alias("points"))


@query(with_("route_stops") + "SELECT route_id, CAST(COUNT(*) AS INTEGER) AS points, round(MIN(lon), 6) AS min_lon, round(SUM(lat), 4) AS sum_lat FROM route_stops GROUP BY 1 HAVING COUNT(*) > 1")
def s12_geojson_round_trip(spark, d):
    text = paths(spark, d).select("route_id", files.to_geojson(F.col("path")).alias("body"))
    body = F.from_json("body", "type string, coordinates string")
    back = text.select("route_id", F.explode(files.lines_of(body["type"], body["coordinates"])).alias("path"))
    lons, lats = F.transform("path", lambda p: p["lon"]), F.transform("path", lambda p: p["lat"])
    return back.select("route_id", F.size("path").alias("points"), F.round(F.array_min(lons), 6).alias("min_lon"), r4(F.aggregate(lats, F.lit(0.0), lambda a, x: a + x)).alias("sum_lat"))


@query("""SELECT n_nationkey AS document, CAST(k AS INTEGER) AS ordinal, 's' || CAST(k AS VARCHAR) AS source_id, CAST(20 + k AS DOUBLE) AS speed_kph, k % 3 <> 0 AS has_speed, k % 4 = 0 AS closure, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS lines
       FROM (SELECT n_nationkey, unnest(generate_series(0, n_nationkey % 6)) AS k FROM nation)""")
def s13_feature_scan(spark, d):
    line = "[[-58.1,-34.1],[-58.2,-34.2]]"
    feature = lambda k: F.concat(
        F.lit('{"geometry":'), F.when(k % 2 == 0, f'{{"type":"LineString","coordinates":{line}}}').otherwise(f'{{"type":"MultiLineString","coordinates":[{line},{line}]}}'),
        F.lit(',"properties":{"source_id":"s'), k.cast("string"), F.lit('","speed_kph":"'), F.when(k % 3 != 0, (20 + k).cast("string")).otherwise((-20 - k).cast("string")), F.lit('","closure":"'), (k % 4 == 0).cast("string"), F.lit('"}}'),
    )
    docs = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"features":['), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_nationkey") % 6), feature), ","), F.lit("]}")).alias("body"))
    f = docs.select("n_nationkey", F.posexplode(F.from_json("body", files.FEATURES)["features"]).alias("ordinal", "f"))
    assert files.traffic_segments(docs).columns[0] == "ordinal"
    p = F.col("f.properties")
    lines = files.lines_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return f.select(F.col("n_nationkey").alias("document"), "ordinal", p["source_id"].alias("source_id"), F.abs(p["speed_kph"].cast("double")).alias("speed_kph"), (p["speed_kph"].cast("double") > 0).alias("has_speed"), p["closure"].cast("boolean").alias("closure"), F.size(lines).cast("long").alias("lines"))


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS parts, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS quantities FROM lineitem GROUP BY 1)
       SELECT l_orderkey, CAST(generate_subscripts(parts, 1) AS INTEGER) AS ordinal, unnest(parts) AS parts, unnest(quantities) AS quantities FROM l""")
def s14_parallel_arrays(spark, d):
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_quantity")]
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(agg.ordered_list(F.col("l_partkey"), *order).alias("parts"), agg.ordered_list(F.col("l_quantity"), *order).alias("quantities"))
    return files.unnested(rows, ["parts", "quantities"])


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, CAST(COUNT(*) AS BIGINT) AS rows FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(MAX(ts) AS DATE) - 6 FROM events) GROUP BY 1")
def s17_daily_partitions(spark, d):
    e, at = table(spark, d, "events"), scratch(spark, "positions")
    sinks.write_by_day(e, at, "ts")
    today = e.agg(F.max("ts")).first()[0]
    sinks.drop_expired_days(spark, at, today.date() if isinstance(today, datetime.datetime) else today, 7)
    return spark.read.parquet(at).groupBy(F.col("observed_day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT CAST(0 AS BIGINT) AS seq, 'header' AS kind, CAST(NULL AS BIGINT) AS value UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), 'analysis', CAST(n_nationkey AS BIGINT) FROM nation
       UNION ALL SELECT COUNT(*) + 1, 'complete', COUNT(*) FROM nation""")
def s18_report(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    lines, at = sinks.report_lines(table(spark, d, "region").select("r_regionkey", "r_name"), nations, ["n_nationkey"]), scratch(spark, "report")
    sinks.write_json_lines(lines, at)
    back = spark.read.schema("seq long, kind string, line string").json(at)
    value = F.coalesce(F.get_json_object("line", "$.n_nationkey"), F.get_json_object("line", "$.analyses")).cast("long")
    return back.select("seq", "kind", value.alias("value"))


@query(with_("route_stops") + "SELECT route_id, CAST(COUNT(*) AS INTEGER) AS stops, arg_min(stop_id, stop_seq) || '' AS first_id, CAST(COUNT(*) FILTER (WHERE stop_seq = 30) AS INTEGER) AS repeated FROM (SELECT route_id, stop_id, stop_seq FROM route_stops UNION ALL SELECT route_id, stop_id, 30 FROM route_stops WHERE stop_seq = 2) GROUP BY 1")
def s19_route_documents(spark, d):
    rs = px.route_stops(spark, d).select("route_id", "stop_id", "stop_seq")
    again = rs.where("stop_seq = 2").withColumn("stop_seq", F.lit(30))
    docs = sinks.route_documents(rs.unionByName(again), px.stops(spark, d))
    ids = F.from_json("document", "stops array<struct<id:string>>")["stops"]["id"]
    return docs.select("route_id", F.size(ids).alias("stops"), F.get(ids, F.lit(0)).alias("first_id"), F.size(F.filter(ids, lambda i: i.endswith("#30"))).alias("repeated"))


@query("SELECT sha256(event_type) AS sha256, CAST(COUNT(*) AS BIGINT) AS uses, CAST(SUM(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def s20_archive(spark, d):
    at = scratch(spark, "archive")
    sinks.write_archive(table(spark, d, "events").select("event_id", F.col("event_type").alias("body")), at)
    bodies, captures = spark.read.json(f"{at}/bodies"), spark.read.json(f"{at}/captures")
    return captures.join(bodies, "sha256").groupBy("sha256", "uses").agg(F.sum("event_id").alias("ids"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def s22_recreated_table(spark, d):
    c, at = table(spark, d, "customer").select("c_custkey", "c_name"), scratch(spark, "raw")
    sinks.overwrite(c, at)
    sinks.overwrite(c.where("c_custkey % 2 = 0"), at)
    return spark.read.parquet(at)


@query("SELECT 'nations' AS layer, CAST(COUNT(*) AS INTEGER) AS features, 'ok' AS state FROM nation UNION ALL SELECT 'regions', CAST(COUNT(*) AS INTEGER), 'ok' FROM region")
def s23_map_snapshot(spark, d):
    layer = lambda name, key: table(spark, d, name).select(F.lit("{}").alias("geojson"), F.col(key).alias("properties"))
    doc = sinks.map_snapshot({"nations": layer("nation", "n_name"), "regions": layer("region", "r_name")}, {"state": "ok"})
    got = doc.select(F.from_json("document", "layers map<string,array<string>>, status map<string,string>").alias("s"))
    return got.select(F.explode("s.layers").alias("layer", "f"), F.col("s.status")["state"].alias("state")).select("layer", F.size("f").alias("features"), "state")


TILE_Y = "CAST(floor((1-asinh(tan(radians({})))/pi())/2*1024) AS BIGINT)"


@query(with_("spots") + f"""SELECT DISTINCT 10 AS z, x, y FROM (SELECT x, unnest(generate_series(y0, y1)) AS y FROM (SELECT unnest(generate_series(CAST(floor((r_lon-0.2+180)/360*1024) AS BIGINT), CAST(floor((r_lon+0.3+180)/360*1024) AS BIGINT))) AS x,
       {TILE_Y.format("r_lat+0.25")} AS y0, {TILE_Y.format("r_lat-0.1")} AS y1 FROM spots))""")
def s10_tile_cover(spark, d):
    boxes = px.spots(spark, d).select((F.col("r_lon") - 0.2).alias("min_lon"), (F.col("r_lat") - 0.1).alias("min_lat"), (F.col("r_lon") + 0.3).alias("max_lon"), (F.col("r_lat") + 0.25).alias("max_lat"))
    return files.tile_cover(boxes, 10)


@query("SELECT l_suppkey, CAST(COUNT(*) AS BIGINT) AS rows, round(SUM(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def m04_recomputed_aggregates(spark, d):
    li, at = table(spark, d, "lineitem"), scratch(spark, "aggregates")
    totals = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    sinks.overwrite(totals.limit(1), at)  # what an earlier run left
    sinks.overwrite(totals, at)
    return spark.read.parquet(at)


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS tags, o_orderstatus AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 3 = 0 THEN 'clerk,status' ELSE 'clerk,priority,status' END AS names FROM orders")
def x03_maps(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.col(v).alias("value"))
    tags = F.map_from_entries(F.array(pair("status", "o_orderstatus"), pair("priority", "o_orderpriority"), pair("clerk", "o_orderstatus")))
    kept = F.map_filter(tags, lambda k, v: (k != "priority") | (F.col("o_orderkey") % 3 != 0))
    return table(spark, d, "orders").select("o_orderkey", F.size(kept).alias("tags"), kept["status"].alias("status"), kept["priority"].alias("priority"), F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("names"))


# relations


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def j06_anti_filtered(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(li, "p_partkey", "left_anti").select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority, c_name, cn.n_name AS customer_nation, cr.r_name AS customer_region, p_brand, s_name, sn.n_name AS supplier_nation, sr.r_name AS supplier_region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey""")
def j18_eight_dimensions(spark, d):
    place = lambda side: (
        table(spark, d, "nation").select(F.col("n_nationkey").alias(f"{side}_key"), F.col("n_name").alias(f"{side}_nation"), "n_regionkey")
        .join(table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias(f"{side}_region")), "n_regionkey").drop("n_regionkey")
    )
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("customer_key")).join(place("customer"), "customer_key")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("supplier_key")).join(place("supplier"), "supplier_key")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_custkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").join(p, "l_partkey").join(s, "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_name", "customer_nation", "customer_region", "p_brand", "s_name", "supplier_nation", "supplier_region")


@query(with_("route_stops") + "SELECT route_id, route_id % 7 <> 0 AS same FROM route_stops GROUP BY 1, 2 HAVING COUNT(*) > 1")
def j19_geometry_versions(spark, d):
    old = checkpointed(paths(spark, d).select("route_id", "path", geo.path_hash(F.col("path")).alias("version")))
    new = old.withColumn("path", F.when(F.col("route_id") % 7 == 0, F.reverse("path")).otherwise(F.col("path")))
    kept = new.select("route_id", geo.path_hash(F.col("path")).alias("version")).join(old.select("route_id", "version"), ["route_id", "version"]).select("route_id", F.lit(True).alias("same"))
    return old.select("route_id").join(kept, "route_id", "left").select("route_id", F.coalesce("same", F.lit(False)).alias("same"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 200 ORDER BY o_orderkey LIMIT 40")
def o04_keyset_page(spark, d):
    return rel.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200, 40)


@query("SELECT 'largest' AS stage, MAX(v) AS value FROM (SELECT l_suppkey, round(SUM(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1) UNION ALL SELECT 'smallest', MIN(v) FROM (SELECT l_suppkey, round(SUM(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1)")
def u05_stage(spark, d):
    stage = checkpointed(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v")))
    return stage.agg(F.lit("largest").alias("stage"), F.max("v").alias("value")).unionByName(stage.agg(F.lit("smallest").alias("stage"), F.min("v").alias("value")))


# aggregates


@query("SELECT user_id, CAST(to_json(list({'id': event_id, 'kind': event_type} ORDER BY event_id)) AS VARCHAR) AS document FROM events GROUP BY 1")
def a16_json_documents(spark, d):
    rows = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))))
    return table(spark, d, "events").groupBy("user_id").agg(F.to_json(rows).alias("document"))


DIGEST = """s AS (SELECT user_id, sha256('{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '"}') AS h FROM events)"""


@query(f"WITH {DIGEST} SELECT user_id, " + " || ".join(f"lpad(lower(hex(bit_xor(CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)))), 8, '0')" for k in range(8)) + " AS print FROM s GROUP BY 1")
def a25_set_fingerprint(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(agg.set_fingerprint(F.col("event_id"), F.col("event_type")).alias("print"))


@query("""SELECT user_id, sha256('[' || string_agg('{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '"}', ',' ORDER BY event_id) || ']') AS print FROM events GROUP BY 1""")
def a26_ordered_fingerprint(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(agg.ordered_fingerprint(F.col("event_id"), F.col("event_type")).alias("print"))


# geometry


def bearing_sql(a, b, c, d):
    return f"((degrees(atan2(sin(radians({c}-{a}))*cos(radians({d})), cos(radians({b}))*sin(radians({d}))-sin(radians({b}))*cos(radians({d}))*cos(radians({c}-{a}))))+360)%360)"


def point_edge_sql(x, y, a, b, c, d):
    """Metres from (x, y) to the edge from (a, b) to (c, d)."""
    off = f"radians({bearing_sql(a, b, x, y)}-{bearing_sql(a, b, c, d)})"
    d13 = f"{hav_sql(a, b, x, y)}/{geo.RADIUS_M}::DOUBLE"
    cross = f"asin(greatest(-1.0::DOUBLE,least(1.0::DOUBLE,sin({d13})*sin({off}))))"
    along = f"acos(greatest(-1.0::DOUBLE,least(1.0::DOUBLE,cos({d13})/cos({cross}))))*{geo.RADIUS_M}::DOUBLE"
    size = hav_sql(a, b, c, d)
    return f"(CASE WHEN {size} = 0 OR cos({off}) <= 0 THEN {hav_sql(a, b, x, y)} WHEN {along} > {size} THEN {hav_sql(c, d, x, y)} ELSE abs({cross})*{geo.RADIUS_M}::DOUBLE END)"


def _route_spots(spark, d):
    return px.spots(spark, d).withColumn("route_id", F.col("spot_id") % 20).join(paths(spark, d), "route_id")


SPOT = "sp AS (SELECT spot_id, r_lon, r_lat, spot_id % 20 AS route_id FROM spots)"


@query(with_("route_stops", "spots", more=EDGES + ", " + SPOT) + f"SELECT spot_id, stop_seq, round({point_edge_sql('r_lon', 'r_lat', 'lon', 'lat', 'nx', 'ny')}, 2) AS metres FROM sp JOIN ed USING (route_id)")
def g03_point_edge(spark, d):
    rows = _route_spots(spark, d).select("spot_id", "r_lon", "r_lat", F.posexplode(geo.edges(F.col("path"))).alias("k", "e"))
    at = geo.point_edge_distance(F.col("r_lon"), F.col("r_lat"), F.col("e.p.lon"), F.col("e.p.lat"), F.col("e.q.lon"), F.col("e.q.lat"))
    return rows.select("spot_id", (F.col("k") + 1).alias("stop_seq"), F.round(at, 2).alias("metres"))


@query(with_("route_stops", "spots", more=EDGES + ", " + SPOT) + f"SELECT spot_id, round(MIN({point_edge_sql('r_lon', 'r_lat', 'lon', 'lat', 'nx', 'ny')}), 2) AS metres FROM sp JOIN ed USING (route_id) GROUP BY 1")
def g04_point_path(spark, d):
    return _route_spots(spark, d).select("spot_id", F.round(geo.point_path_distance(F.col("r_lon"), F.col("r_lat"), F.col("path")), 2).alias("metres"))


LOCATED = RUNS + ", " + SPOT + """, tt AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(1, ((r_lon-lon)*(nx-lon)+(r_lat-lat)*(ny-lat))/(size*size))) END AS t FROM sp JOIN ru USING (route_id)),
       lc AS (SELECT spot_id, (run + t*size)/total AS fraction FROM tt QUALIFY row_number() OVER (PARTITION BY spot_id ORDER BY pow(lon+t*(nx-lon)-r_lon,2)+pow(lat+t*(ny-lat)-r_lat,2), stop_seq) = 1)"""


@query(with_("route_stops", "spots", more=LOCATED) + "SELECT spot_id, round(fraction, 5) AS fraction FROM lc")
def g05_locate(spark, d):
    return _route_spots(spark, d).select("spot_id", F.round(geo.locate(F.col("r_lon"), F.col("r_lat"), F.col("path")), 5).alias("fraction"))


@query(with_("route_stops", more=RUNS + ", iv AS (SELECT route_id, MAX(total) AS total, CAST(COUNT(*) FILTER (WHERE run/total > 0.25 AND run/total < 0.75) AS INTEGER) + 2 AS points FROM ru GROUP BY 1)") + """SELECT iv.route_id, points, round(a.lon + (0.25*iv.total-a.run)/a.size*(a.nx-a.lon), 5) AS lon, round(a.lat + (0.25*iv.total-a.run)/a.size*(a.ny-a.lat), 5) AS lat,
       round(b.lon + (0.75*iv.total-b.run)/b.size*(b.nx-b.lon), 5) AS end_lon FROM iv JOIN ru a ON a.route_id = iv.route_id AND 0.25*iv.total >= a.run AND 0.25*iv.total < a.run + a.size JOIN ru b ON b.route_id = iv.route_id AND 0.75*iv.total >= b.run AND 0.75*iv.total < b.run + b.size""")
def g06_substring(spark, d):
    rows = paths(spark, d).select("route_id", geo.substring(F.col("path"), F.lit(0.25), F.lit(0.75)).alias("s"))
    return rows.select("route_id", F.size("s").alias("points"), F.round(F.col("s")[0]["lon"], 5).alias("lon"), F.round(F.col("s")[0]["lat"], 5).alias("lat"), F.round(F.element_at("s", -1)["lon"], 5).alias("end_lon"))


@query(with_("route_stops", more=EDGES) + f"SELECT route_id, CAST(row_number() OVER w - 1 AS INTEGER) AS edge, round({hav_sql('lon', 'lat', 'nx', 'ny')}, 3) AS edge_m, round(COALESCE(SUM({hav_sql('lon', 'lat', 'nx', 'ny')}) OVER (PARTITION BY route_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS from_m FROM ed WINDOW w AS (PARTITION BY route_id ORDER BY stop_seq)")
def g07_shape_edges(spark, d):
    from ..streaming import bottlenecks

    rows = bottlenecks.shape_edges(paths(spark, d).withColumnRenamed("route_id", "shape_id"))
    return rows.select(F.col("shape_id").alias("route_id"), "edge", F.round("edge_m", 3).alias("edge_m"), F.round("from_m", 2).alias("from_m"))


@query(with_("route_stops", more="b AS (SELECT route_id, MIN(lon) AS x0, MAX(lon) AS x1, MIN(lat) AS y0, MAX(lat) AS y1 FROM route_stops GROUP BY 1 HAVING COUNT(*) > 1)") + f"""SELECT route_id, round(x0 - dx, 6) AS min_lon, round(y0 - dy, 6) AS min_lat, round(x1 + dx, 6) AS max_lon, round(y1 + dy, 6) AS max_lat
       FROM (SELECT *, dy/greatest(cos(radians(least(greatest(abs(y0), abs(y1)) + dy, 89.9))), 1e-6) AS dx FROM (SELECT *, {250 / geo.DEGREE_M}::DOUBLE AS dy FROM b))""")
def g10_expanded_box(spark, d):
    rows = paths(spark, d).select("route_id", geo.expanded_box(F.col("path"), 250.0).alias("b"))
    return rows.select("route_id", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query(with_("route_stops", more=EDGES) + "SELECT route_id, CAST(COUNT(*) + 1 AS INTEGER) AS points FROM ed GROUP BY 1")
def g16_joined_paths(spark, d):
    parts = paths(spark, d).select("route_id", F.transform(geo.edges(F.col("path")), lambda e: F.array(e["p"], e["q"])).alias("parts"))
    return parts.select("route_id", F.size(geo.join_paths(F.col("parts"))).alias("points"))


@query(with_("route_stops", more=EDGES) + "SELECT route_id, stop_seq, stop_id % 3 = 1 AS off, CASE WHEN stop_id % 3 = 0 THEN round(lon + 0.0005, 7) WHEN stop_id % 3 = 1 THEN round(lon + 0.02, 7) ELSE round(nx, 7) END AS first_lon FROM ed WHERE abs(lon-nx) > 0.1")
def g17_alignment(spark, d):
    rows = paths(spark, d).select("route_id", F.posexplode(geo.edges(F.col("path"))).alias("k", "e"))
    first = px.route_stops(spark, d).groupBy("route_id").agg(F.min("stop_seq").alias("s"), F.min("stop_id").alias("i"))
    rows = rows.join(first, "route_id").withColumns({"stop_seq": F.col("k") + F.col("s"), "stop_id": F.col("k") + F.col("i")}).where(F.abs(F.col("e.p.lon") - F.col("e.q.lon")) > 0.1)
    way = F.when(F.col("stop_id") % 3 == 2, F.array(F.col("e.q"), F.col("e.p"))).otherwise(F.array(F.col("e.p"), F.col("e.q")))
    shift = F.when(F.col("stop_id") % 3 == 0, 0.0005).when(F.col("stop_id") % 3 == 1, 0.02).otherwise(0.0)
    aligned, problem = geo.align_path(way, F.col("e.p.lon") + shift, F.col("e.p.lat"), F.col("e.q.lon"), F.col("e.q.lat"), 250.0)
    first_lon = F.when(F.col("stop_id") % 3 == 1, F.col("e.p.lon") + 0.02).otherwise(F.get(aligned, F.lit(0))["lon"])
    return rows.select("route_id", "stop_seq", problem.isNotNull().alias("off"), F.round(first_lon, 7).alias("first_lon"))


@query(with_("route_stops") + "SELECT route_id, COUNT(*) > 1 AND route_id % 4 NOT IN (1, 2) AS valid, CAST(COUNT(*) AS INTEGER) AS points FROM route_stops GROUP BY 1")
def g18_validity(spark, d):
    rows = px.route_stops(spark, d).groupBy("route_id").agg(geo.path_points(F.col("stop_seq"), F.col("lon"), F.col("lat")).alias("path"))
    k, first = F.col("route_id") % 4, F.element_at("path", 1)
    spoiled = F.when(k == 1, F.transform("path", lambda p: F.struct(first["lon"].alias("lon"), first["lat"].alias("lat")))).when(k == 2, F.transform("path", lambda p: F.struct((p["lon"] + 300).alias("lon"), p["lat"].alias("lat")))).otherwise(F.col("path"))
    return rows.select("route_id", geo.valid_path(spoiled).alias("valid"), F.size("path").alias("points"))


@query(with_("route_stops", more=EDGES) + "SELECT route_id, stop_seq, round((lon+nx)/2, 7) AS lon, round((lat+ny)/2, 7) AS lat FROM ed")
def g19_centroid(spark, d):
    w = Window.partitionBy("route_id").orderBy("stop_seq")
    rows = px.route_stops(spark, d).withColumns({"nx": F.lead("lon").over(w), "ny": F.lead("lat").over(w)}).where("nx IS NOT NULL")
    lon, lat = geo.centroid(F.col("lon"), F.col("lat"), F.col("nx"), F.col("ny"))
    return rows.select("route_id", "stop_seq", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _mercator_sql() -> str:
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    radius = geo.AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    c = 2 * n**0.5 / (1 + n)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    east = "eta" + "".join(f" + {x!r}::DOUBLE*cos({2 * k}*xi)*sinh({2 * k}*eta)" for k, x in enumerate(a, 1))
    north = "xi" + "".join(f" + {x!r}::DOUBLE*sin({2 * k}*xi)*cosh({2 * k}*eta)" for k, x in enumerate(a, 1))
    return f"""SELECT stop_id, round(500000 + {geo.SCALE * radius!r}::DOUBLE*({east}), 3) AS east_m, round(10000000 + {geo.SCALE * radius!r}::DOUBLE*({north}), 3) AS north_m FROM
       (SELECT stop_id, atan2(t, cos(dl)) AS xi, atanh(sin(dl)/sqrt(1+t*t)) AS eta FROM (SELECT stop_id, radians(lon+57) AS dl, sinh(atanh(sin(radians(lat))) - {c!r}::DOUBLE*atanh({c!r}::DOUBLE*sin(radians(lat)))) AS t FROM stops))"""


@query(with_("stops") + _mercator_sql())
def g20_planar_metres(spark, d):
    east, north = geo.transverse_mercator(F.col("lon"), F.col("lat"))
    return px.stops(spark, d).select("stop_id", F.round(east, 3).alias("east_m"), F.round(north, 3).alias("north_m"))


@query(with_("positions") + """, n AS (SELECT vehicle, row_number() OVER (PARTITION BY vehicle ORDER BY obs_id) - 1 AS k, COUNT(*) OVER (PARTITION BY vehicle) AS n FROM positions)
       SELECT vehicle, CAST(f AS INTEGER) AS fragment, CAST(least(n - f*10, 11) AS INTEGER) AS points FROM (SELECT DISTINCT vehicle, n, unnest(generate_series(0, greatest(1, CAST(ceil((n-1)/10) AS BIGINT)) - 1)) AS f FROM n)""")
def g21_fragments(spark, d):
    rows = px.positions(spark, d).groupBy("vehicle").agg(geo.path_points(F.col("obs_id"), F.col("lon"), F.col("lat")).alias("path"))
    return rows.select("vehicle", F.posexplode(geo.fragments(F.col("path"), 10)).alias("fragment", "part")).select("vehicle", "fragment", F.size("part").alias("points"))
