"""Queries over ingestion, bunching, bottlenecks and audits, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..policy import BottleneckPolicy, BunchingPolicy, GpsPolicy
from ..streaming import bottlenecks, bunching, ingest, producer
from . import audit
from . import proxy as px
from .proxy import hav_sql, table, with_
from .queries import EPISODES, NOW, _episodes, query
from .queries_sources import EDGES, paths, point_edge_sql

AT = "epoch_us(ts)/1e6"


# ingestion


ROWS = """mx AS (SELECT MAX(ts) AS m FROM events), ba AS (SELECT event_id AS capture_id, CAST(user_id % 40 AS VARCHAR) AS vehicle, event_type AS route, CAST(event_id % 2 AS SMALLINT) AS direction, date_trunc('hour', ts) AS observed_at, m AS received_at, value AS lon, value / 2 AS lat FROM events, mx),
       eq AS (SELECT event_type AS route, CAST(0 AS SMALLINT) AS direction, 'f-' || event_type AS feed_route FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'view'),
       ad AS (SELECT ba.*, feed_route FROM ba LEFT JOIN eq USING (route, direction) WHERE CAST(observed_at AS DATE) >= CAST(received_at AS DATE) - 6 AND observed_at <= received_at + INTERVAL 60 SECOND),
       fi AS (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY vehicle, observed_at ORDER BY capture_id, route, direction, lon, lat) = 1),
       nw AS (SELECT * FROM fi WHERE vehicle NOT IN ('1', '2', '3'))"""


def _ingested(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("received_at"))
    k = F.col("event_id")
    rows = e.crossJoin(F.broadcast(last)).select(
        k.alias("capture_id"), (F.col("user_id") % 40).cast("string").alias("vehicle"), F.col("event_type").alias("route"), (k % 2).cast("short").alias("direction"),
        F.date_trunc("hour", "ts").alias("observed_at"), "received_at", F.col("value").alias("lon"), (F.col("value") / 2).alias("lat"),
    )
    routes = e.select("event_type").distinct().where("event_type <> 'view'")
    equal = routes.select(F.col("event_type").alias("route"), F.lit(0).cast("short").alias("direction"), F.concat(F.lit("f-"), "event_type").alias("feed_route"), F.lit(0).alias("feed_direction"), F.lit(True).alias("active"))
    old = rows.where("vehicle IN ('1', '2', '3')").select(F.to_date("observed_at").alias("observed_day"), "vehicle", "observed_at").distinct()
    return ingest.ingest_batch(old, rows, equal)


@query(f"WITH {ROWS} SELECT vehicle, strftime(observed_at, '%Y-%m-%d %H') AS hour, capture_id, feed_route FROM nw")
def t01_ingested(spark, d):
    new, _ = _ingested(spark, d)
    return new.select("vehicle", F.date_format("observed_at", "yyyy-MM-dd HH").alias("hour"), "capture_id", "feed_route")


@query(f"WITH {ROWS} SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM ba) AS received, (SELECT CAST(COUNT(*) AS BIGINT) FROM ad) AS admitted, (SELECT CAST(COUNT(*) AS BIGINT) FROM ad WHERE feed_route IS NULL) AS unmapped, (SELECT CAST(COUNT(*) AS BIGINT) FROM nw) AS inserted, (SELECT CAST(COUNT(*) AS BIGINT) FROM ba) - (SELECT CAST(COUNT(*) AS BIGINT) FROM ad) AS outside")
def t02_admission(spark, d):
    return _ingested(spark, d)[1]


# bunching

HOURS = f"hc AS (SELECT CAST(floor({AT}/3600) AS BIGINT) AS capture_id, (floor({AT}/3600)*3600+3600)::DOUBLE AS received_at, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS vehicles FROM events GROUP BY 1, 2), nc AS (SELECT *, row_number() OVER (ORDER BY received_at, capture_id) AS n FROM hc)"


@query(f"""WITH RECURSIVE {HOURS}, he(n, capture_id, reference, partial) AS (SELECT n, capture_id, CASE WHEN vehicles = 0 THEN 0 ELSE vehicles END, vehicles = 0 FROM nc WHERE n = 1 UNION ALL
       SELECT nc.n, nc.capture_id, CASE WHEN nc.vehicles = 0 OR nc.vehicles < 0.7 * he.reference THEN he.reference ELSE nc.vehicles END, nc.vehicles = 0 OR nc.vehicles < 0.7 * he.reference FROM he JOIN nc ON nc.n = he.n + 1) SELECT capture_id, partial FROM he""")
def t03_capture_health(spark, d):
    return bunching.health(px.captures(spark, d), GpsPolicy()).select("capture_id", "partial")


@query(with_("captures", more="""lp AS (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY capture_id, vehicle ORDER BY observed_at DESC, lon DESC, lat DESC) = 1), sg AS (SELECT capture_id, string_agg(vehicle || '@' || CAST(obs_id AS VARCHAR), ',' ORDER BY vehicle) AS print FROM lp GROUP BY 1),
       al AS (SELECT c.capture_id, received_at, partial, COALESCE(print, '') AS print FROM captures c LEFT JOIN sg USING (capture_id)), pv AS (SELECT *, last_value(CASE WHEN NOT partial THEN print END IGNORE NULLS) OVER (ORDER BY received_at, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM al)""")
       + "SELECT capture_id, NOT partial AND print IS DISTINCT FROM b AS novel FROM pv")
def t05_novel_captures(spark, d):
    c, policy = px.captures(spark, d), BunchingPolicy(max_age_s=7200.0, max_skew_s=0.0)
    return bunching.novelty(bunching.snapshot(c, px.positions(spark, d), policy), c).select("capture_id", "novel")


@query(f"WITH {EPISODES} SELECT 'open' AS state, CAST(COUNT(*) FILTER (WHERE closed_at IS NULL) AS BIGINT) AS episodes FROM pub WHERE first_at < {NOW} AND COALESCE(closed_at, last_at) >= {NOW} - 864000 UNION ALL SELECT 'closed', COUNT(*) FILTER (WHERE closed_at IS NOT NULL) FROM pub WHERE first_at < {NOW} AND COALESCE(closed_at, last_at) >= {NOW} - 864000 UNION ALL SELECT 'all', COUNT(*) FROM pub WHERE first_at < {NOW} AND COALESCE(closed_at, last_at) >= {NOW} - 864000")
def p09_lifecycle_filter(spark, d):
    e = _episodes(spark, d)
    parts = [bunching.history(e, NOW - 864_000, NOW, state).agg(F.lit(state).alias("state"), F.coalesce(F.max("total"), F.lit(0)).alias("episodes")) for state in ("open", "closed", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {EPISODES} SELECT scope, a, b, round(first_at, 3) AS first_at FROM pub WHERE closed_at IS NULL AND last_at BETWEEN {NOW} - 300000 AND {NOW} + 60")
def t10_current_pairs(spark, d):
    return bunching.current_pairs(_episodes(spark, d), NOW, BunchingPolicy(max_age_s=300_000.0)).select("scope", "a", "b", F.round("first_at", 3).alias("first_at"))


@query(with_("captures") + f"SELECT capture_id, received_at, {NOW}::DOUBLE - received_at AS age_s, partial, {NOW}::DOUBLE - received_at > 300 AS stale, FALSE AS no_captures FROM captures ORDER BY received_at DESC, capture_id DESC LIMIT 1")
def y10_latest_capture(spark, d):
    return bunching.latest_capture(px.captures(spark, d), NOW)


@query(f"WITH {EPISODES} SELECT scope, CAST(COUNT(*) AS BIGINT) AS episodes, CAST(COUNT(*) FILTER (WHERE closed_at IS NULL AND scope <> 'view' AND last_at BETWEEN {NOW} - 300000 AND {NOW} + 60) AS BIGINT) AS active FROM ep GROUP BY 1")
def y11_active_episodes(spark, d):
    e = _episodes(spark, d)
    rows = bunching.with_activity(e, e.select("scope").where("scope <> 'view'"), NOW, BunchingPolicy(max_age_s=300_000.0))
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("episodes"), F.count_if("active").alias("active"))


@query(f"WITH {EPISODES} SELECT scope, a, b FROM pub WHERE closed_at IS NULL AND last_at BETWEEN {NOW} - 300000 AND {NOW} + 60 AND scope IN ('view', 'click')")
def t10_line_bunching(spark, d):
    e = _episodes(spark, d)
    routes = e.select("scope").distinct().select("scope", F.when(F.col("scope").isin("view", "click"), "7").otherwise("8").alias("line"))
    return bunching.line_bunching(e, routes, "7", NOW, BunchingPolicy(max_age_s=300_000.0)).select("scope", "a", "b")


@query(f"""WITH {EPISODES}, sp AS (SELECT CAST(user_id AS VARCHAR) AS v, event_type AS scope, {AT} AS t, value AS s FROM events)
       SELECT ep.scope, a, b, round(ep.first_at, 3) AS first_at, round(greatest(any_value(max_speed_a), COALESCE(MAX(sa.s), 0)), 4) AS max_speed_a FROM ep LEFT JOIN sp sa ON sa.v = a AND sa.scope = ep.scope AND sa.t BETWEEN first_at AND last_at GROUP BY 1, 2, 3, 4""")
def m11_backfilled_speeds(spark, d):
    e = table(spark, d, "events")
    p = e.select(F.col("user_id").cast("string").alias("vehicle"), F.col("event_type").alias("scope"), (F.unix_micros("ts") / 1e6).alias("observed_at"), F.col("value").alias("speed_mps"))
    rows = bunching.backfill_speeds(_episodes(spark, d), p)
    return rows.groupBy("scope", "a", "b", F.round("first_at", 3).alias("first_at")).agg(F.round(F.max("max_speed_a"), 4).alias("max_speed_a"))


@query(f"""WITH {EPISODES} SELECT rule, CAST(broken AS BIGINT) AS broken FROM (SELECT 'order' AS rule, COUNT(*) FILTER (WHERE NOT first_at <= last_at) AS broken FROM ep UNION ALL SELECT 'radius', COUNT(*) FILTER (WHERE NOT observations * 30 <= 100) FROM ep UNION ALL
       SELECT 'closed before last', COUNT(*) FILTER (WHERE closed_at IS NOT NULL AND closed_at < last_at) FROM ep UNION ALL SELECT 'reason', COUNT(*) FILTER (WHERE (closed_at IS NULL) <> (observations = 3)) FROM ep UNION ALL SELECT 'pair order', COUNT(*) FILTER (WHERE NOT a < b) FROM ep)""")
def k07_bunching_integrity(spark, d):
    e = _episodes(spark, d).withColumns({"min_distance": F.col("observations") * 30.0, "reason": F.when(F.col("observations") != 3, "separated")})
    return audit.bunching_integrity(e)


# bottlenecks


def _measured(spark, d):
    t, v = F.unix_micros("ts") / 1e6, F.col("value")
    return table(spark, d, "events").select(
        (F.col("event_id") % 12).cast("int").alias("sector"), F.col("user_id").cast("string").alias("vehicle"), t.alias("entered_at"), (t + v + 1).alias("exited_at"),
        F.when(F.col("event_id") % 9 == 0, v).otherwise(v + 1).alias("duration_s"), F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(v + 2).alias("kmh"),
        F.when(F.col("event_id") % 3 == 0, "incomplete").when(F.col("event_id") % 17 == 0, "rejected").otherwise("passage").alias("kind"),
    )


MEASURED = f"me AS (SELECT CAST(event_id % 12 AS INTEGER) AS sector, CAST(user_id AS VARCHAR) AS vehicle, {AT} AS entered_at, {AT} + value + 1 AS exited_at, CASE WHEN event_id % 9 = 0 THEN value ELSE value + 1 END AS duration_s, CASE WHEN event_id % 10 = 0 THEN 0 ELSE value + 2 END AS kmh, CASE WHEN event_id % 3 = 0 THEN 'incomplete' WHEN event_id % 17 = 0 THEN 'rejected' ELSE 'passage' END AS kind, ts FROM events)"


@query(f"""WITH {MEASURED}, un AS (SELECT CAST(event_id % 12 AS INTEGER) AS sector, CAST(user_id AS VARCHAR) AS vehicle, ts AS t, 'gps' AS kind FROM events UNION ALL SELECT sector, vehicle, ts, kind FROM me WHERE kind <> 'rejected'),
       dd AS (SELECT *, CAST(t - INTERVAL 3 HOUR AS DATE) AS date, CAST(hour(t - INTERVAL 3 HOUR) AS INTEGER) AS h FROM un)
       SELECT sector, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS INTEGER) AS hour, CAST(COUNT(*) FILTER (WHERE kind = 'gps') AS BIGINT) AS observations, CAST(COUNT(*) FILTER (WHERE kind = 'passage') AS BIGINT) AS passages, CAST(COUNT(*) FILTER (WHERE kind = 'incomplete') AS BIGINT) AS incomplete, CAST(COUNT(DISTINCT CASE WHEN kind = 'gps' THEN vehicle END) AS BIGINT) AS vehicles FROM dd GROUP BY 1
       UNION ALL SELECT sector, CAST(date AS VARCHAR), h, COUNT(*) FILTER (WHERE kind = 'gps'), COUNT(*) FILTER (WHERE kind = 'passage'), COUNT(*) FILTER (WHERE kind = 'incomplete'), COUNT(DISTINCT CASE WHEN kind = 'gps' THEN vehicle END) FROM dd GROUP BY 1, 2, 3""")
def a27_coverage_cube(spark, d):
    observed = _measured(spark, d).select("sector", "vehicle", F.col("entered_at").alias("observed_at"))
    return bottlenecks.coverage(observed, _measured(spark, d), "America/Argentina/Buenos_Aires").withColumn("date", F.col("date").cast("string"))


@query(f"WITH {MEASURED} SELECT vehicle, sector, round(entered_at, 3) AS entered_at FROM me WHERE kind = 'passage' AND NOT (duration_s > 0 AND kmh > 0 AND exited_at > entered_at AND abs(exited_at - entered_at - duration_s) < 1e-6)")
def t21_output_problems(spark, d):
    # binary fractions of a second are as exact here as in the twin
    return bottlenecks.output_problems(_measured(spark, d)).select("vehicle", "sector", F.round("entered_at", 3).alias("entered_at"))


@query("""SELECT event_id, sha256('{"layout":"l1","vehicle":"' || CAST(user_id AS VARCHAR) || '","scope":"' || event_type || '","sector":' || CAST(event_id % 12 AS VARCHAR) || '}') AS id FROM events""")
def y01_measurement_identity(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", bottlenecks.measurement_id(F.lit("l1").alias("layout"), F.col("user_id").cast("string").alias("vehicle"), F.col("event_type").alias("scope"), (F.col("event_id") % 12).alias("sector")).alias("id"))


@query(with_("route_stops", more=EDGES + f""", ln AS (SELECT route_id, SUM({hav_sql('lon', 'lat', 'nx', 'ny')}) AS len FROM ed GROUP BY 1), co AS (SELECT *, CAST(greatest(1, floor(len/50000) + CASE WHEN len - floor(len/50000)*50000 >= 25000 THEN 1 ELSE 0 END) AS INTEGER) AS count FROM ln)""")
       + "SELECT route_id, CAST(sector AS INTEGER) AS sector, sector = 0 AS first, sector = count - 1 AS last FROM (SELECT *, unnest(generate_series(0, count - 1)) AS sector FROM co)")
def y02_sector_paths(spark, d):
    shapes = paths(spark, d).select(F.col("route_id").alias("shape_id"), "path", geo.path_length(F.col("path")).alias("length_m"))
    rows = bottlenecks.sector_paths(bottlenecks.layout(shapes, BottleneckPolicy(sector_m=50_000.0)), shapes).withColumnRenamed("path", "part").join(shapes.select("shape_id", "path"), "shape_id")
    begins = F.abs(F.col("part")[0]["lon"] - F.col("path")[0]["lon"]) + F.abs(F.col("part")[0]["lat"] - F.col("path")[0]["lat"]) < 1e-9
    end, stop = F.element_at("part", -1), F.element_at("path", -1)
    ends = F.abs(end["lon"] - stop["lon"]) + F.abs(end["lat"] - stop["lat"]) < 1e-9
    return rows.select(F.col("shape_id").alias("route_id"), "sector", begins.alias("first"), ends.alias("last"))


SNAKE = """sk AS (SELECT user_id AS shape_id, k AS edge, -58.5::DOUBLE + 0.0002::DOUBLE*(user_id % 5) + 0.001::DOUBLE*(k//2 + k%2) AS a, -34.6::DOUBLE + 0.001::DOUBLE*(k//2) AS b, -58.5::DOUBLE + 0.0002::DOUBLE*(user_id % 5) + 0.001::DOUBLE*((k+1)//2 + (k+1)%2) AS c, -34.6::DOUBLE + 0.001::DOUBLE*((k+1)//2) AS d
       FROM (SELECT DISTINCT user_id % 20 AS user_id FROM events), (SELECT unnest(generate_series(0, 5)) AS k))"""


@query(with_("positions", more=SNAKE + f""", ob AS (SELECT obs_id, CAST(vehicle AS BIGINT) % 20 AS shape_id, lon, lat FROM positions),
       sl AS (SELECT *, {hav_sql('a', 'b', 'c', 'd')} AS size FROM sk), sm AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY shape_id ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_m FROM sl),
       cd AS (SELECT obs_id, edge, from_m, size, {point_edge_sql('lon', 'lat', 'a', 'b', 'c', 'd')} AS m, greatest(0, least(1, -(((a-lon)*cos(radians(lat)))*((c-a)*cos(radians(lat))) + (b-lat)*(d-b)) / (pow((c-a)*cos(radians(lat)),2) + pow(d-b,2)))) AS t FROM ob JOIN sm USING (shape_id)),
       nr AS (SELECT * FROM cd WHERE m <= 100), mn AS (SELECT *, CASE WHEN lag(edge) OVER w = edge - 1 THEN lag(m) OVER w END AS pm, CASE WHEN lead(edge) OVER w = edge + 1 THEN lead(m) OVER w END AS nm FROM nr WINDOW w AS (PARTITION BY obs_id ORDER BY edge)),
       kp AS (SELECT obs_id, round(from_m + t*size, 6) AS progress, MIN(m) AS m FROM mn WHERE (pm IS NULL OR m < pm) AND (nm IS NULL OR m <= nm) GROUP BY 1, 2)""")
       + "SELECT obs_id, CAST(COUNT(kp.m) AS INTEGER) AS candidates, round(MIN(kp.m), 2) AS nearest_m FROM ob LEFT JOIN kp USING (obs_id) GROUP BY 1")
def t14_candidates(spark, d):
    at = lambda k: F.struct((-58.5 + 0.0002 * (F.col("shape_id") % 5) + 0.001 * (F.floor(k / 2) + k % 2)).alias("lon"), (-34.6 + 0.001 * F.floor(k / 2)).alias("lat"))
    shapes = table(spark, d, "events").select((F.col("user_id") % 20).alias("shape_id")).distinct().withColumn("path", F.transform(F.sequence(F.lit(0), F.lit(6)), at))
    p = px.positions(spark, d).select("obs_id", "vehicle", "scope", (F.col("vehicle").cast("long") % 20).alias("shape_id"), "observed_at", "lon", "lat")
    rows = bottlenecks.candidates(p, shapes)
    return rows.select("obs_id", F.size("candidates").alias("candidates"), F.round(F.array_min(F.transform("candidates", lambda c: c["distance_m"])), 2).alias("nearest_m"))


@query(with_("captures") + "SELECT capture_id, partial FROM captures WHERE capture_id > (SELECT MIN(capture_id) + 9 FROM captures) ORDER BY capture_id LIMIT 32")
def y05_next_captures(spark, d):
    c = px.captures(spark, d)
    done = c.agg(F.min("capture_id")).first()[0] + 9
    return producer.next_captures(c.select("capture_id", "partial"), done, 32)


# audits


def _distances(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select(F.col("event_type").alias("route"), (k % 500).alias("obs_id"), (k % 7).alias("shape_id"), (k % 7 == 1).alias("assigned"), (F.col("value") * 12).alias("distance_m"))


DIST = "di AS (SELECT event_type AS route, event_id % 500 AS obs_id, event_id % 7 AS shape_id, event_id % 7 = 1 AS assigned, value * 12 AS m FROM events)"


@query(f"WITH {DIST}, p AS (SELECT route, obs_id, bool_or(assigned AND m <= 100) AS own, bool_or(m <= 100) AS anyone FROM di GROUP BY 1, 2) SELECT route, CAST(COUNT(*) AS BIGINT) AS positions, CAST(COUNT(*) FILTER (WHERE own) AS BIGINT) AS near_assigned, CAST(COUNT(*) FILTER (WHERE anyone) AS BIGINT) AS near_any, round(1 - COUNT(*) FILTER (WHERE own) / NULLIF(COUNT(*) FILTER (WHERE anyone), 0), 6) AS lost FROM p GROUP BY 1")
def k01_shape_proximity(spark, d):
    return audit.shape_proximity(_distances(spark, d)).withColumn("lost", F.round("lost", 6))


@query(f"WITH {DIST}, h AS (SELECT route, shape_id, CAST(COUNT(DISTINCT obs_id) AS BIGINT) AS hits FROM di WHERE m <= 100 GROUP BY 1, 2) SELECT route, shape_id, hits, CAST(row_number() OVER (PARTITION BY route ORDER BY hits DESC, shape_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 3")
def k01_ranked_shapes(spark, d):
    return audit.ranked_shapes(_distances(spark, d)).select("route", "shape_id", "hits", "rank")


@query("SELECT CASE WHEN event_type = 'view' THEN 'unmapped' WHEN event_id % 7 = 0 THEN 'no_shape' WHEN value * 12 <= 100 THEN 'near' ELSE 'far' END AS status, CAST(COUNT(*) AS BIGINT) AS positions FROM events GROUP BY 1")
def k02_position_status(spark, d):
    e = table(spark, d, "events")
    return audit.position_status(e.select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("feed_route"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 7).alias("shape_id"), (F.col("value") * 12).alias("distance_m")))


@query(f"WITH {HOURS}, g AS (SELECT received_at - lag(received_at) OVER (ORDER BY received_at, capture_id) AS gap FROM hc) SELECT quantile_cont(gap, 0.5) AS median_gap, MAX(gap) AS max_gap FROM g")
def k03_cadence(spark, d):
    return audit.cadence(px.captures(spark, d))


@query("""WITH r AS (SELECT l_suppkey, CAST(SUM(l_quantity) AS BIGINT) AS observations, CAST(SUM(l_quantity) FILTER (WHERE l_linenumber < 3) AS BIGINT) AS matched, CAST(SUM(l_quantity) FILTER (WHERE l_linenumber = 3) AS BIGINT) AS ambiguous, CAST(SUM(l_quantity) FILTER (WHERE l_linenumber > 3) AS BIGINT) AS unmatched, CAST(COUNT(*) % 13 AS BIGINT) AS passages FROM lineitem GROUP BY 1)
       SELECT CAST(SUM(observations) AS BIGINT) AS observations, CAST(SUM(matched) AS BIGINT) AS matched, CAST(SUM(ambiguous) AS BIGINT) AS ambiguous, CAST(SUM(unmatched) AS BIGINT) AS unmatched, CAST(SUM(passages) AS BIGINT) AS passages, """ + ", ".join(f"CAST(COUNT(*) FILTER (WHERE passages >= {k}) AS BIGINT) AS at_least_{k}" for k in (1, 2, 3, 5, 10)) + """,
       quantile_cont(passages, 0.1) AS p10, quantile_cont(passages, 0.5) AS p50, quantile_cont(passages, 0.9) AS p90, SUM(observations) = SUM(matched) + SUM(ambiguous) + SUM(unmatched) AS consistent FROM r""")
def k08_coverage_summary(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    runs = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(q).cast("long").alias("observations"), F.sum(F.when(n < 3, q)).cast("long").alias("matched"), F.sum(F.when(n == 3, q)).cast("long").alias("ambiguous"), F.sum(F.when(n > 3, q)).cast("long").alias("unmatched"), (F.count(F.lit(1)) % 13).alias("passages")
    )
    return audit.coverage_summary(runs)


@query(with_("captures", more=f"hx AS (SELECT capture_id, a.scope, a.vehicle AS a, b.vehicle AS b, {hav_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m FROM (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY capture_id, vehicle ORDER BY observed_at DESC, lon DESC, lat DESC) = 1) a JOIN (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY capture_id, vehicle ORDER BY observed_at DESC, lon DESC, lat DESC) = 1) b USING (capture_id) WHERE a.scope = b.scope AND a.vehicle < b.vehicle)")
       + "SELECT scope, CAST(COUNT(*) AS BIGINT) AS pairs, round(MIN(m), 2) AS nearest_m, round(quantile_cont(m, 0.5), 2) AS median_m FROM hx GROUP BY 1")
def t07_all_pairs(spark, d):
    policy = BunchingPolicy(max_age_s=7200.0, max_skew_s=0.0)
    snaps = bunching.snapshot(px.captures(spark, d), px.positions(spark, d), policy)
    return bunching.pair_summary(snaps).select("scope", "pairs", F.round("nearest", 2).alias("nearest_m"), F.round("percentile", 2).alias("median_m"))

