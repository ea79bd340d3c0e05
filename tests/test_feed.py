"""File sources and feed loading on tiny synthetic feeds."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from wayframe.plans import feed
from wayframe.policy import InvalidField
from wayframe.schemas import FILES, TABLES, parsed
from wayframe.sources import files, sinks

PATH = "array<struct<lon:double,lat:double>>"


def test_strict_csv(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("﻿stop_id,Stop_Code,stop_name,stop_lat,stop_lon\r\n1,,Plaza,,-58.5\r\n2,x,\"A, b\",-34.5,-58.4\r\n", encoding="utf-8")
    rows = files.read_delimited(spark, str(tmp_path / "stops.txt"), "stops").orderBy("stop_id").collect()
    assert rows[0].stop_code is None and rows[0].stop_lat is None and rows[0].stop_lon == -58.5 and rows[1].stop_name == "A, b"
    (tmp_path / "bad.txt").write_text("stop_id,stop_code,stop_name,stop_lat,stop_lon\n1,a,b,notanumber,2\n")
    with pytest.raises(Exception):
        files.read_delimited(spark, str(tmp_path / "bad.txt"), "stops").collect()
    (tmp_path / "head.txt").write_text("stop_id,code,stop_name,stop_lat,stop_lon\n")
    with pytest.raises(InvalidField):
        files.read_delimited(spark, str(tmp_path / "head.txt"), "stops")
    assert all(parsed(s) for s in (*FILES.values(), *TABLES.values()))
    assert sinks.schema_problems(spark.range(1), parsed("id long, x string")) == ["x: missing"]


def test_relations(spark):
    lines = spark.createDataFrame([("r12 v1 Ttype=restriction,restriction=no_left_turn,note=a%20%b Mw1@from,n5@via,w2@to",), ("n1 v1",), ("r13 T M",)], "value string")
    rows = {r.relation_id: r for r in files.parse_relations(lines).collect()}
    assert rows[12].tags["note"] == "a b" and [(m.type, m.ref, m.role) for m in rows[12].members] == [("w", 1, "from"), ("n", 5, "via"), ("w", 2, "to")]
    assert rows[13].tags == {} and rows[13].members == []


def test_snapshots(spark):
    good = {"route_id": "r", "latitude": -34.6, "longitude": -58.4, "speed": 3.0, "timestamp": 1000, "id": "v1", "direction": 0}
    body = [good, good | {"latitude": -34.7}, good | {"id": "", "timestamp": 1001}, good | {"direction": 2}, good | {"timestamp": 2000}, good | {"id": "v2", "timestamp": 500}, good | {"latitude": None}]
    captures = spark.createDataFrame([(1, 1010, json.dumps(body)), (2, 1010, "[]"), (3, 1010, None)], "capture_id long, received_at long, body string")
    positions, counters = files.decode_snapshots(captures)
    assert sorted((r.vehicle, r.lat, r.stale) for r in positions.collect()) == [("v1", -34.6, False), ("v2", -34.6, True)]
    c = {r.capture_id: r for r in counters.collect()}
    assert (c[1].rows, c[1].rejected, c[1].accepted, c[1].stale, c[1].fresh_vehicles, c[1].repeated) == (7, 4, 2, 1, 1, 1)
    assert (c[2].rows, c[3].rows) == (0, 0)


def test_geojson_and_tiles(spark):
    doc = {"features": [
        {"geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}, "properties": {"source_id": "a", "speed_kph": "20", "closure": "false"}},
        {"geometry": {"type": "MultiLineString", "coordinates": [[[0, 1], [2, 3]], [[4, 5], [6, 7]]]}, "properties": {"source_id": "b"}},
        {"geometry": {"type": "Point", "coordinates": [0, 1]}, "properties": {}},
    ]}
    df = spark.createDataFrame([(json.dumps(doc),)], "body string")
    rows = files.traffic_segments(df).orderBy("source_id").collect()
    assert [(r.source_id, r.has_speed, r.path[0].lat) for r in rows] == [("a", True, 1.0), ("b", False, 1.0), ("b", False, 5.0)]
    assert json.loads(files.features(df).select(files.to_geojson(F.col("path")).alias("g")).first().g)["coordinates"] == [[0.0, 1.0], [2.0, 3.0]]
    tiles = files.tile_cover(spark.createDataFrame([(-1.0, -1.0, 1.0, 1.0)], "min_lon double, min_lat double, max_lon double, max_lat double"), 2).collect()
    assert [(t.x, t.y) for t in tiles] == [(1, 1), (2, 1), (1, 2), (2, 2)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2026, 1, d)) for d in (1, 5, 9)], "v long, observed_at timestamp")
    path = str(tmp_path / "p")
    sinks.write_by_day(rows, path)
    today = datetime.date(2026, 1, 10)
    assert sinks.retained(spark.read.parquet(path), today, 7).count() == 2
    assert sinks.drop_expired_days(spark, path, today, 7) == ["2026-01-01"] and spark.read.parquet(path).count() == 2
    bodies, refs = sinks.archive_bodies(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "capture_id long, body string"))
    assert bodies.count() == 2 and refs.count() == 3
    stops = spark.createDataFrame([("a", 0.0, 1.0), ("b", 2.0, 3.0)], "stop_id string, lon double, lat double")
    doc = json.loads(sinks.route_documents(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a")], "route_id long, stop_seq int, stop_id string"), stops).first().document)
    assert [s["id"] for s in doc["stops"]] == ["a#1", "b", "a#3"]
    layer = spark.createDataFrame([("{}", "p")], "geojson string, properties string")
    assert "status" in json.loads(sinks.map_snapshot({"lines": layer}, {"partial": False}).first().document)
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert (tmp_path / "j" / "_SUCCESS").exists()


def test_clock(spark):
    r = spark.range(1).select(*[feed.seconds_of(F.lit(t)).alias(f"c{k}") for k, t in enumerate(["25:10:05", "7:00:00", "x", ""])]).first()
    assert (r.c0, r.c1, r.c2, r.c3) == (90605, 25200, None, None)


def make_feed(spark):
    t = lambda name, rows: spark.createDataFrame(rows, parsed(FILES[name]))
    stops = [("A", None, "a", 0.0, 0.00), ("B", None, "b", 0.0, 0.01), ("C", None, "c", 0.0, 0.02)]
    times = []
    for trip, legs in (("t1", [0, 100, 220]), ("t2", [0, 120, 300]), ("t3", [0, 140, 260])):
        for k, (s, at) in enumerate(zip("ABC", legs)):
            clock = lambda x: f"24:{x // 60:02d}:{x % 60:02d}"
            times.append((trip, clock(at), clock(at + 10), s, k * 5 + 1, 1, None))
    times += [("t4", "01:00:00", "01:00:00", "A", 1, 1, None), ("x1", "01:00:00", "01:00:00", "A", 1, 1, None)]
    return {
        "routes": t("routes", [("r", "ag", "132A", "", "", 3), ("q", "bad", "9", "", "", 3)]),
        "trips": t("trips", [("r", "s", f"t{k}", "Centro", "", 0, None, "sh", 0) for k in range(1, 5)] + [("r", "s", "x1", "", "", 0, None, "sh", 1), ("q", "s", "q1", "", "", 0, None, "sh", 0)]),
        "stops": t("stops", stops),
        "stop_times": t("stop_times", times),
        "shapes": t("shapes", [("sh", 0.0, 0.0, 1, None), ("sh", 0.0, 0.01, 2, None), ("sh", 0.0, 0.02, 3, None)]),
    }


def test_build_feed(spark):
    out = feed.build_feed(make_feed(spark), spark.createDataFrame([("bad",)], "agency_id string"))
    routes = out["routes"].collect()
    assert len(routes) == 1 and (routes[0].line, routes[0].branch, routes[0].headsign, routes[0].length_m) == ("132", "A", "Centro", 2224)
    rs = out["route_stops"].orderBy("stop_seq").collect()
    assert [r.stop_id for r in rs] == ["A", "B", "C"] and [r.stop_seq for r in rs] == [1, 6, 11]
    assert rs[0].path_to_next[0].lon == pytest.approx(0.0) and rs[0].path_to_next[-1].lon == pytest.approx(0.01) and rs[2].path_to_next is None
    # A to B ends when the vehicle leaves B; B to C when it arrives at C
    assert rs[0].typical_s == 120 and rs[1].typical_s == 110
    assert out["problems"].count() == 0


def test_segment_filters(spark):
    def seg(*points):
        return [{"lon": float(x), "lat": float(y)} for x, y in points]

    jump, loop, edge, fine = seg((0, 0), (0.08, 0)), seg((0, 0), (0.025, 0), (0.025, 0.001), (0, 0.001)), seg((0, 0), (0.03, 0)), seg((0, 0), (0.01, 0))
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate([fine, jump, edge, fine, loop, fine, None])], f"route_id long, stop_seq int, path_to_next {PATH}")
    got = feed.drop_beside_discarded(df.withColumn("path_to_next", feed.plausible(F.col("path_to_next")))).orderBy("stop_seq").collect()
    assert [r.path_to_next is not None for r in got] == [True, False, False, True, False, True, False]
    # the last row has no segment, which does not count as discarded
    last = spark.createDataFrame([(1, 0, edge), (1, 1, None)], f"route_id long, stop_seq int, path_to_next {PATH}")
    assert feed.drop_beside_discarded(last).where("path_to_next IS NOT NULL").count() == 1


def test_integrity(spark):
    trips = spark.createDataFrame([("r", 0, "a"), ("r", 0, "b"), ("q", 2, "a"), ("q", None, "a")], "route_id string, direction_id short, shape_id string")
    assert sorted(r.problem for r in feed.integrity_problems(trips).collect()) == ["direction", "direction", "several shapes"]
