"""Full builds, reloads and vector tiles."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from wayframe.functions.geo import SquareGrid
from wayframe.plans import build
from wayframe.policy import TransferPolicy
from wayframe.schemas import FILES, parsed
from wayframe.sources import files


def feed_files(spark, names=("1", "2")):
    rows = {
        "routes": [(f"r{n}", "a", n, None, None, 3) for n in names],
        "trips": [(f"r{n}", "s", f"t{n}", "Centro", None, 0, None, f"sh{n}", 0) for n in names],
        "stops": [(f"{n}-{k}", None, f"Stop {n} {k}", -34.6 + 0.002 * int(n), -58.4 + 0.01 * k) for n in names for k in range(4)],
        "stop_times": [(f"t{n}", f"08:0{k}:00", f"08:0{k}:00", f"{n}-{k}", k + 1, 1, None) for n in names for k in range(4)],
        "shapes": [(f"sh{n}", -34.6 + 0.002 * int(n), -58.4 + 0.01 * k, k, None) for n in names for k in range(4)],
    }
    return {n: spark.createDataFrame(r, parsed(FILES[n])) for n, r in rows.items()}


def test_build_and_reload(spark, tmp_path):
    survey = spark.createDataFrame([(-58.4, -34.6, -58.37, -34.598, 8, 2.0, 2, 2), (-58.4, -34.6, -58.37, -34.598, 9, 1.0, 1, 1)], "origin_lon double, origin_lat double, dest_lon double, dest_lat double, hour int, weight double, stages int, bus_stages int")
    nodes = spark.createDataFrame([(k, -58.4 + 0.001 * k, -34.6) for k in range(4)], "id long, lon double, lat double")
    ways = spark.createDataFrame([(1, {"highway": "primary"}, [0, 1, 2]), (2, {"highway": "primary"}, [2, 3])], "way_id long, tags map<string,string>, refs array<long>")
    relations = spark.createDataFrame([], files.RELATION)
    steps = []
    tables = build.full_build(spark, str(tmp_path), feed_files(spark), survey, nodes, ways, relations, SquareGrid(0.01), TransferPolicy(), steps.append)
    assert steps == ["feed", "survey", "streets", "derived"]
    assert all(tables.read(n) is not None for n in [*build.FEED, *build.SURVEY, *build.STREETS, *build.DERIVED])
    assert tables.read("routes").count() == 2 and tables.read("street_edges").count() == 2 and tables.read("transfer_points").count() == 2
    before = sorted(map(tuple, tables.read("od_matrix").collect()))
    again = build.reload_feed(spark, str(tmp_path), feed_files(spark, ("1", "2", "3")))
    assert again.read("routes").count() == 3 and again.read("transfer_points").count() == 4
    assert sorted(map(tuple, again.read("od_matrix").collect())) == before and again.read("street_edges").count() == 2
    broken = feed_files(spark)
    more = broken["trips"].withColumns({"trip_id": F.concat("trip_id", F.lit("x")), "shape_id": F.lit("other")})
    with pytest.raises(ValueError, match="inconsistent"):
        build.reload_feed(spark, str(tmp_path), broken | {"trips": broken["trips"].unionByName(more)})


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def tile(lines, values):
    keys = ["traffic_level", "road_category", "traffic_road_coverage", "road_closure"]
    layer = field(1, b"Traffic flow")
    for points, tags, kind in lines:
        geometry, at = b"", (0, 0)
        for k, (x, y) in enumerate(points):
            geometry += (varint(1 << 3 | 1) if k == 0 else varint(len(points) - 1 << 3 | 2) if k == 1 else b"") + varint(zigzag(x - at[0])) + varint(zigzag(y - at[1]))
            at = (x, y)
        layer += field(2, field(2, b"".join(map(varint, tags))) + field(3, kind) + field(4, geometry))
    layer += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, v) for v in values) + field(5, 4096)
    return field(3, layer)


def test_vector_tiles(spark):
    values = [varint(3 << 3 | 1) + struct.pack("<d", 36.5), field(1, b"primary"), field(1, b"full"), field(7, 1)]
    body = tile([([(0, 0), (4096, 0), (4096, 4096)], [0, 0, 1, 1, 2, 2], 2), ([(5, 5)], [0, 0], 1), ([(0, 4096), (2048, 2048)], [3, 3], 2)], values)
    df = spark.createDataFrame([(1, 1, 0, bytearray(body)), (1, 0, 0, bytearray(b""))], "z int, x int, y int, body binary")
    one, two = files.tile_segments(df).orderBy("ordinal").collect()
    assert (one.speed_kph, one.road_category, one.road_coverage, one.has_speed, one.closure) == (36.5, "primary", "full", True, False)
    assert [(p.lon, round(p.lat, 6)) for p in one.path] == [(0.0, 85.051129), (180.0, 85.051129), (180.0, 0.0)]
    assert two.closure and not two.has_speed and two.source_id == "1/1/0/1"
    assert two.path[0].lat == pytest.approx(0.0) and two.path[1].lat == pytest.approx(math.degrees(math.atan(math.sinh(math.pi / 2))))
    with pytest.raises(Exception):
        files.tile_segments(spark.createDataFrame([(1, 1, 0, bytearray(b"\x1a\xff"))], "z int, x int, y int, body binary")).collect()
