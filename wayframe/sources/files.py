"""File sources: strict delimited files, restriction relations, GPS snapshots, GeoJSON, map tiles."""

from __future__ import annotations

import math
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geo import tile_x, tile_y
from ..functions.text import unescape_percent
from ..policy import GpsPolicy, InvalidField
from ..schemas import FILES, parsed


def check_header(header: list[str], schema: StructType, name: str = "file") -> None:
    """The header must name the schema's columns in order, in any case; a byte-order mark is ignored."""
    found = [h.strip().lstrip("﻿").lower() for h in header]
    wanted = [f.name.lower() for f in schema]
    if len(found) != len(wanted):
        raise InvalidField(name, f"{len(found)} columns instead of {len(wanted)}")
    for k, (a, b) in enumerate(zip(found, wanted)):
        if a != b:
            raise InvalidField(name, f"column {k + 1} is {a!r} instead of {b!r}")


def header_problems(headers: DataFrame, schema: StructType, column: str = "header") -> DataFrame:
    """``check_header`` for a table of header lines: adds ``problem``, null where the header is right."""
    wanted = F.array(*[F.lit(f.name.lower()) for f in schema])
    found = F.transform(F.split(F.regexp_replace(F.col(column), "^\ufeff|\r$", ""), ","), lambda h: F.lower(F.trim(h)))
    wrong = F.filter(F.transform(F.arrays_zip(found.alias("a"), wanted.alias("b")), lambda x, k: F.when(x["a"] != x["b"], k + 1)), lambda k: k.isNotNull())
    count = F.concat(F.size(found).cast("string"), F.lit(f" columns instead of {len(schema)}"))
    return headers.withColumn("problem", F.when(F.size(found) != len(schema), count).when(F.size(wrong) > 0, F.concat(F.lit("column "), F.get(wrong, F.lit(0)).cast("string"))))


def read_delimited(spark: SparkSession, path: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A strict typed scan: empty fields are null; a value that can't be read fails the scan when it runs."""
    schema = schema or parsed(FILES[name])
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise InvalidField(name, "no header")
    check_header(first[0][0].rstrip("\r").split(","), schema, name)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="FAILFAST", nullValue="", emptyValue="", lineSep=None)


def load_folder(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All files of a feed by name."""
    return {n: read_delimited(spark, f"{folder}/{n}.txt", n) for n in names or [k for k in FILES if k != "survey"]}


RELATION = "relation_id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>"


def parse_relations(lines: DataFrame, column: str = "value") -> DataFrame:
    """Turn-restriction relations from lines of ``r<id> ... T<tags> M<members>``."""

    def parse(line: str):
        fields = {part[0]: part[1:] for part in line.split(" ") if part}
        ident = re.fullmatch(r"r(\d+)", line.split(" ", 1)[0])
        if not ident:
            return None
        tags = {}
        for pair in filter(None, fields.get("T", "").split(",")):
            k, _, v = pair.partition("=")
            tags[unescape_percent(k)] = unescape_percent(v)
        members = []
        for m in filter(None, fields.get("M", "").split(",")):
            found = re.fullmatch(r"([nwr])(\d+)@(.*)", m)
            if found:
                members.append({"type": found[1], "ref": int(found[2]), "role": unescape_percent(found[3])})
        return int(ident[1]), tags, members

    def run(frames):
        for frame in frames:
            rows = [r for r in map(parse, frame[column]) if r]
            yield pd.DataFrame(rows, columns=["relation_id", "tags", "members"])

    return lines.where(F.col(column).startswith("r")).select(column).mapInPandas(run, RELATION)


def parse_nodes(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id, lon, lat`` from lines of ``n<id> ... x<lon> y<lat>``; nodes without a position are left out."""
    part = lambda letter: F.regexp_extract(column, f" {letter}(-?[0-9.]+)(?: |$)", 1).try_cast("double")
    rows = lines.where(F.col(column).rlike("^n[0-9]+ ")).select(F.regexp_extract(column, "^n([0-9]+)", 1).cast("long").alias("id"), part("x").alias("lon"), part("y").alias("lat"))
    return rows.where("lon IS NOT NULL AND lat IS NOT NULL")


def parse_ways(lines: DataFrame, column: str = "value") -> DataFrame:
    """``way_id, tags, refs`` from lines of ``w<id> ... T<tags> N<nodes>``."""
    plain = lambda c: F.when(c.contains("%"), unescaped(c)).otherwise(c)
    pairs = F.filter(F.split(F.regexp_extract(column, " T([^ ]*)", 1), ","), lambda t: t.contains("="))
    tags = F.map_from_entries(F.transform(pairs, lambda t: F.struct(plain(F.regexp_extract(t, "^([^=]*)=", 1)), plain(F.regexp_extract(t, "^[^=]*=(.*)$", 1)))))
    refs = F.transform(F.filter(F.split(F.regexp_extract(column, " N([^ ]*)", 1), ","), lambda r: r.rlike("^n[0-9]+")), lambda r: F.regexp_extract(r, "^n([0-9]+)", 1).cast("long"))
    return lines.where(F.col(column).rlike("^w[0-9]+ ")).select(F.regexp_extract(column, "^w([0-9]+)", 1).cast("long").alias("way_id"), tags.alias("tags"), refs.alias("refs"))


def unescaped(text: Column) -> Column:
    """Text with ``%hex%`` escapes put back, in built-in functions."""
    parts = F.split(text, "%")
    turned = F.transform(parts, lambda x, k: F.when(k % 2 == 0, x).otherwise(F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32")))
    return F.array_join(turned, "")


SNAPSHOT = (
    "array<struct<route_id:string,latitude:double,longitude:double,speed:double,timestamp:long,id:string,direction:int,"
    "agency_name:string,agency_id:long,route_short_name:string,tip_id:string,trip_headsign:string>>"
)


def decode_snapshots(captures: DataFrame, body: str = "body", received_at: str = "received_at", policy: GpsPolicy = GpsPolicy()) -> tuple[DataFrame, DataFrame]:
    """Positions of provider snapshots and counters per capture.

    ``captures``: ``capture_id, received_at`` (epoch seconds), ``body`` (a JSON array). A bad row is
    rejected by itself; of rows with one vehicle and second, one stays; old rows are marked stale.
    """
    rows = captures.select("capture_id", F.col(received_at).cast("long").alias("received"), F.posexplode_outer(F.from_json(body, SNAPSHOT)).alias("n", "p"))
    p = F.col("p")
    fine = (
        (F.length(F.trim(p["id"])) > 0) & (F.length(F.trim(p["route_id"])) > 0) & p["direction"].isin(0, 1) & (p["timestamp"] > 0)
        & p["latitude"].between(-90, 90) & p["longitude"].between(-180, 180) & (p["speed"] >= 0) & (p["speed"] < float("inf"))
        & (p["timestamp"] <= F.col("received") + policy.max_skew_s)
    )
    marked = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    kept = marked.where("ok").select(
        "capture_id", "received", "n", p["id"].alias("vehicle"), p["timestamp"].alias("observed"), p["longitude"].alias("lon"), p["latitude"].alias("lat"),
        p["speed"].alias("speed_mps"), p["route_id"].alias("route"), p["direction"].alias("direction"), (p["timestamp"] < F.col("received") - policy.max_age_s).alias("stale"),
    )
    first = kept.groupBy("capture_id", "vehicle", "observed").agg(F.min_by(F.struct("received", "lon", "lat", "speed_mps", "route", "direction", "stale"), "n").alias("r"))
    positions = first.select("capture_id", "vehicle", "observed", "r.*")
    seen = marked.groupBy("capture_id").agg(F.count("p").alias("rows"), F.count_if(F.col("p").isNotNull() & ~F.col("ok")).alias("rejected"))
    good = positions.groupBy("capture_id").agg(F.count(F.lit(1)).alias("accepted"), F.count_if("stale").alias("stale"), F.count_distinct(F.when(~F.col("stale"), F.col("vehicle"))).alias("fresh_vehicles"))
    counters = seen.join(good, "capture_id", "left").na.fill(0)
    return positions, counters.withColumn("repeated", F.col("rows") - F.col("rejected") - F.col("accepted"))


FEATURES = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"


def features(documents: DataFrame, body: str = "body") -> DataFrame:
    """Features of GeoJSON collections with their ordinal, properties and paths (one row per line)."""
    rows = documents.select(F.posexplode(F.from_json(body, FEATURES)["features"]).alias("ordinal", "f"))
    return rows.select("ordinal", F.col("f.properties").alias("properties"), F.explode(lines_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).alias("path"))


def lines_of(kind: Column, coordinates: Column) -> Column:
    """Paths of a LineString or MultiLineString given as JSON; none for other geometries."""
    as_path = lambda line: F.transform(line, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    one = F.from_json(coordinates, "array<array<double>>")
    many = F.from_json(coordinates, "array<array<array<double>>>")
    return F.when(kind == "LineString", F.array(as_path(one))).when(kind == "MultiLineString", F.transform(many, as_path)).otherwise(F.array().cast("array<array<struct<lon:double,lat:double>>>"))


def to_geojson(path: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(path, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))


TRAFFIC = "ordinal int, source_id string, road_category string, road_coverage string, speed_kph double, has_speed boolean, closure boolean, path array<struct<lon:double,lat:double>>"


def traffic_segments(documents: DataFrame, body: str = "body") -> DataFrame:
    """Directed traffic segments from decoded features."""
    p = F.col("properties")
    return features(documents, body).select(
        "ordinal", p["source_id"].alias("source_id"), p["road_category"].alias("road_category"), p["road_coverage"].alias("road_coverage"),
        p["speed_kph"].try_cast("double").alias("speed_kph"), F.coalesce(p["speed_kph"].try_cast("double") > 0, F.lit(False)).alias("has_speed"),
        F.coalesce(p["closure"].try_cast("boolean"), F.lit(False)).alias("closure"), "path",
    )


# vector tiles


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _message(data: bytes):
    """Fields of a protocol buffer message: number, and an integer or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _numbers(packed: bytes) -> list[int]:
    out, at = [], 0
    while at < len(packed):
        value, at = _varint(packed, at)
        out.append(value)
    return out


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _tile_value(data: bytes):
    for field, value in _message(data):
        if field == 1:
            return value.decode("utf-8", "replace")
        if field in (2, 3):
            return struct.unpack("<f" if field == 2 else "<d", value)[0]
        return bool(value) if field == 7 else _signed(value) if field == 6 else value - (value >> 63 << 64)
    return None


def _tile_lines(commands: list[int]) -> list[list[tuple[int, int]]]:
    lines, x, y, at = [], 0, 0, 0
    while at < len(commands):
        order, count = commands[at] & 7, commands[at] >> 3
        at += 1
        for _ in range(count if order in (1, 2) else 0):
            x, y, at = x + _signed(commands[at]), y + _signed(commands[at + 1]), at + 2
            if order == 1:
                lines.append([])
            lines[-1].append((x, y))
    return [line for line in lines if len(line) > 1]


def decode_tile(body: bytes, z: int, x: int, y: int) -> list[tuple[str, dict, list[tuple[float, float]]]]:
    """Lines of a vector tile as ``layer, properties, [(lon, lat)]``; points and areas are passed over."""
    out, world = [], 1 << z
    for field, layer in _message(body):
        if field != 3:
            continue
        name, keys, values, features, extent = "", [], [], [], 4096
        for part, value in _message(layer):
            if part == 1:
                name = value.decode("utf-8", "replace")
            elif part == 2:
                features.append(value)
            elif part == 3:
                keys.append(value.decode("utf-8", "replace"))
            elif part == 4:
                values.append(_tile_value(value))
            elif part == 5:
                extent = value
        for feature in features:
            parts = dict(_message(feature))
            if parts.get(3) != 2:
                continue
            tags = _numbers(parts.get(2, b""))
            properties = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}
            for line in _tile_lines(_numbers(parts.get(4, b""))):
                place = lambda px, py: ((x + px / extent) / world * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + py / extent) / world)))))
                out.append((name, properties, [place(px, py) for px, py in line]))
    return out


def tile_segments(tiles: DataFrame) -> DataFrame:
    """Directed traffic segments of vector tiles (``z, x, y, body``): speeds, closures and paths, in the order of the tile.

    A source gets its id from its properties, else from its tile and place in it. A tile that can't be read fails the scan.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for tile in frame.itertuples():
                for k, (_, p, line) in enumerate(decode_tile(bytes(tile.body), int(tile.z), int(tile.x), int(tile.y))):
                    speed = p.get("traffic_level", p.get("speed_kph"))
                    speed = float(speed) if isinstance(speed, (int, float)) and not isinstance(speed, bool) else None
                    path = [{"lon": a, "lat": b} for a, b in line]
                    ident = str(p.get("source_id", f"{tile.z}/{tile.x}/{tile.y}/{k}"))
                    rows.append((k, ident, p.get("road_category"), p.get("traffic_road_coverage", p.get("road_coverage")), speed, bool(speed and speed > 0), bool(p.get("road_closure", p.get("closure", False))), path))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TRAFFIC.split(", ")])

    return tiles.select("z", "x", "y", "body").mapInPandas(run, TRAFFIC)


def unnested(df: DataFrame, columns: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Parallel arrays as rows with their ordinal from 1; shorter arrays give nulls."""
    rest = [c for c in df.columns if c not in columns]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(*[F.col(c) for c in columns])).alias("__k", "__r"))
    return rows.select(*rest, (F.col("__k") + 1).alias(ordinal), *[F.col("__r")[c].alias(c) for c in columns])


def tile_cover(boxes: DataFrame, zoom: int) -> DataFrame:
    """Map tiles that cover boxes (``min_lon, min_lat, max_lon, max_lat``), ordered by row, then column."""
    x = F.sequence(tile_x(F.col("min_lon"), zoom), tile_x(F.col("max_lon"), zoom))
    y = F.sequence(tile_y(F.col("max_lat"), zoom), tile_y(F.col("min_lat"), zoom))
    return boxes.select(F.explode(x).alias("x"), y.alias("ys")).select("x", F.explode("ys").alias("y")).distinct().select(F.lit(zoom).alias("z"), "x", "y").orderBy("y", "x")
