"""Transit tables made from the star-schema tables, with the same integer rules as their SQL twins.

The star schema has no geography, so places, routes, trips and vehicle positions are derived from
keys. Each function has a SQL counterpart (a common table expression) of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_M, SquareGrid

#: Multipliers and moduli that scatter keys over the area.
LON, LAT = (7919, 10007, -58.9, 0.9), (104729, 10009, -34.9, 0.6)
STOPS_PER_ROUTE = 25
GRID = SquareGrid(0.05)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select([F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in df.schema])


def _scatter(key: Column, rule) -> Column:
    a, m, low, width = rule
    return F.lit(low) + ((key * a) % m) / F.lit(float(m)) * F.lit(width)


def _scatter_sql(key: str, rule) -> str:
    a, m, low, width = rule
    return f"({low}::DOUBLE + (({key})*{a} % {m}) / {m}::DOUBLE * {width}::DOUBLE)"


def stops(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("stop_id"), F.col("c_name").alias("name"), _scatter(k, LON).alias("lon"), _scatter(k, LAT).alias("lat"))


def spots(spark, d) -> DataFrame:
    k = F.col("s_suppkey") * 31 + 17
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("spot_id"), F.col("s_name").alias("spot_name"), _scatter(k, LON).alias("r_lon"), _scatter(k, LAT).alias("r_lat"))


def route_stops(spark, d) -> DataFrame:
    k = F.col("stop_id")
    return stops(spark, d).withColumns({"route_id": F.floor(k / STOPS_PER_ROUTE), "stop_seq": (k % STOPS_PER_ROUTE + 1).cast("int"), "stop_order": (k % STOPS_PER_ROUTE).cast("int")})


def routes(spark, d) -> DataFrame:
    r = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / STOPS_PER_ROUTE).alias("route_id")).distinct()
    name = F.concat((F.col("route_id") % 90 + 1).cast("string"), F.when(F.col("route_id") % 3 == 0, "").when(F.col("route_id") % 3 == 1, "A").otherwise(" Ramal B"))
    return r.withColumns({"short_name": name, "headsign": F.concat(F.lit("Terminal "), (F.col("route_id") % 7).cast("string"))})


def survey(spark, d) -> DataFrame:
    li, o, s = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "supplier")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    k = F.col("s_suppkey") * 31 + 17
    stages = 1 + F.col("l_linenumber") % 3
    return rows.select(
        _scatter(F.col("o_custkey"), LON).alias("origin_lon"), _scatter(F.col("o_custkey"), LAT).alias("origin_lat"), _scatter(k, LON).alias("dest_lon"), _scatter(k, LAT).alias("dest_lat"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 24).cast("int").alias("hour"), F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity")).alias("weight"),
        stages.cast("int").alias("stages"), F.when(F.col("l_partkey") % 5 == 0, stages - 1).otherwise(stages).cast("int").alias("bus_stages"),
    )


def positions(spark, d) -> DataFrame:
    """Vehicle samples: seconds, hourly captures, a small area so that vehicles meet."""
    e = F.col("event_id")
    at = F.unix_micros("ts") / 1e6
    return table(spark, d, "events").select(
        F.col("event_id").alias("obs_id"), F.col("user_id").cast("string").alias("vehicle"), F.col("event_type").alias("scope"), at.alias("observed_at"),
        F.floor(at / 3600).cast("long").alias("capture_id"), (F.floor(at / 3600) * 3600.0 + 3600.0).alias("received_at"), F.col("value").alias("speed_mps"),
        (F.lit(-58.5) + (e * 7919 % 1009) / F.lit(1009.0) * F.lit(0.004)).alias("lon"), (F.lit(-34.6) + (e * 104729 % 1013) / F.lit(1013.0) * F.lit(0.003)).alias("lat"),
    )


def captures(spark, d) -> DataFrame:
    rows = positions(spark, d).groupBy("capture_id", "received_at").agg(F.count_distinct("vehicle").alias("vehicles"))
    return rows.withColumns({"partial": F.col("capture_id") % 11 == 0})


CTE = {
    "stops": f"stops AS (SELECT c_custkey AS stop_id, c_name AS name, {_scatter_sql('c_custkey', LON)} AS lon, {_scatter_sql('c_custkey', LAT)} AS lat FROM customer)",
    "spots": f"spots AS (SELECT s_suppkey AS spot_id, s_name AS spot_name, {_scatter_sql('s_suppkey*31+17', LON)} AS r_lon, {_scatter_sql('s_suppkey*31+17', LAT)} AS r_lat FROM supplier)",
    "route_stops": f"route_stops AS (SELECT *, stop_id//{STOPS_PER_ROUTE} AS route_id, CAST(stop_id%{STOPS_PER_ROUTE}+1 AS INTEGER) AS stop_seq, CAST(stop_id%{STOPS_PER_ROUTE} AS INTEGER) AS stop_order FROM stops)",
    "routes": f"""routes AS (SELECT route_id, CAST(route_id%90+1 AS VARCHAR) || CASE route_id%3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE ' Ramal B' END AS short_name, 'Terminal ' || CAST(route_id%7 AS VARCHAR) AS headsign
        FROM (SELECT DISTINCT c_custkey//{STOPS_PER_ROUTE} AS route_id FROM customer))""",
    "survey": f"""survey AS (SELECT {_scatter_sql('o_custkey', LON)} AS origin_lon, {_scatter_sql('o_custkey', LAT)} AS origin_lat, {_scatter_sql('s_suppkey*31+17', LON)} AS dest_lon, {_scatter_sql('s_suppkey*31+17', LAT)} AS dest_lat,
        CAST((l_orderkey*7+l_linenumber)%24 AS INTEGER) AS hour, CASE WHEN l_orderkey%17<>0 THEN l_quantity END AS weight, CAST(1+l_linenumber%3 AS INTEGER) AS stages,
        CAST(CASE WHEN l_partkey%5=0 THEN l_linenumber%3 ELSE 1+l_linenumber%3 END AS INTEGER) AS bus_stages
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey)""",
    "trips": f"""trips AS (SELECT *, CAST(floor(origin_lon/{GRID.step}::DOUBLE) AS BIGINT) || ':' || CAST(floor(origin_lat/{GRID.step}::DOUBLE) AS BIGINT) AS origin,
        CAST(floor(dest_lon/{GRID.step}::DOUBLE) AS BIGINT) || ':' || CAST(floor(dest_lat/{GRID.step}::DOUBLE) AS BIGINT) AS dest FROM survey)""",
    "cells": """cells AS (SELECT cell, lon, lat FROM (SELECT cell, lon, lat, SUM(COALESCE(weight,0)) AS w, COUNT(*) AS n FROM
        (SELECT origin AS cell, origin_lon AS lon, origin_lat AS lat, weight FROM trips UNION ALL SELECT dest, dest_lon, dest_lat, weight FROM trips) GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY cell ORDER BY w DESC, n DESC, lat, lon) = 1)""",
    "od": "od AS (SELECT origin, dest, COALESCE(SUM(weight),0) AS trips FROM trips GROUP BY ALL)",
    "positions": """positions AS (SELECT event_id AS obs_id, CAST(user_id AS VARCHAR) AS vehicle, event_type AS scope, epoch_us(ts)/1e6 AS observed_at, CAST(floor(epoch_us(ts)/1e6/3600) AS BIGINT) AS capture_id,
        floor(epoch_us(ts)/1e6/3600)*3600.0::DOUBLE+3600.0::DOUBLE AS received_at, value AS speed_mps, -58.5::DOUBLE + (event_id*7919%1009)/1009::DOUBLE*0.004::DOUBLE AS lon, -34.6::DOUBLE + (event_id*104729%1013)/1013::DOUBLE*0.003::DOUBLE AS lat FROM events)""",
    "captures": "captures AS (SELECT capture_id, received_at, COUNT(DISTINCT vehicle) AS vehicles, capture_id%11=0 AS partial FROM positions GROUP BY ALL)",
}
NEEDS = {"route_stops": ["stops"], "trips": ["survey"], "cells": ["trips"], "od": ["trips"], "captures": ["positions"]}


def with_(*names: str, more: str = "") -> str:
    """``WITH`` clause of the tables and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([CTE[n] for n in order] + ([more] if more else [])) + "\n"


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    """Great-circle metres between (a, b) and (c, d)."""
    h = f"pow(sin(radians({d}-{b})/2),2)+cos(radians({b}))*cos(radians({d}))*pow(sin(radians({c}-{a})/2),2)"
    return f"({2 * RADIUS_M}::DOUBLE*asin(sqrt(least(1.0::DOUBLE,greatest(0.0::DOUBLE,{h})))))"
