"""Schemas of files and tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def parsed(ddl: str) -> StructType:
    """A schema's type; needs a session."""
    return StructType.fromDDL(ddl)


PATH = "array<struct<lon:double,lat:double>>"
#: The same as a type, for functions declared before a session exists.
PATH_TYPE = ArrayType(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())]))

#: Text files of a feed and of a travel survey, by name.
FILES: dict[str, str] = {
    "agency": "agency_id string, agency_name string, agency_url string, agency_timezone string, agency_lang string, agency_phone string",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_desc string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, trip_short_name string, direction_id short, block_id string, shape_id string, exceptional short",
    "stops": "stop_id string, stop_code string, stop_name string, stop_lat double, stop_lon double",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, timepoint short, shape_dist_traveled double",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int, shape_dist_traveled double",
    "calendar_dates": "service_id string, date string, exception_type short",
    "survey": ("card_id long, trip_id short, stages short, hour short, subway_stages short, train_stages short, bus_stages short, "
        "origin_lon double, origin_lat double, dest_lon double, dest_lat double, origin_dept string, dest_dept string, "
        "weight float, incomplete string, gender string, age_group short"),
}

#: Tables of the library, by name.
TABLES: dict[str, str] = {
    "cells": "cell string, lon double, lat double",
    "od_matrix": "origin string, dest string, trips double",
    "tariff_bands": "jurisdiction string, min_m int, max_m int, registered_cents int, unregistered_cents int",
    "routes": f"route_id long, feed_route string, direction short, line string, branch string, headsign string, jurisdiction string, length_m double, minutes int, path {PATH}",
    "stops": "stop_id string, name string, lon double, lat double",
    "route_stops": f"route_id long, stop_seq int, stop_id string, path_to_next {PATH}, off_peak_s double, typical_s double, peak_s double, metres double",
    "street_vertices": "id long, lon double, lat double",
    "street_edges": f"edge_id long, way_id long, name string, kind string, source long, target long, cost double, reverse_cost double, path {PATH}",
    "turn_restrictions": "from_edge long, to_edge long, via long",
    "captures": "capture_id long, received_at timestamp, partial boolean, vehicles long",
    "positions": "capture_id long, vehicle string, observed_at timestamp, lon double, lat double, speed_mps double, route string, direction short, observed_day date",
    "bunching_events": ("scope string, a string, b string, first_at double, last_at double, confirmed_at double, closed_at double, reason string, "
        "observations int, missing int, min_distance double, max_speed_a double, max_speed_b double"),
    "passages": "vehicle string, sector int, entered_at double, exited_at double, duration_s double, kmh double, inner_count int, max_gap_s double, same_interval boolean",
    "transfer_ranking": "r1 long, r2 long, hour int, trips double, alternatives double, od_pairs long, top_origin string, top_dest string, peak_hour int",
}
