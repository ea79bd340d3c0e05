"""Feed loading: canonical trips, segment times, shapes, stop projection, plausible paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import between, longest_edge, path_length, path_points, substring
from ..functions.text import branch_of, line_of
from ..operators import paths
from ..policy import ShapePolicy


def seconds_of(clock: Column) -> Column:
    """Seconds since midnight of ``HH:MM:SS``, which may pass 24 hours; null if malformed."""
    part = F.split(F.trim(clock), ":")
    fine = F.trim(clock).rlike(r"^\d{1,3}:[0-5]\d:[0-5]\d$")
    return F.when(fine, part[0].try_cast("int") * 3600 + part[1].try_cast("int") * 60 + part[2].try_cast("int"))


def eligible_trips(trips: DataFrame, routes: DataFrame, excluded_agencies: DataFrame | None = None) -> DataFrame:
    """Ordinary trips of routes whose agency is not excluded."""
    kept = routes if excluded_agencies is None else routes.join(excluded_agencies.select("agency_id"), "agency_id", "left_anti")
    return trips.where(F.coalesce("exceptional", F.lit(0)) == 0).join(kept.select("route_id"), "route_id", "left_semi")


def trip_stats(stop_times: DataFrame) -> DataFrame:
    """Per trip: stops, their ordered ids, and duration (not below 0). Needs ``arrival_s, departure_s``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id"))), lambda r: r["stop_id"])
    return stop_times.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("stops"), ordered.alias("stop_ids"), F.greatest(F.max("arrival_s") - F.min("departure_s"), F.lit(0)).alias("duration_s")
    )


def canonical_trips(trips: DataFrame, stats: DataFrame) -> DataFrame:
    """Per route and direction the trip with most stops, then the longest, then by id."""
    rows = trips.join(stats, "trip_id")
    best = F.max_by(F.struct("stops", "duration_s", "stop_ids"), F.struct("stops", "duration_s")).alias("b")
    top = rows.groupBy("route_id", "direction_id").agg(best)
    same = rows.join(top, ["route_id", "direction_id"]).where((F.col("stops") == F.col("b.stops")) & (F.col("duration_s") == F.col("b.duration_s")))
    first = same.groupBy("route_id", "direction_id").agg(F.min("trip_id").alias("trip_id"))
    return first.join(stats, "trip_id")


def route_minutes(trips: DataFrame, stats: DataFrame) -> DataFrame:
    """Median trip duration per route and direction, in minutes rounded half to even."""
    rows = trips.join(stats, "trip_id").groupBy("route_id", "direction_id").agg(F.percentile("duration_s", F.lit(0.5)).alias("s"))
    return rows.select("route_id", "direction_id", F.bround(F.col("s") / 60).cast("int").alias("minutes"))


def segment_times(trips: DataFrame, stop_times: DataFrame, stats: DataFrame, canonical: DataFrame) -> DataFrame:
    """Quartiles of seconds between consecutive stops, from trips with the canonical stops.

    A segment ends when the vehicle leaves the next stop; the last one when it arrives.
    """
    same = trips.join(stats.select("trip_id", "stop_ids"), "trip_id").join(canonical.select("route_id", "direction_id", "stop_ids"), ["route_id", "direction_id", "stop_ids"])
    rows = stop_times.join(same.select("trip_id", "route_id", "direction_id"), "trip_id")
    over = Window.partitionBy("trip_id").orderBy("stop_sequence")
    rows = rows.select(
        "route_id", "direction_id", "stop_sequence", "departure_s", F.lead("departure_s").over(over).alias("next_departure"),
        F.lead("arrival_s").over(over).alias("next_arrival"), F.lead("stop_sequence", 2).over(over).alias("after_next"), F.lead("stop_sequence").over(over).alias("next"),
    )
    end = F.when(F.col("after_next").isNull(), F.col("next_arrival")).otherwise(F.col("next_departure"))
    rows = rows.where(F.col("next").isNotNull()).withColumn("s", end - F.col("departure_s")).where("s > 0")
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("route_id", "direction_id", "stop_sequence").agg(q.alias("q")).select(
        "route_id", "direction_id", "stop_sequence", F.col("q")[0].alias("off_peak_s"), F.col("q")[1].alias("typical_s"), F.col("q")[2].alias("peak_s")
    )


def shapes_to_paths(shapes: DataFrame) -> DataFrame:
    """``shape_id, path, length_m`` (whole metres, half to even)."""
    rows = shapes.groupBy("shape_id").agg(path_points(F.col("shape_pt_sequence"), F.col("shape_pt_lon"), F.col("shape_pt_lat")).alias("path"))
    return rows.withColumn("length_m", F.bround(path_length(F.col("path"))).cast("long"))


def integrity_problems(trips: DataFrame) -> DataFrame:
    """Routes and directions with several shapes, or directions other than 0 and 1."""
    many = trips.groupBy("route_id", "direction_id").agg(F.count_distinct("shape_id").alias("n")).where("n > 1")
    wrong = trips.where(~F.coalesce(F.col("direction_id").isin(0, 1), F.lit(False))).select("route_id", "direction_id").distinct()
    return many.select("route_id", "direction_id", F.lit("several shapes").alias("problem")).unionByName(wrong.withColumn("problem", F.lit("direction")))


def named_routes(routes: DataFrame, name: str = "route_short_name") -> DataFrame:
    return routes.withColumns({"line": line_of(F.col(name)), "branch": branch_of(F.col(name))})


def project_stops(route_paths: DataFrame, route_stops: DataFrame) -> DataFrame:
    """``route_id, stop_seq, stop_id, fraction`` with fractions that never go back along the route.

    Each stop is located on what the one before left of the path, so a route's stops are
    folded in order, one route per group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("stop_seq")
        path = paths.as_array(frame["path"].iloc[0])
        return frame[["route_id", "stop_seq", "stop_id"]].assign(fraction=paths.monotone_fractions(path, frame[["lon", "lat"]].to_numpy()))

    kinds = dict(route_stops.dtypes)
    rows = route_stops.select("route_id", "stop_seq", "stop_id", "lon", "lat").join(route_paths.select("route_id", "path"), "route_id")
    return rows.groupBy("route_id").applyInPandas(run, f"route_id {kinds['route_id']}, stop_seq {kinds['stop_seq']}, stop_id {kinds['stop_id']}, fraction double")


def plausible(path: Column, policy: ShapePolicy = ShapePolicy()) -> Column:
    """Null for a path with a huge straight edge, or a long one that loops."""
    ends = between(F.element_at(path, 1), F.element_at(path, -1))
    bad = (longest_edge(path) > policy.max_edge_m) | ((path_length(path) > policy.loop_m) & (path_length(path) > policy.loop_factor * ends))
    return F.when(bad, None).otherwise(path)


def drop_beside_discarded(segments: DataFrame, policy: ShapePolicy = ShapePolicy()) -> DataFrame:
    """Also nulls segments beside a discarded one that have a long edge; a route's last row has no segment."""
    over = Window.partitionBy("route_id").orderBy("stop_seq")
    last = F.lead("stop_seq").over(over).isNull()
    gone = F.col("path_to_next").isNull() & ~F.col("__last")
    rows = segments.withColumn("__last", last).withColumn("__gone", gone)
    beside = F.lag("__gone", 1, False).over(over) | F.lead("__gone", 1, False).over(over)
    bad = beside & (longest_edge(F.col("path_to_next")) > policy.adjacent_edge_m)
    return rows.withColumn("__bad", F.coalesce(bad, F.lit(False))).withColumn("path_to_next", F.when(~F.col("__bad"), F.col("path_to_next"))).drop("__last", "__gone", "__bad")


def segment_paths(projected: DataFrame, route_paths: DataFrame, policy: ShapePolicy = ShapePolicy()) -> DataFrame:
    """Each stop's path to the next, or null where it is missing or implausible."""
    over = Window.partitionBy("route_id").orderBy("stop_seq")
    rows = projected.withColumn("next_fraction", F.lead("fraction").over(over)).join(route_paths.select("route_id", "path"), "route_id")
    rows = rows.withColumn("__part", substring(F.col("path"), F.col("fraction"), F.col("next_fraction")))
    rows = rows.withColumn("path_to_next", plausible(F.col("__part"), policy)).drop("path", "__part")
    return drop_beside_discarded(rows, policy)


def build_feed(files: dict[str, DataFrame], excluded_agencies: DataFrame | None = None) -> dict[str, DataFrame]:
    """All route tables of a feed: ``routes``, ``route_stops``, ``stops``."""
    times = files["stop_times"].withColumns({"arrival_s": seconds_of(F.col("arrival_time")), "departure_s": seconds_of(F.col("departure_time"))})
    trips = eligible_trips(files["trips"], files["routes"], excluded_agencies)
    stats = trip_stats(times)
    canonical = canonical_trips(trips, stats)
    minutes = route_minutes(trips, stats)
    quartiles = segment_times(trips, times, stats, canonical)
    shapes = shapes_to_paths(files["shapes"])
    chosen = canonical.join(trips.select("trip_id", "shape_id", "trip_headsign"), "trip_id").join(shapes, "shape_id", "left").join(minutes, ["route_id", "direction_id"], "left")
    key = F.concat_ws("/", "route_id", F.col("direction_id").cast("string"))
    routes = named_routes(chosen.join(files["routes"].select("route_id", "route_short_name", "agency_id"), "route_id"))
    routes = routes.select(key.alias("route_key"), "route_id", "direction_id", "line", "branch", F.col("trip_headsign").alias("headsign"), "length_m", "minutes", "path")
    stops = files["stops"].select("stop_id", F.col("stop_name").alias("name"), F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat"))
    rows = times.join(canonical.select("trip_id", "route_id", "direction_id"), "trip_id").select(key.alias("route_id"), F.col("stop_sequence").alias("stop_seq"), "stop_id")
    shaped = routes.where("path IS NOT NULL").select(F.col("route_key").alias("route_id"), "path")
    projected = project_stops(shaped, rows.join(stops.select("stop_id", "lon", "lat"), "stop_id"))
    segments = segment_paths(projected, shaped)
    timed = quartiles.select(key.alias("route_id"), F.col("stop_sequence").alias("stop_seq"), "off_peak_s", "typical_s", "peak_s")
    return {"routes": routes, "route_stops": segments.join(timed, ["route_id", "stop_seq"], "left"), "stops": stops, "problems": integrity_problems(trips)}
