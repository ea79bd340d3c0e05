"""Travel survey to cells and an origin-destination matrix, and the potential demand of a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agg import weighted_sum
from ..functions.geo import HexGrid, haversine
from ..operators.checkpoints import checkpointed
from ..policy import DemandPolicy


def trips_to_cells(survey: DataFrame, grid=None) -> DataFrame:
    """Survey rows with ``origin`` and ``dest`` cells."""
    grid = grid or HexGrid()
    cell = lambda lon, lat: F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), grid.cell(F.col(lon), F.col(lat)))
    return survey.withColumns({"origin": cell("origin_lon", "origin_lat"), "dest": cell("dest_lon", "dest_lat")})


def hotspots(trips: DataFrame) -> DataFrame:
    """Each cell's busiest point: by weight, then count, then latitude, longitude; origins and destinations both count."""
    end = lambda cell, lon, lat: F.struct(F.col(cell).alias("cell"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    both = F.array(end("origin", "origin_lon", "origin_lat"), end("dest", "dest_lon", "dest_lat"))
    ends = trips.select(F.explode(both).alias("e"), "weight").select("e.*", "weight")  # one pass over the survey
    points = ends.where("cell IS NOT NULL").groupBy("cell", "lon", "lat").agg(F.sum(F.coalesce("weight", F.lit(0.0)).cast("double")).alias("w"), F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("lon", "lat"), F.struct((-F.col("w")).alias("w"), (-F.col("n")).alias("n"), "lat", "lon"))
    return points.groupBy("cell").agg(best.alias("p")).select("cell", "p.lon", "p.lat")


def od_matrix(trips: DataFrame) -> DataFrame:
    """Trips between cells, summed as doubles; a null weight counts nothing."""
    return trips.where("origin IS NOT NULL AND dest IS NOT NULL").groupBy("origin", "dest").agg(weighted_sum(F.col("weight").cast("double")).alias("trips"))


def transfer_od(trips: DataFrame) -> DataFrame:
    """Trips by cell pair and hour of riders who changed between buses only."""
    rows = trips.where("stages > 1 AND stages = bus_stages AND origin IS NOT NULL AND dest IS NOT NULL AND hour IS NOT NULL")
    return rows.groupBy("origin", "dest", "hour").agg(weighted_sum(F.col("weight").cast("double")).alias("trips"))


def ends_and_transfers(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hotspots`` and ``transfer_od`` from one pass over the survey, whose sums are written once."""
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda cell, dest, lon, lat, hour: F.struct(F.col(cell).alias("origin"), dest.alias("dest"), lon.alias("lon"), lat.alias("lat"), hour.alias("hour"))
    end = lambda e: row(e, none("string"), F.col(f"{e}_lon"), F.col(f"{e}_lat"), none("int"))
    changed = F.expr("stages > 1 AND stages = bus_stages AND dest IS NOT NULL AND hour IS NOT NULL")
    flow = F.when(changed, row("origin", F.col("dest"), none("double"), none("double"), F.col("hour")))
    rows = trips.select(F.explode(F.array(end("origin"), end("dest"), flow)).alias("e"), "weight").select("e.*", "weight").where("origin IS NOT NULL")
    sums = checkpointed(rows.groupBy("origin", "dest", "lon", "lat", "hour").agg(F.sum(F.coalesce("weight", F.lit(0.0)).cast("double")).alias("trips"), F.count(F.lit(1)).alias("n")))
    best = F.min_by(F.struct("lon", "lat"), F.struct((-F.col("trips")).alias("w"), (-F.col("n")).alias("n"), "lat", "lon"))
    points = sums.where("dest IS NULL").groupBy(F.col("origin").alias("cell")).agg(best.alias("p")).select("cell", "p.lon", "p.lat")
    return points, sums.where("dest IS NOT NULL").select("origin", "dest", "hour", "trips")


def cell_candidates(route_stops: DataFrame, cells: DataFrame, grid=None, policy: DemandPolicy = DemandPolicy()) -> DataFrame:
    """Cells whose point is nearer than the access radius to a stop, from the stop's cell and its neighbours.

    ``route_stops``: ``route_id, stop_order, stop_id, lon, lat``; ``cells``: ``cell, lon, lat``. Neighbourhood is
    mutual, so the cells are copied to their neighbours and not the stops, of which there are more. Catalyst's
    estimate does not see the copies and would broadcast either side by it, hence the hint.
    """
    grid = grid or HexGrid()
    near = cells.select("cell", F.col("lon").alias("cell_lon"), F.col("lat").alias("cell_lat"), F.explode(grid.disk(F.col("cell"))).alias("__at"))
    stops = route_stops.select("route_id", "stop_order", "stop_id", "lon", "lat", grid.cell(F.col("lon"), F.col("lat")).alias("__at"))
    rows = stops.hint("merge").join(near, "__at").withColumn("distance_m", haversine(F.col("lon"), F.col("lat"), F.col("cell_lon"), F.col("cell_lat")))
    return rows.where(F.col("distance_m") < policy.access_m).select("route_id", "stop_order", "stop_id", "cell", "distance_m")


def assign_cells(candidates: DataFrame, policy: DemandPolicy = DemandPolicy()) -> DataFrame:
    """Each cell to its nearest stop (ties: order, id), with the accessibility of the distance."""
    best = F.min_by(F.struct("stop_order", "stop_id", "distance_m"), F.struct("distance_m", "stop_order", "stop_id"))
    rows = candidates.groupBy("route_id", "cell").agg(best.alias("s")).select("route_id", "cell", "s.*")
    share = F.greatest(F.lit(0.0), 1 - F.col("distance_m") / policy.access_m)
    return rows.withColumn("accessibility", share * share if policy.quadratic else share)


def pair_demand(assigned: DataFrame, matrix: DataFrame, bound: int = 200_000) -> DataFrame:
    """Gross and potential trips of every ordered stop pair.

    A route's cells are paired first, within the route, and its pairs then meet the matrix. Their number
    follows the routes' lengths, while a cell of the matrix meets every route that serves its origin. A matrix
    of at most ``bound`` rows is broadcast, so that pairs stay where their route is; a larger one is shuffled.
    """
    matrix = checkpointed(matrix)
    o = assigned.select("route_id", F.col("cell").alias("origin"), F.col("stop_order").alias("origin_order"), F.col("stop_id").alias("origin_id"), F.col("accessibility").alias("a"))
    d = assigned.select("route_id", F.col("cell").alias("dest"), F.col("stop_order").alias("dest_order"), F.col("stop_id").alias("dest_id"), F.col("accessibility").alias("b"))
    trips = F.broadcast(matrix) if matrix.count() <= bound else matrix.hint("merge")
    rows = o.hint("merge").join(d, "route_id").where("origin_order < dest_order").join(trips, ["origin", "dest"])
    return rows.groupBy("route_id", "origin_order", "origin_id", "dest_order", "dest_id").agg(F.sum("trips").alias("gross"), F.sum(F.col("trips") * F.col("a") * F.col("b")).alias("potential"))


def route_demand(route_stops: DataFrame, cells: DataFrame, matrix: DataFrame, grid=None, policy: DemandPolicy = DemandPolicy()) -> DataFrame:
    return pair_demand(checkpointed(assign_cells(cell_candidates(route_stops, cells, grid, policy), policy)), matrix)


def stop_contributions(route_stops: DataFrame, pairs: DataFrame, value: str = "potential") -> DataFrame:
    """Per stop what begins and what ends there; stops without either have 0."""
    end = lambda stop, out, into: F.struct(F.col(stop).alias("stop_order"), out.alias("as_origin"), into.alias("as_dest"))
    none = F.lit(None).cast("double")
    ends = pairs.select("route_id", F.explode(F.array(end("origin_order", F.col(value).cast("double"), none), end("dest_order", none, F.col(value).cast("double")))).alias("e")).select("route_id", "e.*")
    sums = ends.groupBy("route_id", "stop_order").agg(F.sum("as_origin").alias("as_origin"), F.sum("as_dest").alias("as_dest"))  # the pairs are formed once
    rows = route_stops.select("route_id", "stop_order", "stop_id").join(sums.hint("merge"), ["route_id", "stop_order"], "left")
    return rows.na.fill(0.0, ["as_origin", "as_dest"])


def dense_order(route_stops: DataFrame, seq: str = "stop_seq") -> DataFrame:
    """``stop_order`` from 0 without gaps, from the feed's sequence."""
    return route_stops.withColumn("stop_order", F.row_number().over(Window.partitionBy("route_id").orderBy(seq)) - 1)
