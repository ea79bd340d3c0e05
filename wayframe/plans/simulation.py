"""What-if estimates: travel time, revenue, whole simulations, comparisons, detour fares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agg import weighted_median
from ..functions.geo import angle_diff, bearing, haversine, path_length, samples
from ..operators import paths
from ..operators.relational import band_lookup, distance_join, prefix_sum
from ..policy import DemandPolicy, InvalidField, RevenuePolicy, TravelTimePolicy
from .demand import route_demand

JURISDICTIONS = ["national", "city", "province"]
PACES = ["off_peak", "typical", "peak"]


# validation


def route_problems(stops: DataFrame, jurisdictions: list[str] | None = None, tolerance_m: float = 20.0) -> DataFrame:
    """Broken rules of drawn routes: ``route_id, rule``.

    ``stops``: ``route_id, stop_order, stop_id, lon, lat, path_to_next`` and, if ``jurisdictions`` are
    given, ``jurisdiction``.
    """
    over = Window.partitionBy("route_id").orderBy("stop_order")
    rows = stops.withColumns({"n_lon": F.lead("lon").over(over), "n_lat": F.lead("lat").over(over), "has_next": F.lead(F.lit(True)).over(over).isNotNull()})
    path, first, last = F.col("path_to_next"), F.get(F.col("path_to_next"), F.lit(0)), F.try_element_at("path_to_next", F.lit(-1))
    start = haversine(F.col("lon"), F.col("lat"), first["lon"], first["lat"])
    end = haversine(F.col("n_lon"), F.col("n_lat"), last["lon"], last["lat"])
    back = F.greatest(haversine(F.col("n_lon"), F.col("n_lat"), first["lon"], first["lat"]), haversine(F.col("lon"), F.col("lat"), last["lon"], last["lat"]))
    off = F.greatest(start, end) > tolerance_m
    checks = {
        "stop id is blank": F.coalesce(F.trim(F.col("stop_id").cast("string")) == "", F.lit(True)),
        "position is out of range": ~F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False)),
        "path is missing": F.col("has_next") & path.isNull(),
        "path after the last stop": ~F.col("has_next") & path.isNotNull(),
        "path is reversed": F.col("has_next") & off & (back <= tolerance_m),
        "path ends away from its stops": F.col("has_next") & off & (back > tolerance_m),
        "path has no length": F.col("has_next") & (path_length(path) <= 0),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))
    per_stop = rows.select("route_id", F.explode(found).alias("rule"))
    per_route = stops.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stop_id").alias("d"))
    few = per_route.where("n < 2").select("route_id", F.lit("fewer than two stops").alias("rule"))
    again = per_route.where("d < n").select("route_id", F.lit("stop id occurs twice").alias("rule"))
    out = per_stop.unionByName(few).unionByName(again)
    if jurisdictions is not None:
        out = out.unionByName(stops.where(~F.coalesce(F.col("jurisdiction").isin(jurisdictions), F.lit(False))).select("route_id", F.lit("jurisdiction is unknown").alias("rule")))
    return out.distinct()


# travel time


def segment_references(segments: DataFrame, timed: DataFrame, policy: TravelTimePolicy = TravelTimePolicy()) -> DataFrame:
    """Timed segments of existing routes near drawn segments and in a similar direction.

    ``segments``: ``route_id, segment, path``; ``timed``: ``ref_route, ref_path, metres, off_peak_s,
    typical_s, peak_s``. Candidates meet by sampled points in grid buckets; distance and the
    overlap along the corridor are then measured exactly enough (see ``paths.overlap_m``).
    """
    reach = max(policy.radii_m)

    @F.pandas_udf("distance double, overlap double")
    def measured(a: pd.Series, b: pd.Series, radius: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, r in zip(a, b, radius):
            p, q = paths.as_array(x), paths.as_array(y)
            points, sizes = paths.densify(p, max(r / 20, 1.0))
            d = paths.distance_to_path(points, q)
            out.append((float(d.min()), float(sizes[d <= r].sum())) if len(d) else (float("inf"), 0.0))
        return pd.DataFrame(out, columns=["distance", "overlap"])

    first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
    azimuth = lambda c: bearing(first(F.col(c))["lon"], first(F.col(c))["lat"], last(F.col(c))["lon"], last(F.col(c))["lat"])
    kmh = F.col("metres") / F.col("typical_s") * 3.6
    usable = timed.where((F.col("typical_s") > 0) & kmh.between(policy.min_kmh, policy.max_kmh)).withColumn("ref_azimuth", azimuth("ref_path"))
    a = segments.withColumn("azimuth", azimuth("path")).withColumn("s", F.explode(samples(F.col("path"), reach))).select("route_id", "segment", "azimuth", F.col("s.lon").alias("lon"), F.col("s.lat").alias("lat"))
    b = usable.withColumn("ref_id", F.xxhash64("ref_route", F.to_json("ref_path"), "metres", "typical_s"))
    s = b.withColumn("s", F.explode(samples(F.col("ref_path"), reach))).select("ref_id", "ref_azimuth", F.col("s.lon").alias("r_lon"), F.col("s.lat").alias("r_lat"))
    near = distance_join(a, s, 2 * reach, where=angle_diff(F.col("azimuth"), F.col("ref_azimuth")) <= policy.max_angle)
    pairs = near.select("route_id", "segment", "ref_id").distinct().join(segments.select("route_id", "segment", "path"), ["route_id", "segment"]).join(b, "ref_id")
    rows = None
    for radius in policy.radii_m:
        part = pairs.withColumn("radius", F.lit(float(radius))).withColumn("m", measured("path", "ref_path", "radius"))
        part = part.where(F.col("m.distance") <= radius)
        rows = part if rows is None else rows.unionByName(part)
    paces = [(F.col(f"{p}_s") / F.col("metres")).alias(p) for p in PACES]
    return rows.select("route_id", "segment", path_length(F.col("path")).alias("length"), "radius", "ref_route", F.col("m.distance").alias("distance"), F.col("m.overlap").alias("overlap"), *paces)


def consolidate(references: DataFrame, policy: TravelTimePolicy = TravelTimePolicy()) -> DataFrame:
    """Paces of drawn segments by the smallest radius with enough routes.

    ``references``: ``route_id, segment, length, radius, ref_route, distance, overlap`` and paces. Per
    reference route a weighted mean pace, then weighted medians over routes.
    """
    ordered = (F.col("off_peak") > 0) & (F.col("off_peak") <= F.col("typical")) & (F.col("typical") <= F.col("peak"))
    rows = references.where(ordered & (F.col("overlap") > 0)).withColumn("w", F.least(F.lit(1.0), F.col("overlap") / F.col("length")) / (1 + F.col("distance") / F.col("radius")))
    keys = ["route_id", "segment", "radius"]
    per_route = rows.groupBy(*keys, "ref_route").agg(*[(F.sum(F.col(p) * F.col("w")) / F.sum("w")).alias(p) for p in PACES], F.least(F.sum("w"), F.lit(1.0)).alias("w"))
    routes = per_route.groupBy(*keys).agg(F.count(F.lit(1)).alias("routes"))
    last = max(policy.radii_m)
    enough = routes.where((F.col("routes") >= policy.min_routes) | (F.col("radius") == last))
    chosen = enough.groupBy("route_id", "segment").agg(F.min(F.struct("radius", "routes")).alias("c")).select("route_id", "segment", F.col("c.radius").alias("radius"), F.col("c.routes").alias("routes"))
    kept = per_route.join(chosen.drop("routes"), keys)
    out = chosen
    for p in PACES:
        out = out.join(weighted_median(kept, keys, p, "w", "ref_route"), keys)
    rank = F.when((F.col("radius") == min(policy.radii_m)) & (F.col("routes") >= policy.min_routes), "high").when(F.col("routes") >= policy.min_routes, "medium").otherwise("low")
    return out.withColumn("confidence", rank).where(ordered)


def global_paces(timed: DataFrame) -> DataFrame:
    """Fallback: median over routes of seconds per metre, one row. ``timed``: ``route_id, metres`` and seconds."""
    per_route = timed.where("metres > 0 AND typical_s > 0").groupBy("route_id").agg(*[(F.sum(f"{p}_s") / F.sum("metres")).alias(p) for p in PACES])
    return per_route.agg(*[F.percentile(p, F.lit(0.5)).alias(p) for p in PACES])


def travel_time(segments: DataFrame, paces: DataFrame, fallback: DataFrame) -> DataFrame:
    """Seconds per segment (at least 1, rounded half up) with the fallback where nothing was found (low confidence).

    ``segments``: ``route_id, segment, metres``; ``fallback`` has one row.
    """
    base = fallback.select(*[F.col(p).alias(f"g_{p}") for p in PACES])
    rows = segments.join(paces.select("route_id", "segment", *PACES, "confidence").hint("merge"), ["route_id", "segment"], "left").crossJoin(F.broadcast(base.limit(1)))
    seconds = [F.greatest(F.lit(1), F.round(F.col("metres") * F.coalesce(F.col(p), F.col(f"g_{p}")))).cast("long").alias(f"{p}_s") for p in PACES]
    return rows.select("route_id", "segment", "metres", *seconds, F.coalesce("confidence", F.lit("low")).alias("confidence"))


def route_time(segments: DataFrame) -> DataFrame:
    """Totals per route; its confidence is the worst of its segments'."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    worst = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.min(rank))
    return segments.groupBy("route_id").agg(F.sum("metres").alias("metres"), *[F.sum(f"{p}_s").alias(f"{p}_s") for p in PACES], worst.alias("confidence"))


# revenue


def pair_distances(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Stop pairs with the metres between them: the difference of prefix sums. ``segments``: ``route_id, segment, metres``."""
    run = prefix_sum(segments, ["route_id"], ["segment"], "metres", "before")
    start = run.select("route_id", F.col("segment").alias("origin_order"), F.col("before").alias("from_m"))
    end = run.select("route_id", (F.col("segment") + 1).alias("dest_order"), (F.col("before") + F.col("metres")).alias("to_m"))
    # a row per stop is no table to broadcast, however small its file
    rows = pairs.join(start.hint("merge"), ["route_id", "origin_order"]).join(end.hint("merge"), ["route_id", "dest_order"])
    return rows.withColumn("distance_m", F.col("to_m") - F.col("from_m")).drop("from_m", "to_m")


def pair_revenue(pairs: DataFrame, bands: DataFrame, jurisdiction: str, policy: RevenuePolicy = RevenuePolicy()) -> DataFrame:
    """Fare and revenue in cents of each pair by its distance band [min, max)."""
    mine = bands.where(F.col("jurisdiction") == jurisdiction).drop("jurisdiction")
    share = policy.registered_share
    fare = F.col("registered_cents") * share + F.col("unregistered_cents") * (1 - share)
    rows = band_lookup(pairs, mine, "distance_m", "min_m", "max_m")
    return rows.withColumn("fare_cents", fare).withColumn("revenue_cents", F.col("potential") * policy.capture * F.col("fare_cents")).drop("min_m", "max_m", "registered_cents", "unregistered_cents")


# whole simulations


def simulate(
    route_stops: DataFrame, cells: DataFrame, matrix: DataFrame, bands: DataFrame, jurisdiction: str, paces: DataFrame, fallback: DataFrame,
    grid=None, demand: DemandPolicy = DemandPolicy(), revenue: RevenuePolicy = RevenuePolicy(),
) -> DataFrame:
    """One row per route: demand, revenue, time and length; all routes in one plan.

    ``route_stops``: ``route_id, stop_order, stop_id, lon, lat, metres`` (to the next stop; null at the last).
    """
    if jurisdiction not in JURISDICTIONS:
        raise InvalidField("jurisdiction", f"{jurisdiction!r} is none of {JURISDICTIONS}")
    segments = route_stops.where("metres IS NOT NULL").select("route_id", F.col("stop_order").alias("segment"), "metres")
    pairs = pair_revenue(pair_distances(route_demand(route_stops, cells, matrix, grid, demand), segments), bands, jurisdiction, revenue)
    money = pairs.groupBy("route_id").agg(F.sum("gross").alias("gross"), F.sum("potential").alias("potential"), F.sum("revenue_cents").alias("revenue_cents"))
    times = route_time(travel_time(segments, paces, fallback))
    stops = route_stops.groupBy("route_id").agg(F.count(F.lit(1)).alias("stops"))
    return stops.join(times, "route_id", "left").join(money, "route_id", "left").na.fill(0.0, ["gross", "potential", "revenue_cents"])


def change(baseline: Column, proposed: Column) -> Column:
    """Absolute and relative change; the relative one is null from a baseline of 0."""
    return F.struct((proposed - baseline).alias("absolute"), F.try_divide(proposed - baseline, F.nullif(baseline, F.lit(0).cast("double"))).alias("relative"))


COMPARED = ["gross", "potential", "revenue_cents", "typical_s", "metres", "stops"]


def compare(baseline: DataFrame, proposed: DataFrame, values: list[str] = COMPARED, key: str = "route_id", same: str | None = None) -> DataFrame:
    """Changes of the values per route; ``same`` names a column that must agree (as jurisdictions must)."""
    b = baseline.select(key, *[F.col(v).cast("double").alias(f"b_{v}") for v in values], *([F.col(same).alias("b_same")] if same else []))
    p = proposed.select(key, *[F.col(v).cast("double").alias(f"p_{v}") for v in values], *([F.col(same).alias("p_same")] if same else []))
    rows = b.join(p, key)
    if same:
        rows = rows.withColumn("__ok", F.when(~F.col("b_same").eqNullSafe(F.col("p_same")), F.raise_error(F.lit(f"{same} differs"))).otherwise(True)).where("__ok")
    return rows.select(key, *[change(F.col(f"b_{v}"), F.col(f"p_{v}")).alias(v) for v in values])


# detour fares


def project_detour_stops(stops: DataFrame, baseline: DataFrame) -> DataFrame:
    """``route_id, stop_order, stop_id, at_m``: where the stops of detours lie along the baseline.

    ``stops``: ``route_id, stop_order, stop_id, lon, lat``; ``baseline``: ``route_id, stop_id, at_m, path_before``
    in order of ``at_m``, where ``path_before`` leads from the stop before. Retained stops keep their
    place and must keep their order; new ones are placed between their retained neighbours and never go back.
    """

    def run(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new, old = new.sort_values("stop_order"), old.sort_values("at_m")
        places = dict(zip(old["stop_id"], old["at_m"]))
        kept = [places[s] for s in new["stop_id"] if s in places]
        if kept != sorted(kept):
            raise ValueError(f"retained stops of route {key[0]} change their order")
        out, low = [], 0.0
        end = float(old["at_m"].max()) if len(old) else 0.0
        legs = [(a, b, paths.as_array(p)) for a, b, p in zip(old["at_m"].shift(), old["at_m"], old["path_before"]) if p is not None and len(p) > 1]
        ids = list(new["stop_id"])
        for k, (stop, lon, lat) in enumerate(zip(ids, new["lon"], new["lat"])):
            if stop in places:
                low = max(low, float(places[stop]))
            else:
                high = min([float(places[s]) for s in ids[k:] if s in places] or [end])
                best = (float("inf"), low)
                for a, b, path in legs:
                    if b > low and a < high:
                        d = float(paths.distance_to_path(np.array([[lon, lat]]), path)[0])
                        best = min(best, (d, a + (b - a) * paths.locate(path, (lon, lat))))
                low = min(max(low, best[1]), max(high, low))
            out.append(low)
        return new[["route_id", "stop_order", "stop_id"]].assign(at_m=out)

    kinds = dict(stops.dtypes)
    schema = f"route_id {kinds['route_id']}, stop_order {kinds['stop_order']}, stop_id {kinds['stop_id']}, at_m double"
    return stops.groupBy("route_id").cogroup(baseline.groupBy("route_id")).applyInPandas(run, schema)


def detour_pair_distances(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Distances of stop pairs along the baseline, which is what riders of a detour pay for."""
    o = places.select("route_id", F.col("stop_order").alias("origin_order"), F.col("at_m").alias("from_m"))
    d = places.select("route_id", F.col("stop_order").alias("dest_order"), F.col("at_m").alias("to_m"))
    return pairs.join(o, ["route_id", "origin_order"]).join(d, ["route_id", "dest_order"]).withColumn("distance_m", F.col("to_m") - F.col("from_m")).drop("from_m", "to_m")


def compare_detours(
    baseline_stops: DataFrame, detour_stops: DataFrame, cells: DataFrame, matrix: DataFrame, bands: DataFrame, jurisdiction: str, paces: DataFrame, fallback: DataFrame,
    grid=None, demand: DemandPolicy = DemandPolicy(), revenue: RevenuePolicy = RevenuePolicy(),
) -> DataFrame:
    """Changes from routes to their detours, whose riders pay for the distance along the baseline.

    ``baseline_stops`` as in ``simulate``, with ``path_before`` (the path from the stop before);
    ``detour_stops`` as in ``simulate``. Routes without a detour are left out.
    """
    before = simulate(baseline_stops.drop("path_before"), cells, matrix, bands, jurisdiction, paces, fallback, grid, demand, revenue)
    run = Window.partitionBy("route_id").orderBy("stop_order").rowsBetween(Window.unboundedPreceding, -1)
    along = baseline_stops.withColumn("at_m", F.coalesce(F.sum("metres").over(run), F.lit(0.0))).select("route_id", "stop_id", "at_m", "path_before")
    places = project_detour_stops(detour_stops.select("route_id", "stop_order", "stop_id", "lon", "lat"), along)
    pairs = detour_pair_distances(route_demand(detour_stops, cells, matrix, grid, demand), places)
    money = pair_revenue(pairs, bands, jurisdiction, revenue).groupBy("route_id").agg(F.sum("gross").alias("gross"), F.sum("potential").alias("potential"), F.sum("revenue_cents").alias("revenue_cents"))
    segments = detour_stops.where("metres IS NOT NULL").select("route_id", F.col("stop_order").alias("segment"), "metres")
    times = route_time(travel_time(segments, paces, fallback))
    stops = detour_stops.groupBy("route_id").agg(F.count(F.lit(1)).alias("stops"))
    after = stops.join(times, "route_id", "left").join(money, "route_id", "left").na.fill(0.0, ["gross", "potential", "revenue_cents"])
    return compare(before, after)


def precompute(routes: DataFrame, simulated: DataFrame, old: DataFrame | None = None, only_missing: bool = False) -> DataFrame:
    """Catalogue figures of every route, rounded half to even, with a status: done, kept, skipped or failed."""
    rows = routes.select("route_id", "simulable").join(simulated.select("route_id", "potential", "revenue_cents", "typical_s"), "route_id", "left")
    values = {c: F.bround(c).cast("long") for c in ("potential", "revenue_cents", "typical_s")}
    rows = rows.withColumn("status", F.when(~F.col("simulable"), "skipped").when(F.col("potential").isNull(), "failed").otherwise("done")).withColumns(values)
    if old is None:
        return rows.drop("simulable")
    rows = rows.join(old.select("route_id", *[F.col(c).alias(f"old_{c}") for c in values]), "route_id", "left")
    keep = F.col("old_potential").isNotNull() & (F.lit(only_missing) | (F.col("status") != "done"))
    out = {c: F.when(keep, F.col(f"old_{c}")).otherwise(F.col(c)) for c in values}
    return rows.withColumns(out).withColumn("status", F.when(keep & F.lit(only_missing), "kept").otherwise(F.col("status"))).select("route_id", *values, "status")
