"""Slow road sectors: layouts, conservative map matching, passages, coverage, detection.

Matching and measuring are pure functions over one vehicle's ordered rows; batch plans run
them per vehicle and layout, the producer per closed open-period.
"""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, between, edges, point_edge_distance, samples, substring
from ..operators.relational import distance_join, local_minima
from ..policy import BottleneckPolicy

PASSAGE = "sector int, entered_at double, exited_at double, duration_s double, kmh double, inner_count int, max_gap_s double, same_interval boolean"
RESULT = f"kind string, reason string, {PASSAGE}"
RESULT_COLUMNS = [c.split(" ")[0] for c in RESULT.split(", ")]


# layouts


def sector_ends(length_m: float, nominal_m: float) -> list[float]:
    """Ends of sectors: whole nominal ones, the rest its own sector from half a nominal on, else merged."""
    count = int(length_m // nominal_m)
    if length_m - count * nominal_m >= nominal_m / 2:
        count += 1
    count = max(count, 1)
    return [round(k * nominal_m, 6) for k in range(1, count)] + [round(length_m, 6)]


def layout(shapes: DataFrame, policy: BottleneckPolicy = BottleneckPolicy()) -> DataFrame:
    """Sectors of shapes (``shape_id, length_m``), numbered from 0: ``shape_id, sector, start_m, end_m, count``."""
    n = F.lit(float(policy.sector_m))
    whole = F.floor(F.col("length_m") / n)
    count = F.greatest(whole + F.when(F.col("length_m") - whole * n >= n / 2, 1).otherwise(0), F.lit(1)).cast("int")
    rows = shapes.withColumn("count", count).withColumn("sector", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    end = F.when(F.col("sector") == F.col("count") - 1, F.round("length_m", 6)).otherwise((F.col("sector") + 1) * n)
    return rows.select("shape_id", "sector", (F.col("sector") * n).alias("start_m"), end.alias("end_m"), "count")


def sector_paths(sectors: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each sector's path by fractions of the length; the last ends at the path's end."""
    rows = sectors.join(shapes.select("shape_id", "path", "length_m"), "shape_id")
    end = F.when(F.col("sector") == F.col("count") - 1, 1.0).otherwise(F.col("end_m") / F.col("length_m"))
    return rows.withColumn("path", substring(F.col("path"), F.col("start_m") / F.col("length_m"), end)).drop("length_m")


# candidates


def shape_edges(shapes: DataFrame) -> DataFrame:
    """Edges of shapes with their place: ``shape_id, edge, p, q, edge_m, from_m``."""
    rows = shapes.select("shape_id", F.posexplode(edges(F.col("path"))).alias("edge", "e")).select("shape_id", "edge", F.col("e.p").alias("p"), F.col("e.q").alias("q"))
    rows = rows.withColumn("edge_m", between(F.col("p"), F.col("q")))
    over = Window.partitionBy("shape_id").orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("from_m", F.coalesce(F.sum("edge_m").over(over), F.lit(0.0)))


def project(lon: Column, lat: Column, p: Column, q: Column) -> Column:
    """Fraction of the edge nearest to a point, on a plane around the point."""
    k = F.cos(F.radians(lat)) * DEGREE_M
    px, py, qx, qy = (p["lon"] - lon) * k, (p["lat"] - lat) * DEGREE_M, (q["lon"] - lon) * k, (q["lat"] - lat) * DEGREE_M
    dx, dy = qx - px, qy - py
    size2 = dx * dx + dy * dy
    return F.when(size2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(px * dx + py * dy) / size2)))


def candidates(observations: DataFrame, shapes: DataFrame, policy: BottleneckPolicy = BottleneckPolicy()) -> DataFrame:
    """Possible places of observations on their shape: all edges near enough, thinned to local minima along it.

    ``observations``: ``obs_id, vehicle, scope, shape_id, observed_at, lon, lat``. Adds ``candidates``, an
    array of ``progress_m, distance_m`` in order of progress, empty where nothing is near.
    """
    reach = policy.max_distance_m

    parts = shape_edges(shapes)
    marks = parts.withColumn("s", F.explode(samples(F.array("p", "q"), 2 * reach))).select(F.col("shape_id").alias("e_shape"), "edge", F.col("s.lon").alias("r_lon"), F.col("s.lat").alias("r_lat"))
    near = distance_join(observations.select("obs_id", "shape_id", "lon", "lat"), marks, 2.1 * reach, on=[("shape_id", "e_shape")]).select("obs_id", "shape_id", "edge", "lon", "lat").distinct()
    rows = near.join(parts, ["shape_id", "edge"])
    rows = rows.withColumn("distance_m", point_edge_distance(F.col("lon"), F.col("lat"), F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat"))).where(F.col("distance_m") <= reach)
    rows = rows.withColumn("progress_m", F.round(F.col("from_m") + project(F.col("lon"), F.col("lat"), F.col("p"), F.col("q")) * F.col("edge_m"), 6))
    kept = local_minima(rows, ["obs_id"], "edge", "distance_m")
    one = kept.groupBy("obs_id", "progress_m").agg(F.min("distance_m").alias("distance_m"))
    listed = one.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("progress_m", "distance_m"))).alias("candidates"))
    empty = F.array().cast("array<struct<progress_m:double,distance_m:double>>")
    return observations.join(listed, "obs_id", "left").withColumn("candidates", F.coalesce("candidates", empty))


# conservative matching


def match(rows: list[dict], length_m: float, policy: BottleneckPolicy = BottleneckPolicy()) -> list[dict]:
    """Rows of vehicles in order with ``state`` (unmatched, matched, resolved, ambiguous) and ``progress``.

    ``rows``: ``vehicle, scope, t`` and ``candidates`` (progress, distance). Never takes the nearest of
    several: candidates go only when a neighbour that is certain can't be reached from them.
    """
    seen: dict[tuple, dict] = {}
    for r in rows:
        found = sorted({round(c[0], 6) for c in r["candidates"] if 0 <= round(c[0], 6) <= round(length_m, 6) and c[1] <= policy.max_distance_m})
        key = (r["vehicle"], r["t"])
        new = r | {"open": found, "single": len(found) == 1}
        if key in seen:
            if (seen[key]["scope"], seen[key]["open"]) != (new["scope"], new["open"]):
                raise ValueError(f"conflicting rows of {key}")
            seen[key]["copies"] += 1
        else:
            seen[key] = new | {"copies": 1}
    out = [seen[k] for k in sorted(seen)]

    def certain(k: int, other: int) -> dict | None:
        if not 0 <= other < len(out):
            return None
        r, o = out[k], out[other]
        ok = len(o["open"]) == 1 and o["vehicle"] == r["vehicle"] and o["scope"] == r["scope"] and 0 < abs(r["t"] - o["t"]) <= policy.max_gap_s
        return o if ok else None

    def reaches(a: float, b: float, seconds: float) -> bool:
        return b >= a and (b - a) / seconds * 3.6 <= policy.max_kmh

    changed = True
    while changed:
        changed = False
        for k, r in enumerate(out):
            if len(r["open"]) < 2:
                continue
            before, after = certain(k, k - 1), certain(k, k + 1)
            kept = [
                p for p in r["open"]
                if (before is None or reaches(before["open"][0], p, r["t"] - before["t"])) and (after is None or reaches(p, after["open"][0], after["t"] - r["t"]))
            ]
            if kept != r["open"]:
                r["open"], changed = kept, True
    for r in out:
        n = len(r["open"])
        r["state"] = "unmatched" if not n else "ambiguous" if n > 1 else "matched" if r["single"] else "resolved"
        r["progress"] = r["open"][0] if n == 1 else None
    return out


# passages


def measure(rows: list[dict], ends: list[float], policy: BottleneckPolicy = BottleneckPolicy()) -> list[tuple]:
    """Passages and incomplete passages of matched rows in order, as rows of ``RESULT``.

    ``rows``: ``vehicle, scope, t, progress`` (None if not matched).
    """
    starts, out = [0.0, *ends[:-1]], []
    last: dict | None = None
    pending: dict | None = None

    def give_up(reason: str) -> None:
        nonlocal pending
        if pending:
            out.append(("incomplete", reason, pending["sector"], pending["at"], None, None, None, pending["inner"], pending["gap"], None))
        pending = None

    def begin(sector: int, at: float, support: tuple) -> dict | None:
        return {"sector": sector, "at": at, "inner": 0, "gap": support[1] - support[0], "support": support} if sector < len(ends) else None

    def fresh(r: dict) -> None:
        nonlocal last, pending
        last, pending = r, None
        if r["p"] in starts:
            pending = begin(starts.index(r["p"]), r["t"], (r["t"], r["t"]))

    for r in rows:
        if last is not None and r["vehicle"] != last["vehicle"]:
            give_up("batch_boundary")
            last = None
        if r["progress"] is None or not 0 <= round(r["progress"], 6) <= ends[-1]:
            reason = "unresolved_match" if r["progress"] is None else "outside_progress"
            give_up(reason)
            out.append(("rejected", reason, *[None] * 8))
            last = None
            continue
        r = r | {"p": round(r["progress"], 6)}
        if last is None:
            fresh(r)
            continue
        seconds, metres = r["t"] - last["t"], r["p"] - last["p"]
        reason = (
            "scope_changed" if r["scope"] != last["scope"] else "gps_gap" if seconds > policy.max_gap_s else "backwards" if metres < 0
            else "implausible_speed" if seconds <= 0 or metres / seconds * 3.6 > policy.max_kmh else None
        )
        if reason:
            give_up(reason)
            out.append(("rejected", reason, *[None] * 8))
            fresh(r)
            continue
        for k, bound in enumerate(ends):
            if not last["p"] < bound <= r["p"]:
                continue
            exact = bound == r["p"]
            at = r["t"] if exact else last["t"] + seconds * (bound - last["p"]) / metres
            support = (r["t"], r["t"]) if exact else (last["t"], r["t"])
            if pending and pending["sector"] == k:
                duration, gap = at - pending["at"], max(pending["gap"], seconds, support[1] - support[0])
                if duration > 0:
                    kmh = (ends[k] - starts[k]) / duration * 3.6
                    out.append(("passage", None, k, pending["at"], at, duration, kmh, pending["inner"], gap, support == pending["support"]))
                    pending = None
                else:
                    give_up("degenerate_crossing")
            pending = begin(k + 1, at, support)
        if pending:
            pending["gap"] = max(pending["gap"], seconds)
            if starts[pending["sector"]] < r["p"] < ends[pending["sector"]]:
                pending["inner"] += 1
        last = r
    give_up("batch_boundary")
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=RESULT_COLUMNS)
    return out.astype({"sector": "Int32", "inner_count": "Int32", "same_interval": "boolean", **{c: "float64" for c in ("entered_at", "exited_at", "duration_s", "kmh", "max_gap_s")}})


def passages(observed: DataFrame, lengths: DataFrame, policy: BottleneckPolicy = BottleneckPolicy()) -> DataFrame:
    """Passages of all vehicles: ``vehicle, shape_id`` and ``RESULT``. A group is one vehicle on one shape.

    ``observed``: output of ``candidates``; ``lengths``: ``shape_id, length_m``.
    """
    kinds = dict(observed.dtypes)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        length = float(frame["length_m"].iloc[0])
        rows = [{"vehicle": r.vehicle, "scope": r.scope, "t": r.observed_at, "candidates": [(c["progress_m"], c["distance_m"]) for c in r.candidates]} for r in frame.itertuples()]
        out = _frame(measure(match(rows, length, policy), sector_ends(length, policy.sector_m), policy))
        out.insert(0, "vehicle", key[0]), out.insert(1, "shape_id", key[1])
        return out

    rows = observed.select("vehicle", "shape_id", "scope", "observed_at", "candidates").join(lengths.select("shape_id", "length_m"), "shape_id")
    return rows.groupBy("vehicle", "shape_id").applyInPandas(run, f"vehicle {kinds['vehicle']}, shape_id {kinds['shape_id']}, {RESULT}")


def passages_relational(progress: DataFrame, ends: DataFrame, policy: BottleneckPolicy = BottleneckPolicy()) -> DataFrame:
    """Passages of observations with known progress, in window functions only.

    ``progress``: ``vehicle, observed_at`` (seconds), ``progress_m``; ``ends``: ``sector, start_m, end_m`` of one
    layout. A run ends where an edge is a gap, goes back or is too fast; crossings are interpolated and
    a sector's entry is paired with its exit in the same run.
    """
    over = Window.partitionBy("vehicle").orderBy("observed_at")
    rows = progress.withColumns({"t0": F.lag("observed_at").over(over), "p0": F.lag("progress_m").over(over)})
    seconds, metres = F.col("observed_at") - F.col("t0"), F.col("progress_m") - F.col("p0")
    ok = F.coalesce((seconds > 0) & (seconds <= policy.max_gap_s) & (metres >= 0) & (metres / seconds * 3.6 <= policy.max_kmh), F.lit(False))
    rows = rows.withColumn("ok", ok).withColumn("run", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    cut = ends.select(F.col("start_m").alias("bound")).union(ends.select("end_m")).distinct()
    # a layout has few bounds; an edge meets those that it passes
    listed = cut.agg(F.array_sort(F.collect_list("bound")).alias("bounds"))
    moves = rows.where("ok").crossJoin(F.broadcast(listed))
    moves = moves.withColumn("bound", F.explode(F.filter("bounds", lambda b: (b > F.col("p0")) & (b <= F.col("progress_m")))))
    at = F.when(F.col("bound") == F.col("progress_m"), F.col("observed_at")).otherwise(F.col("t0") + seconds * (F.col("bound") - F.col("p0")) / metres)
    crossed = moves.select("vehicle", "run", "bound", at.alias("at"))
    first = rows.where("NOT ok").join(F.broadcast(cut), F.col("progress_m") == F.col("bound")).select("vehicle", "run", "bound", F.col("observed_at").alias("at"))
    crossings = crossed.unionByName(first)
    pair = Window.partitionBy("vehicle", "run").orderBy("at", "bound")
    pairs = crossings.withColumns({"next_bound": F.lead("bound").over(pair), "exited_at": F.lead("at").over(pair)})
    out = pairs.join(F.broadcast(ends), (F.col("bound") == F.col("start_m")) & (F.col("next_bound") == F.col("end_m")))
    duration = F.col("exited_at") - F.col("at")
    return out.where(duration > 0).select("vehicle", "sector", F.col("at").alias("entered_at"), "exited_at", duration.alias("duration_s"), ((F.col("end_m") - F.col("start_m")) / duration * 3.6).alias("kmh"))


# reports


def coverage(observations: DataFrame, measured: DataFrame, zone: str = "UTC") -> DataFrame:
    """Observations, distinct vehicles and passages per sector, and per sector, local date and hour.

    ``observations``: ``sector, vehicle, observed_at``; ``measured``: ``sector, vehicle, entered_at, kind``. Null date
    and hour mark a sector's total.
    """
    local = lambda c: F.from_utc_timestamp(F.timestamp_micros((F.col(c) * 1e6).cast("long")), zone)
    a = observations.select("sector", "vehicle", local("observed_at").alias("at"), F.lit("gps").alias("kind"))
    b = measured.where(F.col("kind").isin("passage", "incomplete")).select("sector", "vehicle", local("entered_at").alias("at"), "kind")
    rows = a.unionByName(b).withColumns({"date": F.to_date("at"), "hour": F.hour("at")})
    counts = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("gps", "observations"), ("passage", "passages"), ("incomplete", "incomplete"))]
    counts.append(F.count_distinct(F.when(F.col("kind") == "gps", F.col("vehicle"))).alias("vehicles"))
    total = rows.groupBy("sector").agg(*counts).withColumns({"date": F.lit(None).cast("date"), "hour": F.lit(None).cast("int")})
    return total.unionByName(rows.groupBy("sector", "date", "hour").agg(*counts))


def repeated_hours(covered: DataFrame, least_dates: int = 2) -> DataFrame:
    """Sectors and hours with passages on several dates."""
    return covered.where("hour IS NOT NULL AND passages > 0").groupBy("sector", "hour").agg(F.count_distinct("date").alias("dates")).where(F.col("dates") >= least_dates)


def slow_sectors(measured: DataFrame, sectors: DataFrame, from_: float, to: float, policy: BottleneckPolicy = BottleneckPolicy(), line: str | None = None, box=None) -> DataFrame:
    """Sectors with enough slow passages entered in [from, to).

    ``measured``: ``shape_id, sector, entered_at, kmh``; ``sectors``: layout rows, with ``line`` and a box's columns
    where those filters are used.
    """
    rows = measured.where((F.col("entered_at") >= from_) & (F.col("entered_at") < to))
    slow = F.col("kmh") < policy.slow_kmh
    found = rows.groupBy("shape_id", "sector").agg(F.count(F.lit(1)).alias("passages"), F.count_if(slow).alias("slow"), F.percentile("kmh", F.lit(0.5)).alias("median_kmh")).where(F.col("slow") >= policy.min_slow)
    kept = sectors
    if line is not None:
        kept = kept.where(F.col("line") == line)
    if box is not None:
        kept = kept.where((F.col("max_lon") >= box[0]) & (F.col("min_lon") <= box[2]) & (F.col("max_lat") >= box[1]) & (F.col("min_lat") <= box[3]))
    out = found.join(kept, ["shape_id", "sector"])
    return out.withColumns({"percent": F.col("slow") * 100.0 / F.col("passages"), "route_end": (F.col("sector") == 0) | (F.col("sector") == F.col("count") - 1)})


def measurement_id(*columns: Column) -> Column:
    """Identity of a measurement, independent of its outcome."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def output_problems(measured: DataFrame) -> DataFrame:
    """Passages that can't be: without duration, with a wrong speed or order."""
    bad = F.coalesce(~((F.col("duration_s") > 0) & (F.col("kmh") > 0) & (F.col("exited_at") > F.col("entered_at")) & (F.abs(F.col("exited_at") - F.col("entered_at") - F.col("duration_s")) < 1e-6)), F.lit(True))
    return measured.where((F.col("kind") == "passage") & bad)


def require_retained(oldest_needed: float | None, oldest_kept: float) -> None:
    """Fails instead of skipping when the source no longer holds what a replay needs."""
    if oldest_needed is not None and oldest_needed < oldest_kept:
        raise ValueError("positions that are still needed have expired")


