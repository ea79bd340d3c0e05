"""Walking transfers between routes, and the ranking of line-to-line combinations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_M
from ..operators.checkpoints import checkpointed
from ..operators.relational import distance_join, page
from ..policy import TransferPolicy, clamp_page


#: Stops of a block of second routes; first stops, and pairs of routes, that are held at once; candidates of a step.
BLOCK_STOPS, STOPS, ROUTE_PAIRS, CANDIDATES = 100_000, 2_000, 4_000_000, 1_000_000


def _runs(batches):
    """``block, side, rows``: the rows of each block in turn, the second routes' whole, the first routes' cut between routes."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table, whole: bool):
        names = [rows[c].combine_chunks() for c in ("block", "side", "route_id")]
        change = [np.zeros(0, bool)] if rows.num_rows < 2 else [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in names]
        block = np.any(change[:2], axis=0) if len(change) > 1 else change[0]
        ends = np.append(np.flatnonzero(np.any(change, axis=0)) + 1, rows.num_rows)
        start = 0
        for k, end in enumerate(ends):
            last = end == rows.num_rows
            if last and not whole:
                break
            first = rows["side"][start].as_py() == 1
            if last or block[end - 1] or (first and ends[k + 1] - start > STOPS):
                yield rows["block"][start].as_py(), first, rows.slice(start, end - start)
                start = end
        held[:] = rows.slice(start).to_batches()

    for batch in batches:
        held.append(batch)
        yield from cut(pa.Table.from_batches(held), False)
    if held:
        yield from cut(pa.Table.from_batches(held), True)


def _shortest_walks(batches, walk_m: float):
    """``r1, r2, from_stop, to_stop, walk_m`` of blocks of routes: stops meet in cubes as wide as the walk's chord.

    Rows with ``seq`` give ``off_seq`` and ``on_seq`` besides, those of the first route's stop and the second's.
    """
    chord = 2 * math.sin(min(walk_m / (2 * RADIUS_M), math.pi / 2))
    width = max(chord * (1 + 1e-6), 1e-6)
    side_cells = int(2 / width) + 4
    key = lambda x, y, z: (x * side_cells + y) * side_cells + z
    current, second = None, None

    def placed(rows: pa.Table):
        lon, lat = np.radians(rows["lon"].to_numpy()), np.radians(rows["lat"].to_numpy())
        point = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        return lon, lat, point, np.floor((point + 1) / width).astype(np.int64) + 1

    def coded(values) -> tuple[pa.Array, np.ndarray]:
        """Distinct values in their order, and each row's place among them."""
        names = pc.unique(values)
        names = names.take(pc.sort_indices(names))
        return names, pc.index_in(values, names).to_numpy(zero_copy_only=False).astype(np.int64)

    def numbered(rows: pa.Table, route, stop, n: int):
        """``seq`` of each (route, stop), sorted by their code; None without it."""
        if "seq" not in rows.column_names:
            return None
        codes, seq = route * n + stop, rows["seq"].to_numpy()
        order = np.argsort(codes, kind="stable")
        return codes[order], seq[order]

    for block, first, rows in _runs(batches):
        if not first:
            lon2, lat2, point2, cell2 = placed(rows)
            cells = key(*cell2)
            order = np.argsort(cells, kind="stable")
            routes2, route2 = coded(rows["route_id"].combine_chunks())
            stops2, stop2 = coded(rows["stop_id"].combine_chunks())
            current, second = block, (cells[order], lon2[order], lat2[order], point2[:, order], route2[order], stop2[order], numbered(rows, route2, stop2, len(stops2)))
            continue
        if current != block:
            continue  # no second route in this block
        cells, lon2, lat2, point2, route2, stop2, seqs2 = second
        routes_1, route_1 = coded(rows["route_id"].combine_chunks())
        at_once = max(1, ROUTE_PAIRS // len(routes2))
        for low in range(0, len(routes_1), at_once):
            mine = rows.filter(pa.array((route_1 >= low) & (route_1 < low + at_once))) if len(routes_1) > at_once else rows
            routes1, route1 = coded(mine["route_id"].combine_chunks())
            stops1, stop1 = coded(mine["stop_id"].combine_chunks())
            seqs1 = numbered(mine, route1, stop1, len(stops1))
            lon1, lat1, point1, cell1 = placed(mine)
            best, code = np.full(len(routes1) * len(routes2), np.inf), np.full(len(routes1) * len(routes2), np.iinfo(np.int64).max)
            starts, sizes = [], []
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    base = key(cell1[0] + dx, cell1[1] + dy, cell1[2])
                    a, b = np.searchsorted(cells, base - 1), np.searchsorted(cells, base + 1, side="right")
                    starts.append(a)
                    sizes.append(b - a)
            starts, sizes, who = np.concatenate(starts), np.concatenate(sizes), np.tile(np.arange(len(lon1)), 9)
            steps = np.searchsorted(np.cumsum(sizes), np.arange(CANDIDATES, sizes.sum() + CANDIDATES, CANDIDATES)) + 1
            for a, b in zip([0, *steps[:-1]], steps):
                size = sizes[a:b]
                i = np.repeat(who[a:b], size)
                j = np.repeat(starts[a:b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                square = sum((p[i] - q[j]) ** 2 for p, q in zip(point1, point2))
                near = square <= chord * chord * (1 + 1e-6) + 1e-18
                i, j = i[near], j[near]
                h = np.sin((lat2[j] - lat1[i]) / 2) ** 2 + np.cos(lat1[i]) * np.cos(lat2[j]) * np.sin((lon2[j] - lon1[i]) / 2) ** 2
                metres = 2 * RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
                pair = route1[i] * len(routes2) + route2[j]
                old = best[pair]
                keep = (metres <= walk_m) & (metres <= old)
                i, j, pair, metres, old = i[keep], j[keep], pair[keep], metres[keep], old[keep]
                np.minimum.at(best, pair, metres)
                won = metres == best[pair]
                i, j, pair, nearer = i[won], j[won], pair[won], metres[won] < old[won]
                code[pair[nearer]] = np.iinfo(np.int64).max
                np.minimum.at(code, pair, stop1[i] * len(stops2) + stop2[j])
            same = pc.index_in(routes1, routes2).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~np.isnan(same.astype(float)))
            best[own * len(routes2) + same[own].astype(np.int64)] = np.inf  # a route is no transfer to itself
            found = np.flatnonzero(np.isfinite(best))
            for k in range(0, len(found), 100_000):
                part = found[k : k + 100_000]
                r1, r2, s1, s2 = part // len(routes2), part % len(routes2), code[part] // len(stops2), code[part] % len(stops2)
                out = {
                    "r1": routes1.take(pa.array(r1)), "r2": routes2.take(pa.array(r2)), "from_stop": stops1.take(pa.array(s1)),
                    "to_stop": stops2.take(pa.array(s2)), "walk_m": pa.array(np.rint(best[part]).astype(np.int64)),
                }
                if seqs1:
                    for name, (codes, seq), of in (("off_seq", seqs1, r1 * len(stops1) + s1), ("on_seq", seqs2, r2 * len(stops2) + s2)):
                        out[name] = pa.array(seq[np.searchsorted(codes, of)])
                yield pa.RecordBatch.from_pydict(out)


def transfer_points(
    route_stops: DataFrame, stops: DataFrame, policy: TransferPolicy = TransferPolicy(), leaving: DataFrame | None = None, joining: DataFrame | None = None, seqs: bool = False
) -> DataFrame:
    """For each ordered pair of routes the shortest walk between their stops (ties: stop ids), in whole metres.

    ``leaving`` and ``joining`` (``route_id``) name the first and second routes that are asked for; all without them.
    With ``seqs`` also the last ``stop_seq`` of the first route's stop (``off_seq``) and the first of the second's (``on_seq``).
    """
    served = route_stops.select("route_id", "stop_id").distinct() if not seqs else None
    # a stop without a number can be neither left nor joined
    numbered = lambda f, none: route_stops.groupBy("route_id", "stop_id").agg(F.coalesce(f(F.col("stop_seq").cast("long")), F.lit(none)).alias("seq"))
    sides = ((numbered(F.max, -(2**62)), leaving), (numbered(F.min, 2**62), joining)) if seqs else ((served, leaving), (served, joining))
    one, two = (side if asked is None else side.join(asked, "route_id", "left_semi") for side, asked in sides)
    at = stops.where("lon IS NOT NULL AND lat IS NOT NULL").select("stop_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    one, two = (checkpointed(side.join(at.hint("merge"), "stop_id").where("route_id IS NOT NULL")) for side in (one, two))
    n, m = one.count(), two.count()
    # a group is a block of first routes with a block of second ones, so that each pair of routes is whole within its group
    lefts, rights = max(1, min(-(-n // (BLOCK_STOPS // 4)), max(8, -(-n // BLOCK_STOPS)))), max(1, -(-m // BLOCK_STOPS))
    block = lambda k: F.pmod(F.xxhash64("route_id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    columns = ["route_id", "stop_id", "lon", "lat"] + ["seq"] * seqs
    one = one.withColumn("other", every(rights)).select((block(lefts) * rights + F.col("other")).alias("block"), F.lit(1).alias("side"), *columns)
    two = two.withColumn("other", every(lefts)).select((F.col("other") * rights + block(rights)).alias("block"), F.lit(0).alias("side"), *columns)
    kinds = dict(one.dtypes)
    rows = one.union(two).repartition("block").sortWithinPartitions("block", "side", "route_id")
    schema = f"r1 {kinds['route_id']}, r2 {kinds['route_id']}, from_stop {kinds['stop_id']}, to_stop {kinds['stop_id']}, walk_m long" + ", off_seq long, on_seq long" * seqs
    walk_m = policy.walk_m
    return rows.mapInArrow(lambda batches: _shortest_walks(batches, walk_m), schema)


def cell_service(cells: DataFrame, route_stops: DataFrame, stops: DataFrame, policy: TransferPolicy = TransferPolicy()) -> DataFrame:
    """Routes that stop near a cell, with the first and last sequence numbers of those stops."""
    at = cells.select("cell", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = distance_join(stops.select("stop_id", "lon", "lat"), at, policy.access_m).select("cell", "stop_id")
    return near.join(route_stops.select("route_id", "stop_id", "stop_seq").hint("merge"), "stop_id").groupBy("cell", "route_id").agg(F.min("stop_seq").alias("min_seq"), F.max("stop_seq").alias("max_seq"))


def _ends(service: DataFrame) -> tuple[DataFrame, DataFrame]:
    o = service.select(F.col("cell").alias("origin"), F.col("route_id").alias("r1"), F.col("min_seq").alias("board_seq"))
    return o, service.select(F.col("cell").alias("dest"), F.col("route_id").alias("r2"), F.col("max_seq").alias("leave_seq"))


def indirect(pairs: DataFrame, service: DataFrame) -> DataFrame:
    """Cell pairs that no route serves directly.

    A route's cells are paired within the route, and equal pairs of many routes fall together before
    the shuffle; a pair of cells never meets all the routes at its origin.
    """
    o, d = _ends(service)
    same = o.hint("merge").join(d.withColumnRenamed("r2", "r1"), "r1").where("leave_seq > board_seq")
    return pairs.join(same.select("origin", "dest").distinct(), ["origin", "dest"], "left_anti")


#: Rows of a side that may be broadcast, so that walks stay where they are formed.
MOST_BROADCAST = 300_000


def _near(side: DataFrame) -> DataFrame:
    """``side``, written, and broadcast while its counted number is bounded."""
    side = checkpointed(side)
    return F.broadcast(side) if side.count() <= MOST_BROADCAST else side.hint("merge")


def _halves(left: DataFrame, service: DataFrame, walks: DataFrame, leaving: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs with each route at their origin, and walks with each cell that the second route still reaches."""
    o, d = _ends(service)
    o = o if leaving is None else o.join(leaving.select(F.col("route_id").alias("r1")), "r1", "left_semi")
    d = d.join(left.select("dest").distinct(), "dest", "left_semi")
    return left.join(o, "origin"), walks.select("r1", "r2", "off_seq", "on_seq").join(_near(d), "r2").where("on_seq < leave_seq").select("r1", "r2", "off_seq", "dest")


def count_itineraries(left: DataFrame, service: DataFrame, walks: DataFrame, leaving: DataFrame) -> DataFrame:
    """``origin, dest, n`` of pairs with feasible itineraries, which are counted by first route, stop and destination and never formed.

    ``leaving``: ``route_id`` of the first routes of ``walks``; pairs meet no others.
    """
    boarded, ways = _halves(left, service, walks, leaving)
    ways = ways.groupBy("r1", "dest", "off_seq").agg(F.count(F.lit(1)).alias("ways"))
    rows = boarded.hint("merge").join(ways, ["r1", "dest"]).where("off_seq > board_seq")
    return rows.groupBy("origin", "dest").agg(F.sum("ways").alias("n"))


def itineraries(left: DataFrame, service: DataFrame, walks: DataFrame) -> DataFrame:
    """Feasible one-transfer itineraries of ``left``, the cell pairs that no route serves directly (``indirect``).

    ``walks``: ``r1, r2, off_seq, on_seq``. The rider leaves the first route after boarding
    it and joins the second before leaving it.
    """
    boarded, ways = _halves(left, service, walks)
    return ways.join(_near(boarded), ["r1", "dest"]).where("off_seq > board_seq").select("origin", "dest", "r1", "r2")


def attribute(od: DataFrame, routes: DataFrame, policy: TransferPolicy = TransferPolicy()) -> DataFrame:
    """Trips of each cell pair and hour split evenly over its itineraries; pairs with too many are left out.

    One itinerary more than allowed is enough to tell a pair with too many, and the limit is
    applied before the shuffle, so such a pair never gathers all of its own.
    """
    pair = Window.partitionBy("origin", "dest")
    first = routes.withColumn("k", F.row_number().over(pair.orderBy("r1", "r2"))).where(F.col("k") <= policy.max_alternatives + 1)
    rows = first.withColumn("n", F.count(F.lit(1)).over(pair)).where(F.col("n") <= policy.max_alternatives).join(od, ["origin", "dest"])
    return rows.select("origin", "dest", "r1", "r2", "hour", "n", (F.col("trips") / F.col("n")).alias("trips"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per key, with the pair of cells of the largest flow (ties: cells)."""
    flows = rows.groupBy(*keys, "origin", "dest").agg(F.sum("trips").alias("t"), F.sum(F.col("trips") * F.col("n")).alias("tn"))
    top = F.min_by(F.struct("origin", "dest"), F.struct((-F.col("t")).alias("t"), "origin", "dest"))
    out = flows.groupBy(*keys).agg(F.sum("t").alias("trips"), F.sum("tn").alias("tn"), F.count(F.lit(1)).alias("od_pairs"), top.alias("p"))
    mean = F.greatest(F.try_divide(F.col("tn"), F.nullif(F.col("trips"), F.lit(0.0))), F.lit(1.0))
    return out.select(*keys, "trips", mean.alias("alternatives"), "od_pairs", F.col("p.origin").alias("top_origin"), F.col("p.dest").alias("top_dest"))


def rank_transfers(attributed: DataFrame) -> DataFrame:
    """Rankings per hour, and of the whole day (null hour) with the hour of the single largest flow as its peak.

    The attributed flows are written once and read by all three aggregations.
    """
    attributed = checkpointed(attributed)
    hourly = _ranked(attributed, ["r1", "r2", "hour"]).withColumn("peak_hour", F.col("hour"))
    peak = attributed.groupBy("r1", "r2").agg(F.min_by("hour", F.struct((-F.col("trips")).alias("t"), "hour")).alias("peak_hour"))
    daily = _ranked(attributed, ["r1", "r2"]).withColumn("hour", F.lit(None).cast(attributed.schema["hour"].dataType)).join(peak, ["r1", "r2"])
    return hourly.unionByName(daily)


def ranking_page(ranking: DataFrame, routes: DataFrame, cells: DataFrame, hour: int | None = None, limit: int | None = None, offset: int = 0, policy: TransferPolicy = TransferPolicy()) -> DataFrame:
    """A page of the ranking of an hour or of the whole day, with names, and a flag for weak evidence."""
    limit, offset = clamp_page(limit, offset, policy.default_limit, policy.max_limit)
    rows = ranking.where(F.col("hour").eqNullSafe(F.lit(hour)))
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.max("trips").alias("most"))
    top = page(rows, [F.desc("trips"), F.asc("r1"), F.asc("r2")], limit, offset)  # at most a page of rows
    for side in ("1", "2"):
        names = routes.select(F.col("route_id").alias(f"r{side}"), F.col("line").alias(f"line{side}"), F.col("branch").alias(f"branch{side}"))
        top = top.join(names, f"r{side}", "left")
    for side in ("origin", "dest"):
        at = cells.select(F.col("cell").alias(f"top_{side}"), F.struct("lon", "lat").alias(f"{side}_at"))
        top = top.join(at, f"top_{side}", "left")
    weak = F.col("alternatives") > policy.weak_above
    return top.crossJoin(F.broadcast(total)).withColumns({"share": F.try_divide("trips", "most"), "weak": weak}).orderBy(F.desc("trips"), "r1", "r2")


#: First routes, about so many, over which pairs with too many itineraries are told before all are tried.
PART_ROUTES = (2, 64, 512, 2048)


def build_ranking(od: DataFrame, cells: DataFrame, route_stops: DataFrame, stops: DataFrame, policy: TransferPolicy = TransferPolicy()) -> DataFrame:
    """The whole pipeline from cell pairs by hour to the ranking; what several steps read is written once.

    Walks are sought only between routes that serve an origin and a destination which no route connects. A pair
    with more itineraries than allowed over a part of its first routes has too many over all of them, so growing
    parts settle the pairs that many routes serve, by counts, before the walks of all routes are formed for the others.
    Those walks are read where they are formed, and neither written nor dealt out while few pairs are left.
    """
    od, service = checkpointed(od), checkpointed(cell_service(cells, route_stops, stops, policy))
    left = checkpointed(indirect(od.select("origin", "dest").distinct(), service))
    serving = lambda end: service.join(left.select(F.col(end).alias("cell")).distinct(), "cell", "left_semi").select("route_id").distinct()
    routes = serving("origin").count()
    for size in PART_ROUTES:
        if routes > 2 * size:
            leaving = serving("origin").where(F.pmod(F.xxhash64("route_id"), F.lit(routes // size)) == 0)
            walks = transfer_points(route_stops, stops, policy, leaving, serving("dest"), seqs=True)
            many = count_itineraries(left, service, walks, leaving).where(F.col("n") > policy.max_alternatives)
            left = checkpointed(left.join(many, ["origin", "dest"], "left_anti"))
    walks = transfer_points(route_stops, stops, policy, serving("origin"), serving("dest"), seqs=True)
    found = itineraries(left, service, walks)
    return rank_transfers(attribute(od, found, policy))


def name_cells(cells: DataFrame, stops: DataFrame, radius_m: float = 800.0) -> DataFrame:
    """Each cell with the name of its nearest stop (ties: id), at any distance."""
    from ..operators.relational import nearest

    at = stops.select("stop_id", "name", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    return nearest(cells, at, ["cell"], radius_m, ["stop_id"]).select("cell", "name", "distance_m")


