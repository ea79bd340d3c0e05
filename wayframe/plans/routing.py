"""Routing on a local street graph: priced costs, snapping, turn-restricted paths, detour plans.

DataFrames cut the search area out of the network, price its edges and snap points; one request's
local graph, bounded by its search area, is then solved in one grouped Python function.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, angle_diff, bearing, interpolate, locate, path_distance, plane_distance, point_path_distance, samples
from ..operators import paths
from ..operators.checkpoints import checkpointed
from ..operators.relational import distance_join, top_n
from ..policy import DetourPolicy, InvalidField

#: Requests that may be broadcast, and the side of a bucket where more meet the edges.
MOST_BROADCAST_REQUESTS, BUCKET_DEGREES = 10_000, 0.02
STATES = ["reached", "no_path", "no_coverage", "unmatched"]


# search area and prices


def check_cut(cut: np.ndarray, policy: DetourPolicy = DetourPolicy()) -> None:
    """A cut has 2 to 10 000 finite positions and a positive length of at most 20 km."""
    if len(cut) < 2:
        raise InvalidField("cut", "needs two positions")
    if len(cut) > policy.max_cut_positions:
        raise InvalidField("cut", "has too many positions")
    if not np.isfinite(cut).all() or (np.abs(cut[:, 0]) > 180).any() or (np.abs(cut[:, 1]) > 90).any():
        raise InvalidField("cut", "has a position out of range")
    if not 0 < paths.length_m(cut) <= policy.max_cut_m:
        raise InvalidField("cut", "has no length or is too long")


def local_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Edges that touch each request's box: ``request_id`` with the edge's columns.

    ``requests``: ``request_id, min_lon, min_lat, max_lon, max_lat``. While their counted number is
    bounded they are sent to the edges' partitions; more of them meet the edges in grid buckets.
    """
    lons, lats = F.transform("path", lambda p: p["lon"]), F.transform("path", lambda p: p["lat"])
    boxed = edges.withColumns({"e_min_lon": F.array_min(lons), "e_max_lon": F.array_max(lons), "e_min_lat": F.array_min(lats), "e_max_lat": F.array_max(lats)})
    asked = requests.select("request_id", "min_lon", "min_lat", "max_lon", "max_lat")
    meet = (F.col("e_max_lon") >= F.col("min_lon")) & (F.col("e_min_lon") <= F.col("max_lon")) & (F.col("e_max_lat") >= F.col("min_lat")) & (F.col("e_min_lat") <= F.col("max_lat"))
    if asked.count() <= MOST_BROADCAST_REQUESTS:
        found = boxed.join(F.broadcast(asked), meet)
    else:  # both sides meet in grid buckets; a pair counts in the first bucket that it shares
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / BUCKET_DEGREES), F.floor(F.col(hi) / BUCKET_DEGREES))
        bucketed = lambda df, p: df.withColumn("__x", F.explode(span(f"{p}min_lon", f"{p}max_lon"))).withColumn("__y", F.explode(span(f"{p}min_lat", f"{p}max_lat")))
        found = bucketed(boxed, "e_").join(bucketed(asked, ""), ["__x", "__y"]).where(meet)
        corner = lambda a, b: F.floor(F.greatest(a, b) / BUCKET_DEGREES)
        found = found.where((F.col("__x") == corner("e_min_lon", "min_lon")) & (F.col("__y") == corner("e_min_lat", "min_lat"))).drop("__x", "__y")
    return found.drop("min_lon", "min_lat", "max_lon", "max_lat", "e_min_lon", "e_max_lon", "e_min_lat", "e_max_lat")


def default_speed(traffic: DataFrame, policy: DetourPolicy = DetourPolicy()) -> DataFrame:
    """Median usable speed of the snapshot, else the constant; one row."""
    usable = F.when(F.col("has_speed") & ~F.col("closure"), F.col("speed_kph"))
    return traffic.agg(F.coalesce(F.percentile(usable, F.lit(0.5)), F.lit(policy.default_kmh)).alias("default_kmh"))


# fixed values: the traffic category that serves each street class
CATEGORIES = {
    "motorway": ["motorway", "motorway_link"], "trunk": ["trunk", "trunk_link"], "primary": ["primary", "primary_link"], "secondary": ["secondary", "secondary_link"],
    "tertiary": ["tertiary", "tertiary_link"], "street": ["residential", "living_street", "unclassified"],
}


def category_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for category, kinds in CATEGORIES.items():
        out = F.when(kind.isin(kinds), category).otherwise(out)
    return out


def priced_edges(edges: DataFrame, traffic: DataFrame, policy: DetourPolicy = DetourPolicy()) -> DataFrame:
    """``edges`` with seconds forward and backward, and where the speeds came from.

    The nearest traffic segment within ``match_m`` that runs along the edge's line serves the way
    forward if it covers the full road, or one side in the edge's direction; the way back if it
    covers the full road or the other side. A match without a usable speed, a closure included, is
    no source; then the median of the nearest segments (one for each source) of the compatible
    category counts, given enough of them, else the snapshot's median or the default. A blocked edge costs -1.
    ``edges``: ``edge_id, kind, cost, reverse_cost, path`` and, if there, ``blocked``;
    ``traffic``: ``source_id, road_category, road_coverage, speed_kph, has_speed, closure, path``
    and, if there, ``ordinal``, which parts equally near segments.
    """
    first, last = (lambda c: F.element_at(F.col(c), 1)), (lambda c: F.element_at(F.col(c), -1))
    azimuth = lambda c: bearing(first(c)["lon"], first(c)["lat"], last(c)["lon"], last(c)["lat"])
    tie = F.col("ordinal").cast("long") if "ordinal" in traffic.columns else F.xxhash64("source_id", F.to_json("path"))
    t = traffic.select(
        tie.alias("t_id"), "source_id", "road_category", "road_coverage", F.col("path").alias("t_path"), azimuth("path").alias("t_azimuth"),
        F.when(F.col("has_speed") & ~F.col("closure") & (F.col("speed_kph") > 0), F.col("speed_kph")).alias("kmh"),
    )
    e = edges.select("edge_id", "kind", (F.col("reverse_cost") > 0).alias("both_ways"), "path", azimuth("path").alias("azimuth"))
    # lines meet by samples, as no part of a line is farther than half a step from one
    reach = policy.estimate_m
    a = e.select("edge_id", F.explode(samples(F.col("path"), reach)).alias("s")).select("edge_id", "s.lon", "s.lat")
    b = t.select("t_id", F.explode(samples(F.col("t_path"), reach)).alias("s")).select("t_id", F.col("s.lon").alias("r_lon"), F.col("s.lat").alias("r_lat"))
    pairs = distance_join(a, b, 2 * reach).select("edge_id", "t_id").distinct()
    near = pairs.join(e.hint("merge"), "edge_id").join(t.hint("merge"), "t_id").withColumn("line_m", path_distance(F.col("path"), F.col("t_path"))).where(F.col("line_m") <= reach)
    near = checkpointed(near.drop("path", "t_path"))  # lines are measured once for both uses
    angle = angle_diff(F.col("azimuth"), F.col("t_azimuth"))
    along = (F.col("line_m") <= policy.match_m) & (F.least(angle, 180 - angle) <= policy.match_angle)
    full, one = F.col("road_coverage") == "full", F.col("road_coverage") == "one_side"
    ahead = along & (full | (one & (angle <= 90)))
    back = along & F.col("both_ways") & (full | (one & (angle > 90)))
    order, speed = F.struct("line_m", "t_id"), F.struct("kmh")
    direct = near.groupBy("edge_id").agg(F.min_by(F.when(ahead, speed), F.when(ahead, order))["kmh"].alias("forward_kmh"), F.min_by(F.when(back, speed), F.when(back, order))["kmh"].alias("backward_kmh"))
    same = near.where((F.col("road_category") == category_of(F.col("kind"))) & F.col("kmh").isNotNull())
    sources = same.groupBy("edge_id", "source_id").agg(F.min(F.struct("line_m", "kmh")).alias("n")).select("edge_id", "source_id", "n.line_m", "n.kmh")
    closest = top_n(sources, ["edge_id"], [F.asc("line_m"), F.asc("source_id")], policy.max_samples)
    median = closest.groupBy("edge_id").agg(F.percentile("kmh", F.lit(0.5)).alias("near_kmh"), F.count(F.lit(1)).alias("samples")).where(F.col("samples") >= policy.min_samples)
    out = edges.join(direct, "edge_id", "left").join(median.drop("samples"), "edge_id", "left").crossJoin(F.broadcast(default_speed(traffic, policy)))
    shut = F.coalesce(F.col("blocked"), F.lit(False)) if "blocked" in edges.columns else F.lit(False)

    def side(own: str, closed: Column):
        kmh = F.coalesce(own, "near_kmh", "default_kmh")
        source = F.when(F.col(own).isNotNull(), "traffic").when(F.col("near_kmh").isNotNull(), "nearby").otherwise("default")
        return F.when(closed, -1.0).otherwise(F.col("cost") / (kmh / 3.6)), source

    seconds, source = side("forward_kmh", shut)
    reverse, reverse_source = side("backward_kmh", shut | (F.col("reverse_cost") <= 0))
    out = out.withColumns({
        "seconds": seconds, "reverse_seconds": reverse, "source_of_speed": F.when(shut, "blocked").otherwise(source),
        "reverse_source": F.when(shut | (F.col("reverse_cost") <= 0), "not_allowed").otherwise(reverse_source),
    })
    return out.drop("forward_kmh", "backward_kmh", "near_kmh", "default_kmh")


def trace(priced: DataFrame) -> DataFrame:
    """Counts of edges by source of speed, and of blocked ones."""
    return priced.groupBy("source_of_speed").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("seconds") < 0).alias("blocked"), F.count_if(F.col("reverse_seconds") < 0).alias("one_way"))


def snap(points: DataFrame, edges: DataFrame, policy: DetourPolicy = DetourPolicy(), max_angle: float = 45.0) -> DataFrame:
    """Points on their nearest edge in a fitting direction; unmatched if that edge is blocked or none is near.

    ``points``: ``point_id, lon, lat, heading`` (null: any); ``edges``: ``edge_id, path, reverse_cost, blocked``.
    """

    marks = edges.withColumn("s", F.explode(samples(F.col("path"), policy.snap_m))).select("edge_id", F.col("s.lon").alias("m_lon"), F.col("s.lat").alias("m_lat"))
    # the side that is copied to the buckets around it is the one with a row per point
    near = distance_join(marks, points.select("point_id", "lon", "lat", "heading"), 2 * policy.snap_m, ("m_lon", "m_lat"), ("lon", "lat")).select("point_id", "lon", "lat", "heading", "edge_id").distinct()
    rows = near.join(edges.select("edge_id", "path", "reverse_cost", "blocked").hint("merge"), "edge_id")
    rows = rows.withColumn("distance", plane_distance(F.col("lon"), F.col("lat"), F.col("path"))).where(F.col("distance") <= policy.snap_m).withColumn("fraction", locate(F.col("lon"), F.col("lat"), F.col("path")))
    before, after = (interpolate(F.col("path"), F.col("fraction") + d) for d in (-0.01, 0.01))
    rows = rows.withColumns({"__a": before, "__b": after}).withColumn("o", F.struct("distance", "fraction", bearing(F.col("__a.lon"), F.col("__a.lat"), F.col("__b.lon"), F.col("__b.lat")).alias("heading")))
    off = angle_diff(F.col("heading"), F.col("o.heading"))
    off = F.when(F.col("reverse_cost") >= 0, F.least(off, 180 - off)).otherwise(off)
    rows = rows.where(F.col("heading").isNull() | (off <= max_angle))
    best = top_n(rows, ["point_id"], [F.asc("o.distance"), F.asc("edge_id")]).select("point_id", "edge_id", F.col("o.fraction").alias("fraction"), F.col("o.distance").alias("snap_m"), "blocked")
    out = points.select("point_id").join(best, "point_id", "left")
    matched = F.col("edge_id").isNotNull() & ~F.coalesce("blocked", F.lit(False))
    return out.select("point_id", F.when(matched, F.col("edge_id")).alias("edge_id"), F.when(matched, F.col("fraction")).alias("fraction"), F.when(matched, F.col("snap_m")).alias("snap_m"), matched.alias("matched"))


# the solver


@dataclass
class Graph:
    """Directed edges with costs by edge and sign; forbidden turns between edges at a vertex."""

    source: dict[int, int] = field(default_factory=dict)
    target: dict[int, int] = field(default_factory=dict)
    cost: dict[tuple[int, int], float] = field(default_factory=dict)  # (edge, +1 or -1)
    leaving: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    forbidden: set[tuple[int, int, int]] = field(default_factory=set)
    paths: dict[int, np.ndarray] = field(default_factory=dict)
    kinds: dict[int, str] = field(default_factory=dict)

    def add(self, edge: int, source: int, target: int, cost: float, reverse: float, path: np.ndarray | None = None, kind: str = "") -> None:
        self.source[edge], self.target[edge] = source, target
        for sign, value, at in ((1, cost, source), (-1, reverse, target)):
            if value is not None and value >= 0 and math.isfinite(value):
                self.cost[edge, sign] = float(value)
                self.leaving.setdefault(at, []).append((edge, sign))
        if path is not None:
            self.paths[edge] = path
        self.kinds[edge] = kind

    def head(self, edge: int, sign: int) -> int:
        return self.target[edge] if sign > 0 else self.source[edge]

    def piece(self, edge: int, start: float, end: float) -> np.ndarray | None:
        return paths.substring(self.paths[edge], start, end) if edge in self.paths else None

    def reversal(self, a: tuple[int, int], b: tuple[int, int], policy: DetourPolicy) -> bool:
        """Turning back on an edge, or onto the other half of a divided road; links and roundabouts may."""
        if a[0] == b[0]:
            return a[1] != b[1]
        if a[0] not in self.paths or b[0] not in self.paths or any("link" in self.kinds[e[0]] or "roundabout" in self.kinds[e[0]] for e in (a, b)):
            return False
        p, q = (self.paths[e][:: 1 if s > 0 else -1] for e, s in (a, b))
        return paths.turn(paths.bearing(p[-2], p[-1]), paths.bearing(q[0], q[1])) >= policy.reversal_angle

    def bearing_at(self, edge: int, sign: int, fraction: float) -> float | None:
        """Direction of travel at a place; None without a path."""
        if edge not in self.paths:
            return None
        line = self.paths[edge]
        a, b = paths.interpolate(line, max(0.0, fraction - 0.01)), paths.interpolate(line, min(1.0, fraction + 0.01))
        return paths.bearing(a, b) if sign > 0 else paths.bearing(b, a)

    def turns_across(self, edges: list[tuple[int, int]], parts: list[np.ndarray], policy: DetourPolicy) -> bool:
        """Does a way turn back over a short connector, as across the divide of an avenue?

        It does when it leaves a piece against the direction in which it came to an earlier one, with at
        most ``crossing_m`` between them; links and roundabouts may. Pieces under 5 m have no direction.
        """
        sizes = [paths.length_m(p) for p in parts]
        free = ["link" in self.kinds[e] or "roundabout" in self.kinds[e] for e, _ in edges]

        def near_end(line: np.ndarray, size: float, end: bool) -> float:
            share = min(1.0, 15.0 / size)
            return paths.bearing(paths.interpolate(line, 1 - share), line[-1]) if end else paths.bearing(line[0], paths.interpolate(line, share))

        for i, size in enumerate(sizes):
            if size < 5 or free[i]:
                continue
            arrives, between = near_end(parts[i], size, True), 0.0
            for j in range(i + 1, min(i + 7, len(parts))):
                if between > policy.crossing_m or (j > i + 1 and free[j - 1]):
                    break
                if sizes[j] >= 5 and not free[j] and paths.turn(arrives, near_end(parts[j], sizes[j], False)) >= policy.reversal_angle:
                    return True
                between += sizes[j]
        return False

    def route(
        self, start: tuple[int, float], end: tuple[int, float], policy: DetourPolicy = DetourPolicy(), directed: bool = True,
        leave: float | None = None, arrive: float | None = None,
    ) -> dict | None:
        """Cheapest way between two places (edge, fraction): ``cost, edges`` [(edge, sign)], ``path``.

        States are directed edges, so turns can be refused; ties go to the smaller edges. ``leave`` and
        ``arrive`` are directions that the ends must agree with. A way that turns back across a divided
        road is none. Every pair of places is solved by itself, so no other place is a node to turn at.
        """
        found = self._cheapest(start, end, policy, directed, leave, arrive)
        if found and directed and found["parts"] is not None and self.turns_across(found["edges"], found["parts"], policy):
            return None
        return found and {k: v for k, v in found.items() if k != "parts"}

    def _fits(self, edge: int, sign: int, fraction: float, wanted: float | None, policy: DetourPolicy) -> bool:
        at = None if wanted is None else self.bearing_at(edge, sign, fraction)
        return at is None or paths.turn(at, wanted) <= policy.match_angle

    def _cheapest(self, start, end, policy, directed, leave, arrive) -> dict | None:
        (e0, f0), (e1, f1) = start, end
        best: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[int, int] | None] = {}
        goal = None
        heap: list[tuple[float, int, int, bool]] = []
        for sign in (1, -1):
            if (e0, sign) not in self.cost or not self._fits(e0, sign, f0, leave, policy):
                continue
            left = (1 - f0) if sign > 0 else f0
            if e0 == e1 and (f1 - f0) * sign >= 0 and self._fits(e1, sign, f1, arrive, policy):
                value = self.cost[e0, sign] * abs(f1 - f0)
                if goal is None or value < goal[0]:
                    goal = (value, [(e0, sign)])
            heapq.heappush(heap, (self.cost[e0, sign] * left, e0, sign, True))
        while heap:
            value, edge, sign, first = heapq.heappop(heap)
            state = (edge, sign)
            if goal is not None and value >= goal[0]:
                break
            if not first and best.get(state, math.inf) < value:
                continue
            at = self.head(edge, sign)
            for nxt in self.leaving.get(at, ()):
                if directed and ((edge, nxt[0], at) in self.forbidden or self.reversal(state, nxt, policy)):
                    continue
                if nxt[0] == e1 and self._fits(*nxt, f1, arrive, policy):
                    share = f1 if nxt[1] > 0 else 1 - f1
                    total = value + self.cost[nxt] * share
                    if goal is None or total < goal[0] - 1e-12:
                        goal = (total, self._trace(back, state, first) + [nxt])
                whole = value + self.cost[nxt]
                if whole < best.get(nxt, math.inf) - 1e-12:
                    best[nxt], back[nxt] = whole, (state if not first else ("start", *state))
                    heapq.heappush(heap, (whole, nxt[0], nxt[1], False))
        if goal is None:
            return None
        path, pieces = self._shape(goal[1], f0, f1)
        return {"cost": goal[0], "edges": goal[1], "path": path, "parts": pieces}

    @staticmethod
    def _trace(back, state, first) -> list[tuple[int, int]]:
        if first:
            return [state]
        out = [state]
        while True:
            before = back[out[-1]]
            if before[0] == "start":
                return [before[1:]] + out[::-1]
            out.append(before)

    def _shape(self, edges: list[tuple[int, int]], f0: float, f1: float) -> tuple[np.ndarray | None, list[np.ndarray] | None]:
        """The way's line, and each edge's part of it."""
        parts, pieces = [], []
        for k, (edge, sign) in enumerate(edges):
            a = f0 if k == 0 else (0.0 if sign > 0 else 1.0)
            b = f1 if k == len(edges) - 1 else (1.0 if sign > 0 else 0.0)
            if edge not in self.paths:
                return None, None
            part = paths.substring(self.paths[edge], a, b)
            pieces.append(part)
            parts.append(part if not parts else part[1:] if np.allclose(part[0], parts[-1][-1] if len(parts[-1]) else part[0]) else part)
        return (np.vstack(parts) if parts else None), pieces


def build_graph(edges: pd.DataFrame, restrictions: list[tuple[int, int, int]] = (), cost: str = "seconds", reverse: str = "reverse_seconds", undirected: bool = False) -> Graph:
    graph = Graph(forbidden=set(map(tuple, restrictions)))
    for r in edges.sort_values("edge_id").itertuples():
        value, back = getattr(r, cost), getattr(r, reverse)
        graph.add(int(r.edge_id), int(r.source), int(r.target), value, value if undirected else back, paths.as_array(r.path) if getattr(r, "path", None) is not None else None, getattr(r, "kind", "") or "")
    return graph


def solve_pairs(edges: DataFrame, pairs: DataFrame, restrictions: DataFrame | None = None, cost: str = "seconds", reverse: str = "reverse_seconds", undirected: bool = False, policy: DetourPolicy = DetourPolicy()) -> DataFrame:
    """Cheapest ways of each request's pairs on its local graph: ``request_id, pair_id, state, cost, edges, path``.

    ``edges``: ``request_id, edge_id, source, target``, costs, ``path``; ``pairs``: ``request_id, pair_id, from_edge,
    from_fraction, to_edge, to_fraction`` (null edges: unmatched); ``restrictions``: ``from_edge, to_edge, via``. Without a
    way, lengths alone tell a missing path from missing coverage.
    """
    kind = F.col("kind") if "kind" in edges.columns else F.lit("")
    rows = edges.select("request_id", "edge_id", "source", "target", F.col(cost).alias("c"), F.col(reverse).alias("r"), F.col("cost").alias("m"), F.col("reverse_cost").alias("mr"), "path", kind.alias("kind"))
    asked = _asked(edges, pairs.select("request_id", "pair_id", "from_edge", "from_fraction", "to_edge", "to_fraction"), restrictions)

    def run(key: tuple, frame: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        rules, wanted = _parted(both)
        graph = build_graph(frame, rules, "c", "r", undirected)
        plain = None
        out = []
        for p in wanted.sort_values("pair_id").itertuples():
            if pd.isna(p.from_edge) or pd.isna(p.to_edge):
                out.append((p.pair_id, "unmatched", None, [], None))
                continue
            ends = (int(p.from_edge), p.from_fraction), (int(p.to_edge), p.to_fraction)
            found = graph.route(*ends, policy, directed=not undirected)
            if found is None:
                plain = plain or build_graph(frame, rules, "m", "mr", undirected)
                state = "no_coverage" if plain.route(*ends, policy, directed=not undirected) else "no_path"
                out.append((p.pair_id, state, None, [], None))
            else:
                out.append((p.pair_id, "reached", found["cost"], [e * s for e, s in found["edges"]], paths.as_rows(found["path"]) if found["path"] is not None else None))
        result = pd.DataFrame(out, columns=["pair_id", "state", "cost", "edges", "path"])
        result.insert(0, "request_id", key[0])
        return result.astype({"cost": "float64"})

    kinds = dict(edges.dtypes) | dict(pairs.dtypes)
    schema = f"request_id {kinds['request_id']}, pair_id {kinds['pair_id']}, state string, cost double, edges array<long>, path array<struct<lon:double,lat:double>>"
    return rows.groupBy("request_id").cogroup(asked.groupBy("request_id")).applyInPandas(run, schema)


def _asked(edges: DataFrame, wanted: DataFrame, restrictions: DataFrame | None) -> DataFrame:
    """What a request asks for and the rules on its edges, as rows of one table; neither is copied to the edges."""
    rule = "struct<from_edge:long,to_edge:long,via:long>"
    out = wanted.withColumn("rule", F.lit(None).cast(rule))
    if restrictions is not None:
        here = edges.select("request_id", F.col("edge_id").alias("from_edge")).join(restrictions, "from_edge")
        rules = here.select("request_id", F.struct(*[F.col(c).cast("long").alias(c) for c in ("from_edge", "to_edge", "via")]).alias("rule"))
        out = out.unionByName(rules, allowMissingColumns=True)
    return out


def _parted(both: pd.DataFrame) -> tuple[list[tuple[int, int, int]], pd.DataFrame]:
    """The rules and the wanted rows of ``_asked``."""
    is_rule = both["rule"].notna() if len(both) else pd.Series([], dtype=bool)
    return [(r["from_edge"], r["to_edge"], r["via"]) for r in both.loc[is_rule, "rule"]], both.loc[~is_rule] if len(both) else both


def segment_routes(edges: DataFrame, waypoints: DataFrame, restrictions: DataFrame | None = None, avoid: DataFrame | None = None, policy: DetourPolicy = DetourPolicy()) -> DataFrame:
    """Ways through ordered waypoints: ``request_id, state, cost, edges, path``.

    ``edges`` as for ``solve_pairs``; ``waypoints``: ``request_id, place, edge_id, fraction, heading``, where only
    the first and last headings count; ``avoid``: ``request_id, cut`` (path), whose corridor no edge may touch.
    States: reached, no_path, unmatched, too_many.
    """
    if avoid is not None:
        touched = edges.join(avoid.select("request_id", "cut"), "request_id").where(path_distance(F.col("path"), F.col("cut")) <= policy.corridor_m)
        edges = edges.join(touched.select("request_id", "edge_id"), ["request_id", "edge_id"], "left_anti")
    kind = F.col("kind") if "kind" in edges.columns else F.lit("")
    rows = edges.select("request_id", "edge_id", "source", "target", F.col("seconds").alias("c"), F.col("reverse_seconds").alias("r"), "path", kind.alias("kind"))
    asked = _asked(edges, waypoints.select("request_id", "place", "edge_id", "fraction", "heading"), restrictions)

    def run(key: tuple, frame: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        rules, wanted = _parted(both)
        wanted = wanted.sort_values("place") if len(wanted) else wanted
        state, total, edge_ids, line = "unmatched", None, [], []
        if len(wanted) > policy.max_waypoints:
            state = "too_many"
        elif len(wanted) >= 2 and wanted["edge_id"].notna().all():
            graph = build_graph(frame, rules, "c", "r")
            places = [(int(e), float(f)) for e, f in zip(wanted["edge_id"], wanted["fraction"])]
            heading = lambda k: None if pd.isna(wanted["heading"].iloc[k]) else float(wanted["heading"].iloc[k])
            legs = route_waypoints(graph, places, policy, leave=heading(0), arrive=heading(-1)) if all(e in graph.source for e, _ in places) else None
            state = "no_path" if legs is None else "reached"
            for leg in legs or ():
                total = (total or 0.0) + leg["cost"]
                edge_ids += [e * s for e, s in leg["edges"]]
                line += paths.as_rows(leg["path"] if not line else leg["path"][1:]) if leg["path"] is not None else []
        return pd.DataFrame([(key[0], state, total, edge_ids, line or None)], columns=["request_id", "state", "cost", "edges", "path"]).astype({"cost": "float64"})

    schema = f"request_id {dict(waypoints.dtypes)['request_id']}, state string, cost double, edges array<long>, path array<struct<lon:double,lat:double>>"
    return rows.groupBy("request_id").cogroup(asked.groupBy("request_id")).applyInPandas(run, schema).join(waypoints.select("request_id").distinct(), "request_id", "left_semi")


def segment_routes_with_retry(network: DataFrame, boxes: DataFrame, waypoints: DataFrame, policy: DetourPolicy = DetourPolicy(), **options) -> DataFrame:
    """``segment_routes`` on each request's box; requests without a way are tried once more with a wider one.

    ``network``: priced edges; ``boxes``: ``request_id, min_lon, min_lat, max_lon, max_lat``.
    """
    first = checkpointed(segment_routes(local_edges(network, boxes), waypoints, policy=policy, **options))
    open_ones = first.where("state = 'no_path'").select("request_id")
    if open_ones.isEmpty():
        return first
    d = policy.retry_margin_m / DEGREE_M
    wide = boxes.join(open_ones, "request_id").withColumns({"min_lon": F.col("min_lon") - 2 * d, "max_lon": F.col("max_lon") + 2 * d, "min_lat": F.col("min_lat") - d, "max_lat": F.col("max_lat") + d})
    again = segment_routes(local_edges(network, wide), waypoints.join(open_ones, "request_id"), policy=policy, **options)
    return first.join(open_ones, "request_id", "left_anti").unionByName(again)


def route_waypoints(
    graph: Graph, places: list[tuple[int, float]], policy: DetourPolicy = DetourPolicy(), directed: bool = True, leave: float | None = None, arrive: float | None = None
) -> list[dict] | None:
    """Legs through ordered places; legs of no length stay. None if one can't be reached."""
    if not 2 <= len(places) <= max(policy.max_waypoints, 50):
        raise InvalidField("waypoints", "need 2 or more, and not too many")
    legs = []
    for k, (a, b) in enumerate(zip(places, places[1:])):
        if a == b:
            legs.append({"cost": 0.0, "edges": [], "path": None})
            continue
        leg = graph.route(a, b, policy, directed, leave if k == 0 else None, arrive if k == len(places) - 2 else None)
        if leg is None:
            return None
        legs.append(leg)
    return legs


# detour plans


def classify_stops(stops: DataFrame, policy: DetourPolicy = DetourPolicy()) -> DataFrame:
    """Stops by distance to the cut: forced out, optional, or required. ``stops``: ``lon, lat, cut`` (path)."""
    d = point_path_distance(F.col("lon"), F.col("lat"), F.col("cut"))
    return stops.withColumn("cut_m", d).withColumn("availability", F.when(F.col("cut_m") <= policy.forced_m, "forced").when(F.col("cut_m") <= policy.optional_m, "optional").otherwise("required"))


@dataclass(order=True)
class Choice:
    """A way through the stop graph up to one stop."""

    rank: tuple
    kept: tuple[int, ...]
    edges: tuple[int, ...]
    seconds: float = field(compare=False)
    arrival: float | None = field(compare=False, default=None)


def select_stops(availability: list[str], connections: dict[tuple[int, int], dict], criterion: str = "time", policy: DetourPolicy = DetourPolicy()) -> dict | None:
    """Which stops to keep: ``kept`` (indices), ``seconds``, ``omitted``; None if there is no way.

    ``connections``: (i, j) to ``seconds, edges, departure, arrival`` (bearings or None). Required stops are never
    skipped and forced ones never kept. The criterion, time or stops, decides first, then the other,
    then the kept stops, then the edges. Times within 1e-9 are equal. A connection that turns back at a
    stop is refused. For each last stop the best ways with one kept stop and with more are known.
    """
    if criterion not in ("time", "stops"):
        raise InvalidField("criterion", "must be time or stops")
    n = len(availability)
    required = np.concatenate([[0], np.cumsum([a == "required" for a in availability])])

    def rank(seconds: float, kept: tuple[int, ...], last: int) -> tuple:
        time, omitted = round(seconds, 9), sum(1 for k in range(last + 1) if k not in kept)
        return (time, omitted) if criterion == "time" else (omitted, time)

    best: list[dict[tuple, Choice]] = [{} for _ in range(n)]
    for j in range(n):
        if availability[j] == "forced":
            continue
        if required[j] == 0:
            best[j][1, None] = Choice(rank(0.0, (j,), j), (j,), (), 0.0)
        for i in range(j):
            link = connections.get((i, j))
            if link is None or required[j] - required[i + 1] > 0:
                continue
            for choice in best[i].values():
                if choice.arrival is not None and link["departure"] is not None and paths.turn(choice.arrival, link["departure"]) >= policy.reversal_angle:
                    continue
                kept, seconds = (*choice.kept, j), choice.seconds + link["seconds"]
                new = Choice(rank(seconds, kept, j), kept, (*choice.edges, *link["edges"]), seconds, link["arrival"])
                at = (2, link["arrival"])  # ways that arrive alike turn alike
                if at not in best[j] or new < best[j][at]:
                    best[j][at] = new
    ends = []
    for j in range(n):
        if required[n] - required[j + 1] == 0:
            for (size, _), c in best[j].items():
                if size == 2:
                    ends.append((rank(c.seconds, c.kept, n - 1), c.kept, c.edges, c.seconds))
    if not ends:
        return None
    _, kept, edges, seconds = min(ends)
    return {"kept": list(kept), "edges": list(edges), "seconds": seconds, "omitted": n - len(kept)}


def affected_intervals(route: np.ndarray, cut: np.ndarray, policy: DetourPolicy = DetourPolicy()) -> list[tuple[float, float]]:
    """Parts of a route inside the corridor of a cut, as fractions by metres."""
    return paths.inside_parts(route, cut, policy.corridor_m)


def plan_pairs(fractions: list[float], availability: list[str], interval: tuple[float, float]) -> tuple[list[int], list[tuple[int, int]]]:
    """Stops that a detour of the interval may use, and ordered pairs that skip no required stop.

    The last required stop before the interval and the first one after it are its anchors; without one,
    the first or last stop that may be kept.
    """
    usable = [k for k, a in enumerate(availability) if a != "forced"]
    firm = [k for k in usable if availability[k] == "required"]
    lo = max((k for k in firm if fractions[k] <= interval[0]), default=usable[0] if usable else 0)
    hi = min((k for k in firm if fractions[k] >= interval[1]), default=usable[-1] if usable else -1)
    inside = [k for k in usable if lo <= k <= hi]
    pairs = [(i, j) for x, i in enumerate(inside) for j in inside[x + 1 :] if not any(availability[k] == "required" for k in range(i + 1, j))]
    return inside, pairs


def reconstruct(route: np.ndarray, replacements: list[tuple[float, float, np.ndarray]]) -> np.ndarray:
    """The route with parts (fractions, in order, apart) replaced by other paths."""
    out, at = [], 0.0
    for start, end, path in sorted(replacements, key=lambda r: r[0]):
        if start < at - 1e-9:
            raise ValueError("replacements overlap")
        if start > at:
            out.append(paths.substring(route, at, start))
        out.append(path)
        at = end
    if at < 1:
        out.append(paths.substring(route, at, 1.0))
    joined = np.vstack(out)
    same = np.concatenate([[False], (np.abs(joined[1:] - joined[:-1]) < 1e-12).all(axis=1)])
    return joined[~same]


PLAN = "request_id long, state string, kept array<int>, omitted array<int>, seconds double, margin_m double, path array<struct<lon:double,lat:double>>"


def plan_detours(requests: DataFrame, edges: DataFrame, restrictions: DataFrame | None = None, policy: DetourPolicy = DetourPolicy()) -> DataFrame:
    """Detour plans of requests, each on its own local graph.

    ``requests``: ``request_id, criterion, path`` (the route), ``cut`` (path), ``stops`` (array of ``lon, lat`` in order);
    ``edges``: priced edges. A request without a plan is tried again in a wider area, then by lengths at
    the default speed. The ladder's areas are nested, so the widest is cut out once.
    """
    from ..functions.geo import expanded_box

    margin = policy.search_m + policy.retry_margin_m
    asked = requests.withColumn("box", expanded_box(F.col("cut"), margin)).select("*", "box.*").drop("box")
    local = local_edges(edges, asked)
    rules = local.select("request_id", F.col("edge_id").alias("from_edge"))
    if restrictions is not None:
        rules = rules.join(restrictions, "from_edge").groupBy("request_id").agg(F.collect_list(F.struct("from_edge", "to_edge", "via")).alias("rules"))
    else:
        rules = requests.select("request_id", F.array().cast("array<struct<from_edge:long,to_edge:long,via:long>>").alias("rules"))
    head = requests.select("request_id", "criterion", F.col("path").alias("route"), "cut", "stops").join(rules, "request_id", "left")

    def run(key, head: pd.DataFrame, local: pd.DataFrame) -> pd.DataFrame:
        if head.empty:
            return pd.DataFrame(columns=[c.split(" ")[0] for c in PLAN.split(", ")])
        r = head.iloc[0]
        route, cut = paths.as_array(r["route"]), paths.as_array(r["cut"])
        stops = paths.as_array(r["stops"])
        rules = [(x["from_edge"], x["to_edge"], x["via"]) for x in (r["rules"] if r["rules"] is not None else [])]
        plan = _plan(int(key[0]), route, cut, stops, r["criterion"], local, rules, policy)
        return pd.DataFrame([plan], columns=[c.split(" ")[0] for c in PLAN.split(", ")])

    cols = [F.col("request_id").alias("__request"), "edge_id", "source", "target", "cost", "reverse_cost", "seconds", "reverse_seconds", "path"]
    kind = [F.col("kind")] if "kind" in edges.columns else [F.lit("").alias("kind")]
    return head.groupBy("request_id").cogroup(local.select(*cols, *kind).groupBy("__request")).applyInPandas(run, PLAN)


def _plan(request, route, cut, stops, criterion, local, rules, policy) -> tuple:
    check_cut(cut, policy)
    n = len(stops)
    parts = affected_intervals(route, cut, policy)
    if not parts:
        return request, "unaffected", list(range(n)), [], 0.0, 0.0, paths.as_rows(route)
    off = paths.distance_to_path(stops, cut)
    availability = ["forced" if d <= policy.forced_m else "optional" if d <= policy.optional_m else "required" for d in off]
    fractions = paths.monotone_fractions(route, stops)
    lines = [paths.as_array(p) for p in local["path"]]
    away = np.array([paths.distance_to_path(paths.densify(p, policy.corridor_m)[0], cut).min() if len(p) > 1 else 0.0 for p in lines])
    for margin, cost, back in ((policy.search_m, "seconds", "reverse_seconds"), (policy.search_m + policy.retry_margin_m, "seconds", "reverse_seconds"), (policy.search_m + policy.retry_margin_m, "m_s", "m_b")):
        near = local.assign(m_s=local["cost"] / (policy.default_kmh / 3.6), m_b=np.where(local["reverse_cost"] < 0, -1.0, local["cost"] / (policy.default_kmh / 3.6)))
        near = near[(away <= margin) & (away > policy.corridor_m)]
        if near.empty:
            continue
        graph = build_graph(near, rules, cost, back)
        interval = (min(p[0] for p in parts), max(p[1] for p in parts))
        inside, pairs = plan_pairs(fractions, availability, interval)
        places = {k: _nearest(graph, stops[k], policy.snap_m) for k in inside}
        connections, shapes = {}, {}
        for i, j in pairs:
            if places[i] is None or places[j] is None:
                continue
            found = graph.route(places[i], places[j], policy)
            if found and found["path"] is not None and len(found["path"]) > 1:
                p = found["path"]
                connections[i, j] = {"seconds": found["cost"], "edges": tuple(e * s for e, s in found["edges"]), "departure": paths.bearing(p[0], p[1]), "arrival": paths.bearing(p[-2], p[-1])}
                shapes[i, j] = p
        at = {k: x for x, k in enumerate(inside)}
        chosen = select_stops([availability[k] for k in inside], {(at[i], at[j]): c for (i, j), c in connections.items()}, criterion, policy)
        if chosen:
            kept = [inside[k] for k in chosen["kept"]]
            line = [shapes[i, j] for i, j in zip(kept, kept[1:])]
            new = reconstruct(route, [(fractions[kept[0]], fractions[kept[-1]], np.vstack(line))])
            every = [k for k in range(n) if availability[k] != "forced" and (k < kept[0] or k > kept[-1] or k in kept)]
            return request, "planned", every, [k for k in range(n) if k not in every], chosen["seconds"], float(margin), paths.as_rows(new)
    return request, "no_path", [], list(range(n)), None, float(policy.search_m + policy.retry_margin_m), None


def _nearest(graph: Graph, point, reach: float) -> tuple[int, float] | None:
    best = None
    for edge in sorted(graph.paths):
        d = float(paths.distance_to_path(np.asarray(point)[None], graph.paths[edge])[0])
        if d <= reach and (best is None or d < best[0]):
            best = (d, edge)
    return (best[1], paths.locate(graph.paths[best[1]], point)) if best else None


def uncovered_stops(plans: DataFrame, contributions: DataFrame) -> DataFrame:
    """Stops that a detour omits, with what they contributed before (0 if nothing)."""
    gone = plans.select(F.col("request_id").alias("route_id"), F.explode("omitted").alias("stop_order"))
    return gone.join(contributions.select("route_id", "stop_order", "as_origin", "as_dest"), ["route_id", "stop_order"], "left").na.fill(0.0, ["as_origin", "as_dest"])
