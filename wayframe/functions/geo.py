"""Geography as column expressions: WGS84 degrees in, metres on the sphere out.

A point is a pair of columns, a path an array of structs ``lon, lat``. All distances are
great-circle distances with one radius; nothing leaves whole-stage code generation but
the higher-order functions over paths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean Earth radius.
RADIUS_M = 6371008.8
#: Metres of one degree of a great circle.
DEGREE_M = math.pi * RADIUS_M / 180


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def between(p: Column, q: Column) -> Column:
    return haversine(p["lon"], p["lat"], q["lon"], q["lat"])


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    """Angle between two directions, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def edges(path: Column) -> Column:
    """The path's edges: array of structs ``p, q``."""
    n = F.size(path)
    return F.when(n < 2, F.slice(F.zip_with(path, path, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), 1, 0)).otherwise(
        F.zip_with(F.slice(path, F.lit(1), n - 1), F.slice(path, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    )


def path_length(path: Column) -> Column:
    return F.aggregate(edges(path), F.lit(0.0), lambda acc, e: acc + between(e["p"], e["q"]))


def longest_edge(path: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(edges(path), lambda e: between(e["p"], e["q"]))), F.lit(0.0))


def path_points(seq: Column, lon: Column, lat: Column) -> Column:
    """Aggregate: ordered points to a path."""
    return F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), lon.alias("lon"), lat.alias("lat")))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))


def point_edge_distance(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance of a point to an edge: cross-track, or to an end beyond it."""
    to_start = haversine(lon1, lat1, lon, lat)
    d13 = to_start / RADIUS_M
    off = F.radians(bearing(lon1, lat1, lon, lat) - bearing(lon1, lat1, lon2, lat2))
    cross = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d13) * F.sin(off))))
    along = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(d13) / F.cos(cross)))) * RADIUS_M
    length = haversine(lon1, lat1, lon2, lat2)
    return F.when((length == 0) | (F.cos(off) <= 0), to_start).when(along > length, haversine(lon2, lat2, lon, lat)).otherwise(F.abs(cross) * RADIUS_M)


def point_path_distance(lon: Column, lat: Column, path: Column) -> Column:
    """Smallest distance of a point to a path; to its point if it has only one."""
    by_edge = F.array_min(F.transform(edges(path), lambda e: point_edge_distance(lon, lat, e["p"]["lon"], e["p"]["lat"], e["q"]["lon"], e["q"]["lat"])))
    return F.coalesce(by_edge, haversine(lon, lat, F.get(path, F.lit(0))["lon"], F.get(path, F.lit(0))["lat"]))


def locate(lon: Column, lat: Column, path: Column) -> Column:
    """Fraction along the path, by planar length, of its point nearest to the given one (the first of equals)."""

    def step(acc, e):
        dx, dy = e["q"]["lon"] - e["p"]["lon"], e["q"]["lat"] - e["p"]["lat"]
        size = F.sqrt(dx * dx + dy * dy)
        t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - e["p"]["lon"]) * dx + (lat - e["p"]["lat"]) * dy) / (size * size))))
        x, y = e["p"]["lon"] + t * dx - lon, e["p"]["lat"] + t * dy - lat
        d = x * x + y * y
        nearer = d < acc["d"]
        return F.struct(F.when(nearer, d).otherwise(acc["d"]).alias("d"), F.when(nearer, acc["run"] + t * size).otherwise(acc["at"]).alias("at"), (acc["run"] + size).alias("run"))

    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("at"), F.lit(0.0).alias("run"))
    return F.aggregate(edges(path), start, step, lambda acc: F.when(acc["run"] == 0, 0.0).otherwise(acc["at"] / acc["run"]))


def plane_distance(lon: Column, lat: Column, path: Column) -> Column:
    """Metres of a point to a path on a plane scaled at the point's latitude (exact to a few centimetres within kilometres)."""
    k = F.cos(F.radians(lat))

    def off(e):
        dx, dy = (e["q"]["lon"] - e["p"]["lon"]) * k, e["q"]["lat"] - e["p"]["lat"]
        x, y = (lon - e["p"]["lon"]) * k, lat - e["p"]["lat"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x * dx + y * dy) / size))).otherwise(0.0)
        return F.sqrt((x - t * dx) * (x - t * dx) + (y - t * dy) * (y - t * dy)) * DEGREE_M

    return F.array_min(F.transform(edges(path), off))


def midpoint(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Spherical midpoint, also across the date line."""
    a, b = F.radians(lat1), F.radians(lat2)
    x1, y1, z1 = F.cos(a) * F.cos(F.radians(lon1)), F.cos(a) * F.sin(F.radians(lon1)), F.sin(a)
    x2, y2, z2 = F.cos(b) * F.cos(F.radians(lon2)), F.cos(b) * F.sin(F.radians(lon2)), F.sin(b)
    x, y, z = x1 + x2, y1 + y2, z1 + z2
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def centroid(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Plain centre of two points, in degrees."""
    return (lon1 + lon2) / 2, (lat1 + lat2) / 2


def _planar_size(e: Column) -> Column:
    dx, dy = e["q"]["lon"] - e["p"]["lon"], e["q"]["lat"] - e["p"]["lat"]
    return F.sqrt(dx * dx + dy * dy)


def _planar_runs(path: Column) -> Column:
    """Planar length before each vertex."""
    return F.aggregate(edges(path), F.array(F.lit(0.0)), lambda acc, e: F.array_append(acc, F.element_at(acc, -1) + _planar_size(e)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _interpolated(path: Column, at: Column) -> Column:
    """The point at a planar length along the path."""

    def step(acc, e):
        size = _planar_size(e)
        here = acc["run"] <= acc["at"]
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (acc["at"] - acc["run"]) / size))).otherwise(0.0)
        lon = F.when(here, e["p"]["lon"] + t * (e["q"]["lon"] - e["p"]["lon"])).otherwise(acc["lon"])
        lat = F.when(here, e["p"]["lat"] + t * (e["q"]["lat"] - e["p"]["lat"])).otherwise(acc["lat"])
        return F.struct((acc["run"] + size).alias("run"), acc["at"].alias("at"), lon.alias("lon"), lat.alias("lat"))

    first = F.get(path, F.lit(0))
    start = F.struct(F.lit(0.0).alias("run"), at.alias("at"), first["lon"].alias("lon"), first["lat"].alias("lat"))
    return F.aggregate(edges(path), start, step, lambda acc: F.struct(acc["lon"].alias("lon"), acc["lat"].alias("lat")))


def interpolate(path: Column, fraction: Column) -> Column:
    """The point at a fraction of the planar length: struct ``lon, lat``."""
    total = F.aggregate(edges(path), F.lit(0.0), lambda acc, e: acc + _planar_size(e))
    return _interpolated(path, F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * total)


def substring(path: Column, start: Column, end: Column) -> Column:
    """The part between two fractions of the planar length; null unless the second is larger."""

    def cut(runs):
        total = F.element_at(runs, -1)
        bounds = F.struct((start * total).alias("lo"), (end * total).alias("hi"))

        def part(b):
            plain = lambda x: F.struct(x["p"]["lon"].alias("lon"), x["p"]["lat"].alias("lat"))
            placed = F.zip_with(path, runs, lambda p, r: F.struct(p.alias("p"), r.alias("r")))
            inner = F.transform(F.filter(placed, lambda x: (x["r"] > b["lo"]) & (x["r"] < b["hi"])), plain)
            return F.concat(F.array(_interpolated(path, b["lo"])), inner, F.array(_interpolated(path, b["hi"])))

        return let(bounds, part)

    return F.when(end > start, let(_planar_runs(path), cut))


def samples(path: Column, step_m: float) -> Column:
    """Points of a path such that none of it is farther than half a step from one; its ends are among them."""
    pieces = F.transform(edges(path), lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), F.greatest(F.lit(1), F.ceil(between(e["p"], e["q"]) / step_m).cast("int")).alias("n")))

    def cut(e):
        share = lambda k: (k + 0.5) / e["n"]
        return F.transform(
            F.sequence(F.lit(0), e["n"] - 1),
            lambda k: F.struct((e["p"]["lon"] + share(k) * (e["q"]["lon"] - e["p"]["lon"])).alias("lon"), (e["p"]["lat"] + share(k) * (e["q"]["lat"] - e["p"]["lat"])).alias("lat")),
        )

    plain = lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
    ends = F.transform(F.filter(F.array(F.get(path, F.lit(0)), F.try_element_at(path, F.lit(-1))), lambda p: p.isNotNull()), plain)
    return F.concat(ends, F.flatten(F.transform(pieces, cut)))


def fragments(path: Column, most: int = 127) -> Column:
    """Pieces of at most ``most`` edges; each begins with the vertex that ends the one before."""
    n = F.greatest(F.lit(1), F.ceil((F.size(path) - 1) / most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(path, k * most + 1, most + 1))


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"]))


def paths_cross(one: Column, two: Column) -> Column:
    """Does an edge of one path properly cross an edge of the other?"""

    def cross(e, f):
        return (_side(e["p"], e["q"], f["p"]) * _side(e["p"], e["q"], f["q"]) < 0) & (_side(f["p"], f["q"], e["p"]) * _side(f["p"], f["q"], e["q"]) < 0)

    return F.exists(edges(one), lambda e: F.exists(edges(two), lambda f: cross(e, f)))


def path_distance(one: Column, two: Column) -> Column:
    """Smallest distance between two paths: 0 where they cross, else from a vertex of either to the other."""
    to = lambda path, other: F.array_min(F.transform(path, lambda p: point_path_distance(p["lon"], p["lat"], other)))
    return F.when(paths_cross(one, two), 0.0).otherwise(F.least(to(one, two), to(two, one)))


# fixed values: the ellipsoid's axis and flattening, and the projection's scale and false origin
AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST_M, FALSE_NORTH_M = 0.9996, 500_000.0, 10_000_000.0


def transverse_mercator(lon: Column, lat: Column, zone: int = 21, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing in metres of a zone of the universal transverse Mercator projection."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    c = 2 * math.sqrt(n) / (1 + n)
    sine, off = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(sine) - c * F.atanh(c * sine))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return FALSE_EAST_M + SCALE * radius * east, (FALSE_NORTH_M if south else 0.0) + SCALE * radius * north


def expanded_box(path: Column, margin_m: float) -> Column:
    """Envelope of a path with a margin: struct ``min_lon, min_lat, max_lon, max_lat``."""
    lons, lats = F.transform(path, lambda p: p["lon"]), F.transform(path, lambda p: p["lat"])
    dy = F.lit(margin_m / DEGREE_M)
    widest = F.greatest(F.abs(F.array_min(lats)), F.abs(F.array_max(lats))) + dy
    dx = dy / F.greatest(F.cos(F.radians(F.least(widest, F.lit(89.9)))), F.lit(1e-6))
    return F.struct((F.array_min(lons) - dx).alias("min_lon"), (F.array_min(lats) - dy).alias("min_lat"), (F.array_max(lons) + dx).alias("max_lon"), (F.array_max(lats) + dy).alias("max_lat"))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def planar(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Local equirectangular metres."""
    return (lon - lon0) * (DEGREE_M * math.cos(math.radians(lat0))), (lat - lat0) * DEGREE_M


def valid_path(path: Column) -> Column:
    """At least two finite points and a positive length."""
    finite = F.forall(path, lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90))
    return F.coalesce((F.size(path) >= 2) & finite & (path_length(path) > 0), F.lit(False))


def path_hash(path: Column) -> Column:
    """Content hash that identifies a version of a path."""
    return F.md5(F.to_json(path))


def join_paths(parts: Column) -> Column:
    """One path of several, without repeated joints."""
    flat = F.flatten(F.filter(parts, lambda p: p.isNotNull()))
    last = lambda acc: F.element_at(acc, -1)
    empty = F.slice(flat, 1, 0)
    return F.aggregate(flat, empty, lambda acc, p: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == p), acc).otherwise(F.array_append(acc, p)))


def align_path(path: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column, tolerance_m: float) -> tuple[Column, Column]:
    """The path with its ends snapped to two points, and an error where a gap exceeds the tolerance.

    A path that runs the other way is left as it is.
    """
    first, last = F.element_at(path, 1), F.element_at(path, -1)
    gap = F.greatest(haversine(lon1, lat1, first["lon"], first["lat"]), haversine(lon2, lat2, last["lon"], last["lat"]))
    back = F.greatest(haversine(lon2, lat2, first["lon"], first["lat"]), haversine(lon1, lat1, last["lon"], last["lat"]))
    point = lambda lon, lat: F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    snapped = F.concat(point(lon1, lat1), F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0))), point(lon2, lat2))
    reversed_ = (back < gap) & (back <= tolerance_m)
    return F.when((gap <= tolerance_m) & ~reversed_, snapped).otherwise(path), F.when((gap > tolerance_m) & ~reversed_, F.format_string("ends %.0f m off", gap))


# cells


class HexGrid:
    """Hexagons by axial coordinates on local equirectangular metres.

    The ids are this grid's own. ``edge_m`` is close to the mean edge of the customary
    resolution 8.
    """

    def __init__(self, edge_m: float = 461.0, lon0: float = -58.45, lat0: float = -34.6):
        self.edge_m, self.lon0, self.lat0 = edge_m, lon0, lat0

    def cell(self, lon: Column, lat: Column) -> Column:
        x, y = planar(lon, lat, self.lon0, self.lat0)
        q, r = (x * (math.sqrt(3) / 3) - y / 3) / self.edge_m, y * (2 / 3) / self.edge_m
        # rounding in cube coordinates
        rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
        q2 = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
        r2 = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
        return self._id(q2.cast("long"), r2.cast("long"))

    @staticmethod
    def _id(q: Column, r: Column) -> Column:
        return F.concat_ws(":", q.cast("string"), r.cast("string"))

    # fixed values: axial steps to the six neighbours
    STEPS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]

    def disk(self, cell: Column) -> Column:
        """The cell and its six neighbours."""
        part = F.split(cell, ":")
        q, r = part[0].cast("long"), part[1].cast("long")
        return F.array(cell, *[self._id(q + a, r + b) for a, b in self.STEPS])


class SquareGrid:
    """Square cells of a step in degrees; the same interface."""

    def __init__(self, step: float = 0.02):
        self.step = step

    def cell(self, lon: Column, lat: Column) -> Column:
        return F.concat_ws(":", F.floor(lon / self.step).cast("string"), F.floor(lat / self.step).cast("string"))

    def disk(self, cell: Column) -> Column:
        part = F.split(cell, ":")
        x, y = part[0].cast("long"), part[1].cast("long")
        return F.array(*[F.concat_ws(":", (x + i).cast("string"), (y + j).cast("string")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * (1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * (1 << zoom)).cast("long")
