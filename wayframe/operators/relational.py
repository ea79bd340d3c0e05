"""Joins and window operators: distance, nearest, as-of, runs, local minima, pages.

Nothing here collects data; each operator is a plan for Catalyst. Distance joins become
equi-joins on grid buckets (one side is sent to the 3 x 3 buckets around it), so their
cost follows the number of near pairs; hot buckets are left to runtime skew splitting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, RADIUS_M, haversine


#: Buckets that more bands than may be broadcast are dealt to.
BAND_BUCKETS = 256


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / step).cast("long")


def _columns_of(band: Column, step: float) -> Column:
    """Buckets around the globe in a latitude band, each at least one radius wide there."""
    poleward = F.greatest(F.abs(band * step - 90.0), F.abs((band + 1) * step - 90.0))
    width = F.lit(step) / F.greatest(F.cos(F.radians(F.least(poleward, F.lit(90.0)))), F.lit(step / 360))
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")


def _within(lon: Column, lat: Column, cos: Column, r_lon: Column, r_lat: Column, r_cos: Column, radius_m: float, strict: bool) -> Column:
    """Is the distance at most the radius? Bounds without trigonometry decide all pairs but those at the radius itself.

    They hold the square of half the chord between ``x^2 - x^4/3`` and ``x^2`` of its angles; ``cos`` is that of a side's latitude.
    """
    half = math.pi / 360
    x, y = (lat - r_lat) * (lat - r_lat) * (half * half), (lon - r_lon) * (lon - r_lon) * (half * half)
    most = math.sin(min(radius_m / (2 * RADIUS_M), math.pi / 2)) ** 2
    exact = haversine(lon, lat, r_lon, r_lat)
    near = exact < radius_m if strict else exact <= radius_m
    return (x - x * x / 3 + (y - y * y / 3) * cos * r_cos <= most * (1 + 1e-9)) & ((x + y * cos * r_cos <= most * (1 - 1e-9)) | near)


def distance_join(
    left: DataFrame, right: DataFrame, radius_m: float, left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("r_lon", "r_lat"),
    on: list[tuple[str, str]] | None = None, strict: bool = False, distance: str = "distance_m", where: Column | None = None,
) -> DataFrame:
    """Pairs within ``radius_m`` (less than it if ``strict``), with their distance.

    The sides' column names must differ. ``on`` adds equal columns, ``where`` a condition.
    The right side is replicated, so it should be the smaller one. Estimates do not see the copies, so a small
    file would be broadcast with all of them; the hint keeps the join to sorted partitions.
    """
    step = radius_m / DEGREE_M * 1.000001
    lon, lat = F.col(left_at[0]), F.col(left_at[1])
    left = left.where(lon.isNotNull() & lat.isNotNull()).withColumns({"__band": _band(lat, step), "__cos": F.cos(F.radians(lat))})
    columns = _columns_of(F.col("__band"), step)
    left = left.withColumn("__cell", F.pmod(F.floor((lon + 180.0) / 360.0 * columns).cast("long"), columns))
    r_lon, r_lat = F.col(right_at[0]), F.col(right_at[1])
    right = right.where(r_lon.isNotNull() & r_lat.isNotNull()).withColumn("__r_cos", F.cos(F.radians(r_lat)))
    right = right.withColumn("__r_band", F.explode(F.array(*[_band(r_lat, step) + d for d in (-1, 0, 1)])))
    columns = _columns_of(F.col("__r_band"), step)
    at = F.floor((r_lon + 180.0) / 360.0 * columns).cast("long")
    right = right.withColumn("__r_cell", F.explode(F.array_distinct(F.array(*[F.pmod(at + d, columns) for d in (-1, 0, 1)]))))
    meet = (F.col("__band") == F.col("__r_band")) & (F.col("__cell") == F.col("__r_cell"))
    for a, b in on or []:
        meet &= F.col(a) == F.col(b)
    if where is not None:
        meet &= where
    meet &= _within(lon, lat, F.col("__cos"), r_lon, r_lat, F.col("__r_cos"), radius_m, strict)
    out = left.join(right.hint("merge"), meet).withColumn(distance, haversine(lon, lat, r_lon, r_lat))
    return out.drop("__band", "__cell", "__cos", "__r_band", "__r_cell", "__r_cos")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the order."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """One row per key by a partially aggregated minimum, which never gathers a hot key's rows."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    found = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return found.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


#: Right rows that the first ring should hold, and the least share of the given radius that it may have.
RING_ROWS, LEAST_RING = 4, 1 / 64


def first_ring(right: DataFrame, radius_m: float, r_lon: str = "r_lon", r_lat: str = "r_lat") -> float:
    """A radius, at most the given one, that holds a few right rows if they lie evenly in their box."""
    at = right.agg(F.count(r_lat).alias("n"), *[f(c).alias(f"{f.__name__}_{k}") for k, c in (("lon", r_lon), ("lat", r_lat)) for f in (F.min, F.max)]).first()
    if not at.n:
        return radius_m
    widest = math.cos(math.radians(0.0 if at.min_lat < 0 < at.max_lat else min(abs(at.min_lat), abs(at.max_lat), 90.0)))
    area = (at.max_lat - at.min_lat) * (at.max_lon - at.min_lon) * widest * DEGREE_M**2
    return min(radius_m, max(radius_m * LEAST_RING, math.sqrt(RING_ROWS * area / (math.pi * at.n))))


def nearest(left: DataFrame, right: DataFrame, key: list[str], radius_m: float, order: list[str], max_radius_m: float = 2.1e7, **at) -> DataFrame:
    """For each left row its nearest right row (ties by ``order``), by rings of growing radius.

    The first ring has the given radius, or less where the right rows are dense.
    """
    from .checkpoints import checkpointed

    found, open_rows, radius = None, left, first_ring(right, radius_m, *at.get("right_at", ("r_lon", "r_lat")))
    while True:
        near = checkpointed(first_per_key(distance_join(open_rows, right, radius, **at), key, ["distance_m", *order]))
        found = near if found is None else found.unionByName(near)
        if radius >= max_radius_m:
            return found
        open_rows = open_rows.join(near.select(*key), key, "left_anti")
        if open_rows.isEmpty():
            return found
        open_rows, radius = checkpointed(open_rows), min(radius * 4, max_radius_m)


def as_of_latest(events: DataFrame, facts: DataFrame, keys: list[str], time: str, fact_time: str, columns: list[str]) -> DataFrame:
    """Each event with the latest fact of its key at or before its time (``columns`` null without one).

    One union and one window over a key's rows; facts sort before events of the same time.
    """
    e = events.withColumns({"__t": F.col(time), "__kind": F.lit(1), "__fact": F.lit(None).cast(facts.select(F.struct(*columns)).schema[0].dataType)})
    blank = {c: F.lit(None).cast(events.schema[c].dataType) for c in events.columns if c not in keys}
    f = facts.select(*keys, F.col(fact_time).alias("__t"), F.struct(*columns).alias("__fact")).withColumns(blank).withColumn("__kind", F.lit(0))
    over = Window.partitionBy(*keys).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(f).withColumn("__last", F.last("__fact", ignorenulls=True).over(over)).where("__kind = 1")
    return both.select(*events.columns, *[F.col("__last")[c].alias(c) for c in columns])


def band_lookup(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str, on: list[str] | None = None, bound: int = 10_000) -> DataFrame:
    """Rows with the band [low, high) that holds their value; a null high has no end.

    Bands are a table of rules; they are broadcast while their counted number is bounded. More of them
    are cut at all their bounds, and values and cuts meet by an as-of merge in buckets between quantiles of the bounds.
    """
    end = F.coalesce(F.col(high).cast("double"), F.lit(float("inf")))
    inside = (F.col(value) >= F.col(low)) & (F.col(value) < end)
    if on:
        return rows.join(F.broadcast(bands) if bands.count() <= bound else bands, on).where(inside)
    if bands.count() <= bound:
        return rows.join(F.broadcast(bands), inside)
    cuts = bands.stat.approxQuantile(low, [k / BAND_BUCKETS for k in range(1, BAND_BUCKETS)], 0.001)  # a fixed number of values
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))])
    bucket = lambda c: F.size(F.filter(cuts, lambda x: x <= c))
    spread = bands.withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(end))))
    return rows.withColumn("__b", bucket(F.col(value))).join(spread, "__b").where(inside).drop("__b")


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of the values before each row of its group; 0 for the first."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(over), F.lit(0).cast(df.schema[value].dataType)))


def runs(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "run") -> DataFrame:
    """Numbers maximal runs (from 1); ``breaks`` is true where a new one starts."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def changed(column: str, keys: list[str], order: list[str]) -> Column:
    """True on the first row of a group and where the column differs from the row before."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return F.lag(F.lit(1)).over(over).isNull() | ~F.col(column).eqNullSafe(F.lag(column).over(over))


def local_minima(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Rows whose value is not above that of adjacent positions (and below an equal run's start)."""
    over = Window.partitionBy(*keys).orderBy(position)
    before = F.when(F.lag(position).over(over) == F.col(position) - 1, F.lag(value).over(over))
    after = F.when(F.lead(position).over(over) == F.col(position) + 1, F.lead(value).over(over))
    marked = df.withColumns({"__before": before, "__after": after})
    keep = (F.col("__before").isNull() | (F.col(value) < F.col("__before"))) & (F.col("__after").isNull() | (F.col(value) <= F.col("__after")))
    return marked.where(keep).drop("__before", "__after")


def ordered_pairs(df: DataFrame, keys: list[str], ident: str, columns: list[str]) -> DataFrame:
    """Pairs of a group's rows with ``a_<ident> < b_<ident>``; for groups known to be small."""
    a = df.select(*keys, *[F.col(c).alias(f"a_{c}") for c in [ident, *columns]])
    b = df.select(*keys, *[F.col(c).alias(f"b_{c}") for c in [ident, *columns]])
    return a.join(b, keys).where(F.col(f"a_{ident}") < F.col(f"b_{ident}"))


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """A page of the total order; no or zero limit means all."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def keyset_page(df: DataFrame, key: str, after: object | None, limit: int | None) -> DataFrame:
    """Rows after a key in its order, without sorting what comes before; no or zero limit means all."""
    out = df if after is None else df.where(F.col(key) > F.lit(after))
    out = out.orderBy(key)
    return out.limit(limit) if limit else out


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """Each row with the number of all rows, from one partially aggregated count."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def optional_filters(df: DataFrame, conditions: dict[str, tuple[object, Column]]) -> DataFrame:
    """Applies only the conditions whose parameter is given."""
    for parameter, condition in conditions.values():
        if parameter is not None and parameter != "":
            df = df.where(condition)
    return df


def overlaps(start: Column, end: Column, last: Column, from_: Column, to: Column) -> Column:
    """An episode overlaps [from, to): it starts before ``to`` and ends, or was last seen, at or after ``from``."""
    return (start < to) & (F.coalesce(end, last) >= from_)


def connected_components(vertices: DataFrame, edges: DataFrame, vertex: str = "id", source: str = "source", target: str = "target") -> DataFrame:
    """``vertices`` with ``component``: the smallest vertex reachable, by stars with a checkpoint per round."""
    from .checkpoints import checkpointed

    pairs = edges.select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v")).where("u <> v").distinct()
    pairs, before = checkpointed(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("u").alias(vertex), F.col("v").alias("__root"))
    return vertices.join(roots, vertex, "left").withColumn("component", F.coalesce("__root", F.col(vertex))).drop("__root")


def largest_component(vertices: DataFrame, edges: DataFrame, vertex: str = "id", source: str = "source", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the largest component; of equals, the one with the smallest id."""
    marked = connected_components(vertices, edges, vertex, source, target)
    best = marked.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    kept = marked.join(F.broadcast(best), "component", "left_semi").drop("component")
    inside = kept.select(F.col(vertex).alias("__v"))
    return kept, edges.join(inside, F.col(source) == F.col("__v"), "left_semi").join(inside, F.col(target) == F.col("__v"), "left_semi")


# set-based mutations of immutable tables


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is new; of several with one key, the first in order."""
    return first_per_key(incoming, keys, order).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows replaced or joined by incoming ones, whose keys are unique."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def guarded_update(existing: DataFrame, changes: DataFrame, keys: list[str], column: str, expected: str, new: str) -> DataFrame:
    """``column`` set to ``new`` only where it still equals ``expected`` (nulls compare equal)."""
    joined = existing.join(changes.select(*keys, F.col(expected).alias("__old"), F.col(new).alias("__new"), F.lit(True).alias("__change")), keys, "left")
    value = F.when(F.col("__change") & F.col(column).eqNullSafe(F.col("__old")), F.col("__new")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*existing.columns)


def delete_unreferenced(rows: DataFrame, references: DataFrame, key: str, expired: Column) -> DataFrame:
    """Rows without those that are expired and not referenced."""
    gone = rows.where(expired).select(key).join(references.select(key), key, "left_anti")
    return rows.join(gone, key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column], ident: list[str]) -> DataFrame:
    """One row per row and broken rule (a rule that is null counts as broken); none when all is well."""
    checks = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()])
    return df.select(*ident, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("rule"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
