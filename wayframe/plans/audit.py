"""Audit reports over shapes, positions, matching, bunching and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import top_n


def shape_proximity(distances: DataFrame, near_m: float = 100.0) -> DataFrame:
    """Positions near their assigned shape against positions near any shape, and the share lost.

    ``distances``: ``route, obs_id, shape_id, assigned`` (boolean), ``distance_m``.
    """
    near = F.col("distance_m") <= near_m
    per = distances.groupBy("route", "obs_id").agg(F.bool_or(F.col("assigned") & near).alias("own"), F.bool_or(near).alias("any"))
    out = per.groupBy("route").agg(F.count(F.lit(1)).alias("positions"), F.count_if("own").alias("near_assigned"), F.count_if("any").alias("near_any"))
    return out.withColumn("lost", 1 - F.try_divide(F.col("near_assigned"), F.nullif(F.col("near_any"), F.lit(0))))


def ranked_shapes(distances: DataFrame, near_m: float = 100.0, n: int = 3) -> DataFrame:
    """Each route's shapes with most near positions."""
    hits = distances.where(F.col("distance_m") <= near_m).groupBy("route", "shape_id").agg(F.count_distinct("obs_id").alias("hits"))
    return top_n(hits, ["route"], [F.desc("hits"), F.asc("shape_id")], n, rank="rank")


def position_status(audited: DataFrame, near_m: float = 100.0) -> DataFrame:
    """Counts by status: unmapped, without a shape, far, near. ``audited``: ``feed_route, shape_id, distance_m``."""
    status = F.when(F.col("feed_route").isNull(), "unmapped").when(F.col("shape_id").isNull(), "no_shape").when(F.coalesce(F.col("distance_m") <= near_m, F.lit(False)), "near").otherwise("far")
    return audited.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("positions"))


def age_profile(positions: DataFrame) -> DataFrame:
    """Ages at receipt, rows that arrived after a newer one of their vehicle, one row.

    ``positions``: ``vehicle, observed_at, received_at, capture_id`` in seconds.
    """
    over = Window.partitionBy("vehicle").orderBy("received_at", "capture_id", "observed_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = positions.withColumns({"age": F.col("received_at") - F.col("observed_at"), "newest": F.max("observed_at").over(over)})
    q = F.percentile("age", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]))
    return rows.agg(F.count(F.lit(1)).alias("positions"), q[0].alias("p10"), q[1].alias("p50"), q[2].alias("p90"), F.count_if(F.col("observed_at") < F.col("newest")).alias("reordered"))


def cadence(captures: DataFrame) -> DataFrame:
    """Seconds between captures: median and maximum, one row (captures are few)."""
    rows = captures.withColumn("gap", F.col("received_at") - F.lag("received_at").over(Window.orderBy("received_at", "capture_id")))
    return rows.agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.max("gap").alias("max_gap"))


def band(value: Column, bounds: list[float]) -> Column:
    """Index of the band: 0 up to the first bound, and so on."""
    out = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        out = F.when(value <= bounds[k], k).otherwise(out)
    return out


def distance_bands(matched: DataFrame, bounds: tuple[float, ...] = (25, 50, 100, 200)) -> DataFrame:
    return matched.groupBy(band(F.col("distance_m"), list(bounds)).alias("band")).agg(F.count(F.lit(1)).alias("positions"), F.count_distinct("vehicle").alias("vehicles"))


def update_gaps(positions: DataFrame, captures: DataFrame, least: tuple[int, ...] = (3, 4)) -> DataFrame:
    """How many updates of a vehicle came after at least so many complete captures without one.

    ``captures``: ``capture_id, partial``; captures are few and get their ordinal in one window.
    """
    ordinal = F.sum(F.when(~F.col("partial"), 1).otherwise(0)).over(Window.orderBy("capture_id"))
    rows = positions.select("vehicle", "capture_id").distinct().join(captures.withColumn("n", ordinal).select("capture_id", "n"), "capture_id")
    over = Window.partitionBy("vehicle").orderBy("capture_id")
    gaps = rows.withColumn("missed", F.col("n") - F.lag("n").over(over) - 1)
    return gaps.agg(F.count("missed").alias("updates"), *[F.count_if(F.col("missed") >= k).alias(f"after_{k}") for k in least])


def bunching_integrity(events: DataFrame, radius_m: float = 100.0) -> DataFrame:
    """Rules that episodes must keep, with how many break them."""
    rules = {
        "order": F.col("first_at") <= F.col("last_at"),
        "radius": F.col("min_distance") <= radius_m,
        "closed before last": F.col("closed_at").isNull() | (F.col("closed_at") >= F.col("last_at")),
        "reason": F.col("closed_at").isNull() == F.col("reason").isNull(),
        "pair order": F.col("a") < F.col("b"),
    }
    counts = events.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    parts = [x for name in rules for x in (F.lit(name), F.col(f"`{name}`"))]
    return counts.select(F.stack(F.lit(len(rules)), *parts).alias("rule", "broken"))


def coverage_summary(runs: DataFrame, cuts: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Totals of coverage rows with volume cuts; ``consistent`` if the accounting adds up. One row.

    ``runs``: ``observations, matched, ambiguous, unmatched, passages``.
    """
    sums = [F.sum(c).alias(c) for c in ("observations", "matched", "ambiguous", "unmatched", "passages")]
    at_least = [F.count_if(F.col("passages") >= k).alias(f"at_least_{k}") for k in cuts]
    out = runs.agg(*sums, *at_least, F.percentile("passages", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return out.withColumns({"p10": F.col("q")[0], "p50": F.col("q")[1], "p90": F.col("q")[2], "consistent": F.col("observations") == F.col("matched") + F.col("ambiguous") + F.col("unmatched")}).drop("q")
