"""Matching provider identities to feed routes by where their vehicles drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import edges, haversine, samples
from ..operators.checkpoints import checkpointed
from ..operators.relational import distance_join, top_n
from ..streaming.bottlenecks import project

#: Weights of the score's parts, and classes by score and margin.
WEIGHTS = {"within_200": 0.35, "within_100": 0.25, "bins": 0.20, "direction": 0.20}
BINS, REACH_M = 20, 1500.0


def sampled(positions: DataFrame, per_identity: int = 500, salt: str = "a") -> DataFrame:
    """At most so many positions of each identity, chosen by a hash, so that a rerun takes the same.

    A threshold on the hash, from the identity's count, cuts hot identities before the exact ranking.
    """
    counts = positions.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    pick = F.xxhash64("obs_id", F.lit(salt))
    near = positions.join(counts, "identity").withColumn("__pick", pick)
    share = F.least(F.lit(1.0), 2.0 * per_identity / F.col("n"))
    kept = near.where(F.pmod("__pick", F.lit(1 << 20)) < share * (1 << 20)).drop("n")
    return top_n(kept, ["identity"], [F.asc("__pick"), F.asc("obs_id")], per_identity).drop("__pick")


def nearest_edges(positions: DataFrame, shapes: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """Each position's nearest edge on every shape within reach: distance and place 0 to 1 by edge number.

    Edges meet positions by samples along them, so that a long edge is found wherever it passes.
    """
    parts = shapes.select("shape_id", F.size("path").alias("points"), F.posexplode(edges(F.col("path"))).alias("edge", "e"))
    parts = parts.select("shape_id", "edge", "points", F.col("e.p").alias("p"), F.col("e.q").alias("q"))
    marks = parts.select(F.col("shape_id"), "edge", F.explode(samples(F.array("p", "q"), 2 * reach_m)).alias("s")).select("shape_id", "edge", F.col("s.lon").alias("r_lon"), F.col("s.lat").alias("r_lat"))
    near = distance_join(positions.select("obs_id", "identity", "lon", "lat", "heading"), marks, 2 * reach_m).drop("r_lon", "r_lat", "distance_m").distinct().join(parts, ["shape_id", "edge"])
    t = project(F.col("lon"), F.col("lat"), F.col("p"), F.col("q"))
    at_lon, at_lat = F.col("p.lon") + t * (F.col("q.lon") - F.col("p.lon")), F.col("p.lat") + t * (F.col("q.lat") - F.col("p.lat"))
    rows = near.withColumns({"off_m": haversine(F.col("lon"), F.col("lat"), at_lon, at_lat), "along": (F.col("edge") + t) / (F.col("points") - 1)}).where(F.col("off_m") <= reach_m)
    best = F.min_by(F.struct("off_m", "along", "p", "q", "heading"), F.struct("off_m", "edge"))
    return rows.groupBy("identity", "obs_id", "shape_id").agg(best.alias("b")).select("identity", "obs_id", "shape_id", "b.*")


def scores(nearest: DataFrame, positions: DataFrame) -> DataFrame:
    """Score of each shape for each identity, from shares of the identity's sampled positions."""
    from ..functions.geo import angle_diff, bearing

    total = positions.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    along = bearing(F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat"))
    agrees = (F.col("off_m") <= 200) & (angle_diff(F.col("heading"), along) <= 90)
    used = F.when(F.col("off_m") <= 200, F.least(F.lit(BINS - 1), F.floor(F.col("along") * BINS)))
    rows = nearest.groupBy("identity", "shape_id").agg(
        F.count_if(F.col("off_m") <= 200).alias("n200"), F.count_if(F.col("off_m") <= 100).alias("n100"), (F.count_distinct(used) / BINS).alias("bins"), F.count_if(F.coalesce(agrees, F.lit(False))).alias("same")
    )
    rows = rows.join(total, "identity").withColumns({"within_200": F.col("n200") / F.col("n"), "within_100": F.col("n100") / F.col("n"), "direction": F.coalesce(F.try_divide(F.col("same"), F.col("n200")), F.lit(0.0))})
    score = sum(F.col(c) * w for c, w in WEIGHTS.items())
    return rows.select("identity", "shape_id", *WEIGHTS, F.round(score, 6).alias("score"))


def classify(scored: DataFrame, other: DataFrame | None = None, least: float = 0.8, margin: float = 0.05) -> DataFrame:
    """Each identity's best shape and its class: accepted, ambiguous, unstable or rejected.

    ``other`` holds scores of a second sample; another winner there makes the identity unstable.
    """
    over = Window.partitionBy("identity").orderBy(F.desc("score"), "shape_id")
    ranked = scored.withColumns({"rank": F.row_number().over(over), "second": F.lead("score").over(over)}).where("rank = 1")
    if other is not None:
        again = top_n(other, ["identity"], [F.desc("score"), F.asc("shape_id")]).select("identity", F.col("shape_id").alias("again"))
        ranked = ranked.join(again, "identity", "left")
    else:
        ranked = ranked.withColumn("again", F.col("shape_id"))
    clear = F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin
    state = F.when(F.col("score") < least, "rejected").when(~F.col("again").eqNullSafe(F.col("shape_id")), "unstable").when(~clear, "ambiguous").otherwise("accepted")
    return ranked.select("identity", "shape_id", "score", "second", state.alias("state"))


def candidate_shapes(positions: DataFrame, shapes: DataFrame, cell_deg: float = 0.005, n: int = 15) -> DataFrame:
    """Inverted index of shapes by grid cells, probed with 3 x 3 cells; the most hit shapes of each identity.

    Shapes of the same cells are hit alike, so that only the first ``n`` of them can be among the most hit, and
    observations of the same cells count together. So the join follows the number of cells, not that of rows times shapes.
    """
    cell = lambda lon, lat: (F.floor(lon / cell_deg), F.floor(lat / cell_deg))
    x, y = cell(F.col("pt.lon"), F.col("pt.lat"))
    passed = shapes.select("shape_id", F.explode("path").alias("pt")).select("shape_id", F.struct(x.alias("x"), y.alias("y")).alias("c")).where("c.x IS NOT NULL AND c.y IS NOT NULL")
    alike = checkpointed(passed.groupBy("shape_id").agg(F.array_sort(F.collect_set("c")).alias("cells")))
    classes = checkpointed(alike.select("cells").distinct().withColumn("class", F.monotonically_increasing_id()))
    around = F.flatten(F.transform("cells", lambda c: F.array(*[F.struct((c["x"] + i).alias("x"), (c["y"] + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    index = classes.select("class", F.explode(F.array_distinct(around)).alias("c"))
    px, py = cell(F.col("lon"), F.col("lat"))
    at = positions.where(px.isNotNull() & py.isNotNull()).groupBy("identity", "obs_id").agg(F.collect_set(F.struct(px.alias("x"), py.alias("y"))).alias("at"))
    probes = at.groupBy("identity", F.array_sort("at").alias("at")).agg(F.count("obs_id").alias("obs"))
    met = probes.select("identity", "at", "obs", F.explode("at").alias("c")).join(index.hint("merge"), "c").groupBy("identity", "class", "at").agg(F.max("obs").alias("obs"))
    hits = met.groupBy("identity", "class").agg(F.sum("obs").alias("hits"))
    first = top_n(alike.join(classes.hint("merge"), "cells").select("class", "shape_id"), ["class"], [F.asc("shape_id")], n)
    hits = hits.join(first, "class").select("identity", "shape_id", "hits")
    return top_n(hits, ["identity"], [F.desc("hits"), F.asc("shape_id")], n, rank="rank")
