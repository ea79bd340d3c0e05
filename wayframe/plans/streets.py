"""Street network: filter, directed costs, largest component, turn restrictions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import path_length, path_points, valid_path
from ..operators.checkpoints import checkpointed
from ..operators.relational import largest_component

# fixed values: classes open to buses, tag values that close a way, and one-way values
CLASSES = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "road", "busway",
]
CLOSED = ["no", "private"]
FORWARD, BACKWARD = ["yes", "true", "1"], ["-1", "reverse"]
BUS_TAGS = ["bus", "psv"]
RESTRICTION_TAGS = ["restriction:bus", "restriction:psv", "restriction"]


def import_network(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and undirected edges of a street extract: ways cut at their ends and where they share a node.

    ``nodes``: ``id, lon, lat``; ``ways``: ``way_id, tags, refs``. References to unknown nodes are passed over.
    Returns ``id, lon, lat`` and ``edge_id, way_id, source, target, tags, path``.
    """
    at = nodes.select(F.col("id").alias("ref"), "lon", "lat")
    rows = ways.select("way_id", F.posexplode("refs").alias("pos", "ref")).join(at, "ref")
    over = Window.partitionBy("way_id").orderBy("pos")
    used = rows.groupBy("ref").agg((F.count(F.lit(1)) > 1).alias("shared"))
    rows = rows.join(used, "ref").withColumn("end", F.lag("ref").over(over).isNull() | F.lead("ref").over(over).isNull())
    rows = rows.withColumn("cut", F.col("shared") | F.col("end"))
    # an inner vertex ends one piece and begins the next
    piece = F.sum(F.col("cut").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("piece", piece)
    both = rows.select("way_id", "piece", "pos", "ref", "lon", "lat").unionByName(rows.where("cut AND piece > 1").select("way_id", (F.col("piece") - 1).alias("piece"), "pos", "ref", "lon", "lat"))
    edges = both.groupBy("way_id", "piece").agg(
        F.min_by("ref", "pos").alias("source"), F.max_by("ref", "pos").alias("target"), path_points(F.col("pos"), F.col("lon"), F.col("lat")).alias("path"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    edges = edges.join(ways.select("way_id", "tags"), "way_id")
    vertices = rows.where("cut").select(F.col("ref").alias("id"), "lon", "lat").distinct()
    return vertices, edges.select((F.col("way_id") * 4096 + F.col("piece")).alias("edge_id"), "way_id", "source", "target", "tags", "path")


def usable_ways(ways: DataFrame) -> DataFrame:
    """Ways a bus may use. ``ways``: ``way_id, tags`` (map), and what else there is."""
    tag = lambda k: F.col("tags")[k]
    bus = F.coalesce(*[F.when(tag(k).isin("yes", "designated"), True) for k in BUS_TAGS], F.lit(False))
    shut = F.coalesce(tag("access").isin(CLOSED), F.lit(False)) | F.coalesce(tag("motor_vehicle").isin(CLOSED), F.lit(False))
    kind = F.coalesce(tag("highway").isin(CLASSES), F.lit(False)) | (F.coalesce(tag("highway").isin("service", "pedestrian"), F.lit(False)) & bus)
    return ways.where(kind & (~shut | bus))


def directed_edges(edges: DataFrame) -> DataFrame:
    """Edges in driving direction with costs in metres; -1 where they can't be driven back.

    ``edges``: ``edge_id, source, target, path, tags``. Edges that run only backward are turned.
    """
    oneway, junction = F.coalesce(F.lower(F.col("tags")["oneway"]), F.lit("")), F.col("tags")["junction"]
    turned = oneway.isin(BACKWARD)
    single = oneway.isin(FORWARD + BACKWARD) | (F.coalesce(junction == "roundabout", F.lit(False)) & (oneway != "no"))
    rows = edges.where(valid_path(F.col("path"))).withColumns({"__turned": turned, "__length": path_length(F.col("path"))})
    source = F.when(F.col("__turned"), F.col("target")).otherwise(F.col("source"))
    target = F.when(F.col("__turned"), F.col("source")).otherwise(F.col("target"))
    return rows.select(
        "edge_id", *[c for c in ("way_id",) if c in edges.columns], source.alias("source"), target.alias("target"), F.col("__length").alias("cost"), F.when(single, -1.0).otherwise(F.col("__length")).alias("reverse_cost"),
        F.when(F.col("__turned"), F.reverse("path")).otherwise(F.col("path")).alias("path"), F.col("tags")["highway"].alias("kind"), F.col("tags")["name"].alias("name"),
    )


def street_graph(ways: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the largest connected part of the usable network."""
    edges = checkpointed(directed_edges(usable_ways(ways)))  # read by every round of the components
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return largest_component(vertices.join(ends, "id", "left_semi"), edges)


def turn_restrictions(relations: DataFrame, edges: DataFrame, way: str = "way_id") -> DataFrame:
    """Forbidden turns ``from_edge, to_edge, via``.

    Of a relation's tags the most specific one counts. It needs exactly one from and to way and one
    via node, and one edge of either way at that node; ``only_*`` forbids all other ways out,
    turning back included.
    """
    kind = F.coalesce(*[F.col("tags")[t] for t in RESTRICTION_TAGS])
    roles = relations.withColumn("kind", kind).where(F.col("kind").rlike("^(no|only)_")).select("relation_id", "kind", F.explode("members").alias("m"))
    one = lambda role, type_: F.when(F.count_if(F.col("m.role") == role) == 1, F.max(F.when((F.col("m.role") == role) & (F.col("m.type") == type_), F.col("m.ref"))))
    whole = roles.groupBy("relation_id", "kind").agg(one("from", "w").alias("from_way"), one("via", "n").alias("via"), one("to", "w").alias("to_way")).dropna()
    # an edge leaves its source, and its target too if it runs both ways
    out = edges.select(F.col("source").alias("via"), F.col(way).alias("to_way"), F.col("edge_id").alias("to_edge")).union(
        edges.where("reverse_cost >= 0").select("target", way, "edge_id")
    )
    into = edges.select(F.col("target").alias("via"), F.col(way).alias("from_way"), F.col("edge_id").alias("from_edge")).union(
        edges.where("reverse_cost >= 0").select("source", way, "edge_id")
    )
    only_in = whole.join(into, ["via", "from_way"]).groupBy("relation_id", "kind", "via", "to_way").agg(F.collect_set("from_edge").alias("f")).where(F.size("f") == 1)
    only_out = only_in.join(out, ["via", "to_way"]).groupBy("relation_id", "kind", "via", "f").agg(F.collect_set("to_edge").alias("t")).where(F.size("t") == 1)
    rows = only_out.select("kind", "via", F.col("f")[0].alias("from_edge"), F.col("t")[0].alias("only_edge"))
    banned = rows.where(F.col("kind").startswith("no_")).select("from_edge", F.col("only_edge").alias("to_edge"), "via")
    others = rows.where(F.col("kind").startswith("only_")).join(out.select("via", "to_edge").distinct(), "via").where("to_edge <> only_edge").select("from_edge", "to_edge", "via")
    return banned.unionByName(others).distinct()


def network_problems(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural faults by kind, with how many; no rows when the network is sound."""
    bad = edges.select(
        F.count_if(~(F.col("cost") > 0)).alias("cost"), F.count_if((F.col("reverse_cost") <= 0) & (F.col("reverse_cost") != -1)).alias("reverse_cost"), F.count_if(~valid_path(F.col("path"))).alias("path")
    )
    known = vertices.select(F.col("id").alias("__id"))
    ends = edges.select(F.col("source").alias("__id")).union(edges.select("target"))
    lost = ends.join(known, "__id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown vertex").alias("problem"), "n")
    rows = bad.select(F.stack(F.lit(3), F.lit("cost"), F.col("cost"), F.lit("reverse_cost"), F.col("reverse_cost"), F.lit("path"), F.col("path")).alias("problem", "n"))
    return rows.union(lost).where("n > 0")


def require_sound(problems: DataFrame) -> None:
    """Raises if there are problems (at most one row per kind)."""
    found = problems.collect()
    if found:
        raise ValueError("; ".join(f"{r[0]}: {r[1]}" for r in found))


def coverage(edges: DataFrame) -> DataFrame:
    """Edges and kilometres by class."""
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("reverse_cost") < 0).alias("one_way"), (F.sum("cost") / 1000).alias("km"))


def touching(edges: DataFrame, vertices: DataFrame, vertex: str = "id") -> DataFrame:
    """Edges that leave a vertex: as source, or as target if they run both ways (two equi-joins, no OR)."""
    a = edges.join(vertices, edges.source == vertices[vertex])
    b = edges.where("reverse_cost >= 0").join(vertices, edges.target == vertices[vertex])
    return a.unionByName(b)


def is_open(column: Column) -> Column:
    return column >= 0
