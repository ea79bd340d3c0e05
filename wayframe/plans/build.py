"""Building all tables from sources in order, and replacing only what a new feed changes.

Every step reads what earlier steps wrote, so a failed build goes on from the tables that are
there, and no step computes another's work again. A reload keeps the survey's tables, the tariffs
and the streets, and renews everything that depends on the feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.geo import HexGrid
from ..policy import TransferPolicy
from ..sources.sinks import overwrite
from . import demand, feed, streets, transfers

FEED = ["routes", "route_stops", "stops", "feed_problems"]
SURVEY = ["cells", "od_matrix", "transfer_od"]
STREETS = ["street_vertices", "street_edges", "turn_restrictions"]
DERIVED = ["transfer_points", "transfer_ranking"]


class Tables:
    """Tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> None:
        overwrite(df, f"{self.folder}/{name}")


def load_feed(tables: Tables, files: dict[str, DataFrame], excluded_agencies: DataFrame | None = None) -> None:
    """Writes the feed's tables; raises where a route and direction has several shapes or a direction is unknown."""
    built = feed.build_feed(files, excluded_agencies)
    tables.write("feed_problems", built["problems"])
    if found := tables.read("feed_problems").limit(5).collect():
        raise ValueError(f"the feed is inconsistent, for example {[tuple(r) for r in found]}")
    for name in ("stops", "routes", "route_stops"):
        tables.write(name, built[name])


def load_survey(tables: Tables, survey: DataFrame, grid=None) -> None:
    trips = demand.trips_to_cells(survey, grid or HexGrid())
    tables.write("cells", demand.hotspots(trips))
    tables.write("od_matrix", demand.od_matrix(trips))
    tables.write("transfer_od", demand.transfer_od(trips))


def load_streets(tables: Tables, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> None:
    """Writes the street network; raises where its structure is broken."""
    vertices, edges = streets.import_network(nodes, ways)
    vertices, edges = streets.street_graph(edges, vertices)
    tables.write("street_vertices", vertices)
    tables.write("street_edges", edges)
    streets.require_sound(streets.network_problems(tables.read("street_vertices"), tables.read("street_edges")))
    tables.write("turn_restrictions", streets.turn_restrictions(relations, tables.read("street_edges")))


def derive(tables: Tables, policy: TransferPolicy = TransferPolicy()) -> None:
    """What follows from feed and survey together."""
    stops, rows = tables.read("stops"), tables.read("route_stops")
    tables.write("transfer_points", transfers.transfer_points(rows, stops, policy))
    tables.write("transfer_ranking", transfers.build_ranking(tables.read("transfer_od"), tables.read("cells"), rows, stops, policy))


def full_build(spark: SparkSession, folder: str, files: dict[str, DataFrame], survey: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame, grid=None, policy: TransferPolicy = TransferPolicy(), step: Callable[[str], None] = lambda name: None) -> Tables:
    """All tables, in order; ``step`` is told the name of each part before it runs."""
    tables = Tables(spark, folder)
    for name, run in (
        ("feed", lambda: load_feed(tables, files)), ("survey", lambda: load_survey(tables, survey, grid)),
        ("streets", lambda: load_streets(tables, nodes, ways, relations)), ("derived", lambda: derive(tables, policy)),
    ):
        step(name)
        run()
    return tables


def reload_feed(spark: SparkSession, folder: str, files: dict[str, DataFrame], policy: TransferPolicy = TransferPolicy()) -> Tables:
    """Renews the feed's tables and what depends on them; survey, streets and tariffs stay as they are."""
    tables = Tables(spark, folder)
    load_feed(tables, files)
    derive(tables, policy)
    return tables
