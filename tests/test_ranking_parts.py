"""The ranking settles pairs with too many itineraries early, and keeps every other one."""

from wayframe import registry
from wayframe.plans import transfers


def test_ranking_is_the_same_by_parts(spark, monkeypatch):
    """Parts of routes that drop pairs early, against all routes at once."""
    seen, real = [], transfers.transfer_points
    monkeypatch.setattr(transfers, "transfer_points", lambda *a, **b: seen.append(a) or real(*a, **b))
    results = []
    for parts in ((), (4, 10)):
        monkeypatch.setattr(transfers, "PART_ROUTES", parts)
        results.append(sorted(map(str, registry.QUERIES["e13_transfer_ranking"](spark, "/root/testdata/sf0.01").collect())))
    assert results[0] == results[1] and len(results[0]) > 3000
    assert len(seen) == 1 + 3


def test_walks_only_for_pairs_without_a_direct_route(spark):
    """Cells that one route connects need no walks: none are sought."""
    stops = spark.createDataFrame([(1, -58.40, -34.60), (2, -58.30, -34.60), (3, -58.401, -34.60)], "stop_id long, lon double, lat double")
    route_stops = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 3, 1)], "route_id long, stop_id long, stop_seq int")
    cells = spark.createDataFrame([("a", -58.40, -34.60), ("b", -58.30, -34.60)], "cell string, lon double, lat double")
    service = transfers.cell_service(cells, route_stops, stops)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "origin string, dest string")
    assert [tuple(r) for r in transfers.indirect(pairs, service).collect()] == [("b", "a")]
    asked = spark.createDataFrame([(2,)], "route_id long")
    assert {(r.r1, r.r2) for r in transfers.transfer_points(route_stops, stops, leaving=asked).collect()} == {(2, 1)}
