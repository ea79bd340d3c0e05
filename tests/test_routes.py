"""Ways that must not turn back, and ways through waypoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.plans import routing
from wayframe.policy import DetourPolicy
from wayframe.schemas import PATH

K = 1e-5  # about a metre


def line(*points):
    return np.array([(x * K, y * K) for x, y in points], dtype=float)


def divided_road(gap, kind=""):
    """Two carriageways in opposite directions, joined at their east end by a connector."""
    g = routing.Graph()
    g.add(1, 1, 2, 100.0, -1.0, line((0, 0), (100, 0)))
    g.add(2, 2, 3, float(gap), -1.0, line((100, 0), (100, gap)), kind)
    g.add(3, 3, 4, 100.0, -1.0, line((100, gap), (0, gap)))
    return g


def test_no_turn_across_a_divide():
    assert divided_road(20).route((1, 0.1), (3, 0.9)) is None
    assert divided_road(20, "primary_link").route((1, 0.1), (3, 0.9)) is not None
    far = divided_road(60).route((1, 0.1), (3, 0.9))
    assert far["edges"] == [(1, 1), (2, 1), (3, 1)] and "parts" not in far
    assert divided_road(20).route((1, 0.1), (2, 0.9))["cost"] == pytest.approx(108)
    # two short connectors count together
    g = divided_road(12)
    g.add(4, 2, 5, 12.0, -1.0, line((100, 0), (105, 6)))
    g.add(5, 5, 3, 12.0, -1.0, line((105, 6), (100, 12)))
    assert g.route((1, 0.1), (3, 0.9)) is None


def test_headings_choose_the_way_round():
    g = routing.Graph()
    for k, (a, b) in enumerate([((0, 0), (100, 0)), ((100, 0), (100, 100)), ((100, 100), (0, 100)), ((0, 100), (0, 0))]):
        g.add(k + 1, k, (k + 1) % 4, 100.0, 100.0, line(a, b))
    assert g.route((1, 0.4), (3, 0.5))["edges"] == [(1, -1), (4, -1), (3, -1)]
    assert g.route((1, 0.4), (3, 0.5), leave=90.0)["edges"] == [(1, 1), (2, 1), (3, 1)]
    assert g.route((1, 0.6), (3, 0.5), arrive=90.0)["edges"] == [(1, -1), (4, -1), (3, -1)]
    assert g.route((1, 0.6), (1, 0.8), leave=0.0) is None
    assert routing.route_waypoints(g, [(1, 0.4), (2, 0.5), (3, 0.5)], leave=270.0, arrive=270.0)[0]["edges"][0] == (1, -1)


def test_segments_with_avoidance_and_retry(spark):
    square = [(1, 1, 2, [(0, 0), (100, 0)]), (2, 2, 3, [(100, 0), (100, 100)]), (3, 3, 4, [(100, 100), (0, 100)]), (4, 4, 1, [(0, 100), (0, 0)])]
    rows = [(e, a, b, 10.0, 10.0, 100.0, 100.0, [(x * K, y * K) for x, y in p]) for e, a, b, p in square]
    network = spark.createDataFrame(rows, f"edge_id long, source long, target long, seconds double, reverse_seconds double, cost double, reverse_cost double, path {PATH}")
    box = lambda r, lo, hi: (r, lo[0] * K, lo[1] * K, hi[0] * K, hi[1] * K)
    boxes = spark.createDataFrame([box("a", (-5, -5), (105, 105)), box("b", (-5, -5), (105, 5)), box("c", (-5, -5), (105, 105)), box("d", (-5, -5), (105, 105))], "request_id string, min_lon double, min_lat double, max_lon double, max_lat double")
    points = [(r, k, e, f, None) for r in "abc" for k, (e, f) in enumerate([(1, 0.4), (3, 0.5)])] + [("d", 0, 1, 0.5, None), ("d", 1, None, None, None)]
    waypoints = spark.createDataFrame(points, "request_id string, place int, edge_id long, fraction double, heading double")
    cut = spark.createDataFrame([("c", [(0.0, 50 * K), (1 * K, 50 * K)])], f"request_id string, cut {PATH}")
    got = {r.request_id: r for r in routing.segment_routes_with_retry(network, boxes, waypoints, DetourPolicy(), avoid=cut).collect()}
    assert got["a"].edges == [-1, -4, -3] and got["a"].cost == pytest.approx(4 + 10 + 5)
    assert got["b"].state == "reached"  # edge 3 lies outside of the first box
    assert got["c"].edges == [1, 2, 3] and got["d"].state == "unmatched"
    many = waypoints.where("request_id = 'a'").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(29))))
    assert routing.segment_routes(routing.local_edges(network, boxes), many).first().state == "too_many"


def test_many_requests_meet_in_buckets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 0.1, (60, 2))
    edges = spark.createDataFrame([(k, [(x, y), (x + 0.03, y + 0.01)]) for k, (x, y) in enumerate(at.tolist())], f"edge_id long, path {PATH}")
    boxes = spark.createDataFrame([(k, x, y, x + 0.02, y + 0.04) for k, (x, y) in enumerate(rng.uniform(0, 0.1, (40, 2)).tolist())], "request_id long, min_lon double, min_lat double, max_lon double, max_lat double")
    few = sorted((r.request_id, r.edge_id) for r in routing.local_edges(edges, boxes).collect())
    monkeypatch.setattr(routing, "MOST_BROADCAST_REQUESTS", 0)
    assert sorted((r.request_id, r.edge_id) for r in routing.local_edges(edges, boxes).collect()) == few and len(few) > 100


def test_many_bands_meet_in_buckets(spark):
    from wayframe.operators import relational as rel

    bands = spark.createDataFrame([(k, k * 3.0, k * 3.0 + 3 if k < 499 else None) for k in range(500)], "band long, lo double, hi double")
    rows = spark.range(4000).select("id", (F.col("id") * 0.41 - 3).alias("v"))
    few = sorted((r.id, r.band) for r in rel.band_lookup(rows, bands, "v", "lo", "hi").collect())
    many = sorted((r.id, r.band) for r in rel.band_lookup(rows, bands, "v", "lo", "hi", bound=10).collect())
    assert few == many and len(few) > 3900
