"""Demand, travel time, revenue, comparison, catalogue, streets, routing, audits, identity."""

import numpy as np

import pytest
from pyspark.sql import functions as F

from wayframe.functions.geo import DEGREE_M, SquareGrid
from wayframe.operators import paths
from wayframe.operators import relational as rel
from wayframe.plans import audit, catalog, demand, identity, routing, simulation, streets, transfers
from wayframe.policy import DetourPolicy, InvalidField, clamp_page

PATH = "array<struct<lon:double,lat:double>>"


def line(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def test_golden_route(spark):
    """Gross and potential trips, times and revenue of a worked example."""
    assigned = spark.createDataFrame([(1, f"c{k}", k, s, a) for k, (s, a) in enumerate([("A", 1.0), ("B", 0.7), ("C", 0.6)])], "route_id long, cell string, stop_order int, stop_id string, accessibility double")
    matrix = spark.createDataFrame([("c0", "c1", 100.0), ("c0", "c2", 50.0), ("c1", "c2", 25.0), ("c2", "c0", 99.0)], "origin string, dest string, trips double")
    pairs = demand.pair_demand(assigned, matrix)
    rows = {(r.origin_id, r.dest_id): (r.gross, round(r.potential, 6)) for r in pairs.collect()}
    assert rows == {("A", "B"): (100, 70), ("A", "C"): (50, 30), ("B", "C"): (25, 10.5)}
    pairs = spark.createDataFrame([(1, 0, 1, 70.0), (1, 0, 2, 30.0), (1, 1, 2, 18.0)], "route_id long, origin_order int, dest_order int, potential double")
    segments = spark.createDataFrame([(1, 0, 1000.0), (1, 1, 500.0)], "route_id long, segment int, metres double")
    bands = spark.createDataFrame([("city", 0, None, 1000, 1000)], "jurisdiction string, min_m int, max_m int, registered_cents int, unregistered_cents int")
    money = simulation.pair_revenue(simulation.pair_distances(pairs, segments), bands, "city")
    assert {(r.origin_order, r.dest_order): (r.distance_m, r.revenue_cents) for r in money.collect()} == {(0, 1): (1000, 70_000), (0, 2): (1500, 30_000), (1, 2): (500, 18_000)}
    per = {r.stop_order: (r.as_origin, r.as_dest) for r in demand.stop_contributions(spark.createDataFrame([(1, k, s) for k, s in enumerate("ABC")], "route_id long, stop_order int, stop_id string"), pairs).collect()}
    assert per == {0: (100, 0), 1: (18, 70), 2: (0, 48)}
    paces = spark.createDataFrame([(1, 0, 0.2, 0.2, 0.2, "high"), (1, 1, 0.5, 0.5, 0.5, "medium")], "route_id long, segment int, off_peak double, typical double, peak double, confidence string")
    times = simulation.route_time(simulation.travel_time(segments, paces, spark.createDataFrame([(1.0, 1.0, 1.0)], "off_peak double, typical double, peak double"))).first()
    assert (times.typical_s, times.metres, times.confidence) == (450, 1500, "medium")
    b = spark.createDataFrame([(1, 118.0, 118_000.0, 450.0, 3, "city"), (2, 0.0, 0.0, 0.0, 0, "city")], "route_id long, potential double, revenue_cents double, typical_s double, stops int, jurisdiction string")
    p = spark.createDataFrame([(1, 95.0, 95_000.0, 430.0, 2, "city"), (2, 5.0, 0.0, 0.0, 0, "city")], b.schema)
    c = {r.route_id: r for r in simulation.compare(b, p, ["potential", "revenue_cents", "typical_s", "stops"], same="jurisdiction").collect()}
    assert (c[1].potential.absolute, round(c[1].potential.relative, 2), c[1].typical_s.absolute, round(c[1].stops.relative, 2)) == (-23, -0.19, -20, -0.33)
    assert c[2].potential.relative is None
    with pytest.raises(Exception, match="differs"):
        simulation.compare(b, p.withColumn("jurisdiction", F.lit("province")), ["stops"], same="jurisdiction").collect()


def test_access_radius_is_exclusive_and_bands_half_open(spark):
    grid = SquareGrid(0.02)
    at = lambda m: -40 + m / DEGREE_M
    cells = spark.createDataFrame([(-50.0, at(m)) for m in (0, 400, 799.9, 801)], "lon double, lat double").withColumn("cell", grid.cell(F.col("lon"), F.col("lat")))
    spots = cells.withColumn("cell", F.col("cell"))
    stop = spark.createDataFrame([(1, 0, "s", -50.0, -40.0)], "route_id long, stop_order int, stop_id string, lon double, lat double")
    assert demand.cell_candidates(stop, spots, grid).count() == 3
    bands = spark.createDataFrame([(0, 100, 1), (100, None, 2)], "low int, high int, fee int")
    rows = spark.createDataFrame([(0.0,), (99.9,), (100.0,), (1e9,)], "v double")
    assert [r.fee for r in rel.band_lookup(rows, bands, "v", "low", "high").orderBy("v").collect()] == [1, 1, 2, 2]


def test_route_rules(spark):
    p = lambda a, b: line((a, 0), (b, 0))
    rows = [
        ("ok", 0, "a", 0.0, 0.0, p(0, 0.01)), ("ok", 1, "b", 0.01, 0.0, None), ("rev", 0, "a", 0.0, 0.0, p(0.01, 0)), ("rev", 1, "b", 0.01, 0.0, None), ("far", 0, "a", 0.0, 0.0, p(0.005, 0.01)), ("far", 1, "a", 0.01, 0.0, None),
        ("few", 0, " ", 0.0, 0.0, None), ("end", 0, "a", 0.0, 95.0, None), ("end", 1, "b", 0.01, 0.0, p(0, 1)),
    ]
    df = spark.createDataFrame(rows, f"route_id string, stop_order int, stop_id string, lon double, lat double, path_to_next {PATH}")
    got = {}
    for r in simulation.route_problems(df.withColumn("jurisdiction", F.lit("mars")), ["city"]).collect():
        got.setdefault(r.route_id, set()).add(r.rule)
    assert got["ok"] == {"jurisdiction is unknown"} and "path is reversed" in got["rev"] and {"path ends away from its stops", "stop id occurs twice"} <= got["far"]
    assert {"fewer than two stops", "stop id is blank"} <= got["few"] and {"position is out of range", "path is missing", "path after the last stop"} <= got["end"]


def test_travel_time_ladder(spark):
    cols = "route_id long, segment int, length double, radius double, ref_route long, distance double, overlap double, off_peak double, typical double, peak double"
    rows = [(1, 0, 100.0, 100.0, r, 0.0, 100.0, 0.1 * r, 0.1 * r, 0.1 * r) for r in (1, 2, 3)]  # three routes within 100 m
    rows += [(1, 1, 100.0, 100.0, r, 0.0, 100.0, 0.1, 0.1, 0.1) for r in (1, 2)] + [(1, 1, 100.0, 300.0, r, 150.0, 50.0, 0.1 * r, 0.1 * r, 0.1 * r) for r in (1, 2, 3, 4)]
    rows += [(1, 2, 100.0, 800.0, 7, 400.0, 100.0, 0.2, 0.3, 0.4)] + [(1, 3, 100.0, 800.0, 7, 400.0, 100.0, 0.4, 0.3, 0.2)]
    got = {r.segment: r for r in simulation.consolidate(spark.createDataFrame(rows, cols)).collect()}
    assert (got[0].radius, got[0].confidence) == (100, "high") and got[0].typical == pytest.approx(0.2)
    assert (got[1].radius, got[1].confidence) == (300, "medium") and got[1].typical == pytest.approx(0.2)
    assert (got[2].radius, got[2].confidence) == (800, "low") and 3 not in got
    segs = spark.createDataFrame([(1, 0, line((0, 0), (0.01, 0)))], f"route_id long, segment int, path {PATH}")
    timed = spark.createDataFrame([(k, line((0, y), (0.01, y)), 1113.0, 200.0, 250.0, 300.0) for k, y in enumerate((0.0, 0.0005, 0.05))] + [(9, line((0.01, 0), (0, 0)), 1113.0, 200.0, 250.0, 300.0)], f"ref_route long, ref_path {PATH}, metres double, off_peak_s double, typical_s double, peak_s double")
    refs = simulation.segment_references(segs, timed).where("radius = 100").collect()
    assert {r.ref_route for r in refs} == {0, 1} and all(r.overlap == pytest.approx(1112, rel=0.02) for r in refs)


def test_detour_projection(spark):
    old = spark.createDataFrame([(1, "A", 0.0, None), (1, "B", 1000.0, line((0, 0), (0.009, 0))), (1, "C", 2000.0, line((0.009, 0), (0.018, 0)))], f"route_id long, stop_id string, at_m double, path_before {PATH}")
    new = spark.createDataFrame([(1, 0, "A", 0.0, 0.0), (1, 1, "n1", 0.0135, 0.001), (1, 2, "n2", 0.0045, 0.001), (1, 3, "C", 0.018, 0.0)], "route_id long, stop_order int, stop_id string, lon double, lat double")
    got = [r.at_m for r in simulation.project_detour_stops(new, old).orderBy("stop_order").collect()]
    assert got[0] == 0 and got[1] == pytest.approx(1500, rel=1e-3) and got[2] == got[1] and got[3] == 2000


def test_precompute(spark):
    routes = spark.createDataFrame([(1, True), (2, False), (3, True)], "route_id long, simulable boolean")
    sim = spark.createDataFrame([(1, 2.5, 3.5, 10.0)], "route_id long, potential double, revenue_cents double, typical_s double")
    got = {r.route_id: (r.status, r.potential, r.revenue_cents) for r in simulation.precompute(routes, sim).collect()}
    assert got == {1: ("done", 2, 4), 2: ("skipped", None, None), 3: ("failed", None, None)}
    old = spark.createDataFrame([(1, 7, 7, 7), (3, 8, 8, 8)], "route_id long, potential long, revenue_cents long, typical_s long")
    assert {r.route_id: (r.status, r.potential) for r in simulation.precompute(routes, sim, old, True).collect()} == {1: ("kept", 7), 2: ("skipped", None), 3: ("kept", 8)}


def test_catalogue(spark):
    routes = spark.createDataFrame([(k, name, "TRONCAL", head, line((10, lat), (10 + n, lat))) for k, (name, head, lat, n) in enumerate([("132", "x", 0.0, 1.0), ("2", "Retiro 132", 0.0005, 0.05), ("13", "y", 1.0, 1.0), (None, "z", 0.0, 0.05)])], f"route_id long, line string, branch string, headsign string, path {PATH}")
    rows = catalog.list_lines(routes, "132").collect()
    assert [(r.route_id, r.relevance, r.total) for r in rows] == [(0, 0, 2), (1, 2, 2)]
    assert [r.route_id for r in catalog.list_lines(routes).collect()] == [1, 2, 0, 3]
    near = {(r.route_id, r.other_id): r for r in catalog.similar_lines(routes, routes).collect()}
    assert (0, 2) not in near and near[1, 3].rank == 1 and near[1, 0].own == pytest.approx(1, abs=0.02) and near[1, 0].theirs < 0.06 and near[0, 1].theirs == pytest.approx(1, abs=0.02)
    with pytest.raises(InvalidField):
        catalog.similar_lines(routes, routes, limit=0)
    with pytest.raises(InvalidField):
        catalog.check_box((1, 0, 0, 0))
    stops = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.01, 0.0)], "stop_id string, lon double, lat double")
    rs = spark.createDataFrame([(1, 1, "a", line((0, 0), (0.01, 0))), (1, 2, "b", None), (2, 1, "a", None), (2, 2, "b", None)], f"route_id long, stop_seq int, stop_id string, path_to_next {PATH}")
    assert {r.route_id: r.simulable for r in catalog.export_lines(rs, stops).collect()} == {1: True, 2: False}
    assert catalog.line_detail(routes, rs, stops, 2).count() == 2 and catalog.line_detail(routes, rs, stops, 3).count() == 1
    assert clamp_page(None, None) == (50, 0) and clamp_page(1000, 3) == (200, 3)


def test_nearest_cell_names(spark):
    cells = spark.createDataFrame([("near", 0.0, 0.0), ("far", 10.0, 10.0)], "cell string, lon double, lat double")
    stops = spark.createDataFrame([("a", "A", 0.001, 0.0), ("b", "B", 0.001, 0.0)], "stop_id string, name string, lon double, lat double")
    assert {r.cell: r.name for r in transfers.name_cells(cells, stops).collect()} == {"near": "A", "far": "A"}


# streets and routing


def test_streets(spark):
    tags = [{"highway": "primary", "oneway": "-1"}, {"highway": "footway"}, {"highway": "service", "bus": "yes", "access": "no"}, {"highway": "primary", "access": "private"}, {"highway": "tertiary", "junction": "roundabout"}, {"highway": "residential"}]
    ways = spark.createDataFrame([(k, k, k, k + 1, line((k, 0), (k + 1, 0)), t) for k, t in enumerate(tags)], f"way_id long, edge_id long, source long, target long, path {PATH}, tags map<string,string>")
    edges = {r.edge_id: r for r in streets.directed_edges(streets.usable_ways(ways)).collect()}
    assert set(edges) == {0, 2, 4, 5} and (edges[0].source, edges[0].target, edges[0].reverse_cost) == (1, 0, -1) and edges[4].reverse_cost == -1 and edges[5].reverse_cost == edges[5].cost
    vertices = spark.createDataFrame([(k, float(k), 0.0) for k in range(8)], "id long, lon double, lat double")
    kept, kept_edges = streets.street_graph(ways, vertices)
    assert sorted(r.id for r in kept.collect()) == [4, 5, 6] and kept_edges.count() == 2
    assert streets.network_problems(kept, kept_edges).count() == 0
    with pytest.raises(ValueError):
        streets.require_sound(streets.network_problems(kept.limit(0), kept_edges))
    assert streets.coverage(kept_edges).count() == 2 and streets.touching(kept_edges, kept).count() == 3


def test_turn_restrictions(spark):
    e = spark.createDataFrame([(1, 10, 1, 5, 1.0, -1.0), (2, 20, 5, 2, 1.0, 1.0), (3, 30, 5, 3, 1.0, -1.0), (4, 40, 5, 4, 1.0, 1.0)], "edge_id long, way_id long, source long, target long, cost double, reverse_cost double")
    member = lambda a, b: [{"type": "w", "ref": a, "role": "from"}, {"type": "n", "ref": 5, "role": "via"}, {"type": "w", "ref": b, "role": "to"}]
    rel_rows = [(1, {"restriction": "no_left_turn"}, member(10, 20)), (2, {"restriction": "only_straight_on"}, member(20, 30)), (3, {"restriction": "no_u_turn", "restriction:bus": "none"}, member(10, 30)), (4, {"restriction": "no_left_turn"}, member(10, 99)), (5, {"restriction": "no_left_turn"}, member(10, 40)[:2])]
    r = spark.createDataFrame(rel_rows, "relation_id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>")
    got = {(x.from_edge, x.to_edge) for x in streets.turn_restrictions(r, e).collect()}
    assert got == {(1, 2), (2, 2), (2, 4)}


def grid_edges(n=4, step=0.002):
    rows, k = [], 0
    at = lambda x, y: x * n + y
    for x in range(n):
        for y in range(n):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < n and y + dy < n:
                    p = [(x * step, y * step), ((x + dx) * step, (y + dy) * step)]
                    d = paths.length_m(np.array(p))
                    rows.append((k, at(x, y), at(x + dx, y + dy), d, d, d / 5, d / 5, line(*p)))
                    k += 1
    return rows


def test_dijkstra_with_turns():
    g = routing.Graph()
    for edge, s, t, c, r in ((1, 1, 2, 1, 1), (2, 2, 3, 1, 1), (3, 2, 4, 1, 1), (4, 4, 3, 1, -1)):
        g.add(edge, s, t, c, r)
    assert g.route((1, 0.0), (2, 1.0))["edges"] == [(1, 1), (2, 1)]
    g.forbidden.add((1, 2, 2))
    found = g.route((1, 0.0), (2, 0.5))
    assert found["edges"] == [(1, 1), (3, 1), (4, 1), (2, -1)] and found["cost"] == pytest.approx(3.5)
    assert g.route((1, 0.25), (1, 0.75))["cost"] == pytest.approx(0.5)
    assert g.route((4, 0.5), (4, 0.25))["edges"] == [(4, 1), (2, -1), (3, 1), (4, 1)]  # around the block
    g.forbidden.add((4, 2, 3))
    assert g.route((4, 0.5), (4, 0.25)) is None
    assert routing.route_waypoints(g, [(1, 0.0), (1, 0.0), (3, 1.0)])[0]["cost"] == 0
    with pytest.raises(InvalidField):
        routing.route_waypoints(g, [(1, 0.0)])


def test_dijkstra_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(15):
        n, g = 12, routing.Graph()
        w = {}
        for k in range(40):
            s, t = (int(x) for x in rng.choice(n, 2, replace=False))
            c, r = float(rng.uniform(1, 9)), float(rng.uniform(1, 9)) if rng.random() < 0.6 else -1.0
            g.add(k, s, t, c, r)
            w[k] = (s, t, c, r)
        # plain Bellman-Ford over directed edges, without turning back on an edge
        states = {(k, 1): c for k, (_, _, c, _) in w.items()} | {(k, -1): r for k, (_, _, _, r) in w.items() if r >= 0}
        best = {(0, 1): states[0, 1]} | ({(0, -1): states[0, -1]} if (0, -1) in states else {})
        best = {s: states[s] for s in best}
        start = {(0, 1): states[0, 1] * 0.5} | ({(0, -1): states[0, -1] * 0.5} if (0, -1) in states else {})
        dist = dict(start)
        for _ in range(80):
            for a, da in list(dist.items()):
                head = w[a[0]][1] if a[1] > 0 else w[a[0]][0]
                for b, cb in states.items():
                    tail = w[b[0]][0] if b[1] > 0 else w[b[0]][1]
                    if tail == head and b[0] != a[0] and da + cb < dist.get(b, 1e18) - 1e-12 and b[0] != 0:
                        dist[b] = da + cb
        for goal in range(1, 40):
            ends = [dist[goal, s] - states[goal, s] * 0.5 for s in (1, -1) if (goal, s) in dist]
            got = g.route((0, 0.5), (goal, 0.5))
            if ends:
                assert got is not None and got["cost"] <= min(ends) + 1e-9
            if got:
                for a, b in zip(got["edges"], got["edges"][1:]):
                    assert g.head(*a) == (w[b[0]][0] if b[1] > 0 else w[b[0]][1]) and a[0] != b[0]


def test_solve_pairs(spark):
    cols = f"edge_id long, source long, target long, cost double, reverse_cost double, seconds double, reverse_seconds double, path {PATH}"
    edges = spark.createDataFrame(grid_edges(), cols)
    asked = spark.createDataFrame([(1, -1.0, -1.0, 1.0, 1.0)], "request_id long, min_lon double, min_lat double, max_lon double, max_lat double")
    local = routing.local_edges(edges, asked)
    pairs = spark.createDataFrame([(1, "p", 0, 0.5, 3, 0.5), (1, "u", None, None, 3, 0.5)], "request_id long, pair_id string, from_edge long, from_fraction double, to_edge long, to_fraction double")
    got = {r.pair_id: r for r in routing.solve_pairs(local, pairs).collect()}
    assert got["p"].state == "reached" and got["p"].cost > 0 and len(got["p"].path) >= 2 and got["u"].state == "unmatched"
    blocked = local.withColumns({"seconds": F.lit(-1.0), "reverse_seconds": F.lit(-1.0)})
    assert {r.pair_id: r.state for r in routing.solve_pairs(blocked, pairs).collect()}["p"] == "no_coverage"


def test_prices_and_snapping(spark):
    edges = spark.createDataFrame([(1, "primary", 111.0, 111.0, line((0, 0), (0.001, 0))), (2, "primary", 111.0, -1.0, line((0, 0.001), (0.001, 0.001))), (3, "minor", 111.0, 111.0, line((1, 1), (1.001, 1)))], f"edge_id long, kind string, cost double, reverse_cost double, path {PATH}")
    traffic = spark.createDataFrame(
        [("a", "primary", "one_side", 36.0, True, False, line((0, 0.00005), (0.001, 0.00005)))] + [(f"n{k}", "primary", "full", 10.0 + k, True, False, line((0, 0.0015 + k * 1e-4), (0.001, 0.0015 + k * 1e-4))) for k in range(2)] + [("z", "primary", "full", 99.0, True, True, line((0, 0.001), (0.001, 0.001)))],
        f"source_id string, road_category string, road_coverage string, speed_kph double, has_speed boolean, closure boolean, path {PATH}",
    )
    got = {r.edge_id: r for r in routing.priced_edges(edges, traffic).collect()}
    assert got[1].source_of_speed == "traffic" and got[1].seconds == pytest.approx(11.1) and got[1].reverse_seconds == pytest.approx(111 / (11 / 3.6))
    assert got[2].source_of_speed == "nearby" and got[2].reverse_seconds == -1 and got[3].source_of_speed == "default"
    assert routing.trace(routing.priced_edges(edges, traffic)).count() == 3
    points = spark.createDataFrame([("a", 0.0005, 0.0001, None), ("b", 0.0005, 0.00001, 0.0), ("c", 5.0, 5.0, None), ("d", 0.0005, 0.001, None)], "point_id string, lon double, lat double, heading double")
    snapped = {r.point_id: r for r in routing.snap(points, edges.withColumn("blocked", F.col("edge_id") == 2)).collect()}
    assert snapped["a"].edge_id == 1 and snapped["a"].fraction == pytest.approx(0.5) and not snapped["b"].matched and not snapped["c"].matched and not snapped["d"].matched


def link(seconds, edges=(1,), departure=0.0, arrival=0.0):
    return {"seconds": seconds, "edges": edges, "departure": departure, "arrival": arrival}


def test_selector():
    every = {(i, j): link(10.0 * (j - i)) for i in range(4) for j in range(i + 1, 4)}
    assert routing.select_stops(["required", "optional", "optional", "required"], every, "stops")["kept"] == [0, 1, 2, 3]
    fast = every | {(0, 3): link(5.0)}
    assert routing.select_stops(["required", "optional", "optional", "required"], fast, "time")["kept"] == [0, 3]
    assert routing.select_stops(["required", "optional", "required", "required"], fast, "time")["kept"] == [0, 1, 2, 3]
    assert routing.select_stops(["required", "forced", "optional", "required"], every, "stops")["kept"] == [0, 2, 3]
    back = every | {(1, 3): link(1.0, departure=180.0), (0, 1): link(1.0, arrival=0.0)}
    assert routing.select_stops(["required", "optional", "forced", "required"], back, "stops")["kept"] == [0, 3]
    assert routing.select_stops(["required", "required"], {}, "time") is None
    with pytest.raises(InvalidField):
        routing.select_stops(["required"], {}, "luck")


def test_reconstruct_and_cut_rules():
    route = np.array([[0, 0], [1, 0], [2, 0]], dtype=float)
    new = routing.reconstruct(route, [(0.25, 0.75, np.array([[0.5, 0], [1, 1], [1.5, 0]]))])
    assert new.tolist() == [[0, 0], [0.5, 0], [1, 1], [1.5, 0], [2, 0]]
    for bad in (np.zeros((1, 2)), np.zeros((2, 2)), np.array([[0, 0], [1, 0]]), np.array([[0, 0], [np.nan, 0]])):
        with pytest.raises(InvalidField):
            routing.check_cut(bad)


def test_plan_detour(spark):
    cols = f"edge_id long, source long, target long, cost double, reverse_cost double, seconds double, reverse_seconds double, path {PATH}"
    edges = spark.createDataFrame(grid_edges(5), cols)
    row = lambda k, cut: (k, "stops", line((0, 0), (0.002, 0), (0.004, 0), (0.006, 0), (0.008, 0)), cut, line((0, 0), (0.0045, 0.0), (0.008, 0)))
    requests = spark.createDataFrame([row(1, line((0.005, -0.0003), (0.005, 0.0003))), row(2, line((0.5, 0.5), (0.5001, 0.5)))], f"request_id long, criterion string, path {PATH}, cut {PATH}, stops {PATH}")
    got = {r.request_id: r for r in routing.plan_detours(requests, edges, policy=DetourPolicy(optional_m=100.0)).collect()}
    assert got[2].state == "unaffected" and got[1].state == "planned"
    assert got[1].kept[0] == 0 and got[1].kept[-1] == 2
    new = paths.as_array(got[1].path)
    assert paths.distance_to_path(paths.densify(new, 5.0)[0], np.array([[0.005, -0.0003], [0.005, 0.0003]])).min() > 5
    classes = routing.classify_stops(spark.createDataFrame([(0.0, 0.0, line((0, 0), (0.001, 0))), (0.0, 0.002, line((0, 0), (0.001, 0))), (1.0, 0.0, line((0, 0), (0.001, 0)))], f"lon double, lat double, cut {PATH}"))
    assert [r.availability for r in classes.orderBy("cut_m").collect()] == ["forced", "optional", "required"]
    lost = spark.createDataFrame([(1, 1, 5.0, 6.0)], "route_id long, stop_order int, as_origin double, as_dest double")
    plans = spark.createDataFrame([(1, [1, 2])], "request_id long, omitted array<int>")
    assert {r.stop_order: r.as_dest for r in routing.uncovered_stops(plans, lost).collect()} == {1: 6.0, 2: 0.0}


# audits and identities


def test_audits(spark):
    d = spark.createDataFrame([("r", k, s, s == "own", m) for k in range(4) for s, m in (("own", 50.0 if k < 1 else 500.0), ("x", 60.0))], "route string, obs_id long, shape_id string, assigned boolean, distance_m double")
    r = audit.shape_proximity(d).first()
    assert (r.near_assigned, r.near_any, r.lost) == (1, 4, 0.75) and audit.ranked_shapes(d).where("rank = 1").first().shape_id == "x"
    s = spark.createDataFrame([(None, None, None), ("f", None, None), ("f", "s", 10.0), ("f", "s", None)], "feed_route string, shape_id string, distance_m double")
    assert {x.status: x.positions for x in audit.position_status(s).collect()} == {"unmapped": 1, "no_shape": 1, "near": 1, "far": 1}
    c = audit.cadence(spark.createDataFrame([(1, 0.0), (2, 60.0), (3, 180.0)], "capture_id long, received_at double")).first()
    assert (c.median_gap, c.max_gap) == (90, 120)
    e = spark.createDataFrame([("a", "b", 0.0, 10.0, 5.0, "x", 50.0), ("b", "a", 0.0, 1.0, None, None, 500.0)], "a string, b string, first_at double, last_at double, closed_at double, reason string, min_distance double")
    assert {x.rule: x.broken for x in audit.bunching_integrity(e).collect()} == {"order": 0, "radius": 1, "closed before last": 1, "reason": 0, "pair order": 1}
    runs = spark.createDataFrame([(10, 5, 3, 2, 1), (10, 10, 0, 0, 5)], "observations long, matched long, ambiguous long, unmatched long, passages long")
    t = audit.coverage_summary(runs).first()
    assert t.consistent and t.at_least_5 == 1 and t.passages == 6


def test_identity(spark):
    rng = np.random.default_rng(0)
    shapes = spark.createDataFrame([("a", line(*[(x / 100, 0.0) for x in range(11)])), ("b", line(*[(x / 100, 0.005) for x in range(11)])), ("back", line(*[(x / 100, 0.0) for x in range(10, -1, -1)]))], f"shape_id string, path {PATH}")
    rows = [(k, "i", float(x), float(y), 90.0) for k, (x, y) in enumerate(zip(rng.uniform(0, 0.1, 300), rng.normal(0, 0.0002, 300)))]
    p = spark.createDataFrame(rows, "obs_id long, identity string, lon double, lat double, heading double")
    one, two = identity.sampled(p, 100, "a"), identity.sampled(p, 100, "b")
    assert one.count() == 100
    score = [identity.scores(identity.nearest_edges(s, shapes), s) for s in (one, two)]
    best = identity.classify(*score).first()
    assert (best.shape_id, best.state) == ("a", "accepted") and best.score > 0.9
    assert identity.candidate_shapes(p, shapes).where("rank = 1").first().shape_id in ("a", "back")
    assert {r.state for r in identity.classify(score[0], least=1.1).collect()} == {"rejected"}
