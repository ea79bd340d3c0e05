"""The summary of all pairs equals that of the pairs written out, without a row for each of them."""

import random
from statistics import median

import pytest

from wayframe.plans import routing
from wayframe.streaming import bunching


@pytest.mark.parametrize("part,bits,ranked", [(4096, 12, 1_000_000), (7, 4, 3)])
def test_pair_summary(spark, monkeypatch, part, bits, ranked):
    for name, value in (("PART", part), ("BITS", bits), ("RANKED", ranked), ("GROUP_ROWS", 50)):
        monkeypatch.setattr(bunching, name, value)
    rng = random.Random(3)
    rows = [(k % 4, "ab"[k % 3 == 0], f"v{k}", 10 + rng.uniform(0, 0.01), 20 + rng.uniform(0, 0.01)) for k in range(120)] + [(0, "c", "x", 1.0, 1.0), (0, "d", "y", 1.0, 1.0), (0, "d", "z", 1.0, 1.0)]
    snaps = spark.createDataFrame(rows, "capture_id long, scope string, vehicle string, lon double, lat double")
    want = {}
    for r in bunching.vehicle_pairs(snaps).collect():
        want.setdefault(r.scope, []).append(r.distance)
    got = {r.scope: r for r in bunching.pair_summary(snaps).collect()}
    assert got.keys() == want.keys() == {"a", "b", "d"}
    for scope, values in want.items():
        assert got[scope].pairs == len(values) and got[scope].nearest == pytest.approx(min(values), abs=1e-6) and got[scope].percentile == pytest.approx(median(values), abs=1e-6)


def test_snap_copies_points_and_runs_no_python(spark):
    edges = spark.sql("SELECT 1L AS edge_id, array(named_struct('lon', 0D, 'lat', 0D), named_struct('lon', 0.001D, 'lat', 0D), named_struct('lon', 0.001D, 'lat', 0.001D)) AS path, 1D AS reverse_cost, false AS blocked")
    points = spark.createDataFrame([(1, 0.0005, 0.0001, 90.0), (2, 0.001, 0.0005, 90.0), (3, 0.0011, 0.0005, None), (4, 0.1, 0.1, None)], "point_id long, lon double, lat double, heading double")
    out = routing.snap(points, edges)
    got = {r.point_id: r for r in out.collect()}
    assert [got[k].matched for k in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[1].fraction == pytest.approx(0.25) and got[1].snap_m == pytest.approx(11.12, abs=0.01) and got[3].fraction == pytest.approx(0.75)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
