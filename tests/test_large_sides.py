"""A side whose rows are copied is not broadcast: the estimate by its file does not see the copies."""

import re

import pytest

from wayframe import registry


def broadcast_copies(frame):
    """Broadcasts in the first plan with an explode below them."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: re.search(r"[A-Za-z(*]", line).start() if re.search(r"[A-Za-z(*]", line) else 0
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[k + 1 :]:
                if depth(below) <= depth(line):
                    break
                if "Generate explode" in below:
                    found.append(below.strip())
    return found


@pytest.mark.parametrize("name", ["d02_cell_candidates", "d03_cell_assignment", "d12_contributions", "d13_simulated_routes", "d13_simulation", "d05_pair_demand", "d11_revenue", "e17_precomputed", "j10_distance_join", "r05_priced_edges"])
def test_no_broadcast_of_copied_rows(spark, data, name):
    assert not broadcast_copies(registry.QUERIES[name](spark, data))


def test_shapes_of_equal_cells_are_probed_once(spark):
    """Many shapes of the same cells give their first ids, with every observation counted once, from few joined rows."""
    from wayframe.plans import identity

    here = "array(struct(0.0001D AS lon, 0.0001D AS lat), struct(0.0007D AS lon, 0.0001D AS lat))"
    shapes = spark.range(500).selectExpr("id AS shape_id", f"{here} AS path")
    rows = [(1, k, 0.0002, 0.0002) for k in range(20)] + [(1, 0, 0.0008, 0.0002), (1, None, 0.0002, 0.0002), (2, 99, 0.5, 0.5)]
    positions = spark.createDataFrame(rows, "identity long, obs_id long, lon double, lat double")
    out = identity.candidate_shapes(positions, shapes, 0.0005, 5)
    assert [(r.identity, r.shape_id, r.hits, r["rank"]) for r in out.orderBy("rank").collect()] == [(1, k, 20, k + 1) for k in range(5)]
    plan = out._jdf.queryExecution().toString()
    assert "class" in plan  # shapes enter after the count, by their class
