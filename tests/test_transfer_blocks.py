"""Shortest walks are formed within blocks of routes: no row per pair of stops is shuffled, and none is lost."""

import math
import random

import pytest

from wayframe.functions.geo import RADIUS_M
from wayframe.plans import transfers
from wayframe.policy import TransferPolicy


def metres(p, q):
    (a, b), (c, d) = p, q
    h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("small", [False, True])
def test_shortest_walks(spark, monkeypatch, small):
    # the functions travel by name to the workers, so that only what the driver reads can be made smaller
    monkeypatch.setattr(transfers, "BLOCK_STOPS", 40 if small else 100_000)
    rng = random.Random(5)
    at = {f"s{k:03}": ((179.99 + rng.uniform(0, 0.02) + 180) % 360 - 180, rng.uniform(0, 0.02)) for k in range(150)}
    at["s150"] = at["s151"] = (0.0, 0.0)  # a tie goes to the smaller id
    served = {(rng.randrange(25), s) for s in at for _ in range(2)} | {(90, "s150"), (90, "s151"), (91, "s151"), (91, "s150")}
    stops = spark.createDataFrame([(s, *p) for s, p in at.items()] + [("none", None, None)], "stop_id string, lon double, lat double")
    rows = spark.createDataFrame([*served, (3, "none")], "route_id long, stop_id string")
    want = {}
    for r1, s in served:
        for r2, t in served:
            d = metres(at[s], at[t])
            if r1 != r2 and d <= 300:
                want[r1, r2] = min(want.get((r1, r2), (math.inf, "", "")), (d, s, t))
    out = transfers.transfer_points(rows, stops, TransferPolicy(walk_m=300.0))
    got = {(r.r1, r.r2): (r.walk_m, r.from_stop, r.to_stop) for r in out.collect()}
    assert got == {k: (round(d), s, t) for k, (d, s, t) in want.items()} and len(got) == out.count()
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()  # no shuffle by pairs of routes
