"""Itineraries of pairs with too many are counted and not formed, and walks are not written."""

import random

from pyspark.sql import functions as F

from wayframe import registry
from wayframe.plans import transfers
from wayframe.policy import TransferPolicy


def test_counts_are_those_of_the_itineraries(spark):
    rng = random.Random(3)
    at = {k: (-58.4 + rng.uniform(0, 0.05), -34.6 + rng.uniform(0, 0.05)) for k in range(60)}
    served = [(r, rng.randrange(60), s) for r in range(20) for s in range(1, 7)]  # a route may stop twice at a place
    stops = spark.createDataFrame([(k, *p) for k, p in at.items()], "stop_id long, lon double, lat double")
    route_stops = spark.createDataFrame(served, "route_id long, stop_id long, stop_seq int")
    cells = spark.createDataFrame([(f"c{k}", *at[k]) for k in range(0, 60, 5)], "cell string, lon double, lat double")
    policy = TransferPolicy(walk_m=500.0, access_m=900.0)
    service = transfers.cell_service(cells, route_stops, stops, policy)
    left = cells.select(F.col("cell").alias("origin")).crossJoin(cells.select(F.col("cell").alias("dest")))
    walks = transfers.transfer_points(route_stops, stops, policy, seqs=True)
    reach = {(r.cell, r.route_id): (r.min_seq, r.max_seq) for r in service.collect()}
    want, places = {}, sorted({c for c, _ in reach})
    for w in transfers.transfer_points(route_stops, stops, policy).collect():
        off = max(s for r, k, s in served if (r, k) == (w.r1, w.from_stop))
        on = min(s for r, k, s in served if (r, k) == (w.r2, w.to_stop))
        for o in places:
            for d in places:
                if (o, w.r1) in reach and (d, w.r2) in reach and off > reach[o, w.r1][0] and on < reach[d, w.r2][1]:
                    want[o, d] = want.get((o, d), 0) + 1
    every = route_stops.select("route_id").distinct()
    assert {(r.origin, r.dest): r.n for r in transfers.count_itineraries(left, service, walks, every).collect()} == want and len(want) > 50
    formed = transfers.itineraries(left, service, walks).groupBy("origin", "dest").count()
    assert {(r.origin, r.dest): r["count"] for r in formed.collect()} == want


def test_walks_are_not_written(spark, monkeypatch):
    written, real = [], transfers.checkpointed
    monkeypatch.setattr(transfers, "checkpointed", lambda df: written.append(set(df.columns)) or real(df))
    monkeypatch.setattr(transfers, "PART_ROUTES", (2,))
    registry.QUERIES["e13_transfer_ranking"](spark, "/root/testdata/sf0.001").collect()
    assert written and not [c for c in written if {"r1", "r2"} <= c and "hour" not in c]
