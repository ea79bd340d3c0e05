"""Distance joins and nearest rows that don't pay for far pairs."""

import math
import random

import pytest

from wayframe.functions.geo import RADIUS_M
from wayframe.operators import relational as rel


def metres(p, q):
    (a, b), (c, d) = p, q
    h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def sides(spark, left, right):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(left)], "a long, lon double, lat double"), spark.createDataFrame([(k, *p) for k, p in enumerate(right)], "b long, r_lon double, r_lat double")


@pytest.mark.parametrize("lon,lat,radius", [(179.99, 10.0, 3000.0), (0.0, 89.99, 3000.0), (-58.4, -34.6, 500.0), (20.0, 5.0, 9.0e6)])
def test_bounds_lose_no_pair(spark, lon, lat, radius):
    rng = random.Random(1)
    wide = 60.0 if radius > 1e6 else 0.05
    place = lambda: ((lon + rng.uniform(-wide, wide) / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-wide, wide))))
    left, right = [place() for _ in range(80)], [place() for _ in range(80)]
    one, two = sides(spark, left, right)
    got = rel.distance_join(one, two, radius)
    want = {(a, b) for a, p in enumerate(left) for b, q in enumerate(right) if metres(p, q) <= radius}
    assert {(r.a, r.b) for r in got.select("a", "b").collect()} == want and want


def test_pairs_are_decided_without_trigonometry(spark):
    one, two = sides(spark, [(0.0, 0.0)], [(0.0, 0.001)])
    join = next(line for line in rel.distance_join(one, two, 4000.0)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line)
    assert join.index("__r_cos") < join.index("ASIN")  # the bounds come before the distance


def test_first_ring_follows_the_density(spark, monkeypatch):
    rng = random.Random(2)
    left, right = [(rng.uniform(-58.9, -58.0), rng.uniform(-34.9, -34.3)) for _ in range(60)], [(rng.uniform(-58.9, -58.0), rng.uniform(-34.9, -34.3)) for _ in range(3000)]
    one, two = sides(spark, left, right)
    radii, real = [], rel.distance_join
    monkeypatch.setattr(rel, "distance_join", lambda a, b, radius, **more: radii.append(radius) or real(a, b, radius, **more))
    got = {r.a: r.b for r in rel.nearest(one, two, ["a"], 6000.0, ["b"]).collect()}
    assert got == {a: min(range(len(right)), key=lambda b: metres(p, right[b])) for a, p in enumerate(left)}
    assert radii[0] < 2000  # some four rows, not hundreds
