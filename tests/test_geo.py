import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayframe.functions import geo
from wayframe.functions.text import branch_of, escape_like, line_of, unescape_percent
from wayframe.operators import paths
from wayframe.operators import relational as rel


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit_path(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


def test_haversine_and_midpoint(spark):
    lon, lat = geo.midpoint(*map(F.lit, (179.0, 0.0, -179.0, 0.0)))
    r = one(spark, geo.haversine(*map(F.lit, (0.0, 0.0, 1.0, 0.0))).alias("d"), F.abs(lon).alias("m"), lat.alias("y"))
    assert r.d == pytest.approx(geo.DEGREE_M)
    assert r.m == pytest.approx(180) and r.y == pytest.approx(0)


def test_point_edge_distance_falls_back_to_ends(spark):
    d = lambda x, y: geo.point_edge_distance(*map(F.lit, (x, y, 0.0, 0.0, 1.0, 0.0)))
    r = one(spark, d(0.5, 0.1).alias("a"), d(-1.0, 0.0).alias("b"), d(2.0, 0.0).alias("c"))
    assert r.a == pytest.approx(0.1 * geo.DEGREE_M, rel=1e-4)
    assert r.b == pytest.approx(geo.DEGREE_M) and r.c == pytest.approx(geo.DEGREE_M)


def test_locate_length_and_hash_agree_with_numpy(spark):
    pts = [(0, 0), (1, 0), (1, 1), (2, 1)]
    p = lit_path(pts)
    r = one(spark, geo.locate(F.lit(1.2), F.lit(0.4), p).alias("f"), geo.path_length(p).alias("n"), geo.valid_path(p).alias("v"), geo.path_hash(p).alias("h"), F.size(geo.join_paths(F.array(p, lit_path([(2, 1), (3, 1)])))).alias("j"))
    a = np.array(pts, dtype=float)
    assert r.f == pytest.approx(paths.locate(a, (1.2, 0.4)))
    assert r.n == pytest.approx(paths.length_m(a))
    assert r.v and len(r.h) == 32 and r.j == 5


def test_align_path(spark):
    ends = [F.lit(x) for x in (0.0, 0.0, 1.0, 0.0)]
    near, bad = geo.align_path(lit_path([(0.0001, 0), (0.5, 0.1), (1, 0)]), *ends, 250.0)
    far, problem = geo.align_path(lit_path([(0.1, 0), (1, 0)]), *ends, 250.0)
    back, none = geo.align_path(lit_path([(1, 0), (0, 0)]), *ends, 250.0)
    r = one(spark, near[0]["lon"].alias("x"), bad.alias("bad"), problem.alias("problem"), back[0]["lon"].alias("b"), none.alias("none"))
    assert r.x == 0.0 and r.bad is None and r.problem.startswith("ends") and r.b == 1.0 and r.none is None


def test_hex_grid_covers_neighbours(spark):
    grid = geo.HexGrid()
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y)) for x, y in zip(rng.uniform(-58.9, -58, 300), rng.uniform(-34.9, -34.3, 300))]
    near = [(x + float(a), y + float(b)) for (x, y), a, b in zip(rows, rng.uniform(-0.004, 0.004, 300), rng.uniform(-0.003, 0.003, 300))]
    df = spark.createDataFrame([(*a, *b) for a, b in zip(rows, near)], "x double, y double, x2 double, y2 double")
    out = df.select(grid.cell(F.col("x"), F.col("y")).alias("a"), grid.cell(F.col("x2"), F.col("y2")).alias("b"), geo.haversine(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("d"))
    out = out.withColumn("in", F.array_contains(grid.disk(F.col("a")), F.col("b"))).collect()
    assert all(r["in"] for r in out if r.d < 461)  # one edge away is at most the next cell
    assert len({r.a for r in out}) > 100


@settings(max_examples=12, deadline=None)
@given(st.floats(-179.99, 179.99), st.floats(-85, 85), st.floats(50, 20_000), st.integers(0, 10_000))
def test_distance_join_is_complete(spark, lon, lat, radius, seed):
    rng = np.random.default_rng(seed)
    spread = 3 * radius / geo.DEGREE_M
    wrap = lambda v: ((v + 180) % 360) - 180
    make = lambda: [(k, float(wrap(lon + x / max(math.cos(math.radians(lat)), 0.05))), float(np.clip(lat + y, -89.9, 89.9))) for k, (x, y) in enumerate(rng.uniform(-spread, spread, (40, 2)))]
    a, b = make(), make()
    got = rel.distance_join(spark.createDataFrame(a, "a long, lon double, lat double"), spark.createDataFrame(b, "b long, r_lon double, r_lat double"), radius).select("a", "b").collect()
    want = {(i, j) for i, x, y in a for j, u, v in b if float(paths.haversine(np.array([x, y]), np.array([u, v]))) <= radius}
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want


def test_text(spark):
    r = one(spark, line_of(F.lit("132A")).alias("l"), branch_of(F.lit("132A")).alias("b"), branch_of(F.lit("7")).alias("t"), line_of(F.lit("ab 2")).alias("x"), line_of(F.lit("-")).alias("n"))
    assert (r.l, r.b, r.t, r.x, r.n) == ("132", "A", "TRONCAL", "AB", None)
    assert escape_like("50%_a\\") == "50\\%\\_a\\\\" and unescape_percent("a%20%b%2c%") == "a b,"


def test_paths():
    line = np.array([[0, 0], [1, 0], [2, 0]], dtype=float)
    assert paths.substring(line, 0.25, 0.75).tolist() == [[0.5, 0], [1, 0], [1.5, 0]]
    assert paths.substring(line, 0.75, 0.25).tolist() == [[1.5, 0], [1, 0], [0.5, 0]]
    loop = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], dtype=float)
    f = paths.monotone_fractions(loop, [(0, 0), (1, 1), (0, 0.02), (0, 0)])
    assert f == sorted(f) and f[1] == pytest.approx(0.5) and f[-1] == pytest.approx(1)
    parts = paths.inside_parts(np.array([[0, 0], [0.01, 0]], dtype=float), np.array([[0.005, -0.001], [0.005, 0.001]]), 100.0)
    assert len(parts) == 1 and parts[0][0] < 0.5 < parts[0][1]
    assert paths.overlap_m(line * 0.01, line * 0.01, 50) == pytest.approx(paths.length_m(line * 0.01))
