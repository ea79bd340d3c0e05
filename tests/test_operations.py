"""State machines of bunching and bottlenecks, in batch and as streams."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayframe.policy import BottleneckPolicy, BunchingPolicy
from wayframe.streaming import bottlenecks as bn
from wayframe.streaming import bunching as bu
from wayframe.streaming import ingest, producer

P = BunchingPolicy()


def sample(t, scope="s", v=5.0):
    return {"t": float(t), "v": v, "scope": scope}


def opened(t=0.0, d=100.0):
    m = bu.Machine("s", P)
    m.step(t, False, True, sample(t), sample(t), d)
    return m


@pytest.mark.parametrize("d, n", [(99.99, 1), (100.0, 1), (100.01, 0)])
def test_radius_is_inclusive(d, n):
    assert len(opened(d=d).rows()) == n


def test_both_times_must_advance():
    m = opened()
    m.step(60, False, True, sample(60), sample(0), 90)
    assert m.open.observations == 1 and m.open.missing == 0
    m.step(61, False, True, sample(60), sample(60), 90)
    assert m.open.observations == 2 and m.open.min_distance == 90
    m.step(120, False, False, sample(60), sample(60), 90)
    assert m.open.observations == 2


def test_separation_needs_new_samples():
    m = opened()
    m.step(60, False, True, sample(60), sample(0), 250)
    assert m.open
    m.step(61, False, True, sample(60), sample(60), 250)
    assert m.done[0].reason == "separated" and m.open is None


def test_partial_changes_nothing():
    m = opened()
    m.step(600, True, True, sample(600), sample(600), 250)
    assert m.open.observations == 1
    assert not bu.Machine("s", P).rows()


def test_missing_tolerance_counts_novel_captures():
    m = opened()
    m.step(60, False, True, sample(60), None, None)
    assert m.open.missing == 1
    m.step(120, False, False, sample(60), None, None)
    assert m.open.missing == 1
    m.step(180, False, True, sample(120), None, None)
    assert m.done[0].reason == "missing"


def test_expired_does_not_bridge_a_gap():
    m = opened()
    m.step(360, False, True, sample(360), sample(360), 80)
    assert m.done[0].reason == "expired" and m.done[0].closed_at == 300 and m.open.observations == 1


def test_identity_change_and_cached_samples():
    m = opened()
    m.step(60, False, True, sample(60, "other"), sample(60), 100)
    assert m.done[0].reason == "identity_changed"
    m = opened()
    m.step(60, False, True, sample(0), None, None)
    m.step(120, False, True, sample(0), None, None)
    assert m.done[0].reason == "missing"
    m.step(150, False, True, sample(0), sample(0), 50)
    assert m.open is None  # the samples of the closed episode can't open another
    m.step(180, False, True, sample(170), sample(170), 50)
    assert m.open


def test_future_skew_closes_not_before_last():
    m = bu.Machine("s", P)
    m.step(0, False, True, sample(30), sample(30), 50)
    m.step(10, False, True, sample(40), sample(40), 250)
    assert m.done[0].closed_at >= m.done[0].last_at


def test_fold_matches_machine_and_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    steps = []
    for k in range(40):
        t = 60.0 * k
        steps.append(("s", "a", "b", t, bool(k % 9 == 8), True, float(rng.uniform(20, 160)), t, t if k % 5 else None, 5.0, 6.0, "s", "s"))
    schema = "scope string, a string, b string, received_at double, partial boolean, novel boolean, distance double, at_a double, at_b double, speed_a double, speed_b double, scope_a string, scope_b string"
    m = bu.Machine("s", P)
    for r in steps:
        side = lambda t, v: None if t is None else {"t": t, "v": v, "scope": "s"}
        m.step(r[3], r[4], r[5], side(r[7], r[9]), side(r[8], r[10]), r[6])
    want = [e.row() for e in m.done]
    assert len(want) > 3
    for k, part in enumerate((steps[:13], steps[13:30], steps[30:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = ingest.bunching_stream(stream).writeStream.format("memory").queryName("episodes").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r[c] for c in bu.COLUMNS) for r in spark.table("episodes").where("closed_at IS NOT NULL").orderBy("first_at").collect()]
    assert [g[4] for g in got] == [w[4] for w in want]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[5] for g in got] == [w[5] for w in want]


def test_snapshot_pipeline(spark):
    c = spark.createDataFrame([(k, 60.0 * k, False) for k in range(4)], "capture_id long, received_at double, partial boolean")
    p = spark.createDataFrame([(k, v, "s", 60.0 * k, 10.0 + (0.0001 if v == "b" else 0.0), 0.0, 5.0) for k in range(4) for v in "ab"], "capture_id long, vehicle string, scope string, observed_at double, lon double, lat double, speed_mps double")
    snaps = bu.snapshot(c, p)
    out = bu.fold_episodes(bu.key_steps(snaps, bu.novelty(snaps, c))).collect()
    assert len(out) == 1 and out[0].observations == 4 and out[0].closed_at is None
    h = bu.health(spark.createDataFrame([(1, 1.0, 10), (2, 2.0, 6), (3, 3.0, 7), (4, 4.0, 0)], "capture_id long, received_at double, vehicles long")).orderBy("capture_id").collect()
    assert [r.partial for r in h] == [False, True, False, True]
    schema = "scope string, a string, b string, " + bu.EVENT
    raised = bu.backfill_speeds(spark.createDataFrame(out, schema), p.withColumn("speed_mps", F.lit(9.0))).first()
    assert raised.max_speed_a == 9.0 and raised.max_speed_b == 9.0


# bottlenecks


def test_layout():
    assert bn.sector_ends(3000, 500) == [500, 1000, 1500, 2000, 2500, 3000]
    assert bn.sector_ends(1249, 500) == [500, 1249] and bn.sector_ends(1250, 500) == [500, 1000, 1250] and bn.sector_ends(100, 500) == [100]


def obs(t, *progress, scope="s", vehicle="v"):
    return {"vehicle": vehicle, "scope": scope, "t": float(t), "candidates": [(float(p), 5.0) for p in progress]}


@pytest.mark.parametrize(
    "rows, states",
    [
        ([obs(0, 250), obs(60, 750, 2500)], "MM"),
        ([obs(0, 250, 2500), obs(60, 750, 2750), obs(120, 1250)], "MMM"),
        ([obs(0, 250), obs(60, 750, 1000)], "MA"),
        ([obs(0, 250, 1000), obs(60, 750, 1500)], "AA"),
        ([obs(0, 250), obs(181, 750, 2500)], "MA"),
        ([obs(0, 250), obs(60), obs(120, 750, 2500)], "MUA"),
        ([obs(0, 1000), obs(60, 250, 1500), obs(120, 500)], "MUM"),
    ],
)
def test_conservative_matching(rows, states):
    short = {"matched": "M", "resolved": "M", "ambiguous": "A", "unmatched": "U"}
    got = bn.match(rows, 3000)
    assert "".join(short[r["state"]] for r in got) == states
    assert got == bn.match(rows[::-1], 3000)


def at(t, p, **k):
    return obs(t, **k) | {"progress": p}


def test_passage_inside_one_interval():
    out = [r for r in bn.measure([at(0, 250.0), at(120, 1250.0)], [500, 1000, 1500]) if r[0] == "passage"]
    assert len(out) == 1
    _, _, sector, entered, exited, duration, kmh, inner, gap, same = out[0]
    assert (sector, entered, exited, duration, inner, gap, same) == (1, 30, 90, 60, 0, 120, True) and kmh == pytest.approx(30)


def test_passage_rejections():
    kinds = lambda rows: [r[1] for r in bn.measure(rows, [500, 1000, 1500]) if r[0] == "rejected"]
    assert kinds([at(0, 0.0), at(60, None)]) == ["unresolved_match"]
    assert kinds([at(0, 0.0), at(200, 600.0)]) == ["gps_gap"]
    assert kinds([at(0, 600.0), at(60, 500.0)]) == ["backwards"]
    assert kinds([at(0, 0.0), at(10, 1000.0)]) == ["implausible_speed"]
    assert kinds([at(0, 0.0), at(60, 100.0, scope="t")]) == ["scope_changed"]
    assert kinds([at(0, 1600.0)]) == ["outside_progress"]


def random_drive(seed, n=60):
    rng = np.random.default_rng(seed)
    t, p, rows = 0.0, 0.0, []
    for _ in range(n):
        rows.append((t, min(round(p, 6), 5000.0)))
        t += float(rng.choice([20, 60, 100, 200], p=[0.3, 0.4, 0.25, 0.05]))
        p += float(rng.uniform(-5, 400) if rng.random() < 0.95 else 0)
        p = max(p, 0)
    return rows


def test_relational_twin_agrees(spark):
    ends = bn.sector_ends(5000, 500)
    starts = [0.0, *ends[:-1]]
    drives = {f"v{s}": random_drive(s) for s in range(6)}
    df = spark.createDataFrame([(v, t, p) for v, rows in drives.items() for t, p in rows], "vehicle string, observed_at double, progress_m double")
    table = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(starts, ends))], "sector int, start_m double, end_m double")
    got = sorted((r.vehicle, r.sector, round(r.entered_at, 6), round(r.duration_s, 6)) for r in bn.passages_relational(df, table).collect())
    want = sorted((v, r[2], round(r[3], 6), round(r[5], 6)) for v, rows in drives.items() for r in bn.measure([at(t, p, vehicle=v) for t, p in rows], ends) if r[0] == "passage")
    assert len(want) > 20 and got == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 10_000))
def test_producer_equals_batch_for_any_captures(seed, cuts):
    rows = [{"vehicle": "v", "scope": "s", "shape_id": 1, "t": t, "candidates": [(p, 1.0)]} for t, p in random_drive(seed, 30)]
    policy, ends = BottleneckPolicy(), bn.sector_ends(5000, 500)
    batch = [r for r in bn.measure(bn.match(rows, 5000), ends) if r[0] == "passage"]
    rng = np.random.default_rng(cuts)
    capture = np.sort(rng.integers(0, 10, len(rows)))
    late = rng.random(len(rows)) < 0.2  # late rows inside the open period
    capture = np.where(late, np.minimum(capture + 1, 9), capture)
    # captures close enough together that absences never reach four in between
    used = {c: i for i, c in enumerate(sorted(set(capture.tolist())))}
    period, out = producer.Period(), []
    for c in range(len(used)):
        out += producer.advance(period, c, False, [r for r, k in zip(rows, capture) if used[k] == c], {1: 5000.0}, policy)
    assert not out
    for c in range(len(used), len(used) + 4):
        out += producer.advance(period, c, False, [], {1: 5000.0}, policy)
    assert [r[1:] for r in out if r[1] == "passage"] == batch
    assert not period.rows and producer.advance(period, 99, False, rows[:1], {1: 5000.0}, policy) == [] and period.late == 1


def test_produce_plan_equals_passages(spark):
    rows = [(k, f"v{s}", "s", 1, t, [(p, 1.0)], i // 3) for s in range(3) for i, (t, p) in enumerate(random_drive(s, 30)) for k in [s * 100 + i]]
    df = spark.createDataFrame(rows, "obs_id long, vehicle string, scope string, shape_id long, observed_at double, candidates array<struct<progress_m:double,distance_m:double>>, capture_id long")
    lengths = spark.createDataFrame([(1, 5000.0)], "shape_id long, length_m double")
    captures = spark.createDataFrame([(c, False) for c in range(20)], "capture_id long, partial boolean")
    a = bn.passages(df, lengths).where("kind = 'passage'").select("vehicle", "sector", "entered_at").collect()
    b = producer.produce(df, captures, lengths).where("kind = 'passage'").select("vehicle", "sector", "entered_at").collect()
    assert sorted(a) == sorted(b) and a
    assert bn.output_problems(bn.passages(df, lengths)).count() == 0


def test_candidates_find_both_branches_of_a_loop(spark):
    path = [(0.0, 0.0), (0.02, 0.0), (0.02, 0.0005), (0.0, 0.0005)]
    shapes = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in path])], "shape_id long, path array<struct<lon:double,lat:double>>")
    o = spark.createDataFrame([(1, "v", "s", 1, 0.0, 0.01, 0.00025), (2, "v", "s", 1, 1.0, 0.01, 0.5)], "obs_id long, vehicle string, scope string, shape_id long, observed_at double, lon double, lat double")
    out = {r.obs_id: r.candidates for r in bn.candidates(o, shapes).collect()}
    assert len(out[1]) == 2 and out[2] == []
    assert math.isclose(out[1][0].distance_m, out[1][1].distance_m, rel_tol=1e-3)
    sectors = bn.sector_paths(bn.layout(shapes.withColumn("length_m", F.lit(4500.0))), shapes.withColumn("length_m", F.lit(4500.0)))
    assert sectors.count() == 9


# ingestion


def test_ingest_batch_and_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    now = datetime(2026, 1, 10, 12)
    rows = [
        (1, "a", now, now - timedelta(minutes=1), "r", 0, 1.0, 2.0, 3.0), (1, "a", now, now - timedelta(minutes=1), "r", 0, 5.0, 2.0, 3.0), (1, "b", now, now - timedelta(days=8), "r", 0, 1.0, 2.0, 3.0),
        (1, "c", now, now + timedelta(minutes=2), "r", 0, 1.0, 2.0, 3.0), (1, "d", now, now, "x", 1, 1.0, 2.0, 3.0),
    ]
    schema = "capture_id long, vehicle string, received_at timestamp, observed_at timestamp, route string, direction int, lon double, lat double, speed_mps double"
    df = spark.createDataFrame(rows, schema)
    known = spark.createDataFrame([("r", 0, "f", 0, True)], "route string, direction int, feed_route string, feed_direction int, active boolean")
    empty = spark.createDataFrame([], "observed_day date, vehicle string, observed_at timestamp")
    new, counters = ingest.ingest_batch(empty, df, known)
    assert sorted((r.vehicle, r.lon) for r in new.collect()) == [("a", 1.0), ("d", 1.0)]
    c = counters.first()
    assert (c.received, c.admitted, c.outside, c.unmapped, c.inserted) == (5, 3, 2, 1, 2)
    again, _ = ingest.ingest_batch(new.select("observed_day", "vehicle", "observed_at"), df, known)
    assert again.count() == 0
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.position_stream(spark, str(tmp_path / "in"), schema), known)
    q = stream.writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == 4
    assert ingest.windowed_speeds(df).agg(F.sum("rows")).first()[0] == 5 and ingest.sessions(df).count() >= 3
