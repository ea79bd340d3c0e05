"""Durable cycles, timers, and the worker's errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayframe.policy import BottleneckPolicy, BunchingPolicy
from wayframe.streaming import bottlenecks as bn
from wayframe.streaming import bunching as bu
from wayframe.streaming import ingest, producer
from wayframe.streaming.store import Conflict, Store

COLUMNS = "obs_id long, vehicle string, scope string, shape_id long, observed_at double, candidates array<struct<progress_m:double,distance_m:double>>, capture_id long"


def drive(seed, n):
    rng = np.random.default_rng(seed)
    t, p, out = 0.0, 0.0, []
    for _ in range(n):
        t, p = t + float(rng.integers(20, 60)), p + float(rng.integers(50, 400))
        out.append((t, min(p, 5000.0)))
    return out


def observed(spark):
    rows = []
    for s in range(4):
        for i, (t, p) in enumerate(drive(s, 30)):
            capture = i // 3 + (7 if s == 2 and i > 14 else 0)  # one vehicle pauses, so that its first period closes
            rows.append((s * 100 + i, f"v{s}", "s", 1, t + (900.0 if s == 2 and i > 14 else 0.0), [(p, 1.0)], capture))
    return spark.createDataFrame(rows, COLUMNS)


def plain(df):
    return sorted(map(tuple, df.select("vehicle", "shape_id", "kind", "reason", "sector", F.round("entered_at", 6), F.round("duration_s", 6)).collect()), key=repr)


@pytest.mark.parametrize("step", [1, 4, 32])
def test_cycles_equal_one_fold(spark, tmp_path, step):
    rows, lengths = observed(spark), spark.createDataFrame([(1, 5000.0)], "shape_id long, length_m double")
    captures = spark.createDataFrame([(c, c == 12) for c in range(26)], "capture_id long, partial boolean")
    if step == 1:
        captures = captures.where("capture_id < 9 OR capture_id > 17")  # fewer cycles
    want = plain(producer.produce(rows, captures, lengths))
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("state") is None and store.checkpoint() == {}
    total = producer.work(lambda: producer.cycle(store, rows, captures, lengths, max_captures=step), max_s=600)
    assert total == captures.count() and producer.cycle(store, rows, captures, lengths) == 0
    assert plain(store.read_all("results")) == want and want
    assert store.checkpoint()["capture"] == 25 and store.read("state").count() == 4


def test_interrupted_cycle_leaves_nothing(spark, tmp_path):
    rows, lengths = observed(spark), spark.createDataFrame([(1, 5000.0)], "shape_id long, length_m double")
    captures = spark.createDataFrame([(c, False) for c in range(26)], "capture_id long, partial boolean")
    store = Store(spark, str(tmp_path / "store"))
    assert producer.cycle(store, rows, captures, lengths, max_captures=8) == 8
    rows.limit(3).write.parquet(f"{store.path}/v2/state")  # written, never committed
    assert store.versions() == [1] and store.read("state").where("first_capture IS NOT NULL").count() == 4
    with pytest.raises(ValueError):  # rows of open periods are gone
        producer.cycle(store, rows, captures, lengths, max_captures=8, oldest_kept=3)
    with pytest.raises(Exception, match="no longer gives"):
        producer.cycle(store, rows.where("obs_id <> 3"), captures, lengths, max_captures=8)
    assert producer.cycle(store, rows, captures, lengths, max_captures=32) == 18
    assert plain(store.read_all("results")) == plain(producer.produce(rows, captures, lengths))
    other = Store(spark, store.path)
    other.versions = lambda: [1]  # saw the folder before the last commit
    with pytest.raises(Conflict):
        other.commit({"state": rows.limit(1)}, {"capture": 1})


def test_worker_repeats_transient_errors_only():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) in (1, 2):
            raise OSError("away")
        return 3 if len(calls) < 5 else 0

    assert producer.work(flaky, pause_s=0.01) == 6
    with pytest.raises(KeyError):
        producer.work(lambda: {}["x"], pause_s=0.01)
    with pytest.raises(OSError):
        producer.work(lambda: (_ for _ in ()).throw(OSError("gone")), pause_s=0.01)


def test_timers_close_and_forget(spark, tmp_path):
    schema = "scope string, a string, b string, received_at double, partial boolean, novel boolean, distance double, at_a double, at_b double, speed_a double, speed_b double, scope_a string, scope_b string"
    near = lambda a, t: ("s", a, "z", t, False, True, 50.0, t, t, 5.0, 6.0, "s", "s")
    parts = [[near("a", 1000.0 + 60.0 * k) for k in range(5)] + [near("b", 1000.0)], [near("c", 10_000.0)], [near("c", 20_000.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = ingest.bunching_stream(stream).writeStream.format("memory").queryName("timed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {r.a: (r.reason, r.closed_at, r.observations) for r in spark.table("timed").where("closed_at IS NOT NULL AND a <> 'c'").collect()}
    age = BunchingPolicy().max_age_s
    assert closed == {"a": ("expired", 1240.0 + age, 5), "b": ("expired", 1000.0 + age, 1)}
    rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert rows <= 1  # the closed keys are forgotten


def test_latest_capture_flags(spark):
    c = spark.createDataFrame([(1, 100.0, False), (2, 200.0, True)], "capture_id long, received_at double, partial boolean")
    assert tuple(bu.latest_capture(c, 250.0).first()) == (2, 200.0, 50.0, True, False, False)
    assert tuple(bu.latest_capture(c.limit(0), 250.0).first()) == (None, None, None, False, True, True)
    assert bn.require_retained(None, 5.0) is None and BottleneckPolicy().missing_captures == 4
