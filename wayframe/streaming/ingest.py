"""Micro-batch ingestion of vehicle positions, and the streams over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.relational import first_per_key
from ..policy import BunchingPolicy, GpsPolicy
from .bunching import EVENT, Episode, Machine


def admitted(rows: DataFrame, policy: GpsPolicy = GpsPolicy(), received: str = "received_at", observed: str = "observed_at") -> DataFrame:
    """Rows of the UTC days still kept at receipt and not from the future. A fixed window, not a moving watermark."""
    oldest = F.date_sub(F.to_date(F.col(received)), policy.retention_days - 1)
    return rows.where((F.to_date(F.col(observed)) >= oldest) & (F.col(observed) <= F.col(received) + F.expr(f"INTERVAL {policy.max_skew_s} SECONDS")))


def with_identity(rows: DataFrame, equivalences: DataFrame) -> DataFrame:
    """Rows with the feed's route for the provider's ``route, direction``; null where none is active."""
    active = equivalences.where("active").select("route", "direction", "feed_route", "feed_direction")
    return rows.join(active, ["route", "direction"], "left")


def ingest_batch(existing: DataFrame, rows: DataFrame, equivalences: DataFrame, policy: GpsPolicy = GpsPolicy()) -> tuple[DataFrame, DataFrame]:
    """New rows by first-write-wins on (day, vehicle, time), and one row of counters."""
    keys = ["observed_day", "vehicle", "observed_at"]
    known = with_identity(admitted(rows, policy), equivalences).withColumn("observed_day", F.to_date("observed_at"))
    first = first_per_key(known, keys, ["capture_id", "route", "direction", "lon", "lat"])
    new = first.join(existing.select(*keys), keys, "left_anti")
    got = rows.agg(F.count(F.lit(1)).alias("received"))
    mapped = known.agg(F.count(F.lit(1)).alias("admitted"), F.count_if(F.col("feed_route").isNull()).alias("unmapped"))
    inserted = new.agg(F.count(F.lit(1)).alias("inserted"))
    counters = got.crossJoin(F.broadcast(mapped)).crossJoin(F.broadcast(inserted)).withColumn("outside", F.col("received") - F.col("admitted"))
    return new, counters


def position_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 32) -> DataFrame:
    """Positions from files as they arrive; at most as many files a batch as a worker's cycle takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, equivalences: DataFrame, delay: str = "7 days") -> DataFrame:
    """First row of each (vehicle, time), with identities from a static table; state older than the delay is dropped."""
    return with_identity(stream, equivalences).withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["vehicle", "observed_at"])


def windowed_speeds(stream: DataFrame, length: str = "10 minutes", slide: str | None = None, delay: str = "5 minutes") -> DataFrame:
    """Speeds per route and event-time window with a watermark for late rows."""
    at = F.window("observed_at", length, slide) if slide else F.window("observed_at", length)
    return stream.withWatermark("observed_at", delay).groupBy(at.alias("window"), "route").agg(F.count(F.lit(1)).alias("rows"), F.avg("speed_mps").alias("speed"))


def sessions(stream: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each vehicle's positions."""
    return stream.withWatermark("observed_at", delay).groupBy(F.session_window("observed_at", gap).alias("session"), "vehicle").agg(F.count(F.lit(1)).alias("rows"))


STATE = "first_at double, last_at double, confirmed_at double, at_a double, at_b double, min_distance double, speed_a double, speed_b double, observations int, missing int, is_open boolean, closed_a double, closed_b double"


def bunching_stream(steps: DataFrame, policy: BunchingPolicy = BunchingPolicy(), delay: str = "1 minute") -> DataFrame:
    """Episodes from a stream of key steps: an open or updated episode on each change, and its close.

    ``steps``: ``scope, a, b, received_at, partial, novel, distance, at_a, at_b, speed_a, speed_b, scope_a, scope_b`` (nulls
    for absent vehicles). The state of a key is its open episode and the last closed samples. When the
    watermark on the time of receipt passes the maximum age after the last confirmation, a timer closes the
    episode as expired; a key without an episode is forgotten once its samples can't be fresh any more.
    """
    import pandas as pd

    from .bunching import COLUMNS

    def run(key, frames, state):
        machine = Machine(key[0], policy)
        if state.exists:
            s = state.get
            machine.closed_a, machine.closed_b = s[11], s[12]
            if s[10]:
                machine.open = Episode(s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7], s[8], s[9])
        latest = 0.0
        if state.hasTimedOut:
            if machine.open:
                machine._close("expired", machine.open.confirmed_at + policy.max_age_s)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("received_at")
            for r in rows.itertuples():
                side = lambda t, v, scope: None if pd.isna(t) else {"t": t, "v": v, "scope": scope}
                distance = None if pd.isna(r.distance) else float(r.distance)
                machine.step(r.received_at, bool(r.partial), bool(r.novel), side(r.at_a, r.speed_a, r.scope_a), side(r.at_b, r.speed_b, r.scope_b), distance)
                latest = max(latest, r.received_at)
            e = machine.open
            kept = (e.first_at, e.last_at, e.confirmed_at, e.at_a, e.at_b, e.min_distance, e.speed_a, e.speed_b, e.observations, e.missing, True) if e else (0.0,) * 8 + (0, 0, False)
            state.update(kept + (machine.closed_a, machine.closed_b))
            until = (e.confirmed_at if e else latest + policy.max_skew_s) + policy.max_age_s
            state.setTimeoutTimestamp(max(int(until * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(machine.rows(), columns=COLUMNS).astype({"closed_at": "float64", "observations": "int32", "missing": "int32"})
        out.insert(0, "scope", key[0]), out.insert(1, "a", key[1]), out.insert(2, "b", key[2])
        yield out

    kinds = dict(steps.dtypes)
    timed = steps.withColumn("__at", F.timestamp_micros((F.col("received_at") * 1e6).cast("long"))).withWatermark("__at", delay)
    return timed.groupBy("scope", "a", "b").applyInPandasWithState(
        run, f"scope {kinds['scope']}, a {kinds['a']}, b {kinds['b']}, {EVENT}", STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
