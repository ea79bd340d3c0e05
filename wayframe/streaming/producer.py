"""Incremental passages: per vehicle, an open period that closes after missing captures.

A period closes by a count of captures without newer samples, not by time, so every capture
must reach every vehicle with an open period. ``produce`` folds all captures at once; ``cycle``
takes the next few, keeps of an open period only a descriptor (where it began, how much was
accepted, a fingerprint), replays the period from the source and commits state, results and
checkpoint together.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checkpoints import checkpointed
from ..operators.relational import keyset_page
from ..policy import BottleneckPolicy
from .bottlenecks import RESULT, _frame, match, measure, require_retained, sector_ends
from .store import Conflict, Store


def fingerprint(rows: list[dict]) -> int:
    """Order-independent fingerprint of accepted rows."""
    import hashlib

    out = 0
    for r in rows:
        out ^= int.from_bytes(hashlib.sha256(repr((r["vehicle"], r["scope"], r["shape_id"], r["t"], r["candidates"])).encode()).digest(), "big")
    return out


@dataclass
class Period:
    """Open period of one vehicle."""

    rows: list[dict] = field(default_factory=list)
    accepted: int = 0
    print: int = 0
    absences: int = 0
    latest: float = float("-inf")
    closed_until: float = float("-inf")
    last_capture: int = -1
    late: int = 0


def replay(period: Period, lengths: dict, policy: BottleneckPolicy) -> list[tuple]:
    """Results of a closed period: runs of one layout and scope, each matched and measured by itself."""
    if len(period.rows) != period.accepted or fingerprint(period.rows) != period.print:
        raise ValueError("replay differs from what was accepted")
    rows, runs = sorted(period.rows, key=lambda r: r["t"]), []
    for r in rows:
        if runs and (runs[-1][-1]["shape_id"], runs[-1][-1]["scope"]) == (r["shape_id"], r["scope"]):
            runs[-1].append(r)
        else:
            runs.append([r])
    out = []
    for k, run in enumerate(runs):
        length = lengths[run[0]["shape_id"]]
        ended = "missing_updates" if k == len(runs) - 1 else "scope_changed"
        for row in measure(match(run, length, policy), sector_ends(length, policy.sector_m), policy):
            out.append((run[0]["shape_id"], row[0], ended if row[1] == "batch_boundary" else row[1], *row[2:]))
    return out


def advance(period: Period, capture: int, partial: bool, rows: list[dict], lengths: dict, policy: BottleneckPolicy = BottleneckPolicy()) -> list[tuple]:
    """One capture's rows of a vehicle (perhaps none); results if its period closes. Repeated captures do nothing."""
    if capture <= period.last_capture:
        return []
    period.last_capture = capture
    fine = [r for r in rows if r["t"] > period.closed_until]
    period.late += len(rows) - len(fine)
    newer = any(r["t"] > period.latest for r in fine)
    known = {(r["t"], r["scope"], r["shape_id"]) for r in period.rows}
    for r in fine:
        if (r["t"], r["scope"], r["shape_id"]) not in known:  # the first stored row of a sample counts
            period.rows.append(r)
            period.accepted += 1
            period.print ^= fingerprint([r])
            known.add((r["t"], r["scope"], r["shape_id"]))
    if period.rows:
        period.latest = max(r["t"] for r in period.rows)
    if newer:
        period.absences = 0
    elif not partial and period.rows:
        period.absences += 1
    if period.absences < policy.missing_captures:
        return []
    out = replay(period, lengths, policy)
    period.closed_until = period.latest
    period.rows, period.accepted, period.print, period.absences = [], 0, 0, 0
    return out


#: Captures that a fold may send to its tasks (some 20 bytes each).
MOST_CAPTURES = 1_000_000


def _listed(captures: DataFrame) -> list[tuple[int, bool]]:
    """Captures in order, one small row each."""
    rows = captures.select(F.col("capture_id").cast("long"), "partial").orderBy("capture_id").limit(MOST_CAPTURES + 1).collect()
    if len(rows) > MOST_CAPTURES:
        raise ValueError(f"more than {MOST_CAPTURES} captures at once; fold them in cycles")
    return [(r[0], bool(r[1])) for r in rows]


def _sizes(lengths: DataFrame) -> dict:
    """Length of each layout; layouts are as many as a network has shapes."""
    return {r[0]: float(r[1]) for r in lengths.select("shape_id", "length_m").collect()}


def _samples(frame: pd.DataFrame) -> dict[int, list[dict]]:
    """A vehicle's rows by capture, in order of their time."""
    out: dict[int, list[dict]] = {}
    for r in frame.itertuples():
        row = {"vehicle": r.vehicle, "scope": r.scope, "shape_id": r.shape_id, "t": r.observed_at, "candidates": [(c["progress_m"], c["distance_m"]) for c in r.candidates]}
        out.setdefault(int(r.capture_id), []).append(row)
    return {c: sorted(rows, key=lambda r: r["t"]) for c, rows in out.items()}


def produce(observed: DataFrame, captures: DataFrame, lengths: DataFrame, policy: BottleneckPolicy = BottleneckPolicy(), flush: bool = False) -> DataFrame:
    """All captures in one fold: ``vehicle, shape_id`` and results of all periods that close.

    ``observed``: ``capture_id`` and the columns of ``candidates``; ``captures``: ``capture_id, partial``.
    ``flush`` closes what is open at the end.
    """
    kinds, context = dict(observed.dtypes), observed.sparkSession.sparkContext
    listed, known = context.broadcast(_listed(captures)), context.broadcast(_sizes(lengths))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        by_capture, period, out = _samples(frame), Period(), []
        for capture, partial in listed.value:
            out += advance(period, capture, partial, by_capture.get(capture, []), known.value, policy)
        if flush and period.rows:
            out += replay(period, known.value, policy)
        result = _frame([r[1:] for r in out])
        result.insert(0, "vehicle", key[0]), result.insert(1, "shape_id", [r[0] for r in out])
        return result.astype({"shape_id": frame["shape_id"].dtype})

    return observed.groupBy("vehicle").applyInPandas(run, f"vehicle {kinds['vehicle']}, shape_id {kinds['shape_id']}, {RESULT}")


def next_captures(captures: DataFrame, after: int, limit: int) -> DataFrame:
    """The first captures after a checkpoint."""
    return keyset_page(captures, "capture_id", after, limit)


DESCRIPTOR = "first_capture long, accepted long, print string, closed_until double, late long"


def cycle(store: Store, observed: DataFrame, captures: DataFrame, lengths: DataFrame, policy: BottleneckPolicy = BottleneckPolicy(), max_captures: int = 32, oldest_kept: int | None = None) -> int:
    """Processes the next captures and commits ``state`` and ``results``; returns how many there were.

    A vehicle's period is replayed from ``observed``, from the capture where it began, and must come out
    as its descriptor says. ``oldest_kept`` is the first capture whose rows the source still holds;
    a period that began earlier can't be replayed, which fails instead of skipping it.
    """
    spark, kinds = observed.sparkSession, dict(observed.dtypes)
    done = store.checkpoint().get("capture", -1)
    fresh = [r[0] for r in next_captures(captures.select(F.col("capture_id").cast("long")), done, max_captures).collect()]
    if not fresh:
        return 0
    state = store.read("state")
    if state is None:
        state = spark.createDataFrame([], f"vehicle {kinds['vehicle']}, {DESCRIPTOR}")
    oldest = state.agg(F.min("first_capture")).first()[0]
    if oldest is not None:
        require_retained(float(oldest), float("-inf") if oldest_kept is None else float(oldest_kept))
    begin = fresh[0] if oldest is None else min(oldest, fresh[0])
    context = spark.sparkContext
    listed, known = context.broadcast(_listed(captures.where(F.col("capture_id").between(begin, fresh[-1])))), context.broadcast(_sizes(lengths))
    open_ones = state.select(F.col("vehicle").alias("__v"), F.col("first_capture").alias("__first"))
    rows = observed.where(F.col("capture_id").between(begin, fresh[-1])).join(open_ones, F.col("vehicle") == F.col("__v"), "left")
    rows = rows.where((F.col("capture_id") > done) | (F.col("capture_id") >= F.col("__first"))).drop("__v", "__first")

    def run(key: tuple, before: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        by_capture, period, out, first = _samples(frame), Period(last_capture=done), [], None
        held = before.iloc[0] if len(before) else None
        if held is not None:
            period.closed_until, period.late = float(held["closed_until"]), int(held["late"])
            if not pd.isna(held["first_capture"]):
                first, period.last_capture = int(held["first_capture"]), -1
                for capture, partial in listed.value:
                    if first <= capture <= done:
                        out += advance(period, capture, partial, by_capture.get(capture, []), known.value, policy)
                if out or (period.accepted, f"{period.print:064x}") != (int(held["accepted"]), held["print"]):
                    raise ValueError(f"the source no longer gives what was accepted of vehicle {key[0]}")
                period.last_capture, period.late = done, int(held["late"])
        for capture, partial in listed.value:
            if capture > done:
                empty = not period.rows
                out += advance(period, capture, partial, by_capture.get(capture, []), known.value, policy)
                first = None if not period.rows else capture if empty else first
        result = _frame([r[1:] for r in out])
        result.insert(0, "vehicle", key[0]), result.insert(1, "shape_id", [r[0] for r in out])
        result["is_state"] = False
        described = {"vehicle": key[0], "is_state": True, "first_capture": first, "accepted": period.accepted, "print": f"{period.print:064x}", "closed_until": period.closed_until, "late": period.late}
        both = pd.concat([result, pd.DataFrame([described])], ignore_index=True).reindex(columns=names)
        for name in ("sector", "inner_count", "first_capture", "accepted", "late"):
            both[name] = both[name].astype("Int64")
        both["same_interval"] = both["same_interval"].astype("boolean")
        return both

    schema = f"vehicle {kinds['vehicle']}, shape_id {kinds['shape_id']}, {RESULT}, is_state boolean, {DESCRIPTOR}"
    names = [part.split(" ")[0] for part in schema.split(", ")]
    both = checkpointed(state.groupBy("vehicle").cogroup(rows.groupBy("vehicle")).applyInPandas(run, schema))
    described = [part.split(" ")[0] for part in DESCRIPTOR.split(", ")]
    store.commit(
        {"state": both.where("is_state").select("vehicle", *described), "results": both.where("NOT is_state").drop("is_state", *described)}, {"capture": fresh[-1]}
    )
    return len(fresh)


def work(step, transient: tuple = (OSError, Conflict), attempts: int = 3, pause_s: float = 1.0, max_s: float = 300.0) -> int:
    """Repeats ``step`` until it returns 0 or ``max_s`` have passed; returns the sum.

    A transient error is tried again after a pause that doubles; any other, and the last one, is raised.
    """
    begun, total, failed = time.monotonic(), 0, 0
    while time.monotonic() - begun < max_s:
        try:
            n = step()
        except transient:
            failed += 1
            if failed >= attempts:
                raise
            time.sleep(pause_s * 2 ** (failed - 1))
            continue
        failed = 0
        if not n:
            break
        total += n
    return total
