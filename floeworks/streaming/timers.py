"""Keyed state as streams whose timers act without an event: circuits close, progress entries expire, runs end.

Time is event time: a timer goes off once the watermark has passed it. Events of a key are taken in order of time and event_id within
a batch, and batches in the order they come; a trigger's limit (maxFilesPerTrigger, maxBytesPerTrigger) bounds what a key
has in one batch. State is a few values for each key and is cleared when a key ends, so its size is that of the keys alive.

State lives in RocksDB, which transformWithState asks for: set spark.sql.streaming.stateStore.providerClass to PROVIDER before
a query starts. Time to live of state variables counts the machine's time and is not used, since a replay would differ.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a key that are Python objects at a time.
AT_ONCE = 10_000


def ordered(rows: Iterator[Row]) -> Iterator[Row]:
    """rows by us and event_id (null first). A batch may hold millions of one key, so they wait as numbers: times, ids and which of the other columns' few values."""
    us, ids, kind, kinds, made = array("q"), array("q"), array("q"), {}, None
    for r in rows:
        if made is None:
            rest = [c for c in r.__fields__ if c not in ("ts", "us", "event_id")]
            made = Row("us", "event_id", *rest)
        no_id = r["event_id"] is None
        us.append(r["us"])
        ids.append(-(2**63) if no_id else r["event_id"])
        kind.append(kinds.setdefault((no_id, *(r[c] for c in rest)), len(kinds)))
    values = list(kinds)
    us, ids, kind = (np.frombuffer(a, np.int64) if a else np.array([], np.int64) for a in (us, ids, kind))
    order = np.lexsort((ids, us))
    for i in range(0, len(order), AT_ONCE):
        at = order[i : i + AT_ONCE]
        for t, n, k in zip(us[at].tolist(), ids[at].tolist(), kind[at].tolist(), strict=True):
            no_id, *others = values[k]
            yield made(t, None if no_id else n, *others)


class Keyed(StatefulProcessor):
    """Folds the events of a key in order of us (microseconds) and event_id; the state is one row of values with at most one timer."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.held.get()) if self.held.exists() else None
        before = self.due(state)
        for r in ordered(rows):
            state, out = self.step(key[0], state, r)
            yield from out
        yield from self.kept(key[0], state)
        self._store(state, before)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = tuple(self.held.get()) if self.held.exists() else None
        due = self.due(state)
        if due is not None and -(-due // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            state, out = self.expire(key[0], state)
            yield from out
            self._store(state, None)

    def close(self) -> None:
        pass

    def _store(self, state: tuple | None, before: int | None) -> None:
        due = self.due(state)
        if before is not None and before != due:
            self.handle.deleteTimer(-(-before // 1000))
        if due is not None and before != due:
            self.handle.registerTimer(-(-due // 1000))
        if state is None:
            self.held.clear()
        else:
            self.held.update(state)

    def due(self, state: tuple | None) -> int | None:
        """When the state's timer goes off, in microseconds."""
        return None

    def step(self, key: Any, state: tuple | None, row: Row) -> tuple[tuple | None, list[Row]]:
        """The state after an event, and the rows it gives."""
        raise NotImplementedError

    def expire(self, key: Any, state: tuple) -> tuple[tuple | None, list[Row]]:
        raise NotImplementedError

    def kept(self, key: Any, state: tuple | None) -> list[Row]:
        """Rows that a key gives at the end of each batch."""
        return []


def _keyed(events: DataFrame, key: str, columns: tuple[str, ...], late_minutes: int, processor: Keyed, schema: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.col(key), ts.alias("ts"), F.unix_micros(ts).alias("us"), "event_id", *columns).withWatermark("ts", f"{late_minutes} minutes")
    return rows.groupBy(key).transformWithState(processor, f"{key} {events.schema[key].dataType.simpleString()}, {schema}", "Append", "EventTime")


class Circuit(Keyed):
    schema = "failures long, until long"

    def __init__(self, threshold: int, cooldown_sec: int):
        self.threshold, self.cooldown = threshold, cooldown_sec * 1_000_000

    def due(self, state):  # noqa: ANN001, ANN201
        return state and state[1]

    def step(self, key, state, row):  # noqa: ANN001, ANN201
        (failures, until), out, t = state or (0, None), [], row["us"]
        if until is not None and until <= t:
            out.append(Row(source=key, us=until, change="closed by time", failure_count=failures))
            until = None
        if row["ok"]:
            if until is not None:
                out.append(Row(source=key, us=t, change="closed by success", failure_count=0))
            return (0, None), out
        failures += 1
        if failures >= self.threshold:
            if until is None:
                out.append(Row(source=key, us=t, change="opened", failure_count=failures))
            until = t + self.cooldown
        return (failures, until), out

    def expire(self, key, state):  # noqa: ANN001, ANN201
        return (state[0], None), [Row(source=key, us=state[1], change="closed by time", failure_count=state[0])]


def stream_circuits(events: DataFrame, threshold: int = 3, cooldown_sec: int = 900, late_minutes: int = 10) -> DataFrame:
    """events (source, ts, event_id, ok) as a stream -> source, at, change (opened, closed by success, closed by time), failure_count.

    A failure that brings the count to the threshold or beyond opens the circuit until cooldown_sec later, or moves that end;
    the circuit closes then without an event and keeps its count, so one more failure opens it again. A success ends both.
    """
    out = _keyed(events, "source", ("ok",), late_minutes, Circuit(threshold, cooldown_sec), "us long, change string, failure_count long")
    return out.select("source", F.timestamp_micros("us").alias("at"), "change", "failure_count")


class Progress(Keyed):
    schema = "created long, updated long, event_id long, status string, percent int"

    def __init__(self, hours: float):
        self.keep = int(hours * 3_600_000_000)

    def due(self, state):  # noqa: ANN001, ANN201
        return state and state[1] + self.keep + 1

    def _row(self, key, state, expired):  # noqa: ANN001, ANN202
        created, updated, _, status, percent = state
        return Row(progress_id=key, created=created, updated=updated, status=status, percent=percent, expired=expired)

    def step(self, key, state, row):  # noqa: ANN001, ANN201
        out = []
        if state is not None:
            if (row["us"], row["event_id"]) <= state[1:3]:
                return state, out
            if row["us"] - state[1] > self.keep:
                out.append(self._row(key, state, True))
                state = None
        percent = min(max(row["percent"] or 0, 0), 100)
        percent = 100 if row["status"] == "completed" else max(1, percent) if row["status"] == "failed" else percent
        return (state[0] if state else row["us"], row["us"], row["event_id"], row["status"], percent), out

    def expire(self, key, state):  # noqa: ANN001, ANN201
        return None, [self._row(key, state, True)]

    def kept(self, key, state):  # noqa: ANN001, ANN201
        return [self._row(key, state, False)] if state else []


def stream_progress(events: DataFrame, retention_hours: float = 72, late_minutes: int = 10) -> DataFrame:
    """events (progress_id, ts, event_id, status, percent) as a stream -> a row for each entry that a batch touches or that expires.

    progress_id, created_at, updated_at, status, percent (clamped; 100 when completed, at least 1 when failed), expired. An entry that
    gets no event for more than retention_hours expires and its state goes; a later event begins a new one. Events older
    than an entry's last change nothing.
    """
    out = _keyed(events, "progress_id", ("status", "percent"), late_minutes, Progress(retention_hours), "created long, updated long, status string, percent int, expired boolean")
    return out.select("progress_id", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("updated").alias("updated_at"), "status", "percent", "expired")


def last_progress(rows: DataFrame) -> DataFrame:
    """The last row of each entry (progress_id, created_at) of what stream_progress has given."""
    last = F.max_by(F.struct("updated_at", "status", "percent", "expired"), F.struct("updated_at", "expired")).alias("x")
    return rows.groupBy("progress_id", "created_at").agg(last).select("progress_id", "created_at", "x.*")


class Lifecycle(Keyed):
    schema = "state string, since long"

    def step(self, key, state, row):  # noqa: ANN001, ANN201
        now, action, new = state[0] if state else None, row["action"], None
        if action == "create" and now is None:
            new = "active"
        elif action == "delete" and now == "active":
            new = "recycled"
        elif action == "restore" and now == "recycled":
            new = "active"
        elif action == "purge" and now == "active":
            new = "purged"
        if new is None:
            return state, []
        return None if new == "purged" else (new, row["us"]), [Row(run_id=key, state=new, since=row["us"], event_id=row["event_id"])]


def stream_lifecycle(events: DataFrame, late_minutes: int = 10) -> DataFrame:
    """events (run_id, ts, event_id, action) as a stream -> run_id, state, since, event_id of each change.

    create makes a run active, delete recycles it, restore brings it back, purge (a hard delete, of an active run only)
    ends it and its state; all other events leave it as it is.
    """
    out = _keyed(events, "run_id", ("action",), late_minutes, Lifecycle(), "state string, since long, event_id long")
    return out.select("run_id", "state", F.timestamp_micros("since").alias("since"), "event_id")
