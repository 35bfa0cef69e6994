"""Keyed machines in event time: signals with a lifetime, watch lists that expire, exits of entries.

A machine takes the rows of its key in the order of their stamps and acts by itself when a time comes. The same machine
runs over a sorted table and over a stream. In a stream its rows wait in state until the watermark has passed them, so
the order in which they arrive does not matter, and a timer wakes the key when a row or a deadline is due; a machine that
has nothing left drops its state. In a table one sorted pass carries the machine of one key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATENESS = "1 hour"
SECOND = 1_000_000  #: stamps are microseconds
PRIORITIES = ("LOW", "NORMAL", "HIGH", "CRITICAL")


def priority_of(score: float | None) -> int:
    """Place in PRIORITIES by score; fixed borders at 40, 70 and 90."""
    return sum(score is not None and score >= border for border in (40, 70, 90))


@dataclass(frozen=True)
class AlertPolicy:
    cooldown: int = 12 * 3600 * SECOND
    change: float = 20.0  #: of the score, for another alert
    most: int = 3  #: alerts of one signal
    validity: int = 36 * 3600 * SECOND
    grace: int = 3600 * SECOND
    digest_below: int = 1  #: priorities below this one go to the digest only
    repeat_critical: bool = True  #: a critical signal that changed breaks the cooldown
    invalid_below: float = 2.0  #: a score under this ends the signal


class Signal:
    """The life of a signal: created, updated, alerted or muted, invalidated by a score too low, expired when its validity
    and a grace have passed without a row. state: [score, alerts, last alert, valid until, name], or None while there is none."""

    def __init__(self, policy: AlertPolicy, state: list | None = None):
        self.policy, self.state = policy, state

    def due(self) -> int | None:
        """When the machine acts by itself: the first moment after validity and grace."""
        return None if self.state is None else self.state[3] + self.policy.grace + 1

    def lapse(self, now: int) -> list[tuple]:
        """What happens by itself up to `now`."""
        if self.state is None or self.due() > now:
            return []
        at, alerts, self.state = self.state[3], self.state[1], None
        return [(at, "EXPIRED", None, "EXPIRED", alerts)]

    def row(self, ts: int, score: float | None) -> list[tuple]:
        policy, before = self.policy, self.state
        if score is not None and score < policy.invalid_below:
            self.state = None
            return [] if before is None else [(ts, "INVALIDATED", None, "INVALIDATED", before[1])]
        changed = before is None or abs((score or 0.0) - (before[0] or 0.0)) >= policy.change
        priority, alerts = priority_of(score), 0 if before is None else before[1]
        waits = before is not None and before[2] is not None and ts - before[2] < policy.cooldown
        if waits and not (policy.repeat_critical and priority == 3 and changed):
            decision = "MUTE_COOLDOWN"
        elif not changed:
            decision = "MUTE_UNCHANGED"
        elif alerts >= policy.most:
            decision = "MUTE_DUPLICATE"
        else:
            decision = "SEND_DIGEST_ONLY" if priority < policy.digest_below else "SEND"
        sent = decision.startswith("SEND")
        alerts += sent
        name = "ACTIVE" if sent else "COOLDOWN" if decision == "MUTE_COOLDOWN" else "MUTED"
        self.state = [score, alerts, ts if sent else before[2], ts + policy.validity, name]
        return [(ts, "UPDATED" if before else "CREATED", decision, name, alerts)]


class Watch:
    """An entry of a watch list: made by the first row of at least a priority, it holds for `lifetime` whatever follows and
    is told when that has passed, with the rows it saw. state: [added, rows, best score]."""

    def __init__(self, lifetime: int, least: int, state: list | None = None):
        self.lifetime, self.least, self.state = lifetime, least, state

    def due(self) -> int | None:
        return None if self.state is None else self.state[0] + self.lifetime + 1

    def lapse(self, now: int) -> list[tuple]:
        if self.state is None or self.due() > now:
            return []
        (added, rows, best), self.state = self.state, None
        return [(added, added + self.lifetime, rows, best)]

    def row(self, ts: int, score: float | None) -> list[tuple]:
        if self.state is None:
            if priority_of(score) >= self.least:
                self.state = [ts, 1, score]
        else:
            self.state[1] += 1
            self.state[2] = max(self.state[2], score) if score is not None else self.state[2]
        return []


class Exits:
    """An entry at each row; each is told when a later price reaches the target or the stop, or after `most` rows. state:
    [rows so far, [number, price] of open entries], at most `most` of them. It has no deadline of its own: entries that are
    open when the rows end are not told."""

    def __init__(self, target: float, stop: float, most: int, state: list | None = None):
        self.target, self.stop, self.most, self.state = target, stop, most, state or [0, []]

    def due(self) -> int | None:
        return None

    def lapse(self, now: int) -> list[tuple]:
        return []

    def row(self, ts: int, price: float | None) -> list[tuple]:
        self.state[0] += 1
        k, still, out = self.state[0], [], []
        for number, paid in self.state[1]:
            move = price / paid - 1 if price is not None and paid else None
            rule = "TARGET" if move is not None and move >= self.target else "STOP" if move is not None and move <= self.stop else "TIME" if k - number >= self.most else None
            if rule:
                out.append((ts, number, rule, k - number))
            else:
                still.append([number, paid])
        self.state[1] = [*still, [k, price]]
        return out


class _Processor(StatefulProcessor):
    def __init__(self, new: Callable, names: list[str], keys: list[str]):
        self.new, self.names, self.keys = new, names, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string")
        self.rows = handle.getListState("rows", "ts long, tie long, value double")
        self.timer = handle.getValueState("timer", "at long")

    def _drain(self, key, now_ms: int, more: list[tuple]) -> Iterator[pd.DataFrame]:
        """Rows that the watermark has passed go through the machine, deadlines between them first; the rest waits."""
        now = now_ms * 1000
        held = [(r[0], r[1], r[2]) for r in self.rows.get()] if self.rows.exists() else []
        held = sorted([*held, *more], key=lambda r: r[:2])
        ready, waiting = [r for r in held if r[0] < now], [r for r in held if r[0] >= now]
        machine = self.new(json.loads(self.machine.get()[0]) if self.machine.exists() else None)
        out = []
        for ts, _, value in ready:
            out += machine.lapse(ts)
            out += machine.row(ts, None if value is None or value != value else value)
        out += machine.lapse(now)
        if machine.state is None:
            self.machine.clear()
        else:
            self.machine.update((json.dumps(machine.state),))
        if waiting:
            self.rows.put(waiting)
        elif held:
            self.rows.clear()
        times = [t for t in (waiting[0][0] if waiting else None, machine.due()) if t is not None]
        wake = min(times) // 1000 + 1 if times else None
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != wake:
            if old is not None and old > now_ms:
                self.handle.deleteTimer(old)
            if wake is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(max(wake, now_ms + 1))
                self.timer.update((max(wake, now_ms + 1),))
        if out:
            frame = pd.DataFrame(out, columns=self.names)
            for name, value in zip(self.keys, key, strict=True):
                frame[name] = value
            yield frame[[*self.keys, *self.names]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        more = [(int(pd.Timestamp(ts).value // 1000), int(tie), None if value != value else float(value)) for frame in rows for ts, tie, value in zip(frame["ts"], frame["tie"], frame["value"], strict=True)]
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs(), more)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, timerValues.getCurrentWatermarkInMs(), [])

    def close(self) -> None:
        pass


def run_machines(rows: DataFrame, keys: list[str], new: Callable, out: str, until: int | None = None) -> DataFrame:
    """rows(keys, ts, tie, value) through a machine for each key: new(state) makes one, `out` names its columns (a stamp is
    a long of microseconds). Rows of one stamp go by tie. Rows without a stamp are left out. A stream needs the RocksDB
    state store; a table is told what lapses up to `until` (microseconds; None: nothing beyond the rows)."""
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(out).fields])
    names = schema.names[len(keys) :]
    slim = rows.where("ts is not null").select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("tie").cast("long").alias("tie"), F.col("value").cast("double").alias("value"))
    if rows.isStreaming:
        held = slim.withWatermark("ts", LATENESS).groupBy(*keys)
        return held.transformWithStateInPandas(_Processor(new, names, keys), schema, "Append", "EventTime")
    kinds = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()]) for f in schema.fields])

    def table(batches):
        machine, key = None, None

        def told(found: list[tuple], of) -> list[tuple]:
            return [(*of, *r) for r in found]

        for batch in batches:
            done, stamps = [], batch.column("ts").cast(pa.int64()).to_pylist()
            owner = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            for of, ts, value in zip(owner, stamps, batch.column("value").to_pylist(), strict=True):
                if machine is None or of != key:
                    done += told(machine.lapse(until), key) if machine and until is not None else []
                    machine, key = new(None), of
                done += told(machine.lapse(ts), key) + told(machine.row(ts, None if value is None or value != value else value), key)
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], kinds.names)
        if machine and until is not None:
            columns = list(zip(*told(machine.lapse(until), key), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], kinds.names)

    return slim.repartition(*keys).sortWithinPartitions(*keys, "ts", "tie").mapInArrow(table, schema)


def _events(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return events.select(*keys, "ts", F.col("event_id").alias("tie"), "value")


def signal_lives(events: DataFrame, policy: AlertPolicy = AlertPolicy(), until: int | None = None) -> DataFrame:
    """Life of the signal of each user and event type, by events(user_id, event_type, ts, event_id, value)."""
    out = "at long, event string, decision string, state string, alerts long"
    return run_machines(_events(events, ("user_id", "event_type")), ["user_id", "event_type"], lambda state: Signal(policy, state), out, until)


def watch_list(events: DataFrame, lifetime: int = 72 * 3600 * SECOND, least: int = 2, until: int | None = None) -> DataFrame:
    """Entries of users that have expired: user_id, added, expires, rows, best."""
    return run_machines(_events(events, ("user_id",)), ["user_id"], lambda state: Watch(lifetime, least, state), "added long, expires long, rows long, best double", until)


def first_exits(rows: DataFrame, target: float = 0.1, stop: float = -0.1, most: int = 20) -> DataFrame:
    """rows(symbol, ts, tie, value), a price each -> exits of the entries at each row: at, k0, rule, bars_held."""
    return run_machines(rows, ["symbol"], lambda state: Exits(target, stop, most, state), "at long, k0 long, rule string, bars_held long")
