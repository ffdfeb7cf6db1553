"""Streams that keep state of their own: the life of windows, counters by producer, callers by parents already seen.

Each is a ``StatefulProcessor`` over map state in the state store, with event-time timers that end it. What
they do depends on the order of arrival and on each row's own arrival, never on how rows fall into micro-batches, as
long as rows come no later than ``disorder`` behind the newest arrival; Spark refuses later ones before a
processor sees them. All need the RocksDB store, which ``use_rocksdb`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S
from ..operators.counters import GAP_SECONDS
from ..operators.traffic import is_error, late_points
from ..schema import LATENESS_SECONDS, WINDOW_SECONDS

DISORDER = "1 minute"
SERIES = ["tenant_id", "service_name", "operation_name"]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ended(timers) -> int:
    """The moment, in microseconds, that the watermark has come to."""
    return timers.getCurrentWatermarkInMs() * 1000


# ------------------------------------------------------------------ windows

#: Fixed value: closed windows of a series that wait for being written.
MOST_CLOSED = 12
_MEASURES = ["n", "errors", "duration_sum", "duration_min", "duration_max"]
_DELTA = "tenant_id string, service_name string, operation_name string, kind string, window long, n long, errors long, duration_sum long, duration_min long, duration_max long, arrival timestamp"


def deltas(spans: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Spans as deltas by series, window and class (accepted, late, future), summed within each Arrow batch, so before any shuffle.

    Lateness is judged by each span's own arrival.
    """
    rows = late_points(spans.withColumnRenamed("start_time", "timestamp"), arrival)
    rows = rows.select(*SERIES, F.col("class").alias("kind"), F.unix_micros(S.window_start(F.col("timestamp"))).alias("window"), is_error().cast("long").alias("errors"), "duration_us", F.col(arrival).alias("arrival"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.groupby([*SERIES, "kind", "window"], sort=False, dropna=False).agg(
                n=("errors", "size"), errors=("errors", "sum"), duration_sum=("duration_us", "sum"), duration_min=("duration_us", "min"), duration_max=("duration_us", "max"), arrival=("arrival", "max")
            )
            yield out.reset_index()

    return rows.mapInPandas(partial, _DELTA)


def written(windows: DataFrame) -> DataFrame:
    """What tells the stream that windows (tenant_id, service_name, operation_name, window, arrival) stand in the store."""
    zero = [F.lit(0).cast("long").alias(c) for c in _MEASURES]
    return windows.select(*SERIES, F.lit("written").alias("kind"), F.unix_micros("window").alias("window"), *zero, "arrival")


class WindowLife(StatefulProcessor):
    """Of a series: windows that take deltas, then closed ones that wait for being written, then none.

    A window closes once the watermark is past its lateness. It goes when it is written (``final``), or as
    the oldest when more than ``most_closed`` wait (``lost``, with what it held). What comes too late is
    told as ``refused`` and changes nothing.
    """

    def __init__(self, most_closed: int = MOST_CLOSED):
        self.most_closed = most_closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "window long", "state string, n long, errors long, duration_sum long, duration_min long, duration_max long")

    @staticmethod
    def closes(window: int) -> int:
        return window + (WINDOW_SECONDS + LATENESS_SECONDS) * 1_000_000

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = _ended(timerValues)
        held = {k[0]: list(v) for k, v in self.windows.iterator()}
        touched, out = set(), []
        for pdf in rows:
            for kind, window, *delta in pdf[["kind", "window", *_MEASURES]].itertuples(index=False, name=None):
                window, delta = int(window), [int(x) for x in delta]
                mine = held.get(window)
                if kind == "written":
                    if mine and mine[0] == "closed":
                        out.append((window, "final", *mine[1:]))
                        del held[window]
                        touched.discard(window)
                        self.windows.removeKey((window,))
                elif kind != "accepted" or (mine[0] == "closed" if mine else self.closes(window) <= now):
                    out.append((window, "refused", *delta))
                else:
                    if mine is None:
                        held[window] = ["mutable", *delta]
                        self.handle.registerTimer(self.closes(window) // 1000)
                    else:
                        held[window] = ["mutable", mine[1] + delta[0], mine[2] + delta[1], mine[3] + delta[2], min(mine[4], delta[3]), max(mine[5], delta[4])]
                    touched.add(window)
        for window in sorted(touched):
            self.windows.updateValue((window,), tuple(held[window]))
            out.append((window, *held[window]))
        yield self._told(key, out)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held, out = {k[0]: v for k, v in self.windows.iterator()}, []
        for window in sorted(w for w, v in held.items() if v[0] == "mutable" and self.closes(w) <= due):
            held[window] = ("closed", *held[window][1:])
            self.windows.updateValue((window,), held[window])
            out.append((window, *held[window]))
        closed = sorted(w for w, v in held.items() if v[0] == "closed")
        for window in closed[: max(0, len(closed) - self.most_closed)]:
            out.append((window, "lost", *held[window][1:]))
            self.windows.removeKey((window,))
        yield self._told(key, out)

    @staticmethod
    def _told(key: Any, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in out], columns=[*SERIES, "window", "state", *_MEASURES])

    def close(self) -> None:
        pass


def window_life(deltas: DataFrame, most_closed: int = MOST_CLOSED, disorder: str = DISORDER) -> DataFrame:
    """(series, window, state, measures), an update for each change of a window: ``mutable``, ``closed``, ``final``, ``lost`` or ``refused``.

    ``deltas``: of ``deltas``, and of ``written`` if windows are to become final. The measures of ``refused`` are
    those of what was refused, of all other states the window's. The mode is ``update``.
    """
    out = deltas.withWatermark("arrival", disorder).groupBy(*SERIES)
    schema = "tenant_id string, service_name string, operation_name string, window long, state string, n long, errors long, duration_sum long, duration_min long, duration_max long"
    return out.transformWithStateInPandas(WindowLife(most_closed), schema, "update", "EventTime").withColumn("window", F.timestamp_micros("window"))


# ------------------------------------------------------------------ counters

#: Fixed value: producers of a series that have a baseline of their own; all others share one.
MOST_PRODUCERS, SHARED = 8, -1


class CounterSlots(StatefulProcessor):
    """Increments of a series' cumulative points, with a baseline for each of its first producers."""

    def __init__(self, most: int = MOST_PRODUCERS, idle_seconds: int = 3600):
        self.most, self.idle = most, idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "producer long", "ts long, start long, value double, seen long")
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["producer", "start", "ts", "value", "arrived"]
        came = pd.concat([pdf[["arrived", "seq", *columns[:-1]]] for pdf in rows]).sort_values(["arrived", "seq"], kind="stable")  # numbers of one series and micro-batch
        slots, changed, out = {k[0]: v for k, v in self.slots.iterator()}, set(), []
        for producer, start, ts, value, arrived in came[columns].itertuples(index=False, name=None):
            producer, start, ts, value, arrived = int(producer), int(start), int(ts), float(value), int(arrived)
            slot = producer if producer in slots or len(slots) < self.most else SHARED
            last = slots.get(slot)
            if last is None:
                event, delta = "seed", 0.0
            elif ts <= last[0]:
                event, delta = "ignored", 0.0
            elif ts - last[0] > GAP_SECONDS * 1_000_000:
                event, delta = "gap", 0.0
            elif start != last[1] or value < last[2]:
                event, delta = "reset", value
            else:
                event, delta = "normal", value - last[2]
            slots[slot] = (*last[:3], max(last[3], arrived)) if event == "ignored" else (ts, start, value, arrived)
            changed.add(slot)
            out.append((*key, producer, ts, event, delta, slot == SHARED))
        for slot in changed:
            self.slots.updateValue((slot,), slots[slot])
        if not self.due.exists():
            self._expect(slots)
        yield pd.DataFrame(out, columns=["tenant_id", "service_name", "name", "producer", "ts", "event", "delta", "shared"])

    def _expect(self, slots: dict) -> None:
        """One timer for each series: when its longest silent producer will have been silent too long."""
        due = (min(v[3] for v in slots.values()) + self.idle) // 1000 + 1
        self.due.update((due,))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs() * 1000, _ended(timerValues))
        slots = {k[0]: v for k, v in self.slots.iterator()}
        for slot in [s for s, v in slots.items() if v[3] + self.idle <= now]:
            del slots[slot]
            self.slots.removeKey((slot,))
        self.due.clear()
        if slots:
            self._expect(slots)
        yield pd.DataFrame([], columns=["tenant_id", "service_name", "name", "producer", "ts", "event", "delta", "shared"])

    def close(self) -> None:
        pass


def counter_slots(points: DataFrame, most: int = MOST_PRODUCERS, idle_seconds: int = 3600, disorder: str = DISORDER) -> DataFrame:
    """(tenant_id, service_name, name, producer, timestamp, event, delta, shared) of each point, in the order of (arrival, seq).

    ``points``: (tenant_id, service_name, name, producer, start_ts, timestamp, value, arrival, seq). In order: a
    point no newer than its baseline is ignored; a gap of more than ten minutes seeds anew; a new start, or a
    smaller value, counts whole. The ninth producer of a series and all after it share a baseline. A baseline goes
    when its producer has been silent for ``idle_seconds``, so that a later one may have its place.
    """
    rows = points.withColumns({"ts": F.unix_micros("timestamp"), "start": F.unix_micros("start_ts"), "arrived": F.unix_micros("arrival")})
    rows = rows.select("tenant_id", "service_name", "name", "producer", "start", "ts", "value", "arrived", "seq", "arrival").withWatermark("arrival", disorder)
    schema = "tenant_id string, service_name string, name string, producer long, ts long, event string, delta double, shared boolean"
    out = rows.groupBy("tenant_id", "service_name", "name").transformWithStateInPandas(CounterSlots(most, idle_seconds), schema, "append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("ts")).withColumnRenamed("ts", "timestamp")


# ------------------------------------------------------------------ calls

_CALL = ["span_id", "parent_span_id", "service_name", "start", "duration_us", "status"]


class ParentsSeen(StatefulProcessor):
    """Of a trace: the services of the spans seen so far; a child whose parent is not among them is a miss."""

    def __init__(self, idle_seconds: int = 600):
        self.idle = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "span_id string", "service string")
        self.last = handle.getValueState("last", "arrived long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came, out = pd.concat(list(rows)).sort_values(["arrived", "seq"], kind="stable"), []  # of one trace and micro-batch
        for span, parent, service, start, duration, status in came[_CALL].itertuples(index=False, name=None):
            self.seen.updateValue((span,), (service,))
            if parent:
                caller = self.seen.getValue((parent,))[0] if self.seen.containsKey((parent,)) else None
                if caller is None or caller != service:
                    out.append((key[0], "edge" if caller else "miss", caller, service, int(start), int(duration), status))
        newest = int(came["arrived"].max())
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
        else:
            self.handle.registerTimer((newest + self.idle) // 1000 + 1)
        self.last.update((newest,))
        yield pd.DataFrame(out, columns=["tenant_id", "event", "caller", "callee", "start", "duration_us", "status"])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        if last + self.idle <= max(expiredTimerInfo.getExpiryTimeInMs() * 1000, _ended(timerValues)):
            self.seen.clear()
            self.last.clear()
        else:
            self.handle.registerTimer((last + self.idle) // 1000 + 1)
        yield pd.DataFrame([], columns=["tenant_id", "event", "caller", "callee", "start", "duration_us", "status"])

    def close(self) -> None:
        pass


def seen_calls(spans: DataFrame, idle_seconds: int = 600, disorder: str = DISORDER) -> DataFrame:
    """(tenant_id, event, caller, callee, start_time, duration_us, status): an ``edge`` for each call whose parent came before it, a ``miss`` for each whose parent did not.

    ``spans`` with ``arrival`` and ``seq``, their order. Spans without an id or a service are none; an
    empty or zero parent is none; a span id that comes again has the newer service. A trace is forgotten when nothing of
    it has come for ``idle_seconds``.
    """
    named = spans.where("span_id <> '' and service_name <> ''")
    parent = F.when(F.col("parent_span_id") == "0000000000000000", "").otherwise(F.coalesce("parent_span_id", F.lit("")))
    rows = named.withColumns({"parent_span_id": parent, "start": F.unix_micros("start_time"), "arrived": F.unix_micros("arrival")})
    rows = rows.select("tenant_id", "trace_id", *_CALL, "arrived", "seq", "arrival").withWatermark("arrival", disorder)
    schema = "tenant_id string, event string, caller string, callee string, start long, duration_us long, status string"
    out = rows.groupBy("tenant_id", "trace_id").transformWithStateInPandas(ParentsSeen(idle_seconds), schema, "append", "EventTime")
    return out.withColumn("start", F.timestamp_micros("start")).withColumnRenamed("start", "start_time")
