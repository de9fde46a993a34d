"""Order-dependent operators as streams: rows wait behind the watermark until their order is certain, then a fold takes them in turn.

Rows may come in any order within the watermark's delay, in whatever batches.
A key's rows wait in a list state; a timer at the earliest of them fires when
the watermark has passed it, and then all rows up to the watermark go through the
fold in order of time (of equal times by the tie column).  So the result is
that of the batch operator over the rows that weren't late; rows older than
the watermark when they come are dropped.  State is the waiting rows and what the fold
carries, a few numbers or one vector.

Sessions need the RocksDB state store: `use_rocksdb(spark)`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on in this session keep their state in RocksDB."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


class Fold:
    """What a key carries from row to row.

    start: what it begins with, a JSON value.  step(carried, row) and
    flush(carried, now) give (carried, output rows); flush is asked when the watermark is at
    `now` (milliseconds) and no row is left before it; wake(carried) says at which
    watermark it wants to be asked again, None if not.
    """

    start: object = None
    output: str = ""

    def step(self, carried, row: dict) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def flush(self, carried, now: int) -> tuple[object, list[tuple]]:
        return carried, []

    def wake(self, carried) -> int | None:
        return None


class RunningScore(Fold):
    """+1 and -1 by winner, summed."""

    start, output = 0, "momentum long"

    def __init__(self, winner: str, plus: str, minus: str, keep: tuple[str, ...]):
        self.winner, self.sign, self.keep = winner, {plus: 1, minus: -1}, keep

    def step(self, carried, row):
        carried += self.sign.get(row[self.winner], 0)
        return carried, [(*(row[k] for k in self.keep), carried)]


class Scoreboard(Fold):
    """Winner and set of each reading; a side keeps its last known value, a drop begins a set."""

    start, output = [0, 0, 0], "winner string, set_index int"

    def __init__(self, left: str, right: str, keep: tuple[str, ...]):
        self.sides, self.keep = (left, right), keep

    def step(self, carried, row):
        *at, number = carried
        seen = [row[c] for c in self.sides]
        if any(v is not None and v < k for v, k in zip(seen, at, strict=True)):
            at, number = [0, 0], number + 1
        left, right = (v is not None and v > k for v, k in zip(seen, at, strict=True))
        won = None if left == right else "left" if left else "right"
        at = [k if v is None else int(v) for v, k in zip(seen, at, strict=True)]
        return [*at, number], [(*(row[k] for k in self.keep), won, number)]


class Tracklets(Fold):
    """The part of a track that each detection is in; a part ends at a gap or where the look departs from its gallery's mean."""

    start, output = [0, None, None, 0], "part int"

    def __init__(self, frame: str, vector: str, gap: int, most: float, gallery: int, keep: tuple[str, ...]):
        self.frame, self.vector, self.gap, self.most, self.gallery, self.keep = frame, vector, gap, most, gallery, keep

    def step(self, carried, row):
        part, last, total, n = carried
        frame, v = int(row[self.frame]), row[self.vector]
        v = None if v is None else [float(c) for c in v]
        far = v is not None and n >= self.gallery and _half_cosine(total, v) > self.most
        if last is not None and (frame - last > self.gap or far):
            part, total, n = part + 1, None, 0
        if v is not None:
            total, n = v if total is None else [a + b for a, b in zip(total, v, strict=True)], n + 1
        return [part, frame, total, n], [(*(row[k] for k in self.keep), part)]


def _half_cosine(a: list[float], b: list[float]) -> float:
    return (1 - sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))) / 2


class Peaks(Fold):
    """Rows further than `gap` seconds from the last kept one; a stronger one that is nearer takes its place.  The last one is given when nothing nearer can come."""

    start, output = None, ""

    def __init__(self, strength: str, gap: float, keep: tuple[str, ...]):
        self.strength, self.gap, self.keep = strength, gap, keep

    def step(self, carried, row):
        now, s = row["_ms"], row[self.strength] or 0.0
        if carried is not None and now - carried[0] <= self.gap * 1000:
            return ([now, s, [_plain(row[k]) for k in self.keep]] if s > carried[1] else carried), []
        return [now, s, [_plain(row[k]) for k in self.keep]], [tuple(carried[2])] if carried is not None else []

    def flush(self, carried, now):
        over = carried is not None and now > carried[0] + self.gap * 1000
        return (None, [tuple(carried[2])]) if over else (carried, [])

    def wake(self, carried):
        return None if carried is None else int(carried[0] + self.gap * 1000) + 1


def _cell(v, kind: T.DataType):
    """A pandas cell as the value that its type asks for; missing ones as None."""
    if isinstance(kind, T.ArrayType):
        return None if v is None else [_cell(x, kind.elementType) for x in v]
    if v is None or pd.isna(v):
        return None
    return int(v) if isinstance(kind, T.IntegralType) else v.item() if hasattr(v, "item") else v


def _plain(v):
    """A JSON value of a cell; times as microseconds."""
    return pd.Timestamp(v).value // 1000 if isinstance(v, datetime) else v.item() if hasattr(v, "item") else v


class _InOrder(StatefulProcessor):
    """The waiting rows of a key and what its fold carries."""

    def __init__(self, fold: Fold, columns: list[str], rows: T.StructType, out: list[str], times: list[str], tie: str | None):
        self.fold, self.columns, self.rows, self.out, self.times, self.tie = fold, columns, rows, out, times, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.carried = handle.getValueState("carried", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            part.columns = self.columns  # names that begin with _ come as others
            columns = [[_cell(v, f.dataType) for v in part[f.name]] for f in self.rows.fields]
            self.waiting.appendList(list(zip(*columns, strict=True)))
        self._ask()
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        at = [f.name for f in self.rows.fields].index("_ms")
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in held if r[at] <= now), key=lambda r: (r[at], self._tie(r)))
        later = [r for r in held if r[at] > now]
        carried = json.loads(self.carried.get()[0]) if self.carried.exists() else self.fold.start
        made, names = [], [f.name for f in self.rows.fields]
        for r in ready:
            carried, out = self.fold.step(carried, dict(zip(names, r, strict=True)))
            made += out
        carried, out = self.fold.flush(carried, now)
        made += out
        self.carried.update((json.dumps(carried),))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        self._ask(carried)
        if made:
            table = pd.DataFrame([(*key, *m) for m in made], columns=self.out, dtype=object)
            for t in self.times:
                table[t] = [v if v is None or isinstance(v, datetime) else pd.Timestamp(v, unit="us") for v in table[t]]
            yield table

    def _tie(self, row):
        names = [f.name for f in self.rows.fields]
        v = row[names.index(self.tie)] if self.tie else 0
        return (v is not None, v)

    def _ask(self, carried=None) -> None:
        """One timer: at the earliest waiting row, or when the fold wants to be asked."""
        at = [f.name for f in self.rows.fields].index("_ms")
        when = [r[at] for r in self.waiting.get()]
        if carried is None and self.carried.exists():
            carried = json.loads(self.carried.get()[0])
        wake = self.fold.wake(carried)
        when = min([*when, *([wake] if wake is not None else [])], default=None)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if when is not None:
            self.handle.registerTimer(int(when))

    def close(self) -> None:
        pass


def in_order(df: DataFrame, keys: list[str], time: str, fold: Fold, keep: list[str], late: str, tie: str | None = None) -> DataFrame:
    """(keys, keep, the fold's output) of a stream's rows, each key's rows in order of `time`, then of `tie`.

    Append mode; late: how long after a later row a row may come.  A row is
    given once the watermark has passed it.  Rows without a time are left out.
    """
    spark = df.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        raise ValueError("this stream needs the RocksDB state store: use_rocksdb(spark)")
    rows = df.where(F.col(time).isNotNull()).withWatermark(time, late).withColumn("_ms", F.unix_millis(time))
    state = T.StructType([f for f in rows.schema.fields if f.name not in keys])
    parts = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, *keep]] + ([fold.output] if fold.output else [])
    out = T.StructType.fromDDL(", ".join(parts))
    times = [f.name for f in out.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and f.name not in keys]
    return rows.groupBy(*keys).transformWithStateInPandas(_InOrder(fold, rows.columns, state, out.fieldNames(), times, tie), out, "Append", "EventTime")


def momentum(winners: DataFrame, keys: list[str], time: str, tie: str, winner: str, plus: str, minus: str, late: str = "1 day") -> DataFrame:
    """(keys, time, tie, momentum): the running score, whatever the order in which rallies come."""
    return in_order(winners.select(*keys, time, tie, winner), keys, time, RunningScore(winner, plus, minus, (time, tie)), [time, tie], late, tie)


def scoreboard(readings: DataFrame, keys: list[str], time: str, tie: str, left: str, right: str, late: str = "1 day") -> DataFrame:
    """(keys, time, tie, winner, set_index) of scoreboard readings."""
    return in_order(readings.select(*keys, time, tie, left, right), keys, time, Scoreboard(left, right, (time, tie)), [time, tie], late, tie)


def chained(detections: DataFrame, keys: list[str], time: str, frame: str, vector: str, gap: int = 1, most: float = 0.45, gallery: int = 3, late: str = "1 minute") -> DataFrame:
    """(keys, time, frame, part): a track's detections cut into tracklets, open ones included: a part grows until it is cut."""
    return in_order(detections.select(*keys, time, frame, vector), keys, time, Tracklets(frame, vector, gap, most, gallery, (time, frame)), [time, frame], late, frame)


def separated(points: DataFrame, keys: list[str], time: str, strength: str, gap: float, late: str = "1 day") -> DataFrame:
    """(keys, time, strength): greedy de-duplication of points within `gap` seconds."""
    return in_order(points.select(*keys, time, strength), keys, time, Peaks(strength, gap, (time, strength)), [time, strength], late, strength)


