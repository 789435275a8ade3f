"""Operators of streams that keep a state for each key, with timers and states that expire (transformWithState).

They need the RocksDB state store, which is set for the session where none is. Times are the clock's of the executors.
A null key is a key. The rows of one key in one micro-batch are sorted in memory: bound a micro-batch at its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_S = 86_400


def _said(c: Column) -> Column:
    """A value as text, so that frames keep nulls and long numbers as they are."""
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))


def _meant(name: str, kind: T.DataType) -> Column:
    return F.when(F.col(name) != "", F.substring(name, 2, 1 << 30)).cast(kind).alias(name)


def _run(df: DataFrame, processor: StatefulProcessor, schema: str, clock: str = "processingTime") -> DataFrame:
    """processor over df by its text column ``key``; with a clock a query goes on until it is stopped, also where its trigger takes only what is there."""
    conf = df.sparkSession.conf
    if "RocksDB" not in conf.get(_STORE, ""):
        conf.set(_STORE, _ROCKS)
    return df.groupBy("key").transformWithStateInPandas(processor, schema, "append", clock)


def _rows(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


class _Changes(StatefulProcessor):
    """The last state of a key, which expires when the key isn't heard of for so long."""

    def __init__(self, forget_s: int | None):
        self.forget_ms = forget_s and forget_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        found = _rows(rows, "ord")
        before = [last, *found["state"].tolist()]
        self.last.update((before[-1],))
        yield found.loc[[a != b for a, b in zip(before, before[1:])], ["key", "state", "ord"]]

    def close(self) -> None:
        pass


def changes(events: DataFrame, key: str, state: str, forget_s: int | None = None) -> DataFrame:
    """STR6 on a stream of (key, state, ord): rows whose state differs from the one before.

    Null is a state of its own. The first row of a key is a change, and so is the first after forget_s seconds without
    one, when its state has expired (None: never, and the states of all keys are kept). Rows count in the order of their micro-batches, within one by ord.
    """
    rows = events.select(_said(F.col(key)).alias("key"), _said(F.col(state)).alias("state"), F.col("ord").cast("long").alias("ord"))
    out = _run(rows, _Changes(forget_s), "key string, state string, ord long", "processingTime" if forget_s else "none")
    return out.select(_meant("key", events.schema[key].dataType).alias(key), _meant("state", events.schema[state].dataType).alias(state), F.col("ord").cast(events.schema["ord"].dataType).alias("ord"))


class _Alive(StatefulProcessor):
    """When a source was heard last and whether it counts as alive; a timer stands at the end of its time, then at its forgetting."""

    def __init__(self, seconds: float, forget_s: float):
        self.wait_ms, self.forget_ms = int(seconds * 1000), int(forget_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last_ms long, alive boolean")

    def _told(self, key, last: int, alive: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "last_ms": [last], "alive": [alive]})

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        heard = [int(x) for f in rows for x in f["ms"].dropna().tolist()]
        if not heard:
            return
        now, before = timerValues.getCurrentProcessingTimeInMs(), self.held.get() if self.held.exists() else None
        last = max([*heard, *([before[0]] if before else [])])
        alive = now - last < self.wait_ms
        self.held.update((last, alive))
        self._timer(last + self.wait_ms if alive else now + self.forget_ms)
        if before is None or before[1] != alive:
            yield self._told(key, last, alive)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, alive = self.held.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        if not alive:
            self.held.clear()
        elif now - last >= self.wait_ms:
            self.held.update((last, False))
            self.handle.registerTimer(now + self.forget_ms)
            yield self._told(key, last, False)
        else:
            self.handle.registerTimer(last + self.wait_ms)

    def close(self) -> None:
        pass


def liveness(heartbeats: DataFrame, seconds: float = 180, forget_s: float = DAY_S, source: str = "source", at: str = "at") -> DataFrame:
    """STR8 on a stream of (source, at): (source, last_at, alive) whenever a source begins or ceases to be alive.

    A source is alive while its last heartbeat is less than seconds old; a timer tells a silent one dead, without
    any further row. A dead one is forgotten after forget_s seconds. A null time is no heartbeat, an old one doesn't revive.
    """
    rows = heartbeats.select(_said(F.col(source)).alias("key"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"))
    out = _run(rows, _Alive(seconds, forget_s), "key string, last_ms long, alive boolean")
    return out.select(_meant("key", heartbeats.schema[source].dataType).alias(source), F.timestamp_millis("last_ms").alias("last_at"), "alive")


#: The pause after so many strikes in a row, in seconds: fixed values.
FIRST_PAUSE_S, MOST_PAUSE_S, MOST_STRIKES = 60, 300, 4


def pause_s(strikes: int, first: float = FIRST_PAUSE_S) -> float:
    return min(first * 2 ** (min(strikes, MOST_STRIKES) - 1), first * MOST_PAUSE_S / FIRST_PAUSE_S)


class _Pauses(StatefulProcessor):
    """Strikes in a row of a provider; a timer ends its pause, and the strikes expire with a success or with time."""

    def __init__(self, first_s: float, forget_s: int):
        self.first_s, self.forget_ms = first_s, forget_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.strikes = handle.getValueState("strikes", "n int", self.forget_ms)

    def _told(self, key, n: int, until: int | None) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "strikes": [n], "until_ms": pd.Series([until], dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.strikes.get()[0] if self.strikes.exists() else 0
        before, struck = n, False
        for limited in _rows(rows, "ord")["limited"].dropna().tolist():
            n, struck = (min(n + 1, MOST_STRIKES), True) if limited else (0, False)
        if (n, struck) == (before, False):
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if not n:
            self.strikes.clear()
            yield self._told(key, 0, None)
            return
        self.strikes.update((n,))
        until = timerValues.getCurrentProcessingTimeInMs() + int(1000 * pause_s(n, self.first_s))
        self.handle.registerTimer(until)
        yield self._told(key, n, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key, self.strikes.get()[0] if self.strikes.exists() else 0, None)

    def close(self) -> None:
        pass


def pauses(outcomes: DataFrame, key: str = "provider", first_s: float = FIRST_PAUSE_S, forget_s: int = DAY_S) -> DataFrame:
    """STR10 on a stream of (provider, limited, ord): (provider, strikes, until) whenever a pause begins, grows or ends.

    limited: whether a call was turned away for its rate; a call that wasn't ends the pause and clears the strikes, null tells nothing.
    A pause that ends by its timer has a null until and keeps its strikes, so the next one is longer, until they expire.
    """
    rows = outcomes.select(_said(F.col(key)).alias("key"), "limited", F.col("ord").cast("long").alias("ord"))
    out = _run(rows, _Pauses(first_s, forget_s), "key string, strikes int, until_ms long")
    return out.select(_meant("key", outcomes.schema[key].dataType).alias(key), "strikes", F.timestamp_millis("until_ms").alias("until"))
