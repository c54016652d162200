"""Keyed state that ends: runs below a level, verdicts that expire, and the rotation of polls.

Each job is a stateful processor with its own state variables. Rows of a micro-batch are
put in order of time before they meet the state; event-time timers free the state of keys that
have been silent for as long as it can matter, so it does not grow with all keys ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """State variables and timers need this provider; it also keeps state off the heap."""
    spark.conf.set(PROVIDER, ROCKS)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _millis(value: pd.Timestamp) -> int:
    return int(value.timestamp() * 1000)


class _Lifetime(StatefulProcessor):
    """A processor whose key has one timer, moved ahead whenever the key is heard of."""

    idle_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _postpone(self, until_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until_ms)

    def close(self) -> None:
        """Spark closes the store."""


class _Settle(_Lifetime):
    def __init__(self, least: int, idle_ms: int):
        self.least, self.idle_ms = least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", "length long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        length, done = self.run.get() if self.run.exists() else (0, False)
        out = []
        batch = _in_order(rows, ["at", "tie"])
        for at, below in zip(batch["at"], batch["below"], strict=True):
            length = length + 1 if below else 0
            if length == self.least and not done:
                done = True
                out.append((key[0], at, length))
        self.run.update((length, done))
        self._postpone(max(_millis(batch["at"].iloc[-1]), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["key", "settled_at", "run"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.run.clear()
        yield from ()


def settle_runs(df: DataFrame, key: str, time: str, tie: str, below, least: int, late: str, idle: str = "3650 days") -> DataFrame:
    """(key, settled_at, run): where a key first has `least` rows in a row that are `below`; once for each key (append mode).

    A key that is silent for `idle` is forgotten. Nulls of `below` break a run.
    """
    rows = df.select(F.col(key).alias("key"), F.col(time).alias("at"), F.col(tie).alias("tie"), F.coalesce(below, F.lit(False)).alias("below")).withWatermark("at", late)
    kinds = dict(rows.dtypes)
    processor = _Settle(least, int(pd.Timedelta(idle).total_seconds() * 1000))
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key {kinds['key']}, settled_at {kinds['at']}, run long", "append", "EventTime")


class _Verdicts(_Lifetime):
    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.asked = handle.getValueState("asked", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.asked.get()[0] if self.asked.exists() else None
        before, out = last, []
        for at in _in_order(rows, ["at"])["at"]:
            now = at.value // 1000
            if last is None or now - last >= self.life_ms * 1000:
                last = now
                out.append((key[0], at))
        if last != before:
            self.asked.update((last,))
            self._postpone(max(last // 1000 + self.life_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "asked_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.asked.clear()
        yield from ()


def verdicts_to_ask(df: DataFrame, key: str, time: str, life: str, late: str) -> DataFrame:
    """(key, asked_at): rows whose key has no verdict that is younger than `life`; each makes one (append mode)."""
    rows = df.select(F.col(key).alias("key"), F.col(time).alias("at")).withWatermark("at", late)
    kinds = dict(rows.dtypes)
    processor = _Verdicts(int(pd.Timedelta(life).total_seconds() * 1000))
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key {kinds['key']}, asked_at {kinds['at']}", "append", "EventTime")


class _Rotation(StatefulProcessor):
    def __init__(self, divisor: int):
        self.divisor = divisor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.polled = handle.getMapState("polled", "member string", "round long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        members = {k[0]: v[0] for k, v in self.polled.iterator()}
        batch, out, changed = pd.concat(list(rows), ignore_index=True), [], set()
        for m in batch["member"].dropna():
            if m not in members:
                members[m] = -1
                changed.add(m)
        for number in sorted(set(batch["round"].dropna().astype(int))):
            count = len(members) if self.divisor <= 1 else max(1, len(members) // self.divisor)
            for m in sorted(members, key=lambda m: (members[m], m))[:count]:
                members[m] = number
                changed.add(m)
                out.append((key[0], number, m))
        for m in changed:
            self.polled.updateValue((m,), (members[m],))
        if out:
            yield pd.DataFrame(out, columns=["key", "round", "member"])

    def close(self) -> None:
        """Spark closes the store."""


def poll_rotation(df: DataFrame, key: str, member: str, number: str, divisor: int) -> DataFrame:
    """(key, round, member): for each round (rows with a number) max(1, n // divisor) members of the key, never polled first, then the stalest, then by name.

    Rows with a member make it known. A key is a group of employers of one board or
    country, small enough for one task; many keys run apart (update mode).
    """
    rows = df.select(F.col(key).alias("key"), F.col(member).cast("string").alias("member"), F.col(number).cast("long").alias("round"))
    return rows.groupBy("key").transformWithStateInPandas(_Rotation(divisor), f"key {dict(rows.dtypes)['key']}, round long, member string", "update", "None")
