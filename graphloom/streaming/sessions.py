"""Chat sessions as keyed state: each keeps its last messages, and closes when nothing came for a day of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import prepare
from ..operators.sessions import KEPT
from . import jobs

_OPEN = "start long, last long, n long"
_MESSAGES = "ts long, seq long, line string"
CLOSED = "session_id long, start long, last long, n long, history string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(sessions: list[tuple[int, int, int]], times: list[int], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (start, last, n) with more events: those less than a gap apart are one, in whatever order they came."""
    out: list[tuple[int, int, int]] = []
    for start, last, n in sorted([*sessions, *((t, t, 1) for t in times)]):
        if out and start < out[-1][1] + gap:
            out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] + n
        else:
            out.append((start, last, n))
    return out


def history(messages: list[tuple[int, int, str]], session: tuple[int, int, int], most: int) -> list[tuple[int, int, str]]:
    """The last messages of a session."""
    return sorted(m for m in messages if session[0] <= m[0] <= session[1])[-most:]


class Sessions(StatefulProcessor):
    """Per session id the open sessions and their last messages; a timer closes those that are due, puts them out and clears their state.

    More than one can be open at a time, as events may come out of order until the watermark has passed. An id has one timer,
    that of its session due first: it closes all that the watermark has passed, and is set again if some are left. Times are
    microseconds; a timer's milliseconds are rounded up.
    """

    def __init__(self, gap: int, most: int = KEPT):
        self.gap, self.most = gap, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)
        self.messages = handle.getListState("messages", _MESSAGES)

    def _due(self, session: tuple[int, int, int]) -> int:
        return -(-(session[1] + self.gap) // 1000)

    def _first(self, sessions: list[tuple[int, int, int]]) -> int | None:
        return min(map(self._due, sessions), default=None)

    def _held(self) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
        sessions = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        return sessions, [tuple(x) for x in self.messages.get()] if sessions else []

    def _keep(self, sessions: list[tuple[int, int, int]], messages: list[tuple[int, int, str]]) -> None:
        for state, rows in ((self.open, sessions), (self.messages, [m for s in sessions for m in history(messages, s, self.most)])):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions, messages = self._held()
        old = self._first(sessions)
        times: list[int] = []
        for f in rows:
            times += f["micros"].astype("int64").tolist()
            messages += list(zip(f["micros"].astype("int64").tolist(), f["seq"].astype("int64").tolist(), f["line"].tolist(), strict=True))
        sessions = merged(sessions, times, self.gap)
        self._keep(sessions, messages)
        new = self._first(sessions)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions, messages = self._held()
        # Timers go off before the watermark, so one that is due at it has not gone off yet.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        closed = [s for s in sessions if self._due(s) <= now]
        left = [s for s in sessions if self._due(s) > now]
        self._keep(left, messages)
        if left:
            self.handle.registerTimer(self._first(left))
        rows = [(key[0], *s, "\n".join(x for _, _, x in history(messages, s, self.most))) for s in closed]
        yield pd.DataFrame(rows, columns=["session_id", "start", "last", "n", "history"])

    def close(self) -> None:
        pass


def run(messages: DataFrame, out: str, gap_hours: float = 24, late: str = "1 hour", most: int = KEPT) -> DataFrame:
    """Closed sessions (session_id, start, last in microseconds, n, history) of a stream of messages (session_id, ts, seq, line).

    The stream runs over what is there now; a later run with the same folder goes on from its state.
    """
    spark = messages.sparkSession
    prepare(spark)
    rows = messages.select("session_id", "ts", F.unix_micros("ts").alias("micros"), F.col("seq").cast("long"), "line").withWatermark("ts", late)
    closed = rows.groupBy("session_id").transformWithStateInPandas(Sessions(int(gap_hours * 3600 * 1_000_000), most), CLOSED, "Append", "EventTime")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return jobs.drain(closed, out).drop("batch")
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def still_open(spark: SparkSession, out: str, most: int = KEPT) -> DataFrame:
    """The sessions that stand open, with the columns of closed ones, from the stream's state: the messages are not read again."""
    state = lambda name: spark.read.format("statestore").option("path", f"{out}/state").option("stateVarName", name).load()
    key = F.col("key").getField("session_id").alias("session_id")
    sessions = state("open").select(key, "list_element.*")
    lines = state("messages").select(key, "list_element.*")
    own = sessions.join(lines, "session_id", "left").filter(F.col("ts").isNull() | F.col("ts").between(F.col("start"), F.col("last")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "line"))), lambda m: m["line"]), "\n")
    return own.groupBy("session_id", "start", "last", "n").agg(text.alias("history"))
