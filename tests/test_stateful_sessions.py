import datetime
import random

import pandas as pd
import pytest

from graphloom.streaming import jobs, sessions

HOUR = 3600 * 1_000_000


def brute(events, gap, most):
    """(id, start, last, n, history) of events (id, micros, seq, line)."""
    out = []
    for key in sorted({e[0] for e in events}):
        run = []
        for e in sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])):
            if run and e[1] >= run[-1][1] + gap:
                out.append(run)
                run = []
            run.append(e)
        out.append(run)
    return sorted((r[0][0], r[0][1], r[-1][1], len(r), "\n".join(e[3] for e in r[-most:])) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_merging_in_any_order_equals_sorting(seed):
    r = random.Random(seed)
    times = [r.randrange(100) for _ in range(30)]
    held = []
    for i in range(0, 30, 4):
        held = sessions.merged(held, times[i : i + 4], 7)
    assert held == [(s, e, n) for _, s, e, n, _ in brute([(0, t, i, "x") for i, t in enumerate(times)], 7, 1)]


def test_sessions_close_by_event_time_across_restarts(spark, tmp_path):
    base = datetime.datetime(2024, 5, 1)
    out, events = f"file://{tmp_path}/out", []
    schema = "session_id long, ts timestamp, seq long, line string"
    start = int(base.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000

    def send(name, rows):
        """rows (id, hours, line): a new file, and a new run of the stream, which goes on from its checkpoint."""
        new = [(i, start + int(h * HOUR), len(events) + k, x) for k, (i, h, x) in enumerate(rows)]
        events.extend(new)
        frame = [(i, base + datetime.timedelta(microseconds=t - start), s, x) for i, t, s, x in new]
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        got = sessions.run(jobs.source(spark, f"file://{tmp_path}/in"), out, late="1 hour", most=3)
        closed = sorted(tuple(r) for r in got.select("session_id", "start", "last", "n", "history").collect())
        opened = sorted(tuple(r) for r in sessions.still_open(spark, out).select("session_id", "start", "last", "n", "history").collect())
        assert sorted(closed + opened) == brute(events, 24 * HOUR, 3)
        return closed, opened

    closed, opened = send("1", [(1, 1, "a"), (1, 2, "c"), (2, 1, "x")])
    assert not closed and len(opened) == 2
    closed, opened = send("2", [(1, 1.5, "b"), (1, 3, "d"), (1, 2.5, "late")])  # out of order, within the watermark
    assert not closed and [o[3] for o in opened] == [5, 1] and opened[0][4] == "c\nlate\nd"
    closed, opened = send("3", [(3, 60, "z")])
    assert [c[0] for c in closed] == [1, 2] and [o[0] for o in opened] == [3]
    # what has closed has left the state
    assert spark.read.format("statestore").option("path", f"{out}/state").option("stateVarName", "messages").load().count() == 1
    closed, opened = send("4", [(1, 61, "again"), (2, 200, "far")])
    assert [(c[0], c[3]) for c in closed] == [(1, 5), (1, 1), (2, 1), (3, 1)] and [o[0] for o in opened] == [2]


class Held:
    """State, timers and times of one id, as the stream hands them."""

    def __init__(self):
        self.timers, self.set, self.lists, self.now = set(), 0, {}, 0

    def getListState(self, name, schema):
        rows = self.lists.setdefault(name, [])

        class State:
            exists = staticmethod(lambda: bool(rows))
            get = staticmethod(lambda: iter(list(rows)))
            put = staticmethod(lambda new: rows.__setitem__(slice(None), new))
            clear = staticmethod(rows.clear)

        return State()

    def registerTimer(self, t):
        self.timers.add(t)
        self.set += 1

    def deleteTimer(self, t):
        self.timers.remove(t)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return min(self.timers)


def test_an_id_of_many_sessions_has_one_timer_that_closes_all_that_are_due():
    held = Held()
    own = sessions.Sessions(1_000_000, 3)
    own.init(held)
    micros = [i * 5_000_000 for i in range(6)]
    list(own.handleInputRows((1,), iter([pd.DataFrame({"micros": micros, "seq": range(6), "line": list("abcdef")})]), held))
    assert held.timers == {1000} and held.set == 1
    held.now = 16_001  # the first four are due
    closed = pd.concat(list(own.handleExpiredTimer((1,), held, held)))
    held.timers.remove(1000)
    assert closed["history"].tolist() == list("abcd") and held.timers == {21_000} and held.set == 2
    held.now = 30_000
    assert pd.concat(list(own.handleExpiredTimer((1,), held, held)))["history"].tolist() == list("ef") and not any(held.lists.values())
