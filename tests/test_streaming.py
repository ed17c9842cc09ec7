"""The meters: transitions, and the streams over files."""

import json
import os

import pytest

from millrace.streaming import meters
from millrace.streaming import transitions as t
from millrace.streaming.run import drained, latest_state, live, status_line


def test_end_is_told_once():
    rows, ended = t.settled({}, {"a": t.Agent("a", status="running")}, 100)
    assert not ended
    rows, ended = t.settled(rows, {"a": t.Agent("a", status="completed")}, 200)
    assert [a.ended_at for a in ended] == [200]
    rows, ended = t.settled(rows, {"a": t.Agent("a", status="completed")}, 300)
    assert not ended and rows["a"].ended_at == 200
    rows, _ = t.settled(rows, {"a": t.Agent("a", status="running")}, 400)
    assert rows["a"].ended_at is None
    _, ended = t.settled(rows, {}, 500)
    assert [(a.status, a.ended_at) for a in ended] == [("ended", 500)]


def test_unlisted_agents_are_forgotten():
    rows = {"a": t.Agent("a")}
    for n in range(1, 4):
        rows, _ = t.settled(rows, {}, n)
        assert rows["a"].misses == n
    assert t.settled(rows, {}, 4) == ({}, [])


def test_rows_of_agents():
    a = t.spawned(None, t.Agent("a", "builder", "d", parent_id="p"))
    a = t.spawned(a, t.Agent("a", "", "e", parent_id="q"))
    assert (a.type, a.description, a.parent_id) == ("builder", "e", "p")
    a = t.tool_started(t.tool_started(a, "1", "Read"), "2", "Edit")
    a = t.tool_ended(t.turned(a, (1, 2, 3, 4)), "1")
    assert a.tools == 2 and a.calls == (("2", "Edit"),) and a.tokens == (1, 2, 3, 4)


def test_tree_order_and_grace():
    rows = {x.id: x for x in (t.Agent("c", parent_id="a", started_at=2), t.Agent("a", started_at=1), t.Agent("b", started_at=3), t.Agent("x", parent_id="y"), t.Agent("y", parent_id="x"), t.Agent("old", status="ended", ended_at=0))}
    assert [a.id for a in t.visible(rows, 10_000)] == ["old", "a", "c", "b", "x", "y"]
    assert "old" not in [a.id for a in t.visible(rows, 10_001)]


def test_ratchet():
    fired, told = {}, []
    reset = "2021-01-04T14:14:59Z"
    for p in (50, 79, 80, 88, 95, 99):
        fired, alerts = t.ratcheted(fired, [("five_hour", p, reset)], 0)
        told += alerts
    assert [a[1] for a in told] == [1, 2]
    fired, alerts = t.ratcheted(fired, [("five_hour", 99, "2021-01-04T14:15:01Z")], 0)
    assert not alerts  # a drift of the reset time
    fired, alerts = t.ratcheted(fired, [("five_hour", 85, "2021-01-04T19:15:01Z")], 0)
    assert [a[1] for a in alerts] == [1] and len(fired) == 1
    fired, _ = t.ratcheted(fired, [("seven_day", 96, None)], 0)
    assert len(fired) == 2
    fired, _ = t.ratcheted(fired, [("seven_day", 10, None)], 0)
    assert len(fired) == 1
    assert t.ratcheted({}, [("five_hour", 99, "2021-01-04T00:00:00Z")], 1 << 50) == ({}, [])
    assert t.changed([("a", 1.0, None)], [("a", 2.0, None)]) and not t.changed([("a", 1.0, None)], [("a", 1.0, None)])


def test_hysteresis():
    c, warned = t.Context(), []
    for p in (50, 85, 90, 95, None, 15, 82):
        c, w = t.context_measured(c, p)
        warned.append(w)
    assert warned == [False, True, False, False, False, False, True]
    c = t.turn_added(c, {"input": 5})
    assert t.turn_added(c, {"input": 9}, of_subagent=True) == c and c.turns == 1
    assert t.context_ended(c, "clear") == t.Context() and t.context_ended(c, "exit") == c


def source(spark, tmp_path, schema, batches):
    for k, rows in enumerate(batches):
        f = tmp_path / f"{k}.json"
        f.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(f, (1_600_000_000 + k, 1_600_000_000 + k))  # files are read in the order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))


def test_context_stream(spark, tmp_path):
    e = lambda at, kind, **more: {"session": "s", "at_ms": at, "event": kind, **more}
    batches = [[e(1, "turn", input=5), e(2, "measure", percent=85.0), e(3, "measure", percent=90.0)], [e(4, "measure", percent=95.0), e(5, "turn", input=1, agent="x")], [e(6, "end", reason="clear"), e(7, "turn", input=2)]]
    got = {r.at_ms: (r.turns, r.input, r.warn) for r in drained(meters.context_stream(source(spark, tmp_path, meters.CONTEXT_EVENTS, batches)), "t").collect()}
    assert got == {1: (1, 5, False), 2: (1, 5, True), 3: (1, 5, False), 4: (1, 5, False), 5: (1, 5, False), 6: (0, 0, False), 7: (1, 2, False)}


def test_limit_stream(spark, tmp_path):
    e = lambda at, p: {"session": "s", "at_ms": at, "windows": [{"kind": "five_hour", "percent": p, "resets_at": "2030-01-01T00:00:00Z"}]}
    got = drained(meters.limit_stream(source(spark, tmp_path, meters.LIMIT_EVENTS, [[e(1, 50.0), e(2, 81.0)], [e(3, 88.0), e(4, 96.0)]])), "t").collect()
    assert {(r.at_ms, r.level) for r in got} == {(2, 1), (4, 2)}


def test_agent_stream(spark, tmp_path):
    e = lambda at, kind, **more: {"session": "s", "at_ms": at, "event": kind, **more}
    listed = lambda s: [{"id": "a", "type": "builder", "status": s}]
    batches = [
        [e(1, "spawn", id="a", type="builder"), e(2, "tool.start", id="a", call="1", tool="Read"), e(3, "turn", id="a", input=3, output=4, cache_read=5, cache_write=6), e(3, "turn", id="unknown", input=3)],
        [e(4, "snapshot", listed=listed("running")), e(5, "snapshot", listed=listed("completed"))],
        [e(6, "snapshot", listed=listed("completed"))],
    ]
    got = drained(meters.agent_stream(source(spark, tmp_path, meters.AGENT_EVENTS, batches), timers=False), "t").collect()
    assert [(r.at_ms, r.id, r.tools, r.tokens) for r in got] == [(5, "a", 1, 13)]


@pytest.mark.parametrize("gap, closed", [(1800, 1), (1801, 2)])
def test_session_stream(spark, tmp_path, gap, closed):
    at = lambda s: f"2021-01-01T{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}Z"
    stream = source(spark, tmp_path, "k string, at timestamp", [[{"k": "a", "at": at(0)}, {"k": "a", "at": at(gap)}], [{"k": "z", "at": "2021-02-01T00:00:00Z"}]])
    got = drained(meters.session_stream(stream, "k", "at"), "t").where("k = 'a'").collect()
    assert len(got) == closed and sum(r.events for r in got) == 2


def test_latest_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = meters.context_stream(source(spark, tmp_path / "in", meters.CONTEXT_EVENTS, [[{"session": "s", "at_ms": 1, "event": "turn", "input": 5}, {"session": "r", "at_ms": 1, "event": "turn", "output": 7}]]))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.key[0]: (r.value.turns, r.value.input, r.value.output) for r in latest_state(spark, str(tmp_path / "c"), "context").collect()}
    assert got == {"s": (1, 5, 0), "r": (1, 0, 7)}


def test_restart_continues(spark, tmp_path):
    (tmp_path / "in").mkdir()

    for k, percent in enumerate((85.0, 90.0)):
        stream = meters.context_stream(source(spark, tmp_path / "in", meters.CONTEXT_EVENTS, [[{"session": "s", "at_ms": n, "event": "measure", "percent": (85.0, 90.0)[n]}] for n in range(k + 1)]))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    told = sorted((r.at_ms, r.warn) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert told == [(0, True), (1, False)]


def test_status_line(spark):
    df = spark.createDataFrame([("a", 84000, 200000, 12300, 1100, 9000), ("b", None, 200000, 5, 6, None), ("c", 1, 200, None, None, None)], "session string, tokens bigint, window bigint, turn_in bigint, turn_out bigint, turn_cached bigint")
    assert {r.session: r.line for r in status_line(df).collect()} == {"a": "ctx 42% 84k/200k · turn in 12.3k out 1.1k cache 73%", "b": "turn in 5 out 6", "c": "ctx 1% 1/200"}


def test_a_failing_receiver_stops_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    e = lambda at, p: {"session": "s", "at_ms": at, "windows": [{"kind": "five_hour", "percent": p, "resets_at": "2030-01-01T00:00:00Z"}]}
    told = []

    def tell(batch, number):
        if number == 0:
            raise RuntimeError("no screen")
        told.extend(r.level for r in batch.collect())

    stream = meters.limit_stream(source(spark, tmp_path / "in", meters.LIMIT_EVENTS, [[e(1, 81.0)], [e(2, 85.0), e(3, 96.0)]]))
    live(stream, str(tmp_path / "c"), tell, str(tmp_path / "f"), None).awaitTermination()
    assert told == [2]
    assert [(r.level, r.error) for r in spark.read.parquet(str(tmp_path / "f")).collect()] == [(1, "RuntimeError: no screen")]


def test_copies_are_dropped_however_late(spark, tmp_path, monkeypatch):
    from millrace.plans import streams

    path = f"{tmp_path}/calls.parquet"
    for k, (key, day) in enumerate([("a", 0), ("b", 1000), ("c", 1001), ("a", 1002)]):
        spark.sql(f"SELECT CAST({k} AS bigint) AS row_id, '{key}' AS request_id, 's' AS src, {k} AS line, named_struct('id', CAST(NULL AS string)) AS message, timestamp_seconds(1600000000 + {day} * 86400) AS delivered_at").coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(streams, "_stream", lambda s, folder, name: s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path))
    assert [r.messages for r in streams.first_deliveries(spark, str(tmp_path)).collect()] == [3]


class _State(dict):
    """State and timers of one key, in memory."""

    def iterator(self):
        return iter(list(self.items()))

    def containsKey(self, k):
        return k in self

    def removeKey(self, k):
        self.pop(k, None)

    def updateValue(self, k, v):
        self[k] = v

    def exists(self):
        return "v" in self

    def get(self, *k):
        return self["v"]

    def update(self, v):
        self["v"] = v


class _Handle:
    def __init__(self, now=0):
        self.now, self.timers = now, []

    def getMapState(self, *a):
        return _State()

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)

    def listTimers(self):
        return iter(self.timers)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def expire(self, processor):
        at = self.timers.pop(self.timers.index(min(self.timers)))
        self.now = at
        info = type("Info", (), {"getExpiryTimeInMs": lambda self: at})()
        return list(processor.handleExpiredTimer(("s",), self, info))


def _event(**x):
    from pyspark.sql import Row

    names = [c.split()[0] for c in meters.AGENT_EVENTS.split(", listed")[0].split(", ")] + ["listed"]
    return Row(**({n: None for n in names} | {"session": "s"} | x))


def test_ticks_lookups_and_grace():
    h, m = _Handle(1000), meters.AgentMeter()
    m.init(h)
    first = list(m.handleInputRows(("s",), iter([_event(at_ms=1000, event="turn", id="u"), _event(at_ms=1001, event="turn", id="u"), _event(at_ms=1002, event="spawn", id="a")]), h))
    assert [(r.what, r.id) for r in first] == [("lookup", "u")]
    assert list(m.handleInputRows(("s",), iter([_event(at_ms=1003, event="tool.start", id="u")]), h)) == []
    assert h.timers == [1000 + t.TICK_MS]  # one tick at a time
    assert [(r.what, r.at_ms) for r in h.expire(m)] == [("tick", 3000)] and h.timers == [5000]
    ended = list(m.handleInputRows(("s",), iter([_event(at_ms=3500, event="snapshot", listed=[{"id": "a", "type": "", "description": "", "status": "completed", "parent_id": None}])]), h))
    assert [r.what for r in ended] == ["ended"]
    assert h.expire(m) == [] and ("a",) in m.rows  # the grace isn't over, nothing is active
    assert h.expire(m) == [] and m.rows == {("a",): m.rows[("a",)]} if h.now - 3500 < t.GRACE_MS else ("a",) not in m.rows


def test_refresh_while_windows_run():
    from pyspark.sql import Row

    h, m = _Handle(0), meters.LimitMeter(refresh=True)
    m.init(h)
    window = {"kind": "five_hour", "percent": 10.0, "resets_at": "1970-01-01T00:02:30Z"}
    assert list(m.handleInputRows(("s",), iter([Row(session="s", at_ms=0, windows=[window])]), h)) == [] and h.timers == [t.REFRESH_MS]
    list(m.handleInputRows(("s",), iter([Row(session="s", at_ms=1, windows=[window])]), h))
    assert h.timers == [t.REFRESH_MS]
    assert [r.kind for r in h.expire(m)] == ["refresh"] and [r.at_ms for r in h.expire(m)] == [2 * t.REFRESH_MS]
    assert h.expire(m) == [] and h.timers == []  # the window has been reset
