"""The meters as stateful streams: per-session state, one writer per key, alerts in append mode.

Events of a session are folded in the order of their time within a micro-batch. The state
is the only memory: it survives restarts through the query's checkpoint, and racing
events fire once because a key has a single writer.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.instants import trimmed
from . import transitions as t

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONTEXT_EVENTS = "session string, at_ms bigint, event string, agent string, input bigint, output bigint, cache_read bigint, cache_write bigint, percent double, reason string"
CONTEXT_OUT = "session string, at_ms bigint, turns bigint, input bigint, output bigint, cache_read bigint, cache_write bigint, warn boolean"
LIMIT_EVENTS = "session string, at_ms bigint, windows array<struct<kind:string,percent:double,resets_at:string>>"
LIMIT_OUT = "session string, at_ms bigint, kind string, level int, percent double"
AGENT_EVENTS = (
    "session string, at_ms bigint, event string, id string, type string, description string, parent_id string, status string, call string, tool string, input bigint, output bigint, cache_read bigint, cache_write bigint, "
    "listed array<struct<id:string,type:string,description:string,status:string,parent_id:string>>"
)
AGENT_OUT = "session string, at_ms bigint, id string, what string, status string, tools bigint, tokens bigint"
_AGENT_STATE = "type string, description string, status string, parent_id string, started_at bigint, ended_at bigint, tools bigint, call_ids array<string>, call_tools array<string>, tokens array<bigint>, is_seen boolean, misses int, is_notified boolean"


def _fields(x: Any) -> dict[str, Any]:
    """A nested struct, which arrives as a dict or as a Row."""
    return x if isinstance(x, dict) else x.asDict()


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.at_ms is None, r.at_ms))


class ContextMeter(StatefulProcessor):
    """Running totals per session, and a warning on each upward crossing of the threshold."""

    def __init__(self, warn: int = 80):
        self.warn = warn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", "turns bigint, input bigint, output bigint, cache_read bigint, cache_write bigint, is_warned boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        c = t.Context(*self.state.get()) if self.state.exists() else t.Context()
        for r in _in_order(rows):
            warn = False
            if r.event == "turn":
                c = t.turn_added(c, {k: r[k] or 0 for k in ("input", "output", "cache_read", "cache_write")}, r.agent is not None)
            elif r.event == "measure":
                c, warn = t.context_measured(c, r.percent, self.warn)
            elif r.event == "end":
                c = t.context_ended(c, r.reason)
            yield Row(session=key[0], at_ms=r.at_ms, turns=c.turns, input=c.input, output=c.output, cache_read=c.cache_read, cache_write=c.cache_write, warn=warn)
        self.state.update((c.turns, c.input, c.output, c.cache_read, c.cache_write, c.is_warned))

    def close(self) -> None:
        pass


class LimitMeter(StatefulProcessor):
    """An alert whenever the level of a rate window rises within its period; the levels told are kept across restarts.

    With ``refresh`` a row of kind 'refresh' is given each minute as long as a window
    runs, so that what is shown of it doesn't age.
    """

    def __init__(self, warn: int = 80, critical: int = 95, refresh: bool = False):
        self.warn, self.critical, self.refresh = warn, critical, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fired = handle.getMapState("fired", "period string", "level int")
        if self.refresh:
            self.live = handle.getValueState("live", "until bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = {k[0]: v[0] for k, v in self.fired.iterator()}
        fired = before
        for r in _in_order(rows):
            fired, alerts = t.ratcheted(fired, [(w["kind"], w["percent"], w["resets_at"]) for w in map(_fields, r.windows or []) if w["kind"] is not None and w["percent"] is not None], r.at_ms or 0, self.warn, self.critical)
            for kind, level, percent in alerts:
                yield Row(session=key[0], at_ms=r.at_ms, kind=kind, level=level, percent=percent)
            if self.refresh and r.windows:
                ends = [t.millis(w["resets_at"]) for w in map(_fields, r.windows)]
                self.live.update((t.FOREVER if None in ends else max(ends),))
                self._wake(timerValues)
        for k in before.keys() - fired.keys():
            self.fired.removeKey((k,))
        for k, v in fired.items():
            if before.get(k) != v:
                self.fired.updateValue((k,), (v,))

    def _wake(self, timerValues: Any) -> None:
        """One timer at a time: a new minute begins only when none is running."""
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + t.REFRESH_MS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.live.exists() and self.live.get()[0] > now:
            self.handle.registerTimer(now + t.REFRESH_MS)
            yield Row(session=key[0], at_ms=now, kind="refresh", level=0, percent=None)

    def close(self) -> None:
        pass


class AgentMeter(StatefulProcessor):
    """Tracked agents of a session: spawns, tool calls, turns, snapshots; tells each end once.

    While agents are shown after their end, a timer at the end of the grace forgets them,
    so that the state stays as small as what is still of interest. While an agent is
    active, a row 'tick' is given every two seconds. An event of an agent not tracked
    asks for it by a row 'lookup', once for each id. A run without timers, over what is
    there, has nobody to ask and nothing to draw.
    """

    def __init__(self, timers: bool = True):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("agents", "id string", _AGENT_STATE)
        self.asked = handle.getMapState("asked", "id string", "at bigint")

    def _load(self) -> dict[str, t.Agent]:
        out = {}
        for (id_,), v in self.rows.iterator():
            out[id_] = t.Agent(id_, v[0], v[1], v[2], v[3], v[4], v[5], v[6], tuple(zip(v[7] or [], v[8] or [])), tuple(v[9]), v[10], v[11], v[12])
        return out

    def _save(self, before: dict[str, t.Agent], after: dict[str, t.Agent]) -> None:
        for k in before.keys() - after.keys():
            self.rows.removeKey((k,))
        for k, r in after.items():
            if before.get(k) != r:
                self.rows.updateValue((k,), (r.type, r.description, r.status, r.parent_id, r.started_at, r.ended_at, r.tools, [c for c, _ in r.calls], [x for _, x in r.calls], list(r.tokens), r.is_seen, r.misses, r.is_notified))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self._load()
        agents = dict(before)
        for r in _in_order(rows):
            known = agents.get(r.id) if r.id is not None else None
            if self.timers and r.event in ("tool.start", "tool.end", "turn") and r.id is not None and not known and not self.asked.containsKey((r.id,)):
                self.asked.updateValue((r.id,), (r.at_ms or 0,))
                yield Row(session=key[0], at_ms=r.at_ms, id=r.id, what="lookup", status=None, tools=0, tokens=0)
            if r.event == "spawn" and r.id is not None:
                agents[r.id] = t.spawned(known, t.Agent(r.id, r.type or "", r.description or "", "running", r.parent_id, r.at_ms or 0))
            elif r.event == "tool.start" and known:
                agents[r.id] = t.tool_started(known, r.call or "", r.tool or "")
            elif r.event == "tool.end" and known:
                agents[r.id] = t.tool_ended(known, r.call or "")
            elif r.event == "turn" and known:
                agents[r.id] = t.turned(known, (r.input or 0, r.output or 0, r.cache_read or 0, r.cache_write or 0))
            elif r.event == "snapshot":
                listed = {a["id"]: t.Agent(a["id"], a["type"] or "", a["description"] or "", a["status"] or "running", a["parent_id"], r.at_ms or 0) for a in map(_fields, r.listed or []) if a["id"] is not None}
                agents, ended = t.settled(agents, listed, r.at_ms or 0)
                for a in ended:
                    yield Row(session=key[0], at_ms=r.at_ms, id=a.id, what="ended", status=a.status, tools=a.tools, tokens=a.tokens[0] + a.tokens[1] + a.tokens[3])
        self._save(before, agents)
        if self.timers:
            now = timerValues.getCurrentProcessingTimeInMs()
            if any(a.ended_at is not None for a in agents.values()):
                self.handle.registerTimer(now + t.GRACE_MS)
            if any(a.status in t.ACTIVE for a in agents.values()) and not any(x <= now + t.TICK_MS for x in self.handle.listTimers()):
                self.handle.registerTimer(now + t.TICK_MS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        before, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        over = {k for k, r in before.items() if r.ended_at is not None and r.is_notified and now - r.ended_at >= t.GRACE_MS}
        self._save(before, {k: r for k, r in before.items() if k not in over})
        if any(r.status in t.ACTIVE for r in before.values()):
            self.handle.registerTimer(now + t.TICK_MS)
            yield Row(session=key[0], at_ms=now, id=None, what="tick", status=None, tools=0, tokens=0)

    def close(self) -> None:
        pass


def _metered(events: DataFrame, processor: StatefulProcessor, out: str, time: str) -> DataFrame:
    # The process that sets a processor up on the driver knows no files of the application: the code travels with it.
    for module in (sys.modules[__name__], t):
        cloudpickle.register_pickle_by_value(module)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return events.groupBy("session").transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=time)


def context_stream(events: DataFrame, warn: int = 80) -> DataFrame:
    return _metered(events.where("session IS NOT NULL"), ContextMeter(warn), CONTEXT_OUT, "None")


def limit_stream(events: DataFrame, warn: int = 80, critical: int = 95, refresh: bool = False) -> DataFrame:
    """``refresh``: rows each minute while a window runs; a run over what is there has no use for them."""
    return _metered(events.where("session IS NOT NULL"), LimitMeter(warn, critical, refresh), LIMIT_OUT, "ProcessingTime" if refresh else "None")


def agent_stream(events: DataFrame, timers: bool = True) -> DataFrame:
    """``timers``: forget ended agents after the grace; a run over what is there has no use for that."""
    return _metered(events.where("session IS NOT NULL"), AgentMeter(timers), AGENT_OUT, "ProcessingTime" if timers else "None")


def delivered_once_stream(calls: DataFrame, at: str = "delivered_at", late: str | None = "2 days") -> DataFrame:
    """The first delivery of each identifier, as a stream; the state of one is kept as long as a copy may be late, for good if ``late`` is None.

    Identifiers are those of ``delivery``. A stream can't take back what it has told, so
    it keeps the first row to arrive, where the batch keeps the largest and earliest: both
    have each identifier once. Rows without an identifier are told apart by file and line.
    """
    key = F.coalesce(trimmed(F.col("message.id")), trimmed(F.col("request_id")), F.concat_ws(":", "src", F.col("line").cast("string")))
    keyed = calls.withColumn("_key", key)
    once = keyed.dropDuplicates(["_key"]) if late is None else keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["_key"])
    return once.drop("_key")


def session_stream(events: DataFrame, key: str, at: str, gap_seconds: int = 1800, late: str = "1 day") -> DataFrame:
    """Sessions of a stream, each given when the watermark has passed its end. A pause of exactly the gap doesn't split."""
    window = F.session_window(at, f"{gap_seconds} seconds 1 microsecond")
    counted = events.withWatermark(at, late).groupBy(key, window.alias("w")).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("events"))
    return counted.drop("w")
