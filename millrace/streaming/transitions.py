"""What the meters do with an event: pure functions from a state and an event to the next state and what to say.

The streaming processors keep the state per session; batches can fold the same functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

ACTIVE = frozenset(("pending", "running", "waiting", "idle"))
GRACE_MS = 10_000
MISSES = 4
TICK_MS = 2_000
REFRESH_MS = 60_000
PERIOD_MS = 300_000
FOREVER = (1 << 63) - 1


# --- tracked agents -----------------------------------------------------------------


@dataclass(frozen=True)
class Agent:
    id: str
    type: str = ""
    description: str = ""
    status: str = "running"
    parent_id: str | None = None
    started_at: int = 0
    ended_at: int | None = None
    tools: int = 0
    calls: tuple[tuple[str, str], ...] = ()
    tokens: tuple[int, int, int, int] = (0, 0, 0, 0)
    is_seen: bool = False
    misses: int = 0
    is_notified: bool = False


def spawned(row: Agent | None, new: Agent) -> Agent:
    """A new row, or an old one with its type and description renewed; a known parent stays."""
    if row is None:
        return new
    return replace(row, type=new.type or row.type, description=new.description or row.description, parent_id=row.parent_id or new.parent_id)


def tool_started(row: Agent, call: str, tool: str) -> Agent:
    return replace(row, tools=row.tools + 1, calls=(*row.calls, (call, tool)))


def tool_ended(row: Agent, call: str) -> Agent:
    return replace(row, calls=tuple(c for c in row.calls if c[0] != call))


def turned(row: Agent, used: tuple[int, int, int, int]) -> Agent:
    return replace(row, tokens=tuple(a + b for a, b in zip(row.tokens, used, strict=True)))


def settled(rows: dict[str, Agent], listed: dict[str, Agent], now: int) -> tuple[dict[str, Agent], list[Agent]]:
    """Tracked rows after a snapshot of all agents, and those whose end is to be told, each once.

    A listed agent takes over its listing, and being active again clears its end. One
    once seen and no longer listed has ended. One never seen misses, and is forgotten at
    the fourth miss.
    """
    out: dict[str, Agent] = {}
    ended: list[Agent] = []
    for key in rows.keys() | listed.keys():
        row, seen = rows.get(key), listed.get(key)
        if seen is not None:
            row = spawned(row, seen)
            active = seen.status in ACTIVE
            row = replace(row, status=seen.status, is_seen=True, misses=0, ended_at=None if active else row.ended_at or now, is_notified=row.is_notified and not active)
        elif row.is_seen:
            row = row if row.ended_at is not None else replace(row, status="ended", ended_at=now)
        elif row.misses + 1 >= MISSES:
            continue
        else:
            row = replace(row, misses=row.misses + 1)
        if row.ended_at is not None and not row.is_notified:
            row = replace(row, is_notified=True)
            ended.append(row)
        out[key] = row
    return out, sorted(ended, key=lambda r: r.id)


def visible(rows: dict[str, Agent], now: int) -> list[Agent]:
    """Active agents and those ended within the grace, parents before children, by start and id; circles come last."""
    shown = {k: r for k, r in rows.items() if r.status in ACTIVE or r.ended_at is not None and now - r.ended_at <= GRACE_MS}
    below: dict[str | None, list[Agent]] = {}
    for r in sorted(shown.values(), key=lambda r: (r.started_at, r.id)):
        below.setdefault(r.parent_id if r.parent_id in shown else None, []).append(r)
    out: dict[str, Agent] = {}
    todo = list(reversed(below.get(None, [])))
    while todo:
        r = todo.pop()
        if r.id not in out:
            out[r.id] = r
            todo += reversed(below.get(r.id, []))
    return [*out.values(), *sorted((r for k, r in shown.items() if k not in out), key=lambda r: (r.started_at, r.id))]


# --- rate windows --------------------------------------------------------------------


def millis(iso: str | None) -> int | None:
    if not iso:
        return None
    try:
        return int(datetime.fromisoformat(iso.replace("Z", "+00:00")).timestamp() * 1000)
    except ValueError:
        return None


def thresholds(warn: int, critical: int) -> tuple[int, int]:
    warn = min(100, max(1, warn))
    return warn, max(warn, min(100, max(1, critical)))


def level(percent: float, warn: int, critical: int) -> int:
    warn, critical = thresholds(warn, critical)
    return 2 if percent >= critical else 1 if percent >= warn else 0


def period_key(kind: str, reset_ms: int | None) -> str:
    return f"{kind}@{(reset_ms + PERIOD_MS // 2) // PERIOD_MS if reset_ms is not None else '-'}"


def ratcheted(fired: dict[str, int], windows: list[tuple[str, float, str | None]], now: int, warn: int = 80, critical: int = 95) -> tuple[dict[str, int], list[tuple[str, int, float]]]:
    """Levels already told per kind and period, after the windows seen ``now``, and the alerts of levels risen.

    A new period of a kind drops the old one's key; kinds not seen keep theirs; without a
    reset time a fall below the warning re-arms. Windows that have been reset are past.
    """
    fired, alerts = dict(fired), []
    for kind, percent, resets in windows:
        reset = millis(resets)
        if reset is not None and reset <= now:
            continue
        key, at = period_key(kind, reset), level(percent, warn, critical)
        for old in [k for k in fired if k.split("@")[0] == kind and k != key]:
            del fired[old]
        if reset is None and at == 0:
            fired.pop(key, None)
        if at > fired.get(key, 0):
            fired[key] = at
            alerts.append((kind, at, percent))
    return fired, alerts


def changed(before: list[tuple[str, float, str | None]], after: list[tuple[str, float, str | None]]) -> bool:
    return sorted(before, key=str) != sorted(after, key=str)


# --- context -------------------------------------------------------------------------


@dataclass(frozen=True)
class Context:
    turns: int = 0
    input: int = 0
    output: int = 0
    cache_read: int = 0
    cache_write: int = 0
    is_warned: bool = False
    last: dict = field(default_factory=dict)


def turn_added(c: Context, used: dict[str, int], of_subagent: bool = False) -> Context:
    """Running totals of a session; turns of subagents don't count."""
    if of_subagent:
        return c
    add = {k: getattr(c, k) + (used.get(k) or 0) for k in ("input", "output", "cache_read", "cache_write")}
    return replace(c, turns=c.turns + 1, last=dict(used), **add)


def context_measured(c: Context, percent: float | None, warn: int = 80) -> tuple[Context, bool]:
    """Whether to warn: on the way up through the threshold, once; a fall below it re-arms. An unknown share changes nothing."""
    if percent is None:
        return c, False
    above = percent >= warn
    return replace(c, is_warned=above), above and not c.is_warned


def context_ended(c: Context, reason: str) -> Context:
    return Context() if reason == "clear" else c
