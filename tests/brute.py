"""Plain Python versions of the general problems, for comparison."""

import json
import re
from collections import defaultdict
from datetime import datetime, timedelta, timezone

TS = re.compile(r"(2\d{3})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):([0-5]\d)(?:[.,](\d+))?(Z|[+-]\d\d(?::?\d\d)?)?", re.A)


def micros(ts):
    m = TS.fullmatch(ts or "")
    if not m:
        return None
    try:
        t = datetime(*map(int, m.groups()[:6]), tzinfo=timezone.utc)
    except ValueError:
        return None
    us = (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) + int((m[7] or "0")[:6].ljust(6, "0"))
    if m[8] and m[8] != "Z":
        d = m[8][1:].replace(":", "").ljust(4, "0")
        us -= (1 if m[8][0] == "+" else -1) * (int(d[:2]) * 3600 + int(d[2:]) * 60) * 1_000_000
    return us


def p1(rows):
    """rows: (row_id, message id, request id, output tokens, ts)"""
    groups = defaultdict(list)
    for row, mid, rid, out, ts in rows:
        key = (mid or "").strip() or (rid or "").strip()
        if key:
            us = micros(ts)
            groups[key].append((-(out if out is not None else -1), us is None, us or 0, row))
    return {r[3] for g in groups.values() for r in g if r != min(g)}


def parents(agents, listed):
    """agents: (row_id, id, parent); listed: (listed_at, listing_id, id, parent)"""
    link = {i: p for _, i, p in sorted(agents, key=lambda x: x[0]) if i is not None}
    link |= {i: p for _, _, i, p in sorted(listed, key=lambda x: x[:2]) if i is not None}
    return {i: p if p and p.strip() and p in link else None for i, p in link.items()}


def p2(link):
    out = set()
    for i in link:
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = link[x]
        out.add((i, seen[-1], len(seen) - 1) if x is None else (i, min(seen[seen.index(x) :]), -1))
    return out


def kind(v):
    return {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array", type(None): "null"}[type(v)]


def p3(lines, schema):
    """lines: (src, json); schema: (field, type, required)"""
    objects = defaultdict(dict)
    for f, t, r in schema:
        objects[f.rpartition(".")[0]][f.rpartition(".")[2]] = (t, r)
    scope = lambda f: f in ("type", "message.model", "message.usage") or f.startswith("message.usage.")
    out = set()

    def compare(src, path, o):
        fields, full = objects[path], lambda k: f"{path}.{k}".lstrip(".")
        lost = [k for k, (_, r) in fields.items() if r and k not in o]
        new = {k: kind(v) for k, v in o.items() if k not in fields}
        for k in lost:
            hit = next((n for n, t in new.items() if t == fields[k][0]), None)
            if hit is not None:
                del new[hit]
            if scope(full(k)):
                out.add((src, full(k), "removed" if hit is None else "renamed"))
        out.update((src, full(k), "added") for k in new)
        for k, v in o.items():
            if k in fields:
                t = fields[k][0]
                if scope(full(k)) and t != "any" and kind(v) not in ("null", t):
                    out.add((src, full(k), "retyped"))
                elif t == "object" and isinstance(v, dict):
                    compare(src, full(k), v)

    for src, text in lines:
        try:
            o = json.loads(text or "")
        except ValueError:
            continue
        if isinstance(o, dict) and isinstance(o.get("message"), dict) and o["message"].get("role") == "assistant":
            compare(src, "", o)
    return out


def p4(rows, gap=1800):
    """rows: (session id, ts)"""
    at = defaultdict(set)
    for s, ts in rows:
        if (s or "").strip() and (us := micros(ts)) is not None:
            at[s.lower()].add(us)
    out = set()
    for s, times in at.items():
        times = sorted(times)
        start = times[0]
        for a, b in zip(times, times[1:] + [None]):
            if b is None or b - a > gap * 1_000_000:
                out.add((s, start // 1000, a // 1000))
                start = b
    return out


def p5(lines):
    """lines: (log_id, json)"""
    blocks, uses = [], {}

    def walk(log, content, path):
        for k, b in enumerate(content if isinstance(content, list) else [content]):
            if isinstance(b, dict):
                here = f"{path}/{k}".lstrip("/")
                blocks.append((log, here, path, b))
                if b.get("type") == "tool_use" and isinstance(b.get("id"), str):
                    key = (log, [int(x) for x in here.split("/")])
                    if b["id"] not in uses or key < uses[b["id"]]:
                        uses[b["id"]] = key
                walk(log, b.get("content"), here)

    for log, text in lines:
        try:
            o = json.loads(text or "")
        except ValueError:
            continue
        if isinstance(o, dict) and isinstance(o.get("message"), dict):
            walk(log, o["message"].get("content"), "")
    out = set()
    for log, path, up, b in blocks:
        use = uses.get(b["tool_use_id"]) if b.get("type") == "tool_result" and isinstance(b.get("tool_use_id"), str) else None
        out.add((log, path, use[0], "/".join(map(str, use[1]))) if use else (log, path, log, up))
    return out
