"""Streaming queries, run over the tables as if they arrived, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.instants import instant_micros, is_blank
from ..streaming import meters
from ..streaming.run import drained, settled_state
from .problems import _STRETCHES
from .usage import _BASE

SPARK, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        SPARK[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _stream(spark, folder, name):
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{path}*")


def _is_folder(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@_query("m14_session_totals", _BASE + 'SELECT session, count(*) AS turns, CAST(sum(inp) AS bigint) AS input, CAST(sum("out") AS bigint) AS output, CAST(sum(read) AS bigint) AS cache_read FROM r WHERE session IS NOT NULL AND NOT sub GROUP BY 1')
def session_totals(spark, folder):
    """Running totals per session (A29, M14); the last of each session is what the table holds."""
    from ..operators.usage import usage

    u = usage(_stream(spark, folder, "calls")).where("NOT sub")
    events = u.select("session", F.coalesce(F.unix_millis("at"), F.lit(0)).alias("at_ms"), F.lit("turn").alias("event"), F.lit(None).cast("string").alias("agent"), F.col("inp").alias("input"), F.col("out").alias("output"), F.col("read").alias("cache_read"), (F.col("w5") + F.col("w1")).alias("cache_write"), F.lit(None).cast("double").alias("percent"), F.lit(None).cast("string").alias("reason"))
    done = drained(meters.context_stream(events), "totals")
    return done.groupBy("session").agg(F.max("turns").alias("turns"), F.max_by("input", "turns").alias("input"), F.max_by("output", "turns").alias("output"), F.max_by("cache_read", "turns").alias("cache_read"))


@_query("m5_agent_ends", "SELECT id, count(*) AS ends FROM (SELECT id, ended, lag(ended) OVER (PARTITION BY session_id, id ORDER BY listed_at, listing_id % 1000) AS before FROM (SELECT *, coalesce(status, 'running') NOT IN ('pending', 'running', 'waiting', 'idle') AS ended FROM listed_agents WHERE id IS NOT NULL AND session_id IS NOT NULL)) WHERE ended AND NOT coalesce(before, false) GROUP BY 1")
def agent_ends(spark, folder):
    """Ends of listed agents, each told once: every listing is a snapshot of one agent (M4, M5). The clock also tells listings of one instant apart."""
    x = _stream(spark, folder, "listed_agents").where("id IS NOT NULL AND session_id IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)
    listed = F.array(F.struct("id", "type", "description", "status", "parent_id"))
    events = x.select(F.concat_ws("/", "session_id", "id").alias("session"), (F.unix_micros("listed_at") * 1000 + F.col("listing_id") % 1000).alias("at_ms"), F.lit("snapshot").alias("event"), *[none("string").alias(c) for c in ("id", "type", "description", "parent_id", "status", "call", "tool")], *[none("bigint").alias(c) for c in ("input", "output", "cache_read", "cache_write")], listed.alias("listed"))
    return drained(meters.agent_stream(events, timers=False), "ends").groupBy("id").agg(F.count(F.lit(1)).alias("ends"))


def _tracked(spark, folder):
    """The rows of ``agents`` as events: each spawns its agent, starts its tools, ends the first of them and reports its tokens; what the meter holds in the end."""
    x = _stream(spark, folder, "agents").where("id IS NOT NULL AND session_id IS NOT NULL")
    t = F.col("tokens")
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda at, kind, call=None, tool=None: F.struct(
        at.alias("at"), F.lit(kind).alias("event"), (none("string") if call is None else call).alias("call"), (none("string") if tool is None else tool).alias("tool"), (F.lit(0) if kind != "turn" else F.lit(1)).alias("used"),
    )
    calls = F.coalesce("calls", F.expr("CAST(array() AS array<struct<id:string,tool:string>>)"))
    starts = F.transform(calls, lambda c, i: event(i + 1, "tool.start", c["id"], c["tool"]))
    ends = F.transform(F.slice(calls, 1, 1), lambda c: event(F.lit(900), "tool.end", c["id"]))
    events = F.concat(F.array(event(F.lit(0), "spawn")), starts, ends, F.array(event(F.lit(950), "turn")))
    e = x.select("session_id", "id", "type", "description", "parent_id", "row_id", *[F.coalesce(t[c], F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_write")], F.explode(events).alias("e"))
    used = lambda c: (F.col(c) * F.col("e.used")).cast("bigint").alias(c)
    rows = e.select(
        F.concat_ws("/", "session_id", "id").alias("session"), (F.col("row_id") * 1000 + F.col("e.at")).cast("bigint").alias("at_ms"), "e.event", "id", "type", "description", "parent_id", none("string").alias("status"), "e.call", "e.tool",
        *[used(c) for c in ("input", "output", "cache_read", "cache_write")], F.expr("CAST(NULL AS array<struct<id:string,type:string,description:string,status:string,parent_id:string>>)").alias("listed"),
    )
    held = settled_state(meters.agent_stream(rows, timers=False), "tracked", "agents")
    return held.select(F.col("key.session").alias("session"), F.col("entry.id").alias("id"), "value.*")


_ROWS = "WITH x AS (SELECT *, session_id || '/' || id AS session FROM agents WHERE id IS NOT NULL AND session_id IS NOT NULL) "


@_query("m1_spawned", _ROWS + "SELECT session, arg_max(type, row_id) FILTER (coalesce(type, '') <> '') AS type, arg_min(parent_id, row_id) FILTER (coalesce(parent_id, '') <> '') AS parent_id FROM x GROUP BY 1")
def spawned(spark, folder):
    """Agents as upserted by their spawns: the last type, the first parent (M1)."""
    return _tracked(spark, folder).select("session", "type", F.nullif("parent_id", F.lit("")).alias("parent_id"))


@_query("m2_tools", _ROWS + "SELECT session, CAST(sum(len(coalesce(calls, []))) AS bigint) AS tools FROM x GROUP BY 1")
def tools(spark, folder):
    """Tools counted per agent (M2)."""
    return _tracked(spark, folder).select("session", "tools")


@_query("m3_tokens", _ROWS + "SELECT session, CAST(sum(coalesce(tokens.input, 0) + coalesce(tokens.output, 0) + coalesce(tokens.cache_write, 0)) AS bigint) AS tokens FROM x GROUP BY 1")
def tokens(spark, folder):
    """Tokens summed per agent from its turns, cache reads left out."""
    t = F.col("tokens")
    return _tracked(spark, folder).select("session", (t[0] + t[1] + t[3]).alias("tokens"))


@_query("m16_report", _ROWS + "SELECT count(DISTINCT session) AS agents, CAST(sum(coalesce(tokens.output, 0)) AS bigint) AS output FROM x")
def report(spark, folder):
    """A report at a moment, read from the meter's state."""
    return _tracked(spark, folder).agg(F.count(F.lit(1)).alias("agents"), F.sum(F.col("tokens")[1]).alias("output"))


@_query("m_first_deliveries", "SELECT count(DISTINCT coalesce(nullif(regexp_replace(message.id, '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(request_id, '^\\s+|\\s+$', '', 'g'), ''), src || ':' || line)) AS messages FROM calls")
def first_deliveries(spark, folder):
    """Messages told once, by the identifiers of problem 1, over all rows."""
    once = meters.delivered_once_stream(_stream(spark, folder, "calls"), late=None).select("row_id")
    return drained(once, "once").agg(F.count(F.lit(1)).alias("messages"))


@_query("m_closed_sessions", _STRETCHES + ", z AS (SELECT session_id, min(us) AS a, max(us) AS b, count(*) AS n FROM g GROUP BY session_id, n) SELECT session_id, a // 1000 AS start_ms, b // 1000 AS end_ms, n AS events FROM z WHERE b + 1800000001 <= (SELECT max(us) FROM e) - 86400000000")
def closed_sessions(spark, folder):
    """Sessions that the watermark, a day behind the latest event, has closed; those still open at the end of the data aren't given."""
    x = _stream(spark, folder, "calls").select(F.lower("session_id").alias("session_id"), F.timestamp_micros(instant_micros(F.col("ts"))).alias("at")).where(~is_blank(F.col("session_id")) & F.col("at").isNotNull())
    return drained(meters.session_stream(x, "session_id", "at"), "sessions").select("session_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "events")
