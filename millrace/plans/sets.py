"""Findings, set operations and reports over the tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import overlap, word_set
from ..operators import alerts, content, findings
from ..operators import usage as ops
from ..sinks.outputs import annotation
from ..sources import config
from ..tables import load
from .content import _BLOCKS, _LAST, _LINES, _LINKED, _STOP, _TOKENS, _VERDICT, _agent_tokens, _judged_runs, _linked, _with_lines
from .usage import _BASE, _GAPS, _SESS, _TYPED, _WEIGHED, _types, _weights

SPARK, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        SPARK[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_LIMIT_LINE = """CASE WHEN log_id % 40 < 2 THEN concat('{"type":"assistant","uuid":"u', log_id div 40, '","sessionId":"S', log_id div 40 % 7, '","timestamp":"2021-01-10T00:00:', lpad(CAST(log_id % 40 AS string), 2, '0'), 'Z","error":"rate_limit","message":{"model":"<synthetic>","role":"assistant"}}') END"""
_LIMITS = "WITH e AS (SELECT 'u' || (log_id // 40) AS key, 's' || (log_id // 40 % 7) AS session, 1610236800000000 + min(log_id % 40) * 1000000 AS us, arg_min(log_id % 40, ('more/' || (log_id % 5) || '.jsonl', log_id)) AS sec FROM call_log WHERE log_id % 40 < 2 GROUP BY 1, 2) "


_COMPACTED = r"""
WITH p AS (SELECT *, json_extract_string(json, '$.timestamp') AS ts FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT' AND json_extract_string(json, '$.type') = 'system' AND json_extract_string(json, '$.subtype') = 'compact_boundary'),
c AS (SELECT coalesce(CASE WHEN json_type(json, '$.uuid') = 'VARCHAR' THEN json_extract_string(json, '$.uuid') END, src || ':' || line) AS key, lower(json_extract_string(json, '$.sessionId')) AS session, CASE WHEN json_extract_string(json, '$.compactMetadata.trigger') IN ('auto', 'manual') THEN json_extract_string(json, '$.compactMetadata.trigger') ELSE 'unknown' END AS trigger,
  epoch_us(try_cast(replace(replace(ts, 'T', ' '), 'Z', '') AS timestamp)) AS us FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, line, log_id) = 1)
"""


_DAYS = 10
_PER = ", rt AS (SELECT mp.model, prd * pin AS per_read, 1.25::decimal(4, 2) * pin AS per_write FROM mp JOIN pr USING (prefix)) "
_RANKED = ", fw AS (SELECT *, CAST(floor((tokens * 14 + {d}) / ({d} * 2.0)) AS bigint) AS weekly_tokens, CAST(floor((weight * 14 + {d} * 10000) / ({d} * 20000.0)) AS bigint) AS weekly_cents FROM (SELECT finding, list, confidence, CAST(evidence AS bigint) AS evidence, CAST(coalesce(tokens, 0) AS bigint) AS tokens, coalesce(weight, 0) AS weight FROM f WHERE evidence > 0)) SELECT finding, list, confidence, evidence, tokens, weekly_tokens, weekly_cents, CAST(floor((weekly_cents * (CASE confidence WHEN 'measured' THEN 100 ELSE 50 END) + 50) / 100.0) AS bigint) AS score FROM fw".format(d=_DAYS)
_SESS_W = _WEIGHED + _SESS[len(_BASE) :]


@_query(
    "g_usage_findings",
    _SESS_W + _PER + ", g AS (SELECT *, us_at - lag(us_at) OVER (PARTITION BY profile, kind, stream ORDER BY us_at, key) AS gap FROM kw WHERE stream IS NOT NULL AND us_at IS NOT NULL), "
    + "w AS (SELECT CASE WHEN kind = 'main' THEN 'main' ELSE 'sub' END AS kind, CASE WHEN gap <= 3600000000 THEN '5m-1h' ELSE '>1h' END AS bucket, w5 + w1 AS written, wwrite FROM g WHERE gap > 300000000 AND ctx > 20000 AND (w5 + w1) * 2 > ctx), "
    + "mn AS (SELECT k.*, per_read FROM k LEFT JOIN rt USING (model) WHERE kind = 'main' AND us_at IS NOT NULL), "
    + "f AS (SELECT 'cache_rewrite_after_idle:' || kind || ':' || bucket AS finding, 'A' AS list, 'measured' AS confidence, count(*) AS evidence, sum(written) AS tokens, sum(wwrite) AS weight FROM w GROUP BY 1 UNION ALL SELECT 'peak_context_over_threshold', 'A', 'measured', count(*), sum(ctx - 300000), sum((ctx - 300000) * per_read) FROM mn WHERE ctx > 300000 "
    + "UNION ALL SELECT 'start_context_size', 'A', 'measured', count(*), (floor(median(first_ctx)) - 30000)::bigint * sum(calls), (floor(median(first_ctx)) - 30000)::bigint * (SELECT sum(per_read) FROM mn WHERE stream IS NOT NULL) FROM t HAVING floor(median(first_ctx)) > 30000 UNION ALL SELECT 'sessions_near_context_limit', 'B', 'inferred', count(*) FILTER (near_limit), 0, 0 FROM t "
    + "UNION ALL SELECT 'unpriced_models', 'B', 'measured', count(DISTINCT model), 0, 0 FROM k WHERE model IS NOT NULL AND model NOT IN (SELECT model FROM mp))" + _RANKED,
)
def usage_findings(spark, folder):
    """Findings over the calls, with a week's share and a score."""
    return findings.ranked(findings.of_usage(ops.deduplicated(ops.usage(load(spark, folder, "calls"))), _weights(spark)), _DAYS)


def _stream_rates(spark, folder):
    """``src``, ``per_write`` of each file of the logs, by the model of its session's first call."""
    kept = ops.deduplicated(ops.usage(load(spark, folder, "calls")))
    first = ops.first_models(kept.where("kind = 'main'"))
    rates = ops.read_rate(kept, _weights(spark))
    files = content.lines(load(spark, folder, "call_log")).where("session IS NOT NULL").groupBy("src").agg(F.min("session").alias("stream"))
    return files.join(first, "stream").join(rates, "model").select("src", "per_write")


@_query(
    "g_content_findings",
    _WEIGHED + _PER + ", fm AS (SELECT stream, arg_max(model, (profile, kind)) AS model FROM (SELECT profile, kind, stream, arg_min(model, (us_at, key)) AS model FROM k WHERE stream IS NOT NULL AND tm IS NOT NULL AND kind = 'main' GROUP BY 1, 2, 3) GROUP BY 1), "
    + _BLOCKS.replace("\nWITH l AS (", "l AS (", 1) + ", sr AS (SELECT src, per_write FROM (SELECT src, min(session) AS stream FROM t WHERE session IS NOT NULL GROUP BY 1) JOIN fm USING (stream) JOIN rt USING (model))"
    + ", a AS (SELECT src, count(*) AS n, sum(x) // 4 AS tk FROM (SELECT src, sum(n) - arg_min(n, (us IS NULL, us, id)) AS x FROM reads GROUP BY src, file_path HAVING count(*) >= 3) GROUP BY 1), began AS (SELECT src, min(us) AS began FROM b WHERE sub AND us IS NOT NULL GROUP BY 1), par AS (SELECT profile, session, file_path, min(us) AS pus FROM reads WHERE NOT sub AND us IS NOT NULL GROUP BY 1, 2, 3), "
    + "y AS (SELECT rd.src, count(*) FILTER (pus < began) AS n, coalesce(sum(n) FILTER (pus < began), 0) // 4 AS tk FROM reads rd LEFT JOIN began USING (src) LEFT JOIN par ON par.profile = rd.profile AND par.session = rd.session AND par.file_path = rd.file_path WHERE rd.sub GROUP BY 1), "
    + "z AS (SELECT coalesce(us.name, 'unknown') AS tool, rs.src, count(*) AS n, sum(rs.chars - 500) // 4 AS tk FROM results rs LEFT JOIN uses us ON us.id = rs.tool_use_id WHERE rs.chars > 500 GROUP BY 1, 2), "
    + "f AS (SELECT 'repeated_file_reads' AS finding, 'A' AS list, 'inferred' AS confidence, sum(n) AS evidence, sum(tk) AS tokens, sum(tk * per_write) AS weight FROM a LEFT JOIN sr USING (src) UNION ALL SELECT 'subagent_rereads_parent_files', 'A', 'inferred', sum(n), sum(tk), sum(tk * per_write) FROM y LEFT JOIN sr USING (src) UNION ALL SELECT 'large_tool_results:' || tool, 'A', 'inferred', sum(n), sum(tk), sum(tk * per_write) FROM z LEFT JOIN sr USING (src) GROUP BY 1)" + _RANKED,
)
def content_findings(spark, folder):
    """Findings over the contents, at 500 characters, as results of this data are short."""
    return findings.ranked(findings.of_contents(content.blocks(load(spark, folder, "call_log")), _stream_rates(spark, folder), 500), _DAYS)


@_query(
    "g4_review_rounds",
    _LINKED + _TOKENS + ", hv AS (SELECT * FROM t WHERE rounds > 2), ex AS (SELECT rk.session_id, rk.id FROM ranked rk JOIN hv ON hv.session_id = rk.session_id AND hv.task = rk.task WHERE rk.n > 2), "
    + "f AS (SELECT 'reviewer_rounds_over_threshold' AS finding, 'A' AS list, CASE WHEN bool_and(all_linked) THEN 'measured' ELSE 'inferred' END AS confidence, count(*) AS evidence, (SELECT sum(q.tokens) FROM ex JOIN q USING (session_id, id)) AS tokens, (SELECT sum(q.tokens) * 3 FROM ex JOIN q USING (session_id, id)) AS weight FROM hv)" + _RANKED,
)
def review_rounds(spark, folder):
    """Tasks of more than two reviews, every token weighing 3."""
    used = _agent_tokens(spark, folder).withColumn("weight", F.col("tokens") * 3)
    return findings.ranked(findings.of_tasks(_linked(spark, folder), used), _DAYS)


@_query(
    "g_event_findings",
    "WITH " + _COMPACTED.replace("\nWITH p AS", "p AS", 1) + ", f AS (SELECT 'usage_limit_hits' AS finding, 'B' AS list, 'measured' AS confidence, (SELECT count(DISTINCT log_id // 40) FROM call_log WHERE log_id % 40 < 2) AS evidence, 0 AS tokens, 0 AS weight UNION ALL SELECT 'auto_compactions', 'B', 'measured', count(*) FILTER (trigger = 'auto'), 0, 0 FROM c "
    + "UNION ALL SELECT 'reviewer_verdict_unclear', 'B', 'measured', count(*), 0, 0 FROM (SELECT DISTINCT session_id, id FROM agents WHERE type = 'reviewer') WHERE right(id, 1) >= 'b')" + _RANKED,
)
def event_findings(spark, folder):
    """Limits hit, unclear verdicts and compactions as findings."""
    reviews = _judged_runs(spark, folder).where("type = 'reviewer'")
    return findings.ranked(findings.of_events(_limits(spark, folder), reviews, content.compactions(load(spark, folder, "call_log"))), _DAYS)


@_query("u1_paths", "SELECT repo, path FROM entries WHERE kind = 'file' UNION SELECT repo, path FROM entries WHERE kind = 'gitlink'")
def paths(spark, folder):
    e = load(spark, folder, "entries")
    return e.where("kind = 'file'").select("repo", "path").union(e.where("kind = 'gitlink'").select("repo", "path")).distinct()


@_query("u3_never_listed", "SELECT id FROM agents EXCEPT SELECT id FROM listed_agents")
def never_listed(spark, folder):
    return load(spark, folder, "agents").select("id").subtract(load(spark, folder, "listed_agents").select("id"))


@_query("u7_all_agents", "SELECT 'tracked' AS origin, session_id, id FROM agents UNION ALL SELECT 'listed', session_id, id FROM listed_agents")
def all_agents(spark, folder):
    part = lambda n, o: load(spark, folder, n).select(F.lit(o).alias("origin"), "session_id", "id")
    return part("agents", "tracked").unionByName(part("listed_agents", "listed"))


@_query(
    "f16_word_overlap",
    f"WITH w AS (SELECT row_id, id, parent_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_STOP}))) AS ws FROM agents QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1) "
    + "SELECT a.id, CASE WHEN least(len(a.ws), len(p.ws)) > 0 THEN len(list_intersect(a.ws, p.ws)) / least(len(a.ws), len(p.ws)) ELSE 0.0 END AS overlap FROM w a JOIN w p ON p.id = a.parent_id",
)
def word_overlap(spark, folder):
    """How far an agent's task overlaps its parent's."""
    a = load(spark, folder, "agents").where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("parent_id", "description"), "row_id").alias("r")).select("id", "r.parent_id", word_set(F.coalesce("r.description", F.lit("")), content.STOP_WORDS).alias("w"))
    p = a.select(F.col("id").alias("parent_id"), F.col("w").alias("pw"))
    return a.join(p, "parent_id").select("id", overlap(F.col("w"), F.col("pw")).alias("overlap"))


@_query("w1_largest_gaps", _GAPS + " SELECT stream, key, gap AS gap_us FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, stream, key LIMIT 20")
def largest_gaps(spark, folder):
    g = ops.gaps(ops.deduplicated(ops.usage(load(spark, folder, "calls"))))
    return g.where("gap_us IS NOT NULL").select("stream", "key", "gap_us").orderBy(F.desc("gap_us"), "stream", "key").limit(20)


@_query("k6_annotations", "SELECT entry_id, '::error file=' || replace(replace(replace(path, '%', '%25'), ':', '%3A'), ',', '%2C') || ',title=submodule::gitlink (mode 160000)' AS line FROM entries WHERE kind = 'gitlink'")
def annotations(spark, folder):
    e = load(spark, folder, "entries").where("kind = 'gitlink'")
    return e.select("entry_id", annotation(F.lit("error"), F.col("path"), F.lit(None).cast("int"), F.lit("submodule"), F.lit("gitlink (mode 160000)")).alias("line"))


@_query("f34_hashes", "SELECT entry_id, sha256(data) AS sha FROM entries WHERE data IS NOT NULL")
def hashes(spark, folder):
    return load(spark, folder, "entries").where("data IS NOT NULL").select("entry_id", F.sha2("data", 256).alias("sha"))


def _shares(spark, folder):
    """The share of a context window that each call fills, per stream, in whole percents."""
    k = ops.deduplicated(ops.usage(load(spark, folder, "calls"))).where("stream IS NOT NULL AND at IS NOT NULL")
    return k.select("key", "profile", F.concat_ws("/", "profile", "kind", "stream").alias("stream"), F.struct("at", "key").alias("o"), F.to_date("at").alias("day"), F.date_trunc("hour", "at").alias("hour"), (ops.context() * 100 / 200_000).cast("bigint").alias("share"))


_SHARES = _SESS + ", h AS (SELECT key, concat_ws('/', profile, kind, stream) AS stream, us_at, tm::date AS day, ctx * 100 // 200000 AS share FROM k WHERE stream IS NOT NULL AND us_at IS NOT NULL)"


@_query("w9_crossings", _SHARES + " SELECT key, stream, share FROM (SELECT *, coalesce(lag(share) OVER (PARTITION BY stream ORDER BY us_at, key) >= 80, false) AS b FROM h) WHERE share >= 80 AND NOT b")
def crossings(spark, folder):
    """Upward crossings of 80 % of the window, re-armed by a fall."""
    return alerts.crossings(_shares(spark, folder), "stream", "o", "hour", "share").select("key", "stream", "share")


@_query("w10_ratchet", _SHARES + " SELECT key, stream, level FROM (SELECT *, coalesce(max(level) OVER (PARTITION BY stream, day ORDER BY us_at, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM (SELECT *, CASE WHEN share >= 95 THEN 2 WHEN share >= 80 THEN 1 ELSE 0 END AS level FROM h)) WHERE level > m")
def ratchet(spark, folder):
    """Rises of the level within a day of a stream."""
    return alerts.ratchet(_shares(spark, folder), ["stream", "day"], "o", "hour", "share").select("key", "stream", "level")


@_query("a11_compactions", "SELECT CASE WHEN json_extract_string(json, '$.compactMetadata.trigger') IN ('auto', 'manual') THEN json_extract_string(json, '$.compactMetadata.trigger') ELSE 'unknown' END AS trigger, count(DISTINCT coalesce(json_extract_string(json, '$.uuid'), src || ':' || line)) AS compactions FROM (SELECT * FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT') WHERE json_extract_string(json, '$.type') = 'system' AND json_extract_string(json, '$.subtype') = 'compact_boundary' GROUP BY 1")
def compactions(spark, folder):
    return content.by_trigger(content.compactions(load(spark, folder, "call_log")))


def _limits(spark, folder):
    return content.limit_hits(_with_lines(spark, folder, _LIMIT_LINE))


@_query("a12_limit_hits", _LIMITS + "SELECT key, session, CAST(1610236800000000 + sec * 1000000 AS bigint) AS us FROM e")
def limit_hits(spark, folder):
    """Lines that a limit cut off, each event once; the table has none, so some are added."""
    return _limits(spark, folder).select("key", "session", "us")


@_query("a12_limit_totals", _LIMITS + "SELECT count(*) AS hits, count(DISTINCT session) AS sessions FROM e")
def limit_totals(spark, folder):
    return _limits(spark, folder).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("session").alias("sessions"))


@_query("t9_compactions_in_order", _COMPACTED + "SELECT key, session, trigger, us, row_number() OVER (ORDER BY us, session, key) AS place FROM c WHERE us IS NOT NULL")
def compactions_in_order(spark, folder):
    """Compactions by time and session."""
    c = content.compactions(load(spark, folder, "call_log")).where("us IS NOT NULL")
    return content.in_order(c).select("key", "session", "trigger", "us", "place")


@_query("j8_events_of_sessions", _COMPACTED + "SELECT c.key FROM c WHERE session IN (SELECT lower(session_id) FROM calls WHERE trim(session_id) <> '' AND profile = 'work')")
def events_of_sessions(spark, folder):
    """Compactions of sessions that occur among the calls of one profile."""
    kept = ops.deduplicated(ops.usage(load(spark, folder, "calls").where("profile = 'work'")))
    return content.within_sessions(content.compactions(load(spark, folder, "call_log")), kept).select("key")


@_query(
    "j5_run_verdicts",
    _BLOCKS + _LAST[len(_LINES) :] + ", hand AS (SELECT src, arg_max(b->>'$.input.message', (line, log_id, pos)) AS text FROM (SELECT b.*, t.line FROM b JOIN t USING (log_id, src)) WHERE sub AND type = 'tool_use' AND name = 'SubagentHandback' AND json_type(b, '$.input.message') = 'VARCHAR' GROUP BY 1), "
    + f"x AS (SELECT src, {_VERDICT} AS v FROM (SELECT src, coalesce(hand.text, y.text, '') AS text FROM (SELECT DISTINCT src FROM b WHERE sub) LEFT JOIN hand USING (src) LEFT JOIN y USING (src))) SELECT src, CASE WHEN regexp_matches(v, '(?i)VERDICT:[\\t ]*(APPROVE|PASS)') THEN 'approve' WHEN v IS NOT NULL THEN 'changes' ELSE 'unclear' END AS verdict FROM x",
)
def run_verdicts(spark, folder):
    return content.verdicts_of_runs(load(spark, folder, "call_log"))


_STEM = "regexp_replace(string_split(src, '/')[-1], '\\.[^.]*$', '')"


@_query(
    "a14_runs_in_full",
    _TYPED + ", " + _BLOCKS.replace("\nWITH l AS (", "l AS (", 1) + _LAST[len(_LINES) :] + f", jv AS (SELECT {_STEM} AS stream, max(CASE WHEN regexp_matches(v, '(?i)VERDICT:[\\t ]*(APPROVE|PASS)') THEN 'approve' WHEN v IS NOT NULL THEN 'changes' ELSE 'unclear' END) AS verdict FROM (SELECT src, {_VERDICT} AS v FROM (SELECT src, coalesce(y.text, '') AS text FROM (SELECT DISTINCT src FROM b WHERE sub) LEFT JOIN y USING (src))) GROUP BY 1), "
    + "rr AS (SELECT profile, stream, arg_min(model, (us_at, key)) AS model, count(*) AS calls, CASE WHEN count(*) FILTER (wout IS NULL) = 0 THEN CAST(floor((sum(wout) + 5000) / 10000.0) AS bigint) END AS cents_out FROM kw WHERE kind = 'sub' AND tm IS NOT NULL GROUP BY 1, 2) "
    + "SELECT ty.profile, ty.stream, rr.model, rr.calls, ty.tokens, ty.type, ty.cents_in, rr.cents_out, CASE WHEN ty.type = 'reviewer' THEN coalesce(jv.verdict, 'unclear') END AS verdict FROM ty JOIN rr USING (profile, stream) LEFT JOIN jv USING (stream)",
)
def runs_in_full(spark, folder):
    """Subagent runs with type, weight and verdict."""
    kept = ops.deduplicated(ops.usage(load(spark, folder, "calls")))
    said = content.verdicts_of_runs(load(spark, folder, "call_log")).select(F.regexp_replace(F.element_at(F.split("src", "/"), -1), r"\.[^.]*$", "").alias("stream"), "verdict")
    full = ops.runs_in_full(kept, _types(spark, folder), _weights(spark), said)
    return full.select("profile", "stream", "model", "calls", "tokens", "type", "cents_in", "cents_out", "verdict")


@_query("a25_memory_sizes", "SELECT repo, count(*) AS files, CAST(sum(size) AS bigint) AS bytes, CAST(sum(size // 4) AS bigint) AS tokens FROM entries WHERE kind = 'file' AND path LIKE '%.md' GROUP BY 1")
def memory_sizes(spark, folder):
    """Notes kept beside the code: files, bytes and about how many tokens, by repository; contents aren't read."""
    notes = load(spark, folder, "entries").where("kind = 'file' AND path LIKE '%.md'")
    return config.sizes(notes, "repo", "size")
