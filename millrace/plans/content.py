"""Queries over the contents of ``call_log`` and over agents, each with the SQL that checks it where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agents as ag
from ..operators import content
from ..tables import load

SPARK, SQL = {}, {}

_LINES = r"""
WITH l AS (
  SELECT log_id, profile, src, line, json::json AS j, string_split(src, '/') AS parts FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT'
), i AS (
  SELECT *, coalesce(len(parts) >= 2 AND parts[-2] = 'subagents', false) AS sub, CASE WHEN json_type(j, '$.sessionId') = 'VARCHAR' THEN lower(j->>'$.sessionId') END AS session,
    CASE WHEN json_type(j, '$.message.role') = 'VARCHAR' THEN j->>'$.message.role' END AS role,
    regexp_extract(CASE WHEN json_type(j, '$.timestamp') = 'VARCHAR' THEN j->>'$.timestamp' ELSE '' END, '^(2[0-9]{3}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-5][0-9])([.,]([0-9]+))?(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?)?$', ['d', 't', 'x', 'f', 'z']) AS m FROM l
), t AS (
  SELECT *, epoch_us(try_cast(m.d || ' ' || m.t AS timestamp)) + CAST(rpad(substr(coalesce(nullif(m.f, ''), '0'), 1, 6), 6, '0') AS bigint)
      - CASE WHEN m.z IN ('', 'Z') THEN 0 ELSE (CASE WHEN m.z[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(m.z, 2, 2) AS bigint) * 3600 + CAST(coalesce(nullif(substr(replace(m.z, ':', ''), 4, 2), ''), '0') AS bigint) * 60) * 1000000 END AS us FROM i
)
"""
_BLOCKS = _LINES + r""", c AS (
  SELECT log_id, profile, src, sub, session, us, CASE json_type(j, '$.message.content') WHEN 'ARRAY' THEN json_extract(j, '$.message.content[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.message.content')] ELSE [] END AS content FROM t
), e AS (
  SELECT log_id, profile, src, sub, session, us, unnest(range(len(content))) AS pos, unnest(content) AS b FROM c
), b AS (
  SELECT *, CASE WHEN json_type(b, '$.type') = 'VARCHAR' THEN b->>'$.type' END AS type, CASE WHEN json_type(b, '$.id') = 'VARCHAR' THEN b->>'$.id' END AS id, CASE WHEN json_type(b, '$.name') = 'VARCHAR' THEN b->>'$.name' END AS name,
    CASE WHEN json_type(b, '$.tool_use_id') = 'VARCHAR' THEN b->>'$.tool_use_id' END AS tool_use_id, CASE WHEN json_type(b, '$.input.file_path') = 'VARCHAR' THEN b->>'$.input.file_path' END AS file_path,
    CASE WHEN coalesce(json_type(b, '$.content'), 'NULL') = 'NULL' THEN 0 WHEN json_type(b, '$.content') = 'VARCHAR' THEN length(b->>'$.content')
      ELSE length(json_extract(b, '$.content')::varchar) + length(regexp_replace(regexp_replace(json_extract(b, '$.content')::varchar, '"([^"\\]|\\.)*"', '', 'g'), '[^,:]', '', 'g')) END AS chars
  FROM e WHERE json_type(b) = 'OBJECT'
), uses AS (
  SELECT * FROM b WHERE type = 'tool_use' AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY log_id, pos) = 1
), results AS (
  SELECT * FROM b WHERE type = 'tool_result' AND tool_use_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tool_use_id ORDER BY log_id, pos) = 1
), named AS (
  SELECT r.tool_use_id, r.chars, coalesce(u.name, 'unknown') AS tool FROM results r LEFT JOIN uses u ON u.id = r.tool_use_id
), reads AS (
  SELECT u.*, coalesce(r.chars, 0) AS n FROM (SELECT * EXCLUDE chars FROM uses WHERE name = 'Read' AND file_path IS NOT NULL) u LEFT JOIN results r ON r.tool_use_id = u.id
)
"""


def _query(name: str, sql: str | None = None):
    def add(f):
        SPARK[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _blocks(spark, folder):
    return content.blocks(load(spark, folder, "call_log"))


@_query("s2_line_classes", "SELECT class, count(*) AS lines FROM (SELECT CASE WHEN coalesce(trim(regexp_replace(json, '\\s+', ' ', 'g')), '') = '' THEN 'blank' WHEN NOT json_valid(json) THEN 'bad json' WHEN json_type(json) = 'OBJECT' THEN 'object' ELSE 'other' END AS class FROM call_log) GROUP BY 1")
def line_classes(spark, folder):
    return content.classified(load(spark, folder, "call_log")).groupBy("class").agg(F.count(F.lit(1)).alias("lines"))


@_query("s5_routed_lines", _LINES + "SELECT log_id, coalesce(role, 'none') AS role, sub, session, us FROM t")
def routed(spark, folder):
    return content.lines(load(spark, folder, "call_log")).select("log_id", F.coalesce("role", F.lit("none")).alias("role"), "sub", "session", "us")


@_query("f35_tool_blocks", _BLOCKS + "SELECT log_id, pos, type, id, tool_use_id, file_path, CAST(chars AS bigint) AS chars FROM b WHERE type IN ('tool_use', 'tool_result')")
def tool_blocks(spark, folder):
    return _blocks(spark, folder).where("type IN ('tool_use', 'tool_result')").select("log_id", "pos", "type", "id", "tool_use_id", "file_path", "chars")


@_query("a5_results_by_tool", _BLOCKS + "SELECT tool, count(*) AS results, CAST(sum(chars) AS bigint) AS chars, CAST(max(chars) AS bigint) AS max_chars, CAST(sum(chars) // 4 AS bigint) AS tokens FROM named GROUP BY 1")
def results_by_tool(spark, folder):
    return content.results_by_tool(_blocks(spark, folder))


@_query("a6_large_results", _BLOCKS + "SELECT tool, count(*) AS results, CAST(sum(chars - 500) AS bigint) AS excess FROM named WHERE chars > 500 GROUP BY 1")
def large_results(spark, folder):
    """With a limit of 500 characters, as results of this data are short."""
    return content.large_results(_blocks(spark, folder), 500)


_LARGE_LINE = """CASE WHEN log_id % 100 = 1 THEN concat('{"type":"user","message":{"role":"user","content":[{"type":"tool_use","id":"q', log_id, '","name":"Grep"},{"type":"tool_result","tool_use_id":"q', log_id, '","content":"', repeat('y', CAST(19990 + log_id % 40 AS int)), '"}]}}') END"""


@_query("a6_results_beyond_20000", "SELECT 'Grep' AS tool, count(*) AS results, CAST(sum(19990 + log_id % 40 - 20000) AS bigint) AS excess FROM call_log WHERE log_id % 100 = 1 AND log_id % 40 > 10")
def results_beyond(spark, folder):
    """At the limit of 20,000 characters, strictly: the table's results, all shorter, and longer ones of some lines."""
    return content.large_results(content.blocks(_with_lines(spark, folder, _LARGE_LINE)))


@_query("t4_largest_results", _BLOCKS + "SELECT tool_use_id, tool, CAST(chars AS bigint) AS chars FROM named ORDER BY chars DESC, tool_use_id LIMIT 10")
def largest_results(spark, folder):
    return content.largest_results(_blocks(spark, folder))


def _with_lines(spark, folder, json):
    """``call_log`` and, of each of its rows, a further line (its JSON the SQL ``json``, null for none), as the table has none of the kind looked for."""
    log = load(spark, folder, "call_log")
    more = log.select(F.col("log_id") + 10**9, "profile", F.concat(F.lit("more/"), F.col("log_id") % 5, F.lit(".jsonl")), F.lit(1), "loaded_at", F.expr(json)).toDF("log_id", "profile", "src", "line", "loaded_at", "json")
    return log.select(*more.columns).unionByName(more.where("json IS NOT NULL"))


_READ_LINE = """concat('{"type":"assistant","timestamp":"2021-01-10T00:00:', lpad(CAST(log_id % 60 AS string), 2, '0'), 'Z","message":{"role":"assistant","content":[{"type":"tool_use","id":"t', log_id, '","name":"Read","input":{"file_path":"f', log_id % 3, '"}},{"type":"tool_result","tool_use_id":"t', log_id, '","content":"', repeat('x', CAST(log_id % 50 AS int)), '"}]}}')"""
_MORE_READS = _BLOCKS + ", more AS (SELECT 'more/' || (log_id % 5) || '.jsonl' AS src, 'f' || (log_id % 3) AS file_path, log_id % 50 AS n, log_id % 60 AS us, 't' || log_id AS id FROM call_log), a AS (SELECT src, file_path, n, us, id FROM reads UNION ALL SELECT * FROM more), h AS (SELECT src, file_path, count(*) AS reads, CAST(sum(n) - arg_min(n, (us IS NULL, us, id)) AS bigint) AS extra_chars FROM a GROUP BY 1, 2 HAVING count(*) >= 3) "


@_query("a7_repeated_reads", _MORE_READS + "SELECT * FROM h")
def repeated_reads(spark, folder):
    """The table's reads, of which hardly any is repeated, and a further one per line."""
    return content.repeated_reads(content.blocks(_with_lines(spark, folder, _READ_LINE)))


@_query("t5_repeated_reads_top", _MORE_READS + "SELECT * FROM h ORDER BY reads DESC, extra_chars DESC, src, file_path LIMIT 10")
def repeated_reads_top(spark, folder):
    return repeated_reads(spark, folder).orderBy(F.desc("reads"), F.desc("extra_chars"), "src", "file_path").limit(10)


@_query("a8_subagent_rereads", _BLOCKS + ", began AS (SELECT src, min(us) AS began FROM b WHERE sub AND us IS NOT NULL GROUP BY 1), par AS (SELECT profile, session, file_path, min(us) AS pus FROM reads WHERE NOT sub AND us IS NOT NULL GROUP BY 1, 2, 3) SELECT r.src, count(*) AS reads, count(*) FILTER (pus < began) AS again, CAST(coalesce(sum(n) FILTER (pus < began), 0) AS bigint) AS chars FROM reads r LEFT JOIN began USING (src) LEFT JOIN par ON par.profile = r.profile AND par.session = r.session AND par.file_path = r.file_path WHERE r.sub GROUP BY 1")
def subagent_rereads(spark, folder):
    return content.rereads_of_parent(_blocks(spark, folder))


_VERDICT = r"list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '(?i)^[*#\s]*VERDICT:[\t ]*(APPROVE|PASS|CHANGES)\b'))[1]"
_LAST = _LINES + r""", z AS (
  SELECT src, line, log_id, CASE json_type(j, '$.message.content') WHEN 'VARCHAR' THEN j->>'$.message.content' WHEN 'OBJECT' THEN CASE WHEN j->>'$.message.content.type' = 'text' THEN j->>'$.message.content.text' ELSE '' END
    ELSE array_to_string(list_transform(list_filter(json_extract(j, '$.message.content[*]'), lambda x: json_type(x) = 'OBJECT' AND json_extract_string(x, '$.type') = 'text' AND json_type(x, '$.text') = 'VARCHAR'), lambda x: json_extract_string(x, '$.text')), chr(10)) END AS text FROM t WHERE role = 'assistant'
), y AS (SELECT src, arg_max(text, (line, log_id)) AS text FROM z WHERE regexp_matches(text, '\S') GROUP BY 1)
"""


@_query("w8_last_texts", _LAST + "SELECT src, text FROM y")
def last_texts(spark, folder):
    return content.last_texts(load(spark, folder, "call_log"))


@_query("f14_verdicts", _LAST + f"SELECT src, CASE WHEN regexp_matches(v, '(?i)VERDICT:[\\t ]*(APPROVE|PASS)') THEN 'approve' WHEN v IS NOT NULL THEN 'changes' ELSE 'unclear' END AS verdict FROM (SELECT src, {_VERDICT} AS v FROM y)")
def verdicts(spark, folder):
    return content.last_texts(load(spark, folder, "call_log")).select("src", content.verdict(F.col("text")).alias("verdict"))


@_query("a18_verdict_counts", _LAST + f"SELECT verdict, count(*) AS files FROM (SELECT CASE WHEN regexp_matches(v, '(?i)VERDICT:[\\t ]*(APPROVE|PASS)') THEN 'approve' WHEN v IS NOT NULL THEN 'changes' ELSE 'unclear' END AS verdict FROM (SELECT {_VERDICT} AS v FROM y)) GROUP BY 1")
def verdict_counts(spark, folder):
    return verdicts(spark, folder).groupBy("verdict").agg(F.count(F.lit(1)).alias("files"))


def _bad(path: str) -> str:
    return f"coalesce(json_type(j, '{path}'), 'NULL') NOT IN ('NULL', 'UBIGINT', 'BIGINT') OR (json_type(j, '{path}') = 'BIGINT' AND CAST(j->>'{path}' AS bigint) < 0)"


_U = "$.message.usage"
_DRIFT = (
    f"CASE WHEN coalesce(json_type(j, '{_U}'), '') <> 'OBJECT' THEN 'usage' "
    + " ".join(f"WHEN {_bad(f'{_U}.{c}')} THEN '{c}'" for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"))
    + f" WHEN coalesce(json_type(j, '{_U}.cache_creation'), 'NULL') NOT IN ('NULL', 'OBJECT') THEN 'cache_creation' "
    + " ".join(f"WHEN {_bad(f'{_U}.cache_creation.ephemeral_{t}_input_tokens')} THEN 'ephemeral_{t}'" for t in ("5m", "1h"))
    + f" WHEN {_bad(_U + '.output_tokens_details.thinking_tokens')} THEN 'thinking_tokens' "
    + " ".join(f"WHEN coalesce(json_type(j, '{p}'), 'NULL') NOT IN ('NULL', 'VARCHAR') THEN '{r}'" for p, r in (("$.message.id", "id"), ("$.requestId", "requestId")))
    + " WHEN json_type(j, '$.message.content') = 'ARRAY' AND len(list_filter(json_extract(j, '$.message.content[*]'), lambda x: json_extract_string(x, '$.type') = 'tool_use' AND (coalesce(json_type(x, '$.id'), '') <> 'VARCHAR' OR json_extract_string(x, '$.id') = ''))) > 0 THEN 'tool_use id'"
    + " WHEN us IS NULL THEN 'timestamp' END"
)


@_query("line_drift", _LINES + f"SELECT log_id, {_DRIFT} AS reason FROM t WHERE role = 'assistant'")
def line_drift(spark, folder):
    """The first reason for which an assistant line is unusable."""
    return content.line_drift(load(spark, folder, "call_log")).select("log_id", "reason")


@_query("a21_drift_counts", _LINES + f"SELECT coalesce({_DRIFT}, 'sound') AS reason, count(*) AS lines FROM t WHERE role = 'assistant' GROUP BY 1")
def drift_counts(spark, folder):
    return line_drift(spark, folder).groupBy(F.coalesce("reason", F.lit("sound")).alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


@_query("q5_drift_share", _LINES + f"SELECT count(*) AS lines, count(reason) AS drifted, count(reason) > count(*) * 0.05 AS failed FROM (SELECT {_DRIFT} AS reason FROM t WHERE role = 'assistant')")
def drift_share(spark, folder):
    from ..operators.quality import drift_share as share

    return share(line_drift(spark, folder))


def _agent_runs(spark, folder):
    """Runs of builders and reviewers, with the verdict of the agent's own file in its session; none without such a file.

    In the test data agents and files have no identifiers in common, so there the verdicts are null.
    """
    a = load(spark, folder, "agents").where("type IN ('builder', 'reviewer')")
    runs = a.groupBy("session_id", "id").agg(F.min_by(F.struct("type", "description", "started_at"), "row_id").alias("r")).select("session_id", "id", "r.*")
    parts = F.split("src", "/")
    said = content.verdicts_of_runs(load(spark, folder, "call_log")).select(
        F.lower(F.element_at(parts, -3)).alias("session"), F.regexp_replace(F.element_at(parts, -1), r"^(?:run|agent)-|\.[^.]*$", "").alias("run"), F.struct("src", "verdict").alias("v")
    )
    said = said.groupBy("session", "run").agg(F.max("v").alias("v"))
    own = F.regexp_replace("id", "^(?:run|agent)-", "")
    return runs.join(said, (F.lower("session_id") == F.col("session")) & (own == F.col("run")), "left").select("session_id", "id", "type", "description", "started_at", F.when(F.col("type") == "reviewer", F.col("v.verdict")).alias("verdict"))


def _judged_runs(spark, folder):
    """The runs with a verdict: that of their own file, or else one told by the end of the id, as files and agents of the test data have none in common."""
    last = F.substring("id", -1, 1)
    told = F.when(last < "6", "changes").when(last < "b", "approve").otherwise("unclear")
    return _agent_runs(spark, folder).withColumn("verdict", F.when(F.col("type") == "reviewer", F.coalesce("verdict", told)))


def _linked(spark, folder):
    return content.linked_runs(_judged_runs(spark, folder))


#: Task linking as a recursion over the runs of all sessions, one run of each a step: the state holds the words and last verdicts of the tasks.
_LINKED = r"""
WITH RECURSIVE a AS (SELECT session_id, id, type, description, started_at FROM agents WHERE type IN ('builder', 'reviewer') QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY row_id) = 1),
r AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN (STOP))) AS ws,
  CASE WHEN type = 'reviewer' THEN CASE WHEN right(id, 1) < '6' THEN 'changes' WHEN right(id, 1) < 'b' THEN 'approve' ELSE 'unclear' END END AS verdict, row_number() OVER (PARTITION BY session_id ORDER BY started_at, id) AS n FROM a),
w AS (
  SELECT session_id, 0::bigint AS n, []::varchar[][] AS words, []::varchar[] AS said, NULL::varchar AS id, NULL::varchar AS type, NULL::bigint AS started_at, NULL::varchar AS verdict, NULL::bigint AS task, NULL::varchar AS how FROM (SELECT DISTINCT session_id FROM r)
  UNION ALL
  SELECT session_id, n, CASE WHEN how = 'time' THEN words WHEN task = len(words) THEN list_append(words, ws) ELSE list_transform(words, lambda t, i: CASE WHEN i = task + 1 THEN list_distinct(list_concat(t, ws)) ELSE t END) END,
    CASE WHEN task = len(said) THEN list_append(said, verdict) WHEN type = 'reviewer' THEN list_transform(said, lambda t, i: CASE WHEN i = task + 1 THEN verdict ELSE t END) ELSE said END, id, type, started_at, verdict, task, how
  FROM (
    SELECT *, CASE WHEN coalesce(best, 0) >= 0.5 THEN len(score) - list_position(list_reverse(score), best) WHEN len(words) > 0 AND (type = 'reviewer' OR said[len(said)] = 'changes') THEN len(words) - 1 ELSE len(words) END AS task,
      CASE WHEN coalesce(best, 0) >= 0.5 THEN 'description' WHEN len(words) > 0 AND (type = 'reviewer' OR coalesce(said[len(said)] = 'changes', false)) THEN 'time' WHEN type = 'builder' THEN 'new' ELSE 'unlinked' END AS how
    FROM (SELECT *, list_max(score) AS best FROM (SELECT w.session_id, r.n, w.words, w.said, r.id, r.type, r.started_at, r.verdict, r.ws, list_transform(w.words, lambda t: CASE WHEN least(len(t), len(r.ws)) > 0 THEN len(list_intersect(t, r.ws)) / least(len(t), len(r.ws)) ELSE 0.0 END) AS score FROM w JOIN r ON r.session_id = w.session_id AND r.n = w.n + 1))
  )
), v AS (SELECT session_id, id, type, started_at, task, how AS linked_by, verdict FROM w WHERE n > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, task, type ORDER BY started_at, id) AS n FROM v),
t AS (SELECT session_id, task, count(*) FILTER (type = 'builder') AS builders, count(*) FILTER (type = 'reviewer') AS rounds, count(*) FILTER (linked_by IN ('time', 'unlinked')) = 0 AS all_linked, count(*) FILTER (verdict = 'approve') AS approve, count(*) FILTER (verdict = 'changes') AS changes, count(*) FILTER (verdict = 'unclear') AS unclear,
  count(*) FILTER (linked_by = 'description') AS by_description, count(*) FILTER (linked_by = 'new') AS by_new, count(*) FILTER (linked_by = 'time') AS by_time, count(*) FILTER (linked_by = 'unlinked') AS by_unlinked,
  coalesce(array_to_string(list(id ORDER BY type, n) FILTER (n > 2), ','), '') AS extra FROM ranked GROUP BY 1, 2)
""".replace("STOP", ", ".join(f"'{w}'" for w in ("a an and the of for to in on with at by build built rebuild validate validation revalidate re review rereview reviewer fix fixes write implement verify check final round rounds pass attempt iteration again follow up").split()))


@_query("w7_task_links", _LINKED + "SELECT * FROM v")
def task_links(spark, folder):
    return _linked(spark, folder)


@_query("a16_tasks", _LINKED + "SELECT session_id, task, builders, rounds, all_linked, approve, changes, unclear, by_description, by_new, by_time, by_unlinked, extra FROM t")
def task_rollup(spark, folder):
    t = content.tasks(_linked(spark, folder))
    return t.select("session_id", "task", "builders", "rounds", "all_linked", "approve", "changes", "unclear", "by_description", "by_new", "by_time", "by_unlinked", F.array_join("extra_runs", ",").alias("extra"))


@_query("a17_rounds", _LINKED + "SELECT rounds, count(*) AS tasks, CAST(floor(median(builders)) AS bigint) AS median_builders FROM t GROUP BY 1")
def rounds(spark, folder):
    return content.rounds_histogram(content.tasks(_linked(spark, folder)))


_TOKENS = ", q AS (SELECT session_id, id, tokens.input + tokens.output + tokens.cache_write AS tokens FROM agents QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY row_id) = 1) "


@_query("j6_extra_run_tokens", _LINKED + _TOKENS + "SELECT x.session_id, x.task, CAST(coalesce(sum(q.tokens), 0) AS bigint) AS tokens FROM (SELECT session_id, task, id FROM ranked WHERE n > 2) x LEFT JOIN q ON q.session_id = x.session_id AND q.id = x.id GROUP BY 1, 2")
def extra_run_tokens(spark, folder):
    """What the runs beyond the second of a task and kind have used."""
    extra = content.tasks(_linked(spark, folder)).select("session_id", "task", F.explode("extra_runs").alias("id"))
    return content.tokens_of(extra, _agent_tokens(spark, folder))


def _agent_tokens(spark, folder):
    t = F.col("tokens")
    return load(spark, folder, "agents").groupBy("session_id", "id").agg(F.min_by(t["input"] + t["output"] + t["cache_write"], "row_id").alias("tokens"))


@_query("a16_task_tokens", _LINKED + _TOKENS + "SELECT v.session_id, v.task, CAST(coalesce(sum(tokens) FILTER (type = 'builder'), 0) AS bigint) AS builder_tokens, CAST(coalesce(sum(tokens) FILTER (type = 'reviewer'), 0) AS bigint) AS reviewer_tokens FROM v LEFT JOIN q ON q.session_id = v.session_id AND q.id = v.id GROUP BY 1, 2")
def task_tokens(spark, folder):
    return content.tokens_by_kind(_linked(spark, folder), _agent_tokens(spark, folder)).groupBy("session_id", "task").agg(*[F.sum(F.when(F.col("type") == k, F.col("tokens")).otherwise(0)).alias(f"{k}_tokens") for k in ("builder", "reviewer")])


@_query("a17_median_tokens", _LINKED + _TOKENS + "SELECT type, count(*) AS runs, CAST(floor(median(coalesce(tokens, 0))) AS bigint) AS median_tokens FROM v LEFT JOIN q ON q.session_id = v.session_id AND q.id = v.id GROUP BY 1")
def median_tokens(spark, folder):
    from ..functions.scalars import whole_median

    return content.tokens_by_kind(_linked(spark, folder), _agent_tokens(spark, folder)).groupBy("type").agg(F.count(F.lit(1)).alias("runs"), whole_median(F.col("tokens")).alias("median_tokens"))


_STOP = ", ".join(f"'{w}'" for w in content.STOP_WORDS)


@_query("f15_task_words", f"SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_STOP})))), ' ') AS words FROM agents")
def task_words(spark, folder):
    from ..functions.scalars import word_set

    return load(spark, folder, "agents").select("row_id", F.array_join(F.sort_array(word_set(F.coalesce("description", F.lit("")), content.STOP_WORDS)), " ").alias("words"))


_MERGE = "WITH a AS (SELECT * FROM agents QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY row_id DESC) = 1), l AS (SELECT * FROM listed_agents QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY listed_at DESC, listing_id DESC) = 1), m AS (SELECT coalesce(a.session_id, l.session_id) AS session_id, coalesce(a.id, l.id) AS id, CASE WHEN l.id IS NULL AND NOT coalesce(a.is_seen, false) AND coalesce(a.misses, 0) + 1 >= 4 THEN 'dropped' WHEN l.id IS NULL AND NOT coalesce(a.is_seen, false) THEN 'missed' WHEN l.id IS NULL THEN 'ended' WHEN a.id IS NULL THEN 'inserted' ELSE 'updated' END AS change, CASE WHEN l.id IS NULL AND coalesce(a.is_seen, false) THEN 'ended' ELSE coalesce(l.status, a.status) END AS status FROM a FULL JOIN l ON a.session_id IS NOT DISTINCT FROM l.session_id AND a.id = l.id) "


@_query("j14_snapshot_merge", _MERGE + "SELECT * FROM m")
def snapshot_merge(spark, folder):
    return ag.merged(load(spark, folder, "agents"), load(spark, folder, "listed_agents")).select("session_id", "id", "change", "status")


@_query("j15_parent_labels", "WITH a AS (SELECT * FROM agents QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1) SELECT a.id, CASE WHEN coalesce(trim(a.parent_id), '') = '' THEN 'main' ELSE coalesce(p.type, substr(a.parent_id, 1, 8)) END AS parent FROM a LEFT JOIN a p ON p.id = a.parent_id")
def parent_labels(spark, folder):
    return ag.parent_labels(load(spark, folder, "agents"))


@_query("pred20_visible_agents", "SELECT row_id FROM agents WHERE status IN ('pending', 'running', 'waiting', 'idle') OR ended_at >= (SELECT max(ended_at) FROM agents) - 10000")
def visible(spark, folder):
    a = load(spark, folder, "agents")
    return ag.visible(a, a.agg(F.max("ended_at").alias("now"))).select("row_id")


@_query("pred21_active_sessions", "SELECT session_id, bool_or(coalesce(status IN ('pending', 'running', 'waiting', 'idle'), false)) AS active FROM agents GROUP BY 1")
def active_sessions(spark, folder):
    return ag.active_sessions(load(spark, folder, "agents"))


@_query("a28_agent_tokens", "SELECT id, CAST(sum(tokens.input + tokens.output + tokens.cache_write) AS bigint) AS total FROM (SELECT DISTINCT id, row_id, tokens FROM agents) GROUP BY 1")
def agent_tokens(spark, folder):
    """Token totals without cache reads."""
    return ag.token_totals(load(spark, folder, "agents"))


@_query("u_status_changes", "SELECT session_id, id, listing_id, before, status FROM (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS n FROM listed_agents WINDOW w AS (PARTITION BY session_id, id ORDER BY listed_at, listing_id)) WHERE n > 1 AND before IS DISTINCT FROM status")
def status_changes(spark, folder):
    return ag.status_changes(load(spark, folder, "listed_agents"))


#: Depth-first order by a path of sort keys; links and cycles as in problem 2.
_TREE = r"""
WITH RECURSIVE ids AS (SELECT id FROM agents WHERE id IS NOT NULL UNION SELECT id FROM listed_agents WHERE id IS NOT NULL),
a AS (SELECT id, parent_id, started_at FROM agents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1),
l AS (SELECT id, parent_id FROM listed_agents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC, listing_id DESC) = 1),
c AS (SELECT ids.id, CASE WHEN l.id IS NOT NULL THEN l.parent_id ELSE a.parent_id END AS p, coalesce(a.started_at, 0) AS began FROM ids LEFT JOIN a ON a.id = ids.id LEFT JOIN l ON l.id = ids.id),
par AS (SELECT c.id, ids.id AS parent, c.began FROM c LEFT JOIN ids ON ids.id = c.p AND trim(c.p) <> ''),
d AS (SELECT id, id AS root, 0::bigint AS depth, [[lpad(began::varchar, 20, '0'), id]] AS path FROM par WHERE parent IS NULL UNION ALL SELECT par.id, d.root, d.depth + 1, list_append(d.path, [lpad(par.began::varchar, 20, '0'), par.id]) FROM d JOIN par ON par.parent = d.id)
SELECT id AS agent_id, root AS root_id, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM d
"""


@_query("w11_tree_order", _TREE)
def tree_order(spark, folder):
    """Depth-first order of each tree, parents first, siblings by start and id; agents on or below cycles have no place in it."""
    from pyspark.sql import Window

    from ..operators.hierarchy import Forest, agent_links

    agents, listed = load(spark, folder, "agents"), load(spark, folder, "listed_agents")
    began = agents.where("id IS NOT NULL").groupBy("id").agg(F.max_by("started_at", F.coalesce("row_id", F.lit(-1))).alias("at"))
    f = Forest(spark, agent_links(agents, listed).join(began, "id", "left").withColumn("at", F.coalesce("at", F.lit(0).cast("bigint"))), by=("at", "id"))
    rooted = f.intervals().join(f.roots().select("agent_id", "depth").where("depth >= 0"), "agent_id")
    return rooted.select("agent_id", "root_id", "depth", (F.row_number().over(Window.partitionBy("root_id").orderBy("enter")) - 1).cast("bigint").alias("place"))
