"""Queries of the general problems: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, drift, nesting, sessions
from ..operators.hierarchy import Forest, agent_links
from ..tables import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.surplus_rows(load(spark, folder, "calls"))


def p1_delivered_once(spark: SparkSession, folder: str) -> DataFrame:
    kept = delivery.delivered_once(load(spark, folder, "calls"))
    return kept.select("row_id", "session_id", "request_id", F.col("message.id").alias("message_id"), F.col("message.usage.output_tokens").alias("output_tokens"))


def _forest(spark: SparkSession, folder: str) -> Forest:
    return Forest(spark, agent_links(load(spark, folder, "agents"), load(spark, folder, "listed_agents")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _forest(spark, folder).roots()


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = _forest(spark, folder).paths()
    return paths.select("agent_id", F.array_join("path", "/").alias("path"), "n_descendants", "on_or_below_cycle")


def p2_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Each agent's interval on its tree's tour, with the number of descendants that lie in it."""
    inside = _forest(spark, folder).intervals()
    return inside.select("agent_id", "root_id", ((F.col("leave") - F.col("enter") - 1) / 2).cast("bigint").alias("n_descendants"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return _forest(spark, folder).descendants()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.Drift(spark, load(spark, folder, "call_log"), load(spark, folder, "log_schema")).changes()


def p3_unified(spark: SparkSession, folder: str) -> DataFrame:
    return drift.Drift(spark, load(spark, folder, "call_log"), load(spark, folder, "log_schema")).unified()


def p3_renames(spark: SparkSession, folder: str) -> DataFrame:
    found = drift.Drift(spark, load(spark, folder, "call_log"), load(spark, folder, "log_schema")).renames()
    return found.select("object", "old_name", "new_name").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.call_sessions(load(spark, folder, "calls")).select("session_id", "start_ms", "end_ms").distinct()


def p4_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.call_sessions(load(spark, folder, "calls"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.Blocks(spark, load(spark, folder, "call_log")).linked().select("log_id", "path", "parent_log_id", "parent_path").distinct()


def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.Blocks(spark, load(spark, folder, "call_log")).linked()


def p5_lines(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.flat_lines(load(spark, folder, "call_log"))


def p5_usage(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.flat_usage(load(spark, folder, "call_log"))


QUERIES = {f.__name__: f for f in (p1_found, p1_delivered_once, p2_found, p2_paths, p2_intervals, p2_descendants, p3_found, p3_unified, p3_renames, p4_found, p4_sessions, p5_found, p5_blocks, p5_lines, p5_usage)}

#: Independent SQL of the problems that SQL can express.
_IDENTIFIED = r"""
WITH p AS (
  SELECT row_id, message.usage.output_tokens AS o, session_id, regexp_extract(ts, '^(2[0-9]{3}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-5][0-9])([.,]([0-9]+))?(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?)?$', ['d', 't', 'x', 'f', 'z']) AS m,
    coalesce(nullif(regexp_replace(message.id, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(request_id, '^\s+|\s+$', '', 'g'), '')) AS key FROM calls
), r AS (
  SELECT row_id, o, session_id, key, epoch_us(try_cast(m.d || ' ' || m.t AS timestamp)) + CAST(rpad(substr(coalesce(nullif(m.f, ''), '0'), 1, 6), 6, '0') AS bigint)
      - CASE WHEN m.z IN ('', 'Z') THEN 0 ELSE (CASE WHEN m.z[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(m.z, 2, 2) AS bigint) * 3600 + CAST(coalesce(nullif(substr(replace(m.z, ':', ''), 4, 2), ''), '0') AS bigint) * 60) * 1000000 END AS us FROM p
)
"""
_RANKED = _IDENTIFIED + ", k AS (SELECT row_id, key, row_number() OVER (PARTITION BY key ORDER BY coalesce(o, -1) DESC, us IS NULL, us, row_id) AS n FROM r) "
_STRETCHES = _IDENTIFIED + ", e AS (SELECT lower(session_id) AS session_id, us, us - lag(us) OVER (PARTITION BY lower(session_id) ORDER BY us) > 1800000000 AS new FROM r WHERE trim(session_id) <> '' AND us IS NOT NULL), g AS (SELECT session_id, us, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY us) AS n FROM e) "
_LINKS = r"""
WITH RECURSIVE ids AS (SELECT id FROM agents WHERE id IS NOT NULL UNION SELECT id FROM listed_agents WHERE id IS NOT NULL),
a AS (SELECT id, parent_id FROM agents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1),
l AS (SELECT id, parent_id FROM listed_agents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY listed_at DESC, listing_id DESC) = 1),
c AS (SELECT ids.id, CASE WHEN l.id IS NOT NULL THEN l.parent_id ELSE a.parent_id END AS p FROM ids LEFT JOIN a ON a.id = ids.id LEFT JOIN l ON l.id = ids.id),
par AS (SELECT c.id, ids.id AS parent FROM c LEFT JOIN ids ON ids.id = c.p AND trim(c.p) <> ''),
w AS (SELECT id AS start, id AS cur, [id] AS path, false AS ring FROM par UNION ALL SELECT w.start, par.parent, list_append(w.path, par.parent), list_contains(w.path, par.parent) FROM w JOIN par ON par.id = w.cur WHERE par.parent IS NOT NULL AND NOT w.ring),
f AS (SELECT start, arg_max(cur, len(path)) AS cur, arg_max(path, len(path)) AS path, bool_or(ring) AS ring FROM w GROUP BY 1)
"""
_ABOVE = ", h AS (SELECT start, ring, CASE WHEN ring THEN path[:list_position(path, cur)] ELSE path END AS up FROM f), y AS (SELECT * FROM (SELECT start, unnest(up) AS a, unnest(range(len(up))) AS d FROM h) WHERE d > 0) "
_NESTED = r"""
WITH RECURSIVE l AS (SELECT log_id, json_extract(json, '$.message.content') AS c FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT'),
e AS (SELECT log_id, '' AS up, CASE json_type(c) WHEN 'ARRAY' THEN json_extract(c, '$[*]') WHEN 'OBJECT' THEN [c] ELSE [] END AS xs FROM l),
b AS (
  SELECT log_id, up, i::varchar AS path, x FROM (SELECT log_id, up, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM e) WHERE json_type(x) = 'OBJECT'
  UNION ALL
  SELECT log_id, up, up || '/' || i, x FROM (SELECT log_id, path AS up, unnest(range(len(xs))) AS i, unnest(xs) AS x FROM (SELECT log_id, path, CASE json_type(x, '$.content') WHEN 'ARRAY' THEN json_extract(x, '$.content[*]') WHEN 'OBJECT' THEN [json_extract(x, '$.content')] ELSE [] END AS xs FROM b)) WHERE json_type(x) = 'OBJECT'
),
u AS (SELECT x->>'$.id' AS id, arg_min(struct_pack(log_id := log_id, path := path), (log_id, list_transform(string_split(path, '/'), lambda k: CAST(k AS int)))) AS t FROM b WHERE json_type(x, '$.id') = 'VARCHAR' AND x->>'$.type' = 'tool_use' GROUP BY 1),
d AS (SELECT b.log_id, b.path, coalesce(u.t.log_id, b.log_id) AS parent_log_id, coalesce(u.t.path, b.up) AS parent_path FROM b LEFT JOIN u ON b.x->>'$.type' = 'tool_result' AND json_type(b.x, '$.tool_use_id') = 'VARCHAR' AND u.id = b.x->>'$.tool_use_id')
"""
#: Here fields lost and gained of one type are paired by name alone, which is enough unless more are lost than gained.
_CHANGES = r"""
WITH l AS (SELECT log_id, src, json::json AS j FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT' AND json_type(json, '$.message') = 'OBJECT' AND json_extract_string(json, '$.message.role') = 'assistant'),
s AS (SELECT CASE WHEN contains(field, '.') THEN regexp_replace(field, '\.[^.]*$', '') ELSE '' END AS obj, regexp_extract(field, '[^.]*$') AS name, json_type, is_required, field, field IN ('type', 'message.model', 'message.usage') OR starts_with(field, 'message.usage.') AS within FROM log_schema),
o AS (SELECT log_id, src, p AS obj, CASE WHEN p = '' THEN j ELSE json_extract(j, '$.' || p) END AS x FROM l, (SELECT DISTINCT obj AS p FROM s) WHERE p = '' OR json_type(j, '$.' || p) = 'OBJECT'),
k AS (SELECT log_id, src, obj, name, CASE json_type(x, '$."' || name || '"') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(json_type(x, '$."' || name || '"')) END AS kind FROM (SELECT *, unnest(json_keys(x)) AS name FROM o)),
lost AS (SELECT o.log_id, o.src, o.obj, s.name, s.field, s.within, s.json_type AS kind, row_number() OVER (PARTITION BY o.log_id, o.obj, s.json_type ORDER BY s.name) AS n FROM o JOIN s ON s.obj = o.obj AND s.is_required WHERE NOT list_contains(json_keys(o.x), s.name)),
gain AS (SELECT k.*, row_number() OVER (PARTITION BY k.log_id, k.obj, k.kind ORDER BY k.name) AS n FROM k ANTI JOIN s ON s.obj = k.obj AND s.name = k.name),
c AS (
  SELECT lost.src, field, CASE WHEN gain.name IS NULL THEN 'removed' ELSE 'renamed' END AS change FROM lost LEFT JOIN gain ON gain.log_id = lost.log_id AND gain.obj = lost.obj AND gain.kind = lost.kind AND gain.n = lost.n WHERE within
  UNION ALL SELECT gain.src, CASE WHEN gain.obj = '' THEN '' ELSE gain.obj || '.' END || gain.name, 'added' FROM gain ANTI JOIN lost ON gain.log_id = lost.log_id AND gain.obj = lost.obj AND gain.kind = lost.kind AND gain.n = lost.n
  UNION ALL SELECT k.src, s.field, 'retyped' FROM k JOIN s ON s.obj = k.obj AND s.name = k.name WHERE s.within AND s.json_type <> 'any' AND k.kind NOT IN ('null', s.json_type)
)
"""
_FIELDS = [("type", "", "type", "string"), ("message_model", "message", "model", "string"), ("message_usage_service_tier", "usage", "service_tier", "string"), *[(f"message_usage_{c}", "usage", c, "integer") for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")]]
_FIELDS += [(f"message_usage_cache_creation_{c}", "creation", c, "integer") for c in ("ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens")] + [("message_usage_output_tokens_details_thinking_tokens", "details", "thinking_tokens", "integer")]
_PATHS = {"": "", "message": "message", "usage": "message.usage", "creation": "message.usage.cache_creation", "details": "message.usage.output_tokens_details"}


def _moved(at: str, name: str) -> str:
    """SQL: a field of the object ``at``, from its own or its new name."""
    full = f"{_PATHS[at]}.{name}" if at else name
    return f"coalesce(json_extract({at or 'j'}, '$.\"{name}\"'), CASE WHEN mv['{full}'] IS NOT NULL THEN json_extract({at or 'j'}, '$.\"' || mv['{full}'] || '\"') END)"


def _object(at: str, name: str) -> str:
    return f"CASE WHEN json_type({_moved(at, name)}) = 'OBJECT' THEN {_moved(at, name)} END"


def _column(name: str, at: str, own: str, kind: str) -> str:
    x = _moved(at, own)
    if kind == "string":
        return f"CASE WHEN json_type({x}) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN {x}->>'$' END AS {name}"
    number = f"try_cast({x}->>'$' AS decimal(38, 9))"
    return f"CASE WHEN json_type({x}) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') AND {number} = floor({number}) THEN CAST({number} AS bigint) END AS {name}"


_UNIFIED = _CHANGES + ", mv AS (SELECT lost.log_id, map_from_entries(list((lost.field, gain.name))) AS mv FROM lost JOIN gain ON gain.log_id = lost.log_id AND gain.obj = lost.obj AND gain.kind = lost.kind AND gain.n = lost.n GROUP BY 1), "
_UNIFIED += f"a AS (SELECT l.*, coalesce(mv.mv, MAP {{}}) AS mv FROM l LEFT JOIN mv USING (log_id)), b AS (SELECT *, {_object('', 'message')} AS message FROM a), c2 AS (SELECT *, {_object('message', 'usage')} AS usage FROM b), d AS (SELECT *, {_object('usage', 'cache_creation')} AS creation, {_object('usage', 'output_tokens_details')} AS details FROM c2) "
SQL = {
    "p3_unified": _UNIFIED + "SELECT log_id, src, " + ", ".join(_column(*f) for f in _FIELDS) + " FROM d",
    "p3_renames": _CHANGES + "SELECT DISTINCT lost.obj AS object, lost.name AS old_name, gain.name AS new_name FROM lost JOIN gain ON gain.log_id = lost.log_id AND gain.obj = lost.obj AND gain.kind = lost.kind AND gain.n = lost.n",
    "p5_blocks": _NESTED.replace("d AS (SELECT b.log_id, b.path,", "d AS (SELECT b.log_id, b.path, " + ", ".join(f"CASE WHEN json_type(b.x, '$.{k}') = 'VARCHAR' THEN b.x->>'$.{k}' END AS {k}" for k in ("type", "id", "tool_use_id", "name")) + ",") + "SELECT * FROM d",
    "p2_intervals": _LINKS + _ABOVE + "SELECT start AS agent_id, CASE WHEN ring THEN up[len(up)] ELSE cur END AS root_id, coalesce(n, 0) AS n_descendants FROM h JOIN f USING (start, ring) LEFT JOIN (SELECT a, count(*) AS n FROM y GROUP BY 1) ON a = start",
    "p3_found": _CHANGES + "SELECT DISTINCT src, field, change FROM c",
    "p1_found": _RANKED + "SELECT row_id FROM k WHERE key IS NOT NULL AND n > 1",
    "p1_delivered_once": _RANKED + "SELECT c.row_id, c.session_id, c.request_id, c.message.id AS message_id, c.message.usage.output_tokens AS output_tokens FROM calls c JOIN k ON k.row_id = c.row_id WHERE key IS NULL OR n = 1",
    "p2_found": _LINKS + "SELECT start AS agent_id, CASE WHEN ring THEN list_min(path[list_position(path, cur):]) ELSE cur END AS root_id, CASE WHEN ring THEN -1 ELSE len(path) - 1 END::bigint AS depth FROM f",
    "p2_paths": _LINKS + _ABOVE + "SELECT start AS agent_id, array_to_string(list_reverse(up), '/') AS path, coalesce(n, 0) AS n_descendants, ring AS on_or_below_cycle FROM h LEFT JOIN (SELECT a, count(*) AS n FROM y GROUP BY 1) ON a = start",
    "p2_descendants": _LINKS + _ABOVE + "SELECT a AS ancestor_id, start AS descendant_id, CAST(d AS bigint) AS distance FROM y",
    "p4_found": _STRETCHES + "SELECT session_id, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms FROM g GROUP BY session_id, n",
    "p4_sessions": _STRETCHES + "SELECT session_id, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms, max(us) // 1000 - min(us) // 1000 AS duration_ms, count(*) AS calls FROM g GROUP BY session_id, n",
    "p5_found": _NESTED + "SELECT DISTINCT * FROM d",
    "p5_lines": r"WITH l AS (SELECT *, json::json AS j FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT') SELECT log_id, src, line, "
    + ", ".join(f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN j->>'{path}' END AS {name}" for path, name in (("$.type", "type"), ("$.timestamp", "ts"), ("$.sessionId", "session_id"), ("$.uuid", "uuid"), ("$.requestId", "request_id"), ("$.message.id", "message_id"), ("$.message.role", "role"), ("$.message.model", "model")))
    + " FROM l",
    "p5_usage": "WITH u AS (SELECT log_id, json_extract(json, '$.message.usage') AS u FROM call_log WHERE json_valid(json) AND json_type(json, '$.message.usage') = 'OBJECT'), "
    + "k AS (SELECT log_id, '' AS parent_path, unnest(json_keys(u)) AS field, u AS x FROM u), n AS (SELECT log_id, field AS parent_path, json_extract(x, '$.\"' || field || '\"') AS x FROM k WHERE json_type(x, '$.\"' || field || '\"') = 'OBJECT'), "
    + "a AS (SELECT * FROM k UNION ALL SELECT log_id, parent_path, unnest(json_keys(x)), x FROM n) SELECT log_id, parent_path, field, CAST(json_extract_string(x, '$.\"' || field || '\"') AS bigint) AS tokens FROM a WHERE json_type(x, '$.\"' || field || '\"') IN ('UBIGINT', 'BIGINT')",
}
