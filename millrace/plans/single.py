"""Queries of single functions and small operators over whole tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import agents as ag
from ..operators import alerts
from ..operators import content, scan
from ..operators import usage as ops
from ..sinks import outputs
from ..sources import config
from ..streaming.run import status_line
from ..tables import load
from .usage import _BASE

SPARK, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        SPARK[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_query("f2_strict_dates", "SELECT row_id, CASE WHEN regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(try_cast(d AS date) AS varchar) END AS day FROM (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN substr(ts, 1, 10) WHEN row_id % 3 = 1 THEN substr(ts, 1, 9) || (row_id % 10) ELSE '2021-02-' || (row_id % 31) END AS d FROM calls)")
def strict_dates(spark, folder):
    k = F.col("row_id") % 3
    d = F.when(k == 0, F.substring("ts", 1, 10)).when(k == 1, F.concat(F.substring("ts", 1, 9), (F.col("row_id") % 10).cast("string"))).otherwise(F.concat(F.lit("2021-02-"), (F.col("row_id") % 31).cast("string")))
    return load(spark, folder, "calls").select("row_id", fn.strict_date(d).cast("string").alias("day"))


@_query("f17_masked", "SELECT row_id, CASE WHEN length(b) >= 10 THEN '****' || right(b, 4) WHEN length(b) > 4 THEN '****' || right(b, 2) ELSE '****' END AS shown FROM (SELECT row_id, regexp_replace(substr(request_id, 1, (row_id % 16)::int), '[\\s()-]', '', 'g') AS b FROM calls WHERE request_id IS NOT NULL)")
def masked(spark, folder):
    x = load(spark, folder, "calls").where("request_id IS NOT NULL").selectExpr("row_id", "substr(request_id, 1, CAST(row_id % 16 AS int)) AS v")
    return x.select("row_id", fn.masked(F.col("v")).alias("shown"))


@_query("f19_markdown_cells", "SELECT doc_id, md5(regexp_replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), '[\\r\\n]+', ' ', 'g')) AS cell FROM documents WHERE text IS NOT NULL")
def markdown_cells(spark, folder):
    return load(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(fn.markdown_cell(F.col("text"))).alias("cell"))


@_query("f20_hidden_characters", "SELECT doc_id, line, 'U+00AD SOFT HYPHEN' AS detail FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL) WHERE contains(t, chr(173))")
def hidden_characters(spark, folder):
    d = load(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.lit("").alias("path"), "text")
    return scan.line_findings(scan.lines(d), {"soft-hyphen"}).select("doc_id", "line", "detail")


_MS = "WITH s AS (SELECT DISTINCT message.usage.cache_read_input_tokens AS n FROM calls WHERE message.usage.cache_read_input_tokens >= 0) "


def _numbers(spark, folder):
    return load(spark, folder, "calls").select(F.col("message.usage.cache_read_input_tokens").alias("n")).where("n >= 0").distinct()


@_query("f24_remaining", _MS + "SELECT n, CASE WHEN m < 1 THEN '<1m' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m // 1440) || 'd ' || ((m // 60) % 24) || 'h' END AS left_ FROM (SELECT n, n * 997 // 60000 AS m FROM s)")
def remaining(spark, folder):
    return _numbers(spark, folder).select("n", fn.remaining(F.col("n") * 997).alias("left_"))


@_query("f25_fitted", "SELECT doc_id, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 39) || '…' END AS line FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)")
def fitted(spark, folder):
    return load(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", fn.fit(F.col("text"), 40).alias("line"))


@_query("f26_amounts", _MS + "SELECT n, regexp_replace(reverse(regexp_replace(reverse(n::varchar), '(\\d{3})', '\\1,', 'g')), '^,', '') AS grouped, '$' || (n // 1000) || '.' || lpad((((n % 1000) + 5) // 10 % 100)::varchar, 2, '0') AS usd, (n // 100) || '.' || ((n // 10) % 10) || '%' AS share FROM s WHERE n % 1000 < 995 AND n % 10 < 5")
def amounts(spark, folder):
    n = F.col("n")
    return _numbers(spark, folder).where("n % 1000 < 995 AND n % 10 < 5").select("n", fn.grouped(n).alias("grouped"), fn.usd(n.cast("decimal(20,3)") / 1000).alias("usd"), fn.pct1(n.cast("decimal(20,2)") / 100).alias("share"))


@_query("f27_short_tools", "SELECT row_id, tool, CASE WHEN starts_with(tool, 'mcp__') THEN string_split(tool, '__')[-1] ELSE tool END AS short FROM (SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'mcp__' || type || '__' ELSE '' END || c.tool AS tool FROM (SELECT row_id, type, unnest(calls) AS c FROM agents))")
def short_tools(spark, folder):
    x = load(spark, folder, "agents").select("row_id", "type", F.explode("calls").alias("c"))
    tool = F.concat(F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("mcp__"), "type", F.lit("__"))).otherwise(""), F.col("c.tool"))
    return x.select("row_id", tool.alias("tool"), fn.short_tool(tool).alias("short"))


@_query("f28_window_labels", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '5h' WHEN 1 THEN '7d' ELSE 'per ' || event_type || CASE WHEN event_id % 4 = 2 THEN ' day' ELSE '' END END AS label FROM events")
def window_labels(spark, folder):
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "five_hour").when(k == 1, "seven_day").otherwise(F.concat(F.lit("per_"), "event_type", F.when(k == 2, "_day").otherwise("")))
    return load(spark, folder, "events").select("event_id", fn.window_label(kind).alias("label"))


@_query("f32_status_lines", _BASE + ", z AS (SELECT session, arg_max(struct_pack(ctx := ctx, i := inp + w5 + w1 + read, o := \"out\", r := read), (us_at, key)) AS z FROM k WHERE session IS NOT NULL AND us_at IS NOT NULL GROUP BY 1) SELECT session, 'ctx ' || CAST(floor(z.ctx * 100 / 200000 + 0.5) AS bigint) || '% ' || f(z.ctx) || '/200k · turn in ' || f(z.i) || ' out ' || f(z.o) || CASE WHEN z.i > 0 THEN ' cache ' || CAST(floor(z.r * 100 / z.i + 0.5) AS bigint) || '%' ELSE '' END AS line FROM z"
    .replace("f(z.ctx)", "K1").replace("f(z.i)", "K2").replace("f(z.o)", "K3"))
def status_lines(spark, folder):
    """The status line after the last call of each session."""
    k = ops.deduplicated(ops.usage(load(spark, folder, "calls"))).where("session IS NOT NULL AND at IS NOT NULL")
    last = k.groupBy("session").agg(F.max_by(F.struct(ops.context().alias("tokens"), F.col("out").alias("turn_out"), F.col("read").alias("turn_cached")), F.struct("at", "key")).alias("z"))
    x = last.select("session", "z.tokens", F.lit(200_000).alias("window"), F.col("z.tokens").alias("turn_in"), "z.turn_out", "z.turn_cached")
    return status_line(x)


_K = "CASE WHEN {n} < 1000 THEN {n}::varchar WHEN {n} < 99950 THEN CASE WHEN (({n} + 50) // 100) % 10 = 0 THEN (({n} + 50) // 1000)::varchar ELSE (({n} + 50) // 1000)::varchar || '.' || ((({n} + 50) // 100) % 10)::varchar END || 'k' WHEN ({n} + 500) // 1000 < 1000 THEN (({n} + 500) // 1000)::varchar || 'k' ELSE (({n} + 50000) // 1000000)::varchar || '.' || ((({n} + 50000) // 100000) % 10)::varchar || 'M' END"
for _n, _c in (("K1", "z.ctx"), ("K2", "z.i"), ("K3", "z.o")):
    SQL["f32_status_lines"] = SQL["f32_status_lines"].replace(_n, "(" + _K.format(n=_c) + ")")


@_query("f33_figures", "SELECT row_id, f[1 + (started_at // 500) % len(f)] AS frame FROM (SELECT row_id, started_at, CASE list_sum(list_transform(string_split(id, ''), lambda c: ascii(c))) % 4 WHEN 0 THEN ['><>  ', ' ><> ', '  ><>', ' ><> '] WHEN 1 THEN ['~~~o ', '~~o~ ', '~o~~ ', 'o~~~ '] WHEN 2 THEN ['^v^  ', 'v^v  '] ELSE ['(o,o)', '(-,-)', '(o,o)', '(o,o)'] END AS f FROM agents WHERE id IS NOT NULL AND started_at IS NOT NULL)")
def figures(spark, folder):
    return load(spark, folder, "agents").where("id IS NOT NULL AND started_at IS NOT NULL").select("row_id", fn.figure(F.col("id"), F.col("started_at")).alias("frame"))


@_query("f36_numbers", "SELECT log_id, CASE WHEN json_type(x) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') THEN CAST(try_cast(x->>'$' AS decimal(38, 9)) AS double) END AS n FROM (SELECT log_id, json_extract(json, '$.message.usage.input_tokens') AS x FROM call_log WHERE json_valid(json)) WHERE x IS NOT NULL")
def numbers(spark, folder):
    x = load(spark, folder, "call_log").select("log_id", F.expr("try_variant_get(try_parse_json(json), '$.message.usage.input_tokens', 'variant')").alias("x")).where("x IS NOT NULL")
    return x.select("log_id", fn.as_number("x").cast("double").alias("n"))


@_query("f6_half_up", _MS + "SELECT n, ((n * 2 + 10) // 20) AS tenths FROM s")
def roundings(spark, folder):
    """Half up to tenths of hundredths."""
    return _numbers(spark, folder).select("n", (F.round(F.col("n").cast("decimal(20,2)") / 100, 1) * 10).cast("bigint").alias("tenths"))


@_query("pred9_safe_values", "SELECT entry_id, coalesce(regexp_full_match(path, '[A-Za-z0-9_.:\\[\\]-]{1,64}'), false) AS safe FROM (SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN path ELSE replace(path, '/', '.') END AS path FROM entries)")
def safe_values(spark, folder):
    v = F.when(F.col("entry_id") % 2 == 0, F.col("path")).otherwise(F.replace("path", F.lit("/"), F.lit(".")))
    return load(spark, folder, "entries").select("entry_id", fn.is_safe_scalar(v).alias("safe"))


@_query("pred10_settings", "SELECT log_id, CASE WHEN json_type(json, '$.type') = 'VARCHAR' THEN json_extract_string(json, '$.type') END AS type, array_to_string(list_sort(list_filter(json_keys(json), lambda k: k NOT IN ('type', 'timestamp'))), ',') AS other_keys FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT'")
def settings(spark, folder):
    """Objects reduced to the values of keys that may be shown and the names of the others (P10)."""
    x = load(spark, folder, "call_log").select("log_id", F.expr("try_parse_json(json)").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT<%'")
    shown = config.projected("v", ("type", "timestamp"))
    return x.select("log_id", F.expr(shown[0]).alias("m"), F.expr(shown[1]).alias("others")).select("log_id", F.col("m")["type"].alias("type"), F.array_join("others", ",").alias("other_keys"))


@_query("pred11_scopes", _BASE + "SELECT s.scope, count(*) AS calls FROM k, (VALUES ('all'), ('main'), ('subagent')) s(scope) WHERE s.scope = 'all' OR (s.scope = 'main') = (kind <> 'sub') GROUP BY 1")
def scopes(spark, folder):
    k = ops.deduplicated(ops.usage(load(spark, folder, "calls")))
    x = k.select("kind", F.explode(F.array(*map(F.lit, ("all", "main", "subagent")))).alias("scope"))
    return ops.in_scope(x).groupBy("scope").agg(F.count(F.lit(1)).alias("calls"))


@_query("pred12_contexts", _BASE + 'SELECT key, ctx, ctx + "out" AS total FROM k')
def contexts(spark, folder):
    return ops.deduplicated(ops.usage(load(spark, folder, "calls"))).select("key", ops.context().alias("ctx"), (ops.context() + F.col("out")).alias("total"))


@_query("pred16_globs", "SELECT entry_id, path LIKE 'src/%' OR regexp_full_match(path, '.*/[a-m].*\\.py') OR regexp_full_match(path, 'docs/.*\\.md') AS hit FROM entries")
def globs(spark, folder):
    """Paths by patterns, in which '*' spans folders and brackets name characters."""
    hit = F.lit(False)
    for g in ("src/*", "docs/*.md", "*/[a-m]*.py"):
        hit = hit | F.col("path").rlike("^" + scan.glob_regex(g))
    return load(spark, folder, "entries").select("entry_id", hit.alias("hit"))


_NOW = "(SELECT max(started_at) FROM agents)"


@_query("pred19_live", f"SELECT row_id, ended_at IS NULL OR ended_at > {_NOW} AS live FROM agents")
def live(spark, folder):
    a = load(spark, folder, "agents")
    return a.select("row_id", alerts.is_live(F.col("ended_at"), a.agg(F.max("started_at").alias("n")).scalar()).alias("live"))


_MEASURES = "m AS (SELECT user_id, date_trunc('hour', ts) AS hour, list_sort(list({'kind': event_type, 'resets': h, 'percent': v})) AS w FROM (SELECT user_id, event_type, date_trunc('hour', ts) AS ts, CAST(epoch(date_trunc('day', ts)) AS bigint) AS h, CAST(floor(max(value)) AS bigint) // 10 AS v FROM events GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"


@_query("m10_window_changes", f"WITH {_MEASURES} SELECT user_id, epoch_us(hour) AS at FROM (SELECT *, lag(w) OVER (PARTITION BY user_id ORDER BY hour) AS before FROM m) WHERE before IS NULL OR before <> w")
def window_changes(spark, folder):
    """Measures whose rate windows changed: each kind of event of a user is a window, an hour's events are a measure."""
    e = load(spark, folder, "events").withColumns({"hour": F.date_trunc("hour", "ts"), "resets": F.unix_seconds(F.date_trunc("day", "ts"))})
    per = e.groupBy("user_id", "hour", F.col("event_type").alias("kind"), "resets").agg(F.expr("floor(max(value)) div 10").cast("bigint").alias("percent"))
    m = per.groupBy("user_id", "hour").agg(F.collect_list(F.struct("kind", "resets", "percent")).alias("w")).withColumn("day", F.to_date("hour"))
    return alerts.window_changes(m, "user_id", "hour", "day", "w").select("user_id", F.unix_micros("hour").alias("at"))


@_query("m11_ratchet", "WITH m AS (SELECT event_id, user_id, event_type, ts, CAST(floor(value) AS bigint) % 101 AS p FROM events), l AS (SELECT *, CASE WHEN p >= 95 THEN 2 WHEN p >= 80 THEN 1 ELSE 0 END AS level FROM m) SELECT event_id, level FROM (SELECT *, max(level) OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM l) WHERE level > coalesce(most, 0)")
def ratchet(spark, folder):
    """Rises of the level of a kind within its period, here a day."""
    e = load(spark, folder, "events").withColumns({"p": F.floor("value").cast("bigint") % 101, "o": F.struct("ts", "event_id"), "period": F.date_trunc("day", "ts"), "hour": F.date_trunc("hour", "ts")})
    return alerts.ratchet(e, ["user_id", "event_type", "period"], "o", "hour", "p").select("event_id", "level")


@_query("m15_crossings", "SELECT event_id FROM (SELECT *, lag(p) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, CAST(floor(value) AS bigint) % 101 AS p FROM events)) WHERE p >= 80 AND NOT coalesce(before >= 80, false)")
def crossings(spark, folder):
    """Upward crossings, re-armed by a fall."""
    e = load(spark, folder, "events").withColumns({"p": F.floor("value").cast("bigint") % 101, "o": F.struct("ts", "event_id"), "hour": F.date_trunc("hour", "ts")})
    return alerts.crossings(e, "user_id", "o", "hour", "p").select("event_id")


@_query("j12_changed_files", "SELECT entry_id FROM entries WHERE repo || '/' || path IN (SELECT repo || '/' || path FROM entries WHERE entry_id % 7 = 0)")
def changed_files(spark, folder):
    """Entries limited to the paths of a change."""
    e = load(spark, folder, "entries")
    changed = e.where("entry_id % 7 = 0").select("repo", "path").distinct()
    return e.join(changed, ["repo", "path"], "left_semi").select("entry_id")


@_query("j13_blobs", "WITH b AS (SELECT DISTINCT sha256(data) AS sha, octet_length(data) AS n FROM entries WHERE data IS NOT NULL) SELECT entry_id, n AS bytes FROM entries JOIN b ON sha256(data) = sha WHERE data IS NOT NULL")
def blobs(spark, folder):
    """Entries joined to their contents by hash, equal contents being held once."""
    e = load(spark, folder, "entries").where("data IS NOT NULL").withColumn("sha", F.sha2("data", 256))
    held = e.groupBy("sha").agg(F.first(F.octet_length("data")).cast("bigint").alias("bytes"))
    return e.select("entry_id", "sha").join(held, "sha").select("entry_id", "bytes")


@_query("j16_merged_profiles", "SELECT cwd, arg_max(profile, (profile <> 'default', profile)) AS profile FROM calls WHERE cwd IS NOT NULL AND profile IS NOT NULL GROUP BY 1")
def merged_profiles(spark, folder):
    """One profile per folder: a named one wins over the implied."""
    c = load(spark, folder, "calls").where("cwd IS NOT NULL AND profile IS NOT NULL")
    return c.groupBy("cwd").agg(F.max_by("profile", F.struct(F.col("profile") != "default", "profile")).alias("profile"))


@_query("a30_null_shares", "SELECT entry_id, len(list_filter(regexp_extract_all(h, '(..)(..)?', 1), lambda x: x = '00')) AS even, len(list_filter(regexp_extract_all(h, '(..)(..)?', 2), lambda x: x = '00')) AS odd FROM (SELECT entry_id, hex(data[:8192]) AS h FROM entries WHERE data IS NOT NULL)")
def null_shares(spark, folder):
    """NUL bytes at even and odd places of the first 8 KiB, by which UTF-16 without a mark is told."""
    even, odd = scan.null_counts(F.col("data"))
    return load(spark, folder, "entries").where("data IS NOT NULL").select("entry_id", even.cast("bigint").alias("even"), odd.cast("bigint").alias("odd"))


@_query("a31_not_found", "SELECT DISTINCT entry_id FROM entries WHERE kind = 'file' AND entry_id % 4 = 0 EXCEPT SELECT entry_id FROM entries WHERE kind = 'file' AND size % 3 = 0")
def not_found(spark, folder):
    """What was planted and wasn't found."""
    e = load(spark, folder, "entries").where("kind = 'file'")
    return e.where("entry_id % 4 = 0").select("entry_id").subtract(e.where("size % 3 = 0").select("entry_id"))


@_query("t2_weeks", _BASE + "SELECT week, row_number() OVER (ORDER BY week) AS place FROM (SELECT DISTINCT strftime(tm, '%G-W%V') AS week FROM k WHERE tm IS NOT NULL)")
def weeks(spark, folder):
    """Weeks in their order, as texts; one row per week, so that a window over all is small."""
    k = ops.usage(load(spark, folder, "calls")).where("at IS NOT NULL").select(fn.iso_week(F.col("at")).alias("week")).distinct()
    return k.withColumn("place", F.row_number().over(Window.orderBy("week")))


@_query("t10_band", "WITH a AS (SELECT * FROM agents QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY row_id) = 1) SELECT session_id, id, place, greatest(n - 6, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY started_at, id) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM a) WHERE place <= 6")
def band(spark, folder):
    """The first six agents of each session and how many more there are."""
    a = load(spark, folder, "agents").groupBy("session_id", "id").agg(F.min_by("started_at", "row_id").alias("started_at"))
    return ag.band(a)


@_query("t11_latest_listings", "SELECT session_id, arg_max(listing_id, (listed_at, listing_id)) AS listing_id FROM listed_agents GROUP BY 1")
def latest_listings(spark, folder):
    """The latest of several runs or listings, by time and then by id."""
    x = load(spark, folder, "listed_agents")
    return x.groupBy("session_id").agg(F.max_by("listing_id", F.struct("listed_at", "listing_id")).alias("listing_id"))


@_query("s10_front_matter", "SELECT doc_id, 'd' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN 'a, b' END AS tags FROM documents")
def front_matter(spark, folder):
    """The settings at the head of texts: each document gets some, its own text follows."""
    head = F.concat(F.lit("---\nname: d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "\ntags:\n- a\n- b").otherwise(""), F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    m = config.front_matter(head)
    return load(spark, folder, "documents").select("doc_id", m["name"].alias("name"), m["tags"].alias("tags"))


@_query("scan_unknown_severities", "SELECT 0 AS unknown")
def known_severities(spark, folder):
    """Findings of a rule without a severity: none may be."""
    f = scan.findings(load(spark, folder, "entries"))
    return f.agg(F.count_if(F.col("severity").isNull()).cast("int").alias("unknown"))


@_query("d1_content_lengths", "SELECT log_id, CASE WHEN coalesce(json_type(c), 'NULL') = 'NULL' THEN 0 WHEN json_type(c) = 'VARCHAR' THEN length(c->>'$') ELSE length(c::varchar) + length(regexp_replace(regexp_replace(c::varchar, '\"([^\"\\\\]|\\\\.)*\"', '', 'g'), '[^,:]', '', 'g')) END AS chars FROM (SELECT log_id, json_extract(json, '$.message.content') AS c FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT')")
def content_lengths(spark, folder):
    """How long contents are: texts by their characters, all else by those of its JSON."""
    x = load(spark, folder, "call_log").select("log_id", F.expr("try_parse_json(json)").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT<%'")
    x = x.withColumn("c", F.expr("try_variant_get(v, '$.message.content', 'variant')"))
    return x.select("log_id", F.expr(content.content_length("c")).cast("bigint").alias("chars"))


@_query("k1_csv_lines", """SELECT row_id::varchar || ',' || coalesce(profile, '') || ',"' || replace(cwd, '"', '""') || ',' || line || '"' AS text FROM calls WHERE cwd IS NOT NULL""")
def csv_lines(spark, folder):
    """Rows as lines of CSV (K1)."""
    x = load(spark, folder, "calls").where("cwd IS NOT NULL").select("row_id", "profile", F.concat("cwd", F.lit(","), "line").alias("place"))
    return x.select(outputs.csv_line(x.columns).alias("text"))


@_query("k3_markdown_rows", "SELECT '| ' || entry_id || ' | ' || repo || ' | ' || replace(path, '|', '\\|') || ' | ' || coalesce(link_target, '') || ' |' AS text FROM entries")
def markdown_rows(spark, folder):
    """Rows as those of a Markdown table (K3)."""
    x = load(spark, folder, "entries").select("entry_id", "repo", "path", "link_target")
    return x.select(outputs.markdown_row(x.columns).alias("text"))
