"""Queries of usage analytics over ``calls``, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import quality, usage
from ..tables import load

#: SQL of the usage rows (u) and the deduplicated ones (k), independent of the operators.
_BASE = r"""
WITH p AS (
  SELECT *, regexp_extract(ts, '^(2[0-9]{3}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-5][0-9])([.,]([0-9]+))?(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9])?)?$', ['d', 't', 'x', 'f', 'z']) AS m,
    string_split(src, '/') AS parts, message.usage AS us FROM calls
), q AS (
  SELECT *, try_cast(m.d || ' ' || m.t AS timestamp) AS loc, replace(m.z, ':', '') AS zz,
    len(parts) >= 2 AND parts[-2] = 'subagents' AS sub, nullif(trim(lower(session_id), ' ' || chr(9) || chr(10)), '') AS session FROM p
), u AS (
  SELECT row_id, profile, src, line, session, sub,
    CASE WHEN sub THEN 'sub' WHEN coalesce(is_sidechain, false) THEN 'side' ELSE 'main' END AS kind,
    CASE WHEN sub THEN regexp_replace(parts[-1], '\.[^.]*$', '') ELSE session END AS stream,
    CASE WHEN sub THEN parts[-3] END AS parent_session,
    epoch_us(loc) + CAST(rpad(substr(coalesce(nullif(m.f, ''), '0'), 1, 6), 6, '0') AS bigint)
      - CASE WHEN zz IN ('', 'Z') THEN 0 ELSE (CASE WHEN zz[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(zz, 2, 2) AS bigint) * 3600 + CAST(coalesce(nullif(substr(zz, 4, 2), ''), '0') AS bigint) * 60) * 1000000 END AS us_at,
    message.model AS model, coalesce(nullif(trim(effort), ''), 'unknown') AS effort,
    greatest(coalesce(us.input_tokens, 0), 0) AS inp,
    CASE WHEN us.cache_creation.ephemeral_5m_input_tokens IS NULL AND us.cache_creation.ephemeral_1h_input_tokens IS NULL THEN greatest(coalesce(us.cache_creation_input_tokens, 0), 0) ELSE greatest(coalesce(us.cache_creation.ephemeral_5m_input_tokens, 0), 0) END AS w5,
    greatest(coalesce(us.cache_creation.ephemeral_1h_input_tokens, 0), 0) AS w1,
    greatest(coalesce(us.cache_read_input_tokens, 0), 0) AS read,
    greatest(coalesce(us.output_tokens, 0), 0) AS "out",
    coalesce(nullif(trim(message.id, ' ' || chr(9) || chr(10) || chr(13)), ''), nullif(trim(request_id, ' ' || chr(9) || chr(10) || chr(13)), ''), src || ':' || line) AS key
  FROM q
), r AS (
  SELECT *, inp + w5 + w1 + read AS ctx, make_timestamp(us_at) AS tm FROM u
), k AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY "out" DESC, sub, us_at IS NULL, us_at, src, line, row_id) = 1
)
"""
_PCT = "CASE WHEN {d} = 0 THEN 0.0 ELSE ((2000 * {n} + {d}) // (2 * {d})) / 10.0 END"
_MEAS = (
    'count(DISTINCT session) AS sessions, count(*) AS calls, CAST(sum(inp) AS bigint) AS inp, CAST(sum(w5) AS bigint) AS w5, CAST(sum(w1) AS bigint) AS w1, CAST(sum(read) AS bigint) AS read, CAST(sum("out") AS bigint) AS "out", '
    + _PCT.format(n="sum(read)", d="sum(ctx)") + " AS hit_pct"
)
_WEEK = "strftime(tm, '%G-W%V')"
_GAPS = _BASE + ", g AS (SELECT *, us_at - lag(us_at) OVER (PARTITION BY profile, kind, stream ORDER BY us_at, key) AS gap FROM k WHERE stream IS NOT NULL AND us_at IS NOT NULL), w AS (SELECT CASE WHEN kind = 'main' THEN 'main' ELSE 'sub' END AS kind, CASE WHEN gap <= 300000000 THEN '<5m' WHEN gap <= 3600000000 THEN '5m-1h' ELSE '>1h' END AS bucket, stream, w5 + w1 AS written FROM g WHERE gap IS NOT NULL AND ctx > 20000 AND (w5 + w1) * 2 > ctx)"
_SESS = _BASE + ", s AS (SELECT profile, stream, min(tm) AS start, count(*) AS calls, arg_min(ctx, (us_at, key)) AS first_ctx, arg_max(ctx, (us_at, key)) AS last_ctx, max(ctx) AS peak_ctx, arg_max(model, (ctx, key)) AS peak_model, CASE WHEN max(ctx) > 200000 THEN 1000000 ELSE 200000 END::bigint AS window_ FROM k WHERE kind = 'main' AND stream IS NOT NULL AND tm IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, last_ctx * 10 >= window_ * 8 AS near_limit FROM s)"
_RUNS = _BASE + ", n AS (SELECT profile, stream, arg_min(model, (us_at, key)) AS model, arg_min(effort, (us_at, key)) AS effort, count(*) AS calls, CAST(sum(ctx + \"out\") AS bigint) AS tokens, max(ctx) AS peak_ctx, (max(us_at) - min(us_at)) // 1000000 AS seconds FROM k WHERE kind = 'sub' AND tm IS NOT NULL GROUP BY 1, 2)"


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return usage.usage(load(spark, folder, "calls"))


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return usage.deduplicated(_raw(spark, folder))


CHANGES = [("2021-01-12", "all"), ("2021-01-12", "main"), ("2021-01-12", "subagent"), ("2021-01-18", "all")]
PREFIXES = ["fenn", "fenn-2", "orla", "orla-5", "orla-5-fast", "tarn"]

SPARK, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        SPARK[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_query("usage_rows", _BASE + 'SELECT row_id, kind, stream, parent_session, us_at, model, effort, inp, w5, w1, read, "out", key FROM r')
def usage_rows(spark, folder):
    """Nested extraction with defaults."""
    r = _raw(spark, folder)
    return r.select("row_id", "kind", "stream", "parent_session", F.unix_micros("at").alias("us_at"), "model", "effort", *usage.MEASURES, "key")


@_query("a3_dedup_calls", _BASE + 'SELECT key, row_id, "out", sub FROM k')
def dedup_calls(spark, folder):
    return _kept(spark, folder).select("key", "row_id", "out", "sub")


@_query("a1_core", _BASE + f"SELECT {_MEAS} FROM k")
def core(spark, folder):
    return usage.core(_kept(spark, folder))


@_query("a2_weekly_by_model_effort", _BASE + f"SELECT CASE WHEN grouping(week, model, effort) = 0 THEN 'group' WHEN grouping(week, model, effort) = 3 THEN 'SUBTOTAL' ELSE 'TOTAL' END AS level, week, model, effort, {_MEAS} FROM (SELECT *, {_WEEK} AS week FROM k WHERE tm IS NOT NULL) GROUP BY GROUPING SETS ((week, model, effort), (week), ())")
def weekly(spark, folder):
    return usage.weekly(_kept(spark, folder))


@_query("a2b_weekly_by_kind", _BASE + f"SELECT {_WEEK} AS week, kind, {_MEAS} FROM k WHERE tm IS NOT NULL GROUP BY 1, 2")
def weekly_by_kind(spark, folder):
    return usage.weekly_by_kind(_kept(spark, folder))


@_query("f4_partial_weeks", _BASE + ", d AS (SELECT min(tm)::date AS a, max(tm)::date AS b FROM k), w AS (SELECT DISTINCT date_trunc('week', tm)::date AS monday FROM k WHERE tm IS NOT NULL) SELECT * FROM (SELECT strftime(monday, '%G-W%V') AS week, concat_ws('; ', CASE WHEN monday < a THEN 'starts late' END, CASE WHEN monday + 6 > b THEN 'ends early' END) AS reason FROM w, d) WHERE reason <> ''")
def partial(spark, folder):
    return usage.partial_weeks(_kept(spark, folder))


@_query("a4_reconciliation", _BASE + " SELECT m AS measure, CAST(raw AS bigint) AS raw, CAST(kept AS bigint) AS kept, CAST(raw - kept AS bigint) AS removed FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS m, (SELECT {e} FROM r) AS raw, (SELECT {e} FROM k) AS kept" for m, e in (("rows", "count(*)"), *((x, f'sum("{x}")') for x in usage.MEASURES))) + ")")
def reconciliation(spark, folder):
    return usage.reconciliation(_raw(spark, folder), _kept(spark, folder))


@_query("a9_session_rollup", _SESS + " SELECT profile, stream, epoch_us(start) AS start_us, calls, first_ctx, last_ctx, peak_ctx, peak_model, window_ AS \"window\", near_limit FROM t")
def session_rollup(spark, folder):
    s = usage.sessions(_kept(spark, folder))
    return s.select("profile", "stream", F.unix_micros("start").alias("start_us"), "calls", "first_ctx", "last_ctx", "peak_ctx", "peak_model", "window", "near_limit")


@_query("a10_peak_buckets", _SESS + " SELECT count(*) AS sessions, " + ", ".join(f"count(*) FILTER (peak_ctx > {p}) AS over_{p // 1000}k" for p in usage.PEAKS) + ", count(*) FILTER (near_limit) AS near_limit FROM t")
def peak_buckets(spark, folder):
    return usage.peak_buckets(_kept(spark, folder))


_P90 = "list_sort(list(first_ctx))[CAST(ceil(0.9 * count(*)) AS bigint)]"


@_query("a13_start_context", _SESS + f" SELECT profile, count(*) AS sessions, CAST(floor(median(first_ctx)) AS bigint) AS median, {_P90} AS p90 FROM t GROUP BY 1 UNION ALL SELECT '*', count(*), CAST(floor(median(first_ctx)) AS bigint), {_P90} FROM t")
def start_context(spark, folder):
    return usage.start_context(_kept(spark, folder))


@_query("a14_subagent_runs", _RUNS + " SELECT profile, stream, model, effort, calls, tokens, peak_ctx, ((seconds * 10 + 30) // 60) / 10.0 AS minutes FROM n")
def subagent_runs(spark, folder):
    return usage.runs(_kept(spark, folder))


@_query("a15_runs_by_model", _RUNS + " SELECT model, effort, count(*) AS runs, CAST(sum(tokens) AS bigint) AS tokens, CAST(floor(median(tokens)) AS bigint) AS median_tokens, CAST(floor(median(peak_ctx)) AS bigint) AS median_peak FROM n GROUP BY 1, 2")
def runs_by_model(spark, folder):
    return usage.runs_by_model(_kept(spark, folder))


@_query("w1_stream_gaps", _GAPS + " SELECT profile, kind, stream, key, us_at, gap AS gap_us FROM g")
def stream_gaps(spark, folder):
    return usage.gaps(_kept(spark, folder)).select("profile", "kind", "stream", "key", F.unix_micros("at").alias("us_at"), "gap_us")


@_query("w2_cache_rewrites", _GAPS + " SELECT c.kind, c.bucket, count(w.written) AS events, CAST(coalesce(sum(w.written), 0) AS bigint) AS written FROM (SELECT * FROM (VALUES ('main'), ('sub')) a(kind), (VALUES ('<5m'), ('5m-1h'), ('>1h')) b(bucket)) c LEFT JOIN w ON w.kind = c.kind AND w.bucket = c.bucket GROUP BY 1, 2")
def cache_rewrites(spark, folder):
    return usage.cache_rewrites(_kept(spark, folder))


@_query("w3_rewrite_top_streams", _GAPS + ' SELECT kind, bucket, stream, written, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY kind, bucket ORDER BY written DESC, stream) AS "rank" FROM (SELECT kind, bucket, stream, CAST(sum(written) AS bigint) AS written FROM w GROUP BY 1, 2, 3)) WHERE "rank" <= 5')
def rewrite_top_streams(spark, folder):
    return usage.rewrite_top_streams(_kept(spark, folder))


#: Made-up weights of models, by the beginning of their names: per million tokens of input and output, and the factor of reading from a cache.
WEIGHTS = [("fenn", "3", "15", "0.1"), ("fenn-2", "4.5", "20", "0.1"), ("orla", "10", "50", "0.25"), ("orla-5", "12.25", "61.5", "0.1"), ("orla-5-fast", "1.1", "5.5", "0.2")]


def _weights(spark):
    from decimal import Decimal

    return spark.createDataFrame([(p, *map(Decimal, x)) for p, *x in WEIGHTS], "prefix string, input decimal(8,4), output decimal(8,4), read decimal(4,2)")


def _events(spark, folder):
    """Compactions of the logs, and a limit hit at every 50th call."""
    from ..operators import content

    c = content.compactions(load(spark, folder, "call_log")).where("us IS NOT NULL").select("session", F.lit("compaction").alias("what"), "trigger", F.timestamp_micros("us").alias("at"))
    hits = _raw(spark, folder).where("row_id % 50 = 0 AND at IS NOT NULL").select("session", F.lit("limit").alias("what"), F.lit(None).cast("string").alias("trigger"), "at")
    return c.unionByName(hits)


_WEIGHED = (
    _BASE
    + ", pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {a}::decimal(8, 4), {b}::decimal(8, 4), {c}::decimal(4, 2))" for p, a, b, c in WEIGHTS) + ") v(prefix, pin, pout, prd)), "
    + "mp AS (SELECT model, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT model FROM k) JOIN pr ON starts_with(model, prefix) GROUP BY 1), "
    + 'kw AS (SELECT k.*, (inp + 1.25::decimal(4, 2) * w5 + 2 * w1 + prd * read) * pin AS win, "out" * pout AS wout, prd * read * pin AS wread, (1.25::decimal(4, 2) * w5 + 2 * w1) * pin AS wwrite FROM k LEFT JOIN mp ON mp.model = k.model LEFT JOIN pr ON pr.prefix = mp.prefix)'
)
_CENTS = "CASE WHEN count(*) FILTER ({w} IS NULL) = 0 THEN CAST(floor((sum({w}) + 5000) / 10000.0) AS bigint) END"
_EVENTS = r"""
, cp AS (SELECT *, json_extract_string(json, '$.timestamp') AS ts FROM call_log WHERE json_valid(json) AND json_type(json) = 'OBJECT' AND json_extract_string(json, '$.type') = 'system' AND json_extract_string(json, '$.subtype') = 'compact_boundary'),
cq AS (SELECT coalesce(CASE WHEN json_type(json, '$.uuid') = 'VARCHAR' THEN json_extract_string(json, '$.uuid') END, src || ':' || line) AS key, lower(json_extract_string(json, '$.sessionId')) AS session, json_extract_string(json, '$.compactMetadata.trigger') AS trigger, try_cast(replace(replace(ts, 'T', ' '), 'Z', '') AS timestamp) AS tm FROM cp QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, line, log_id) = 1),
ev AS (SELECT session, 'compaction' AS what, trigger, tm FROM cq WHERE tm IS NOT NULL UNION ALL SELECT session, 'limit', NULL, tm FROM r WHERE row_id % 50 = 0 AND tm IS NOT NULL)
"""


@_query("a1_weighted", _WEIGHED + f"SELECT count(*) AS calls, {_CENTS.format(w='win')} AS cents_in, CAST(floor((sum(win) + 5000) / 10000.0) AS bigint) AS known_in, count(*) FILTER (win IS NULL) AS unknown FROM kw")
def weighted_core(spark, folder):
    """The weighted sum, which is unknown if any model is, beside that of the known ones (F8, A1)."""
    x = usage.weighted(_kept(spark, folder), _weights(spark))
    return x.agg(F.count(F.lit(1)).alias("calls"), usage.cents("weight_in").alias("cents_in"), usage.hundredths(F.sum("weight_in")).alias("known_in"), F.count_if(F.col("weight_in").isNull()).alias("unknown"))


@_query("a2_weekly_weights", _WEIGHED + f"SELECT CASE WHEN grouping(week, model, effort) = 0 THEN 'group' WHEN grouping(week, model, effort) = 3 THEN 'SUBTOTAL' ELSE 'TOTAL' END AS level, week, model, effort, count(*) AS calls, {_CENTS.format(w='win')} AS cents_in, {_CENTS.format(w='wout')} AS cents_out FROM (SELECT *, {_WEEK} AS week FROM kw WHERE tm IS NOT NULL) GROUP BY GROUPING SETS ((week, model, effort), (week), ())")
def weekly_weights(spark, folder):
    return usage.weekly_weights(_kept(spark, folder), _weights(spark))


@_query("f8_call_weights", _WEIGHED + "SELECT key, CAST(win * 10000 AS bigint) AS weight_in, CAST(wout * 10000 AS bigint) AS weight_out FROM kw")
def call_weights(spark, folder):
    units = lambda c: (F.col(c) * 10000).cast("bigint").alias(c)
    return usage.weighted(_kept(spark, folder), _weights(spark)).select("key", units("weight_in"), units("weight_out"))


@_query("f9_cache_weights", _WEIGHED + "SELECT key, CAST(wread * 10000 AS bigint) AS weight_read, CAST(wwrite * 10000 AS bigint) AS weight_write FROM kw")
def cache_weights(spark, folder):
    units = lambda c: (F.col(c) * 10000).cast("bigint").alias(c)
    return usage.weighted(_kept(spark, folder), _weights(spark)).select("key", units("weight_read"), units("weight_write"))


_TYPED = _WEIGHED + f", n AS (SELECT profile, stream, CAST(sum(ctx + \"out\") AS bigint) AS tokens, max(ctx) AS peak_ctx, {_CENTS.format(w='win')} AS cents_in FROM kw WHERE kind = 'sub' AND tm IS NOT NULL GROUP BY 1, 2), ty AS (SELECT *, CASE WHEN right(stream, 1) < '6' THEN 'builder' WHEN right(stream, 1) < 'b' THEN 'reviewer' ELSE 'unknown' END AS type FROM n) "


def _types(spark, folder):
    """A type for each run, told by the end of its id, as the runs of the logs and the agents of the table have no id in common."""
    last = F.substring("stream", -1, 1)
    return _raw(spark, folder).where("sub").select("stream", F.when(last < "6", "builder").when(last < "b", "reviewer").alias("type")).where("type IS NOT NULL").distinct()


@_query("a15_runs_by_type", _TYPED + "SELECT type, count(*) AS runs, CAST(sum(tokens) AS bigint) AS tokens, CAST(floor(median(tokens)) AS bigint) AS median_tokens, CAST(floor(median(peak_ctx)) AS bigint) AS median_peak, CASE WHEN count(*) FILTER (cents_in IS NULL) = 0 THEN CAST(sum(cents_in) AS bigint) END AS cents_in FROM ty GROUP BY 1")
def runs_by_type(spark, folder):
    return usage.runs_by_type(_kept(spark, folder), _types(spark, folder), _weights(spark))


@_query("a2b_weekly_by_type", _BASE + f"SELECT {_WEEK} AS week, CASE WHEN sub THEN 'subagent' ELSE 'main' END AS split, CASE WHEN NOT sub THEN '' WHEN right(stream, 1) < '6' THEN 'builder' WHEN right(stream, 1) < 'b' THEN 'reviewer' ELSE 'unknown' END AS agent_type, {_MEAS} FROM k WHERE tm IS NOT NULL GROUP BY 1, 2, 3")
def weekly_by_type(spark, folder):
    return usage.weekly_by_type(_kept(spark, folder), _types(spark, folder))


@_query("j7_first_models", _BASE + ", p1 AS (SELECT profile, kind, stream, arg_min(model, (us_at, key)) AS model FROM k WHERE stream IS NOT NULL AND tm IS NOT NULL GROUP BY 1, 2, 3) SELECT stream, arg_max(model, (profile, kind)) AS model FROM p1 GROUP BY 1")
def first_models(spark, folder):
    return usage.first_models(_kept(spark, folder))


def _vector(group: str, tail: str) -> str:
    """SQL of the metrics of the rows ``i`` and the events ``ei``, by the columns of ``group``."""
    on = lambda a, b: " AND ".join(f"{a}.{g} = {b}.{g}" for g in group.split(", "))
    return (
        f", e AS (SELECT {group}, kind, max(ctx) AS peak, arg_min(ctx, (us_at, key)) AS first FROM i WHERE stream IS NOT NULL GROUP BY {group}, profile, kind, stream), "
        + f"pk AS (SELECT {group}, CAST(floor(median(peak)) AS bigint) AS median_peak_context, max(peak) AS max_peak_context, CAST(floor(median(first) FILTER (kind = 'main')) AS bigint) AS median_first_call_context FROM e GROUP BY {group}), "
        + f"tt AS (SELECT {group}, {_MEAS}, {_PCT.format(n='sum(w5 + w1)', d='sum(ctx)')} AS write_share_pct, CAST(sum(ctx + \"out\") // nullif(count(DISTINCT session), 0) AS bigint) AS tokens_per_session, {_CENTS.format(w='win')} AS cents_in FROM i GROUP BY {group}), "
        + f"ec AS (SELECT {group}, count(*) FILTER (what = 'compaction') AS compactions, count(*) FILTER (what = 'compaction' AND trigger = 'auto') AS auto_compactions, count(*) FILTER (what = 'limit') AS limit_hits FROM ei WHERE EXISTS (SELECT 1 FROM i WHERE i.session = ei.session AND {on('i', 'ei')}) GROUP BY {group}), "
        + f"mv AS (SELECT tt.*, pk.* EXCLUDE ({group}), coalesce(compactions, 0) AS compactions, coalesce(auto_compactions, 0) AS auto_compactions, coalesce(limit_hits, 0) AS limit_hits FROM tt LEFT JOIN pk ON {on('tt', 'pk')} LEFT JOIN ec ON {on('tt', 'ec')}) "
        + tail
    )


_VECTOR = ", ".join(f'"{m}"' for m in usage.METRICS)


@_query("a19_metrics", _WEIGHED + _EVENTS + ", i AS (SELECT 1 AS g, * FROM kw WHERE tm >= TIMESTAMP '2021-01-08' AND tm < TIMESTAMP '2021-01-15'), ei AS (SELECT 1 AS g, * FROM ev WHERE tm >= TIMESTAMP '2021-01-08' AND tm < TIMESTAMP '2021-01-15')" + _vector("g", f"SELECT {_VECTOR} FROM mv"))
def metrics(spark, folder):
    return usage.metrics(_kept(spark, folder), F.lit("2021-01-08").cast("timestamp"), F.lit("2021-01-15").cast("timestamp"), _events(spark, folder), _weights(spark))


_END = "2021-01-20"
_SIDED = ", c AS (SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}', '{s}')" for d, s in CHANGES) + ") v(date, scope)), cs AS (SELECT *, date::timestamp - INTERVAL 14 DAY AS lo, date::timestamp AS cut, least(date::timestamp + INTERVAL 14 DAY, TIMESTAMP '" + _END + "') AS hi FROM c), "
_SIDED += "i AS (SELECT date, scope, CASE WHEN tm < cut THEN 'before' ELSE 'after' END AS side, kw.* FROM kw JOIN cs ON tm >= lo AND tm < greatest(hi, cut) AND (scope = 'all' OR (scope = 'main') = (kind <> 'sub'))), ei AS (SELECT date, scope, CASE WHEN tm < cut THEN 'before' ELSE 'after' END AS side, ev.* FROM ev JOIN cs ON tm >= lo AND tm < greatest(hi, cut))"
_LONG = "lo2 AS (" + " UNION ALL ".join(f"SELECT date, scope, side, sessions AS ns, '{m}' AS metric, CAST(\"{m}\" AS double) AS v FROM mv" for m in usage.METRICS) + "), "
# Of a side without calls the counts, shares and weights are 0 and the rest is unknown.
_EMPTY = "coalesce({v}, CASE WHEN metric IN ('sessions', 'calls', 'inp', 'w5', 'w1', 'read', 'out', 'hit_pct', 'write_share_pct', 'compactions', 'auto_compactions', 'limit_hits') OR metric = 'cents_in' AND {n} IS NULL THEN 0.0 END)"
_LONG += "wc AS (SELECT date, scope, metric, max(v) FILTER (side = 'before') AS vb, max(v) FILTER (side = 'after') AS va, max(ns) FILTER (side = 'before') AS nb, max(ns) FILTER (side = 'after') AS na FROM lo2 GROUP BY 1, 2, 3), "
_LONG += f"wd AS (SELECT date, scope, metric, {_EMPTY.format(v='vb', n='nb')} AS before, {_EMPTY.format(v='va', n='na')} AS after, nb, na FROM wc)"


@_query("a20_all_metrics", _WEIGHED + _EVENTS + _SIDED + _vector("date, scope, side", ", " + _LONG + " SELECT CAST(date AS varchar) AS date, scope, metric, before, after, after - before AS delta, CASE WHEN before <> 0 THEN sign(after - before) * floor(abs((after - before) * 1000 / before) + 0.5) / 10 END AS delta_pct, CASE WHEN nb >= 10 AND na >= 10 THEN 'compared' ELSE 'insufficient data' END AS result FROM wd"))
def all_metrics(spark, folder):
    """All metrics before and after each change, with their deltas."""
    return usage.compared(_kept(spark, folder), spark.createDataFrame(CHANGES, "date string, scope string"), _END, _events(spark, folder), _weights(spark))


@_query("a20_before_after", _BASE + ", c AS (SELECT * FROM (VALUES " + ", ".join(f"(DATE '{d}', '{s}')" for d, s in CHANGES) + ") v(date, scope)), x AS (SELECT c.date, c.scope, CASE WHEN tm < c.date::timestamp THEN 'b' ELSE 'a' END AS side, session, ctx + \"out\" AS tok FROM k, c WHERE tm >= c.date::timestamp - INTERVAL 14 DAY AND tm < c.date::timestamp + INTERVAL 14 DAY AND (scope = 'all' OR (scope = 'main') = (kind <> 'sub'))), y AS (SELECT date, scope, count(DISTINCT session) FILTER (side = 'b') AS sessions_before, count(DISTINCT session) FILTER (side = 'a') AS sessions_after, CAST(coalesce(sum(tok) FILTER (side = 'b'), 0) AS bigint) AS tokens_before, CAST(coalesce(sum(tok) FILTER (side = 'a'), 0) AS bigint) AS tokens_after FROM x GROUP BY 1, 2) SELECT CAST(date AS varchar) AS date, scope, sessions_before, sessions_after, tokens_before, tokens_after, tokens_after - tokens_before AS delta, CASE WHEN sessions_before >= 10 AND sessions_after >= 10 THEN 'compared' ELSE 'insufficient data' END AS result FROM y")
def before_after(spark, folder):
    return usage.before_after(_kept(spark, folder), spark.createDataFrame(CHANGES, "date string, scope string"))


@_query("j1_longest_prefix", "SELECT model, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT message.model AS model FROM calls WHERE message.model IS NOT NULL) LEFT JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PREFIXES) + ") v(prefix)) ON starts_with(model, prefix) GROUP BY 1")
def prefix_join(spark, folder):
    return usage.longest_prefix(load(spark, folder, "calls").select(F.col("message.model").alias("model")), "model", spark.createDataFrame([(p,) for p in PREFIXES], "prefix string"), "prefix")


@_query("t1_weekly_ranked", _BASE + f", w AS (SELECT {_WEEK} AS week, model, effort, CAST(sum(ctx + \"out\") AS bigint) AS tokens FROM k WHERE tm IS NOT NULL GROUP BY 1, 2, 3) SELECT week, model, effort, tokens, row_number() OVER (PARTITION BY week ORDER BY tokens DESC, model, effort) AS rank FROM w")
def weekly_ranked(spark, folder):
    k = _kept(spark, folder).where("at IS NOT NULL")
    g = k.groupBy(fn.iso_week(F.col("at")).alias("week"), "model", "effort").agg(F.sum(usage.context() + F.col("out")).alias("tokens"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("tokens"), "model", "effort")))


@_query("t3_peak_sessions", _SESS + " SELECT profile, stream, peak_ctx FROM t ORDER BY peak_ctx DESC, stream, profile LIMIT 10")
def peak_sessions(spark, folder):
    return usage.sessions(_kept(spark, folder)).select("profile", "stream", "peak_ctx").orderBy(F.desc("peak_ctx"), "stream", "profile").limit(10)


@_query("t6_top_runs", _RUNS + " SELECT profile, stream, tokens FROM n ORDER BY tokens DESC, stream, profile LIMIT 10")
def top_runs(spark, folder):
    return usage.runs(_kept(spark, folder)).select("profile", "stream", "tokens").orderBy(F.desc("tokens"), "stream", "profile").limit(10)


@_query("t8_evidence", _SESS + " SELECT profile, array_to_string(list_sort(list(DISTINCT stream))[1:10], ',') AS streams FROM t WHERE peak_ctx > 300000 GROUP BY 1")
def evidence(spark, folder):
    """The first ten ids of each profile's sessions over the threshold, kept by a bounded rank rather than a collected set."""
    over = usage.sessions(_kept(spark, folder)).where("peak_ctx > 300000").select("profile", "stream").distinct()
    first = over.withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy("stream"))).where("n <= 10")
    return first.groupBy("profile").agg(F.array_join(F.sort_array(F.collect_list("stream")), ",").alias("streams"))


@_query("q1_raw_below_kept", _BASE + " SELECT m AS measure, CAST(kept + 1 AS bigint) AS raw, CAST(kept AS bigint) AS kept FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS m, (SELECT {e} FROM r) AS raw, (SELECT {e} FROM k) AS kept" for m, e in (("rows", "count(*)"), *((x, f'sum("{x}")') for x in usage.MEASURES))) + ") WHERE raw < kept UNION ALL SELECT 'planted', 1, 2")
def raw_below_kept(spark, folder):
    """Measures whose raw sum is below the deduplicated one: none of the data's, and a planted one, which must be seen."""
    seen = usage.reconciliation(_raw(spark, folder), _kept(spark, folder)).select("measure", "raw", "kept")
    return quality.raw_covers_kept(seen.unionByName(spark.sql("SELECT 'planted' AS measure, 1L AS raw, 2L AS kept")))


@_query("q2_levels_add_up", _BASE + f"SELECT DISTINCT week FROM (SELECT {_WEEK} AS week FROM k WHERE tm IS NOT NULL) WHERE week = '2021-W02' UNION ALL SELECT '*'")
def levels_add_up(spark, folder):
    """Weeks whose groups don't add up: none of the data's, and one from which a group's calls were planted off, with it the total."""
    w = usage.weekly(_kept(spark, folder))
    off = F.when((F.col("level") == "SUBTOTAL") & (F.col("week") == "2021-W02"), 1).otherwise(0)
    return quality.levels_add_up(w.withColumn("calls", F.col("calls") + off))


@_query("q6_missing_inputs", "SELECT 'no calls of profile nobody' AS missing")
def missing_inputs(spark, folder):
    """Inputs without any row: of the profiles there are none, of an unknown one the calls."""
    raw = _raw(spark, folder)
    return quality.missing({"calls": raw, "no calls of profile nobody": raw.where("profile = 'nobody'"), "dated calls": raw.where("at IS NOT NULL")})


@_query("q3_unknown_profiles", "SELECT DISTINCT profile FROM calls WHERE profile NOT IN ('work', 'default', 'mobile')")
def unknown_profiles(spark, folder):
    return quality.unknown_profiles(_raw(spark, folder), spark.createDataFrame([("work",), ("default",), ("mobile",)], "profile string"))


@_query("a24_unknown_models", "SELECT message.model AS model, count(*) AS calls FROM calls WHERE message.model IS NOT NULL AND NOT (" + " OR ".join(f"starts_with(message.model, '{p}')" for p in PREFIXES) + ") GROUP BY 1")
def unknown_models(spark, folder):
    calls = load(spark, folder, "calls").select(F.col("message.model").alias("model"))
    known = prefix_join(spark, folder)
    per = calls.where("model IS NOT NULL").groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    return per.join(known.where("prefix IS NULL").select("model"), "model")


@_query("cwds_by_session", "SELECT profile, cwd, lower(session_id) AS session, count(*) AS n FROM calls GROUP BY 1, 2, 3")
def cwds(spark, folder):
    return load(spark, folder, "calls").groupBy("profile", "cwd", F.lower("session_id").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@_query("a25_sessions_per_project", "SELECT cwd, count(DISTINCT lower(session_id)) AS sessions FROM calls WHERE cwd IS NOT NULL GROUP BY 1")
def sessions_per_project(spark, folder):
    return load(spark, folder, "calls").where("cwd IS NOT NULL").groupBy("cwd").agg(F.count_distinct(F.lower("session_id")).alias("sessions"))


@_query("range_files", _BASE + ", f AS (SELECT src, count(*) FILTER (tm >= TIMESTAMP '2021-01-10' AND tm < TIMESTAMP '2021-01-13') AS inside, count(*) FILTER (tm IS NULL) AS undated, count(*) AS n FROM r GROUP BY 1) SELECT src FROM f WHERE inside > 0 OR (undated > 0 AND undated = n)")
def range_files(spark, folder):
    """Files with a line in the range, or with undated lines only."""
    inside = F.count_if((F.col("at") >= F.lit("2021-01-10").cast("timestamp")) & (F.col("at") < F.lit("2021-01-13").cast("timestamp")))
    per = _raw(spark, folder).groupBy("src").agg(inside.alias("inside"), F.count_if(F.col("at").isNull()).alias("undated"), F.count(F.lit(1)).alias("n"))
    return per.where("inside > 0 OR (undated > 0 AND undated = n)").select("src")


@_query("f_formats", r"""
WITH s AS (SELECT DISTINCT message.usage.cache_read_input_tokens AS n FROM calls WHERE message.usage.cache_read_input_tokens >= 0)
SELECT n,
  CASE WHEN n < 1000 THEN n::varchar WHEN n < 10000 THEN (n // 1000)::varchar || '.' || ((n // 100) % 10)::varchar || 'k' WHEN n < 1000000 THEN (n // 1000)::varchar || 'k' ELSE (n // 1000000)::varchar || '.' || ((n // 100000) % 10)::varchar || 'M' END AS tokens,
  CASE WHEN n < 1000 THEN n::varchar WHEN n < 99950 THEN CASE WHEN ((n + 50) // 100) % 10 = 0 THEN ((n + 50) // 1000)::varchar ELSE ((n + 50) // 1000)::varchar || '.' || (((n + 50) // 100) % 10)::varchar END || 'k' WHEN (n + 500) // 1000 < 1000 THEN ((n + 500) // 1000)::varchar || 'k' ELSE ((n + 50000) // 1000000)::varchar || '.' || (((n + 50000) // 100000) % 10)::varchar || 'M' END AS k,
  CASE WHEN n // 1000 < 60 THEN (n // 1000)::varchar || 's' WHEN n // 1000 < 3600 THEN (n // 60000)::varchar || 'm' || lpad(((n // 1000) % 60)::varchar, 2, '0') || 's' ELSE (n // 3600000)::varchar || 'h' || lpad(((n // 60000) % 60)::varchar, 2, '0') || 'm' END AS elapsed,
  'five_hour@' || ((n + 150000) // 300000)::varchar AS period,
  CASE WHEN n % 101 >= 95 THEN 2 WHEN n % 101 >= 80 THEN 1 ELSE 0 END AS level
FROM s""")
def formats(spark, folder):
    """Formats of the meters."""
    n = F.col("n")
    s = load(spark, folder, "calls").select(F.col("message.usage.cache_read_input_tokens").alias("n")).where("n >= 0").distinct()
    return s.select("n", fn.format_tokens(n).alias("tokens"), fn.kfmt(n).alias("k"), fn.elapsed(n).alias("elapsed"), fn.period_key(F.lit("five_hour"), n).alias("period"), fn.alert_level(n % 101, 80, 95).alias("level"))
