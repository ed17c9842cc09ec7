"""Usage analytics, log contents, agents, checks: hand-made cases, and every SQL check on the small tables."""

import json
import math
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as fn
from millrace.operators import agents, content, quality, usage
from millrace.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(small):
    import glob
    import os

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, Decimal):
        return str(v.normalize())
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert sorted(tuple(norm(row[c]) for c in columns) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_queries_without_sql_run(spark, small, name):
    df = catalog.queries()[name](spark, small)
    assert df.columns and df.count() >= 0


def one(spark, *values):
    kinds = {int: "bigint", str: "string", type(None): "string", float: "double"}
    return spark.createDataFrame([(v,) for v in values], f"x {kinds[type(values[0])]}")


@pytest.mark.parametrize(
    "function, pairs",
    [
        (fn.format_tokens, {0: "0", 999: "999", 1000: "1.0k", 1234: "1.2k", 9999: "9.9k", 10000: "10k", 999999: "999k", 1000000: "1.0M", 2550000: "2.5M"}),
        (fn.kfmt, {950: "950", 12300: "12.3k", 84000: "84k", 200000: "200k", 999400: "999k", 999600: "1.0M", 1250000: "1.3M"}),
        (fn.elapsed, {0: "0s", 59999: "59s", 65000: "1m05s", 3661000: "1h01m", -5: "0s"}),
        (fn.remaining, {59_000: "<1m", 9 * 60_000: "9m", 134 * 60_000: "2h 14m", 76 * 3_600_000: "3d 4h"}),
        (lambda c: fn.fit(c, 6), {"abcdefg": "abcde…", "a\nb\tc": "a b c", "abcdef": "abcdef"}),
        (fn.short_tool, {"mcp__server__read": "read", "Read": "Read"}),
        (fn.window_label, {"five_hour": "5h", "seven_day": "7d", "some_other": "some other"}),
        (fn.masked, {"4111 1111 1111 1111": "****1111", "abcdefgh": "****gh", "abcd": "****"}),
        (fn.annotation_property, {"a,b:c%\n": "a%2Cb%3Ac%25%0A"}),
        (fn.markdown_cell, {"a|b\nc": "a\\|b c"}),
        (content.verdict, {"so\n**VERDICT: approve**": "approve", "VERDICT:\nchanges": "unclear", "# VERDICT: CHANGES": "changes", "VERDICT: passes": "unclear", "VERDICT: pass": "approve", "": "unclear"}),
    ],
)
def test_scalars(spark, function, pairs):
    df = one(spark, *pairs)
    assert [r[0] for r in df.select(function(F.col("x"))).collect()] == list(pairs.values())


def test_small_scalars(spark):
    r = spark.range(1).select(
        fn.usd(F.lit("1.235")).alias("a"), fn.grouped(F.lit(1234567)).alias("b"), fn.pct(F.lit(1), F.lit(3)).alias("c"), fn.pct(F.lit(1), F.lit(0)).alias("d"),
        fn.iso_week(F.lit("2026-12-31").cast("date")).alias("e"), fn.iso_week(F.lit("2027-01-03").cast("date")).alias("f"), fn.iso_week(F.lit("2027-01-04").cast("date")).alias("g"),
        fn.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("h"), fn.overlap(F.array().cast("array<string>"), F.array(F.lit("b"))).alias("i"),
        fn.period_key(F.lit("k"), F.lit(51299000)).alias("j"), fn.period_key(F.lit("k"), F.lit(51301000)).alias("k"), fn.alert_level(F.lit(96), 80, 20).alias("l"),
    ).first()
    assert tuple(r)[:9] == ("$1.24", "1,234,567", 33.3, 0.0, "2026-W53", "2026-W53", "2027-W01", 1.0, 0.0)
    assert r.j == r.k and r.l == 2
    n = spark.range(1, 11).select(fn.whole_median(F.col("id")).alias("m"), fn.nearest_rank_p90("id").alias("p")).first()
    assert (n.m, n.p) == (5, 9)


USAGE = (
    "row_id bigint, profile string, src string, line int, session_id string, is_sidechain boolean, ts string, effort string, request_id string, "
    "message struct<id:string,model:string,usage:struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>>>"
)


def row(n, src="/l/p/s.jsonl", ts="2021-01-04T00:00:00Z", mid=None, out=1, split=(None, None), written=None, read=None, side=None, model="m"):
    return (n, "p", src, n, "S", side, ts, None, None, (mid, model, (10, written, read, out, split)))


def test_usage_rows(spark):
    df = spark.createDataFrame([row(1, written=5), row(2, split=(1, 2), written=9), row(3, "/l/p/s/subagents/run-1.jsonl"), row(4, side=True), row(5, ts="n/a", out=None)], USAGE)
    r = {x.row_id: x for x in usage.usage(df).collect()}
    assert (r[1].w5, r[1].w1, r[2].w5, r[2].w1) == (5, 0, 1, 2)
    assert (r[3].kind, r[3].stream, r[3].parent_session) == ("sub", "run-1", "s") and r[4].kind == "side" and r[1].stream == "s"
    assert r[5].at is None and r[5].out == 0 and r[1].key == "/l/p/s.jsonl:1" and r[1].effort == "unknown"


def test_best_copy(spark):
    sub = "/l/p/s/subagents/run-1.jsonl"
    df = spark.createDataFrame([row(1, mid="a", out=5), row(2, mid="a", out=100), row(3, sub, mid="b"), row(4, mid="b"), row(5, mid="c", ts="2021-01-04T00:00:02Z"), row(6, mid="c")], USAGE)
    kept = usage.deduplicated(usage.usage(df))
    assert {x.row_id for x in kept.collect()} == {2, 4, 6}
    assert {(x.measure, x.removed) for x in usage.reconciliation(usage.usage(df), kept).collect()} >= {("rows", 3), ("out", 7)}


def test_gaps_over_slots(spark):
    times = ["00:00:00", "00:59:59", "01:00:01", "05:00:00"]
    df = spark.createDataFrame([row(k, ts=f"2021-01-04T{t}Z", mid=str(k), written=30000) for k, t in enumerate(times)], USAGE)
    got = {x.row_id: x.gap_us for x in usage.gaps(usage.usage(df)).collect()}
    assert got == {0: None, 1: 3599_000_000, 2: 2_000_000, 3: (4 * 3600 - 1) * 1_000_000}
    cells = {(x.kind, x.bucket): (x.events, x.written) for x in usage.cache_rewrites(usage.usage(df)).collect()}
    assert cells == {("main", "<5m"): (1, 30000), ("main", "5m-1h"): (1, 30000), ("main", ">1h"): (1, 30000), **{("sub", b): (0, 0) for b in ("<5m", "5m-1h", ">1h")}}


def test_empty_usage(spark):
    df = usage.usage(spark.createDataFrame([], USAGE))
    kept = usage.deduplicated(df)
    assert kept.isEmpty() and usage.sessions(kept).isEmpty() and usage.weekly_by_kind(kept).isEmpty() and usage.gaps(kept).isEmpty()
    assert usage.core(kept).first().calls == 0


def test_longest_prefix(spark, rows):
    v = spark.createDataFrame([("m-a-1",), ("m-a",), ("m-b-9",), ("zz",), (None,)], "model string")
    p = spark.createDataFrame([("m-a",), ("m-a-1",), ("m-b",)], "prefix string")
    assert rows(usage.longest_prefix(v, "model", p, "prefix")) == {("m-a-1", "m-a-1"), ("m-a", "m-a"), ("m-b-9", "m-b"), ("zz", None)}


def test_gates(spark):
    r = spark.createDataFrame([("out", 1, 2)], "measure string, raw bigint, kept bigint")
    with pytest.raises(quality.GateError) as e:
        quality.require(quality.raw_covers_kept(r), "sums")
    assert e.value.code == 3
    with pytest.raises(quality.GateError) as e:
        quality.require_rows(r.where("false"), "no rows")
    assert e.value.code == 2
    share = lambda bad, n: quality.drift_share(spark.createDataFrame([("x",)] * bad + [(None,)] * (n - bad), "reason string")).first().failed
    assert share(1, 10) and not share(1, 20)
    w = spark.createDataFrame([("group", "w1", 1), ("group", "w1", 2), ("SUBTOTAL", "w1", 4), ("TOTAL", None, 4)], "level string, week string, calls bigint")
    w = w.withColumns({m: F.lit(0).cast("bigint") for m in usage.MEASURES})
    assert {x.week for x in quality.levels_add_up(w).collect()} == {"w1"}


def log(k, src, role, blocks, ts="2021-01-04T00:00:00Z", session="S"):
    return (k, "p", src, k, json.dumps({"timestamp": ts, "sessionId": session, "message": {"role": role, "content": blocks}}))


def test_contents(spark, rows):
    main, sub = "/l/s.jsonl", "/l/s/subagents/run-1.jsonl"
    use = lambda i, f: {"type": "tool_use", "id": i, "name": "Read", "input": {"file_path": f}}
    res = lambda i, c: {"type": "tool_result", "tool_use_id": i, "content": c}
    at = lambda m: f"2021-01-04T00:{m:02}:00Z"
    made = [
        log(1, main, "assistant", [use("a", "/f"), {"type": "text", "text": "first"}], at(1)),
        log(2, main, "user", [res("a", "x" * 100)], at(2)),
        log(3, main, "assistant", [use("b", "/f")], at(3)),
        log(4, main, "user", [res("b", [{"type": "text", "text": "é"}])], at(4)),
        log(5, main, "assistant", [use("c", "/f"), use("a", "/other")], at(5)),
        log(6, sub, "assistant", [use("d", "/f"), {"type": "text", "text": "VERDICT: changes"}], at(6)),
        log(7, sub, "user", [res("d", None), res("nowhere", "yy")], at(7)),
        (8, "p", sub, 8, "{"),
    ]
    b = content.blocks(spark.createDataFrame(made, "log_id bigint, profile string, src string, line int, json string"))
    length = len(json.dumps([{"type": "text", "text": "é"}], ensure_ascii=False))
    assert rows(content.results_by_tool(b)) == {("Read", 3, 100 + length, 100, (100 + length) // 4), ("unknown", 1, 2, 2, 0)}
    assert rows(content.repeated_reads(b)) == {(main, "/f", 3, length)}
    assert rows(content.rereads_of_parent(b)) == {(sub, 1, 1, 0)}
    assert rows(content.large_results(b, 50)) == {("Read", 1, 50)}
    texts = rows(content.last_texts(spark.createDataFrame(made, "log_id bigint, profile string, src string, line int, json string")))
    assert texts == {(main, "first"), (sub, "VERDICT: changes")}


def linked(spark, made):
    return content.linked_runs(spark.createDataFrame([("s", i, k, d, t, v) for t, i, k, d, v in made], "session_id string, id string, type string, description string, started_at bigint, verdict string"))


def test_task_links(spark):
    made = [
        (0, "r0", "reviewer", "too early", None),
        (1, "b1", "builder", "alpha beta", None),
        (2, "r1", "reviewer", "review alpha beta", "changes"),
        (3, "b2", "builder", "other words", None),  # after a verdict of changes
        (4, "r2", "reviewer", "unknown thing", "approve"),
        (5, "b3", "builder", "gamma delta", None),
        (6, "b4", "builder", "rebuild alpha beta", None),
        (7, "x", "scout", "alpha beta", None),
    ]
    got = {r.id: (r.task, r.linked_by) for r in linked(spark, made).collect()}
    assert got == {"r0": (0, "unlinked"), "b1": (1, "new"), "r1": (1, "description"), "b2": (1, "time"), "r2": (1, "time"), "b3": (2, "new"), "b4": (1, "description")}
    per = {r.task: (r.builders, r.reviewers, r.rounds, r.all_linked, r.extra_runs) for r in content.tasks(linked(spark, made)).collect()}
    assert per == {0: (0, 1, 1, False, []), 1: (3, 2, 2, False, ["b4"]), 2: (1, 0, 0, True, [])}


def test_rounds(spark):
    one = [(k, f"{kind}{k}", kind, "one task", "changes") for k, kind in enumerate(["builder", "reviewer"] * 4)]
    per = content.tasks(linked(spark, one))
    assert [(r.rounds, r.extra_runs, r.changes) for r in per.collect()] == [(4, ["builder4", "builder6", "reviewer5", "reviewer7"], 4)]
    assert [(r.rounds, r.tasks) for r in content.rounds_histogram(per).collect()] == [(4, 1)]


def test_snapshot_merge(spark):
    t = datetime(2021, 1, 1)
    a = spark.createDataFrame([(1, "s", "a", "running", True, 0, None), (2, "s", "b", "running", True, 0, None), (3, "s", "c", "running", False, 0, None), (4, "s", "d", "running", False, 3, None), (5, None, "e", "idle", None, None, None)], "row_id bigint, session_id string, id string, status string, is_seen boolean, misses int, ended_at bigint")
    b = spark.createDataFrame([(1, t, "s", "a", "completed"), (2, t, "s", "n", "running"), (3, t, None, "e", "idle")], "listing_id bigint, listed_at timestamp, session_id string, id string, status string")
    got = {r.id: (r.change, r.status, r.misses) for r in agents.merged(a, b).collect()}
    assert got == {"a": ("updated", "completed", 0), "b": ("ended", "ended", 0), "c": ("missed", "running", 1), "d": ("dropped", "running", 4), "e": ("updated", "idle", 0), "n": ("inserted", "running", 0)}


def test_compactions_and_limits(spark, rows):
    line = lambda k, **o: (k, "p", "/l/s.jsonl", k, json.dumps({"timestamp": "2021-01-04T00:00:00Z", "sessionId": "S", **o}))
    boundary = lambda k, **m: line(k, type="system", subtype="compact_boundary", uuid=m.pop("uuid", None), compactMetadata=m)
    made = [
        boundary(1, uuid="u", trigger="auto", preTokens=5, postTokens=-1),
        boundary(2, uuid="u", trigger="manual"),
        boundary(3, trigger="odd", preTokens=True),
        line(4, type="system", subtype="other"),
        line(5, type="assistant", error="rate_limit", message={"role": "assistant", "model": "<synthetic>"}),
        line(6, type="assistant", error="rate_limit", message={"role": "assistant", "model": "m"}),
        line(7, type="assistant", message={"role": "assistant", "model": "<synthetic>"}),
    ]
    df = spark.createDataFrame(made, "log_id bigint, profile string, src string, line int, json string")
    got = {(r.key, r.trigger, r.pre_tokens, r.post_tokens) for r in content.compactions(df).collect()}
    assert got == {("u", "auto", 5, None), ("/l/s.jsonl:3", "unknown", None, None)}
    assert {r.key for r in content.limit_hits(df).collect()} == {"/l/s.jsonl:5"}
    kept = spark.createDataFrame([("other",)], "session string")
    assert content.within_sessions(content.limit_hits(df), kept).isEmpty()


def test_verdicts_of_runs(spark, rows):
    sub = "/l/s/subagents/run-1.jsonl"
    hand = {"type": "tool_use", "id": "h", "name": "SubagentHandback", "input": {"message": "ok\nVERDICT: PASS"}}
    made = [log(1, sub, "assistant", [hand]), log(2, sub, "assistant", [{"type": "text", "text": "VERDICT: CHANGES"}]), log(3, "/l/s/subagents/run-2.jsonl", "assistant", [{"type": "text", "text": "VERDICT: CHANGES"}]), log(4, "/l/s.jsonl", "assistant", [hand]), log(5, "/l/s/subagents/run-3.jsonl", "assistant", [{"type": "thinking"}])]
    df = spark.createDataFrame(made, "log_id bigint, profile string, src string, line int, json string")
    assert rows(content.verdicts_of_runs(df)) == {(sub, "approve"), ("/l/s/subagents/run-2.jsonl", "changes"), ("/l/s/subagents/run-3.jsonl", "unclear")}


def test_task_links_take_verdicts_from_files(spark, tmp_path):
    from millrace.plans import content as plans

    agents = [(1, "S", "b1", "builder", "alpha beta", 1), (2, "S", "r1", "reviewer", "review alpha beta", 2), (3, "S", "b2", "builder", "other words", 3), (4, "S", "r2", "reviewer", "unknown thing", 4)]
    spark.createDataFrame(agents, "row_id bigint, session_id string, id string, type string, description string, started_at bigint").write.parquet(f"{tmp_path}/agents.parquet")
    text = lambda t: json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": t}]}})
    log = [(1, "p", "/l/s/subagents/run-r1.jsonl", 1, text("VERDICT: changes")), (2, "p", "/l/s/subagents/run-r2.jsonl", 1, text("VERDICT: approve")), (3, "p", "/l/other/subagents/run-b2.jsonl", 1, text("VERDICT: approve"))]
    spark.createDataFrame(log, "log_id bigint, profile string, src string, line int, json string").write.parquet(f"{tmp_path}/call_log.parquet")
    got = {r.id: (r.task, r.linked_by, r.verdict) for r in plans.task_links(spark, str(tmp_path)).collect()}
    assert got == {"b1": (0, "new", None), "r1": (0, "description", "changes"), "b2": (0, "time", None), "r2": (0, "time", "approve")}
    assert [(r.approve, r.changes, r.unclear) for r in plans.task_rollup(spark, str(tmp_path)).collect()] == [(1, 1, 0)]
