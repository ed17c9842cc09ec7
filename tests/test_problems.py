"""The general problems against plain Python, on the small tables and on hand-made cases."""

import json
from datetime import datetime

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.instants import instant_micros
from millrace.operators import delivery, drift, nesting, sessions
from millrace.operators.hierarchy import Forest, agent_links
from millrace.plans.problems import QUERIES
from millrace.tables import load

CALLS = "row_id bigint, batch string, src string, line int, ts string, session_id string, request_id string, copies string, message struct<id:string,usage:struct<output_tokens:bigint>>"
LOG = "log_id bigint, src string, json string, v string, path string"
AGENTS = "row_id bigint, id string, parent_id string, n string"
LISTED = "listing_id bigint, listed_at timestamp, id string, parent_id string, label string"


def call(row, mid=None, rid=None, out=None, ts=None, session=None):
    return (row, "b", "s", row, ts, session, rid, "x", {"id": mid, "usage": {"output_tokens": out}})


# --- instants ------------------------------------------------------------------------

INSTANTS = [
    ("2021-01-04T03:17:41.084Z", 1609730261084000),
    ("2021-01-04 03:17:41", 1609730261000000),
    ("2021-01-04T05:17:41+02:00", 1609730261000000),
    ("2021-01-04T05:17:41.5+0200", 1609730261500000),
    ("2021-01-04T05:17:41,25+02", 1609730261250000),
    ("2021-01-03T21:47:41.123456789-05:30", 1609730261123456),
    ("2021-01-04T03:17:41.0000001Z", 1609730261000000),
    ("1999-12-31T23:59:59Z", None),
    ("2021-02-30T00:00:00Z", None),
    ("2021-01-04T24:00:00Z", None),
    ("2021-01-04T03:17Z", None),
    ("2021-01-04", None),
    ("n/a", None),
    ("", None),
    (None, None),
]


def test_instants(spark):
    got = spark.createDataFrame([(t,) for t, _ in INSTANTS], "t string").select(instant_micros(F.col("t"))).collect()
    assert [r[0] for r in got] == [us for _, us in INSTANTS] == [brute.micros(t) for t, _ in INSTANTS]


def test_instants_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2021-07-04 03:17:41",)], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(instant_micros(F.col("t"))).first()[0] == brute.micros("2021-07-04 03:17:41")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- 1: delivered more than once --------------------------------------------------------


def test_p1_small_tables(spark, small, rows):
    raw = load(spark, small, "calls").select("row_id", "message.id", "request_id", "message.usage.output_tokens", "ts").collect()
    assert rows(QUERIES["p1_found"](spark, small)) == {(r,) for r in brute.p1(map(tuple, raw))}


def test_p1_cases(spark, rows):
    a, b = "2021-01-04T03:17:41Z", "2021-01-04T03:17:42Z"
    made = [
        call(1, "msg_00000000000000aa", out=5, ts=b),
        call(2, " msg_00000000000000aa\t", out=5, ts=a),  # earlier, white space apart
        call(3, "msg_00000000000000aa", out=None, ts=a),
        call(4, None, "req_1", 3, a),
        call(5, "  ", "req_1", 3, a),  # a tie: the smaller row stays
        call(6, None, None),
        call(7, "", ""),
        call(8, "x", out=0, ts="n/a"),
        call(9, "x", out=0, ts=b),  # unreadable comes last
        call(10, "y", out=-1),
        call(11, "y", out=None),
        call(12, "00000000000000aa", out=9),  # the same digits by another prefix
        call(13, "msg_"),
        call(14, "msg_0000000000000000"),
        call(15, "z" * 100_000),
        call(16, "z" * 100_000),
        (None, *call(17, "msg_00000000000000aa", out=99)[1:]),
    ]
    df = spark.createDataFrame(made, CALLS)
    assert rows(delivery.surplus_rows(df)) == {(1,), (3,), (5,), (8,), (11,), (16,)}
    kept = delivery.delivered_once(df.where("row_id IS NOT NULL"))
    assert kept.count() == 10 and set(kept.columns) == set(df.columns)
    assert delivery.surplus_rows(df.where("false")).isEmpty()


def test_p1_permutation_is_one_to_one(spark):
    x = spark.range(20000).select(F.col("id").alias("l"), (F.col("id") % 7).alias("h"))
    h, low = delivery.permuted(F.col("h"), F.col("l"))
    y = x.select(h.alias("a"), low.alias("b"))
    assert y.distinct().count() == 20000
    assert y.where("a < 0 OR a > 4294967295 OR b < 0 OR b > 4294967295").isEmpty()


# --- 2: hierarchies ---------------------------------------------------------------------


def test_p2_small_tables(spark, small, rows):
    a = load(spark, small, "agents").select("row_id", "id", "parent_id").collect()
    b = load(spark, small, "listed_agents").select("listed_at", "listing_id", "id", "parent_id").collect()
    assert rows(QUERIES["p2_found"](spark, small)) == brute.p2(brute.parents(map(tuple, a), map(tuple, b)))


def forest(spark, link, **more):
    return Forest(spark, spark.createDataFrame(list(link.items()), "id string, parent_id string"), **more)


@pytest.mark.parametrize("base", [None, 16])
def test_p2_shapes(spark, rows, base):
    link = {f"c{k}": f"c{k - 1}" if k else None for k in range(70)}  # a chain
    link |= {f"s{k}": "hub" for k in range(200)} | {"hub": None}  # a star
    link |= {"r1": "r2", "r2": "r3", "r3": "r1", "below": "r2", "under": "below", "self": "self", "alone": None}
    f = forest(spark, link, base=base)
    assert rows(f.roots()) == brute.p2(link)
    inside = {r.agent_id: r for r in f.intervals().collect()}
    assert all((r.leave - r.enter - 1) // 2 == sum(q.root_id == r.root_id and r.enter < q.enter < r.leave for q in inside.values()) for r in inside.values())
    paths = {r.agent_id: r for r in f.paths(chunk=16).collect()}
    for i in link:
        up, x = [i], i
        while link[x] is not None and x not in ("r1", "r2", "r3", "self"):
            x = link[x]
            up.append(x)
        assert paths[i].path == up[::-1]
        assert paths[i].on_or_below_cycle == (up[-1] in ("r1", "r2", "r3", "self"))
    assert paths["c0"].n_descendants == 69 and paths["hub"].n_descendants == 200 and paths["alone"].n_descendants == 0
    pairs = rows(f.descendants())
    assert ("c0", "c69", 69) in pairs and ("hub", "s7", 1) in pairs and ("r2", "under", 2) in pairs
    assert len(pairs) == 70 * 69 // 2 + 200 + 3


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(-1, 14), min_size=1, max_size=15))
def test_p2_any_links(spark, parents):
    link = {f"n{i}": f"n{p}" if 0 <= p < len(parents) else None for i, p in enumerate(parents)}
    for base in (None, 4):
        assert {tuple(r) for r in forest(spark, link, base=base).roots().collect()} == brute.p2(link)


def test_p2_order_of_siblings(spark):
    made = [("r", None, 0), ("b", "r", 5), ("a", "r", 5), ("c", "r", 1), ("d", "c", 9), ("e", "c", 2), *[(f"x{k}", "b", -k) for k in range(60)]]
    for base in (None, 16):
        f = Forest(spark, spark.createDataFrame(made, "id string, parent_id string, at int"), by=("at", "id"), base=base)
        got = [r.agent_id for r in f.intervals().orderBy("enter").collect()]
        assert got == ["r", "c", "e", "d", "a", "b", *[f"x{k}" for k in reversed(range(60))]]


def test_p2_links(spark, rows):
    t = datetime(2021, 1, 1)
    a = spark.createDataFrame([(1, "a", "b", "x"), (2, "b", " ", "x"), (3, "c", "nowhere", "x"), (4, None, "a", "x"), (5, "d", "a", "x"), (6, "d", "a", "x")], AGENTS)
    b = spark.createDataFrame([(1, t, "a", None, "x"), (2, t, "e", "a", "x"), (3, t, "e", "b", "x"), (4, None, "e", "c", "x")], LISTED)
    got = rows(agent_links(a, b))
    assert got == {("a", None), ("b", None), ("c", "nowhere"), ("d", "a"), ("e", "b")}
    f = Forest(spark, agent_links(a, b))
    assert rows(f.roots()) == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("d", "a", 1), ("e", "b", 1)}
    empty = Forest(spark, agent_links(a.where("false"), b.where("false")))
    assert empty.roots().isEmpty() and empty.paths().isEmpty() and empty.descendants().isEmpty()


# --- 3: drift -----------------------------------------------------------------------------


def test_p3_small_tables(spark, small, rows):
    lines = load(spark, small, "call_log").select("src", "json").collect()
    schema = load(spark, small, "log_schema").collect()
    assert rows(QUERIES["p3_found"](spark, small)) == brute.p3(map(tuple, lines), map(tuple, schema))


def sound(**change):
    line = {"type": "assistant", "timestamp": "2021-01-04T03:17:41Z", "sessionId": "s", "message": {"role": "assistant", "model": "m-1", "usage": {
        "input_tokens": 1, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 30000, "output_tokens": 400, "output_tokens_details": {"thinking_tokens": 5}, "cache_creation": {"ephemeral_5m_input_tokens": 6, "ephemeral_1h_input_tokens": 7}}}}
    for path, value in change.items():
        o, *rest = [line], *path.split("__")
        at = line
        for k in rest[:-1]:
            at = at[k]
        if value is None:
            del at[rest[-1]]
        else:
            at[rest[-1]] = value
    return line


def test_p3_changes(spark, small, rows):
    schema = load(spark, small, "log_schema")
    u = "message__usage__"
    lines = [
        ("sound", sound()),
        ("removed", sound(type=None)),
        ("renamed", sound(**{u + "output_tokens": None, u + "outputTokens": 401})),
        ("both", sound(**{u + "output_tokens": None, u + "input_tokens": None, u + "outputTokens": 402})),
        ("retyped", sound(**{u + "input_tokens": 12.5})),
        ("object", sound(**{u + "cache_creation": [1]})),
        ("added", sound(extra={"below": 1}, **{u + "retries": 2})),
        ("moved", sound(message__usage=None, usage={"input_tokens": 1})),
        ("nested", sound(**{u + "cache_creation__ephemeral_5m_input_tokens": None, u + "cache_creation__5m": 6})),
        ("user", sound(message__role="user", type=None)),
    ]
    spelled = json.dumps(sound(type=None)).replace('"role": "assistant"', '"role": "\\u0061ssistant"')
    made = [(k, src, json.dumps(o), "x", "y") for k, (src, o) in enumerate(lines)]
    made += [(99, "spelled", spelled, "x", "y"), (100, "zero", json.dumps(sound()).replace('"input_tokens": 1,', '"input_tokens": 1.0,'), "x", "y"), (101, "broken", '{"type"', "x", "y"), (102, "blank", None, "x", "y"), (103, None, json.dumps(sound(type=3)), "x", "y"), (104, "list", "[1]", "x", "y")]
    df = spark.createDataFrame(made, LOG)
    d = drift.Drift(spark, df, schema)
    got = rows(d.changes())
    assert got == {
        ("removed", "type", "removed"),
        ("spelled", "type", "removed"),
        ("renamed", "message.usage.output_tokens", "renamed"),
        ("both", "message.usage.output_tokens", "renamed"),
        ("both", "message.usage.input_tokens", "removed"),
        ("retyped", "message.usage.input_tokens", "retyped"),
        ("object", "message.usage.cache_creation", "retyped"),
        ("added", "extra", "added"),
        ("added", "message.usage.retries", "added"),
        ("moved", "message.usage", "removed"),
        ("moved", "usage", "added"),
        ("nested", "message.usage.cache_creation.ephemeral_5m_input_tokens", "renamed"),
        ("zero", "message.usage.input_tokens", "retyped"),
        (None, "type", "retyped"),
    }
    table = {r.log_id: r for r in d.unified().collect()}
    assert table[2].message_usage_output_tokens == 401 and table[3].message_usage_output_tokens == 402 and table[3].message_usage_input_tokens is None
    assert table[100].message_usage_input_tokens == 1 and table[4].message_usage_input_tokens is None and table[103].type == "3"
    assert table[8].message_usage_cache_creation_ephemeral_5m_input_tokens == 6 and 9 not in table and 101 not in table
    none = drift.Drift(spark, df.where("false"), schema)
    assert none.changes().isEmpty() and none.unified().isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 9), min_size=4, max_size=4), min_size=1, max_size=4))
def test_best_matching(scores):
    from itertools import permutations

    got = drift.best_matching([[float(x) for x in r] for r in scores])
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    best = max(((sum(scores[i][j] >= 0 for i, j in enumerate(p)), sum(max(0, scores[i][j]) for i, j in enumerate(p) if scores[i][j] >= 0)) for p in permutations(range(4), len(scores))), default=(0, 0))
    assert (len(got), sum(scores[i][j] for i, j in got)) == best


def test_similarities():
    assert drift.name_similarity("output_tokens", "outputTokens") == 1.0 > drift.name_similarity("output_tokens", "generated") >= 0
    assert drift.sketch_similarity({"i8": 3}, {"i8": 6}) == 1.0 and drift.sketch_similarity({}, {"i8": 1}) == 0.0


# --- 4: sessions ----------------------------------------------------------------------------


def test_p4_small_tables(spark, small, rows):
    raw = load(spark, small, "calls").select("session_id", "ts").collect()
    assert rows(QUERIES["p4_found"](spark, small)) == brute.p4(map(tuple, raw))


def test_p4_cases(spark, rows):
    at = lambda s: f"2021-01-04T{s}"
    made = [("A", at("00:00:00Z")), ("a", at("00:30:00Z")), ("a", at("01:00:00.001Z")), ("b", at("00:29:59.999Z")), ("b", at("00:30:00Z")), ("b", at("00:30:00Z")), (" ", at("00:00:00Z")), (None, at("00:00:00Z")), ("c", "n/a")]
    df = spark.createDataFrame([call(k, session=s, ts=t) for k, (s, t) in enumerate(made)], CALLS)
    got = rows(sessions.call_sessions(df))
    assert {g[:3] for g in got} == brute.p4(made)
    assert {(g[0], g[3], g[4]) for g in got} == {("a", 1800000, 2), ("a", 0, 1), ("b", 1, 3)}
    assert sessions.call_sessions(df.where("false")).isEmpty()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 12000)), min_size=1, max_size=40))
def test_p4_any_events(spark, events):
    df = spark.createDataFrame([(k, s * 1_000_000) for k, s in events], "k string, us bigint")
    got = {(r.k, r.start_us // 1000, r.end_us // 1000) for r in sessions.sessionize(df, "k", "us").collect()}
    iso = lambda s: datetime.fromtimestamp(s + 1609459200).strftime("%Y-%m-%dT%H:%M:%SZ")
    base = 1609459200000
    assert got == {(k, a - base, b - base) for k, a, b in brute.p4([(k, iso(s)) for k, s in events])}


# --- 5: nested records -------------------------------------------------------------------------


def test_p5_small_tables(spark, small, rows):
    lines = load(spark, small, "call_log").select("log_id", "json").collect()
    assert rows(QUERIES["p5_found"](spark, small)) == brute.p5(map(tuple, lines))


def deep(n):
    return {"type": "group", "content": [1, deep(n - 1)]} if n else {"type": "text", "text": "x"}


def test_p5_cases(spark, rows):
    m = lambda content, **more: json.dumps({"message": {"role": "user", "content": content}, **more})
    lines = [
        (1, m([{"type": "tool_use", "id": "t", "input": {"content": [{"type": "text"}]}}, "text", 3, {"type": "tool_result", "tool_use_id": "t"}])),
        (2, m([{"type": "tool_use", "id": "t"}])),
        (3, m({"type": "tool_result", "tool_use_id": "t", "content": {"type": "text"}})),
        (4, m([{"type": "tool_result", "tool_use_id": "nowhere", "content": [None, {"no": "type"}]}])),
        (5, m(deep(25))),
        (6, m("just text")),
        (7, json.dumps({"message": {}})),
        (8, json.dumps({"message": 3})),
        (9, "[]"),
        (10, ""),
        (11, None),
        (12, m([{"type": 3, "id": 4}, {"type": "tool_result", "tool_use_id": 5}, {"type": "text", "text": "y" * 300_000}])),
    ]
    df = spark.createDataFrame([(k, "s", j, "x", "y") for k, j in lines], LOG)
    got = rows(nesting.Blocks(spark, df).linked().select("log_id", "path", "parent_log_id", "parent_path"))
    assert got == brute.p5(lines)
    assert max(p.count("/") for k, p, _, _ in got if k == 5) == 25
    assert nesting.Blocks(spark, df.where("false")).linked().isEmpty()
    assert rows(nesting.flat_lines(df.withColumn("line", F.lit(1))).select("log_id")) == {(k,) for k in (1, 2, 3, 4, 5, 6, 7, 8, 12)}


def test_p5_usage(spark, rows):
    df = spark.createDataFrame([(1, "s", json.dumps(sound()), "x", "y"), (2, "s", json.dumps({"message": {"usage": [1]}}), "x", "y")], LOG)
    got = rows(nesting.flat_usage(df))
    assert (1, "", "output_tokens", 400) in got and (1, "cache_creation", "ephemeral_1h_input_tokens", 7) in got and len(got) == 7


@pytest.mark.parametrize("name", ["p1_delivered_once", "p2_paths", "p2_descendants", "p3_unified", "p3_renames", "p4_sessions", "p5_blocks", "p5_lines", "p5_usage"])
def test_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() >= (name != "p3_renames")
