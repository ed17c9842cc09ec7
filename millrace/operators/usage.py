"""Usage analytics over delivered assistant messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_micros, trimmed
from ..functions.scalars import iso_week, nearest_rank_p90, pct, whole_median

MEASURES = ("inp", "w5", "w1", "read", "out")
IDLE_SECONDS = (300, 3600)
WINDOWS = (200_000, 1_000_000)
PEAKS = (200_000, 300_000, 500_000, 800_000)


def usage(calls: DataFrame) -> DataFrame:
    """One row per delivery, with its stream, times, token counts and key.

    A stream is what one reader of a conversation wrote: kind 'sub' for a file below
    ``subagents`` (id: the file's stem), 'side' for a side chain in a main file, else
    'main' (id: the session in lower case). Cache writes without a split count as
    5-minute ones. The key is the message's id, else the request's, else file and line.
    Null counts are 0; an unreadable time is null.
    """
    u, parts = F.col("message.usage"), F.split("src", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    in_sub = F.coalesce(F.element_at(parts, -2) == "subagents", F.lit(False))
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint")
    split = u["cache_creation"]
    unsplit = split["ephemeral_5m_input_tokens"].isNull() & split["ephemeral_1h_input_tokens"].isNull()
    session = F.lower(trimmed(F.col("session_id")))
    side = F.coalesce(F.col("is_sidechain"), F.lit(False))
    return calls.select(
        "row_id",
        "profile",
        "src",
        "line",
        session.alias("session"),
        in_sub.alias("sub"),
        F.when(in_sub, "sub").when(side, "side").otherwise("main").alias("kind"),
        F.when(in_sub, stem).otherwise(session).alias("stream"),
        F.when(in_sub, F.element_at(parts, -3)).alias("parent_session"),
        F.timestamp_micros(instant_micros(F.col("ts"))).alias("at"),
        F.col("message.model").alias("model"),
        F.coalesce(trimmed(F.col("effort")), F.lit("unknown")).alias("effort"),
        count(u["input_tokens"]).alias("inp"),
        F.when(unsplit, count(u["cache_creation_input_tokens"])).otherwise(count(split["ephemeral_5m_input_tokens"])).alias("w5"),
        count(split["ephemeral_1h_input_tokens"]).alias("w1"),
        count(u["cache_read_input_tokens"]).alias("read"),
        count(u["output_tokens"]).alias("out"),
        F.coalesce(trimmed(F.col("message.id")), trimmed(F.col("request_id")), F.concat_ws(":", "src", "line")).alias("key"),
    )


def context(c: str = "") -> Column:
    return F.col("inp") + F.col("w5") + F.col("w1") + F.col("read")


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row per key: the most output tokens, then main before sub, the earlier time, the smaller file and line.

    The best is an aggregate, reduced in each task before the shuffle, so that one key
    of a third of all rows is no burden. Filters on dates come after it: the best copy
    may lie outside a range that holds a worse one.
    """
    order = F.struct(-F.col("out"), F.col("sub"), F.col("at").isNull(), "at", "src", "line", "row_id")
    best = rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "key"]), order).alias("b"))
    return best.select("key", "b.*")


def measures() -> list[Column]:
    return [
        F.count_distinct("session").alias("sessions"),
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(m).alias(m) for m in MEASURES],
        pct(F.sum("read"), F.sum(context())).alias("hit_pct"),
    ]


def core(rows: DataFrame) -> DataFrame:
    return rows.groupBy().agg(*measures())


def weekly(rows: DataFrame) -> DataFrame:
    """Measures by week, model and effort, with a SUBTOTAL per week and a TOTAL; sessions are counted anew on each level."""
    dated = rows.where("at IS NOT NULL").withColumn("week", iso_week(F.col("at")))
    sets = dated.groupingSets([[F.col("week"), F.col("model"), F.col("effort")], [F.col("week")], []], "week", "model", "effort").agg(F.grouping_id().alias("g"), *measures())
    level = F.when(F.col("g") == 0, "group").when(F.col("g") == 3, "SUBTOTAL").otherwise("TOTAL")
    return sets.select(level.alias("level"), "week", "model", "effort", "sessions", "calls", *MEASURES, "hit_pct")


def weekly_by_kind(rows: DataFrame) -> DataFrame:
    return rows.where("at IS NOT NULL").groupBy(iso_week(F.col("at")).alias("week"), "kind").agg(*measures())


def partial_weeks(rows: DataFrame) -> DataFrame:
    """Weeks that the data's first or last day cuts."""
    span = rows.where("at IS NOT NULL").agg(F.to_date(F.min("at")).alias("first"), F.to_date(F.max("at")).alias("last"))
    weeks = rows.where("at IS NOT NULL").select(F.to_date(F.date_trunc("week", "at")).alias("monday")).distinct()
    joined = weeks.withColumn("span", span.select(F.struct("first", "last")).scalar()).select("monday", "span.*")
    reason = F.concat_ws("; ", F.when(F.col("monday") < F.col("first"), "starts late"), F.when(F.date_add("monday", 6) > F.col("last"), "ends early"))
    return joined.select(iso_week(F.col("monday")).alias("week"), reason.alias("reason")).where("reason <> ''")


def reconciliation(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Per measure: raw sum, deduplicated sum, difference, and the number of surplus rows."""
    names = ("rows", *MEASURES)

    def total(df: DataFrame, tag: str) -> DataFrame:
        sums = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in MEASURES])
        return sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(tag).alias("tag"), F.coalesce(m, F.lit(0)).alias("v")) for m in names])))

    side = lambda tag: F.sum(F.when(F.col("tag") == tag, F.col("v")))
    both = total(raw, "raw").unionByName(total(kept, "kept")).groupBy("measure").agg(side("raw").alias("raw"), side("kept").alias("kept"))
    return both.withColumn("removed", F.col("raw") - F.col("kept"))


def _ordered() -> Column:
    return F.struct("at", "key")


def sessions(rows: DataFrame) -> DataFrame:
    """Per main stream: start, calls, first, last and peak context, the model at the peak, the window assumed and whether the end is near it."""
    main = rows.where("kind = 'main' AND stream IS NOT NULL AND at IS NOT NULL").withColumn("ctx", context())
    agg = main.groupBy("profile", "stream").agg(
        F.min("at").alias("start"),
        F.count(F.lit(1)).alias("calls"),
        F.min_by("ctx", _ordered()).alias("first_ctx"),
        F.max_by("ctx", _ordered()).alias("last_ctx"),
        F.max("ctx").alias("peak_ctx"),
        F.max_by("model", F.struct("ctx", "key")).alias("peak_model"),
    )
    window = F.when(F.col("peak_ctx") > WINDOWS[0], WINDOWS[1]).otherwise(WINDOWS[0]).cast("bigint")
    return agg.withColumn("window", window).withColumn("near_limit", F.col("last_ctx") * 10 >= F.col("window") * 8)


def peak_buckets(rows: DataFrame) -> DataFrame:
    s = sessions(rows)
    over = s.agg(F.count(F.lit(1)).alias("sessions"), *[F.count_if(F.col("peak_ctx") > p).alias(f"over_{p // 1000}k") for p in PEAKS], F.count_if("near_limit").alias("near_limit"))
    return over


def start_context(rows: DataFrame) -> DataFrame:
    """Median and 90th percentile of the first context, of all profiles and of each."""
    s = sessions(rows)
    each = s.groupBy("profile").agg(F.count(F.lit(1)).alias("sessions"), whole_median(F.col("first_ctx")).alias("median"), nearest_rank_p90("first_ctx").alias("p90"))
    whole = s.groupBy(F.lit("*").alias("profile")).agg(F.count(F.lit(1)).alias("sessions"), whole_median(F.col("first_ctx")).alias("median"), nearest_rank_p90("first_ctx").alias("p90"))
    return each.unionByName(whole)


def runs(rows: DataFrame) -> DataFrame:
    """Per subagent run: model and effort of its first call, calls, tokens, peak context, minutes (tenths, half up)."""
    sub = rows.where("kind = 'sub' AND at IS NOT NULL").withColumn("ctx", context())
    agg = sub.groupBy("profile", "stream").agg(
        F.min_by("model", _ordered()).alias("model"),
        F.min_by("effort", _ordered()).alias("effort"),
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("ctx") + F.col("out")).alias("tokens"),
        F.max("ctx").alias("peak_ctx"),
        F.floor((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1_000_000).alias("seconds"),
    )
    return agg.select("profile", "stream", "model", "effort", "calls", "tokens", "peak_ctx", (F.floor((F.col("seconds") * 10 + 30) / 60) / F.lit(10.0)).alias("minutes"))


def runs_by_model(rows: DataFrame) -> DataFrame:
    return runs(rows).groupBy("model", "effort").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens").alias("tokens"), whole_median(F.col("tokens")).alias("median_tokens"), whole_median(F.col("peak_ctx")).alias("median_peak"))


def gaps(rows: DataFrame) -> DataFrame:
    """Each call with the one before it in its stream and the seconds between.

    A stream of a third of all rows would make one window task of them; so the previous
    instant is taken within slots of an hour, which are aggregated, and across slots by
    a window over one row per slot.
    """
    s = rows.where("stream IS NOT NULL AND at IS NOT NULL").withColumn("us", F.unix_micros("at")).withColumn("slot", F.expr("us div 3600000000"))
    keys = ("profile", "kind", "stream")
    inner = s.withColumn("before", F.lag("us").over(Window.partitionBy(*keys, "slot").orderBy("us", "key")))
    ends = s.groupBy(*keys, "slot").agg(F.max("us").alias("end"))
    ends = ends.withColumn("slot_before", F.lag("end").over(Window.partitionBy(*keys).orderBy("slot"))).drop("end")
    joined = inner.join(ends.withColumnsRenamed({k: f"_{k}" for k in (*keys, "slot")}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "slot")], "left")
    return joined.withColumn("gap_us", F.col("us") - F.coalesce("before", "slot_before")).drop("before", "slot_before", "slot", "us", *[f"_{k}" for k in (*keys, "slot")])


def rewrites(rows: DataFrame) -> DataFrame:
    """Calls that wrote most of their context anew, with their kind and the pause before them; other columns stay."""
    ctx, written = context(), F.col("w5") + F.col("w1")
    g = gaps(rows).where(F.col("gap_us").isNotNull() & (ctx > 20_000) & (written * 2 > ctx))
    bucket = F.when(F.col("gap_us") <= IDLE_SECONDS[0] * 1_000_000, "<5m").when(F.col("gap_us") <= IDLE_SECONDS[1] * 1_000_000, "5m-1h").otherwise(">1h")
    return g.withColumns({"kind": F.when(F.col("kind") == "main", "main").otherwise("sub"), "bucket": bucket, "written": written})


def cache_rewrites(rows: DataFrame) -> DataFrame:
    """Calls that wrote most of their context anew, by kind and by the pause before them; all six cells are given."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(k, b) for k in ("main", "sub") for b in ("<5m", "5m-1h", ">1h")], "kind string, bucket string")
    found = rewrites(rows).groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("events"), F.sum("written").alias("written"))
    return cells.join(found, ["kind", "bucket"], "left").select("kind", "bucket", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"), F.coalesce("written", F.lit(0)).cast("bigint").alias("written"))


def rewrite_top_streams(rows: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` streams of each cell by tokens written anew, ties by id."""
    per = rewrites(rows).groupBy("kind", "bucket", "stream").agg(F.sum("written").alias("written"))
    return ranked_top(per, ["kind", "bucket"], [F.desc("written"), F.col("stream")], "stream", top)


def ranked_top(df: DataFrame, keys: list[str], order: list[Column], spread: str, top: int) -> DataFrame:
    """The first ``top`` rows of each key with their ``rank``; parts of a key, by ``spread``, are reduced to as many before the key's are ranked."""
    part = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(64)))
    few = part.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_n") <= top).drop("_n", "_part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)


METRICS = (
    "sessions", "calls", "inp", "w5", "w1", "read", "out", "hit_pct", "write_share_pct", "median_peak_context", "max_peak_context", "median_first_call_context", "tokens_per_session", "cents_in", "compactions", "auto_compactions", "limit_hits",
)


def metrics_by(rows: DataFrame, keys: tuple[str, ...], events: DataFrame, weights: DataFrame) -> DataFrame:
    """The 17 metrics of each group of ``keys``: counts and shares of its calls, contexts of its streams, and events of its sessions.

    ``events``: ``session``, ``what`` (compaction, limit), ``trigger`` and ``keys``; those
    of sessions without a call in the group don't count. ``weights``: see ``weighted``.
    """
    x = weighted(rows, weights).withColumn("ctx", context())
    per = x.where("stream IS NOT NULL").groupBy(*keys, "profile", "kind", "stream").agg(F.max("ctx").alias("peak"), F.min_by("ctx", _ordered()).alias("first"))
    peaks = per.groupBy(*keys).agg(whole_median(F.col("peak")).alias("median_peak_context"), F.max("peak").alias("max_peak_context"), F.median(F.when(F.col("kind") == "main", F.col("first"))).cast("bigint").alias("median_first_call_context"))
    total = x.groupBy(*keys).agg(*measures(), pct(F.sum(F.col("w5") + F.col("w1")), F.sum("ctx")).alias("write_share_pct"), F.expr("floor(try_divide(sum(ctx + out), count(distinct session)))").alias("tokens_per_session"), cents("weight_in").alias("cents_in"))
    own = events.join(x.select(*keys, "session").distinct(), [*keys, "session"], "left_semi")
    compaction = F.col("what") == "compaction"
    seen = own.groupBy(*keys).agg(F.count_if(compaction).alias("compactions"), F.count_if(compaction & (F.col("trigger") == "auto")).alias("auto_compactions"), F.count_if(F.col("what") == "limit").alias("limit_hits"))
    joined = total.join(peaks, list(keys), "left").join(seen, list(keys), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("compactions", "auto_compactions", "limit_hits")}
    return joined.withColumns(zero).select(*keys, *METRICS)


def metrics(rows: DataFrame, low: Column, high: Column, events: DataFrame, weights: DataFrame) -> DataFrame:
    """The metric vector of the half-open window [low, high); ``events`` have a time ``at``."""
    inside = lambda df: df.where((F.col("at") >= low) & (F.col("at") < high)).withColumn("_window", F.lit(1))
    return metrics_by(inside(rows), ("_window",), inside(events), weights).drop("_window")


def _sided(df: DataFrame, fixed: list, days: int) -> DataFrame:
    """Rows with each change on one of whose sides they lie, told in one pass with the changes as literals. The side after a change ends with the data."""
    each = F.array(*[F.struct(F.lit(d).cast("date").alias("date"), F.lit(s).alias("scope"), F.lit(end).cast("timestamp").alias("_end")) for d, s, end in fixed])
    x = df.where("at IS NOT NULL").select("*", F.inline(each))
    cut, span = F.col("date").cast("timestamp"), F.expr(f"INTERVAL {days} DAYS")
    side = F.when((F.col("at") >= cut - span) & (F.col("at") < cut), "before").when((F.col("at") >= cut) & (F.col("at") < F.least(cut + span, F.col("_end"))), "after")
    return x.withColumn("side", side).where("side IS NOT NULL").drop("_end")


def before_after(rows: DataFrame, changes: DataFrame, days: int = 14, least: int = 10) -> DataFrame:
    """Measures in the ``days`` before and after each change (``date``, ``scope``), and whether both sides have enough sessions.

    The range join is on few changes: each call is told its side of every change by one
    pass over the calls with the changes as literals.
    """
    fixed = [(r.date, r.scope, "9999-12-31") for r in changes.orderBy("date", "scope").collect()]  # a hand-written list
    x = in_scope(_sided(rows, fixed, days))
    agg = x.groupBy("date", "scope").agg(
        *[e for s in ("before", "after") for m in (f"{s}",) for e in (F.count_distinct(F.when(F.col("side") == m, F.col("session"))).alias(f"sessions_{s}"), F.sum(F.when(F.col("side") == m, context() + F.col("out")).otherwise(0)).alias(f"tokens_{s}"))]
    )
    enough = (F.col("sessions_before") >= least) & (F.col("sessions_after") >= least)
    delta = F.col("tokens_after") - F.col("tokens_before")
    return agg.select(F.col("date").cast("string").alias("date"), "scope", "sessions_before", "sessions_after", "tokens_before", "tokens_after", delta.alias("delta"), F.when(enough, "compared").otherwise("insufficient data").alias("result"))


def in_scope(x: DataFrame) -> DataFrame:
    """Rows whose ``kind`` is in their ``scope``: all, main (side chains included) or subagent."""
    return x.where((F.col("scope") == "all") | (F.col("scope") == "main") & (F.col("kind") != "sub") | (F.col("scope") == "subagent") & (F.col("kind") == "sub"))


def compared(rows: DataFrame, changes: DataFrame, end: str, events: DataFrame, weights: DataFrame, days: int = 14, least: int = 10) -> DataFrame:
    """All metrics before and after each change, in long form: ``date``, ``scope``, ``metric``, ``before``, ``after``, ``delta``, ``delta_pct``, ``result``.

    ``end``: the day after the last one of the data, with which the side after a change
    ends. A delta is null where a side is, its percentage (tenths, half up) also where
    the side before is 0.
    """
    fixed = [(r.date, r.scope, end) for r in changes.orderBy("date", "scope").collect()]  # a hand-written list
    keys = ("date", "scope", "side")
    m = metrics_by(in_scope(_sided(rows, fixed, days)), keys, _sided(events, fixed, days), weights)
    long = m.select(*keys, F.col("sessions").alias("_sessions"), F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("v")) for k in METRICS])))
    side = lambda name, v: F.max(F.when(F.col("side") == name, F.col(v))).alias(f"{v}_{name}")
    wide = long.groupBy("date", "scope", "metric").agg(*[side(n, v) for n in ("before", "after") for v in ("v", "_sessions")])
    # A side without any call has no vector: its counts are 0, the rest is unknown.
    counted = F.col("metric").isin("sessions", "calls", "inp", "w5", "w1", "read", "out", "hit_pct", "write_share_pct", "compactions", "auto_compactions", "limit_hits")
    value = lambda n: F.coalesce(f"v_{n}", F.when(counted | F.col(f"_sessions_{n}").isNull() & (F.col("metric") == "cents_in"), 0.0))
    x = wide.select("date", "scope", "metric", value("before").alias("before"), value("after").alias("after"), "_sessions_before", "_sessions_after")
    d = F.col("after") - F.col("before")
    share = F.when(F.col("before") != 0, F.signum(d) * F.floor(F.abs((d * 1000).cast("decimal(38,6)") / F.col("before").cast("decimal(38,6)")) + F.lit(0.5).cast("decimal(2,1)")) / 10)
    enough = (F.coalesce("_sessions_before", F.lit(0)) >= least) & (F.coalesce("_sessions_after", F.lit(0)) >= least)
    return x.select(F.col("date").cast("string").alias("date"), "scope", "metric", "before", "after", d.alias("delta"), share.cast("double").alias("delta_pct"), F.when(enough, "compared").otherwise("insufficient data").alias("result"))


#: How much writing for five minutes and for an hour weighs against plain input.
WRITE_FACTORS = ("1.25", "2")


def weighted(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with the weights of their tokens: ``weight_in``, ``weight_out``, ``weight_read``, ``weight_write``, in millionths; null for models no prefix fits.

    ``weights`` is a small parameter table: ``prefix`` of a model's name, ``input`` and
    ``output`` per million tokens, and ``read``, the factor of tokens read from a cache.
    The longest prefix counts. Each distinct model is looked up once.
    """
    known = longest_prefix(rows, "model", weights, "prefix").join(weights, "prefix", "left").select(F.col("model").alias("_model"), "input", "output", F.col("read").alias("_read"))
    x = rows.join(known, F.col("model") == F.col("_model"), "left")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    rate = lambda c: F.col(c).cast("decimal(8,4)")
    factor = lambda f: F.lit(f).cast("decimal(4,2)")
    read = whole("read") * F.col("_read").cast("decimal(4,2)")
    write = whole("w5") * factor(WRITE_FACTORS[0]) + whole("w1") * factor(WRITE_FACTORS[1])
    d = lambda c: c.cast("decimal(38,6)")
    return x.withColumns({"weight_in": d((whole("inp") + write + read) * rate("input")), "weight_out": d(whole("out") * rate("output")), "weight_read": d(read * rate("input")), "weight_write": d(write * rate("input"))}).drop("_model", "input", "output", "_read")


def read_rate(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``model``, ``per_read``, ``per_write``: what a token read from the cache, or written to it for five minutes, weighs; models without a weight are left out."""
    known = longest_prefix(rows, "model", weights, "prefix").where("prefix IS NOT NULL").join(weights, "prefix")
    rate = F.col("input").cast("decimal(8,4)")
    return known.select("model", (F.col("read").cast("decimal(4,2)") * rate).alias("per_read"), (F.lit(WRITE_FACTORS[0]).cast("decimal(4,2)") * rate).alias("per_write"))


def cents(c: str) -> Column:
    """The sum of weights in whole hundredths, half up; null if any of them is unknown."""
    return F.when(F.count_if(F.col(c).isNull()) == 0, hundredths(F.sum(c)))


def hundredths(total: Column) -> Column:
    return F.floor((total + F.lit(5000)) / F.lit(10000)).cast("bigint")


def weekly_share(total: Column, days: Column | int) -> Column:
    """What falls on a week of a total of so many days, half up."""
    return F.floor((total.cast("decimal(30,0)") * 14 + F.lit(days)) / (F.lit(days) * 2)).cast("bigint")


def weekly_weights(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights by week, model and effort with a SUBTOTAL per week and a TOTAL, in hundredths; null where a model is unknown."""
    dated = weighted(rows.where("at IS NOT NULL"), weights).withColumn("week", iso_week(F.col("at")))
    sets = dated.groupingSets([[F.col("week"), F.col("model"), F.col("effort")], [F.col("week")], []], "week", "model", "effort").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("calls"), cents("weight_in").alias("cents_in"), cents("weight_out").alias("cents_out"))
    level = F.when(F.col("g") == 0, "group").when(F.col("g") == 3, "SUBTOTAL").otherwise("TOTAL")
    return sets.select(level.alias("level"), "week", "model", "effort", "calls", "cents_in", "cents_out")


def runs_in_full(rows: DataFrame, types: DataFrame, weights: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``runs`` with their type (unknown without one in ``types``), their weight and, of reviewers, the verdict (``verdicts``: ``stream``, ``verdict``)."""
    each = weighted(rows.where("kind = 'sub' AND at IS NOT NULL"), weights).groupBy("profile", "stream").agg(cents("weight_in").alias("cents_in"), cents("weight_out").alias("cents_out"))
    one = verdicts.groupBy("stream").agg(F.max("verdict").alias("_verdict"))
    x = runs(rows).join(each, ["profile", "stream"]).join(types, "stream", "left").join(one, "stream", "left")
    kind = F.coalesce("type", F.lit("unknown"))
    return x.withColumns({"type": kind, "verdict": F.when(kind == "reviewer", F.coalesce("_verdict", F.lit("unclear")))}).drop("_verdict")


def weekly_by_type(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Measures by week, whether the calls are of a main stream or a subagent, and the subagent's type, empty for main streams."""
    x = rows.where("at IS NOT NULL").join(types, "stream", "left")
    split = F.when(F.col("sub"), "subagent").otherwise("main")
    kind = F.when(F.col("sub"), F.coalesce("type", F.lit("unknown"))).otherwise("")
    return x.groupBy(iso_week(F.col("at")).alias("week"), split.alias("split"), kind.alias("agent_type")).agg(*measures())


def runs_by_type(rows: DataFrame, types: DataFrame, weights: DataFrame) -> DataFrame:
    """Subagent runs by type (``types``: ``stream``, ``type``; unknown without a row): runs, tokens, medians, weights."""
    each = weighted(rows.where("kind = 'sub' AND at IS NOT NULL"), weights).withColumn("ctx", context())
    per = each.groupBy("profile", "stream").agg(F.sum(F.col("ctx") + F.col("out")).alias("tokens"), F.max("ctx").alias("peak_ctx"), cents("weight_in").alias("cents_in"))
    typed = per.join(types, "stream", "left").withColumn("type", F.coalesce("type", F.lit("unknown")))
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens").alias("tokens"), whole_median(F.col("tokens")).alias("median_tokens"), whole_median(F.col("peak_ctx")).alias("median_peak"), F.when(F.count_if(F.col("cents_in").isNull()) == 0, F.sum("cents_in")).alias("cents_in"))


def first_models(rows: DataFrame) -> DataFrame:
    """``stream``, ``model`` of its first call; of streams that share an id the last, by profile and kind."""
    per = rows.where("stream IS NOT NULL AND at IS NOT NULL").groupBy("profile", "kind", "stream").agg(F.min_by("model", _ordered()).alias("model"))
    return per.groupBy("stream").agg(F.max_by("model", F.struct("profile", "kind")).alias("model"))


def longest_prefix(values: DataFrame, value: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each distinct value with the longest prefix it begins with, null if none. ``prefixes`` is a small parameter table.

    Each distinct value, of which there are few, meets the table by equality with every
    beginning of its own.
    """
    distinct = values.select(value).where(F.col(value).isNotNull()).distinct()
    begins = distinct.select(value, F.explode_outer(F.when(F.length(value) > 0, F.sequence(F.lit(1), F.length(value)))).alias("n"))
    begins = begins.withColumn(prefix, F.substr(value, F.lit(1), F.col("n")))
    hits = begins.join(prefixes.select(prefix, F.lit(True).alias("known")).distinct(), prefix, "left").withColumn(prefix, F.when(F.col("known"), F.col(prefix)))
    return hits.groupBy(value).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
