"""Findings: each a row of what it is, how sure it is, how much it stands for and its score, joined by union.

A finding has ``finding``, ``list`` (A: tokens to be saved, B: things to look at),
``confidence`` (measured, inferred), ``evidence`` (how many), ``tokens`` and ``weight``
(millionths, see ``usage.weighted``). ``ranked`` adds what falls on a week and the score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import whole_median
from . import content, usage

PEAK = 300_000
START = 30_000
ROUNDS = 2
#: How much a finding's weight counts in its score, in percent.
CONFIDENCE = {"measured": 100, "inferred": 50}


def _row(df: DataFrame, name, listed: str, confidence, evidence, tokens, weight=None) -> DataFrame:
    name = F.lit(name) if isinstance(name, str) else name
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    weight = F.lit(0) if weight is None else weight
    zero = F.lit(0).cast("decimal(38,6)")
    return df.select(name.alias("finding"), F.lit(listed).alias("list"), confidence.alias("confidence"), evidence.cast("bigint").alias("evidence"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(weight.cast("decimal(38,6)"), zero).alias("weight")).where("evidence > 0")


def of_usage(kept: DataFrame, weights: DataFrame) -> DataFrame:
    """Rewrites of the cache after a pause, contexts beyond the peak, large contexts at the start, sessions near their limit, models of unknown weight.

    Written tokens weigh as cache writes, those of too large contexts as cache reads at
    each call's model; what is unknown weighs nothing.
    """
    w = usage.weighted(kept, weights)
    again = usage.rewrites(w).where("bucket <> '<5m'").groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("written").alias("t"), F.sum("weight_write").alias("w"))
    per_read = usage.read_rate(kept, weights)
    main = kept.where("kind = 'main' AND at IS NOT NULL").withColumn("ctx", usage.context()).join(per_read, "model", "left")
    beyond = F.col("ctx") - PEAK
    over = main.where(beyond > 0).agg(F.count(F.lit(1)).alias("n"), F.sum(beyond).alias("t"), F.sum(beyond * F.col("per_read")).alias("w"))
    s = usage.sessions(kept)
    start = s.agg(F.sum("calls").alias("calls"), whole_median(F.col("first_ctx")).alias("m"), F.count(F.lit(1)).alias("n"), F.count_if("near_limit").alias("near"))
    each = main.where("stream IS NOT NULL").agg(F.sum("per_read").alias("per"))
    start = start.withColumn("per", each.select("per").scalar())
    unknown = kept.select("model").distinct().join(per_read, "model", "left").where("per_read IS NULL AND model IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("m") - START
    parts = [
        _row(again, F.concat_ws(":", F.lit("cache_rewrite_after_idle"), "kind", "bucket"), "A", "measured", F.col("n"), F.col("t"), F.col("w")),
        _row(over, "peak_context_over_threshold", "A", "measured", F.col("n"), F.col("t"), F.col("w")),
        _row(start.where(large > 0), "start_context_size", "A", "measured", F.col("n"), large * F.col("calls"), large * F.col("per")),
        _row(start, "sessions_near_context_limit", "B", "inferred", F.col("near"), F.lit(0)),
        _row(unknown, "unpriced_models", "B", "measured", F.col("n"), F.lit(0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def of_contents(blocks: DataFrame, models: DataFrame, large: int = content.LARGE_RESULT) -> DataFrame:
    """Files read again, by one stream or by a subagent after its parent, and large results.

    A quarter of the characters are tokens, cut off per stream; they weigh as written to
    the cache for five minutes, at the model of the stream (``models``: ``src`` and
    ``per_write``), and nothing where that is unknown.
    """
    rate = models.select("src", "per_write")
    weigh = lambda df: df.join(rate, "src", "left").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum(F.col("t") * F.col("per_write")).alias("w"))
    again = weigh(content.repeated_reads(blocks).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(extra_chars) div 4").alias("t")))
    parent = weigh(content.rereads_of_parent(blocks).select("src", F.col("again").alias("n"), F.expr("chars div 4").alias("t")))
    excess = content.named_results(blocks).where(F.col("chars") > large).groupBy("tool", "src").agg(F.count(F.lit(1)).alias("n"), F.expr(f"sum(chars - {large}) div 4").alias("t"))
    excess = excess.join(rate, "src", "left").groupBy("tool").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum(F.col("t") * F.col("per_write")).alias("w"))
    parts = [
        _row(again, "repeated_file_reads", "A", "inferred", F.col("n"), F.col("t"), F.col("w")),
        _row(parent, "subagent_rereads_parent_files", "A", "inferred", F.col("n"), F.col("t"), F.col("w")),
        _row(excess, F.concat_ws(":", F.lit("large_tool_results"), "tool"), "A", "inferred", F.col("n"), F.col("t"), F.col("w")),
    ]
    return reduce(DataFrame.unionByName, parts)


def of_tasks(linked: DataFrame, tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Tasks of more than ``rounds`` reviews: the tokens (and ``weight``) of their runs beyond that many of a kind; measured if all are linked by words."""
    heavy = content.tasks(linked, rounds).where(F.col("rounds") > rounds)
    extra = heavy.select("session_id", "task", F.explode_outer("extra_runs").alias("id")).join(tokens, ["session_id", "id"], "left")
    used = extra.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"))
    found = heavy.agg(F.count(F.lit(1)).alias("n"), F.bool_and("all_linked").alias("sure")).withColumn("u", used.select(F.struct("t", "w")).scalar())
    return _row(found, "reviewer_rounds_over_threshold", "A", F.when(F.col("sure"), "measured").otherwise("inferred"), F.col("n"), F.col("u.t"), F.col("u.w"))


def of_events(hits: DataFrame, verdicts: DataFrame, compacted: DataFrame) -> DataFrame:
    """Limits hit, reviews without a verdict, contexts compacted of themselves."""
    n = F.col("n")
    parts = [
        _row(hits.agg(F.count(F.lit(1)).alias("n")), "usage_limit_hits", "B", "measured", n, F.lit(0)),
        _row(verdicts.agg(F.count_if(F.col("verdict") == "unclear").alias("n")), "reviewer_verdict_unclear", "B", "measured", n, F.lit(0)),
        _row(compacted.agg(F.count_if(F.col("trigger") == "auto").alias("n")), "auto_compactions", "B", "measured", n, F.lit(0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def ranked(found: DataFrame, days: int) -> DataFrame:
    """Findings with their share of a week and their score, the highest first.

    Tokens and hundredths of weight are what falls on a week of ``days``, half up; the
    score is that rounded weight by the confidence, half up again.
    """
    share: Column = F.floor((F.col("weight") * 14 + F.lit(days * 10000)) / F.lit(days * 20000)).cast("bigint")
    sure = F.create_map(*[F.lit(x) for k, v in CONFIDENCE.items() for x in (k, v)])[F.col("confidence")]
    x = found.withColumns({"weekly_tokens": usage.weekly_share(F.col("tokens"), days), "weekly_cents": share})
    x = x.withColumn("score", F.floor((F.col("weekly_cents") * sure + 50) / 100).cast("bigint")).drop("weight")
    return x.orderBy(F.desc("score"), F.desc("weekly_tokens"), "finding")
