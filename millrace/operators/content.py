"""Analytics over the contents of call logs: tools, reads, texts, drift of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.scalars import whole_median, word_set
from ..session import ship
from .nesting import _BLOCK, _elements

LARGE_RESULT = 20_000
REPEATED_READS = 3
READ_TOOL = "Read"
# How a review's verdict is written.
VERDICT = r"(?i)^[*#\s]*VERDICT:[^\S\r\n]*(APPROVE|PASS|CHANGES)\b"
# Words that tell the kind of a run or its round, not its task.
STOP_WORDS = (
    "a an and the of for to in on with at by build built rebuild validate validation revalidate re review rereview reviewer fix fixes write implement verify check final round rounds pass attempt iteration again follow up"
).split()


def classified(call_log: DataFrame) -> DataFrame:
    """Each line with its ``class``: blank, bad json, other (JSON but no object) or object. None is an error."""
    v = F.expr("try_parse_json(json)")
    kind = F.when(F.coalesce(F.trim(F.regexp_replace("json", r"[\s]+", " ")), F.lit("")) == "", "blank").when(v.isNull(), "bad json").when(F.expr("schema_of_variant(try_parse_json(json))").startswith("OBJECT<"), "object").otherwise("other")
    return call_log.withColumn("class", kind)


def _kind(path: str) -> str:
    return f"schema_of_variant(try_variant_get(v, '{path}', 'variant'))"


def _text(path: str) -> str:
    return f"CASE WHEN {_kind(path)} = 'STRING' THEN try_variant_get(v, '{path}', 'string') END"


def lines(call_log: DataFrame) -> DataFrame:
    """Object lines with ``v`` and the columns that their path and head tell: run, sub, session, us, kind."""
    parts = F.split("src", "/")
    parsed = call_log.withColumn("v", F.expr("try_parse_json(json)")).where("schema_of_variant(v) LIKE 'OBJECT<%'")
    return parsed.select(
        "log_id",
        "profile",
        "src",
        "line",
        "v",
        F.coalesce(F.element_at(parts, -2) == "subagents", F.lit(False)).alias("sub"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("run"),
        F.expr(f"lower({_text('$.sessionId')})").alias("session"),
        instant_micros(F.expr(_text("$.timestamp"))).alias("us"),
        F.expr(_text("$.message.role")).alias("role"),
        F.expr("schema_of_variant(try_variant_get(v, '$.message.usage', 'variant'))").alias("usage_kind"),
    )


def content_length(x: str) -> str:
    """SQL: the characters of a content value: of a text its own, of null none, of anything else those of its JSON with a space after each separator."""
    bare = f"regexp_replace(to_json({x}), '\"([^\"\\\\\\\\]|\\\\\\\\.)*\"', '')"
    return f"CASE WHEN {x} IS NULL OR schema_of_variant({x}) = 'VOID' THEN 0 WHEN schema_of_variant({x}) = 'STRING' THEN length(CAST({x} AS string)) ELSE length(to_json({x})) + length(regexp_replace({bare}, '[^,:]', '')) END"


def blocks(call_log: DataFrame) -> DataFrame:
    """The blocks on the top level of each line's content, with the line's columns."""
    rows = lines(call_log).withColumn("content", F.expr("try_variant_get(v, '$.message.content', 'variant')"))
    arr = f"transform({_elements('content')}, (x, i) -> struct(i AS pos, try_cast(x AS {_BLOCK}) AS b))"
    x = rows.select("log_id", "profile", "src", "run", "sub", "session", "us", F.expr(f"inline(filter({arr}, e -> e.b IS NOT NULL))"))
    text = lambda k: F.expr(f"CASE WHEN schema_of_variant(b['{k}']) = 'STRING' THEN CAST(b['{k}'] AS string) END").alias(k)
    path = F.expr("CASE WHEN schema_of_variant(try_variant_get(b['input'], '$.file_path', 'variant')) = 'STRING' THEN try_variant_get(b['input'], '$.file_path', 'string') END")
    return x.select("log_id", "profile", "src", "run", "sub", "session", "us", "pos", text("type"), text("id"), text("name"), text("tool_use_id"), text("text"), path.alias("file_path"), F.expr(content_length("b['content']")).cast("bigint").alias("chars"))


def tools(b: DataFrame) -> DataFrame:
    """Per tool id its first ``use`` and first ``result``, by line and position; null what is nowhere.

    Uses and results meet in one aggregate over their common id: the log is parsed once,
    nothing is joined, and copies are reduced in each task before the shuffle.
    """
    use, result = F.col("type") == "tool_use", F.col("type") == "tool_result"
    keyed = b.where(use | result).withColumn("tool_id", F.when(use, F.col("id")).otherwise(F.col("tool_use_id"))).where("tool_id IS NOT NULL")
    order = F.struct("log_id", "pos")
    first = lambda which, *cols: F.min_by(F.when(which, F.struct(*cols)), F.when(which, order))
    return keyed.groupBy("tool_id").agg(first(use, "name", "file_path", "profile", "session", "src", "sub", "us").alias("use"), first(result, "chars", "src").alias("result"))


def named_results(b: DataFrame) -> DataFrame:
    """Results with the name of the tool that gave them, 'unknown' if its use is nowhere."""
    t = tools(b).where("result IS NOT NULL")
    return t.select(F.col("tool_id").alias("tool_use_id"), "result.chars", "result.src", F.coalesce("use.name", F.lit("unknown")).alias("tool"))


def results_by_tool(b: DataFrame) -> DataFrame:
    per = named_results(b).groupBy("tool").agg(F.count(F.lit(1)).alias("results"), F.sum("chars").alias("chars"), F.max("chars").alias("max_chars"))
    return per.withColumn("tokens", F.expr("chars div 4"))


def large_results(b: DataFrame, limit: int = LARGE_RESULT) -> DataFrame:
    return named_results(b).where(F.col("chars") > limit).groupBy("tool").agg(F.count(F.lit(1)).alias("results"), F.sum(F.col("chars") - limit).alias("excess"))


def largest_results(b: DataFrame, top: int = 10) -> DataFrame:
    return named_results(b).select("tool_use_id", "tool", "chars").orderBy(F.desc("chars"), "tool_use_id").limit(top)


def _reads(b: DataFrame, tool: str) -> DataFrame:
    t = tools(b).where(F.col("use.name") == tool).where("use.file_path IS NOT NULL")
    return t.select(F.col("tool_id").alias("id"), "use.*", F.coalesce("result.chars", F.lit(0)).alias("chars"))


def repeated_reads(b: DataFrame, tool: str = READ_TOOL, least: int = REPEATED_READS) -> DataFrame:
    """Files read ``least`` times or more in one stream, and the characters of all reads but the first.

    All but the first is the sum less the first's, so no window over a stream is needed.
    """
    per = _reads(b, tool).groupBy("src", "file_path").agg(F.count(F.lit(1)).alias("reads"), (F.sum("chars") - F.min_by("chars", F.struct(F.col("us").isNull(), "us", "id"))).alias("extra_chars"))
    return per.where(F.col("reads") >= least)


def rereads_of_parent(b: DataFrame, tool: str = READ_TOOL) -> DataFrame:
    """Per subagent file: reads, those of files that the main stream had read before the subagent began, and their characters."""
    reads = _reads(b, tool)
    began = b.where("sub AND us IS NOT NULL").groupBy("src").agg(F.min("us").alias("began"))
    parent = reads.where("NOT sub AND us IS NOT NULL").groupBy("profile", "session", "file_path").agg(F.min("us").alias("parent_us"))
    own = reads.where("sub").join(began, "src", "left").join(parent, ["profile", "session", "file_path"], "left")
    again = F.coalesce(F.col("parent_us") < F.col("began"), F.lit(False))
    return own.groupBy("src").agg(F.count(F.lit(1)).alias("reads"), F.count_if(again).alias("again"), F.sum(F.when(again, F.col("chars")).otherwise(0)).alias("chars"))


def last_texts(call_log: DataFrame) -> DataFrame:
    """The last text of the assistant in each file that isn't blank: a text content, or its text blocks joined by line ends."""
    x = lines(call_log).where("role = 'assistant'")
    c = "try_variant_get(v, '$.message.content', 'variant')"
    parts = f"filter(transform({_elements(c)}, x -> try_cast(x AS {_BLOCK})), b -> b IS NOT NULL AND CAST(b['type'] AS string) = 'text' AND schema_of_variant(b['text']) = 'STRING')"
    text = F.expr(f"CASE WHEN schema_of_variant({c}) = 'STRING' THEN CAST({c} AS string) ELSE array_join(transform({parts}, b -> CAST(b['text'] AS string)), '\\n') END")
    rows = x.withColumn("text", text).where(r"text RLIKE '(?U)\\S'")
    return rows.groupBy("src").agg(F.max_by("text", F.struct("line", "log_id")).alias("text"))


def verdict(text: Column) -> Column:
    """approve, changes or unclear: the first line of the text that gives a verdict; lines are split first, so that none reaches into the next."""
    hits = F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: line.rlike(VERDICT))
    word = F.upper(F.regexp_extract(F.try_element_at(hits, F.lit(1)), VERDICT, 1))
    return F.when(word.isin("APPROVE", "PASS"), "approve").when(word == "CHANGES", "changes").otherwise("unclear")


def line_drift(call_log: DataFrame) -> DataFrame:
    """Assistant lines with the first ``reason`` for which a line is unusable, null for sound ones."""
    u = "$.message.usage"
    counts = ["input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"]
    bad_count = lambda path: f"{_kind(path)} NOT IN ('VOID', 'BIGINT') OR try_variant_get(v, '{path}', 'bigint') < 0"
    bad_text = lambda path: f"{_kind(path)} NOT IN ('VOID', 'STRING')"
    cases = [(f"coalesce({_kind(u)}, '') NOT LIKE 'OBJECT<%'", "usage")]
    cases += [(bad_count(f"{u}.{c}"), c) for c in counts]
    cases += [(f"{_kind(u + '.cache_creation')} NOT LIKE 'OBJECT<%' AND {_kind(u + '.cache_creation')} <> 'VOID'", "cache_creation")]
    cases += [(bad_count(f"{u}.cache_creation.ephemeral_{t}_input_tokens"), f"ephemeral_{t}") for t in ("5m", "1h")]
    cases += [(bad_count(f"{u}.output_tokens_details.thinking_tokens"), "thinking_tokens"), (bad_text("$.message.id"), "id"), (bad_text("$.requestId"), "requestId")]
    uses = f"filter(transform(coalesce(try_variant_get(v, '$.message.content', 'array<variant>'), CAST(array() AS array<variant>)), x -> try_cast(x AS {_BLOCK})), b -> CAST(b['type'] AS string) = 'tool_use')"
    cases += [(f"exists({uses}, b -> b['id'] IS NULL OR schema_of_variant(b['id']) <> 'STRING' OR CAST(b['id'] AS string) = '')", "tool_use id"), ("us IS NULL", "timestamp")]
    reason = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in cases) + " END"
    return lines(call_log).where("role = 'assistant'").withColumn("reason", F.expr(reason)).drop("v")


def linked_runs(runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Runs (``session_id``, ``id``, ``type``, ``description``, ``started_at``, ``verdict``) joined to tasks, greedily in the order of time.

    A run joins the task whose words overlap its own the most (coefficient of
    ``threshold`` or more, the latest on ties). Else a reviewer, or a builder if the
    newest task's last verdict was changes, joins the newest task, without adding its
    words; else it opens a task, by which a reviewer counts as unlinked. Only builders
    and reviewers are runs. Each step needs the one before it, so a session is read in
    order as a stream of rows: the worker holds the words of its tasks, never its rows.
    """
    ship(runs.sparkSession)
    words = runs.where("type IN ('builder', 'reviewer')").withColumn("words", word_set(F.coalesce("description", F.lit("")), STOP_WORDS))
    ordered = words.select("session_id", "id", "type", "started_at", "verdict", "words").repartition("session_id").sortWithinPartitions("session_id", "started_at", "id")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, known, verdicts = object(), [], []  # words and last verdict of each task
        for batch in batches:
            out = []
            for s, run, kind, at, said, w in batch.itertuples(index=False):
                if s != session:
                    session, known, verdicts = s, [], []
                own = set(w)
                score, best = max(((len(own & t) / min(len(own), len(t)) if own and t else 0.0, k) for k, t in enumerate(known)), default=(0.0, -1))
                if best >= 0 and score >= threshold:
                    task, how = best, "description"
                elif known and (kind == "reviewer" or verdicts[-1] == "changes"):
                    task, how = len(known) - 1, "time"
                else:
                    known.append(set())
                    verdicts.append(None)
                    task, how = len(known) - 1, "new" if kind == "builder" else "unlinked"
                if how != "time":
                    known[task] |= own
                if kind == "reviewer":
                    verdicts[task] = said
                out.append((s, run, kind, at, task, how, said))
            yield pd.DataFrame(out, columns=["session_id", "id", "type", "started_at", "task", "linked_by", "verdict"])

    return ordered.mapInPandas(link, "session_id string, id string, type string, started_at bigint, task bigint, linked_by string, verdict string")


def tasks(linked: DataFrame, rounds: int = 2) -> DataFrame:
    """Per task: runs of both kinds, rounds (its reviews), whether all runs are linked by words, how each was linked, and the runs beyond ``rounds``.

    The extra runs are ranked in a window over one task's runs of a kind.
    """
    ranked = linked.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "task", "type").orderBy("started_at", "id")))
    count = lambda c: F.count_if(c)
    per = ranked.groupBy("session_id", "task").agg(
        count(F.col("type") == "builder").alias("builders"),
        count(F.col("type") == "reviewer").alias("reviewers"),
        *[count(F.col("linked_by") == m).alias(f"by_{m}") for m in ("description", "new", "time", "unlinked")],
        *[count((F.col("type") == "reviewer") & (F.col("verdict") == v)).alias(v) for v in ("approve", "changes", "unclear")],
        F.array_sort(F.collect_list(F.when(F.col("n") > rounds, F.struct("type", "n", "id")))).alias("extra"),
    )
    return per.withColumns({"rounds": F.col("reviewers"), "all_linked": (F.col("by_time") == 0) & (F.col("by_unlinked") == 0), "extra_runs": F.transform("extra", lambda x: x["id"])}).drop("extra")


def tokens_by_kind(linked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Linked runs with the ``tokens`` (``session_id``, ``id``, ``tokens``) they have used, 0 where nothing is known of them."""
    return linked.join(tokens, ["session_id", "id"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def tokens_of(extra: DataFrame, tokens: DataFrame) -> DataFrame:
    """``session_id``, ``task``, ``tokens``: what the runs listed have used in all."""
    return tokens_by_kind(extra, tokens).groupBy("session_id", "task").agg(F.sum("tokens").alias("tokens"))


def rounds_histogram(per_task: DataFrame) -> DataFrame:
    return per_task.groupBy("rounds").agg(F.count(F.lit(1)).alias("tasks"), whole_median(F.col("builders")).alias("median_builders"))


def _events(call_log: DataFrame, test: str, more: dict[str, str]) -> DataFrame:
    """Lines that pass ``test``, one per uuid (else file and line), the first by file and line."""
    x = lines(call_log).where(test)
    key = F.coalesce(F.expr(_text("$.uuid")), F.concat_ws(":", "src", F.col("line").cast("string")))
    x = x.select(key.alias("key"), "profile", "session", "run", "us", "src", "line", "log_id", *[F.expr(e).alias(n) for n, e in more.items()])
    names = ["profile", "session", "run", "us", *more]
    return x.groupBy("key").agg(F.min_by(F.struct(*names), F.struct("src", "line", "log_id")).alias("r")).select("key", "r.*")


def compactions(call_log: DataFrame) -> DataFrame:
    """Boundaries at which a context was compacted: key, profile, session, run, us, trigger (auto, manual, unknown), tokens before and after."""
    meta = "$.compactMetadata"
    count = lambda k: f"CASE WHEN {_kind(f'{meta}.{k}')} = 'BIGINT' AND try_variant_get(v, '{meta}.{k}', 'bigint') >= 0 THEN try_variant_get(v, '{meta}.{k}', 'bigint') END"
    trigger = f"CASE WHEN {_text(meta + '.trigger')} IN ('auto', 'manual') THEN {_text(meta + '.trigger')} ELSE 'unknown' END"
    return _events(call_log, f"{_text('$.type')} = 'system' AND {_text('$.subtype')} = 'compact_boundary'", {"trigger": trigger, "pre_tokens": count("preTokens"), "post_tokens": count("postTokens")})


def in_order(events: DataFrame) -> DataFrame:
    """Events with their ``place`` by time, session and key, from 1.

    Days are numbered by themselves and the days before counted in, so that no task
    sorts more than a day.
    """
    x = events.withColumn("_day", F.expr("us div 86400000000"))
    days = x.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_day").orderBy("us", "session", "key"))
    return x.withColumn("_own", own).join(before, "_day").withColumn("place", F.col("_before") + F.col("_own")).drop("_day", "_own", "_before")


def limit_hits(call_log: DataFrame) -> DataFrame:
    """Lines that a limit cut off: written in place of an answer (model '<synthetic>') with the error 'rate_limit'."""
    return _events(call_log, f"{_text('$.type')} = 'assistant' AND {_text('$.message.model')} = '<synthetic>' AND {_text('$.error')} = 'rate_limit'", {})


def by_trigger(compacted: DataFrame) -> DataFrame:
    return compacted.where("us IS NOT NULL").groupBy("trigger").agg(F.count(F.lit(1)).alias("compactions"))


def within_sessions(events: DataFrame, kept: DataFrame) -> DataFrame:
    """Events of sessions that occur in ``kept``."""
    return events.join(kept.select("session").distinct(), "session", "left_semi")


def verdicts_of_runs(call_log: DataFrame, handback: str = "SubagentHandback") -> DataFrame:
    """``src``, ``verdict`` of each subagent's file: that of its last message handed back, else of its last text. The log is parsed once."""
    v = lines(call_log).where("sub")
    c = "try_variant_get(v, '$.message.content', 'variant')"
    parts = f"filter(transform({_elements(c)}, x -> try_cast(x AS {_BLOCK})), b -> b IS NOT NULL)"
    rows = v.select("src", "line", "log_id", "role", F.expr(parts).alias("parts"), F.expr(f"CASE WHEN schema_of_variant({c}) = 'STRING' THEN CAST({c} AS string) END").alias("whole"))
    handed = f"element_at(transform(filter(parts, b -> CAST(b['type'] AS string) = 'tool_use' AND CAST(b['name'] AS string) = '{handback}' AND schema_of_variant(try_variant_get(b['input'], '$.message', 'variant')) = 'STRING'), b -> try_variant_get(b['input'], '$.message', 'string')), -1)"
    told = "coalesce(whole, array_join(transform(filter(parts, b -> CAST(b['type'] AS string) = 'text' AND schema_of_variant(b['text']) = 'STRING'), b -> CAST(b['text'] AS string)), '\\n'))"
    own = F.col("role") == "assistant"
    rows = rows.withColumns({"blocks": F.size("parts"), "handed": F.when(own, F.expr(handed.replace("element_at(", "try_element_at(", 1))), "told": F.when(own, F.expr(told))})
    order = F.struct("line", "log_id")
    last = lambda x, test: F.max_by(x, F.when(test, order))
    per = rows.groupBy("src").agg(F.sum("blocks").alias("n"), last("handed", F.col("handed").isNotNull()).alias("handed"), last("told", F.col("told").rlike(r"(?U)\S")).alias("final"))
    return per.where("n > 0").select("src", verdict(F.coalesce("handed", "final", F.lit(""))).alias("verdict"))
