"""The reports: usage in full, and the summary of a scan. Each section is a small table; what is long is cut at a stated number of rows with a note of how many more there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import content, findings, quality, usage
from .outputs import markdown_table

ROWS = 20


def _section(title: str, table: DataFrame, rows: int | None = None) -> str:
    """A heading and a table; of more than ``rows`` rows the first, in the table's order, and the number of the others."""
    if rows is None:
        return f"## {title}\n\n{markdown_table(table)}\n"
    n = table.count()
    more = f"\n{n - rows} more rows\n" if n > rows else ""
    return f"## {title}\n\n{markdown_table(table.limit(rows))}{more}\n"


def full_report(calls: DataFrame, call_log: DataFrame, weights: DataFrame, changes: DataFrame, end: str, days: int, rows: int = ROWS) -> str:
    """The usage report in Markdown: totals and their reconciliation, weeks, sessions, caches, tools, runs, events, comparisons around changes, findings, checks."""
    raw = usage.usage(calls)
    kept = usage.deduplicated(raw)
    blocks = content.blocks(call_log)
    compacted, hits = content.compactions(call_log), content.limit_hits(call_log)
    event = lambda df, what, trigger: df.where("us IS NOT NULL").select("session", F.lit(what).alias("what"), trigger.alias("trigger"), F.timestamp_micros("us").alias("at"))
    events = event(compacted, "compaction", F.col("trigger")).unionByName(event(hits, "limit", F.lit(None).cast("string")))
    weekly = usage.weekly(kept)
    found = findings.of_usage(kept, weights).unionByName(findings.of_events(hits, content.verdicts_of_runs(call_log), compacted))
    by_week = weekly.orderBy(F.col("week").isNull(), "week", F.col("level") != "group", F.desc(sum(F.col(m) for m in usage.MEASURES)), "model", "effort")
    sections = [
        _section("Totals", usage.core(kept)),
        _section("Reconciliation", usage.reconciliation(raw, kept).orderBy("measure")),
        _section("Weeks", by_week, rows),
        _section("Weeks cut by the data", usage.partial_weeks(kept).orderBy("week"), rows),
        _section("Weights by week", usage.weekly_weights(kept, weights).where("level <> 'group'").orderBy(F.col("week").isNull(), "week"), rows),
        _section("By kind", usage.weekly_by_kind(kept).orderBy("week", "kind"), rows),
        _section("Sessions by peak", usage.sessions(kept).orderBy(F.desc("peak_ctx"), "stream"), rows),
        _section("Peaks", usage.peak_buckets(kept)),
        _section("Start of sessions", usage.start_context(kept).orderBy("profile"), rows),
        _section("Cache rewrites", usage.cache_rewrites(kept).orderBy("kind", "bucket")),
        _section("Subagent runs", usage.runs(kept).orderBy(F.desc("tokens"), "stream"), rows),
        _section("Tools", content.results_by_tool(blocks).orderBy(F.desc("chars"), "tool"), rows),
        _section("Large results", content.large_results(blocks).orderBy("tool"), rows),
        _section("Repeated reads", content.repeated_reads(blocks).orderBy(F.desc("reads"), F.desc("extra_chars"), "src", "file_path"), rows),
        _section("Compactions", content.in_order(compacted.where("us IS NOT NULL")).orderBy("place").select("place", "session", "trigger", "pre_tokens", "post_tokens"), rows),
        _section("Limits", content.in_order(hits.where("us IS NOT NULL")).orderBy("place").select("place", "session"), rows),
        _section("Before and after", usage.compared(kept, changes, end, events, weights).orderBy("date", "scope", "metric"), rows * 5),
        _section("Findings", findings.ranked(found, days)),
        _section("Lines that drifted", quality.drift_share(content.line_drift(call_log))),
    ]
    return "# Usage\n\n" + "\n".join(sections)


def scan_summary(found: DataFrame, rows: int = ROWS) -> str:
    """The summary of a scan: how many findings of each severity and status, the reported ones by path, errors first."""
    counts = found.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("findings")).orderBy("severity", "status")
    reported = found.where("status = 'reported'").orderBy("severity", "path", F.col("line").isNotNull(), "line", "rule")
    waived = found.where("status = 'suppressed'").orderBy("path", "line", "rule").select("path", "line", "rule")
    sections = [_section("Counts", counts), _section("Findings", reported.select("severity", "rule", "path", "line", "detail"), rows), _section("Overridden beside the line, to be reviewed", waived, rows)]
    return "# Content scan\n\n" + "\n".join(sections)


def exit_code(found: DataFrame) -> int:
    """1 if an error is reported, else 0; one such row is looked for."""
    return int(not found.where("severity = 'error' AND status = 'reported'").limit(1).isEmpty())
