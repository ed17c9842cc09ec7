"""Problem 5: deeply nested semi-structured records into related flat tables.

A line is parsed once into a VARIANT. Nested ``transform`` calls walk down the content,
attaching to each block its position path and that of its parent; ``flatten`` joins a
level's arrays, and a single ``inline`` emits the rows of all levels. A pass goes
``LEVELS`` deep; whatever content lies still deeper is carried as JSON into another pass
until none is left, so no depth is cut off. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

LEVELS = 8
_BLOCK = "map<string,variant>"


def _elements(content: str) -> str:
    """SQL: the elements of a content value, a lone object being one."""
    return f"coalesce(try_cast({content} AS array<variant>), CASE WHEN try_cast({content} AS {_BLOCK}) IS NOT NULL THEN array({content}) END, CAST(array() AS array<variant>))"


def _level(parents: str | None, content: str) -> str:
    """SQL: the blocks of one level as an array of (path, parent_path, block)."""
    if parents is None:
        inner = f"transform({_elements(content)}, (x, i) -> struct(concat(base, CASE WHEN base = '' THEN '' ELSE '/' END, i) AS path, base AS parent_path, try_cast(x AS {_BLOCK}) AS block))"
    else:
        inner = f"flatten(transform({parents}, p -> transform({_elements("p.block['content']")}, (x, i) -> struct(concat(p.path, '/', i) AS path, p.path AS parent_path, try_cast(x AS {_BLOCK}) AS block))))"
    return f"filter({inner}, x -> x.block IS NOT NULL)"


def _pass(df: DataFrame) -> DataFrame:
    """From (log_id, base, content) to the rows of ``LEVELS`` levels; ``deeper`` holds what the last one still contains."""
    df = df.withColumn("l0", F.expr(_level(None, "content")))
    for k in range(1, LEVELS):
        df = df.withColumn(f"l{k}", F.expr(_level(f"l{k - 1}", "")))
    text = lambda f: f"CASE WHEN schema_of_variant(x.block['{f}']) = 'STRING' THEN CAST(x.block['{f}'] AS string) END AS {f}"
    row = lambda deeper: f"struct(x.path AS path, x.parent_path AS enclosing, {text('type')}, {text('id')}, {text('tool_use_id')}, {text('name')}, {deeper} AS deeper)"
    rest = f"CASE WHEN size({_elements("x.block['content']")}) > 0 THEN to_json(x.block['content']) END"
    arrays = [f"transform(l{k}, x -> {row('CAST(NULL AS string)')})" for k in range(LEVELS - 1)] + [f"transform(l{LEVELS - 1}, x -> {row(rest)})"]
    return df.selectExpr("log_id", f"inline(concat({', '.join(arrays)}))")


def parsed_lines(call_log: DataFrame) -> DataFrame:
    """``call_log`` with ``v``, the parsed line, where it is an object; blank, broken and other lines are dropped."""
    return call_log.withColumn("v", F.expr("try_parse_json(json)")).where("schema_of_variant(v) LIKE 'OBJECT%'")


class Blocks:
    """The blocks of all lines, written once: ``log_id, path, enclosing, type, id, tool_use_id, name``."""

    def __init__(self, spark: SparkSession, call_log: DataFrame):
        scratch = Scratch(spark, "blocks")
        content = call_log.selectExpr("log_id", "try_variant_get(try_parse_json(json), '$.message.content', 'variant') AS content", "'' AS base").where("log_id IS NOT NULL AND content IS NOT NULL")
        parts = []
        while True:
            done = scratch.table(_pass(content), "pass").df
            parts.append(done.drop("deeper"))
            left = done.where("deeper IS NOT NULL")
            if left.isEmpty():
                break
            content = left.selectExpr("log_id", "path AS base", "parse_json(deeper) AS content")
        self.rows = parts[0]
        for p in parts[1:]:
            self.rows = self.rows.unionByName(p)

    def linked(self) -> DataFrame:
        """Each block with ``parent_log_id`` and ``parent_path``.

        A tool_result belongs to the tool_use whose id it names, of the line with the
        smallest ``log_id`` and there the first position; any other block, and a result
        whose tool use is nowhere, to the enclosing block of its own line ('' at the top).
        """
        b = self.rows
        uses = b.where("type = 'tool_use' AND id IS NOT NULL").select("id", "log_id", "path", F.expr("transform(split(path, '/'), x -> CAST(x AS int))").alias("position"))
        first = uses.groupBy("id").agg(F.min(F.struct("log_id", "position", "path")).alias("u"))
        first = first.select(F.col("id").alias("tool_use_id"), F.col("u.log_id").alias("use_log_id"), F.col("u.path").alias("use_path"))
        results = b.where("type = 'tool_result' AND tool_use_id IS NOT NULL").join(first, "tool_use_id", "left")
        others = b.where("type IS NULL OR type <> 'tool_result' OR tool_use_id IS NULL").select("*", F.lit(None).cast("bigint").alias("use_log_id"), F.lit(None).cast("string").alias("use_path"))
        rows = results.unionByName(others)
        return rows.select("log_id", "path", "type", "id", "tool_use_id", "name", F.coalesce("use_log_id", "log_id").alias("parent_log_id"), F.coalesce("use_path", "enclosing").alias("parent_path"))


def _text(path: str, name: str) -> str:
    return f"CASE WHEN schema_of_variant(try_variant_get(v, '{path}', 'variant')) = 'STRING' THEN try_variant_get(v, '{path}', 'string') END AS {name}"


def flat_lines(call_log: DataFrame) -> DataFrame:
    """One row per parsable object line; fields of another type than text are null."""
    return parsed_lines(call_log).selectExpr("log_id", "src", "line", _text("$.type", "type"), _text("$.timestamp", "ts"), _text("$.sessionId", "session_id"), _text("$.uuid", "uuid"), _text("$.requestId", "request_id"), _text("$.message.id", "message_id"), _text("$.message.role", "role"), _text("$.message.model", "model"))


def flat_usage(call_log: DataFrame) -> DataFrame:
    """One row per count within ``message.usage``, at any of its two levels: ``log_id``, ``parent_path``, ``field``, ``tokens``; only whole numbers are counts."""
    usage = call_log.selectExpr("log_id", f"try_variant_get(try_parse_json(json), '$.message.usage', '{_BLOCK}') AS u").where("u IS NOT NULL")
    top = "transform(map_entries(u), e -> struct('' AS parent_path, e.key AS field, e.value AS x))"
    below = f"flatten(transform(map_entries(map_filter(u, (k, x) -> try_cast(x AS {_BLOCK}) IS NOT NULL)), p -> transform(map_entries(try_cast(p.value AS {_BLOCK})), e -> struct(p.key AS parent_path, e.key AS field, e.value AS x))))"
    rows = usage.selectExpr("log_id", f"inline(concat({top}, {below}))")
    return rows.where("schema_of_variant(x) = 'BIGINT'").selectExpr("log_id", "parent_path", "field", "CAST(x AS bigint) AS tokens")
