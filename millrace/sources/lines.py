"""A data source of numbered lines of text files: ``spark.read.format("numbered_lines")``.

Spark's text source has no line numbers, and reading a file as a single row to number
them would hold it in memory. Here a file is a partition, read as a stream; a line ends
with LF, CR or both, is numbered from 1 and decoded as UTF-8 with replacements. Files
that can't be read give one row with ``error``, so that they are counted, not fatal.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

SCHEMA = "profile string, src string, line int, json string, error string"
_BATCH = 4096


class _File(InputPartition):
    def __init__(self, profile: str, path: str):
        super().__init__((profile, path))
        self.profile, self.path = profile, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [x.split("=", 1) for x in options["roots"].split("\n") if x]
        self.suffix = options.get("suffix", ".jsonl")

    def partitions(self) -> list[InputPartition]:
        found = []
        for profile, root in self.roots:
            paths = [p for p in Path(root).rglob(f"*{self.suffix}")]
            found += [_File(profile, str(p)) for p in sorted(paths, key=lambda p: p.parts)]
        return found or [_File("", "")]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("profile", pa.string()), ("src", pa.string()), ("line", pa.int32()), ("json", pa.string()), ("error", pa.string())])
        if not part.path:
            return
        rows: list[tuple] = []
        try:
            if not os.path.isfile(part.path):
                raise OSError("not a regular file")
            with open(part.path, "rb") as raw:
                for n, text in enumerate(io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline=None), 1):
                    rows.append((part.profile, part.path, n, text.rstrip("\n"), None))
                    if len(rows) >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
        except OSError as e:
            rows.append((part.profile, part.path, None, None, str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class NumberedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_lines(spark: SparkSession, roots: dict[str, str], suffix: str = ".jsonl") -> DataFrame:
    """Lines of all files below the roots (profile -> folder), files in the order of their path's components."""
    ship(spark)
    spark.dataSource.register(NumberedLines)
    return spark.read.format("numbered_lines").option("roots", "\n".join(f"{k}={v}" for k, v in roots.items())).option("suffix", suffix).load()


def with_path_columns(lines: DataFrame) -> DataFrame:
    """Adds ``in_sub_dir``, ``run_id`` and ``parent_session``, which the path tells."""
    parts = F.split("src", "/")
    in_sub = F.coalesce(F.try_element_at(parts, F.lit(-2)) == "subagents", F.lit(False))
    return lines.withColumns({"in_sub_dir": in_sub, "run_id": F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[^.]*$", ""), "parent_session": F.when(in_sub, F.try_element_at(parts, F.lit(-3)))})


def sidecars(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """``src`` of a log, ``agent_type``, ``description``, ``state`` (read or unreadable) of the ``.meta.json`` beside it."""
    text = read_lines(spark, roots, ".meta.json").groupBy("src").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line", "json"))), lambda x: x["json"])).alias("text"))
    v = F.expr("try_parse_json(text)")
    pick = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')")
    x = text.withColumn("v", v)
    return x.select(F.regexp_replace("src", r"\.meta\.json$", ".jsonl").alias("src"), pick("agentType").alias("agent_type"), pick("description").alias("description"), F.when(F.col("v").isNull(), "unreadable").otherwise("read").alias("state"))


def with_sidecars(lines: DataFrame, meta: DataFrame) -> DataFrame:
    return lines.join(meta, "src", "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def split_lines(spark: SparkSession, roots: dict[str, str], suffix: str = ".jsonl") -> DataFrame:
    """``profile``, ``src``, ``line``, ``json`` of all lines below folders of any file system that Spark can read.

    Spark lists the folders and splits great files by bytes, so that none is one task's
    work. Lines are numbered within each split, in its order, and the lines of the splits
    before are added: windows hold no more than a split, or a row per split. Line ends
    are LF, CR LF or CR; bytes that aren't UTF-8 become U+FFFD. Unreadable files fail the
    read, unlike in ``read_lines``.
    """
    parts = []
    for profile, root in roots.items():
        texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root)
        parts.append(texts.select(F.lit(profile).alias("profile"), F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), F.make_valid_utf8("value").alias("json")))
    rows = reduce(DataFrame.unionByName, parts)
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy("profile", "src", "_split").orderBy("_at")))
    counts = rows.groupBy("profile", "src", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("profile", "src").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return own.join(before, ["profile", "src", "_split"]).select("profile", "src", (F.col("_before") + F.col("_own")).alias("line"), "json")
