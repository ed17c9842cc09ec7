"""Outputs: canonical JSON, CSV, Markdown, TOML, annotations, manifests, trees of files.

Reports are small: what is collected here has the size of a report's table. Data of any
size is written by Spark's own writers.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import posixpath
import uuid
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import annotation_property, annotation_text, markdown_cell
from ..operators.quality import GateError
from ..session import ship


def _plain(x: Any) -> Any:
    if isinstance(x, Decimal):
        return str(x)
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    raise TypeError(type(x).__name__)


def canonical_json(x: Any) -> str:
    """Sorted keys, one space of indent, decimals as texts, times in ISO form."""
    return json.dumps(x, indent=1, sort_keys=True, ensure_ascii=False, default=_plain) + "\n"


def csv_text(table: DataFrame) -> str:
    """A report's table in its order, with a header, lines ended by LF."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(table.columns)
    w.writerows(["" if v is None else v for v in row] for row in table.toLocalIterator())
    return out.getvalue()


def csv_line(columns: list[str]) -> Column:
    """A row as a line of CSV, for tables of any size; null is empty, quotes are doubled."""
    return F.to_csv(F.struct(*columns), {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})


def markdown_row(columns: list[str]) -> Column:
    """A row as one of a Markdown table, for tables of any size."""
    cells = [F.coalesce(markdown_cell(F.col(c).cast("string")), F.lit("")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_table(table: DataFrame) -> str:
    clean = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    rows = [table.columns, ["---"] * len(table.columns), *([clean(v) for v in r] for r in table.toLocalIterator())]
    return "".join("| " + " | ".join(r) + " |\n" for r in rows)


def report(title: str, sections: dict[str, DataFrame]) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(t)}" for name, t in sections.items())


def toml_text(x: dict[str, Any], prefix: str = "") -> str:
    """Scalars and lists first, then tables, then arrays of tables."""

    def value(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (date, datetime)):
            return v.isoformat()
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        if isinstance(v, dict):
            return "{" + ", ".join(f"{key(k)} = {value(w)}" for k, w in v.items()) + "}"
        raise TypeError(type(v).__name__)

    key = lambda k: k if k and all(c.isalnum() and c.isascii() or c in "_-" for c in k) else json.dumps(k)
    tables = {k: v for k, v in x.items() if isinstance(v, dict)}
    arrays = {k: v for k, v in x.items() if isinstance(v, list) and v and all(isinstance(i, dict) for i in v)}
    out = "".join(f"{key(k)} = {value(v)}\n" for k, v in x.items() if k not in tables and k not in arrays)
    for k, v in tables.items():
        out += f"\n[{prefix}{key(k)}]\n" + toml_text(v, f"{prefix}{key(k)}.")
    for k, v in arrays.items():
        out += "".join(f"\n[[{prefix}{key(k)}]]\n" + toml_text(i, f"{prefix}{key(k)}.") for i in v)
    return out


def annotation(severity: Column, path: Column, line: Column, title: Column, message: Column) -> Column:
    """A workflow's annotation of a finding, special characters escaped."""
    where = F.concat(F.lit("file="), annotation_property(path), F.coalesce(F.concat(F.lit(",line="), line.cast("string")), F.lit("")), F.lit(",title="), annotation_property(title))
    return F.concat(F.lit("::"), severity, F.lit(" "), where, F.lit("::"), annotation_text(message))


def exit_code(found: DataFrame) -> int:
    """1 if an error is reported, else 0."""
    return 0 if found.where("severity = 'error' AND status = 'reported'").isEmpty() else 1


def write_outputs(folder: str, files: dict[str, str], facts: dict[str, Any]) -> dict[str, Any]:
    """Writes the files and a manifest with their hashes, reads all back, and removes the manifest if anything differs."""
    if "reconciliation" not in facts:
        raise GateError("the manifest has no reconciliation", 3)
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        Path(folder, name).write_text(text, encoding="utf-8")
    manifest = {**facts, "sha256": {n: hashlib.sha256(t.encode()).hexdigest() for n, t in files.items()}}
    at = Path(folder, "manifest.json")
    at.write_text(canonical_json(manifest), encoding="utf-8")
    back = json.loads(at.read_text(encoding="utf-8"))
    if any(hashlib.sha256(Path(folder, n).read_bytes()).hexdigest() != h for n, h in back["sha256"].items()):
        at.unlink()
        raise GateError("an output isn't what was written", 3)
    return manifest


def export_tree(entries: DataFrame, folder: str) -> int:
    """Writes the files of ``entries`` below ``folder``, which appears only when all are there; no path may lead outside.

    ``folder`` is a path or the address of a file system that all executors reach. Each
    task writes its own files into a folder beside it, which takes its name at the end;
    a task that is run again writes the same files again.
    """
    ship(entries.sparkSession)
    files, target = _file_system(folder)
    made = f"{target.rstrip('/')}.{uuid.uuid4().hex[:12]}.part"
    address = folder

    def write(batches):
        at, _ = _file_system(address)
        for batch in batches:
            for path, data in zip(batch["path"], batch["data"], strict=True):
                full = posixpath.normpath(posixpath.join(made, path))
                if path.startswith("/") or not full.startswith(made + "/"):
                    raise GateError(f"{path} leads outside", 2)
                at.create_dir(posixpath.dirname(full), recursive=True)
                with at.open_output_stream(full) as out:
                    out.write(bytes(data))
            yield pd.DataFrame({"n": [len(batch)]})

    try:
        files.create_dir(made, recursive=True)
        written = entries.where("kind = 'file' AND data IS NOT NULL").select("path", "data").mapInPandas(write, "n bigint")
        n = written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        files.move(made, target)
    except BaseException as e:
        files.delete_dir(made)
        if "GateError" in str(e):
            raise GateError("a path leads outside", 2) from e
        raise
    return n


def _file_system(folder: str):
    """The file system of an address or a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def uncovered(planted: DataFrame, found: DataFrame) -> DataFrame:
    """What was planted and not found: the self-test of a scanner."""
    return planted.distinct().join(found, planted.columns, "left_anti")


