"""Files of a working tree and of a git revision as ``entries``: path, kind, size, data, link_target, escapes.

A listing is made on the driver (names only); the contents are read by the tasks, a
chunk of files each. Both are Python data sources.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.patterns import MAX_FILE
from ..session import ship

SCHEMA = "path string, kind string, size bigint, data binary, link_target string, escapes boolean"
CHUNK = 256
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("link_target", pa.string()), ("escapes", pa.bool_())])


def git(root: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, check=True).stdout


def tree(root: str, revision: str) -> list[tuple[str, str, str, int, str]]:
    """(mode, type, object, size, path) of all entries of a revision."""
    out = []
    for row in git(root, "ls-tree", "-r", "-z", "-l", "--full-tree", revision).decode("utf-8", "surrogateescape").split("\0"):
        if row:
            head, path = row.split("\t", 1)
            mode, kind, sha, size = head.split()
            out.append((mode, kind, sha, int(size) if size != "-" else 0, path))
    return out


def changed(root: str, base: str, head: str) -> list[str]:
    """Paths that ``head`` adds, copies, changes or retypes since it left ``base``, renames counted as additions."""
    out = git(root, "diff", "--name-only", "-z", "--no-renames", "--diff-filter=ACMRT", f"{base}...{head}")
    return sorted(set(filter(None, out.decode("utf-8", "surrogateescape").split("\0"))))


def listed(root: str) -> list[str]:
    """Tracked and untracked files of a working tree, without ignored ones; of a folder outside git all files."""
    try:
        out = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode("utf-8", "surrogateescape")
        return sorted(set(filter(None, out.split("\0"))) | set(gitlinks(root)))
    except (subprocess.CalledProcessError, OSError):
        return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def gitlinks(root: str) -> list[str]:
    try:
        rows = git(root, "ls-files", "-z", "--stage").decode("utf-8", "surrogateescape").split("\0")
    except (subprocess.CalledProcessError, OSError):
        return []
    return sorted(r.split("\t", 1)[1] for r in rows if r.startswith("160000 "))


def blobs(root: str, shas: list[str]) -> dict[str, bytes]:
    """The contents of objects, by one batch process; equal objects are read once."""
    wanted = list(dict.fromkeys(shas))
    raw, at, out = git(root, "cat-file", "--batch", data="".join(f"{s}\n" for s in wanted).encode()), 0, {}
    for sha in wanted:
        end = raw.index(b"\n", at)
        head = raw[at:end].split()
        if head[-1] == b"missing":
            at = end + 1
            continue
        size = int(head[2])
        out[sha] = raw[end + 1 : end + 1 + size]
        at = end + 2 + size
    return out


class _Chunk(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(len(rows))
        self.rows = rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _WorkingTree(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.paths = options["paths"].split("\0") if options.get("paths") else None

    def partitions(self) -> list[InputPartition]:
        links = set(gitlinks(self.root))
        rows = [(p, p in links) for p in (self.paths if self.paths is not None else listed(self.root))]
        return [_Chunk(rows[k : k + CHUNK]) for k in range(0, len(rows), CHUNK)] or [_Chunk([])]

    def read(self, part: _Chunk) -> Iterator[pa.RecordBatch]:
        top = os.path.realpath(self.root)
        for path, is_gitlink in part.rows:
            full = os.path.join(self.root, path)
            if is_gitlink:
                yield _batch([(path, "gitlink", 0, None, None, None)])
            elif os.path.islink(full):
                target = os.readlink(full)
                real = os.path.realpath(full)
                outside = os.path.isabs(target) or not (real == top or real.startswith(top + os.sep))
                yield _batch([(path, "symlink", 0, None, target, outside)])
            elif os.path.isfile(full):
                size = os.path.getsize(full)
                data = None
                if size <= MAX_FILE:
                    with open(full, "rb") as f:
                        data = f.read()
                yield _batch([(path, "file", size, data, None, None)])


class _Revision(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.revision = options["root"], options.get("revision", "HEAD")
        self.paths = set(options["paths"].split("\0")) if options.get("paths") else None

    def pushFilters(self, filters):
        """An equality on ``path`` is applied to the listing, before any content is read."""
        from pyspark.sql.datasource import EqualTo

        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = {f.value} if self.paths is None else self.paths & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        rows = [r for r in tree(self.root, self.revision) if self.paths is None or r[4] in self.paths]
        return [_Chunk(rows[k : k + CHUNK]) for k in range(0, len(rows), CHUNK)] or [_Chunk([])]

    def read(self, part: _Chunk) -> Iterator[pa.RecordBatch]:
        wanted = [sha for mode, kind, sha, size, _ in part.rows if kind == "blob" and (size <= MAX_FILE or mode == "120000")]
        data = blobs(self.root, wanted) if wanted else {}
        for mode, kind, sha, size, path in part.rows:
            if kind == "commit":
                row = (path, "gitlink", 0, None, None, None)
            elif mode == "120000":
                row = (path, "symlink", size, None, data[sha].decode("utf-8", "replace"), None)
            else:
                row = (path, "file", size, data.get(sha), None, None)
            yield _batch([row])


class WorkingTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "working_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WorkingTree(self.options)


class Revision(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_revision"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Revision(self.options)


def read_working_tree(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(WorkingTree)
    reader = spark.read.format("working_tree").option("root", root)
    return (reader.option("paths", "\0".join(paths)) if paths is not None else reader).load()


def read_revision(spark: SparkSession, root: str, revision: str = "HEAD", paths: list[str] | None = None) -> DataFrame:
    """The entries of a revision; with ``paths`` (as of ``changed``) only those, others aren't fetched."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Revision)
    reader = spark.read.format("git_revision").option("root", root).option("revision", revision)
    return (reader.option("paths", "\0".join(paths)) if paths is not None else reader).load()
