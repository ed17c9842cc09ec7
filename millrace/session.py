"""Session helpers: the shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local does the session get a
    temporary folder of its own, which is removed when Python ends.
    """
    named = spark.conf.get(_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_KEY} must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="millrace-")
    _own_dirs.append(path)
    spark.conf.set(_KEY, f"file://{path}")
    return f"file://{path}"


@atexit.register
def _clean() -> None:
    for path in _own_dirs:
        shutil.rmtree(path, ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers of all executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    _own_dirs.append(str(archive.parent))
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._millrace_shipped = True


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_root(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the application ends."""
    root = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"
    path, files = _path(spark, root)
    files.mkdirs(path)
    files.deleteOnExit(path)
    sc = spark.sparkContext
    sc._millrace_roots = [*getattr(sc, "_millrace_roots", []), root]
    return root


def cleared(spark: SparkSession) -> None:
    """Removes all that operators have written to the shared folder so far; results not yet read become unreadable."""
    for root in getattr(spark.sparkContext, "_millrace_roots", []):
        path, files = _path(spark, root)
        files.delete(path, True)
    spark.sparkContext._millrace_roots = []


class Scratch:
    """Tables written once in the shared folder and read again.

    A written table cuts the lineage, survives the loss of executors and gives the
    optimizer its true size for the choice of join. ``drop`` removes tables that a
    later round has superseded; what a returned DataFrame still reads stays until the
    application ends, or until ``cleared`` is called in one that goes on.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_root(spark, name)
        self._n = 0

    def table(self, df: DataFrame, label: str) -> "Table":
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.parquet(path)
        return Table(self.spark, path, df.schema)

    def drop(self, *tables: "Table | None") -> None:
        for t in tables:
            if t is not None:
                path, files = _path(self.spark, t.path)
                files.delete(path, True)


class Table:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.path = path
        self.df = spark.read.schema(schema).parquet(path)

    def count(self) -> int:
        return self.df.count()


def fanout(spark: SparkSession, least: int = 8) -> int:
    """Number of salts for hot groups: that of the shuffle partitions of this cluster."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
