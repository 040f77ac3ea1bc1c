"""Tables that cut lineage, kept in the shared folder the cluster names.

A long chain of joins is split by writing the rows so far as parquet and going
on from the files.  An executor lost later costs a re-read, not a re-run of
the chain, and the files are columnar, so later reads fetch only the columns
they use.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A session without that setting uses its warehouse folder, which every
    session names and which executors must share anyway to write tables.
    Several machines can't share a ``file:`` folder by themselves; a warehouse
    that is one is refused unless the master is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and folder.startswith(("file:", "/")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_end(application: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == application:
        _delete(spark, _ROOTS[application])


def application_root(spark: SparkSession) -> str:
    """One folder per application, deleted when the program ends."""
    application = spark.sparkContext.applicationId
    if application not in _ROOTS:
        _ROOTS[application] = f"{shared_folder(spark)}/meander-{application}-{uuid.uuid4().hex[:8]}"
        atexit.register(_at_end, application)
    return _ROOTS[application]


class Scratch:
    """A folder of intermediate tables, dropped by ``close`` or else with the application."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.root = f"{(folder or application_root(spark)).rstrip('/')}/{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        """A fresh path below this folder."""
        self._count += 1
        return f"{self.root}/{self._count:04d}-{name}"

    def cut(self, df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
        """Write ``df`` and return a table that reads the files."""
        path = self.path(name)
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut_by(self, df: DataFrame, key: str, name: str = "table", compression: str = "snappy") -> DataFrame:
        """Like ``cut``, in buckets of ``key``: joins by it read them in place, and rows that lie so already aren't moved.

        All rows of a key are written by one task, so ``key`` must not have hot values.
        """
        path, buckets = self.path(name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        known = "meander_cut_" + hashlib.md5(path.encode()).hexdigest()
        (df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").option("compression", compression)
         .option("path", path).saveAsTable(known))
        table = self.spark.table(known)
        self.spark.sql(f"DROP TABLE {known}")  # the files of a table with a path stay
        return table

    def text(self, lines: DataFrame, name: str = "lines") -> str:
        """Write a one-column table as text and return its path."""
        path = self.path(name)
        lines.write.text(path)
        return path

    def close(self) -> None:
        """Delete the folder; tables returned by ``cut`` can't be read after that."""
        _delete(self.spark, self.root)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.close()
