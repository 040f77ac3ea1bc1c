"""Neighbour lists kept as a bucketed table, for later walks and other sessions.

The table is bucketed and sorted by vertex, one file for each bucket, so joins and
sums by vertex read it in place: neither a walk's layout nor the tags of hops
shuffle it again.  Beside the files stands a table that tells the buckets, so that
a session that knows the path only can open it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from meander.schemas import TABLES, expect


@dataclass(frozen=True)
class Lists:
    """Neighbour lists in ``buckets`` buckets of their vertex."""
    table: DataFrame
    buckets: int


def save_lists(adj: DataFrame, path: str, buckets: int | None = None) -> Lists:
    """Write the lists to ``path``, an absolute path or URI, which must be free."""
    lists = _write(adj, path, buckets)
    adj.sparkSession.range(1).selectExpr(f"{lists.buckets} AS buckets").write.parquet(_about(path))
    return lists


def hold_lists(adj: DataFrame, path: str, buckets: int | None = None) -> Lists:
    """Lists for this run only: written in buckets too, but the catalog doesn't keep their name.

    Lists that have just been gathered by vertex in as many partitions aren't moved again.
    """
    lists = _write(adj, path, buckets)
    adj.sparkSession.sql(f"DROP TABLE {_name(path)}")  # the files of a table with a path stay
    return lists


def _write(adj: DataFrame, path: str, buckets: int | None) -> Lists:
    spark = adj.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (expect(adj, "adj").repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id")
     .format("parquet").option("path", path).saveAsTable(_name(path)))
    return Lists(spark.table(_name(path)), buckets)


def open_lists(spark: SparkSession, path: str) -> Lists:
    """Lists that this or another session has saved."""
    buckets = spark.read.parquet(_about(path)).first()["buckets"]
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(path)} ({TABLES['adj']}) USING parquet "
              f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{location}'")
    return Lists(spark.table(_name(path)), buckets)


def _name(path: str) -> str:
    return "meander_lists_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _about(path: str) -> str:
    return path.rstrip("/") + ".about"
