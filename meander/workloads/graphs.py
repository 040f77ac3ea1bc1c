"""Graphs with vertex features over the supplied tables, as edges and feature tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meander.operators import adjacency as A, index as I, padding as P
from meander.scratch import Scratch


@dataclass(frozen=True)
class Graph:
    """Weighted edges (weight = source rows per pair) and the features of both vertex types."""

    edges: DataFrame
    feat1: DataFrame
    feat2: DataFrame

    def padded(self, weighted: bool = True, scratch: Scratch | None = None, written: bool = False) -> DataFrame:
        edges = self.edges if weighted else self.edges.withColumn("weight", F.lit(1.0))
        return P.pad_edges(edges, self.feat1, self.feat2, scratch, written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _token(*parts) -> Column:
    return F.regexp_replace(F.concat_ws("_", *[F.col(p).cast("string") for p in parts]), r"\s", "_")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _named("c", "c_custkey").alias("node"), _token("c_mktsegment", "c_nationkey").alias("feat"))


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _named("p", "p_partkey").alias("node"), _token("p_brand", "p_size").alias("feat"))


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        _named("s", "s_suppkey").alias("node"), _token("s_nationkey").alias("feat"))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                    "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                                   "o_custkey")
    return lines.join(orders, "l_orderkey")


def customer_part(spark: SparkSession, sf_dir: str) -> Graph:
    pairs = _sales(spark, sf_dir).select(
        _named("c", "o_custkey").alias("src"), _named("p", "l_partkey").alias("dst"))
    return Graph(_counted(pairs), customer_features(spark, sf_dir), part_features(spark, sf_dir))


def supplier_part(spark: SparkSession, sf_dir: str) -> Graph:
    pairs = table(spark, sf_dir, "lineitem").select(
        _named("s", "l_suppkey").alias("src"), _named("p", "l_partkey").alias("dst"))
    return Graph(_counted(pairs), supplier_features(spark, sf_dir), part_features(spark, sf_dir))


def user_key(spark: SparkSession, sf_dir: str) -> Graph:
    events = table(spark, sf_dir, "events").select(
        _named("u", "user_id").alias("src"), "event_type",
        F.get_json_object("props", "$.k").alias("key"))
    pairs = events.where("key is not null").select("src", F.concat(F.lit("k"), "key").alias("dst"))
    # Counted before ranking: a user has as many rows here as there are event types.
    counts = events.groupBy("src", "event_type").count()
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), "event_type"))
    users = (counts.withColumn("rank", first).where("rank = 1")
             .select(F.col("src").alias("node"), _token("event_type").alias("feat")))
    keys = pairs.select(F.col("dst").alias("node"), F.substring("dst", 2, 100).alias("feat")).distinct()
    return Graph(_counted(pairs), users, keys)


def tripartite(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer, part and supplier of each line, all linked: a graph with triangles."""
    def pair(a, b):
        return F.struct(a.alias("src"), b.alias("dst"))
    c, p, s = _named("c", "o_custkey"), _named("p", "l_partkey"), _named("s", "l_suppkey")
    pairs = _sales(spark, sf_dir).select(F.inline(F.array(pair(c, p), pair(p, s), pair(c, s))))
    feats = (customer_features(spark, sf_dir).unionByName(part_features(spark, sf_dir))
             .unionByName(supplier_features(spark, sf_dir)))
    return Graph(_counted(pairs), feats, feats)


GRAPHS = {"customer_part": customer_part, "supplier_part": supplier_part,
          "user_key": user_key, "tripartite": tripartite}


@dataclass(frozen=True)
class Indexed:
    """A graph by id, with its names."""

    padded: DataFrame
    node2id: DataFrame
    edges: DataFrame
    scratch: Scratch

    def adjacency(self, degree: int, directed: bool = False, weighted: bool = True) -> DataFrame:
        return A.adjacency(self.scratch.cut(self.edges, "edges", "zstd"), degree, directed, weighted)


def indexed(spark: SparkSession, sf_dir: str, name: str, scratch: Scratch,
            weighted: bool = True) -> Indexed:
    padded = GRAPHS[name](spark, sf_dir).padded(weighted, scratch, written=True)
    ids = scratch.cut(I.node_index(padded, scratch), "node2id")
    return Indexed(padded, ids, I.index_edges(padded, ids), scratch)
