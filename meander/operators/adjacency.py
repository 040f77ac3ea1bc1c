"""Neighbour lists of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meander.operators.joins import attach, fits_broadcast, hot_keys
from meander.schemas import expect

# Up to this many, Spark itself cuts each key's rows before the shuffle of a
# row_number filter (spark.sql.optimizer.windowGroupLimitThreshold).
_SPARK_CUTS_UP_TO = 1000
_SLICES = 64


def neighbour_edges(indexed: DataFrame, directed: bool = False, weighted: bool = True) -> DataFrame:
    """One row per vertex and neighbour: the largest weight and the smallest feature.

    Undirected edges count for both ends.  Repeated edges, even a third of
    all rows on one pair, collapse in the map-side part of the aggregation.
    """
    return _merged(_ends(expect(indexed, "indexed_edges"), directed, weighted))


def _ends(indexed: DataFrame, directed: bool, weighted: bool) -> DataFrame:
    weight = F.col("weight") if weighted else F.lit(1.0).alias("weight")
    ends = [F.struct(F.col("src_id").alias("id"), F.col("dst_id").alias("nbr"), weight,
                     F.col("dst_feat").alias("feat"))]
    if not directed:
        ends.append(F.struct(F.col("dst_id").alias("id"), F.col("src_id").alias("nbr"), weight,
                             F.col("src_feat").alias("feat")))
    return indexed.select(F.inline(F.array(*ends)))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "nbr").agg(F.max("weight").alias("weight"), F.min("feat").alias("feat"))


def degree_cap(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` heaviest neighbours of each vertex; ties go to the lower id.

    Vertices with very many neighbours are cut in every map task, before their
    rows meet in one task.
    """
    heaviest = [F.col("weight").desc(), F.col("nbr").asc()]
    rows = expect(edges, "adj_edges")
    if degree > _SPARK_CUTS_UP_TO:
        slice_ = F.pmod(F.xxhash64("nbr"), F.lit(_SLICES))
        within = Window.partitionBy("id", slice_).orderBy(*heaviest)
        rows = rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= degree)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*heaviest))
    return (rows.withColumn("rank", rank).where(F.col("rank") <= degree)
            .select("id", "nbr", "weight", "feat"))


def gather(edges: DataFrame) -> DataFrame:
    """Rows of capped neighbours as one sorted list per vertex."""
    entry = F.struct("nbr", "weight", "feat")
    return (expect(edges, "adj_edges").groupBy("id")
            .agg(F.sort_array(F.collect_list(entry)).alias("nbrs")))


def adjacency(indexed: DataFrame, degree: int = 50, directed: bool = False,
              weighted: bool = True, hot: list | None = None) -> DataFrame:
    """The neighbour list of each vertex, by neighbour id, of at most ``degree`` entries.

    Rows of a vertex move to its task once, where copies collapse and the list is cut.
    Vertices with more than ``HOT_SHARE`` of the edges (``hot``, looked for if not given)
    collapse and are cut in every map task before, in two moves.  Hand over a written
    table, with edges that aren't repeated much: it is read for the look.
    """
    indexed = expect(indexed, "indexed_edges")
    ends = ["src_id"] if directed else ["src_id", "dst_id"]
    if hot is None:
        hot = [] if fits_broadcast(indexed) else sorted({k for keys in hot_keys(indexed, ends).values() for k in keys})
    rows = _ends(indexed, directed, weighted)
    is_hot = F.col("id").isin(hot)
    lists = gather(degree_cap(_merged((rows.where(~is_hot) if hot else rows).repartition("id")), degree))
    return lists.unionByName(gather(degree_cap(_merged(rows.where(is_hot)), degree))) if hot else lists


def adj_edges(adj: DataFrame) -> DataFrame:
    """Neighbour lists as rows."""
    return expect(adj, "adj").select("id", F.inline("nbrs"))


def triplets(adj: DataFrame) -> DataFrame:
    """Each directed edge with the neighbour lists of both its ends."""
    adj = expect(adj, "adj")
    out = adj.select(F.col("id").alias("src_id"), F.col("nbrs").alias("src_nbrs"),
                     F.inline("nbrs").alias("dst_id", "weight", "dst_feat"))
    ends = adj.select(F.col("id").alias("dst_id"), F.col("nbrs").alias("dst_nbrs"))
    return attach(out, ends, "dst_id")
