"""Alias tables: a weighted draw at the same cost however long the list is.

A list of n entries of total weight W becomes n buckets of weight W / n each,
every one shared by at most two entries.  A draw takes a bucket evenly and one
of its entries by a second number.  The buckets of light entries (weight under
W / n) are filled up by heavy ones in the order of both; who fills up whom
follows from running sums of what light entries lack and heavy ones have to
spare, so the tables are window functions over entries, without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meander.functions import draw
from meander.schemas import expect


def with_alias(entries: DataFrame) -> DataFrame:
    """Rows (id, nbr, weight, ...) with ``place`` (from 1, by nbr), ``total``, ``prob`` and ``other``.

    Bucket ``place`` belongs to its entry up to ``prob`` of ``total``, beyond it to the
    entry at place ``other``.  Partitioned by id, as the rows may be already.
    """
    whole, by_nbr = Window.partitionBy("id"), Window.partitionBy("id").orderBy("nbr")
    before = by_nbr.rowsBetween(Window.unboundedPreceding, -1)
    rows = entries.withColumns({
        "place": F.row_number().over(by_nbr), "__n": F.count(F.lit(1)).over(whole), "__run": F.sum("weight").over(by_nbr)})
    rows = rows.withColumn("total", F.max("__run").over(whole))
    own = F.col("__n") * F.col("weight")
    light = own <= F.col("total")
    rows = rows.withColumns({"__light": light, "__lack": F.when(light, F.col("total") - own).otherwise(F.lit(0.0)),
                             "__spare": F.when(light, F.lit(0.0)).otherwise(own - F.col("total"))})
    rows = rows.withColumns({"__lack_before": F.coalesce(F.sum("__lack").over(before), F.lit(0.0)),
                             "__lack_to": F.sum("__lack").over(by_nbr), "__spare_to": F.sum("__spare").over(by_nbr)})
    # In this order a light entry is followed by the heavy one that fills its bucket, a
    # heavy one by the next heavy one, and preceded by the light one that uses it up.
    rows = rows.withColumn("__key", F.when(F.col("__light"), F.col("__lack_before")).otherwise(F.col("__spare_to")))
    ahead = whole.orderBy("__key", "__light", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = (whole.orderBy(F.desc("__key"), F.desc("__light"), F.desc("place"))
              .rowsBetween(Window.unboundedPreceding, -1))
    used = F.last(F.when(F.col("__light"), F.col("__lack_to")), ignorenulls=True).over(ahead)
    filler = F.last(F.when(~F.col("__light"), F.col("place")), ignorenulls=True).over(behind)
    rows = rows.withColumns({"__used": F.coalesce(used, F.lit(0.0)), "other": F.coalesce(filler, F.col("place"))})
    left = F.least(F.col("total"), F.col("total") + F.col("__spare_to") - F.col("__used"))
    rows = rows.withColumn("prob", F.when(F.col("__light"), F.col("__n") * F.col("weight")).otherwise(left))
    return rows.select(*entries.columns, "place", "total", "prob", "other")


def alias_tables(adj: DataFrame) -> DataFrame:
    """One row per entry of the lists: id, place, nbr, prob, other, total."""
    rows = with_alias(expect(adj, "adj").select("id", F.inline("nbrs")))
    return rows.select("id", "place", "nbr", "prob", "other", "total")


def alias_draw(tables: DataFrame, seed: int, draw_no: int = 0) -> DataFrame:
    """One neighbour per vertex, in proportion to weight, by the vertex's table: id, nbr."""
    lists = tables.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "nbr", "prob", "other"))).alias("e"),
                                     F.max("total").alias("total"))
    bits = draw.hashed(seed, F.lit(draw_no), F.col("id"), 0)
    drawn = lists.select("id", "e", pick("e.prob", "e.other", F.col("total"), draw.part(bits, 0), draw.part(bits, 1)).alias("at"))
    return drawn.select("id", F.element_at("e.nbr", F.col("at")).alias("nbr"))


def pick(prob: str, other: str, total: Column, u: Column, v: Column) -> Column:
    """The place (from 1) that two numbers in (0, 1) draw."""
    bucket = F.floor(u * F.size(prob)).cast("int")
    return F.when(v * total < F.get(prob, bucket), bucket + 1).otherwise(F.get(other, bucket))
