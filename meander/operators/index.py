"""Dense ids for vertex names, and edges by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meander.operators.joins import attach, fits_broadcast, hot_keys
from meander.schemas import expect
from meander.scratch import Scratch


def node_index(padded: DataFrame, scratch: Scratch) -> DataFrame:
    """Ids 0, 1, 2, ... for the distinct endpoint names, in name order.

    Names are range-partitioned and sorted, and numbered within each
    partition while they are written; the number of names in the partitions
    before gives the rest of the id.  So no task sees more than its range.
    The table is written because range bounds come from a sample: counts and
    numbers must refer to the same layout.
    """
    names = padded.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    numbered = scratch.cut(
        names.repartitionByRange("node").sortWithinPartitions("node")
             .select("node", F.monotonically_increasing_id().alias("at")), "names")
    # An increasing id holds the partition in its upper 31 bits, the row in its lower 33.
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    located = numbered.select("node", part.alias("part"), row.alias("row"))
    # One row per written partition.
    indexed = located.join(F.broadcast(before), "part")
    return indexed.select("node", (F.col("before") + F.col("row")).cast("bigint").alias("id"))


def index_edges(padded: DataFrame, node2id: DataFrame) -> DataFrame:
    """Padded edges with ids in place of names.  Hand over a written table: it is read for the look for hot keys."""
    padded = expect(padded, "padded")
    hot = ({"src": [], "dst": []} if fits_broadcast(node2id)
           else hot_keys(padded, ["src", "dst"]))
    # Targets first: padded edges lie in their order, and the name needn't move again.
    ids = expect(node2id, "node2id")
    half = attach(padded, ids.toDF("dst", "dst_id"), "dst", hot=hot["dst"]).drop("dst")
    return expect(attach(half, ids.toDF("src", "src_id"), "src", hot=hot["src"]), "indexed_edges")


def half_indexed(padded: DataFrame, node2id: DataFrame, hot: list | None = None) -> DataFrame:
    """Padded edges with the id of the source, still with the name of the target."""
    ids = expect(node2id, "node2id").toDF("src", "src_id")
    return attach(expect(padded, "padded"), ids, "src", hot=hot).drop("src")
