"""Minimax contiguous sharding of atomic groups.

Groups (rows of one text) are put in a fixed order, by the hash of the text.
The smallest capacity is searched for which a greedy cut of that order makes
no more than the wanted number of shards: each shard takes groups as long as
they fit.  The order is then cut there.

Nothing whole is ever in one place: sums of groups are kept per bucket of the
order (``MOST_BUCKETS`` at most reach the driver), and where a shard ends inside a
bucket is looked up by Spark, for a lane of capacities at once.  All of it is
built-in functions.

Cases: a null text has no bytes and is equal to the empty one.  Rows with equal
text and doc_id are still rows of their own.  With fewer groups than shards
some shards stay empty; an empty table gives an empty one.  One group bigger
than an even share gets a shard that big: groups are never split.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meander.llm.common import running_sums
from meander.scratch import Scratch

SHARDS = 24
OVERHEAD = 8
LEAST_BUCKETS, MOST_BUCKETS = 1 << 10, 1 << 18
LANES = 512
# Rows of a group that are numbered together; a larger group is numbered in this many pieces or more.
PIECES, PIECE_ROWS = 64, 100_000


class _Ends:
    """Looks up, for byte positions in the order, the last group end that isn't beyond them."""

    def __init__(self, groups: DataFrame, totals: list[tuple[int, int]]):
        self.groups, self.known = groups, {}
        self.bucket, self.start, at = [], [], 0
        for bucket, size in totals:
            self.bucket.append(bucket)
            self.start.append(at)
            at += size
        self.total = at

    def ends(self, positions: list[int]) -> list[int]:
        wanted = sorted({p for p in positions if p < self.total and p not in self.known})
        if wanted:
            lanes = [(self.bucket[i], p, self.start[i]) for p in wanted for i in [bisect_right(self.start, p) - 1]]
            values = ", ".join(f"({b}, {p}L)" for b, p, _ in lanes)
            table = F.broadcast(self.groups.sparkSession.sql(f"SELECT * FROM VALUES {values} AS lanes(bucket, position)"))
            found = (self.groups.where(F.col("bucket").isin(sorted({x[0] for x in lanes})))
                     .join(table, "bucket").where("before + size <= position")
                     .groupBy("position").agg(F.max(F.expr("before + size")).alias("at")).collect())
            self.known.update({p: s for _, p, s in lanes})  # no group of the bucket ends before: its start
            self.known.update({r["position"]: r["at"] for r in found})
        return [self.total if p >= self.total else self.known[p] for p in positions]

    def greedy(self, capacities: list[int], shards: int) -> list[list[int]]:
        """Per capacity, where the shards end; the last end is short of the total if they don't suffice."""
        cuts, at = [[] for _ in capacities], [0] * len(capacities)
        for _ in range(shards):
            at = self.ends([p + c for p, c in zip(at, capacities)])
            for own, p in zip(cuts, at):
                own.append(p)
        return cuts


def minimax_cuts(groups: DataFrame, totals: list[tuple[int, int]], largest: int, shards: int) -> list[int]:
    """Ends of the shards under the smallest feasible capacity.

    groups: bucket, size, before (bytes before the group in the whole order).
    """
    ends = _Ends(groups, totals)
    low = max(largest, -(-ends.total // shards))  # no capacity below can do
    high = low + largest  # a shard is left only when the next group doesn't fit, so this one does
    best = None
    while low < high or best is None:
        step = max(1, -(-(high - low) // LANES))
        lanes = sorted({min(high, low + k * step) for k in range(LANES + 1)})
        results = ends.greedy(lanes, shards)
        fit = next(i for i, cuts in enumerate(results) if cuts[-1] == ends.total)
        best, high = results[fit], lanes[fit]
        low = lanes[fit - 1] + 1 if fit else high
    return best


def shard_groups(docs: DataFrame, scratch: Scratch, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
                 overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, .. in each shard) of every row."""
    words = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(words) + overhead).cast("long").alias("size"),
        F.crc32(words.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(words, 256)).alias("sha"),
        F.monotonically_increasing_id().alias("row"))
    rows = scratch.cut(rows, "rows")
    total = rows.count()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (total // 16).bit_length()))
    pieces = max(PIECES, total // PIECE_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "row"), F.lit(pieces)).cast("int"))
    parts = scratch.cut(rows.groupBy("bucket", "sha", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "parts")
    groups = parts.groupBy("bucket", "sha").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    # Buckets are the first sort key, so sums over whole buckets and inside each make up the whole order.
    groups = scratch.cut(running_sums(groups.withColumn("all", F.lit(0)), ["all"], "bucket", [F.col("sha")],
                                      {"before": "size", "rows_before": "n"}), "groups")
    totals = groups.groupBy("bucket").agg(F.sum("size").alias("s"), F.max("size").alias("m")).collect()
    cuts = (minimax_cuts(groups, sorted((r["bucket"], r["s"]) for r in totals), max(r["m"] for r in totals), shards)
            if totals else [0] * shards)
    shard = sum((F.col("before") >= c).cast("int") for c in cuts[:-1]) if shards > 1 else F.lit(0)
    placed = groups.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))
    placed = placed.join(F.broadcast(first), "shard").select("bucket", "sha", "shard", (F.col("rows_before") - F.col("first")).alias("at"))
    ahead = Window.partitionBy("bucket", "sha").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
             .join(placed, ["bucket", "sha"]).select("bucket", "sha", "piece", "shard", (F.col("at") + F.col("ahead")).alias("at")))
    number = F.row_number().over(Window.partitionBy("bucket", "sha", "piece").orderBy("doc_id", "row")) - 1
    return (rows.withColumn("number", number).join(parts, ["bucket", "sha", "piece"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("number")).alias("slot")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_groups(docs, Scratch(spark)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
