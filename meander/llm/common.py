"""What several operators share: bounded slices of texts, running sums, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from meander.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"

# Text bytes that one step of a task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``limit`` bytes of text, whatever the lengths of the texts are."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        block = np.cumsum(size) // limit
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for lo, hi in zip(starts, [*starts[1:], len(size)]):
            yield batch.slice(lo, hi - lo)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64)


def binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values[first[i]:first[i + 1]] as one binary each."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(first, np.int64) * values.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def long_arrays(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values[first[i]:first[i + 1]] as one list of longs each."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(first, np.int32)), pa.array(signed(values)))


def running_sums(rows: DataFrame, key: list[str], bucket: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Add, per entry ``new: column`` of ``values``, the column's sum over the rows before, within ``key``.

    ``bucket`` is a column that grows with ``order``; only rows of one bucket
    are sorted together, and the buckets' totals are summed in a table with one
    row per bucket, so a key may own any share of the rows.  ``key`` and
    ``bucket`` hold no nulls.
    """
    at = [*key, bucket]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(c).alias(f"__t_{n}") for n, c in values.items()]
    shift = before(Window.partitionBy(*key).orderBy(bucket))
    offsets = rows.groupBy(*at).agg(*sums).select(
        *at, *[F.coalesce(F.sum(f"__t_{n}").over(shift), F.lit(0)).alias(f"__o_{n}") for n in values])
    inner = before(Window.partitionBy(*at).orderBy(*order))
    own = rows.withColumns({f"__i_{n}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in values.items()})
    return own.join(offsets, at).select(
        *rows.columns, *[(F.col(f"__o_{n}") + F.col(f"__i_{n}")).alias(n) for n in values])


def components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``links``: root is the smallest node reachable.

    Alternates large stars (every larger neighbour moves to a node's smallest
    neighbour) and small stars (every smaller one does) until nothing changes.
    Each round is a sum by node and an equi-join, written out.  Once the nodes of a
    component all point to its root, the root's rows meet in one partition of
    that join; Spark's adaptive skew join splits it where it is large.
    """
    def stars(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.select(F.col("u"), F.col("v"))
        if larger:
            both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        if larger:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return (met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(least.select("u", F.col("m").alias("v"))).distinct())

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())

    # Every edge points from the larger node to the smaller one.
    edges = scratch.cut(links.where(F.col(a) != F.col(b))
                        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    now = state(edges)
    while now[0]:
        edges = scratch.cut(stars(stars(edges, True), False), "edges")
        was, now = now, state(edges)
        if was == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
