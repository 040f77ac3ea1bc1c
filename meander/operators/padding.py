"""Put vertex features on the endpoints of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meander.functions import text as X
from meander.operators.joins import attach, fits_broadcast, hot_keys
from meander.schemas import expect
from meander.scratch import Scratch


def drop_malformed(lines: DataFrame) -> DataFrame:
    """The text lines with at least two tokens."""
    return lines.where(X.has_two_tokens(F.col("value")))


def pad_edges(edges: DataFrame, feat1: DataFrame, feat2: DataFrame, scratch: Scratch | None = None,
              written: bool = False) -> DataFrame:
    """Distinct edges with a feature of Type I on ``src`` and one of Type II on ``dst``.

    Edges without either feature drop out; several features of a vertex give
    several rows.  Copies are removed before the joins: then every pair of
    distinct inputs gives a distinct row, so no pass over the result is needed
    and repeated edges collapse map-side instead of piling up on a join key.
    Where a feature table is too large to broadcast, the distinct edges are written
    once, so that the look for hot keys doesn't work them out a second time.
    ``written`` edges go to ``scratch``; where the last join has left them by their target,
    none of which is hot, in buckets of it, so that ids are joined to it in place.
    """
    pairs = expect(edges, "edges").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    one = expect(feat1, "features").distinct().toDF("src", "src_feat")
    two = expect(feat2, "features").distinct().toDF("dst", "dst_feat")
    wanted = [end for end, table in (("src", one), ("dst", two)) if not fits_broadcast(table)]
    hot = {"src": [], "dst": []}
    if wanted:
        pairs = (scratch or Scratch(edges.sparkSession)).cut(pairs, "pairs", "zstd")
        hot |= hot_keys(pairs, wanted)
    joined = attach(pairs, one, "src", hot=hot["src"])
    joined = attach(joined, two, "dst", hot=hot["dst"])
    padded = expect(joined, "padded")
    if not written:
        return padded
    scratch = scratch or Scratch(edges.sparkSession)
    in_place = "dst" in wanted and not hot["dst"]
    return scratch.cut_by(padded, "dst", "padded", "zstd") if in_place else scratch.cut(padded, "padded", "zstd")


def node2feat(padded: DataFrame, side: str = "src") -> DataFrame:
    """Distinct (vertex, feature) pairs from the sources of edges, or from both ends."""
    ends = [F.struct(F.col("src").alias("node"), F.col("src_feat").alias("feat"))]
    if side == "both":
        ends.append(F.struct(F.col("dst").alias("node"), F.col("dst_feat").alias("feat")))
    elif side != "src":
        raise ValueError(f"side must be 'src' or 'both', got {side!r}")
    return expect(padded, "padded").select(F.inline(F.array(*ends))).distinct()
