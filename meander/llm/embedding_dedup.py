"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by pseudo-random rotations (three rounds of random signs
and a fast Hadamard transform).  A hash is the axis it then lies nearest to,
with the sign; a bucket is the pair of two such hashes, of which there are
``TABLES``.  Each vector also probes the buckets that its second-nearest axes
give.  Vectors that share a bucket are compared by their exact cosine in
double precision, so no pair below the threshold is ever linked.

Equal vectors are one class from the start.  A bucket of any size is split
into blocks, and every pair of its blocks is compared somewhere, so no bucket
has a cap.

Cases: vectors that are null, empty, zero or hold null or non-finite parts,
and those with a null label or vec_id, link with nothing; a null vec_id gets a
null component and isn't kept.  Only vectors of one label and one length are
compared.  Rows with the same vec_id and equal vectors count one by one.
An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from meander.llm.common import components, long_arrays
from meander.llm.words import mix
from meander.scratch import Scratch

THRESHOLD = 0.93
TABLES, SEED = 8, 1
# Members of a block of a bucket, and members that one comparing task holds.
BLOCK, GROUP_ROWS = 512, 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, its length a power of two, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    signs = np.random.default_rng([seed, number]).choice([-1.0, 1.0], size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second-nearest axis of each row, +i as 2 i and -i as 2 i + 1."""
    size = np.abs(x)
    at = np.arange(len(x))
    first = size.argmax(1)
    size[at, first] = -1
    second = size.argmax(1)
    code = lambda i: 2 * i + (x[at, i] < 0)
    return code(first).astype(np.uint64), code(second).astype(np.uint64)


def bucket_codes(x: np.ndarray, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Per row its buckets: of each table the nearest pair of axes and the two probes."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = []
    for t in range(tables):
        (a, a2), (b, b2) = (nearest_axes(rotated(x, 2 * t + k, seed)) for k in (0, 1))
        out += [(np.uint64(t) << np.uint64(48)) | (p << np.uint64(24)) | q for p, q in ((a, b), (a2, b), (a, b2))]
    return np.stack(out, axis=1)


def _hash(tables: int, seed: int):
    """(label, vector) to (label, vector, width, unit vector, buckets) for vectors that can link."""
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, size = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            start = np.r_[0, np.cumsum(size)][:-1]
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null part becomes NaN
            for width in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == width)
                x = values[start[rows][:, None] + np.arange(width)]
                top = np.abs(x).max(1)
                good = np.isfinite(x).all(1) & (top > 0)
                rows, x = rows[good], x[good] / top[good][:, None]  # no overflow or underflow in the lengths
                if not len(rows):
                    continue
                x /= np.sqrt((x * x).sum(1))[:, None]
                codes = bucket_codes(x, tables, seed)
                label = np.asarray(batch.column(0).take(pa.array(rows)).cast(pa.int64()))
                key = mix(codes ^ mix(label.view(np.uint64) * np.uint64(1 << 20) + np.uint64(width), 41)[:, None], 42)
                yield pa.record_batch([pa.array(label), batch.column(1).take(pa.array(rows)),
                                       pa.array([r.tobytes() for r in x], pa.binary()),
                                       long_arrays(key.ravel(), np.arange(len(rows) + 1) * key.shape[1])],
                                      ["label", "embedding", "unit", "buckets"])
    return run


def _compare(threshold: float):
    """All buckets (or pairs of blocks) of a task's share: pairs of classes at the threshold."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf[["bucket", "i", "j"]].to_numpy()
        order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0]))
        cell, ids, label, block = (v[order] for v in (cell, pdf["rep"].to_numpy(), pdf["label"].to_numpy(), pdf["block"].to_numpy()))
        units = pdf["unit"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
        out = []
        for lo, hi in zip(starts, [*starts[1:], len(cell)]):
            if hi - lo < 2:
                continue
            size = np.array([len(u) for u in units[lo:hi]])
            for width in np.unique(size):
                own = lo + np.flatnonzero(size == width)
                x = np.frombuffer(b"".join(units[own]), np.float64).reshape(len(own), -1)
                near = np.triu(x @ x.T >= threshold, 1) & (label[own][:, None] == label[own][None, :])
                if cell[lo, 1] != cell[lo, 2]:  # members of one block meet elsewhere
                    near &= block[own][:, None] != block[own][None, :]
                a, b = np.nonzero(near)
                out.append(np.stack([ids[own[a]], ids[own[b]]], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}).astype("int64")
    return run


def vector_links(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, tables: int = TABLES,
                 seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (label, embedding, rep, members) and links (a, b) between their reps.

    vectors: vec_id, embedding, label.  rep is the smallest vec_id of a class.
    """
    usable = vectors.where("vec_id is not null and label is not null and size(embedding) > 0")
    classes = scratch.cut(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")), "classes")
    shape = "label long, embedding {}, unit binary, buckets array<long>".format(vectors.schema["embedding"].dataType.simpleString())
    hashed = classes.select("label", "embedding").mapInArrow(_hash(tables, seed), shape)
    hashed = scratch.cut(hashed.join(classes.select("label", "embedding", "rep"), ["label", "embedding"])
                         .select("rep", "label", "unit", "buckets"), "hashed", "zstd")
    entries = hashed.select("rep", F.explode(F.array_distinct("buckets")).alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    met = scratch.cut(entries.join(full, "bucket")
                      .withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
                      .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
                      .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
                      .select("rep", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "met")
    groups = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // GROUP_ROWS)
    share = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)).alias("share")
    pairs = (met.join(hashed.select("rep", "label", "unit"), "rep").select("*", share)
             .groupBy("share").applyInPandas(_compare(threshold), "a long, b long").distinct())
    return classes, scratch.cut(pairs, "links")


def vector_components(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, tables: int = TABLES, seed: int = SEED,
                      vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).cast("long").alias("label"))
    classes, links = vector_links(rows, scratch, threshold, tables, seed)
    members = classes.select("rep", "members")
    both = links.union(links.select("b", "a"))
    degree = (both.join(members.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("members").alias("others")))
    roots = components(links, "a", "b", scratch)
    # A zero or non-finite vector's class isn't linked even with its equals.
    fit = scratch.cut(classes.select("label", "embedding", "rep", "members")
                      .where(F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"))
                      .join(degree, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
                      .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
                              F.coalesce("root", "rep").alias("root"))
                      .where("n_links > 0"), "linked")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    joined = (rows.where(usable).join(fit, ["label", "embedding"], "left").select("vec_id", "n_links", "root")
              .unionByName(rows.where(~usable).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("root"))))
    component = F.coalesce("root", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return vector_components(vectors, Scratch(spark))
