"""Exact deduplication in two passes over Bloom filters.

The first pass counts, per slot of a Bloom filter, how many rows' hashes fall
on it and keeps the slots hit more than once; the second tests every row
against these.  Only rows all of whose slots were hit more than once can have
an equal partner, so only they are shuffled to meet it; all others pass
straight through.  Everything is built-in functions.

The filter that is sent to all tasks has at most ``filter_bits`` bits, however
many rows there are.  Beyond about ``filter_bits / 16`` rows more rows without
a partner take the shuffle; the result is the same.

Cases: a null text counts as empty.  Of equal texts the row with the largest
doc_id stays, a null doc_id counting as the smallest; of rows with the same
text and doc_id exactly one stays.  An empty table gives an empty one.  Columns
of any other name are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meander.scratch import Scratch

FILTER_BITS = 1 << 26
SLOTS_PER_ROW = 16
HASHES = 2
# Groups with more than this share of the rows (so under 1 / share of them) are broadcast.
HOT_SHARE = 1e-3


def filter_size(rows: int, most: int = FILTER_BITS) -> int:
    """Slots: a power of two, SLOTS_PER_ROW per row or a little more, within the bound."""
    return min(most, max(1 << 10, 1 << (rows * SLOTS_PER_ROW - 1).bit_length()))


def _slot(sha: Column, k: int, slots: int) -> Column:
    return F.xxhash64(sha, F.lit(k)).bitwiseAND(F.lit(slots - 1))


def repeated_slots(hashed: DataFrame, sha: str, slots: int) -> DataFrame:
    """The filter: (word, bits) for every 64 slots of which at least one was hit more than once.

    One hash function after the other has its own range of words.
    """
    each = [F.struct(F.lit(k).alias("k"), _slot(F.col(sha), k, slots).alias("slot")) for k in range(HASHES)]
    return (hashed.select(F.explode(F.array(*each)).alias("s")).select("s.*")
            .groupBy("k", "slot").count().where("count > 1")
            .select(F.expr(f"k * {slots // 64} + shiftright(slot, 6)").alias("word"),
                    F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def possibly_repeated(rows: DataFrame, sha: str, slots_hit: DataFrame, slots: int, name: str) -> DataFrame:
    """Rows with a flag ``name``: all the row's slots are in the filter.  No row is moved."""
    out, flag = rows, F.lit(True)
    for k in range(HASHES):
        word, bits = f"__word{k}", f"__bits{k}"
        table = F.broadcast(slots_hit.select(F.col("word").alias(word), F.col("bits").alias(bits)))
        slot = _slot(F.col(sha), k, slots)
        out = out.withColumn(f"__slot{k}", slot).join(
            table, F.col(word) == F.lit(k * (slots // 64)) + F.shiftright(F.col(f"__slot{k}"), 6), "left")
        flag = flag & F.expr(f"coalesce(shiftright({bits}, CAST(__slot{k} & 63 AS INT)) & 1, 0) = 1")
    return out.select(*rows.columns, flag.alias(name))


def exact_groups(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text",
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = scratch.cut(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("sha"),
        F.monotonically_increasing_id().alias("row")), "hashed")
    rows = hashed.count()
    slots = filter_size(rows, filter_bits)
    hit = scratch.cut(repeated_slots(hashed, "sha", slots), "filter")
    tested = possibly_repeated(hashed, "sha", hit, slots, "repeated")
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = scratch.cut(tested.where("repeated").groupBy("sha").agg(best, F.count("*").alias("n"))
                         .select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"),
                         "groups")
    hot = F.broadcast(groups.where(F.col("n") > F.lit(max(1.0, rows * HOT_SHARE)))
                      .select("sha", *[F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "n")]))
    alone = tested.where("not repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    met = tested.where("repeated").join(hot, "sha", "left")
    done = lambda df, p: df.select(
        "doc_id", F.col(f"{p}keep_id").alias("keep_id"), F.col(f"{p}n").alias("group_size"),
        (F.col("row") == F.col(f"{p}keep_row")).alias("kept"), "sha")
    crowd = done(met.where("hot_n is not null"), "hot_")
    rest = done(met.where("hot_n is null").select("doc_id", "sha", "row").join(groups, "sha"), "")
    return (alone.unionByName(crowd).unionByName(rest)
            .select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text",
                      filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter clears are returned as they are read.  The others are
    matched with the decisions by (doc_id, text hash); where several rows share
    both, the one with the smallest columns stays.
    """
    decided = scratch.cut(exact_groups(docs, scratch, doc_id, text, filter_bits)
                          .where("group_size > 1")
                          .select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"), "decided")
    slots = filter_size(docs.count(), filter_bits)
    keyed = docs.withColumn("__sha", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    hit = scratch.cut(repeated_slots(keyed, "__sha", slots), "filter")
    tested = possibly_repeated(keyed, "__sha", hit, slots, "__repeated")
    keep = decided.groupBy("doc_id", "sha").agg(F.max("kept").alias("__kept"), F.count("*").alias("__same"))
    held = tested.where("__repeated").join(
        keep.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__of"), "__kept", "__same"),
        F.col("__id").eqNullSafe(F.col(doc_id)) & (F.col("__of") == F.col("__sha")), "left")
    once = held.where(F.coalesce("__same", F.lit(1)) == 1).where(F.coalesce("__kept", F.lit(True)))
    several = held.where("__same > 1 and __kept")
    # Equal in doc_id and text: one row per pair, whatever the other columns hold.
    others = [c for c in docs.columns if c not in (doc_id, text)]
    one = several.groupBy("__sha", "__id").agg(
        F.min_by(F.struct(*docs.columns), F.struct(F.col(text).isNull(), *[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in others])).alias("__row"))
    return (tested.where("not __repeated").select(*docs.columns)
            .unionByName(once.select(*docs.columns)).unionByName(one.select("__row.*")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs.select("doc_id", "text"), Scratch(spark))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
