"""Documents linked by the Jaccard similarity of their word shingles, exactly.

Prefix filtering: two sets of similarity t share k shingles among the first
n - ceil(t n) + k of each, whatever order all shingles are put in.  Several
orders are used, each a filter of its own, and a pair is compared only if it
passes all of them:

1. By hash, k a tenth of n.  Documents whose prefix shares fewer than k
   shingles with others are linked with nothing; for most this ends the search.
2. Rarest first (by how many sets hold a shingle, in steps of a twelfth or
   less), ties by a second hash, over the documents left.  Documents of a
   common prefix shingle form a list.
3. Rarest first, ties by a third hash: a pair from a list must also share a
   prefix shingle here.

Equal sets are one class from the start, known by a 64-bit hash of the set, so
copies cost nothing.  A list of many near copies isn't spelled out in pairs:
its most typical member (the pivot) is compared with all others; members that
this doesn't bring into one component are compared block by block, skipping
pairs that are linked already.  So links that can't change a component are not
looked for, and every other one is found.

Cases: a null text, or one without words, has no shingles and is linked with
nothing.  With fewer words than a shingle the whole sequence is the only
shingle.  A row without doc_id gets a null component and is linked with
nothing.  Rows with one doc_id are one document; each row's own text decides
its component.  An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meander.llm.common import binaries, components, long_arrays, signed, slices
from meander.llm.postings import BY_SLICE, common_hashes, deal_by_slice, shared_counts_by_slice, shared_hashes_by_slice
from meander.llm.words import Words, mix, position_mask, shingle_hashes, text_of
from meander.operators.joins import attach
from meander.scratch import Scratch

WORDS, PERCENT = 5, 75
# The first prefix holds this part of a document's shingles more than one, and as many must be shared.
SLACK = 10
# Shingles that one reducing task holds at a time, members of a block, and documents fetched by broadcast at most.
GROUP_SHINGLES, BLOCK, BROADCAST_IDS = 500_000, 512, 500_000
# Bytes of whole sets whose answers come back together.
SLICE_OF_SETS = 8 << 20


def shingle_sets(words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, end to end, and where each text's begin."""
    h, counts = words.hash, words.counts
    whole = position_mask(words.first, n)
    values, owner = shingle_hashes(h, n)[whole], text_of(words.first)[:len(whole)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        one = mix(counts[short].astype(np.uint64), 11)
        for k in range(n - 1):
            more = counts[short] > k
            one[more] = mix(one[more] * np.uint64(31) + h[words.first[short[more]] + k])
        values, owner = np.r_[values, one], np.r_[owner, short]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])] if len(values) else np.zeros(0, bool)
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[np.zeros(1, values.dtype), np.cumsum(values)]
    return total[first[1:]] - total[first[:-1]]


def prefix_length(n, percent: int = PERCENT):
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def _first_of_each(values, first, lengths, order):
    """Of each text's values, in the order given (by text, then rank), the first ``lengths``."""
    at = np.repeat(first[:-1], lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    return values[order[at]], np.r_[0, np.cumsum(lengths)]


def _class_of(values, first, counts):
    return mix(_sums(mix(values, 5), first) + counts.astype(np.uint64), 6)


def _read(n: int, percent: int):
    def run(batches):
        for batch in slices(batches, "text"):
            values, first = shingle_sets(Words(batch.column(1), lower=True), n)
            counts = np.diff(first)
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((mix(values, 21), owner))
            prefix, at = _first_of_each(values, first, prefix_length(counts, percent) + np.maximum(0, counts // SLACK - 1), order)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()),
                                   pa.array(signed(_class_of(values, first, counts)), mask=counts == 0), binaries(prefix, at)],
                                  ["doc_id", "n", "set_id", "prefix"])
    return run


def _read_sets(n: int):
    def run(batches):
        for batch in slices(batches, "text"):
            values, first = shingle_sets(Words(batch.column(0), lower=True), n)
            counts = np.diff(first)
            own = np.asarray(batch.column(1), np.int64)
            same = pa.array(signed(_class_of(values, first, counts)) == own)
            yield pa.record_batch([batch.column(1), pa.array(counts, pa.int64()), binaries(values, first)],
                                  ["set_id", "n", "hashes"]).filter(same)
    return run


def _prefixes(percent: int):
    """Rarest-first prefixes under two tie-breaks, without the shingles that only one set has."""
    def run(batches):
        for batch in batches:
            ns = np.asarray(batch.column(1), np.int64)
            out = ([], [])
            typical = np.zeros(len(ns))
            for i, (hs, ds) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                values, level = np.frombuffer(hs, np.uint64), np.frombuffer(ds, np.uint8)
                left = max(0, int(prefix_length(ns[i], percent)) - (int(ns[i]) - len(values)))
                for k in (0, 1):
                    out[k].append(values[np.lexsort((mix(values, 22 + k), level))[:left]])
                typical[i] = level.sum(dtype=np.int64) / ns[i]
            lists = [long_arrays(np.concatenate(o or [np.zeros(0, np.uint64)]), np.r_[0, np.cumsum([len(x) for x in o])]) for o in out]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *lists, pa.array(typical)],
                                  ["set_id", "n", "hashes", "prefix2", "prefix3", "typical"])
    return run


def _similar(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = [_similar(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)),
                             n, m, percent)
                    for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _compare_blocks(percent: int):
    """Links between members of different components in two blocks of a pivot's documents."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "set_id"]).drop_duplicates("set_id")
        sets = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
        n, label, ids = pdf["n"].to_numpy(), pdf["label"].to_numpy(), pdf["set_id"].to_numpy()
        block = pdf["block"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        names, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.r_[0, np.cumsum([len(s) for s in sets])]
        mark, links = np.zeros(len(names), np.int32), []
        most = pd.Series(label).value_counts().index[0]
        component = dict(zip(label.tolist(), label.tolist()))

        def root(x):
            while component[x] != x:
                x = component[x]
            return x

        for x in np.flatnonzero(label != most):
            mark[tokens[at[x]:at[x + 1]]] = 1
            common = np.add.reduceat(mark[tokens], at[:-1])
            mark[tokens[at[x]:at[x + 1]]] = 0
            near = _similar(common, n[x], n, percent) & (label != label[x])
            if i != j:
                near &= block != block[x]
            for y in np.flatnonzero(near):
                p, q = root(label[x]), root(label[y])
                if p != q:
                    component[p] = q
                    links.append((ids[x], ids[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")
    return run


def set_links(docs: DataFrame, scratch: Scratch, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, set_id), and links (a, b) between set ids that connect just what is connected."""
    spark = docs.sparkSession
    rows = scratch.cut(docs.mapInArrow(_read(words, percent), "doc_id long, n long, set_id long, prefix binary"), "sets", "zstd")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, total // 4 // GROUP_SHINGLES)

    known = rows.where("set_id is not null and doc_id is not null")
    classes = scratch.cut(known.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.count("*").alias("c")), "classes")
    # One document speaks for all of an equal set.
    many = classes.where("c > 1").select("set_id", F.col("id").alias("first"))
    if many.count() <= BROADCAST_IDS:
        sole = known.join(F.broadcast(many), "set_id", "left").where("first is null or first = doc_id").select("set_id", "prefix")
    else:  # rows that come from a shuffle are written, so that slices of them are the same in a task that runs again
        sole = scratch.cut(attach(known, many, "set_id", "left").where("first is null or first = doc_id").select("set_id", "prefix"), "sole", "zstd")
    shared = shared_counts_by_slice(sole.mapInArrow(deal_by_slice("prefix", buckets, short=True), BY_SLICE))
    wanted = (classes.join(shared, F.col("set_id") == F.col("owner")).where(f"shared >= greatest(1, n div {SLACK})").select("set_id", "id", "n"))
    wanted = scratch.cut(wanted, "active")
    stats = wanted.agg(F.count("*"), F.sum("n")).first()
    ids = wanted.select(F.col("id").alias("doc_id"), "set_id")
    ids = F.broadcast(ids) if stats[0] <= BROADCAST_IDS else ids
    sets = scratch.cut(docs.join(ids, "doc_id").select("text", "set_id")
                       .mapInArrow(_read_sets(words), "set_id long, n long, hashes binary"), "active-sets", "zstd")

    buckets = max(parts, (stats[1] or 0) // GROUP_SHINGLES)
    owned = sets.select("set_id", "hashes", "n")
    dealt = owned.mapInArrow(deal_by_slice("hashes", buckets, common_hashes(owned, "hashes", stats[0]), limit=SLICE_OF_SETS), BY_SLICE)
    counted = shared_hashes_by_slice(dealt).withColumnRenamed("owner", "set_id")
    if sets.count() > stats[0]:  # rows that repeat doc_id and text
        counted = counted.dropDuplicates(["set_id"])
    info = (counted.select("set_id", "n", "hashes", "levels")
            .mapInArrow(_prefixes(percent), "set_id long, n long, hashes binary, prefix2 array<long>, prefix3 array<long>, typical double")
            .where("size(prefix2) > 0"))
    # From here on the shingles that only one set has are left out: none of them is in an intersection.
    info = scratch.cut(info, "prefixes", "zstd")

    postings = info.select(F.explode("prefix2").alias("shingle"), "set_id", "typical")
    pivots = (postings.groupBy("shingle").agg(F.max(F.struct("typical", "set_id")).alias("p"), F.count("*").alias("c"))
              .where("c > 1").select("shingle", F.col("p.set_id").alias("pivot")))
    near = scratch.cut(postings.join(pivots, "shingle").where("pivot <> set_id").select("pivot", "set_id").distinct(), "near")

    # Both sides of a pair get the same columns under names of their own, so that one exchange of the sets serves both.
    own = lambda c, *more: info.select(F.col("set_id").alias(c), *[F.col(m).alias(f"{m}_{c}") for m in more])
    both = lambda pairs, *more: pairs.join(own("b", *more), "b").join(own("a", *more), "a")
    pairs = (both(near.select(F.col("pivot").alias("a"), F.col("set_id").alias("b")), "n", "prefix3")
             .where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)") & F.arrays_overlap("prefix3_a", "prefix3_b"))
             .select("a", "b"))
    links = scratch.cut(both(pairs, "n", "hashes").select("a", "b", "n_a", "n_b", "hashes_a", "hashes_b")
                        .mapInArrow(_verify(percent), "a long, b long"), "links")

    labels = scratch.cut(components(links, "a", "b", scratch), "labels")
    members = near.unionByName(near.select("pivot", F.col("pivot").alias("set_id")).distinct())
    members = members.join(labels, F.col("set_id") == F.col("node"), "left").select("pivot", "set_id", F.coalesce("root", "set_id").alias("label"))
    members = scratch.cut(members, "members")
    open_ = members.groupBy("pivot").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("c")).where("l <> m")
    rest = (members.join(open_.select("pivot", "c"), "pivot")
            .withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("pivot", "set_id", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    # Two members of one block meet in that block with itself, members of two blocks in the pair of them.
    rest = rest.join(info.select("set_id", "n", "hashes"), "set_id")
    more = rest.groupBy("pivot", "i", "j").applyInPandas(_compare_blocks(percent), "a long, b long")
    return rows.select("doc_id", "n", "set_id"), scratch.cut(links.unionByName(more), "links")


def jaccard_components(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return _rows_with_component(docs, scratch, words, percent, doc_id, text).drop("set_id")


def _rows_with_component(docs: DataFrame, scratch: Scratch, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, links = set_links(narrow, scratch, words, percent)
    roots = scratch.cut(components(links, "a", "b", scratch), "roots")
    known = rows.where("set_id is not null and doc_id is not null")
    classes = scratch.cut(known.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")), "classes")
    joined = classes.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("c").alias("c")).where("c > 1")
    named = scratch.cut(joined.select("set_id", "root").join(least.select("root", "component_id"), "root").select("set_id", "component_id"), "named")
    return attach(rows, named, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "set_id")


def _add_set(n: int, batch_text: str, at: int):
    def run(batches):
        for batch in slices(batches, batch_text):
            values, first = shingle_sets(Words(batch.column(at), lower=True), n)
            counts = np.diff(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(_class_of(values, first, counts)), mask=counts == 0)],
                                             [*batch.schema.names, "__set"])
    return run


def one_of_each(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and those without doc_id."""
    found = _rows_with_component(docs, scratch, words, percent, doc_id, text)
    # Rows of one doc_id may have different texts, each with a component of its own.
    losers = scratch.cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__loser"), F.col("set_id").alias("__lost")).distinct(), "losers")
    if losers.count() <= BROADCAST_IDS:
        losers = F.broadcast(losers)
    told = docs.mapInArrow(_add_set(words, text, docs.columns.index(text)), T.StructType([*docs.schema.fields, T.StructField("__set", T.LongType())]))
    same = (F.col(doc_id).cast("long") == F.col("__loser")) & (F.col("__set") == F.col("__lost"))
    return told.join(losers, same, "left_anti").drop("__set")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, Scratch(spark))
