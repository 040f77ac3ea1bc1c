"""Removal of passages that repeat across documents, by automata of repeated phrases.

1. Anchors.  Of the 25-word phrases of a 50-word window the one with the
   smallest hash is its anchor; equal windows have equal anchors, and
   neighbouring windows mostly share theirs.  Only documents holding an anchor
   that another document has too can hold a repeated window.
2. Confirmed windows.  Of these documents the windows on shared anchors are
   compared by hash; each that several documents have belongs to the first of
   them (smallest doc_id).  Neighbouring windows of one first document make a
   passage, which is kept as text.
3. Automata.  The documents are dealt into batches of bounded size, the
   passages to the batches whose documents have one of their anchors.  Every
   batch's passages are compiled into an Aho-Corasick automaton of short
   phrases, one for every 25th word, so every window of a passage holds one.
   All documents of the batch stream through it.  Windows in which a phrase
   occurs are compared word by word with the passage they may come from; equal
   ones, if its document is an earlier one, are covered.

Hashes only propose; what is removed was compared word by word.  Windows are
judged on the input: a passage is never shortened because of another one.

Cases: a null text has no words; fewer than 50 words are never removed.  A row
without doc_id is left as it is and removes nothing elsewhere.  Rows with one
doc_id are one document for each other: neither comes before the other.  An
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meander.llm.common import WORD, binaries, slices
from meander.llm.postings import SCHEMA, bucket_of, deal, packed, runs, shared_hashes
from meander.llm.words import Words, mix, position_mask, text_of, window_hashes
from meander.scratch import Scratch

WINDOW, ANCHOR = 50, 25
PHRASE = 6  # words of an automaton's phrases
GROUP_HASHES, BATCH_WORDS, BROADCAST_IDS = 500_000, 300_000, 500_000


def _joined(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The (kept) words of all texts, each followed by a space, and where each text's begin."""
    start, end = words.start, words.end
    first = words.first
    if keep is not None:
        first = np.r_[0, np.cumsum(keep)][first]
        start, end = start[keep], end[keep]
    size = end - start + 1
    past = np.r_[0, np.cumsum(size)]
    at = np.repeat(start - past[:-1], size) + np.arange(past[-1])
    out = words.data[np.minimum(at, max(0, len(words.data) - 1))] if len(at) else np.zeros(0, np.uint8)
    out[past[1:] - 1] = 32
    return out.tobytes(), past[first]


def _digests(words: Words, keep: np.ndarray | None = None) -> list[str]:
    text, at = _joined(words, keep)
    return [hashlib.sha256(text[a:max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def window_anchors(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Per window the smallest hash of its phrases."""
    least, width, span = window_hashes(h, anchor), 1, window - anchor + 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    shift = span - width
    return np.minimum(least[:-shift], least[shift:]) if shift else least


def _read(window: int, anchor: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            whole = position_mask(words.first, window)
            anchors = window_anchors(words.hash, window, anchor)[whole] if len(whole) else np.zeros(0, np.uint64)
            owner = text_of(words.first)[:len(whole)][whole]
            new = np.r_[True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])] if len(anchors) else np.zeros(0, bool)
            anchors, owner = anchors[new], owner[new]
            yield pa.record_batch([batch.column(0), pa.array(words.counts), pa.array(_digests(words)),
                                   binaries(anchors, np.searchsorted(owner, np.arange(batch.num_rows + 1)))],
                                  ["doc_id", "n_words", "kept_sha256", "anchors"])
    return run


def _windows(window: int, anchor: int, buckets: int):
    """Packed windows on shared anchors, each by its two first documents of the slice."""
    def run(batches):
        for batch in slices(batches, "text", 8 << 20):
            words = Words(batch.column(1))
            whole = position_mask(words.first, window)
            if not whole.any():
                continue
            anchors = window_anchors(words.hash, window, anchor)[whole]
            values = window_hashes(words.hash, window)[whole]
            owner = text_of(words.first)[:len(whole)][whole]
            lists = batch.column(2).to_pylist()
            wanted = np.concatenate([mix(np.frombuffer(b"".join(x), np.uint64) ^ mix(np.uint64([i]), 51)) for i, x in enumerate(lists)])
            keep = np.isin(mix(anchors ^ mix(owner.astype(np.uint64), 51)), wanted)
            values, owner, anchors = values[keep], np.asarray(batch.column(0), np.int64)[owner[keep]], anchors[keep]
            order = np.lexsort((owner, values))
            values, owner, anchors = values[order], owner[order], anchors[order]
            new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])] if len(values) else np.zeros(0, bool)
            values, owner, anchors = values[new], owner[new], anchors[new]
            early = runs(values)[0] < 2
            yield packed(values[early], owner[early], bucket_of(anchors[early], buckets))
    return run


def _confirm(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows that several documents have, by the first of them."""
    values = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["hashes"]])
    owner = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["owners"]])
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    place, size = runs(values)
    last = owner[np.arange(len(values)) - place + size - 1]
    keep = (place == 0) & (last > owner)
    values, owner = values[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    return pd.DataFrame({"doc_id": owner[start], "windows": [values[a:b].tobytes() for a, b in zip(start, [*start[1:], len(owner)])]},
                        columns=["doc_id", "windows"])


def _passages(window: int, anchor: int):
    """Of first documents, the passages that their confirmed windows make up, and the anchors in each."""
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            whole = position_mask(words.first, window)
            hashes = window_hashes(words.hash, window)
            anchors = window_anchors(words.hash, window, anchor) if len(whole) else hashes
            text, _ = _joined(words)
            size = np.r_[0, np.cumsum(words.end - words.start + 1)]
            out = []
            for i, lists in enumerate(batch.column(2).to_pylist()):
                lo, hi = int(words.first[i]), int(words.first[i + 1]) - window + 1
                if hi <= lo:
                    continue
                ours = np.isin(hashes[lo:hi], np.frombuffer(b"".join(lists), np.uint64))
                edge = np.flatnonzero(np.diff(np.r_[0, ours.astype(np.int8), 0]))
                for a, b in zip(edge[::2] + lo, edge[1::2] + lo):
                    out.append((batch.column(0)[i].as_py(), text[size[a]:size[b + window - 1] - 1], np.unique(anchors[a:b]).tobytes()))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
                                  ["first_doc", "passage", "anchors"])
    return run


def _each(column: str):
    """(id, packed hashes) to a row per hash."""
    def run(batches):
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            count = np.array([len(b) // 8 for b in blobs], np.int64)
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(blobs)), count))),
                                   pa.array(np.frombuffer(b"".join(blobs), np.int64))], [column, "anchor"])
    return run


def _phrases(source: Words, stored: list[bytes], anchor: int, phrase: int) -> ahocorasick.Automaton:
    """The first words of every ``anchor``-th stretch of each passage, with their length in characters."""
    automaton = ahocorasick.Automaton()
    for lo, hi in zip(source.first[:-1].tolist(), source.first[1:].tolist()):
        for k in range(lo, hi - anchor + 1, anchor):
            key = _text([b"", *stored[k:k + phrase], b""])
            automaton.add_word(key, len(key))
    automaton.make_automaton()
    return automaton


def _text(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "surrogateescape")


def _occurrences(automaton: ahocorasick.Automaton, words: Words, own: list[bytes]) -> np.ndarray:
    """How many phrases start at each word, over all documents of the batch."""
    hits = np.zeros(len(own), np.int64)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        text = _text([b"", *own[lo:hi], b""])
        found = list(automaton.iter(text))
        if found:
            ends, sizes = np.array(found).T
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            np.add.at(hits, lo + np.searchsorted(spaces, ends - sizes + 1), 1)
    return hits


def _cover(window: int, anchor: int, phrase: int):
    """The documents of a batch and the passages dealt to it: what of each document is covered."""
    def run(_, docs: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        words = Words(pa.array(docs["text"], pa.string()))
        covered = np.zeros(len(words.start), bool)
        whole = position_mask(words.first, window)
        if len(passages) and whole.any():
            source = Words(pa.array(passages["passage"], pa.binary()))
            stored = [bytes(source.data[a:b]) for a, b in zip(source.start, source.end)]
            own = [bytes(words.data[a:b]) for a, b in zip(words.start, words.end)]
            hits = np.r_[0, np.cumsum(_occurrences(_phrases(source, stored, anchor, phrase), words, own))]
            # Windows in which a phrase was found, and the passage window that each may equal.
            start = np.flatnonzero(whole & (hits[window - phrase + 1:len(whole) + window - phrase + 1] > hits[:len(whole)]))
            at = np.flatnonzero(position_mask(source.first, window))
            names, first = np.unique(window_hashes(source.hash, window)[at], return_index=True)
            at = at[first]
            mine = window_hashes(words.hash, window)[start]
            place = np.minimum(np.searchsorted(names, mine), len(names) - 1)
            earlier = passages["first_doc"].to_numpy()[text_of(source.first)[at[place]]] < docs["doc_id"].to_numpy()[text_of(words.first)[start]]
            start, place = (x[(names[place] == mine) & earlier] for x in (start, place))
            number: dict[bytes, int] = {}
            sid = np.array([number.setdefault(w, len(number)) for w in stored], np.int64)
            did = np.array([number.get(w, -1) for w in own], np.int64)
            ahead = np.arange(window)
            ends = np.zeros(len(own) + 1, np.int64)
            for k in range(0, len(start), 10_000):
                a, b = start[k:k + 10_000], at[place[k:k + 10_000]]
                same = a[(did[a[:, None] + ahead] == sid[b[:, None] + ahead]).all(1)]
                ends[same] += 1
                np.add.at(ends, same + window, -1)
            covered = np.cumsum(ends)[:-1] > 0
        past = np.r_[0, np.cumsum(covered)][words.first]
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("int64"), "n_words": words.counts, "kept_sha256": _digests(words, ~covered),
                             "n_removed": np.diff(past),
                             "covered": [np.packbits(covered[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:])]})
    return run


COVERED = "doc_id long, n_words long, kept_sha256 string, n_removed long, covered binary"


def repeated_words(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR, phrase: int = PHRASE,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, covered (a bit per word; null: none removed)."""
    if not phrase <= anchor <= window // 2:
        raise ValueError("a phrase must fit into an anchor, and an anchor into half a window")
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.cut(docs.mapInArrow(_read(window, anchor), "doc_id long, n_words long, kept_sha256 string, anchors binary"), "anchors", "zstd")
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    owned = rows.where("doc_id is not null and length(anchors) > 0").select("doc_id", "anchors")
    buckets = max(parts, total * 2 // (window - anchor + 2) // GROUP_HASHES)
    shared = shared_hashes(owned.mapInArrow(deal("anchors", buckets), SCHEMA), buckets)
    shared = scratch.cut(shared.select(F.col("owner").alias("doc_id"), F.array("hashes").alias("anchors")), "shared", "zstd")

    ids = shared.select("doc_id")
    n_ids = ids.count()
    some = docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    size = rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", "left_semi").agg(F.sum("n_words")).first()[0] or 0
    batches = max(parts, size // BATCH_WORDS)
    some = scratch.cut(some.join(shared, "doc_id").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "documents", "zstd")

    buckets = max(parts, size // GROUP_HASHES)
    windows = some.select("doc_id", "text", "anchors").mapInArrow(_windows(window, anchor, buckets), SCHEMA)
    confirmed = (windows.groupBy("bucket").applyInPandas(_confirm, "doc_id long, windows binary")
                 .groupBy("doc_id").agg(F.collect_list("windows").alias("windows")))
    passages = scratch.cut(some.select("doc_id", "text").join(confirmed, "doc_id")
                           .mapInArrow(_passages(window, anchor), "first_doc long, passage binary, anchors binary")
                           .withColumn("passage_id", F.monotonically_increasing_id()), "passages", "zstd")

    at = passages.select("passage_id", "anchors").mapInArrow(_each("passage_id"), "passage_id long, anchor long")
    seen = (some.select("batch", F.explode("anchors").alias("anchors")).mapInArrow(_each("batch"), "batch int, anchor long").distinct())
    dealt = at.join(seen, "anchor").select("passage_id", "batch").distinct().join(passages.drop("anchors"), "passage_id")
    done = scratch.cut(some.select("batch", "doc_id", "text").groupBy("batch").cogroup(
        dealt.select("batch", "first_doc", "passage").groupBy("batch")).applyInPandas(_cover(window, anchor, phrase), COVERED), "covered", "zstd")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "covered"]
    rest = rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", "left_anti")
    return done.select(*names).unionByName(rest.select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("binary").alias("covered")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_words(docs, Scratch(spark)).drop("covered")


OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + {WINDOW} - 1], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, list(pos) AS starts FROM k JOIN f USING (h) WHERE first < doc_id GROUP BY doc_id),
v AS (SELECT DISTINCT doc_id, pos + o AS pos FROM (SELECT doc_id, unnest(starts) AS pos FROM c), range({WINDOW}) r(o)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
q AS (SELECT p.doc_id, count(v.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.pos) FILTER (v.pos IS NULL), '') AS kept
      FROM p LEFT JOIN v ON p.doc_id = v.doc_id AND p.pos = v.pos GROUP BY p.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
