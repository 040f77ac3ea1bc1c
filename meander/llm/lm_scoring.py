"""Documents by the difference of two models' cross-entropies.

A target model (from documents of the wanted kind) and a background model
(from all documents) score every word; a document's score is the mean of the
differences of its words' losses, target minus background.  Low scores are
like the target.

The models match in everything but their counts: the same vocabulary and the
same smoothing.  The vocabulary is every word of the corpus; a word that it
lacks is the unknown one.  A word's probability after another one is their
bigram count, smoothed by its unigram probability.  Words and bigrams are
counted exactly (known by 64-bit hashes), all documents whole.

No table of counts is ever in one place.  Texts are cut into slices; a slice
sends its distinct bigrams and words with its counts to buckets by hash, packed
in one row for each bucket, and each bucket sends back the corpus's counts of
just these.  So what is gathered and sent follows the input, and no task holds
more than a slice or a bucket.

Cases: a text without words scores null with 0 words.  A null doc_id is scored
and never in the target.  Without target documents the target's model is the
vocabulary's even distribution.  Rows that repeat count every time.  An empty
table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from meander.llm.common import slices
from meander.llm.words import Words, mix
from meander.scratch import Scratch

SMOOTHING, EVEN = 50.0, 1.0  # pseudo-counts of the unigram share in a bigram's, and of each word in a unigram's
# Text bytes of a slice, and of the corpus for each bucket.
PACK_BYTES, BUCKET_BYTES, BROADCAST_IDS = 14 << 20, 12 << 20, 500_000
_BEGIN = np.uint64(0x1234567)
_SLICE = "slice long, ids binary, known binary, counts binary, wanted binary, names binary, tokens binary"
_COUNTS = ("pair_n", "pair_t", "word_n", "word_t", "end_n", "end_t")
_SENT = "bucket long, slice long, pairs binary, words binary, " + ", ".join(f"{c} binary" for c in _COUNTS)
_BACK = "slice long, bucket long, " + ", ".join(f"{c} binary" for c in _COUNTS)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, which packs well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _values(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _narrow(counts: np.ndarray) -> np.ndarray:
    """In as few bytes as the largest count needs."""
    most = int(counts.max(initial=0))
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def _sized(counts: np.ndarray) -> bytes:
    """Counts with the size of each before them."""
    return bytes([counts.itemsize]) + _planes(counts)


def _unsized(data: bytes) -> np.ndarray:
    return _values(data[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data[0]])


def _steps(ascending: np.ndarray) -> bytes:
    return _planes(np.diff(ascending, prepend=np.uint64(0)))


def _ascending(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data, np.uint64), dtype=np.uint64)


def _cuts(ascending: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins: a range of hashes each, so that buckets in order are hashes in order."""
    bucket = ((ascending >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text, wanted."""
    ids = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", F.col("__id").isNotNull().cast("int").alias("wanted"))


def _slice(batches):
    """Texts to slices: their documents, distinct words by hash, and each word's number among these."""
    at = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(slices(batches, "text", PACK_BYTES)):
        parts = [(w.hash, w.counts) for w in (Words(part.column(1), lower=True) for part in slices([batch], "text"))]
        names, tokens = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        ids = batch.column(0)
        row = [at + number, _planes(np.asarray(ids.fill_null(0), np.int64)), np.asarray(ids.is_valid()).tobytes(),
               _planes(np.concatenate([n for _, n in parts]).astype(np.int64)), np.asarray(batch.column(2)).astype(np.int8).tobytes(),
               _steps(names), _planes(tokens.astype(np.int32))]
        yield pa.record_batch([pa.array([x]) for x in row], ["slice", "ids", "known", "counts", "wanted", "names", "tokens"])


class _Slice:
    """names: sorted hashes of its words; tokens: the place of each of its words there; pairs, pair: likewise for bigrams."""

    def __init__(self, row):
        self.counts, self.names = _values(row["counts"], np.int64), _ascending(row["names"])
        self.tokens = _values(row["tokens"], np.int32)
        first = np.r_[0, np.cumsum(self.counts)]
        some = self.counts > 0
        self.start, self.last = first[:-1][some], first[1:][some] - 1
        self.owner = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.wanted = np.frombuffer(row["wanted"], np.int8)[self.owner]
        word = self.names[self.tokens]
        before = np.r_[_BEGIN, word[:-1]][:len(word)]
        before[self.start] = _BEGIN  # a text begins with a word of its own
        word ^= mix(before, 61)
        self.pairs, pair = np.unique(mix(word), return_inverse=True)
        self.pair = pair.astype(np.int32)

    def own_counts(self) -> list[np.ndarray]:
        """By the names of _COUNTS: of bigrams, words, and words that end a text, in all and in the target."""
        count = lambda x, n: _narrow(np.bincount(x, minlength=n))
        at, last = self.wanted == 1, self.last
        p, w = len(self.pairs), len(self.names)
        return [count(self.pair, p), count(self.pair[at], p), count(self.tokens, w), count(self.tokens[at], w),
                count(self.tokens[last], w), count(self.tokens[last[at[last]]], w)]


def _send(buckets: int, counts: bool, asks: bool):
    """What a slice counts, one row for each bucket.  Without ``counts`` its own are 0, without ``asks`` it wants no answer."""
    def run(batches):
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                own = _Slice(row)
                p, w = _cuts(own.pairs, buckets), _cuts(own.names, buckets)
                some = np.flatnonzero((np.diff(p) > 0) | (np.diff(w) > 0))
                values = [x if counts else np.zeros(len(x), np.uint8) for x in own.own_counts()]
                cut = lambda x, at, f: pa.array([f(x[at[k]:at[k + 1]]) for k in some], pa.binary())
                yield pa.record_batch([pa.array(some, pa.int64()), pa.array(np.full(len(some), row["slice"] if asks else -1), pa.int64()),
                                       cut(own.pairs, p, _steps), cut(own.names, w, _steps),
                                       *[cut(x, p if k < 2 else w, _sized) for k, x in enumerate(values)]],
                                      ["bucket", "slice", "pairs", "words", *_COUNTS])
    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of a bucket's counts, for each slice those of what it has sent, in its order."""
    asks = (pdf["slice"] >= 0).to_numpy()
    out = {"slice": pdf["slice"][asks], "bucket": pdf["bucket"][asks]}
    for keys, columns in (("pairs", _COUNTS[:2]), ("words", _COUNTS[2:])):
        size = [len(b) // 8 for b in pdf[keys]]
        at = np.r_[0, np.cumsum(size)].tolist()
        names = np.empty(at[-1], np.uint64)
        for b, lo, hi in zip(pdf[keys], at, at[1:]):
            names[lo:hi] = _ascending(b)
        names, back = np.unique(names, return_inverse=True)
        n, back = len(names), back.astype(np.int32)
        del names
        for c in columns:
            total = np.zeros(n, np.int64)
            for b, lo, hi in zip(pdf[c], at, at[1:]):
                total[back[lo:hi]] += _unsized(b)  # no hash twice in one slice
            total = _narrow(total)
            out[c] = [_sized(total[back[lo:hi]]) for lo, hi, a in zip(at, at[1:], asks) if a]
    return pd.DataFrame(out)


def _send_words(buckets: int):
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                names = _ascending(data)
                at = _cuts(names, buckets)
                some = np.flatnonzero(np.diff(at))
                yield pa.record_batch([pa.array(some, pa.int64()), pa.array([_steps(names[at[k]:at[k + 1]]) for k in some], pa.binary())], ["bucket", "words"])
    return run


def _different(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [len(np.unique(np.concatenate([_ascending(b) for b in pdf["words"]])))]})


def _totals(batches):
    for batch in batches:
        for row in batch.to_pylist():
            counts, own = _values(row["counts"], np.int64), np.frombuffer(row["wanted"], np.int8) == 1
            yield pa.record_batch([pa.array([x]) for x in (counts[own].sum(), counts.sum(), (counts[own] > 0).sum(), (counts > 0).sum())],
                                  ["words_t", "words_n", "texts_t", "texts_n"])


@dataclass(frozen=True)
class Models:
    """The documents, as slices, that the two models (target, background) are the counts of, and what these add up to."""
    docs: DataFrame
    slices: DataFrame
    buckets: int
    vocabulary: int
    words: tuple[int, int]
    texts: tuple[int, int]  # with words


def _losses(own: _Slice, answers: pd.DataFrame, vocabulary: int, words: tuple[int, int], texts: tuple[int, int]):
    """Each model's loss of each word, in nats, one model after the other."""
    answers = answers.sort_values("bucket")
    found = lambda c: np.concatenate([_unsized(b) for b in answers[c]] or [np.zeros(0, np.uint8)])
    before = np.r_[0, own.tokens[:-1]][:len(own.tokens)]
    for model, name in enumerate("tn"):
        count, pair = found(f"word_{name}").astype(np.int64), found(f"pair_{name}")[own.pair]
        share = (count + EVEN) / (words[model] + EVEN * (vocabulary + 1))
        context = (count - found(f"end_{name}"))[before]
        context[own.start] = texts[model]
        yield -np.log((pair + SMOOTHING * share[own.tokens]) / (context + SMOOTHING))


def fit(docs: DataFrame, target_ids: DataFrame, scratch: Scratch | None = None) -> Models:
    """docs: doc_id, text; target_ids: doc_id."""
    spark = docs.sparkSession
    cut = (scratch or Scratch(spark)).cut(_marked(docs, target_ids).mapInArrow(_slice, _SLICE), "slices", "zstd")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    different = cut.select("names").mapInArrow(_send_words(buckets), "bucket long, words binary").groupBy("bucket").applyInPandas(_different, "n long")
    total = cut.select("counts", "wanted").mapInArrow(_totals, "words_t long, words_n long, texts_t long, texts_n long")
    sums = [int(x or 0) for x in total.agg(*[F.sum(c) for c in total.columns]).first()]
    return Models(docs, cut, buckets, int(different.agg(F.sum("n")).first()[0] or 0), tuple(sums[:2]), tuple(sums[2:]))


def score(docs: DataFrame, models: Models, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a word), score (their difference)."""
    buckets, vocabulary, words, texts = models.buckets, models.vocabulary, models.words, models.texts
    if docs is models.docs:
        own = models.slices
        sent = own.mapInArrow(_send(buckets, True, True), _SENT)
    else:
        own = (scratch or Scratch(docs.sparkSession)).cut(docs.select("doc_id", "text", F.lit(0).alias("wanted")).mapInArrow(_slice, _SLICE), "slices", "zstd")
        sent = models.slices.mapInArrow(_send(buckets, True, False), _SENT).unionByName(own.mapInArrow(_send(buckets, False, True), _SENT))
    answers = sent.groupBy("bucket").applyInPandas(_answer, _BACK)

    def run(slice_: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        row = slice_.iloc[0]
        own = _Slice(row)
        n = len(own.counts)
        target, background = (np.where(own.counts > 0, np.bincount(own.owner, x, n) / np.maximum(own.counts, 1), np.nan)
                              for x in _losses(own, back, vocabulary, words, texts))
        ids = pd.Series(_values(row["ids"], np.int64), dtype="Int64").mask(~np.frombuffer(row["known"], bool))
        nullable = lambda x: pd.Series(x).astype("Float64").mask(own.counts == 0)
        return pd.DataFrame({"doc_id": ids, "n_tokens": own.counts, "target_loss": nullable(target), "background_loss": nullable(background),
                             "score": nullable(target - background)})
    return own.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels.where("quality = 1 and toxic = 0").select("doc_id")))
