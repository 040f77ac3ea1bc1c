"""Quality of texts by Bradley-Terry pairwise ranking.

P(text a is preferred to text b) = sigmoid(w x_a - w x_b).  Preference pairs are
labelled texts of either kind, the one of good quality preferred; the weights
minimize the logistic loss on the differences of the pairs' features, with a
small L2 penalty.  A text's strength w x needs no partner, so every text gets
one.  The cut between good and bad is a quantile of the labelled texts'
strengths, the one that tells the two kinds apart best; the score is a logistic
curve through ``CUT`` at this cut.

Features, of the whole text: for each shape of a word (runs of letters of one
case, of digits, and of one other character shrink to one) the root of its share
of the words, shapes told apart by ``SHAPES`` classes; and a few shares: words
equal to the one before, different words, lines seen before, letters, upper
case, digits, ends of sentences, long words, and the length.

Fitted on every labelled text, with ``PAIRS`` partners for each.  Labelled texts are
dealt by the hash of doc_id to blocks of about ``BLOCK``; partners are of the same
block, each block is fitted in one task, and the weights are the mean of the blocks'
weights by their numbers of pairs.  A kind with too few texts for ``LEAST`` in a block is
repeated in several.  The cut's quantiles and shares are counted over all labelled texts,
with strengths put in order by Spark.

Cases: a text that is null or without words has no features but the length and
gets a score as any other.  Without labelled texts of both kinds every score is
0.5.  Labels that are null are not used; of several labels of a document the
larger one counts, and of several texts each is an example.  A null doc_id has
no label.  An empty table gives an empty one.  Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meander.llm.common import binaries, slices
from meander.llm.words import Words, range_hashes, text_of
from meander.scratch import Scratch

SHAPES, PAIRS = 1 << 12, 8
BLOCK, LEAST = 8000, 20
PENALTY, STEPS, CUT, SEED = 1e-4, 400, 0.3, 42
QUANTILES = 1000
# Up to this many labels are sent to every task; beyond, texts move to them.
SENT_LABELS = 500_000

_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a"):ord("z") + 1] = ord("a")
_KIND[ord("A"):ord("Z") + 1] = ord("A")
_KIND[ord("0"):ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")
SHARES = ("again", "different", "seen_lines", "letters", "upper", "digits", "sentences", "long", "length")


@dataclass(frozen=True)
class Ranking:
    """weights: of the shapes' classes, then of SHARES; cut: the strength where a text counts as good."""
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float


def _by_text(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return sums[first[1:]] - sums[first[:-1]]


def _seen_lines(words: Words) -> np.ndarray:
    """The share of each text's lines that equal an earlier one of it."""
    out = np.zeros(len(words.begin))
    ends = np.flatnonzero(words.data == 10)
    start = np.unique(np.r_[words.begin, ends + 1])
    stop = np.r_[start[1:], len(words.data)]
    text = np.searchsorted(words.begin, start, "right") - 1
    some = start < words.stop[text] if len(text) else np.zeros(0, bool)
    start, stop, text = start[some], np.minimum(stop[some], words.stop[text[some]]), text[some]
    line = range_hashes(words.data, start, stop)
    order = np.lexsort((line, text))
    again = (line[order][1:] == line[order][:-1]) & (text[order][1:] == text[order][:-1])
    np.add.at(out, text[order][1:][again], 1)
    return out / np.maximum(1, np.bincount(text, minlength=len(out)))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, class, value) of the shapes that texts hold, and a row of SHARES for each text."""
    kind, owner, n = _KIND[words.data], text_of(words.first), len(words.counts)
    many = np.maximum(1, words.counts)
    # A word's shape: its bytes but those of the same kind as the one before.
    new = np.r_[True, kind[1:] != kind[:-1]][:len(kind)]
    new[words.start] = True
    past = np.r_[0, np.cumsum(new)]
    classes = (range_hashes(kind[new], past[words.start], past[words.end]) & np.uint64(SHAPES - 1)).astype(np.int64)
    both, count = np.unique(owner * SHAPES + classes, return_counts=True)
    text = both // SHAPES
    value = np.sqrt(count / many[text])
    within = np.r_[False, owner[1:] == owner[:-1]][:len(owner)]
    again = within & np.r_[False, words.hash[1:] == words.hash[:-1]][:len(owner)]
    order = np.lexsort((words.hash, owner))
    new_word = np.r_[True, (words.hash[order][1:] != words.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])][:len(owner)]
    different = np.bincount(owner[order][new_word], minlength=n)
    size = np.maximum(1, words.stop - words.begin)
    byte_sum = np.r_[0, np.cumsum(kind == ord("a"))], np.r_[0, np.cumsum(kind == ord("A"))], np.r_[0, np.cumsum(kind == ord("0"))]
    small, upper, digits = (s[words.stop] - s[words.begin] for s in byte_sum)
    ends = np.isin(words.data[words.end - 1], np.frombuffer(b".!?", np.uint8)) if len(words.end) else np.zeros(0, bool)
    shares = np.stack([
        _by_text(words.first, again) / many, different / np.sqrt(many), _seen_lines(words),
        (small + upper) / size, upper / np.maximum(1, small + upper), digits / size, _by_text(words.first, ends) / many,
        _by_text(words.first, words.end - words.start > 20) / many, np.log1p(words.counts)], 1)
    return text, both % SHAPES, value, shares


def pairs_of(quality: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Preferred and other text of preference pairs: ``pairs`` partners of the other kind for every text."""
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    rng = np.random.default_rng(seed)
    return (np.r_[np.repeat(good, pairs), rng.choice(good, len(bad) * pairs)],
            np.r_[rng.choice(bad, len(good) * pairs), np.repeat(bad, pairs)])


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> np.ndarray:
    """Weights that minimize the mean of log(1 + exp(-(w x_better - w x_worse))) + penalty / 2 |w| ** 2."""
    n, m = len(x), len(better)
    direction = np.random.default_rng(SEED).standard_normal(x.shape[1])
    back = lambda g: x.T @ (np.bincount(better, g, n) - np.bincount(worse, g, n))
    for _ in range(20):
        s = x @ direction
        direction = back(s[better] - s[worse])
        most = np.linalg.norm(direction)
        direction /= max(most, 1e-12)
    rate = 1 / (0.25 * most / m + penalty)
    w = np.zeros(x.shape[1])
    ahead, pace = w, 1.0
    for _ in range(steps):
        s = x @ ahead
        wrong = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -500, 500)))
        new = ahead + rate * (back(wrong) / m - penalty * ahead)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    return w


def best_quantile(strength: np.ndarray, quality: np.ndarray, weight: np.ndarray) -> float:
    """The quantile of the strengths with the greatest mean share of right answers of the two kinds; the middle one of equals."""
    order = np.argsort(strength, kind="stable")
    strength, quality, weight = strength[order], quality[order], weight[order]
    mass = np.cumsum(weight) / weight.sum()
    at = np.clip(np.searchsorted(mass, (np.arange(QUANTILES - 1) + 1) / QUANTILES), 0, len(strength) - 2)
    cuts = np.unique((strength[at] + strength[at + 1]) / 2)
    good, bad = strength[quality == 1], strength[quality == 0]
    right = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    best = cuts[right >= right.max() - 1e-12]
    return float((best[0] + best[-1]) / 2)


def _described(batches):
    for batch in slices(batches, "text"):
        text, classes, value, shares = features(Words(batch.column(0)))
        at = np.searchsorted(text, np.arange(batch.num_rows + 1))
        yield pa.record_batch([batch.column(1), batch.column(2), binaries(classes.astype(np.int32), at), binaries(value.astype(np.float32), at),
                               binaries(shares.ravel(), np.arange(batch.num_rows + 1) * len(SHARES))],
                              ["blocks", "quality", "classes", "value", "shares"])


def _unpacked(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, class, value) and the rows of SHARES of described texts."""
    packed = lambda name, kind: [np.frombuffer(b, kind) for b in table.column(name).to_pylist()]
    classes = packed("classes", np.int32)
    text = np.repeat(np.arange(len(classes)), [len(c) for c in classes])
    whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return (text, whole(classes, np.int32), whole(packed("value", np.float32), np.float32),
            whole(packed("shares", np.float64), np.float64).reshape(-1, len(SHARES)))


def _fit_block(table: pa.Table) -> pa.Table:
    """(class, weight, pairs) of a block, for features that aren't scaled; SHARES come after the shapes' classes."""
    # The same order whatever the partitions, so that reruns agree.
    table = table.sort_by([(c, "ascending") for c in ("quality", "shares", "classes", "value")])
    y = np.asarray(table.column("quality"), np.int64)
    if not len(y) or y.min() == y.max():
        return _WEIGHTS.empty_table()
    text, classes, value, shares = _unpacked(table)
    used, at = np.unique(classes, return_inverse=True)
    x = np.zeros((len(y), len(used) + len(SHARES)))
    x[text, at] = value
    scale = shares.std(0) + 1e-6
    x[:, len(used):] = (shares - shares.mean(0)) / scale
    better, worse = pairs_of(y)
    weights = fit_pairs(x, better, worse)
    weights[len(used):] /= scale
    return pa.table([pa.array(np.r_[used, SHAPES + np.arange(len(SHARES))], pa.int32()), pa.array(weights),
                     pa.array(np.full(len(weights), len(better)), pa.int64())], schema=_WEIGHTS)


_WEIGHTS = pa.schema([("class", pa.int32()), ("weight", pa.float64()), ("pairs", pa.int64())])


def _labelled(docs: DataFrame, labels: DataFrame, block: int, doc_id: str, text: str, quality: str) -> DataFrame:
    """Every labelled text's features, with the blocks it is dealt to."""
    one = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(quality).alias("q")).where("id is not null and q is not null")
           .groupBy("id").agg(F.max((F.col("q") > 0).cast("int")).alias("quality")))
    total = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    many = max(1, -(-sum(total.values()) // block))
    copies = {k: min(many, -(-many * LEAST // max(1, total.get(k, 0)))) for k in (0, 1)}
    dealt = F.transform(F.sequence(F.lit(0), F.when(F.col("quality") == 1, copies[1]).otherwise(copies[0]) - 1),
                        lambda i: F.pmod(F.xxhash64("id") + i, F.lit(many)).cast("int"))
    one = one.withColumn("blocks", dealt)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    met = texts.join(F.broadcast(one) if sum(total.values()) <= SENT_LABELS else one, "id").select("text", "blocks", "quality")
    return met.mapInArrow(_described, "blocks array<int>, quality int, classes binary, value binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text",
        quality: str = "quality") -> Ranking | None:
    """The ranking, from all labelled texts; None if a kind has none."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.cut(_labelled(docs, labels, block, doc_id, text, quality), "labelled")
    dealt = found.withColumn("block", F.explode("blocks")).drop("blocks")
    fitted = scratch.cut(dealt.groupBy("block").applyInArrow(lambda t: _fit_block(t.drop_columns(["block"])), "class int, weight double, pairs long"), "fitted")
    # A decimal's sum doesn't depend on the order of its parts.
    sums = fitted.groupBy("class").agg(F.sum((F.col("weight") * F.col("pairs")).cast("decimal(38,15)")).cast("double").alias("sum"),
                                       F.sum("pairs").alias("pairs")).collect()
    if not sums:
        return None
    # Every block has the shares, so the greatest sum of pairs is that of all blocks.
    pairs, weights = max(r["pairs"] for r in sums), np.zeros(SHAPES + len(SHARES))
    for r in sums:
        weights[r["class"]] = r["sum"] / pairs
    model = Ranking(weights, np.zeros(len(SHARES)), np.ones(len(SHARES)), 0.0)
    return Ranking(model.weights, model.mean, model.scale, _best_cut(found, model, scratch))


def _best_cut(found: DataFrame, model: Ranking, scratch: Scratch) -> float:
    """``best_quantile`` of all texts: their strengths are numbered in order, and only those at quantiles come here."""
    def run(batches):
        for batch in batches:
            text, classes, value, shares = _unpacked(batch)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("quality")),
                                   pa.array(_strength(model, text, classes, value, shares))], ["quality", "s"])
    each = found.mapInArrow(run, "quality int, s double").groupBy("s").agg(
        F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    placed = scratch.cut(each.repartitionByRange("s").sortWithinPartitions("s").withColumn(
        "at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "placed")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    sums = parts.select("part", *[F.coalesce(F.sum(c).over(before(Window.orderBy("part"))), F.lit(0)).alias(f"{c}0") for c in "gb"])
    inner = before(Window.partitionBy("part").orderBy("at"))
    rows = placed.join(F.broadcast(sums), "part").select("s", "good", "bad", *[
        (F.col(f"{c}0") + F.coalesce(F.sum(n).over(inner), F.lit(0))).alias(c) for c, n in (("g", "good"), ("b", "bad"))])
    all_good, all_bad = parts.agg(F.sum("g"), F.sum("b")).first()
    n = all_good + all_bad
    ranks = np.clip(-(-(np.arange(QUANTILES - 1) + 1) * n // QUANTILES) - 1, 0, n - 2)
    # A row stands at ranks from ``first`` to ``past``; the quantiles up to a rank follow from it, so no row is held against each.
    rows = rows.withColumn("first", F.col("g") + F.col("b")).withColumn("past", F.expr("first + good + bad"))
    at_rank = (F.expr(f"past * {QUANTILES} div {n} > first * {QUANTILES} div {n}")
               | F.expr(f"(past - 1) * {QUANTILES} div {n} > greatest(first - 1, 0) * {QUANTILES} div {n}") | (F.col("past") >= n - 1))
    rows = rows.where(at_rank).orderBy("s").collect()
    s, g, b = (np.array([r[c] for r in rows]) for c in ("s", "g", "b"))
    low = np.searchsorted(g + b, ranks, "right") - 1
    high = np.searchsorted(g + b, ranks + 1, "right") - 1
    # What stands before the upper one is below the cut; of equal ones, what stands before both.
    right = 1 - g[high] / all_good + b[high] / all_bad
    cuts = (s[low] + s[high]) / 2
    best = np.unique(cuts[right >= right.max() - 1e-12])
    return float((best[0] + best[-1]) / 2)


def strength(model: Ranking, words: Words) -> np.ndarray:
    return _strength(model, *features(words))


def _strength(model: Ranking, text: np.ndarray, classes: np.ndarray, value: np.ndarray, shares: np.ndarray) -> np.ndarray:
    return (np.bincount(text, value * model.weights[classes], len(shares))
            + (shares - model.mean) / model.scale @ model.weights[SHAPES:])


def score(docs: DataFrame, model: Ranking | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row: 0 to 1, ``CUT`` where good begins."""
    base = np.log(CUT / (1 - CUT))

    def run(batches):
        for batch in slices(batches, "text"):
            values = np.full(batch.num_rows, 0.5)
            if model is not None:
                values = 1 / (1 + np.exp(-np.clip(strength(model, Words(batch.column(1))) - model.cut + base, -500, 500)))
            yield pa.record_batch([batch.column(0), pa.array(values)], ["doc_id", "score"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """One document of five, by its number; its label is not learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
