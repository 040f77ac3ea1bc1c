"""Periodic runs of words, found while words are appended, by dyadic square catchers.

A run is a stretch of words with smallest period p that no neighbouring word
extends, at least ``least`` words and three periods long.

Catchers.  Whenever a text's words fill another block of 2 ** k words (blocks
are aligned to their size, from the text's start), that block's catcher is on
the watch for a copy of the block, whose last word comes d words after the
block's, 2 ** k <= d < 2 ** (k + 1).  So each level has one catcher on the watch
at a time; the lowest level also has one for all smaller d.  A run of period d
holds a block of its level and the copy one period on, so none is missed.

Comparisons.  A caught copy opens a comparison of the two suffixes, d words
apart: back once to where they begin to agree, then on with each appended word
until two words differ.  From the d-th agreeing word on each word completes a
square; these merge into one run, which ends with the comparison.  Copies at
multiples of a run's period inside the run are the run again and open nothing;
its period is caught before any multiple of it is.

Words are appended in pieces, for which all of this is done at once; the state
between two pieces is the list of comparisons that still agree.  Catchers
compare hashes of blocks, comparisons 64-bit hashes of words.

Cases: a null text has no words, no runs, and collapses to the empty text.  Rows
that repeat are each a text of their own.  An empty table gives an empty one.
Of ``docs`` only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meander.llm.common import slices
from meander.llm.words import Words, powers, text_of

LEAST_WORDS, LEAST_POWER = 24, 3
# Words that are appended at a time.
PIECE_WORDS = 1 << 14
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lowest_level(least: int) -> int:
    """The largest blocks of which every run with a period below 2 ** (level + 1) holds one and its copy."""
    # A run of period p has max(least - p, 2 p) words that agree with those p before: 2 / 3 least at the fewest.
    return max(0, ((2 * least // 3 + 1) // 2).bit_length() - 1)


def catch(hashes: np.ndarray, prefix: np.ndarray, place: np.ndarray, lo: int, hi: int, lowest: int) -> np.ndarray:
    """What the catchers report as words lo .. hi - 1 are appended: rows (last word of the copy, distance, block size).

    ``place`` is each word's number in its text, ``prefix`` the running sum of the powered hashes.
    """
    done = place[lo:hi] + 1  # words of the text so far
    power = powers(len(hashes))
    found = []
    for level in range(lowest, max(lowest + 1, int(done.max(initial=0)).bit_length())):
        size = 1 << level
        for back in ((1, 0) if level == lowest else (1,)):
            at = np.flatnonzero(done >= (1 + back) * size)
            end = ((done[at] >> level) - back) << level
            distance = done[at] - end
            at += lo
            some = distance > 0
            at, distance = at[some], distance[some]
            copy = prefix[at + 1] - prefix[at + 1 - size]
            before = at - distance
            block = prefix[before + 1] - prefix[before + 1 - size]
            equal = np.flatnonzero(block * power[distance] == copy)
            found.append(np.stack([at[equal], distance[equal], np.full(len(equal), size)], 1))
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


@dataclass
class Text:
    """What is known of one text, whose words begin at ``begin`` of the hashes, after some of them."""
    hashes: np.ndarray
    begin: int
    least: int = LEAST_WORDS
    agreeing: list[tuple[int, int]] = field(default_factory=list)  # (start, period) of the open comparisons
    runs: list[tuple[int, int, int]] = field(default_factory=list)

    def append(self, lo: int, hi: int, caught: np.ndarray) -> None:
        """Words lo .. hi - 1 come after those known, and their catches."""
        ahead, self.agreeing = self.agreeing, []
        for start, period in ahead:
            caught = self._take(start, self._agree(lo, period, hi), period, hi, caught)
        while len(caught):
            last, distance, _ = caught[0].tolist()
            caught = caught[1:]
            if self.hashes[last] == self.hashes[last - distance]:
                start = self._begin(last, distance)
                caught = self._take(start, self._agree(last + 1, distance, hi), distance, hi, caught)

    def close(self) -> None:
        """No more words come."""
        end = len(self.hashes)
        for start, period in self.agreeing:
            self._end(start, end, period)
        self.agreeing = []

    def _take(self, start: int, stop: int, period: int, hi: int, caught: np.ndarray) -> np.ndarray:
        """Note a comparison that agrees up to ``stop``; the catches that aren't part of it."""
        if stop == hi:
            self.agreeing.append((start, period))
        else:
            self._end(start, stop, period)
        last, distance, size = caught.T
        inside = (last < stop) & (last - distance - size + 1 >= start) & (distance % period == 0)
        return caught[~inside]

    def _end(self, start: int, stop: int, period: int) -> None:
        if stop - start >= max(self.least, LEAST_POWER * period):
            self.runs.append((start - self.begin, stop - start, period))

    def _agree(self, at: int, period: int, hi: int) -> int:
        """The first word from ``at`` on that differs from the one a period before, or ``hi``."""
        h, step = self.hashes, 64
        while at < hi:
            to = min(hi, at + step)
            differ = np.flatnonzero(h[at:to] != h[at - period:to - period])
            if len(differ):
                return at + int(differ[0])
            at, step = to, 2 * step
        return hi

    def _begin(self, at: int, period: int) -> int:
        """Where the stretch of this period that holds word ``at`` begins."""
        h, step, first = self.hashes, 64, self.begin + period
        while at > first:
            to = max(first, at - step)
            differ = np.flatnonzero(h[to:at] != h[to - period:at - period])
            if len(differ):
                return to + int(differ[-1]) + 1 - period
            at, step = to, 2 * step
        return self.begin


def find_runs(hashes: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, piece: int = PIECE_WORDS) -> list[list[tuple[int, int, int]]]:
    """Per text, whose words are first[i] .. first[i + 1] - 1, its runs (start, length, period) in order."""
    owner = text_of(first)
    place = np.arange(len(hashes)) - first[owner] if len(hashes) else np.zeros(0, np.int64)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=prefix[1:])
    lowest = lowest_level(least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    texts: dict[int, Text] = {}
    for lo in range(0, len(hashes), piece):
        hi = min(lo + piece, len(hashes))
        caught = catch(hashes, prefix, place, lo, hi, lowest)
        of = owner[caught[:, 0]]
        concerned = np.union1d(of, [t for t, state in texts.items() if state.agreeing]).astype(np.int64)
        cuts = np.searchsorted(of, np.r_[concerned, concerned[-1:] + 1])
        for text, a, b in zip(concerned.tolist(), cuts, np.searchsorted(of, concerned, "right")):
            begin, end = int(first[text]), int(first[text + 1])
            state = texts.setdefault(text, Text(hashes[:end], begin, least))
            state.append(max(lo, begin), min(hi, end), caught[a:b])
            out[text] = state.runs
        for text in [t for t in texts if first[t + 1] <= hi]:
            texts.pop(text).close()
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def beyond_first_period(first: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Per word whether a run holds it after the run's first period."""
    flat = np.array([(first[i] + s, n, p) for i, own in enumerate(runs) for s, n, p in own], np.int64).reshape(-1, 3)
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(edge, flat[:, 0] + flat[:, 2], 1)
    np.add.at(edge, flat[:, 0] + flat[:, 1], -1)
    return np.cumsum(edge)[:-1] > 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    first = np.r_[0, np.cumsum(keep)][words.first]
    start, size = words.start[keep], (words.end - words.start)[keep] + 1
    last = first[1:][first[1:] > first[:-1]] - 1
    size[last] -= 1  # no space after the last word
    past = np.r_[0, np.cumsum(size)]
    data = np.full(int(past[-1]), 32, np.uint8)
    is_letter = np.ones(len(data), bool)
    spaces = np.ones(len(size), bool)
    spaces[last] = False
    is_letter[past[1:][spaces] - 1] = False
    at = np.repeat(start - past[:-1], size) + np.arange(len(data))
    data[is_letter] = words.data[at[is_letter]]
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(past[first].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def collapse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the text without later periods of its runs."""
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            runs = find_runs(words.hash, words.first, least)
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.array(words.counts), pa.ListArray.from_arrays(offsets, each),
                                   joined(words, ~beyond_first_period(words.first, runs))], ["doc_id", "n_words", "runs", "collapsed"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals; null if there is none."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: in about a tenth of the documents the words from some place on repeat the first few of these."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    hit = docs.select("doc_id", "text", h.alias("h")).withColumns({
        "g": F.expr("h div 10"), "words": F.when(F.col("h") % 10 == 0, words)})
    n = F.size("words").cast("long")
    at = hit.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("""concat_ws(' ', slice(words, 1, cast(a AS int)), slice(flatten(array_repeat(
        slice(words, cast(a AS int) + 1, cast(p AS int)), cast((n - a + p - 1) div p AS int))), 1, cast(n - a AS int)))""")
    return at.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = collapse(with_planted_runs(docs))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
