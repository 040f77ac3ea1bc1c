"""Harmonic packing of token sequences.

A document of t tokens is of class k if it is in (capacity / (k + 1),
capacity / k], and a sequence of class k takes k of them, whole, so it is
full but for less than capacity / (k + 1).  Documents longer than a sequence
and those of the last classes (k above ``CLASSES``) are loose: they are cut to
fill exactly what the sequences leave open, and make up sequences by
themselves where there are more of them.  Every task fills the sequences of its own
documents and keeps at most ``WAITING`` that wait for loose tokens; the
documents of one more become loose themselves.  At its end a task's open
sequences are dissolved in the same way, and less than one sequence of tokens is
left over.  These are cut into pieces whose lengths are classes themselves (the
capacity's halves down to 64, and every length below 64), brought together,
ranked class by class, and put into sequences of one class.  The last pieces of a
class, too few for a sequence, are cut into runs whose lengths are powers of
two, which need no padding.

Cases: a null or empty text is the end token alone.  Rows with the same doc_id
and text are rows of their own.  Texts of any length are taken whole.  An empty
table gives an empty one.  Task-wide arrays are bounded by ``SLICE_BYTES`` of
text or one text, whichever is more.
"""

from __future__ import annotations

import os
from collections import defaultdict, deque
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from meander.llm.common import running_sums, slices
from meander.llm.words import range_hashes
from meander.scratch import Scratch

CAPACITY, LEAST_HALF, END = 2048, 64, 1
TOKENIZER = "byte_bpe_50k.json"
# Pieces of text whose ids a worker keeps (beyond that it starts anew), and that it gathers before it sorts them in.
MEMORY, FRESH = 3_000_000, 100_000
_TASK = 1 << 32
# Documents of a sequence at most, beyond which they are loose; sequences of a task that wait for loose tokens.
CLASSES, WAITING = 32, 64


def token_classes(capacity: int = CAPACITY, least: int = LEAST_HALF) -> list[int]:
    halves = []
    while capacity >= least:
        halves.append(capacity)
        capacity //= 2
    return halves + list(range(halves[-1] - 1, 0, -1))


class Encoder:
    """Ids of whole batches.

    A byte-level BPE splits a text before it merges, and never across the space
    or line break that stands alone between two other characters.  Pieces
    between such places are encoded once and remembered.  A piece in plain
    letters is encoded from the tokenizer's own merges by a faster library with
    the same result; pieces with a special token go through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _same_by_ranks(path)
        self._forget()

    def _forget(self):
        self.hashes, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.fresh: list[tuple] = []
        self.n_fresh = 0

    def _remember(self, hashes, count, ids):
        self.fresh.append((hashes, count, ids))
        self.n_fresh += len(hashes)
        if self.n_fresh < FRESH:
            return
        if len(self.hashes) + self.n_fresh > MEMORY:
            held, size = self.fresh, self.n_fresh
            self._forget()
            self.fresh, self.n_fresh = held, size
        names, count, ids = (np.concatenate(x) for x in zip(*self.fresh))
        first = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        names, where = np.unique(np.r_[self.hashes, names], return_index=True)
        self.first, self.count = np.r_[self.first, first][where], np.r_[self.count, count][where].astype(np.int32)
        self.hashes, self.ids = names, np.concatenate([self.ids, ids])
        self.fresh, self.n_fresh = [], 0

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for k in range(0, len(pieces), 4096) for e in self.tokenizer.encode_batch_fast(
                [p.decode("utf-8") for p in pieces[k:k + 4096]], add_special_tokens=False)]
        whole = b"\0".join(pieces)
        odd = any(t in whole for t in self.special)
        encode, slow = self.fast, self.tokenizer
        return [slow.encode(t, add_special_tokens=False).ids if odd and any(x.decode() in t for x in self.special) else encode(t)
                for t in (p.decode("utf-8") for p in pieces)]

    def encode(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin."""
        # Only plain ASCII on both sides: some longer characters count as white space.
        alone = np.zeros(len(data), bool)
        if len(data) > 2:
            plain = _PLAIN[data]
            alone[1:-1] = _BREAK[data[1:-1]] & plain[:-2] & plain[2:]
        alone[begin[stop > begin]] = True
        at = np.flatnonzero(alone)
        end = np.r_[at[1:], len(data)]
        names, where, back = np.unique(range_hashes(data, at, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, names), max(0, len(self.hashes) - 1))
        new = self.hashes[place] != names if len(self.hashes) else np.ones(len(names), bool)
        first, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        first[~new], count[~new] = self.first[place[~new]], self.count[place[~new]]
        pool = self.ids
        if new.any():
            raw = data.tobytes()
            some = where[new]
            lists = self._encode([raw[a:b] for a, b in zip(at[some].tolist(), end[some].tolist())])
            sizes = np.fromiter(map(len, lists), np.int32, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
            first[new], count[new] = len(pool) + np.cumsum(sizes, dtype=np.int64) - sizes, sizes
            pool = np.concatenate([pool, ids])
            self._remember(names[new], sizes, ids)
        count, first = count[back], first[back]
        past = np.r_[0, np.cumsum(count)]
        ids = pool[np.repeat(first - past[:-1], count) + np.arange(past[-1])]
        return ids, past[np.searchsorted(at, np.r_[begin, len(data)])]


def _same_by_ranks(path: str):
    """The encoder by ranks of the same vocabulary, if its file lies beside the tokenizer's."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import base64
    import tiktoken
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


# Fixed value: how a byte-level BPE of this kind splits a text.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CODES = np.arange(256)
_BREAK = (_CODES == 32) | (_CODES == 10)
_PLAIN = (_CODES > 32) & (_CODES < 128)


_ENCODERS: dict[str, Encoder] = {}


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def cut_lengths(tokens: np.ndarray, capacity: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of each document's pieces, end to end, and how many each has."""
    halves = [c for c in token_classes(capacity, least) if c >= least]
    counts = np.stack([tokens // capacity] + [(tokens % h) >= h // 2 for h in halves[:-1]] + [tokens % halves[-1] > 0], axis=1).astype(np.int64)
    length = np.tile(np.r_[halves, 0], (len(tokens), 1))
    length[:, -1] = tokens % halves[-1]
    return np.repeat(length.ravel(), counts.ravel()), counts.sum(1)


SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task int, number long")


class Filling:
    """One task's sequences: whole documents by class, and what fills them up.

    A piece is (doc_id, start, length, ids of the whole document, its number of tokens).
    """

    def __init__(self, task: int, capacity: int, classes: int = CLASSES, waiting: int = WAITING):
        self.task, self.capacity, self.classes, self.waiting = task, capacity, classes, waiting
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.closed: deque[list[tuple]] = deque()
        self.loose: deque[tuple] = deque()
        self.spare = self.sequences = self.number = 0
        self.done: list[tuple] = []

    def add(self, doc_id, ids: bytes, tokens: int) -> None:
        piece = (doc_id, 0, tokens, ids, tokens)
        k = self.capacity // tokens
        if not 1 <= k <= self.classes:
            self._loosen([piece])
            return
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            self.closed.append(self.open.pop(k))
            self._settle()
            if len(self.closed) > self.waiting:
                self._loosen(self.closed.pop())

    def finish(self) -> list[tuple]:
        """Dissolve what is open; the pieces left over, less than a sequence of tokens."""
        for k in list(self.open):
            self._loosen(self.open.pop(k))
        while self.closed:
            self._loosen(self.closed.pop())
        while self.spare >= self.capacity:
            self._emit(self._take(self.capacity))
        return self._take(self.spare)

    def _loosen(self, pieces: list[tuple]) -> None:
        self.loose.extend(pieces)
        self.spare += sum(p[2] for p in pieces)
        self._settle()

    def _settle(self) -> None:
        while self.closed:
            gap = self.capacity - sum(p[2] for p in self.closed[0])
            if self.spare < gap:
                break
            self._emit(self.closed.popleft() + self._take(gap))
        while self.spare >= (self.waiting + 1) * self.capacity:
            self._emit(self._take(self.capacity))

    def _take(self, tokens: int) -> list[tuple]:
        self.spare -= tokens
        taken = []
        while tokens:
            doc_id, start, length, ids, whole = self.loose.popleft()
            if length > tokens:
                self.loose.appendleft((doc_id, start + tokens, length - tokens, ids, whole))
                length = tokens
            taken.append((doc_id, start, length, ids, whole))
            tokens -= length
        return taken

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append(self.row(piece, self.task * _TASK + self.sequences, offset))
            offset += piece[2]
        self.sequences += 1

    def row(self, piece: tuple, sequence_id: int | None = None, offset: int | None = None) -> tuple:
        doc_id, start, length, ids, whole = piece
        self.number += 1
        return doc_id, start, length, ids[4 * start:4 * (start + length)], whole, sequence_id, offset, self.task, self.number


def _pack(path: str, capacity: int, least: int, end: int):
    def run(batches):
        encoder = _ENCODERS.setdefault(path, None) or Encoder(path)
        _ENCODERS[path] = encoder
        filling = Filling(TaskContext.get().partitionId(), capacity)
        for batch in slices(batches, "text"):
            data, begin, stop = _text_bytes(batch.column(1))
            ids, first = encoder.encode(data, begin, stop)
            tokens = np.diff(first) + 1
            ids = np.insert(ids, first[1:], np.uint32(end))
            past = np.cumsum(tokens) - tokens
            for doc_id, lo, n in zip(batch.column(0).to_pylist(), past.tolist(), tokens.tolist()):
                filling.add(doc_id, ids[lo:lo + n].tobytes(), n)
            if filling.done:
                yield _batch(filling.done)
                filling.done = []
        rest = []
        for doc_id, start, length, whole, tokens in filling.finish():
            lengths, _ = cut_lengths(np.array([length]), capacity, least)
            for at, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist()):
                rest.append(filling.row((doc_id, start + at, n, whole, tokens)))
        if filling.done or rest:
            yield _batch(filling.done + rest)
    return run


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: int = CAPACITY, least: int = LEAST_HALF, end: int = END,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed pieces: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: the path of the tokenizer's file on the workers.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = scratch.cut(narrow.mapInArrow(_pack(tokenizer, capacity, least, end), SCHEMA), "pieces", "zstd")
    left = scratch.cut(pieces.where("sequence_id is null").drop("sequence_id", "offset"), "left", "zstd")
    per = F.floor(F.lit(capacity) / F.col("length"))
    # Ranked class by class, the tasks in order.
    ranked = running_sums(left.withColumn("one", F.lit(1)), ["length"], "task", [F.col("number")], {"rank": "one"})
    total = F.broadcast(left.groupBy("length").agg(F.count("*").alias("n")))  # one row per class
    ranked = ranked.join(total, "length").withColumn("bin", F.floor(F.col("rank") / per))
    name = F.lit(-1) - (F.col("bin") * F.lit(4096) + F.col("length")) * F.lit(32)
    place = (F.pmod("rank", per) * F.col("length")).cast("long")
    full = F.col("n") >= (F.col("bin") + 1) * per
    keep = ["doc_id", "start", "length", "ids", "doc_tokens"]
    filled = ranked.where(full).select(*keep, name.alias("sequence_id"), place.alias("offset"))
    # What is left of a class: used words in all, cut where their binary digits say.
    bits = capacity.bit_length() - 1
    tail = ranked.where(~full).withColumn("at", place).withColumn("used", ((F.col("n") - F.col("bin") * per) * F.col("length")).cast("long"))
    tail = tail.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    tail = tail.where("shiftright(used, bit) & 1 = 1").withColumn("from", F.expr("shiftleft(shiftright(used, bit + 1), bit + 1)"))
    lo, hi = F.greatest("at", "from"), F.least(F.col("at") + F.col("length"), F.col("from") + F.expr("shiftleft(1L, bit)"))
    tail = tail.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi").select(
        "doc_id", (F.col("start") + F.col("lo") - F.col("at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"),
        F.expr("substring(ids, cast((lo - at) * 4 + 1 as int), cast((hi - lo) * 4 as int))").alias("ids"), "doc_tokens",
        (name - 1 - F.col("bit")).alias("sequence_id"), (F.col("lo") - F.col("from")).alias("offset"))
    return pieces.where("sequence_id is not null").select(*keep, "sequence_id", "offset").unionByName(filled).unionByName(tail)


def default_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(pack(docs, Scratch(spark), default_tokenizer()))
