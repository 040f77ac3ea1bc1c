"""Which hashes several owners share, by one shuffle of packed arrays.

Owners (documents or sets, known by a long) hold hashes.  A task packs what it
has for each bucket of hashes into one row; a bucket's task sees all owners of
its hashes.  A hash that very many owners hold would make one bucket large, so
such a hash isn't sent by all of them:

- To learn just whether a hash is shared, a task that sees three owners or
  more of one sends two; the others know already and take the count ``MANY``.
- To count owners, hashes that a large part of them hold are found first
  (``common_hashes``) and aren't counted.

Rows for what is known already have a bucket below 0, one for each packed row.

``deal_by_slice`` sends owners as places
in the slice of rows they were packed with, a byte for each step from place to
place, whatever the number of buckets.  What the slice's places stand for
travels once, and answers come back by slice.  Owners of different slices are
taken for different ones, so every owner should have one row, and a slice must
come out alike when a lost task runs again: the rows are read from a file.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from meander.llm.common import binaries, signed, slices
from meander.llm.words import mix

SCHEMA = "bucket long, hashes binary, owners binary"
PACK_BYTES = 16 << 20
MANY = 1 << 30
# A hash is common if at least this share of the owners, and this many, hold it.
COMMON_SHARE, COMMON_LEAST = 1e-3, 64


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, owner), in this order."""
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])] if len(values) else np.zeros(0, bool)
    return values[new], owner[new]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry of a sorted array: its place among its equals, and how many these are."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    size = np.diff(np.r_[start, len(values)])
    return np.arange(len(values)) - np.repeat(start, size), np.repeat(size, size)


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    blobs = batch.column(1)
    values = np.frombuffer(b"".join(blobs.to_pylist()), np.uint64)
    counts = np.asarray(pc.binary_length(blobs), np.int64) // 8
    return values, np.repeat(np.asarray(batch.column(0), np.int64), counts)


def packed(values: np.ndarray, owner: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that has entries; inside it by owner, which packs well."""
    order = np.lexsort((values, owner, to))
    values, owner, to = values[order], owner[order], to[order]
    start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    cut = np.r_[start, len(to)]
    return pa.record_batch([pa.array(to[start], pa.int64()), binaries(values, cut), binaries(owner, cut)], ["bucket", "hashes", "owners"])


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values, 31) % np.uint64(buckets)).astype(np.int64)


def deal(column: str, buckets: int):
    """(owner, hashes) to packed rows."""
    def run(batches):
        at = TaskContext.get().partitionId() << 20
        for number, batch in enumerate(slices(batches, column, PACK_BYTES)):
            values, owner = distinct(*_unpack(batch))
            place, _ = runs(values)
            yield packed(values, owner, np.where(place >= 2, -1 - at - number, bucket_of(values, buckets)))
    return run


def common_hashes(rows: DataFrame, column: str, owners: int) -> np.ndarray:
    """Hashes that more than COMMON_SHARE of the owners hold; fewer than mean hashes per owner / COMMON_SHARE.

    A hash with that share of all owners has half of it in some packed row at least;
    rows where it has less than that don't send it.
    """
    least = max(COMMON_LEAST, int(owners * COMMON_SHARE))

    def run(batches):
        for batch in slices(batches, column, PACK_BYTES):
            values, owner = distinct(*_unpack(batch))
            place, size = runs(values)
            often = (place == 0) & (size >= max(4, COMMON_SHARE / 2 * batch.num_rows))
            yield pa.record_batch([pa.array(signed(values[often])), pa.array(size[often])], ["hash", "n"])
    found = rows.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array([r["hash"] for r in found.select("hash").collect()], np.int64).view(np.uint64)


def _gather(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, owner = distinct(np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["hashes"]]),
                             np.concatenate([np.frombuffer(b, np.int64) for b in pdf["owners"]]))
    return values, owner, runs(values)[1] if pdf["bucket"].iloc[0] >= 0 else np.full(len(values), MANY)


def _by_part(owner: np.ndarray, parts: int, **columns: np.ndarray) -> pd.DataFrame:
    """One row for each part of the owners; inside it by owner, which packs well."""
    to = bucket_of(owner.view(np.uint64), parts)
    order = np.lexsort((owner, to))
    to, columns = to[order], {n: x[order] for n, x in {"owners": owner, **columns}.items()}
    start = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    spans = list(zip(start, [*start[1:], len(to)]))
    return pd.DataFrame({"part": to[start], **{n: [x[a:b].tobytes() for a, b in spans] for n, x in columns.items()}}, columns=["part", *columns])


def _by_owner(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """A bucket's shared hashes, one row for each part of the owners."""
    values, owner, count = _gather(pdf)
    keep = count > 1
    return _by_part(owner[keep], parts, hashes=values[keep], counts=np.minimum(count[keep], MANY).astype(np.int32))


def _one_row_each(pdf: pd.DataFrame) -> pd.DataFrame:
    owner, values, count = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("owners", np.int64), ("hashes", np.uint64), ("counts", np.int32)))
    order = np.lexsort((values, owner))
    values, owner, count = values[order], owner[order], count[order]
    # An owner met in several slices sends a common hash from each.
    new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])] if len(owner) else np.zeros(0, bool)
    values, owner, count = values[new], owner[new], count[new]
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    spans = list(zip(start, [*start[1:], len(owner)]))
    return pd.DataFrame({"owner": owner[start], "hashes": [values[a:b].tobytes() for a, b in spans],
                         "counts": [count[a:b].tobytes() for a, b in spans]}, columns=["owner", "hashes", "counts"])


def shared_hashes(dealt: DataFrame, parts: int) -> DataFrame:
    """owner, hashes, counts: one row per owner that shares a hash, with these and how many owners each has.

    Between buckets and owners rows are packed by part, so their number doesn't follow that of the owners.
    """
    return (dealt.groupBy("bucket").applyInPandas(lambda pdf: _by_owner(pdf, parts), "part long, owners binary, hashes binary, counts binary")
            .groupBy("part").applyInPandas(_one_row_each, "owner long, hashes binary, counts binary"))


BY_SLICE = "bucket long, slice long, hashes binary, owners binary, names binary"


def steps(places: np.ndarray) -> np.ndarray:
    """Ascending places as differences of one byte each; 255 goes on by 255 and ends at no place."""
    gap = np.diff(places, prepend=0)
    more = gap // 255
    out = np.full(len(gap) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out


def places(step: np.ndarray) -> np.ndarray:
    return np.cumsum(step, dtype=np.int64)[step != 255]


def levels(count: np.ndarray) -> np.ndarray:
    """Numbers of owners in one byte, eight levels for each doubling; 255 is kept for what is common."""
    return np.minimum(254, np.ceil(8 * np.log2(count))).astype(np.uint8)


def _slice_rows(values: np.ndarray, owner: np.ndarray, to: np.ndarray, number: int, names: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that has entries, and one with the names (owner, its number) and what is known already."""
    order = np.lexsort((values, owner, to))
    values, owner, to = values[order], owner[order], to[order]
    keys, start = np.unique(to, return_index=True)
    spans = dict(zip(keys.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(to)])))
    spans.setdefault(-1, (0, 0))
    rows = [(b if b >= 0 else -1 - number, number, values[x:y].tobytes(), steps(owner[x:y]).tobytes(), names.tobytes() if b < 0 else None)
            for b, (x, y) in spans.items()]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in BY_SLICE.split(", ")])


def deal_by_slice(column: str, buckets: int, common: np.ndarray | None = None, short: bool = False, limit: int = PACK_BYTES):
    """(owner, hashes) to rows of BY_SLICE; a third column, a long, stays with its owner.

    A task that sees three owners or more of a hash sends two; the others know
    already that it is shared.  With ``common`` (see ``common_hashes``), all send
    but for these, which take the highest level.

    ``short`` sends half of each hash, enough to tell that one isn't shared.  What
    two hashes of an owner have in common then counts as known, so that none is lost.
    """
    def run(batches):
        at = TaskContext.get().partitionId() << 20
        for number, batch in enumerate(slices(batches, column, limit)):
            values, owner = distinct(*_unpack(batch))
            names, owner = np.unique(owner, return_inverse=True)
            row = pd.Series(np.arange(batch.num_rows), np.asarray(batch.column(0), np.int64))
            row = row[~row.index.duplicated()].reindex(names).to_numpy()
            with_names = np.asarray(batch.column(2), np.int64)[row] if batch.num_columns > 2 else np.zeros(len(names), np.int64)
            names = np.column_stack([names, with_names])
            place, _ = runs(values)
            known = place >= 2 if common is None else np.isin(values, common)
            to = np.where(known, -1, bucket_of(values, buckets))
            if short:
                values = (values >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((values, owner, to))
                again = np.r_[False, np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (values, owner, to)])][:len(order)]
                to[order[again]] = -1
            yield _slice_rows(values, owner, to, at + number, names)
    return run


def _holders(pdf: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of a bucket's rows end to end: hash, how many hold it, place in the slice; and where each row begins."""
    own = [places(np.frombuffer(b, np.uint8)) for b in pdf["owners"]]
    values = np.frombuffer(b"".join(pdf["hashes"]), kind)
    order = np.argsort(values, kind="stable")
    size = np.empty(len(values), np.int64)
    size[order] = runs(values[order])[1]
    return values, size, np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])].tolist()


def _count_by_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket of short hashes, the places whose hash others hold too, once for each such hash."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["slice", "owners", "names"]]
    _, size, place, at = _holders(pdf, np.uint32)
    own = [place[a:b][size[a:b] > 1] for a, b in zip(at, at[1:])]
    out = [(n, steps(x).tobytes(), None) for n, x in zip(pdf["slice"], own) if len(x)]
    return pd.DataFrame(out, columns=["slice", "owners", "names"])


def _names(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(next(b for b in pdf["names"] if b is not None), np.int64).reshape(-1, 2)


def _sum_by_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    names = _names(pdf)[:, 0]
    shared = np.bincount(np.concatenate([places(np.frombuffer(b, np.uint8)) for b in pdf["owners"]]), minlength=len(names))
    return pd.DataFrame({"owner": names[shared > 0], "shared": shared[shared > 0]})


def shared_counts_by_slice(dealt: DataFrame) -> DataFrame:
    """owner, shared: at least how many of its hashes, dealt short, others hold too; owners with none are left out.

    An owner of several slices has the number of the one with most.
    """
    return (dealt.groupBy("bucket").applyInPandas(_count_by_slice, "slice long, owners binary, names binary")
            .groupBy("slice").applyInPandas(_sum_by_slice, "owner long, shared long")
            .groupBy("owner").agg(F.max("shared").alias("shared")))


def _shared_by_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's shared hashes with their places and levels."""
    names = ["slice", "owners", "hashes", "levels", "names"]
    if pdf["bucket"].iloc[0] < 0:
        return pdf.assign(levels=[b"\xff" * (len(h) // 8) for h in pdf["hashes"]])[names]
    values, size, place, at = _holders(pdf, np.uint64)
    level = levels(size)
    out = []
    for n, a, b in zip(pdf["slice"], at, at[1:]):
        keep = size[a:b] > 1
        if keep.any():
            out.append((n, steps(place[a:b][keep]).tobytes(), values[a:b][keep].tobytes(), level[a:b][keep].tobytes(), None))
    return pd.DataFrame(out, columns=names)


def _owners_of_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    names = _names(pdf)
    owner = np.concatenate([places(np.frombuffer(b, np.uint8)) for b in pdf["owners"]])
    values, level = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("hashes", np.uint64), ("levels", np.uint8)))
    order = np.lexsort((values, owner))
    values, level, owner = values[order], level[order], owner[order]
    held, start = np.unique(owner, return_index=True)
    spans = list(zip(start, [*start[1:], len(owner)]))
    return pd.DataFrame({"owner": names[held, 0], "n": names[held, 1], "hashes": [values[a:b].tobytes() for a, b in spans],
                         "levels": [level[a:b].tobytes() for a, b in spans]}, columns=["owner", "n", "hashes", "levels"])


def shared_hashes_by_slice(dealt: DataFrame) -> DataFrame:
    """owner, n (what was dealt with it), hashes, levels (of how many owners each has): one row per owner, and slice, that shares a hash."""
    return (dealt.groupBy("bucket").applyInPandas(_shared_by_slice, "slice long, owners binary, hashes binary, levels binary, names binary")
            .groupBy("slice").applyInPandas(_owners_of_slice, "owner long, n long, hashes binary, levels binary"))
