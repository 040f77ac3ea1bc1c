"""Expressions for reproducible weighted draws.

A draw hashes what it is for (seed, walk, start vertex, step) to a number in
(0, 1) and takes the first candidate whose running weight reaches that share
of the total.  The same inputs give the same draw in any task, so a re-run
task or another partitioning changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hashed(seed: int, walk_no: Column, start: Column, step: Column | int) -> Column:
    """128 bits as 32 hex digits, for a draw."""
    return F.md5(_name(seed, walk_no, start, step))


def hashed_wide(seed: int, walk_no: Column, start: Column, step: Column | int, more: int) -> Column:
    """256 bits as 64 hex digits, for a draw that needs several numbers; ``more`` gives others."""
    return F.sha2(F.concat_ws("|", _name(seed, walk_no, start, step), F.lit(str(more))), 256)


def _name(seed: int, walk_no: Column, start: Column, step: Column | int) -> Column:
    # As text, a step number is not part of the generated code.
    step = F.lit(str(step)) if isinstance(step, int) else step
    return F.concat_ws("|", F.lit(str(seed)), walk_no.cast("string"), start.cast("string"), step.cast("string"))


def part(bits: Column, k: int) -> Column:
    """A number in (0, 1) from the k-th 32 bits; never one of the ends."""
    return (F.conv(F.substring(bits, 8 * k + 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def uniform(seed: int, walk_no: Column, start: Column, step: Column | int) -> Column:
    """A number in (0, 1) from the first 32 bits of an md5."""
    return part(hashed(seed, walk_no, start, step), 0)


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)


def running(weights: Column) -> Column:
    """The running sums of an array of weights."""
    return F.aggregate(
        weights, F.array().cast("array<double>"),
        lambda sums, w: F.array_append(sums, F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0.0)) + w))


def reach(sums: Column, amount: Column) -> Column:
    """The 1-based position of the first running sum that is at least ``amount``.

    Where the amount lands when sorted into the sums is the answer.  No lambda
    is involved, so the draw runs inside the generated code of the join, on plain
    numbers if neither the sums nor the amount can be null.
    Rounding can put an amount just past the end: that's the last one.
    """
    at = F.array_position(F.sort_array(F.concat(sums, F.array(amount))), amount)
    return F.least(at, F.size(sums).cast("bigint")).cast("int")


def pick(weights: Column, amount: Column) -> Column:
    """Like ``reach``, for weights without their running sums.

    The fold's one number first is the amount still to pass; from the chosen
    element on it counts down from -1, so at the end it gives the position
    from the back.
    """
    rest = F.aggregate(
        weights, amount,
        lambda left, w: F.when(left < 0, left - 1).when(w >= left, F.lit(-1.0)).otherwise(left - w))
    return (F.size(weights) + 1 + F.least(rest, F.lit(-1.0))).cast("int")


def biased(weight: Column, back: Column, shared: Column, p: float, q: float) -> Column:
    """Weights of a list's entries for a walk that came from the one at place ``back`` (from 1, 0 if none).

    Back there: w/p; to a neighbour of it (at one of the places ``shared``, from 0): w; else w/q.
    """
    plain = F.transform(weight, lambda w, i: F.when(i == back - 1, w / F.lit(p)).otherwise(w / F.lit(q)))
    full = F.transform(weight, lambda w, i: F.when(i == back - 1, w / F.lit(p))
                       .when(F.array_contains(shared, i), w).otherwise(w / F.lit(q)))
    return F.when(F.coalesce(F.size(shared), F.lit(0)) <= 0, plain).otherwise(full)


def amount_with_return(sums: Column, back: Column, back_weight: Column, u: Column,
                       p: float, q: float) -> Column:
    """What running sum to reach when all weights but one are divided by q.

    The one at position ``back`` (0 if there is none), of ``back_weight``, is
    divided by p.  All running sums before it scale by 1/q, all from it on
    are shifted besides, so the amount can be undone instead of the sums redone.
    """
    end = F.get(sums, F.size(sums) - 1)
    before = F.coalesce(F.get(sums, (back - 2).cast("int")), F.lit(0.0)) / F.lit(q)
    shift = back_weight / F.lit(p) - back_weight / F.lit(q)
    amount = u * (end / F.lit(q) + shift)
    return (F.when((back == 0) | (amount <= before), amount * F.lit(q))
             .when(amount <= before + back_weight / F.lit(p), F.get(sums, (back - 1).cast("int")))
             .otherwise((amount - shift) * F.lit(q)))
