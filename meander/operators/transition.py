"""Transition probabilities as tables, for inspection; walks don't need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meander.functions import draw
from meander.operators.joins import attach, frequent_keys
from meander.operators.triangles import shared_places
from meander.schemas import expect
from meander.scratch import Scratch


def transition1(adj: DataFrame) -> DataFrame:
    """First order: the share of each neighbour in its vertex's total weight.  No shuffle."""
    shares = expect(adj, "adj").select(
        "id", draw.total(F.col("nbrs.weight")).alias("total"), F.inline("nbrs"))
    return shares.select("id", "nbr", (F.col("weight") / F.col("total")).alias("prob"))


def _met_lists(adj: DataFrame, p: float, q: float, scratch: Scratch | None) -> DataFrame:
    """(prev, cur, nbrs, shared, back, total): the list of ``cur`` at every edge that leads there, and what its biased weights add up to.

    Which neighbours of ``cur`` those of ``prev`` are comes from the triangles of the
    graph; only places in lists are joined to the edges, and then the list of ``cur``.
    The total follows from that of the plain weights and the few that aren't divided by q.
    """
    adj = expect(adj, "adj")
    steps = adj.select(F.col("id").alias("prev"), F.posexplode("nbrs.nbr").alias("at", "cur"))
    # Told by the plain lists: the same look at the joined rows would work out all triangles once more.
    hot = frequent_keys(steps, ["cur"])["cur"]
    if q != 1:
        near = shared_places(adj, scratch or Scratch(adj.sparkSession)).withColumnRenamed("id", "prev")
        steps = steps.join(near, ["prev", "at"], "left")
    else:
        steps = steps.withColumn("shared", F.lit(None).cast("array<int>"))
    slim = F.transform("nbrs", lambda e: F.struct(e["nbr"].alias("nbr"), e["weight"].alias("weight")))
    lists = adj.select(F.col("id").alias("cur"), slim.alias("nbrs"), draw.total(F.col("nbrs.weight")).alias("plain"))
    met = attach(steps.drop("at"), lists, "cur", hot=hot)
    met = met.withColumn("back", (F.coalesce(F.array_position("nbrs.nbr", F.col("prev")), F.lit(0)) - 1).cast("int"))
    weight = lambda i: F.get("nbrs", i)["weight"]
    near = F.aggregate(F.coalesce("shared", F.array().cast("array<int>")), F.lit(0.0),
                       lambda acc, i: acc + F.when(i == F.col("back"), F.lit(0.0)).otherwise(weight(i)))
    total = (F.col("plain") / F.lit(q) + near * F.lit(1 - 1 / q)
             + F.coalesce(weight(F.col("back")), F.lit(0.0)) * F.lit(1 / p - 1 / q))
    return met.select("prev", "cur", "nbrs", "shared", "back", total.alias("total"))


def _share(weight: Column, at: Column, p: float, q: float, some: bool = True) -> Column:
    """The probability of the entry at place ``at``, from 0; with ``some`` where vertices may share neighbours."""
    biased = F.when(at == F.col("back"), weight / F.lit(p))
    if some:
        biased = biased.when(F.coalesce(F.array_contains("shared", at), F.lit(False)), weight)
    return biased.otherwise(weight / F.lit(q)) / F.col("total")


def transition2(adj: DataFrame, p: float = 1.0, q: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """Second order: over (prev, cur, nbr), with the bias of a walk that came from ``prev``; in generated code."""
    rows = _met_lists(adj, p, q, scratch).select("prev", "cur", "shared", "back", "total", F.posexplode("nbrs").alias("at", "e"))
    return rows.select("prev", "cur", "e.nbr", _share(F.col("e.weight"), F.col("at"), p, q).alias("prob"))


def transition_lists(adj: DataFrame, p: float = 1.0, q: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """Second order, one row per (prev, cur): ``next``, the neighbours of ``cur`` with their ``prob``.

    A total that is used once only, the optimizer would write out in the lambda, to be worked
    out for every entry anew; here lists with and without shared neighbours each use it.
    """
    shares = lambda some: F.transform("nbrs", lambda e, i: F.struct(
        e["nbr"].alias("nbr"), _share(e["weight"], i, p, q, some).alias("prob")))
    some = F.coalesce(F.size("shared"), F.lit(0)) > 0
    return _met_lists(adj, p, q, scratch).select("prev", "cur", F.when(some, shares(True)).otherwise(shares(False)).alias("next"))
