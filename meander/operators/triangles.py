"""Which neighbours the two ends of an edge share.

Every triangle is found once: from its vertex of lowest degree, whose list of
higher neighbours, lowest first, is sent to each of these from there on, as bare
ids, and met with theirs.  What is found serves all edges of the triangle, in both
directions.  A vertex of degree d has at most about the square root of twice the
edges higher neighbours, so hubs send short lists; that many lists may reach a hub
is left to ``attach``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meander.operators.joins import attach
from meander.schemas import expect
from meander.scratch import Scratch


def shared_places(adj: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, at, shared): entry ``at`` of the list of ``id``, and the places in that neighbour's list whose vertices both lists have.

    Places count from 0 and ascend.  Entries that share nothing have no row.
    """
    adj = expect(adj, "adj")
    entries = adj.select("id", F.posexplode("nbrs.nbr").alias("at", "nbr"))
    # Entries of the own list and of others' lists: at most twice the degree, and known before pairs are.
    met = scratch.cut(entries.select(F.explode(F.array("id", "nbr")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("met")),
                      "degrees")
    # Per pair of vertices, where each stands in the other's list, if at all, and the degree of each that has a list with the other.
    told = adj.select("id", F.col("nbrs.nbr").alias("own")).join(met.toDF("id", "met"), "id", "left")
    told = told.select("id", "met", F.posexplode("own").alias("at", "nbr")).where("id <> nbr")
    of = lambda sign, what, name: F.max(F.expr(f"if(id {sign} nbr, {what}, null)")).alias(name)
    pairs = scratch.cut(
        told.groupBy(F.least("id", "nbr").alias("lo"), F.greatest("id", "nbr").alias("hi"))
        .agg(of("<", "at", "hi_at"), of(">", "at", "lo_at"), of("<", "met", "lo_met"), of(">", "met", "hi_met")), "pairs")
    ranked = _both_degrees(pairs, met)
    lower = F.col("lo_met") <= F.col("hi_met")  # lo is the smaller id
    pick = lambda a, b: F.when(lower, F.col(a)).otherwise(F.col(b))
    # a is the lower end: ab is where b stands in a's list, ba the other way round.
    up = ranked.select(pick("lo", "hi").alias("a"), F.struct(
        pick("hi_met", "lo_met").alias("met"), pick("hi", "lo").alias("b"),
        pick("hi_at", "lo_at").alias("ab"), pick("lo_at", "hi_at").alias("ba")).alias("e"))
    up = up.groupBy("a").agg(F.sort_array(F.collect_list("e")).alias("ups"))
    up = scratch.cut(up.select("a", F.col("ups.b").cast(f"array<{_id_type(met)}>").alias("ids"),
                               F.col("ups.ab").alias("out"), F.col("ups.ba").alias("back")), "higher")
    # The third vertex stands behind the second in the list of the first: no more than that part is sent.
    sent = up.select("a", "ids", F.posexplode("ids").alias("i", "b")).where("i + 1 < size(ids)")
    sent = sent.select("a", "i", F.col("b").cast("bigint").alias("b"), F.expr("slice(ids, i + 2, size(ids))").alias("after"))
    sent = attach(sent, up.select(F.col("a").alias("b"), F.col("ids").alias("further"), "out", "back"), "b")
    at = lambda c: F.array_position("further", c).cast("int") - 1
    third = F.transform(F.array_intersect("after", "further"), lambda c: F.struct(
        (F.col("i") + F.array_position("after", c)).cast("int").alias("j"),
        F.get("out", at(c)).alias("bc"), F.get("back", at(c)).alias("cb")))
    found = scratch.cut(sent.select("a", "i", F.inline(third)), "triangles")
    # What the first vertex knows of the other two is looked up for the triangles only.
    found = attach(found, up, "a")
    known = lambda of, k, name: F.get(of, F.col(k)).alias(name)
    found = found.select("a", F.get("ids", "i").cast("bigint").alias("b"), F.get("ids", "j").cast("bigint").alias("c"),
                         known("out", "i", "ab"), known("back", "i", "ba"), known("out", "j", "ac"), known("back", "j", "ca"),
                         "bc", "cb")

    def edge(at: str, reached: str, seen: str) -> str:
        """From the first vertex of ``at`` to its second, if its first has the third one too (``reached``) and its second (``seen``)."""
        return (f"if({at} is not null and {reached} is not null and {seen} is not null, "
                f"struct({at[0]} as id, {at} as at, {seen} as place), null)")
    each = ", ".join(edge(*x) for x in (("ab", "ac", "bc"), ("ba", "bc", "ac"), ("ac", "ab", "cb"),
                                        ("ca", "cb", "ab"), ("bc", "ba", "ca"), ("cb", "ca", "ba")))
    places = found.select(F.expr(f"inline(array_compact(array({each})))"))
    # A vertex in its own list: shared by it and whoever is linked with it, and all of its list with itself.
    loops = scratch.cut(entries.where("id = nbr").select("id", F.col("at").alias("own")), "loops")
    to_loop = entries.where("id <> nbr").join(loops.toDF("nbr", "place"), "nbr").select("id", "at", "place")
    mutual = pairs.where("lo_at is not null and hi_at is not null").select(F.expr(
        "inline(array(struct(lo as id, hi_at as at, lo_at as place), struct(hi as id, lo_at as at, hi_at as place)))"))
    from_loop = mutual.join(loops, "id", "left_semi")
    itself = entries.select("id", F.col("at").alias("place")).join(loops, "id").select("id", F.col("own").alias("at"), "place")
    return (places.unionByName(to_loop).unionByName(from_loop).unionByName(itself).groupBy("id", "at")
            .agg(F.sort_array(F.collect_list("place")).alias("shared")))


def _both_degrees(pairs: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs with the degrees of both ends: only where one end's list doesn't have the other must one be looked up."""
    one_way = pairs.where("lo_met is null or hi_met is null").withColumn("v", F.expr("if(lo_met is null, lo, hi)"))
    filled = attach(one_way, met.withColumnRenamed("met", "v_met"), "v")
    filled = filled.withColumns({c: F.coalesce(c, "v_met") for c in ("lo_met", "hi_met")})
    return pairs.where("lo_met is not null and hi_met is not null").unionByName(filled.select(*pairs.columns))


def _id_type(met: DataFrame) -> str:
    """The narrowest type that holds all ids ``v``: the sent lists are most of what moves."""
    ends = met.agg(F.min("v"), F.max("v")).first()
    return "int" if ends[0] is None or (ends[0] >= -2**31 and ends[1] < 2**31) else "bigint"
