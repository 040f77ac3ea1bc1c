"""Biased random walks: a loop of joins in which only slim walk states move.

All walks from all vertices advance together, one join per step.  The
neighbour lists are laid out by vertex once; a step shuffles the states to
them.  A state holds the vertices and features of the current stretch only,
features as numbers where their dictionary is small, and, for a biased walk,
where in the current list the neighbours of the vertex just left stand: known
for every edge from the graph's triangles, so that no list travels.
After ``checkpoint_every`` steps the stretch is written to the shared folder,
which cuts the plan and the lineage, and the walks go on from its last vertex.
The stretches are put together once, at the end.

There are two ways to draw.  ``sums`` looks up an amount in the running sums of
a list, corrected for the bias, and weighs the entries one by one where the two
vertices share neighbours.  ``alias`` takes an entry by the list's alias table
and, for a biased walk, accepts or rejects it by its bias and tries again: its
cost doesn't depend on the length of the list.  Both draw with the same
probabilities, but not the same walks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meander.functions import draw
from meander.operators import alias
from meander.operators.joins import attach
from meander.operators.lists import Lists, hold_lists
from meander.operators.triangles import shared_places
from meander.schemas import expect
from meander.scratch import Scratch

# Walks that may meet at one vertex in one task.
WALKS_PER_TASK = 1_000_000
# Features travel as numbers if all of them together take no more bytes than this.
FEATURE_BYTES = 16 << 20
METHODS = ("sums", "alias")
# Tries of a biased alias draw; then the list is weighed.
TRIES = 4


@dataclass(frozen=True)
class Layout:
    """Neighbour lists laid out for the walk: one row per vertex, or per copy of a hub.

    ``table`` is partitioned and sorted by (id[, copy]) and has the lists as
    parallel arrays, with the running sums of the weights or the alias tables.
    With ``spread`` it also tells the copies of every neighbour, so that a walk
    knows at the draw among how many it may choose.  ``hubs`` are the vertices
    with copies.  ``near`` has, for ``biased`` walks, the places in a neighbour's
    list that the own list shares, unless no two linked vertices share any, as where
    all edges lead from one kind of vertex to another; ``features`` the numbers of
    features, if these take the place of texts in ``table``.
    """

    table: DataFrame
    hubs: DataFrame | None
    directed: bool
    adj: DataFrame
    num_partitions: int
    method: str = "sums"
    placed: bool = False
    near: DataFrame | None = field(default=None, repr=False)
    features: DataFrame | None = field(default=None, repr=False)
    biased: bool = False

    @property
    def spread(self) -> bool:
        return self.directed or self.hubs is not None

    def persist(self) -> "Layout":
        return replace(self, table=self.table.persist(StorageLevel.MEMORY_AND_DISK))

    def release(self) -> None:
        self.table.unpersist()

    @property
    def kept(self) -> bool:
        level = self.table.storageLevel
        return level.useMemory or level.useDisk


def find_hubs(adj: DataFrame, num_walks: int, walks_per_task: int = WALKS_PER_TASK,
              starts: DataFrame | None = None) -> DataFrame:
    """Vertices where more than ``walks_per_task`` walks would meet, with the copies to spread them over.

    The walks expected at a vertex follow from its shares of the lists of the
    starts (walks that have just started), from its share of all weights (walks
    that have settled), and, where only some vertices are starts, from the walks
    that may be back at one.
    """
    adj = expect(adj, "adj")
    lists = adj.select("id", "nbrs", draw.total(F.col("nbrs.weight")).alias("total"))
    lists = lists.withColumn("from", F.lit(num_walks))
    if starts is not None:
        lists = lists.drop("from").join(
            starts.select("id", F.lit(num_walks).alias("from")).distinct(), "id", "left")
    size = lists.agg(F.coalesce(F.sum("from"), F.lit(0)).alias("walks"), F.sum("total").alias("weight")).first()
    if size["walks"] <= walks_per_task:
        return adj.select("id", F.lit(1).alias("copies")).where(F.lit(False))
    into = lists.select(F.inline("nbrs"), (F.coalesce("from", F.lit(0)) / F.col("total")).alias("per"))
    met = (into.groupBy(F.col("nbr").alias("id"))
           .agg(F.greatest(F.sum(F.col("weight") * F.col("per")),
                           F.sum("weight") * F.lit(size["walks"] / size["weight"])).alias("met")))
    if starts is not None and num_walks > walks_per_task:
        back = lists.where("from IS NOT NULL").select("id", F.lit(float(num_walks)).alias("met"))
        met = met.unionByName(back).groupBy("id").agg(F.max("met").alias("met"))
    hubs = met.select("id", F.ceil(F.col("met") / F.lit(float(walks_per_task))).cast("int").alias("copies"))
    return hubs.where("copies > 1")


def crowded(state: DataFrame, hubs: DataFrame | None, walks_per_task: int = WALKS_PER_TASK) -> DataFrame:
    """Vertices where over twice as many walks stand as their copies are for, with the copies they need."""
    met = state.groupBy(F.col("cur").alias("id")).agg(F.count(F.lit(1)).alias("met"))
    met = met.where((F.col("met") > 2 * walks_per_task) & F.col("id").isNotNull())
    known = F.lit(1)
    if hubs is not None:
        met, known = met.join(hubs, "id", "left"), F.coalesce("copies", F.lit(1))
    met = met.where(F.col("met") > F.lit(2 * walks_per_task) * known)
    return met.select("id", F.ceil(F.col("met") / F.lit(float(walks_per_task))).cast("int").alias("copies"))


def more_copies(layout: Layout, over: DataFrame, scratch: Scratch) -> Layout:
    """The layout with copies for these vertices too, kept; the one before is for the caller to release."""
    hubs = over if layout.hubs is None else layout.hubs.unionByName(over)
    hubs = scratch.cut(hubs.groupBy("id").agg(F.max("copies").alias("copies")), "hubs")
    return replace(layout, hubs=hubs, table=_table(layout.adj, hubs, layout.directed, layout.num_partitions, layout.method,
                                                   layout.placed, layout.near, layout.features)).persist()


def lay_out(adj: DataFrame | Lists, hubs: DataFrame | None = None, directed: bool = False,
            num_partitions: int | None = None, scratch: Scratch | None = None, method: str = "sums",
            biased: bool = False, placed: bool = False, feature_bytes: int = FEATURE_BYTES) -> Layout:
    """Partition the neighbour lists by vertex, hubs repeated, for the joins of the walk.

    ``placed`` lists are in ``num_partitions`` buckets of their vertex already and
    stay where they are, as ``Lists`` do.  ``biased`` is for walks whose q isn't 1.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, got {method!r}")
    if isinstance(adj, Lists):
        adj, num_partitions, placed = adj.table, adj.buckets, True
    adj = expect(adj, "adj")
    scratch = scratch or Scratch(adj.sparkSession)
    if hubs is not None and hubs.isEmpty():
        hubs = None
    count = num_partitions or int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = None
    if biased:
        near = scratch.cut(shared_places(adj, scratch).groupBy("id").agg(
            F.map_from_entries(F.collect_list(F.struct("at", "shared"))).alias("near")), "near")
        near = None if near.isEmpty() else near
    features = _numbered_features(adj, scratch, feature_bytes)
    return Layout(_table(adj, hubs, directed, count, method, placed, near, features), hubs, directed, adj, count, method,
                  placed, near, features, biased)


def _numbered_features(adj: DataFrame, scratch: Scratch, most_bytes: int) -> DataFrame | None:
    """(feat, code) of all features of the lists, or None if they are too many to send to every task."""
    feats = adj.select(F.explode("nbrs.feat").alias("feat")).where("feat is not null").distinct()
    numbered = scratch.cut(feats.withColumn("code", F.monotonically_increasing_id()), "features")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("feat") + 16), F.lit(0))).first()[0]
    return numbered if size <= most_bytes else None


def _table(adj: DataFrame, hubs: DataFrame | None, directed: bool, count: int, method: str, placed: bool,
           near: DataFrame | None, features: DataFrame | None) -> DataFrame:
    """The lists entry by entry, looked up and put together again: one shuffle of them, or none if they are placed."""
    lists = adj if placed else adj.repartition(count, "id")
    if near is not None:
        lists = lists.join(near, "id", "left")
        rows = lists.select("id", "near", F.posexplode("nbrs").alias("at", "e"))
        rows = rows.select("id", "e.*", F.expr("try_element_at(near, at)").alias("shared"))
    else:
        rows = lists.select("id", F.inline("nbrs"))
    if features is not None:
        rows = rows.join(F.broadcast(features), "feat", "left").drop("feat").withColumnRenamed("code", "feat")
    extra = [c for c in ("shared",) if c in rows.columns]
    keys = ["id"]
    if hubs is not None:
        rows = attach(rows, hubs.select(F.col("id").alias("nbr"), "copies"), "nbr", "left")
        rows = rows.withColumn("copies", F.coalesce("copies", F.lit(1))).repartition(count, "id")
    elif directed:  # walks that have ended need a second key to be spread over
        rows = rows.withColumn("copies", F.lit(1))
    if hubs is not None or directed:
        keys, extra = ["id", "copy"], [*extra, "copies"]
    if method == "alias":
        rows, extra = alias.with_alias(rows), ["prob", "other", *extra]
        whole = [F.max("total").alias("total")]
    else:
        # Sums that can't be null are sorted as plain numbers by every draw, not as objects.
        sums = F.sum("weight").over(Window.partitionBy("id").orderBy("nbr"))
        rows = rows.withColumn("sums", F.coalesce(sums, F.lit(0.0)))
        extra, whole = ["sums", *extra], []
    columns = ["nbr", "weight", "feat", *extra]
    table = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("e"), *whole)
    table = table.select("id", *[f"e.{c}" for c in columns], *(["total"] if whole else []))
    if hubs is not None:
        own = hubs.select("id", F.sequence(F.lit(0), F.col("copies") - 1).alias("own"))
        table = table.join(own, "id", "left").withColumn(
            "copy", F.explode(F.coalesce("own", F.array(F.lit(0))))).drop("own").repartition(count, *keys)
    elif directed:
        table = table.withColumn("copy", F.lit(0)).repartition(count, *keys)
    return table.sortWithinPartitions(*keys)


def weighted_draw(adj: DataFrame, seed: int, draw_no: int = 0) -> DataFrame:
    """One neighbour per vertex, in proportion to weight."""
    weights = F.col("nbrs.weight")
    u = draw.uniform(seed, F.lit(draw_no), F.col("id"), 0)
    drawn = expect(adj, "adj").select(
        "id", F.element_at("nbrs", draw.pick(weights, u * draw.total(weights))).alias("entry"))
    return drawn.select("id", "entry.nbr", "entry.weight", "entry.feat")


def walk_start(layout: Layout, num_walks: int, seed: int, starts: DataFrame | None = None) -> DataFrame:
    """The first, unbiased hop of ``num_walks`` walks from every vertex, or from ``starts(id)``.

    States have the walk's number and start, its last two vertices, and the
    vertices met (v1, v2, ...) and their features (f1, f2, ...), the newest last:
    a step adds one of each, so that no empty ones move.
    """
    lists = layout.table
    if layout.spread:
        lists = lists.where(F.col("copy") == 0)
    if starts is not None:
        lists = lists.join(starts.select("id").distinct(), "id", "left_semi")
    rows = lists.withColumn("walk_no", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
    drawn = _draw(rows.withColumnRenamed("id", "start"), layout, 0, 1.0, 1.0, seed)
    hop = drawn.select("walk_no", "start", *_hop(layout))
    state = hop.select("walk_no", "start", F.col("start").alias("prev"), *_carried(hop), "cur", "feat")
    return _add_slots(state)


def walk_step(state: DataFrame, layout: Layout, step: int, p: float, q: float,
              seed: int) -> DataFrame:
    """Advance every walk by one hop; one shuffle, of the states.

    The join is an outer one: in a directed graph a walk may end at a vertex
    without out-edges.  In an undirected graph every state finds its list, and
    an inner join would make the optimizer repeat the draw to test the next
    key for null.  A first-order draw has no lambda, so join and draw are one
    piece of generated code.
    """
    on = F.col("cur") == F.col("id")
    if layout.spread:
        state = _choose_copy(state, step)
        on = on & (F.col("to_copy") == F.col("copy"))
    if "shared" in state.columns:
        state = state.withColumnRenamed("shared", "met_before")
    # Lists of vertices, broadcast, would make one method of all steps, too long to be compiled.
    met = state.join(layout.table.hint("merge"), on, "left")
    drawn = _draw(met, layout, step, p, q, seed)
    hop = drawn.select("walk_no", "start", F.col("cur").alias("prev"), *_hop(layout),
                       *[c for c in state.columns if _is_slot(c)])
    return _add_slots(hop)


def _draw(met: DataFrame, layout: Layout, step: int, p: float, q: float, seed: int) -> DataFrame:
    """Add ``pos``, the place from 1 of the drawn entry."""
    if q != 1 and not layout.biased:
        raise ValueError("walks with q other than 1 need a layout for biased walks")
    weighs = q != 1 and layout.near is not None
    who = (seed, F.col("walk_no"), F.col("start"), step)
    if layout.method == "alias":
        if p != 1 or q != 1:
            return _accepted(met, who, p, q, weighs)
        bits = draw.part(F.col("bits"), 0), draw.part(F.col("bits"), 1)
        return met.withColumn("bits", draw.hashed(*who)).withColumn("pos", alias.pick("prob", "other", F.col("total"), *bits))
    met = met.withColumn("u", draw.uniform(*who))
    if p != 1 or q != 1:
        return _biased_draw(met, p, q, weighs)
    return met.withColumn("amount", F.coalesce(F.col("u") * _last("sums"), F.lit(0.0))).withColumn("pos", draw.reach(F.col("sums"), F.col("amount")))


def _accepted(met: DataFrame, who: tuple, p: float, q: float, weighs: bool) -> DataFrame:
    """Add ``pos``: entries are proposed by weight and accepted by their bias, up to ``TRIES`` times.

    Biases are under a ceiling; what the way back has above it is an area of its
    own, so that a small p doesn't make other proposals fail.  A draw that no try
    settles weighs the list.  The tries don't build on each other: the optimizer
    writes out what a column is made of wherever it is used.  The lambda keeps them
    out of the join's method: one of over 8,000 bytes is never compiled by the JVM.
    """
    ceiling = max(1.0, 1 / q)
    back = F.coalesce(F.array_position("nbr", F.col("prev")), F.lit(0)).cast("int")
    met = met.withColumns({"back": back, **{f"bits{k}": draw.hashed_wide(*who, k) for k in range((TRIES + 1) // 2)}})
    back_weight = F.coalesce(F.get("weight", F.col("back") - 1), F.lit(0.0))
    number = lambda k, i: draw.part(F.col(f"bits{k // 2}"), 3 * (k % 2) + i)
    met = met.withColumns({
        "area": F.lit(ceiling) * F.col("total") + F.lit(max(0.0, 1 / p - ceiling)) * back_weight,
        **{f"proposed{k}": alias.pick("prob", "other", F.col("total"), number(k, 0), number(k, 1)) for k in range(TRIES)}})
    tries = []
    for k in range(TRIES):
        proposed, height = F.col(f"proposed{k}"), number(k, 2) * F.col("area")
        bias = F.when(proposed == F.col("back"), F.lit(min(ceiling, 1 / p)))
        if weighs:
            bias = bias.when(F.coalesce(_holds("met_before", proposed - 1), F.lit(False)), F.lit(1.0))
        tries.append(F.when(height >= F.lit(ceiling) * F.col("total"), F.col("back"))
                     .when(bias.otherwise(F.lit(1 / q)) * F.col("total") > height, proposed))
    shared = F.col("met_before") if weighs else F.lit(None).cast("array<int>")
    met = met.withColumn("found", F.coalesce(*tries))
    met = met.withColumn("b", F.when(F.col("found").isNull(), draw.biased(F.col("weight"), F.col("back"), shared, p, q)))
    weighed = draw.pick(F.col("b"), draw.part(F.col("bits0"), 6) * draw.total(F.col("b")))
    return met.withColumn("pos", F.coalesce("found", weighed))


def _holds(places: str, place: Column) -> Column:
    return F.exists(places, lambda known: known == place)


def _named_features(state: DataFrame, layout: Layout, hops: int) -> DataFrame:
    """States with the texts of the last ``hops`` features, by a look-up for each slot: nothing moves."""
    if layout.features is None:
        return state
    room = sum(_is_slot(c) for c in state.columns) // 2
    for i in range(room - hops + 1, room + 1):
        names = F.broadcast(layout.features.select(F.col("code").alias(f"f{i}"), F.col("feat").alias(f"__f{i}")))
        state = state.join(names, f"f{i}", "left").drop(f"f{i}").withColumnRenamed(f"__f{i}", f"f{i}")
    return state


def _is_slot(column: str) -> bool:
    return column[0] in "vf" and column[1:].isdigit()


def _add_slots(hop: DataFrame) -> DataFrame:
    """Add ``cur`` and ``feat`` behind the slots."""
    room = sum(_is_slot(c) for c in hop.columns) // 2
    slots = [F.col(f"{name}{i}" if i <= room else newest).alias(f"{name}{i}")
             for name, newest in (("v", "cur"), ("f", "feat")) for i in range(1, room + 2)]
    return hop.select("walk_no", "start", "prev", *_carried(hop), "cur", *slots)


def _biased_draw(met: DataFrame, p: float, q: float, weighs: bool) -> DataFrame:
    """Add ``pos``, the position of the next vertex in the list of ``cur``; without a lambda unless vertices share neighbours."""
    back = F.coalesce(F.array_position("nbr", F.col("prev")), F.lit(0))
    met = met.withColumn("back", back)
    met = met.withColumn("amount", F.coalesce(draw.amount_with_return(
        F.col("sums"), F.col("back"),
        F.coalesce(F.get("weight", (F.col("back") - 1).cast("int")), F.lit(0.0)), F.col("u"), p, q), F.lit(0.0)))
    by_sums = draw.reach(F.col("sums"), F.col("amount"))
    if not weighs:
        return met.withColumn("pos", by_sums)
    # Only where vertices share neighbours must every candidate be weighed.
    some = F.coalesce(F.size("met_before"), F.lit(0)) > 0
    met = met.withColumn("b", F.when(some, draw.biased(F.col("weight"), F.col("back"), F.col("met_before"), p, q)))
    by_weighing = draw.pick(F.col("b"), F.col("u") * draw.total(F.col("b")))
    return met.withColumn("pos", F.when(F.col("b").isNull(), by_sums).otherwise(by_weighing))


def as_walks(state: DataFrame, layout: Layout, hops: int, with_start: bool = True, keep: tuple = ()) -> DataFrame:
    """The last ``hops`` hops of states as paths and features; in directed graphs some may be missing."""
    state = _named_features(state, layout, hops)
    room = sum(_is_slot(c) for c in state.columns) // 2
    last = range(room - hops + 1, room + 1)
    path = F.array(*(["start"] if with_start else []), *[f"v{i}" for i in last])
    feats = F.array(*[f"f{i}" for i in last])
    if layout.directed:
        path, feats = F.array_compact(path), F.array_compact(feats)
    return state.select("walk_no", "start", *keep, path.alias("path"), feats.alias("feats"))


def random_walk(adj: DataFrame | Lists | Layout, walk_length: int = 80, num_walks: int = 10,
                p: float = 1.0, q: float = 1.0, seed: int = 42, directed: bool = False,
                starts: DataFrame | None = None, checkpoint_every: int = 8,
                num_partitions: int | None = None, scratch: Scratch | None = None,
                walks_per_task: int = WALKS_PER_TASK, method: str = "sums", resume: str | None = None) -> DataFrame:
    """Walks of ``walk_length`` biased hops after the first: paths and features of the vertices met.

    ``path`` starts with the start vertex; ``feats[i]`` belongs to ``path[i + 1]``.
    A directed walk that reaches a vertex without out-edges ends there.
    Walks up to ``checkpoint_every`` hops are one stretch; longer ones write
    their stretches to ``scratch``, or below the shared folder ``resume``, from
    which a run that was stopped goes on where the same settings and graph are
    given again.  A layout that was persisted before serves several walks: it is
    left to who persisted it.
    """
    layout = adj
    if not isinstance(adj, Layout):
        if not isinstance(adj, Lists):
            scratch = scratch or Scratch(adj.sparkSession)
            adj = hold_lists(adj, scratch.path("adj"), num_partitions)
        scratch = scratch or Scratch(adj.table.sparkSession)
        hubs = scratch.cut(find_hubs(adj.table, num_walks, walks_per_task, starts), "hubs")
        layout = lay_out(adj, hubs, directed, None, scratch, method, q != 1)
    scratch = scratch or Scratch(layout.table.sparkSession)
    if walk_length <= checkpoint_every:
        return expect(_one_stretch(layout, walk_length, num_walks, p, q, seed, starts, scratch), "walks")
    # Every start has as many walks; where there are few starts, the walks' numbers spread them.
    keys = ["start"] if starts is None else ["walk_no", "start"]
    kept = None
    if resume:
        settings = (walk_length, num_walks, p, q, seed, layout.directed, checkpoint_every, layout.method)
        kept = Kept(layout.table.sparkSession, resume, settings, layout.adj, starts)
    return _put_together(_stretches(layout, walk_length, num_walks, p, q, seed, starts,
                                    checkpoint_every, scratch, walks_per_task, kept), keys)


def _one_stretch(layout: Layout, walk_length: int, num_walks: int, p: float, q: float, seed: int,
                 starts: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Short walks, written once, so that the lists are laid out once for all steps and can be let go."""
    held = layout.kept
    kept = layout.persist() if walk_length and not held else layout
    state = _advance(walk_start(kept, num_walks, seed, starts), kept, 1, walk_length, p, q, seed)
    walks = as_walks(state, kept, walk_length + 1)
    if not walk_length:
        return walks
    try:
        return scratch.cut(walks, "walks")
    finally:
        if not held:
            kept.release()


class Kept:
    """Stretches in a folder of their settings and graph; one counts once its note is written behind it."""

    def __init__(self, spark: SparkSession, folder: str, settings: tuple, *tables: DataFrame | None):
        self.spark = spark
        prints = [None if t is None else tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*t.columns)), F.sum(
            F.shiftright(F.xxhash64(*reversed(t.columns)), 24))).first()) for t in tables]
        name = hashlib.sha256(repr((settings, prints)).encode()).hexdigest()[:24]
        self.folder = f"{folder.rstrip('/')}/walks-{name}"

    def find(self, number: int) -> DataFrame | None:
        """The stretch, if it was written to its end."""
        try:
            self.spark.read.parquet(f"{self.folder}/{number:05d}.done")
        except AnalysisException:
            return None
        return self.spark.read.parquet(f"{self.folder}/{number:05d}")

    def keep(self, stretch: DataFrame, number: int) -> DataFrame:
        path = f"{self.folder}/{number:05d}"
        stretch.write.mode("overwrite").parquet(path)
        self.spark.range(1).write.mode("overwrite").parquet(path + ".done")
        return self.spark.read.schema(stretch.schema).parquet(path)


def _stretches(layout: Layout, walk_length: int, num_walks: int, p: float, q: float, seed: int,
               starts: DataFrame | None, every: int, scratch: Scratch,
               walks_per_task: int, kept: Kept | None = None) -> list[DataFrame]:
    """Walk and write stretch by stretch; between two, spread the vertices that have become crowded."""
    given = layout if layout.kept else None
    layout = given or layout.persist()
    state = walk_start(layout, num_walks, seed, starts)
    written, many = [], None
    try:
        for first in range(1, walk_length + 1, every):
            last = min(first + every - 1, walk_length)
            found = kept.find(len(written)) if kept else None
            if found is None:
                state = _advance(state, layout, first, last, p, q, seed)
                opening = first == 1
                hops = last - first + (2 if opening else 1)
                keep = () if last == walk_length else ("prev", "cur", *_carried(state))
                walked = as_walks(state, layout, hops, opening, keep)
                stretch = kept.keep(walked, len(written)) if kept else scratch.cut(walked, "stretch")
            else:
                stretch = _told_again(found, layout)
            written.append(stretch.select("walk_no", "start", F.lit(len(written)).alias("stretch"),
                                          "path", "feats"))
            if last == walk_length:
                break
            state = stretch.select("walk_no", "start", "prev", *_carried(stretch), "cur")
            if layout.directed:
                state = state.where(F.col("cur").isNotNull())
            many = stretch.count() > walks_per_task if many is None else many
            if not many:
                continue
            over = scratch.cut(crowded(state, layout.hubs, walks_per_task), "crowded")
            if not over.isEmpty():
                before, layout = layout, more_copies(layout, over, scratch)
                if before is not given:
                    before.release()
                to = layout.hubs.select(F.col("id").alias("cur"), F.col("copies").alias("to"))
                state = attach(state.drop("to"), to, "cur", "left").withColumn(
                    "to", F.coalesce("to", F.lit(1)))
    finally:
        if layout is not given:
            layout.release()
    return written


def _told_again(stretch: DataFrame, layout: Layout) -> DataFrame:
    """A stretch found written, with the copies that this layout has, which may be others than when it was written."""
    if "cur" not in stretch.columns:
        return stretch
    stretch = stretch.drop("to")
    if layout.hubs is not None:
        to = layout.hubs.select(F.col("id").alias("cur"), F.col("copies").alias("to"))
        stretch = attach(stretch, to, "cur", "left").withColumn("to", F.coalesce("to", F.lit(1)))
    return stretch.withColumn("to", F.lit(1)) if layout.spread and layout.hubs is None else stretch


def _advance(state: DataFrame, layout: Layout, first: int, last: int, p: float, q: float,
             seed: int) -> DataFrame:
    for step in range(first, last + 1):
        state = walk_step(state, layout, step, p, q, seed)
    return state


def _put_together(stretches: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per walk from its stretches; partitioned by ``keys``, which later joins can use."""
    rows = stretches[0]
    for more in stretches[1:]:
        rows = rows.unionByName(more)
    # A column for each stretch: collected and sorted, stretches would be objects, and a task holds many walks.
    one = lambda i: F.first(F.when(F.col("stretch") == i, F.struct("path", "feats")), ignorenulls=True)
    number = range(len(stretches))
    walks = rows.repartition(*keys).groupBy("walk_no", "start").agg(*[one(i).alias(f"s{i}") for i in number])
    # A walk that has ended has no later stretches.
    whole = lambda part: F.flatten(F.array_compact(F.array(*[F.col(f"s{i}.{part}") for i in number]))).alias(part)
    return expect(walks.select("walk_no", "start", whole("path"), whole("feats")), "walks")


def multi_walk(walk_sets: list[DataFrame]) -> DataFrame:
    """Several walk sets as one."""
    rows = expect(walk_sets[0], "walks")
    for more in walk_sets[1:]:
        rows = rows.unionByName(expect(more, "walks"))
    return rows


def feature_walk(walks: DataFrame) -> DataFrame:
    """The features met on each walk, in order."""
    return expect(walks, "walks").select("walk_no", "start", "feats")


def hop_tag(walks: DataFrame, adj: DataFrame | Lists) -> DataFrame:
    """Each hop after the start, tagged 0 back at the start, 1 at a neighbour of it, 2 elsewhere."""
    adj = adj.table if isinstance(adj, Lists) else adj
    near = expect(adj, "adj").select(F.col("id").alias("start"), F.col("nbrs.nbr").alias("near"))
    hops = (expect(walks, "walks").join(near, "start")
            .select("walk_no", "start", "near",
                    F.posexplode(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))
                     .alias("pos", "node")))
    tag = (F.when(F.col("node") == F.col("start"), 0)
            .when(F.array_contains("near", F.col("node")), 1).otherwise(2))
    return hops.select("walk_no", "start", (F.col("pos") + 1).alias("hop"), "node",
                       tag.alias("tag"))


def _carried(state: DataFrame) -> list[str]:
    return [c for c in ("shared", "to") if c in state.columns]


def _last(sums: str) -> Column:
    return F.get(sums, F.size(sums) - 1)


def _hop(layout: Layout) -> list[Column]:
    """The drawn vertex, its feature, what its list shares with the one just left, and its copies where there are any."""
    told = [F.element_at("copies", F.col("pos")).alias("to")] if layout.spread else []
    if layout.near is not None:
        told.append(F.element_at("shared", F.col("pos")).alias("shared"))
    return [F.element_at("nbr", F.col("pos")).alias("cur"),
            F.element_at("feat", F.col("pos")).alias("feat"), *told]


def _choose_copy(state: DataFrame, step: int) -> DataFrame:
    """Give each walk the copy of its vertex that it will read; spread walks that have ended."""
    mixed = F.hash("walk_no", "start", F.lit(step))
    copy = F.when(F.col("cur").isNull(), mixed).otherwise(F.pmod(mixed, F.col("to")))
    return state.withColumn("to_copy", copy)
