"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end; the
stream is cut into blocks of ``block_tokens`` words.  The mix is a list of
slots, each for one block.  Slot n goes to the source in whose share of [0, 1)
the n-th multiple of the golden ratio falls, so every stretch of the mix holds
the sources in nearly their shares.  A source's slots are ranked; rank r takes
block r of the source's stream, starting again when it is used up, and the
last slot of a source is cut so that the words taken are its target, rounded.
The golden points miss a source's number of slots by a few; slots over it stay
void and missing ones follow at the end, the sources in turn.

Targets: sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ..; they
share all words by weight, but none gets more than ``most_repeats`` times its
own words, and the excess is shared again.

Cases: a null or blank text has 0 words and is never taken; a source without
words has target 0.  Rows with the same doc_id and text are rows of their own.
An empty table gives an empty one.  Reruns agree, whatever the partitioning,
but for which of several wholly equal rows is taken more often.  Columns of
other names pass through ``mixed_documents``, whatever they are called but for
names that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meander.llm.common import WORD, running_sums
from meander.operators.joins import attach
from meander.scratch import Scratch

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_TOKENS = 1024
SEED = 7
# Rows of a part of a source's stream, which is sorted by itself; there are 2 ** LEAST_BITS parts at least.
PART_ROWS, LEAST_BITS = 1 << 14, 10
_GOLDEN = 2654435769  # 2 ** 32 / golden ratio


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """source, number, source_size, target for a table (source, source_size) of one row per source.

    Sharing the excess again and again ends where every source has the smaller
    of its limit and its weight times one level; sorted by the level at which
    a source reaches its limit, the level follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.withColumn("number", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    table = table.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most_repeats))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    table = table.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0)))
                             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    # The first source that doesn't reach its limit at its level sets the level for all after it.
    free = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "number", "level"))).over(every)
    target = F.when(free.isNull() | (F.col("limit") <= free["level"] * F.col("weight")), F.col("limit")).otherwise(free["level"] * F.col("weight"))
    return table.withColumn("target", target).select("source", "number", "source_size", "target")


def _golden(n: Column) -> Column:
    """The n-th golden point as a whole number below 2 ** 32, without overflow."""
    low, high = n.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftright(n, 31)
    return F.pmod(F.pmod(low * F.lit(_GOLDEN), F.lit(1 << 32)) + high * F.lit((_GOLDEN << 31) % (1 << 32)), F.lit(1 << 32))


def schedule(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """slot, number, rank: which source each slot is for.  sources: number, slots (wanted) - one row per source."""
    spark = sources.sparkSession
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    table = scratch.cut(sources.withColumn("past", F.coalesce(F.sum("slots").over(upto), F.lit(0)))
                        .withColumn("all", F.sum("slots").over(Window.partitionBy(F.lit(0)))), "shares")
    total, last = (x or 0 for x in table.agg(F.max("all"), F.max("number")).first())
    edge = lambda c: F.floor(c * F.lit(float(1 << 32)) / F.col("all"))
    spans = (table.where("slots > 0").select("number", edge(F.col("past")).alias("low"), edge(F.col("past") + F.col("slots")).alias("high"))
             .withColumn("cell", F.explode(F.sequence(F.shiftright("low", 20), F.shiftright(F.col("high") - 1, 20)))))
    # At most 4096 rows more than there are sources.
    points = spark.range(total).select(F.col("id").alias("slot"), _golden(F.col("id")).alias("x"))
    drawn = (points.withColumn("cell", F.shiftright("x", 20)).join(spans, "cell").where("x >= low and x < high")
             .select("slot", "number", F.shiftright("slot", 20).alias("stretch")))
    ranked = scratch.cut(running_sums(drawn.withColumn("one", F.lit(1)), ["number"], "stretch", [F.col("slot")], {"rank": "one"})
                         .select("slot", "number", "rank"), "drawn")
    got = ranked.groupBy("number").count()
    quota = table.select("number", "slots")
    kept = ranked.join(quota, "number").where("rank < slots").select("slot", "number", "rank")
    missing = (quota.join(got, "number", "left").where("slots > coalesce(count, 0)")
               .select("number", F.posexplode(F.expr("sequence(coalesce(count, 0), slots - 1)")).alias("turn", "rank"))
               .select((F.lit(total) + F.col("turn") * F.lit(last + 1) + F.col("number")).alias("slot"), "number", "rank"))
    return kept.unionByName(missing)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS,
        block_tokens: int = BLOCK_TOKENS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """The mix: slot, source, doc_id, row, round, piece_start, piece_words - every stretch of a document that a slot holds.

    piece_start counts the document's words before the stretch; round, how often the source was used up before.
    ``row`` tells rows apart; see ``taken_words`` for the totals.
    """
    table, rows = _streams(docs, scratch, weights, most_repeats, block_tokens, seed, doc_id, text, source)
    return _pieces(table, rows, scratch, block_tokens)


def _streams(docs, scratch, weights, most_repeats, block_tokens, seed, doc_id, text, source):
    rows = scratch.cut(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("shuffle"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("check"),
        F.monotonically_increasing_id().alias("row")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    b = F.lit(block_tokens)
    table = source_targets(sizes, weights, most_repeats).withColumn("want", F.floor(F.col("target") + 0.5))
    table = (table.withColumn("blocks", F.ceil(F.col("source_size") / b))
             .withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size")) * F.col("blocks")
                                         + F.ceil(F.pmod(F.col("want"), F.col("source_size")) / b)).otherwise(0)))
    table = scratch.cut(table, "sources")
    keyed = attach(rows.withColumn("key", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))).drop("source"),
                   table.select(F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("key"),
                                "number", "source", "source_size", "target", "want", "blocks"), "key").drop("key")
    part = F.pmod(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long"), F.lit(1 << 32))
    bits = min(32, max(LEAST_BITS, (rows.count() // PART_ROWS).bit_length()))
    keyed = keyed.withColumn("part", F.shiftright(part, 32 - bits))
    laid = running_sums(keyed, ["number"], "part", [F.col("shuffle"), F.col("doc_id"), F.col("check"), F.col("row")], {"begin": "size"})
    return table, scratch.cut(laid, "streams")


def _pieces(table, rows, scratch, block_tokens):
    b = F.lit(block_tokens)
    slots = schedule(table.select("number", "slots"), scratch)
    cycle = table.select("number", "blocks", "source_size", "want")
    # Slot of rank r: block r of the stream, over and over; the words from its rank's place to the target at most.
    slots = (slots.join(cycle.where("blocks > 0"), "number")
             .withColumn("block", F.pmod("rank", "blocks")).withColumn("round", F.floor(F.col("rank") / F.col("blocks")))
             .withColumn("stop", F.least((F.col("block") + 1) * b, F.col("source_size"), F.col("want") - F.col("round") * F.col("source_size")))
             .select("slot", "number", "block", "round", "stop"))
    spread = (rows.where("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b)))))
    start = F.greatest(F.col("begin"), F.col("block") * b)
    words = F.least(F.col("begin") + F.col("size"), F.col("stop")) - start
    return (spread.select("number", "block", "begin", "size", "source", "doc_id", "row").join(slots, ["number", "block"])
            .select("slot", "source", "doc_id", "row", "round", (start - F.col("begin")).alias("piece_start"), words.alias("piece_words"))
            .where("piece_words > 0"))


def taken_words(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS,
                block_tokens: int = BLOCK_TOKENS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, first_slot, n_slots.

    taken: words the mix takes of it; first_slot, n_slots: the first and how many of the slots that hold some of them.
    """
    table, rows = _streams(docs, scratch, weights, most_repeats, block_tokens, seed, doc_id, text, source)
    # A slot holds one stretch of a row.
    taken = _pieces(table, rows, scratch, block_tokens).groupBy("row").agg(
        F.sum("piece_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    return (rows.join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots")))


def mixed_documents(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS,
                    block_tokens: int = BLOCK_TOKENS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """The documents of the mix with the columns of ``docs``, in the order of the schedule.

    Each time the mix takes a document it stands where the first slot is that
    holds some of it; the rows are range-partitioned and sorted by slot.  One of
    which the mix takes only its first words, at a source's last slot, has its
    text cut there.  n_chars, if there, follows the text.  Documents without
    words stay as they are, spread over the slots.  Equal rows share evenly what
    is taken of them.
    """
    table, rows = _streams(docs, scratch, weights, most_repeats, block_tokens, seed, doc_id, text, source)
    times = (_pieces(table, rows, scratch, block_tokens).groupBy("row", "round")
             .agg(F.sum("piece_words").alias("words"), F.min("slot").alias("slot")))
    # Rows with the same doc_id, source and text are alike and share their places; the key is the one
    # _streams reads, on the rows as they are read again.
    key = ["__id", "__source", "__check"]
    known = rows.select(
        "row", "size", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"),
        F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("__source"),
        F.col("check").alias("__check"))
    same = known.groupBy(*key).agg(F.max("size").alias("__size"), F.count("*").alias("__same"))
    slots = table.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    blank = known.where("size = 0").select(*key).distinct().select(
        *key, F.lit(0).cast("long").alias("low"), F.lit(max(0, slots - 1)).cast("long").alias("high"), F.lit(0).cast("long").alias("words"))
    taken = (known.join(times, "row").groupBy(*key, "round")
             .agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.sum("words").alias("words")).drop("round"))
    # A few bytes a document: under Spark's threshold they are broadcast and the texts move once, into the
    # order of the slots; beyond it twice, first to their places.
    places = scratch.cut(taken.unionByName(blank).join(same, key)
                         .withColumn("words", F.floor(F.col("words") / F.col("__same"))).where("words > 0 or __size = 0")
                         .groupBy(*key, "__size").agg(F.collect_list(F.struct("low", "high", "words")).alias("__times")), "places")
    keyed = docs.withColumns({
        "__id": F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")),
        "__source": F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source).cast("string"), F.lit(""))),
        "__check": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        "__spread": F.xxhash64(F.col(doc_id), F.monotonically_increasing_id())})
    copies = keyed.join(places, key).withColumn("__time", F.explode("__times"))
    low, high = F.col("__time.low"), F.col("__time.high")
    copies = copies.select(*docs.columns, "__size", F.col("__time.words").alias("__words"),
                           (low + F.pmod("__spread", high - low + 1)).alias("__slot"))
    copies = copies.repartitionByRange("__slot").sortWithinPartitions("__slot")
    cut = (F.col("__words") < F.col("__size"))
    copies = copies.withColumn(text, F.when(cut, _first_words(F.col(text), F.col("__words"))).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(cut, F.length(F.col(text)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return copies.select(*docs.columns)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word: the words' lengths tell where that is."""
    gaps = F.split(text, WORD)  # what stands before, between and after the words
    words = F.regexp_extract_all(text, F.lit("(" + WORD + ")"))
    length = lambda parts: F.aggregate(F.slice(parts, F.lit(1), n.cast("int")), F.lit(0), lambda a, x: a + F.length(x))
    return F.substring(text, F.lit(1), length(gaps) + length(words))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken_words(docs, Scratch(spark))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CAST(number % 3 + 1 AS DOUBLE) AS weight, 3.0 * source_size AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY lim / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, lim / weight) AS level FROM l WHERE lim > level * weight),
t AS (SELECT l.source, l.number, CAST(source_size AS BIGINT) AS source_size, CAST(CASE WHEN f.level IS NULL OR lim <= f.level * weight THEN lim ELSE f.level * weight END AS DOUBLE) AS target FROM l, f),
-- Slots a source wants, and where its share of them begins.
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want, CAST(ceil(source_size / {BLOCK_TOKENS}.0) AS BIGINT) AS blocks FROM t),
n AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size * blocks + CAST(ceil((want % source_size) / {BLOCK_TOKENS}.0) AS BIGINT) ELSE 0 END AS slots FROM q),
e AS (SELECT *, sum(slots) OVER () AS total, sum(slots) OVER (ORDER BY number) - slots AS past, max(number) OVER () + 1 AS sources FROM n),
-- The golden points, each in the share of one source, ranked by source.
g AS (SELECT slot, (CAST(slot AS HUGEINT) * {_GOLDEN}) % 4294967296 AS x FROM (SELECT unnest(range(CAST((SELECT max(total) FROM e) AS BIGINT))) AS slot)),
r AS (SELECT slot, e.number, row_number() OVER (PARTITION BY e.number ORDER BY slot) - 1 AS place, slots
      FROM g JOIN e ON slots > 0 AND x >= floor(past * 4294967296.0 / total) AND x < floor((past + slots) * 4294967296.0 / total)),
c AS (SELECT e.number, e.total, e.sources, e.slots, count(slot) AS got FROM e LEFT JOIN r ON r.number = e.number GROUP BY ALL),
u AS (SELECT slot, number, place FROM r WHERE place < slots
      UNION ALL SELECT total + (place - got) * sources + number, number, place
      FROM (SELECT *, unnest(range(CAST(got AS BIGINT), CAST(slots AS BIGINT))) AS place FROM c)),
p AS (SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, e.number, want, blocks, row_number() OVER (ORDER BY doc_id, shuffle) AS id,
             sum(size) OVER (PARTITION BY e.number ORDER BY shuffle, doc_id) - size AS first
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
-- A row's blocks, and the words of each that a slot takes in its round.
b AS (SELECT p.*, unnest(range(CAST(first // {BLOCK_TOKENS} AS BIGINT), CAST((first + size - 1) // {BLOCK_TOKENS} + 1 AS BIGINT))) AS block FROM p WHERE size > 0),
v AS (SELECT b.id, u.slot, least(first + size, (block + 1) * {BLOCK_TOKENS}, want - place // blocks * source_size) - greatest(first, block * {BLOCK_TOKENS}) AS words
      FROM b JOIN u ON u.number = b.number AND u.place % b.blocks = b.block),
k AS (SELECT id, sum(words) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM v WHERE words > 0 GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot,
       CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots
FROM p LEFT JOIN k USING (id)
"""
