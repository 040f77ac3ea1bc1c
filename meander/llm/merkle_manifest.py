"""A Merkle manifest of a dataset: a tree over each source's rows, and one over the sources' roots.

A digest is the lowercase hex sha256 of its inputs, concatenated.  A row's leaf
is the digest of its fields, each ``-`` if null, else byte count, ``:`` and value.
Every ``ARITY`` consecutive nodes become their digest (the last ones: fewer, even
one) while there are several; one node that remains is the root.

Concatenated-level strings.  Nodes are numbered, and ``ARITY`` ** ``LEVELS``
consecutive ones, aligned, make a block.  A block has each of its levels as
one string of digests of equal width: parents are the digests of fixed-width
substrings of the level below, and what flanks a node inside its run's substring
are its siblings.  A block's last level is one digest; these are the nodes of the
next layer of blocks, until a group has one block.  So no task holds more than a
block, whatever share of the rows a source has, and there are as many layers
as the largest group's size has powers of the block's.

A proof is a list of (left, right) siblings, level by level: those within the
node's block, then those of the block's digest in the layers above, then those
of the source's root.

Cases: a null source is a source of its own, the first.  Rows are ordered by
doc_id (null first), and rows that repeat a doc_id by their digests; each is a
leaf.  Null fields are told from empty ones.  An empty table gives an empty
manifest.  Other columns are neither read nor proven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meander.scratch import Scratch

ARITY, LEVELS, WIDTH = 3, 6, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SEGMENT = "struct<left:string,right:string>"


def leaf(fields: list[Column]) -> Column:
    """The digest of the fields."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*each), 256)


def numbered(rows: DataFrame, group: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos``, each row's number within its group from 0, and ``n``, the group's rows.

    Rows are range-partitioned by group and order, so a group may own any share
    of them, and written; the rows of a group in the partitions before give the rest.
    """
    ordered = [F.col(group).asc_nulls_first(), *order]
    written = scratch.cut(rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
                          .withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each source and partition that holds some of it.
    held = written.groupBy(F.col(group).alias("__group"), part.alias("__part")).agg(F.count("*").alias("__n"), F.min(row).alias("__first"))
    all_ = Window.partitionBy("__group")
    held = held.select("__group", "__part", F.sum("__n").over(all_).alias("n"), (
        F.sum("__n").over(all_.orderBy("__part")) - F.col("__n") - F.col("__first")).alias("__shift"))
    met = written.withColumns({"__part": part, "__row": row}).alias("w").join(
        held.alias("h"), F.col(f"w.{group}").eqNullSafe(F.col("h.__group")) & (F.col("w.__part") == F.col("h.__part")))
    return met.select(*[f"w.{c}" for c in rows.columns], (F.col("__row") + F.col("__shift")).alias("pos"), "n")


def blocks(nodes: DataFrame, group: str, levels: int = LEVELS) -> DataFrame:
    """group, block, n, members, level0 .. level<levels>, root, from rows (group, pos, n, node, member).

    ``members`` holds what is known of each node, in order.  A block that is its
    group's only one ends at its first level of one digest; others have all
    levels.  ``root`` is the last digest; levels beyond it are null.
    """
    size = ARITY ** levels
    rows = nodes.groupBy(group, F.expr(f"pos div {size}").alias("block"), "n").agg(
        F.sort_array(F.collect_list(F.struct("pos", "node", "member"))).alias("rows"))
    # Binary: a substring's place in text would be counted from the start.
    out = rows.select(group, "block", "n", F.col("rows.member").alias("members"),
                      F.array_join("rows.node", "").cast("binary").alias("level0"))
    for k in range(levels):
        out = out.withColumn(f"level{k + 1}", F.expr(f"""if(n <= {size} and length(level{k}) <= {WIDTH}, null, cast(array_join(
            transform(sequence(0, (length(level{k}) - 1) div {ARITY * WIDTH}),
                      i -> sha2(substring(level{k}, i * {ARITY * WIDTH} + 1, {ARITY * WIDTH}), 256)), '') as binary))"""))
    last = F.coalesce(*[f"level{k}" for k in range(levels, -1, -1)])
    return out.withColumn("root", last.cast("string"))


def segments(place: str, levels: int = LEVELS) -> str:
    """SQL: the siblings of node ``place`` of a block on each level below its root."""
    each = []
    for k in range(levels):
        at, run = f"({place} div {ARITY ** k})", f"({place} div {ARITY ** (k + 1)})"
        left = f"substring(level{k}, {run} * {ARITY * WIDTH} + 1, ({at} % {ARITY}) * {WIDTH})"
        right = f"substring(level{k}, ({at} + 1) * {WIDTH} + 1, ({ARITY - 1} - {at} % {ARITY}) * {WIDTH})"
        each.append(f"if(level{k + 1} is null, null, struct(cast({left} as string) as left, cast({right} as string) as right))")
    return f"array_compact(array({', '.join(each)}))"


def fold(node: Column, proof: Column) -> Column:
    """The root that follows from a node and its siblings."""
    return F.aggregate(proof, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proofs(nodes: DataFrame, group: str, scratch: Scratch, levels: int = LEVELS) -> DataFrame:
    """group, member, proof of every node, and its group's root.

    ``nodes``: group, pos, n, node, member; positions are gapless in a group.
    """
    size = ARITY ** levels
    layers, largest = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        layers.append(scratch.cut(blocks(nodes, group, levels), "blocks", "zstd"))
        if largest <= size:
            break
        nodes = layers[-1].where(f"n > {size}").select(
            group, F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("root").alias("node"),
            F.col("block").alias("member"))
        largest = -(-largest // size)
    up = None
    for layer in reversed(layers):
        rows = layer.where(f"n <= {size}").withColumn("top", F.expr(f"cast(array() as array<{_SEGMENT}>)"))
        if up is not None:
            tops = up.select(F.col(group).alias("__group"), F.col("member").alias("__block"), F.col("proof").alias("top"), "root")
            part = layer.where(f"n > {size}").drop("root")
            part = part.join(tops, part[group].eqNullSafe(tops["__group"]) & (part["block"] == tops["__block"]))
            rows = rows.unionByName(part.drop("__group", "__block"))
        each = f"transform(members, (m, i) -> struct(m as member, {segments('i', levels)} as own))"
        # Members one by one, before their proofs are put together: a block's strings aren't repeated.
        up = (rows.select(group, "root", "top", F.expr(f"inline({each})"))
              .select(group, "member", F.concat("own", "top").alias("proof"), "root"))
    return up


def manifest(rows: DataFrame, scratch: Scratch, order: str = "doc_id", source: str = "source", levels: int = LEVELS) -> DataFrame:
    """member, leaf, subroot, root, proof of every row, from rows (source, order, leaf, member)."""
    placed = numbered(rows, source, [F.col(order).asc_nulls_first(), F.col("leaf")], scratch)
    nodes = scratch.cut(placed.select(source, "pos", "n", F.col("leaf").alias("node"),
                                      F.struct("leaf", "member").alias("member")), "leaves", "zstd")
    own = scratch.cut(proofs(nodes, source, scratch, levels).select(
        F.col(source).alias("source"), "member", F.col("root").alias("subroot"), "proof"), "own", "zstd")
    roots = own.groupBy("source").agg(F.first("subroot").alias("node")).withColumn("tree", F.lit(0))
    roots = scratch.cut(numbered(roots, "tree", [F.col("source").asc_nulls_first()], scratch)
                        .select("tree", "pos", "n", "node", F.struct("source").alias("member")), "roots")
    over = proofs(roots, "tree", scratch, levels).select("member.source", "proof", "root")
    tops = over.select(F.col("source").alias("__source"), F.col("proof").alias("__top"), "root")
    met = own.join(tops, own["source"].eqNullSafe(tops["__source"]))
    return met.select("member.member", "member.leaf", "subroot", "root", F.concat("proof", "__top").alias("proof"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(c) for c in FIELDS]
    tampered = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    rows = docs.select("doc_id", "source", leaf(fields).alias("leaf"), F.struct(
        "doc_id", F.when(touched, leaf(tampered)).alias("tampered")).alias("member"))
    proven = manifest(rows, Scratch(spark))
    folded = fold(F.coalesce("member.tampered", "leaf"), F.col("proof"))
    sides = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return (proven.withColumns({"folded_root": folded, "proof_sha256": F.sha2(sides, 256)})
            .select("member.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


# The remainder of a division by the polynomial of crc32, bit by bit: 256 stands for a shift.
_CRC32 = """xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))]),
    lambda acc, x: CASE WHEN x < 256 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295)"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
                                   for c in (*FIELDS[:-1], text)) + ")"


def _levels_sql(name: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3, n)"""


def _fold_sql(name: str, start: str, levels: str) -> str:
    """h: what a row's digest becomes; proof: the siblings met on the way."""
    return f"""{name} AS ({start} UNION ALL
  SELECT f.row, f.tree, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN x.pos = f.pos THEN f.h ELSE x.h END, '' ORDER BY x.pos)),
    f.proof || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> f.pos), '')
  FROM {name} f JOIN {levels} x ON x.tree = f.tree AND x.lvl = f.lvl AND x.pos // 3 = f.pos // 3
  WHERE x.n > 1 GROUP BY f.row, f.tree, f.lvl, f.pos, f.proof, f.h)"""


OP11_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS held FROM documents),
leaves AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_levels_sql("nodes", "SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves")},
subroots AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_levels_sql("upper", "SELECT 0 AS tree, 0 AS lvl, pos, n, subroot AS h FROM subroots")},
{_fold_sql("climbed", "SELECT row, tree, 0 AS lvl, pos, held AS h, '' AS proof FROM leaves", "nodes")},
done AS (SELECT row, tree, h, proof FROM climbed QUALIFY row_number() OVER (PARTITION BY row ORDER BY lvl DESC) = 1),
{_fold_sql("risen", "SELECT d.row, 0 AS tree, 0 AS lvl, s.pos, d.h, d.proof FROM done d JOIN subroots s ON s.source = d.tree", "upper")},
top AS (SELECT row, h, proof FROM risen QUALIFY row_number() OVER (PARTITION BY row ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.h AS folded_root, t.h = r.h AS verified
FROM leaves l JOIN subroots s ON s.source = l.tree JOIN top t ON t.row = l.row JOIN upper r ON r.n = 1
"""
