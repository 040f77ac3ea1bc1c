"""The four commands, each from input files to output files.

Every table that is used more than once is written to the scratch folder
first, so that no input is parsed and no walk is drawn twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meander.functions import text as X
from meander.operators import adjacency as A, embedding as E, index as I, naming as N
from meander.operators import padding as P, walk as W
from meander.operators.joins import attach
from meander.operators.lists import save_lists
from meander.params import Params
from meander.scratch import Scratch
from meander.sources import readers as R, writers as Wr
from meander.sources.rejects import rejected


def padding(spark: SparkSession, params: Params) -> None:
    """Put the features of two vertex types on an edge list; write ``<output>.padd``.

    With ``rejects_path`` this and the walk command also write the lines they drop,
    by reason, a folder for each input.
    """
    params.require("input", "feat_path1", "feat_path2", "output")
    for kind, name, path in (("edges", "edges", params.input), ("features", "features1", params.feat_path1),
                             ("features", "features2", params.feat_path2)):
        _write_rejects(spark, params, kind, name, path)
    with Scratch(spark) as scratch:
        padded = P.pad_edges(R.read_edges(spark, params.input),
                             R.read_features(spark, params.feat_path1),
                             R.read_features(spark, params.feat_path2), scratch)
        Wr.write_text(Wr.padded_lines(padded, params.sep), params.output + ".padd",
                      params.num_partitions)


def random_walks(spark: SparkSession, params: Params) -> None:
    """Walk a padded graph and write the walks as ids and as features.

    Writes ``<output>``, ``<feat_walk_path>``, ``<feat_walk_path>2``, and beside
    them the node index (``.node2id``) and the features of sources
    (``.node2feat``); with ``half_indexed`` the edges with the source's id
    (``.j2``), with ``lists_path`` the neighbour lists, for other walks.  With
    ``resume_path`` the stretches of the walks stay there, and a command that was
    stopped goes on after the last one.  ``starts_path`` names the vertices to
    start from, one a line; without it walks start everywhere.  With
    ``sinks_path`` the three walk files are written there in one pass, as
    folders ``sink=ids``, ``sink=feats`` and ``sink=feats2``, instead of apart.
    """
    params.require("input", "output", "feat_walk_path")
    with Scratch(spark) as scratch:
        _walk_and_write(spark, params, scratch)


def embedding(spark: SparkSession, params: Params) -> None:
    """Fit vectors on written walks; write ``<output>.bin`` and ``<output>.emb``.

    With ``node_path``, a written node2feat table, the input is taken as feature
    walks and the vectors go beside the vertices that carry each feature;
    without it as id walks, and the vectors go beside the ids, or beside the
    names that ``node2id_path``, a written node index, has for them.
    """
    params.require("input", "output")
    with Scratch(spark) as scratch:
        corpus = scratch.cut(R.read_feat_corpus(spark, params.input, params.sep), "corpus")
        model = E.fit_vectors(corpus, params)
        Wr.save_model(model, params.output + ".bin")
        if params.node_path:
            nodes = R.read_node2feat(spark, params.node_path, params.sep)
            lines = Wr.feat_vector_lines(N.feat_vectors(E.vectors(model), nodes))
        else:
            names = (R.read_node2id(spark, params.node2id_path, params.index_format) if params.node2id_path else None)
            lines = Wr.node_vector_lines(N.node_vectors(E.vectors(model), names))
        Wr.write_text(lines, params.output + ".emb", params.num_partitions)


def full(spark: SparkSession, params: Params) -> None:
    """Walk a padded graph, write the walks, and fit and write vectors.

    Those of its vertices, beside their names, or with ``vectors="features"`` those
    of the features met, beside each source vertex that carries one.
    """
    params.require("input", "output", "feat_walk_path")
    with Scratch(spark) as scratch:
        walks, node2id, node2feat = _walk_and_write(spark, params, scratch)
        of_features = params.vectors == "features"
        model = E.fit_vectors(scratch.cut((E.feat_corpus if of_features else E.id_corpus)(walks), "corpus"), params)
        Wr.save_model(model, params.output + ".bin")
        if of_features:
            lines = Wr.feat_vector_lines(N.feat_vectors(E.vectors(model), node2feat))
        else:
            lines = Wr.node_vector_lines(N.node_vectors(E.vectors(model), node2id))
        Wr.write_text(lines, params.output + ".emb", params.num_partitions)


COMMANDS = {"padding": padding, "randomwalk": random_walks, "embedding": embedding, "full": full}


def run(spark: SparkSession, command: str, params: Params) -> None:
    if command not in COMMANDS:
        raise ValueError(f"command must be one of {', '.join(COMMANDS)}, got {command!r}")
    COMMANDS[command](spark, params)


def _load_graph(spark: SparkSession, params: Params, scratch: Scratch):
    """Indexed edges, the node index and the features of sources, from padded or indexed text.

    Also writes the half-indexed edges, if asked for.
    """
    kind = "indexed" if params.indexed else "padded"
    _write_rejects(spark, params, kind, kind, params.input)
    if params.indexed:
        edges = scratch.cut(R.read_indexed(spark, params.input, params.sep), "edges")
        ids = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
        number = F.col("id").cast("string")
        if params.node_path:  # a vertex that the index doesn't name goes by its id
            ids = ids.join(R.read_node2id(spark, params.node_path, params.index_format), "id", "full")
            number = F.coalesce("node", number)
        node2id = scratch.cut(ids.select(number.alias("node"), "id"), "node2id")
        names = node2id.withColumnRenamed("id", "src_id")
        sources = edges.select("src_id", F.col("src_feat").alias("feat")).distinct()
        node2feat = sources.join(names, "src_id").select("node", "feat")
        if params.half_indexed:
            targets = node2id.select(F.col("node").alias("dst"), F.col("id").alias("dst_id"))
            _write_half_indexed(attach(edges, targets, "dst_id"), params)
        return edges, node2id, scratch.cut(node2feat, "node2feat")
    # Repeated lines collapse here, before any of them is joined.
    padded = scratch.cut(
        R.read_padded(spark, params.input, params.sep)
         .groupBy("src", "src_feat", "dst", "dst_feat").agg(F.max("weight").alias("weight")),
        "padded")
    node2id = scratch.cut(I.node_index(padded, scratch), "node2id")
    if params.half_indexed:
        _write_half_indexed(I.half_indexed(padded, node2id), params)
    edges = scratch.cut(I.index_edges(padded, node2id), "edges")
    return edges, node2id, scratch.cut(P.node2feat(padded), "node2feat")


def _write_rejects(spark: SparkSession, params: Params, kind: str, name: str, path: str) -> None:
    if params.rejects_path:
        rows = rejected(spark.read.text(path), kind, params.sep)
        rows.write.partitionBy("reason").parquet(f"{params.rejects_path.rstrip('/')}/{name}")


def _write_half_indexed(half: DataFrame, params: Params) -> None:
    Wr.write_text(Wr.half_indexed_lines(half, params.sep), params.feat_walk_path + ".j2", params.num_partitions)


def _walk_and_write(spark: SparkSession, params: Params,
                    scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walk, name the walks before they are written once, and fill the sinks without moving them again."""
    edges, node2id, node2feat = _load_graph(spark, params, scratch)
    Wr.write_node2id(node2id, params.feat_walk_path + ".node2id", params.index_format)
    Wr.write_text(Wr.node2feat_lines(node2feat, params.sep), params.feat_walk_path + ".node2feat",
                  params.num_partitions)
    if params.indexed:  # lines may be repeated here; padded ones have collapsed
        edges = scratch.cut(edges.groupBy("src_id", "src_feat", "dst_id", "dst_feat").agg(F.max("weight").alias("weight")), "distinct")
    adj = A.adjacency(edges, params.degree, params.directed, params.weighted)
    if params.lists_path:
        adj = save_lists(adj, params.lists_path, params.num_partitions)
    starts = None
    if params.starts_path:
        wanted = R.read_starts(spark, params.starts_path)
        starts = scratch.cut(node2id.join(wanted, "node", "left_semi").select("id"), "starts")
    walks = W.random_walk(adj, params.walk_length, params.num_walks, params.p, params.q,
                          params.seed, params.directed, starts, checkpoint_every=params.checkpoint_every,
                          num_partitions=params.num_partitions, scratch=scratch, method=params.method,
                          walks_per_task=params.walks_per_task, resume=params.resume_path)
    # Both joins are by the start, as the walks are partitioned.
    feats = node2feat.groupBy("node").agg(F.collect_set("feat").alias("start_feats"))
    names = scratch.cut(node2id.join(feats, "node", "left")
                        .select(F.col("id").alias("start"), "node", "start_feats"), "names")
    walks = scratch.cut(walks.join(names, "start", "left"), "walks")
    named = walks.where(F.col("node").isNotNull() & ~X.is_blank(F.col("node")))
    if params.sinks_path:
        Wr.write_sinks(Wr.sink_lines(named, params.sep), params.sinks_path, params.num_partitions)
        return walks, node2id, node2feat
    with_feat = named.withColumn("feat", F.explode("start_feats"))
    for lines, path in (
            (Wr.walk_lines(named, params.sep), params.output),
            (Wr.feat_walk_lines(named, params.sep), params.feat_walk_path),
            (Wr.feat_walk2_lines(with_feat, params.sep), params.feat_walk_path + "2")):
        Wr.write_text(lines, path, params.num_partitions)
    return walks, node2id, node2feat
