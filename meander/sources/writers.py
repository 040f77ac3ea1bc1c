"""Text sinks.  Each ``*_lines`` makes a table with one column ``value``."""

from __future__ import annotations

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, functions as F

from meander.functions import text as X
from meander.params import SEPARATOR
from meander.schemas import expect


def padded_lines(padded: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """``src<sep>feature dst<sep>feature``, and the weight behind it unless it is 1."""
    weight = F.when(F.col("weight") != 1.0, F.col("weight").cast("string"))
    return expect(padded, "padded").select(F.concat_ws(
        " ", X.padded_token(F.col("src"), F.col("src_feat"), sep),
        X.padded_token(F.col("dst"), F.col("dst_feat"), sep), weight).alias("value"))


def node2id_lines(node2id: DataFrame) -> DataFrame:
    """``(name,id)``"""
    return expect(node2id, "node2id").select(
        F.format_string("(%s,%d)", "node", "id").alias("value"))


def node2feat_lines(node2feat: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    return expect(node2feat, "node2feat").select(F.concat_ws(sep, "node", "feat").alias("value"))


def half_indexed_lines(half: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """``dst <sep> source id, source feature, target feature``"""
    return half.select(F.concat_ws(
        " ", "dst", F.lit(sep), F.col("src_id").cast("string"), "src_feat", "dst_feat")
        .alias("value"))


def walk_lines(named: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """``name<sep>id<sep>vertex vertex ...``"""
    return _walk_lines(named, F.col("start").cast("string"), "path", sep)


def feat_walk_lines(named: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """``name<sep>id<sep>feature feature ...``"""
    return _walk_lines(named, F.col("start").cast("string"), "feats", sep)


def feat_walk2_lines(with_feat: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """``name<sep>feature of the start<sep>feature feature ...``"""
    return _walk_lines(with_feat, F.col("feat"), "feats", sep)


def _walk_lines(walks: DataFrame, second, tokens: str, sep: str) -> DataFrame:
    return walks.select(
        F.concat_ws(sep, "node", second, X.joined(F.col(tokens), " ")).alias("value"))


def sink_lines(named: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """The lines of all three walk files, told apart by ``sink``: ids, feats, feats2.

    ``named`` has ``start_feats``, the features of the start; a walk is read once
    and its lines are made beside each other.
    """
    def line(second, tokens):
        return F.concat_ws(sep, "node", second, X.joined(F.col(tokens), " "))

    number = F.col("start").cast("string")
    feats2 = F.transform(F.coalesce("start_feats", F.array().cast("array<string>")), lambda feat: F.struct(
        F.lit("feats2").alias("sink"), line(feat, "feats").alias("value")))
    lines = F.concat(F.array(F.struct(F.lit("ids").alias("sink"), line(number, "path").alias("value")),
                             F.struct(F.lit("feats").alias("sink"), line(number, "feats").alias("value"))), feats2)
    return named.select(F.inline(lines))


def node_vector_lines(vectors: DataFrame) -> DataFrame:
    """``name<tab>v1,v2,...``"""
    return vectors.select(
        F.concat_ws("\t", "node", X.joined(F.col("vector"), ",")).alias("value"))


def feat_vector_lines(vectors: DataFrame) -> DataFrame:
    """``name<tab>feature<tab>v1,v2,...``"""
    return vectors.select(
        F.concat_ws("\t", "node", "feat", X.joined(F.col("vector"), ",")).alias("value"))


def write_text(lines: DataFrame, path: str, num_partitions: int | None = None,
               mode: str = "errorifexists") -> None:
    if num_partitions:
        lines = lines.repartition(num_partitions)
    lines.write.mode(mode).text(path)


def write_sinks(lines: DataFrame, path: str, num_partitions: int | None = None,
                mode: str = "errorifexists") -> None:
    """One pass over (sink, value); each sink is a folder of text, ``<path>/sink=<name>``."""
    if num_partitions:
        lines = lines.repartition(num_partitions)
    lines.write.mode(mode).partitionBy("sink").text(path)


def write_node2id(node2id: DataFrame, path: str, fmt: str = "parquet",
                  mode: str = "errorifexists") -> None:
    rows = node2id_lines(node2id) if fmt == "text" else expect(node2id, "node2id")
    rows.write.mode(mode).format(fmt).save(path)


def save_model(model: Word2VecModel, path: str) -> None:
    model.write().overwrite().save(path)
