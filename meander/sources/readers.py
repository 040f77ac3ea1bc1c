"""Text sources.  Each ``*_from_lines`` parses a table with one column ``value``."""

from __future__ import annotations

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from meander.functions import text as X
from meander.operators.padding import drop_malformed
from meander.params import SEPARATOR
from meander.schemas import expect


def edges_from_lines(lines: DataFrame) -> DataFrame:
    """Unweighted edges: the first and the last token of each line."""
    line = F.col("value")
    return drop_malformed(lines).select(
        X.first_token(line).alias("src"), X.last_token(line).alias("dst"),
        F.lit(1.0).alias("weight"))


def features_from_lines(lines: DataFrame) -> DataFrame:
    """Vertex features: the first token is the vertex, the last its feature."""
    line = F.col("value")
    return drop_malformed(lines).select(
        X.first_token(line).alias("node"), X.last_token(line).alias("feat"))


def padded_from_lines(lines: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """Padded edges ``name<sep>feature name<sep>feature [weight]``.

    A token without a feature is its own feature.  The weight is 1 where it is
    missing or no number; edges of weight 0 or less and empty names drop out.
    """
    # Outputs of generators: the filters would otherwise take a line or a token apart once for every condition.
    line = lines.select(F.explode(F.array(X.trimmed(F.col("value")))).alias("line"))
    tokens = line.select(F.explode(F.array(X.words(F.col("line")))).alias("t")).where(F.size("t") >= 2)
    s, d = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    padded = tokens.select(F.inline(F.array(F.struct(
        X.name_of(s, sep).alias("src"), X.feature_of(s, sep).alias("src_feat"),
        X.name_of(d, sep).alias("dst"), X.feature_of(d, sep).alias("dst_feat"),
        X.number_or(F.get("t", F.lit(2)), 1.0).alias("weight")))))
    return expect(padded.where("src <> '' and dst <> '' and weight > 0"), "padded")


def indexed_from_lines(lines: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """Padded edges whose names are ids already; lines with other names drop out."""
    padded = padded_from_lines(lines, sep)
    ids = padded.select(F.col("src").try_cast("bigint").alias("src_id"),
                        F.col("dst").try_cast("bigint").alias("dst_id"),
                        "src_feat", "dst_feat", "weight")
    return ids.where("src_id is not null and dst_id is not null")


def node2feat_from_lines(lines: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """Vertex and feature in the first two fields; lines with one field drop out."""
    field = F.split_part(F.col("value"), F.lit(sep), F.lit(2))
    rows = lines.select(X.name_of(F.col("value"), sep).alias("node"), field.alias("feat"))
    return rows.where("node <> '' and feat <> ''")


def corpus_from_lines(lines: DataFrame) -> DataFrame:
    """The tokens of each line; blank lines drop out."""
    return (lines.where(~X.is_blank(F.col("value")))
            .select(X.tokens(F.col("value")).alias("tokens")))


def feat_corpus_from_lines(lines: DataFrame, sep: str = SEPARATOR) -> DataFrame:
    """The tokens after the last separator of each line, as walks are written."""
    return corpus_from_lines(lines.select(X.after_last(F.col("value"), sep).alias("value")))


def node2id_from_lines(lines: DataFrame) -> DataFrame:
    """A node index written as ``(name,id)``."""
    line = F.col("value")
    rows = lines.select(F.regexp_extract(line, r"^\((.*),\d+\)$", 1).alias("node"),
                        F.regexp_extract(line, r",(\d+)\)$", 1).try_cast("bigint").alias("id"))
    return rows.where("node <> '' and id is not null")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return edges_from_lines(spark.read.text(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return features_from_lines(spark.read.text(path))


def read_padded(spark: SparkSession, path: str, sep: str = SEPARATOR) -> DataFrame:
    return padded_from_lines(spark.read.text(path), sep)


def read_indexed(spark: SparkSession, path: str, sep: str = SEPARATOR) -> DataFrame:
    return indexed_from_lines(spark.read.text(path), sep)


def read_node2feat(spark: SparkSession, path: str, sep: str = SEPARATOR) -> DataFrame:
    return node2feat_from_lines(spark.read.text(path), sep)


def read_node2id(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "text":
        return node2id_from_lines(spark.read.text(path))
    return expect(spark.read.format(fmt).load(path), "node2id")


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """The vertices named first on each line; blank lines name none."""
    name = X.first_token(F.col("value"))
    return spark.read.text(path).select(name.alias("node")).where("node <> ''").distinct()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus_from_lines(spark.read.text(path))


def read_feat_corpus(spark: SparkSession, path: str, sep: str = SEPARATOR) -> DataFrame:
    return feat_corpus_from_lines(spark.read.text(path), sep)


def load_model(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)
