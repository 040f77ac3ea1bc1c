"""Line shapes, and each writer with its reader."""

import pytest

from meander.functions import text as X
from meander.operators import padding as P
from meander.sources import readers as R, rejects, writers as W
from tests.conftest import rows


def test_lines_kept_and_dropped(lines):
    kept = lines("a b", "a  b", " a b ", "a\tb", "a x b", "", " ", "\t", "a", "x x")
    assert rows(R.edges_from_lines(kept)) == [("a", "b", 1.0)] * 5 + [("x", "x", 1.0)]
    assert rows(R.features_from_lines(kept)) == [("a", "b")] * 5 + [("x", "x")]
    assert P.drop_malformed(kept).count() == 6


@pytest.mark.parametrize("line, want", [
    ("a b 2.5", ("a", "a", "b", "b", 2.5)),
    ("a b z", ("a", "a", "b", "b", 1.0)),
    ("12 34", ("12", "12", "34", "34", 1.0)),
    ("a\u0001F b\u0001G", ("a", "F", "b", "G", 1.0)),
    ("a\u0001F\u0001H b\u0001", ("a", "H", "b", "b", 1.0)),
    ("a\u0001F\u0001 b", ("a", "F", "b", "b", 1.0)),
    ("a b 0", None), ("a b -1", None), ("a", None), ("", None),
    ("\u0001F b", None), ("\u0001 b", None),
])
def test_padded_lines(lines, line, want):
    assert rows(R.padded_from_lines(lines(line))) == ([want] if want else [])


def test_indexed_lines(lines):
    got = R.indexed_from_lines(lines("1 2", "3\u0001F 4\u0001G 5", "a 2", "1 b", "9"))
    assert rows(got) == [(1, 2, "1", "2", 1.0), (3, 4, "F", "G", 5.0)]


def test_corpora(lines):
    assert rows(R.corpus_from_lines(lines("a b", " c  d ", "", " "))) == [(["a", "b"],), (["c", "d"],)]
    got = R.feat_corpus_from_lines(lines("n#1#a b", "plain c", "n#2#"), "#")
    assert rows(got) == [(["a", "b"],), (["plain", "c"],)]


def test_numbers(spark, lines):
    got = lines("1.5", "x", "", "1e3", None).select(X.number_or(X.trimmed("value"), 1.0).alias("n"))
    assert rows(got) == [(1.0,), (1.0,), (1.0,), (1.5,), (1000.0,)]


def test_padded_round_trip(spark, tmp_path):
    padded = spark.createDataFrame(
        [("a", "F", "b", "G", 1.0), ("c", "c", "d", "H", 2.5)],
        "src string, src_feat string, dst string, dst_feat string, weight double")
    W.write_text(W.padded_lines(padded), str(tmp_path / "p"))
    assert rows(R.read_padded(spark, str(tmp_path / "p"))) == rows(padded)


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_node2id_round_trip(spark, tmp_path, fmt):
    ids = spark.createDataFrame([("a", 0), ("b,c", 1), ("(d)", 2)], "node string, id bigint")
    W.write_node2id(ids, str(tmp_path / "n"), fmt)
    assert rows(R.read_node2id(spark, str(tmp_path / "n"), fmt)) == rows(ids)


def test_node2feat_round_trip(spark, tmp_path):
    feats = spark.createDataFrame([("a", "F"), ("a", "G"), ("b", "F")], "node string, feat string")
    W.write_text(W.node2feat_lines(feats), str(tmp_path / "n"))
    assert rows(R.read_node2feat(spark, str(tmp_path / "n"))) == rows(feats)


def test_walk_lines(spark, tmp_path):
    named = spark.createDataFrame(
        [(0, "a", 5, "A", [5, 6, 7], ["F", "G"])],
        "walk_no int, node string, start bigint, feat string, path array<bigint>, feats array<string>")
    assert rows(W.walk_lines(named)) == [("a\u00015\u00015 6 7",)]
    assert rows(W.feat_walk_lines(named, "#")) == [("a#5#F G",)]
    assert rows(W.feat_walk2_lines(named)) == [("a\u0001A\u0001F G",)]
    W.write_text(W.feat_walk_lines(named), str(tmp_path / "w"))
    assert rows(R.read_feat_corpus(spark, str(tmp_path / "w"))) == [(["F", "G"],)]


def test_half_indexed_and_vector_lines(spark):
    half = spark.createDataFrame([(3, "A", "b", "B", 1.0)],
                                 "src_id bigint, src_feat string, dst string, dst_feat string, weight double")
    assert rows(W.half_indexed_lines(half)) == [("b \u0001 3 A B",)]
    vecs = spark.createDataFrame([("a", "F", 1, [0.5, -2.0])],
                                 "node string, feat string, id bigint, vector array<float>")
    assert rows(W.node_vector_lines(vecs)) == [("a\t0.5,-2.0",)]
    assert rows(W.feat_vector_lines(vecs)) == [("a\tF\t0.5,-2.0",)]


def test_sink_does_not_overwrite(spark, lines, tmp_path):
    W.write_text(lines("a"), str(tmp_path / "x"))
    with pytest.raises(Exception, match="already exists"):
        W.write_text(lines("b"), str(tmp_path / "x"))


BAD = {"edges": {"a b": None, "": "blank", " \t": "blank", "a ": "one token", "a x b": None},
       "features": {"a f": None, "a": "one token"},
       "padded": {"a\u0001f b": None, "\u0001f b": "no name", "a \u0001": "no name", "a b 0": "weight not above 0", "a b -1.5": "weight not above 0",
                  "a b many": None, "a": "one token", "": "blank"},
       "indexed": {"1\u0001f 2": None, "x 2": "no number", "1 99999999999999999999": "no number", "1 2 0": "weight not above 0"},
       "node2feat": {"a\u0001f": None, "a": "no feature", "\u0001f": "no name", "": "blank"}}


@pytest.mark.parametrize("kind", sorted(BAD))
def test_rejected_lines_have_a_reason(lines, kind):
    table = lines(*BAD[kind])
    got = {r.value: r.reason for r in rejects.rejected(table, kind).collect()}
    assert got == {v: why for v, why in BAD[kind].items() if why}
    watched, seen = rejects.watched(table, kind)
    parse = getattr(R, kind + "_from_lines")
    taken = parse(watched).count()
    # What isn't rejected is what the source takes.
    assert taken == parse(table).count() == sum(why is None for why in BAD[kind].values()) == seen.get["taken"]
    for why in rejects.REASONS:
        assert seen.get[why] == sum(w == why for w in BAD[kind].values())


def test_kinds_of_rejects():
    with pytest.raises(ValueError):
        rejects.reason("other")


def test_padded_lines_are_taken_apart_once(spark, lines):
    """The conditions on names and weights read the tokens, which they don't work out again."""
    got = R.padded_from_lines(lines("  a\u0001A\tb\u0001B 2 ", "a b", "a b x", "a", "", "a b 0", "\u0001A b"))
    assert rows(got) == [("a", "A", "b", "B", 2.0), ("a", "a", "b", "b", 1.0), ("a", "a", "b", "b", 1.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(value") == 1


def test_patterns_are_used_only_where_lines_need_them(spark, lines):
    """Names are told without a pattern, and a line with single blanks isn't split by one."""
    got = R.indexed_from_lines(lines("1\u0001A 2\u0001B", " 3\u0001A\u0001 \t4 2\n", "1\u0001A  x", "5 6 7 8", "9", None))
    assert rows(got) == [(1, 2, "A", "B", 1.0), (3, 4, "A", "4", 2.0), (5, 6, "5", "6", 7.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Once for each end of an edge and each of what stands before and behind its separator.
    assert plan.count("substring_index") == 4 and "split_part" not in plan.lower() and "stringsplitsql" not in plan.lower()
