"""Corpora, vectors, names, and whole runs."""

import math
from types import SimpleNamespace

import pytest

from meander import Params, Scratch
from meander.operators import embedding as E, naming as N, walk as W
from meander.plans import commands as C
from meander.schemas import schema
from meander.scratch import shared_folder
from meander.sources import readers as R, writers as Wr
from tests.conftest import rows

SMALL = Params(dim=6, iterations=1, train_partitions=1, window=2, seed=1)


@pytest.fixture()
def walks(spark):
    return spark.createDataFrame(
        [(0, 0, [0, 1, 2], ["F", "G"]), (1, 0, [0, 2, 0], ["G", "E"]), (0, 1, [1, 0, 1], ["E", "F"])],
        schema("walks"))


@pytest.fixture()
def node2id(spark):
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), (" ", 3)], schema("node2id"))


def test_corpora(walks):
    assert rows(E.id_corpus(walks)) == [(["0", "1", "2"],), (["0", "2", "0"],), (["1", "0", "1"],)]
    assert rows(E.feat_corpus(walks)) == [(["E", "F"],), (["F", "G"],), (["G", "E"],)]


def test_vectors_and_model_round_trip(spark, walks, tmp_path):
    model = E.fit_vectors(E.feat_corpus(walks), SMALL)
    got = {r.word: r.vector for r in E.vectors(model).collect()}
    assert set(got) == {"E", "F", "G"}
    assert all(len(v) == 6 and all(math.isfinite(x) for x in v) for v in got.values())
    Wr.save_model(model, str(tmp_path / "m.bin"))
    again = {r.word: r.vector for r in E.vectors(R.load_model(str(tmp_path / "m.bin"))).collect()}
    assert again == got


def test_too_large_a_vocabulary_is_refused(walks):
    with pytest.raises(ValueError, match="more than"):
        E.check_vocabulary(E.feat_corpus(walks), 2**31)


def test_training_fills_the_cores(spark, walks):
    """No round of tasks is left nearly empty, unless more partitions would send more words than they save."""
    assert E.training_partitions(126_000_000, 1_400, 12) == 36
    assert E.training_partitions(21_000_000, 1_400, 12) == 12
    assert E.training_partitions(21_000_000, 1_400, 5) == 10
    assert E.training_partitions(6_500_000, 540_000, 12) == 10
    assert E.training_partitions(0, 0, 1) == 10
    assert E._measured(E.feat_corpus(walks), 0) == (3, 6, 2)
    assert E._measured(E.feat_corpus(walks), 3) == (0, 6, 2)
    assert E._measured(E.id_corpus(walks).where("false"), 0) == (0, 0, 0)


def test_names(spark, walks, node2id):
    named = N.walks_named(walks, node2id)
    assert rows(named.select("node", "walk_no")) == [("a", 0), ("a", 1), ("b", 0)]
    feats = spark.createDataFrame([("a", "X"), ("a", "Y"), ("a", "X")], schema("node2feat"))
    got = N.walks_with_feat(named, feats).select("walk_no", "node", "feat")
    assert rows(got) == [(0, "a", "X"), (0, "a", "Y"), (1, "a", "X"), (1, "a", "Y")]


def test_vector_joins(spark, node2id):
    vecs = spark.createDataFrame([("0", [1.0]), ("2", [2.0])], schema("vectors"))
    assert rows(N.node_vectors(vecs, node2id)) == [("a", 0, [1.0]), ("c", 2, [2.0])]
    assert rows(N.node_vectors(vecs)) == [("0", 0, [1.0]), ("2", 2, [2.0])]
    feats = spark.createDataFrame([("a", "0"), ("b", "0"), ("a", "0"), ("c", "9")], schema("node2feat"))
    assert rows(N.feat_vectors(vecs, feats)) == [("a", "0", [1.0]), ("b", "0", [1.0])]
    with pytest.raises(ValueError):
        N.feat_vectors(vecs, None)


@pytest.fixture()
def inputs(lines, scratch):
    return Params(
        input=scratch.text(lines("u1 k1", "u1 k2", "u2 k2", "u3 k1", "u3 k3", "u9 k1", "bad")),
        feat_path1=scratch.text(lines("u1 A", "u2 B", "u3 A")),
        feat_path2=scratch.text(lines("k1 X", "k2 Y", "k3 X")),
        output=scratch.path("out"), feat_walk_path=scratch.path("feats"),
        walk_length=3, num_walks=2, dim=4, iterations=1, train_partitions=1)


def test_whole_runs(spark, inputs, scratch):
    C.run(spark, "padding", inputs)
    padded = inputs.output + ".padd"
    assert spark.read.text(padded).count() == 5
    walk = inputs.but(input=padded)
    C.run(spark, "randomwalk", walk)
    read = lambda path: sorted(r.value for r in spark.read.text(path).collect())
    ids, feats, feats2 = read(walk.output), read(walk.feat_walk_path), read(walk.feat_walk_path + "2")
    assert len(ids) == len(feats) == 12 and len(feats2) == 6
    assert all(len(x.split("\u0001")[2].split(" ")) == 5 for x in ids)
    assert all(len(x.split("\u0001")[2].split(" ")) == 4 for x in feats)
    assert {tuple(x.split("\u0001")[:2]) for x in feats2} == {("u1", "A"), ("u2", "B"), ("u3", "A")}
    assert R.read_node2id(spark, walk.feat_walk_path + ".node2id").count() == 6
    emb = walk.but(input=walk.feat_walk_path, node_path=walk.feat_walk_path + ".node2feat",
                   output=scratch.path("emb"))
    C.run(spark, "embedding", emb)
    assert {tuple(x.split("\t")[:2]) for x in read(emb.output + ".emb")} == {
        ("u1", "A"), ("u2", "B"), ("u3", "A")}
    plain = walk.but(input=walk.output, output=scratch.path("emb"))
    C.run(spark, "embedding", plain)
    assert {x.split("\t")[0] for x in read(plain.output + ".emb")} == set("012345")
    once = walk.but(output=scratch.path("once"), feat_walk_path=scratch.path("oncef"), sinks_path=scratch.path("sinks"),
                    index_format="text", walks_per_task=3)
    C.run(spark, "randomwalk", once)
    sinks = [read(f"{once.sinks_path}/sink={name}") for name in ("ids", "feats", "feats2")]
    assert sinks == [ids, feats, feats2]
    assert R.read_node2id(spark, once.feat_walk_path + ".node2id", "text").count() == 6
    starts = scratch.text(spark.createDataFrame([("u2",), (" ",), ("",), ("nobody",), ("u2 again",)], "value string"))
    some = walk.but(output=scratch.path("some"), feat_walk_path=scratch.path("somef"), starts_path=starts)
    C.run(spark, "randomwalk", some)
    assert read(some.output) == [x for x in ids if x.startswith("u2\u0001")]
    everything = walk.but(output=scratch.path("all"), feat_walk_path=scratch.path("allf"))
    C.run(spark, "full", everything)
    assert read(everything.output) == ids
    assert {x.split("\t")[0] for x in read(everything.output + ".emb")} == {
        "u1", "u2", "u3", "k1", "k2", "k3"}


def test_indexed_run(spark, lines, scratch):
    params = Params(input=scratch.text(lines("1\u0001A 2\u0001B", "2\u0001B 5\u0001C 3")), indexed=True,
                    output=scratch.path("o"), feat_walk_path=scratch.path("f"), walk_length=1, num_walks=1)
    C.run(spark, "randomwalk", params)
    got = sorted(r.value.split("\u0001")[:2] for r in spark.read.text(params.output).collect())
    assert got == [["1", "1"], ["2", "2"], ["5", "5"]]


def test_settings_are_checked(spark):
    for wrong in ({"p": 0}, {"q": -1}, {"degree": 0}, {"num_walks": 0}, {"walk_length": -1},
                  {"sep": " "}, {"num_partitions": 0}):
        with pytest.raises(ValueError):
            Params(**wrong)
    with pytest.raises(ValueError, match="input"):
        C.run(spark, "padding", Params())
    with pytest.raises(ValueError, match="command"):
        C.run(spark, "nothing", Params())


def test_scratch_uses_the_folder_of_the_session(spark, tmp_path):
    def session(setting, context_dir, master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: {
                "spark.checkpoint.dir": setting, "spark.sql.warehouse.dir": "file:/w"}.get(key)),
            sparkContext=SimpleNamespace(getCheckpointDir=lambda: context_dir, master=master))
    assert shared_folder(session("hdfs:/x/", None, "yarn")) == "hdfs:/x"
    assert shared_folder(session(None, "hdfs:/y", "yarn")) == "hdfs:/y"
    assert shared_folder(session(None, None, "local[8]")) == "file:/w"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(None, None, "yarn"))
    with Scratch(spark, str(tmp_path)) as scratch:
        assert scratch.cut(spark.range(3)).count() == 3
        assert list(tmp_path.iterdir())
    assert not list(tmp_path.iterdir())
