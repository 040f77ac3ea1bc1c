"""The ranking: its fit against a plain one, held-out labels, edge cases."""

import random
import zlib

import numpy as np
import pytest

from meander.llm import quality as Q
from meander.llm.words import Words
import pyarrow as pa

DOCS, LABELS = "doc_id long, text string, quality string, score int, id string", "doc_id long, quality int, text string"


def texts(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghi", k=rnd.randint(2, 9)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.choice([5, 30, 200]))]
        if i % 4 == 0:
            kind = rnd.randrange(3)
            w = [x + rnd.choice(["%%%", "&&"]) for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else w[:1] * len(w)
        out.append((i, " ".join(w), int(i % 4 != 0)))
    return out


@pytest.fixture()
def tables(spark):
    rows = texts(800)
    docs = [(i, t, "q", 5, "i") for i, t, _ in rows] + [(5000, None, "", 1, ""), (5001, "", "", 1, ""), (5002, "\n", None, 1, ""), (None, "one two", "", 1, ""),
                                                         (5003, "%%% " * 30_000, "", 1, ""), (5003, "fine words here", "", 1, "")]
    labels = [(i, q, "t") for i, _, q in rows[:600]] + [(3, 0, ""), (None, 1, ""), (9999, 1, ""), (7, None, "")]
    return spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS).repartition(2)


def test_pairwise_fit_is_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 5))
    y = (x @ np.array([2, -1, 0, 0.5, 0]) + rng.standard_normal(120) > 0.5).astype(int)
    better, worse = Q.pairs_of(y)
    assert (y[better] == 1).all() and (y[worse] == 0).all()
    w = Q.fit_pairs(x, better, worse, 1e-2, 4000)
    d = x[better] - x[worse]
    slope = -(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-2 * w
    assert np.abs(slope).max() < 1e-5


def test_best_quantile():
    s = np.r_[np.linspace(0, 1, 50), np.linspace(3, 4, 450)]
    cut = Q.best_quantile(s, np.r_[np.zeros(50, int), np.ones(450, int)], np.ones(500))
    assert 1 < cut < 3


def test_features_are_of_each_text_alone():
    all_ = ["Ab c. Ab c.", "", None, "x x x\nx x x\n\nx", "É%%% 12", "one"]
    one_by_one = [Q.features(Words(pa.array([t], pa.string()), )) for t in all_]
    text, classes, value, shares = Q.features(Words(pa.array(all_, pa.string())))
    for i, (_, c, v, s) in enumerate(one_by_one):
        assert (classes[text == i] == c).all() and np.allclose(value[text == i], v) and np.allclose(shares[i], s[0])
    named = dict(zip(Q.SHARES, shares[3]))
    assert named["again"] == 6 / 7 and named["seen_lines"] == 1 / 4


def test_held_out_documents_are_told_apart(spark, tables):
    docs, labels = tables
    model = Q.fit(docs, labels)
    rows = Q.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    want = {i: q for i, _, q in texts(800)}
    new = [(r.score >= Q.CUT) == (want[r.doc_id] == 1) for r in rows if r.doc_id is not None and 600 <= r.doc_id < 800]
    assert len(new) == 200 and np.mean(new) > 0.97
    again = {(r.doc_id, r.score) for r in Q.score(docs.repartition(3), Q.fit(docs.repartition(7), labels)).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}


def test_every_labelled_text_counts(spark, tables):
    docs, labels = tables
    # 601 labels have a number, one of them without a text: thirteen blocks, and a cut counted over all texts.
    model = Q.fit(docs, labels, block=50)
    found = Q._labelled(docs, labels, 50, "doc_id", "text", "quality").collect()
    assert len(found) == 600 and len({b for r in found for b in r.blocks}) == 13
    quality = {i: q for i, _, q in texts(600)} | {3: 1}
    s = {i: float(Q.strength(model, Words(pa.array([t], pa.string())))[0]) for i, t, _ in texts(600)}
    ids = sorted(s)
    values, y = np.array([s[i] for i in ids]), np.array([quality[i] for i in ids])
    assert model.cut == pytest.approx(Q.best_quantile(values, y, np.ones(600)), abs=1e-6)
    right = [(r.score >= Q.CUT) == (r.doc_id % 4 != 0) for r in Q.score(docs, model).collect() if r.doc_id is not None and 600 <= r.doc_id < 800]
    assert np.mean(right) > 0.95


def test_one_kind_of_label_or_none(spark, tables):
    docs, labels = tables
    assert Q.fit(docs, labels.where("quality = 1")) is None
    assert Q.fit(docs.limit(0), labels) is None
    assert {r.score for r in Q.score(docs, None).collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.fit(docs, labels)).collect() == []


def test_query(spark, tables, tmp_path):
    docs, labels = tables
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.op12_quality(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    # A label that must not be learned changes nothing.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    other = tmp_path / "other"
    docs.write.parquet(str(other / "documents.parquet"))
    flipped.write.parquet(str(other / "labels.parquet"))
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(got) == key(Q.op12_quality(spark, str(other)).collect())
