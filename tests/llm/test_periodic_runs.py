"""Runs against a plain search, and the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from meander.llm import periodic_runs as P
from meander.llm.words import mix

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, runs int, h string, words string"


def plain_runs(w, least=24):
    """Every stretch in which words a period apart are equal, if no smaller period fits."""
    out = []
    for p in range(1, len(w) // 3 + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            s, n = i - p, j - i + p
            if j > i and n >= max(least, 3 * p) and not any(w[s + q:s + n] == w[s:s + n - q] for q in range(1, p)):
                out.append((s, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rnd, size, letters):
    w = []
    while len(w) < size:
        block = [rnd.randrange(letters) for _ in range(rnd.randint(1, 25))]
        w += (block * 8)[:rnd.randint(1, 8 * len(block))] if rnd.random() < 0.5 else block
    return w


@pytest.mark.parametrize("least", [24, 3, 10])
def test_runs_are_those_of_a_plain_search(least):
    rnd, found = random.Random(least), 0
    for _ in range(60):
        texts = [some_words(rnd, rnd.choice([0, 5, 40, 200]), rnd.choice([1, 2, 3, 5])) for _ in range(4)]
        want = [plain_runs(w, least) for w in texts]
        hashes = mix(np.array([x for w in texts for x in w], np.uint64))
        first = np.r_[0, np.cumsum([len(w) for w in texts])].astype(np.int64)
        # A word at a time, in pieces that cut texts, and all at once.
        for piece in (1, 37, P.PIECE_WORDS):
            assert P.find_runs(hashes, first, least, piece) == want
        found += sum(map(len, want))
    assert found > 100


def test_long_periods_and_multiples():
    word = mix(np.arange(3000).astype(np.uint64))
    text = np.r_[word[:100], np.tile(word[100:1100], 4), word[1100:1200], np.tile(word[:2], 2000)]
    assert P.find_runs(text, np.array([0, len(text)])) == [[(100, 4000, 1000), (4200, 4000, 2)]]
    assert P.find_runs(np.full(200_000, 7, np.uint64), np.array([0, 200_000])) == [[(0, 200_000, 1)]]


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(kept)))


def test_query_equals_plain_python(spark, tmp_path):
    rnd = random.Random(5)
    texts = ["", None, " \n\t", "one", "é " * 50, "a b " * 20 + "c\n" + "x y z\t" * 9, "w " * 7000 + "end", "A a " * 30, "\x85  q\x0b" * 40]
    texts += [" ".join(f"w{x}" for x in some_words(rnd, rnd.choice([3, 30, 120, 300]), rnd.choice([2, 40, 5000]))) for _ in range(150)]
    rows = [(i, t, 1, "h", "w") for i, t in enumerate(texts)] + [(3, "one", 0, "", ""), (None, "x " * 40, 1, "", "")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in P.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 30 and any(r[1] > 1 for r in want)


def test_strongest_compares_exactly(spark):
    big = 1 << 29
    rows = [([(0, big + 1, 3), (5, big, 3), (9, 3 * big + 4, 9)],), ([(4, 30, 3), (6, 20, 2)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    best = [r.b for r in df.select(P.strongest(df["runs"]).alias("b")).collect()]
    assert [b and tuple(b) for b in best] == [(9, 3 * big + 4, 9), (4, 30, 3), None]


def test_no_documents(spark):
    assert P.collapse(spark.createDataFrame([], SCHEMA)).collect() == []
