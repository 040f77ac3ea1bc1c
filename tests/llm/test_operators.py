"""Operators on training data against plain Python, with nulls, ties, empty tables and odd columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from meander.llm import embedding_dedup, exact_dedup, jaccard_join, license_scan, lm_scoring, mixing, packing, postings, sharding, substring_dedup, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, n long, row string"


def make_docs():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "x\x85y"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    rows = []
    base, passage = text(120), text(70)
    for i in range(60):
        t = [text(rnd.randint(1, 150)), base, base.replace("w1", "w2", 2), text(30) + "\n" + passage + "\t" + text(20), ""][rnd.randint(0, 4)]
        rows.append((i, t, rnd.choice(["a", "b", None]), i, "r"))
    edited = base.split()
    for k in range(8):
        e = list(edited)
        e[5 + 13 * k] = f"new{k}"
        rows.append((100 + k, " ".join(e), "a", 0, None))
    rows += [(200, None, "b", None, None), (201, "   \n", None, 0, ""), (202, "One two", "c", 1, ""), (203, "one TWO", "c", 1, ""),
             (None, base, "a", 1, ""), (204, text(5000), "b", 2, ""), (205, passage, "b", 2, ""), (206, passage, "b", 2, ""), (206, passage, "b", 2, "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture()
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def roots(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in items:
        for b in items:
            if a < b and linked(a, b):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in items}


def test_jaccard_components(docs, rows, scratch):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    near = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = roots(sorted(sets), near)
    got = jaccard_join.jaccard_components(docs, scratch).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), want[i]) for i, s in sets.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_one_of_each_tells_rows_of_a_doc_id_by_text(spark, scratch):
    near, clean = " ".join(f"n{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    table = [(1, near, "x"), (5, near + " more", "y"), (5, clean, "z"), (None, near, "w"), (6, None, "v"), (7, clean, "u")]
    docs = spark.createDataFrame(table, "doc_id long, text string, row string")
    left = jaccard_join.one_of_each(docs, scratch)
    assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == ["v", "w", "x", "z"]


def test_blocks_know_sets_by_their_shared_shingles():
    rnd = random.Random(6)
    sets = {}
    for i in range(40):  # families of ten near copies, every set with shingles of its own
        own = set(range(1000 * (i % 4), 1000 * (i % 4) + 60)) - set(rnd.sample(range(1000 * (i % 4), 1000 * (i % 4) + 60), rnd.randint(0, 12)))
        sets[i] = (own, len(own) + rnd.randint(0, 9))
    pdf = pd.DataFrame([(i, i, n, np.array(sorted(own), np.uint64).tobytes(), 0, 0, 0) for i, (own, n) in sets.items()],
                       columns=["set_id", "label", "n", "hashes", "block", "i", "j"])
    got = jaccard_join._compare_blocks(75)(pdf)
    near = lambda a, b: 100 * len(sets[a][0] & sets[b][0]) >= 75 * (sets[a][1] + sets[b][1] - len(sets[a][0] & sets[b][0]))
    assert all(near(a, b) for a, b in got.itertuples(index=False))
    links = set(got.itertuples(index=False, name=None))
    assert roots(range(40), lambda a, b: (a, b) in links or (b, a) in links) == roots(range(40), near)


def test_repeated_common_hashes_of_an_owner_are_one():
    pack = lambda x, kind: np.array(x, kind).tobytes()
    sent = pd.DataFrame({"owners": [pack([7, 7, 9], np.int64), pack([7, 7], np.int64)], "hashes": [pack([3, 4, 3], np.uint64), pack([3, 4], np.uint64)],
                         "counts": [pack([postings.MANY] * 3, np.int32), pack([postings.MANY] * 2, np.int32)]})
    got = postings._one_row_each(sent)
    assert [np.frombuffer(b, np.uint64).tolist() for b in got["hashes"]] == [[3, 4], [3]]
    assert [len(b) // 4 for b in got["counts"]] == [2, 1]


def test_places_are_kept_by_steps():
    for x in ([], [0], [0, 0, 3, 254, 255, 256], [255], [254, 509, 510, 100_000], [510, 510]):
        assert postings.places(postings.steps(np.array(x, np.int64))).tolist() == x


class Task:
    partitionId = staticmethod(lambda: 0)


def dealt_by_slice(sets, monkeypatch, column="hashes", **settings):
    """The rows of ``sets`` (owner to hashes), cut into slices of a few, after their bucket's work."""
    monkeypatch.setattr(postings.TaskContext, "get", staticmethod(Task))
    blobs = [np.array(sorted(h), np.uint64).tobytes() for h in sets.values()]
    number = pa.array([7 * i for i in sets], pa.int64())
    table = pa.record_batch([pa.array(list(sets), pa.int64()), pa.array(blobs, pa.binary()), number], ["set_id", column, "n"])
    return pa.Table.from_batches(list(postings.deal_by_slice(column, 3, limit=2000, **settings)([table]))).to_pandas()


def work(rows, by_bucket, by_slice):
    return pd.concat(by_slice(pdf) for _, pdf in pd.concat(by_bucket(pdf) for _, pdf in rows.groupby("bucket")).groupby("slice"))


def test_short_hashes_by_slice_lose_none(monkeypatch):
    rnd = random.Random(4)
    pool = [rnd.getrandbits(64) for _ in range(300)]
    twins = [(7 << 32) | 1, (7 << 32) | 2]
    sets = {i: {*rnd.sample(pool, rnd.randint(0, 30)), *(rnd.getrandbits(64) for _ in range(9))} for i in range(60)} | {70: set(twins), 71: {*twins, 9 << 40}}
    rows = dealt_by_slice(sets, monkeypatch, short=True)
    assert rows["slice"].nunique() > 5
    got = work(rows, postings._count_by_slice, postings._sum_by_slice)
    held = Counter(h for s in sets.values() for h in s)
    want = {i: sum(held[h] > 1 for h in s) for i, s in sets.items()}
    assert dict(got.itertuples(index=False)) == {i: n for i, n in want.items() if n}


def test_shared_hashes_by_slice(monkeypatch):
    rnd = random.Random(5)
    pool = [rnd.getrandbits(64) for _ in range(200)]
    sets = {i: {pool[0], *rnd.sample(pool, rnd.randint(0, 30)), *(rnd.getrandbits(64) for _ in range(9))} for i in range(60)}
    got = work(dealt_by_slice(sets, monkeypatch, common=np.array(pool[:1], np.uint64)), postings._shared_by_slice, postings._owners_of_slice)
    held = Counter(h for s in sets.values() for h in s)
    assert len(got) == len(sets)
    for owner, n, hashes, level in got.itertuples(index=False):
        assert n == 7 * owner
        hashes, level = np.frombuffer(hashes, np.uint64).tolist(), np.frombuffer(level, np.uint8).tolist()
        assert sorted(hashes) == hashes and set(hashes) == {h for h in sets[owner] if held[h] > 1}
        assert level == [255 if h == pool[0] else math.ceil(8 * math.log2(held[h])) for h in hashes]


def test_repeated_rows_of_near_copies(spark, scratch):
    near = [" ".join(f"n{i}" for i in range(60) if i != k) for k in (70, 3)]
    lone = " ".join(f"c{i}" for i in range(60))
    table = [(1, near[0]), (2, near[1]), (3, lone), (4, lone)] * 40
    got = jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string").repartition(5), scratch)
    assert Counter((r.doc_id, r.component_id) for r in got.collect()) == {(1, 1): 40, (2, 1): 40, (3, 3): 40, (4, 3): 40}


def test_exact_groups(docs, rows, scratch):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(docs, scratch).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        own = next(g for g in groups.values() if r.doc_id in g)
        assert r.group_size == len(own) and r.keep_id == max(x for x in own if x is not None)
    kept = exact_dedup.drop_exact_copies(docs, scratch)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)
    # A filter far too small only sends more rows through the shuffle.
    small = exact_dedup.exact_groups(docs, scratch, filter_bits=1 << 10).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))


def test_repeated_words(docs, rows, scratch):
    first = {}
    for i, t in ((r[0], r[1]) for r in rows if r[0] is not None):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            first[key] = min(i, first.get(key, i))
    got = defaultdict(set)
    for r in substring_dedup.repeated_words(docs, scratch).collect():
        got[r.doc_id].add((r.n_words, r.n_removed))
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        assert got[i] == {(len(w), len(gone))}


def test_shards(docs, rows, scratch):
    got = sharding.shard_groups(docs, scratch, shards=4).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == {0, 1, 2, 3}
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    where, size = defaultdict(set), defaultdict(int)
    for r in got:
        where[r.text_crc32].add(r.shard)
        size[r.text_crc32] += r.size
    assert all(len(s) == 1 for s in where.values())
    total, largest = sum(size.values()), max(size.values())
    assert sum(r.size for r in got) == total == sum(len((r[1] or "").encode()) + 8 for r in rows)
    assert max(sum(r.size for r in s) for s in by.values()) <= max(largest, total / 4 + largest)


def test_minimax_is_smallest(spark, scratch):
    sizes = [random.Random(1).randint(1, 50) for _ in range(80)]
    at, table, totals = 0, [], defaultdict(int)
    for i, s in enumerate(sizes):
        table.append((i // 10, s, at))
        totals[i // 10] += s
        at += s
    cuts = sharding.minimax_cuts(spark.createDataFrame(table, "bucket int, size long, before long"), sorted(totals.items()), max(sizes), 6)

    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= 6
    best = next(c for c in range(max(sizes), at + 1) if fits(c))
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == best


def test_mix(docs, rows, scratch):
    got = mixing.taken_words(docs, scratch, block_tokens=16).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.target, r.source_size] += r.taken
    assert len(taken) == 4 and all(abs(t - w) <= 1 for (t, _), w in taken.items())
    again = mixing.taken_words(docs.repartition(5), scratch, block_tokens=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(docs, scratch, block_tokens=16)
    assert mixed.columns == docs.columns
    assert abs(sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) - sum(r.taken for r in got)) <= 3
    blanks = lambda table: sorted(str(r.doc_id) for r in table if not WORD.search(r.text or ""))
    assert blanks(mixed.collect()) == blanks(docs.collect())


def test_mix_is_in_the_order_of_the_schedule(spark, scratch):
    """Every stretch of the mix holds the sources near their shares, which the order of the rows doesn't."""
    rows = [(i, " ".join([f"w{i}"] * 20), "abc"[(i > 400) + (i > 700)], i, "") for i in range(1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed_documents(docs, scratch, block_tokens=20).collect()
    weight = {r.target: r.source_size for r in mixing.taken_words(docs, scratch, block_tokens=20).collect()}
    share = [t / sum(weight) for t in sorted(weight)]
    assert len(share) == 3
    for lo in range(0, len(got) - 100, 50):
        seen = Counter(r.source for r in got[lo:lo + 100])
        assert all(abs(a - 100 * b) <= 5 for a, b in zip(sorted(seen.values()), share)), (lo, seen, share)
    first = {r.doc_id: r.first_slot for r in mixing.taken_words(docs, scratch, block_tokens=20).collect() if r.taken}
    places = [first[i] for i in dict.fromkeys(r.doc_id for r in got)]
    assert places == sorted(places)  # a document first stands where its first slot is


def test_slots_are_pieces(docs, scratch):
    pieces = mixing.mix(docs, scratch, block_tokens=16).collect()
    at = defaultdict(list)
    for r in pieces:
        at[r.row].append(r)
    got = {r: min(p.slot for p in ps) for r, ps in at.items()}
    want = [r for r in mixing.taken_words(docs, scratch, block_tokens=16).collect() if r.taken]
    assert sorted(got.values()) == sorted(r.first_slot for r in want)
    assert sorted(len(p) for p in at.values()) == sorted(r.n_slots for r in want)
    words = defaultdict(int)
    for r in pieces:
        words[r.slot] += r.piece_words
    assert max(words.values()) <= 16 and len({(r.slot, r.row) for r in pieces}) == len(pieces)


def test_pack(docs, rows, scratch):
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    encoder = Tokenizer.from_file(path)
    ids = defaultdict(set)
    for r in rows:
        ids[r[0]].add(np.array(encoder.encode(r[1] or "", add_special_tokens=False).ids + [1], np.uint32).tobytes())
    got = packing.pack(docs, scratch, path, capacity=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, own in pieces.items():
        if i != 206:  # two rows, whose pieces can't be told apart
            assert b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start)) in ids[i]
    assert sum(r.length for r in got) == sum(len(encoder.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1])
        assert sum(r.length for r in s) <= 256


@pytest.mark.parametrize("sizes", [(1, 40), (520, 900), (130, 250), (1, 6000), (2048, 2049), (1030, 1100)])
def test_sequences_of_a_class(sizes):
    """All sequences of a task are full, sequences hold k documents of class k, and all ids come out once."""
    rnd = random.Random(5)
    filling, docs = packing.Filling(0, 2048), {}
    for i in range(2500):
        n = rnd.randint(*sizes)
        docs[i] = np.arange(n, dtype=np.uint32).tobytes()
        filling.add(i, docs[i], n)
        assert len(filling.closed) <= packing.WAITING and filling.spare < (packing.WAITING + 1) * 2048
    rest = [filling.row(p) for p in filling.finish()]
    assert sum(r[2] for r in rest) < 2048 and not filling.closed and not filling.open
    own, sequences = defaultdict(list), defaultdict(list)
    for r in filling.done + rest:
        own[r[0]].append(r)
    for r in filling.done:
        sequences[r[5]].append(r)
    assert {i: b"".join(r[3] for r in sorted(p, key=lambda r: r[1])) for i, p in own.items()} == docs
    for s in sequences.values():
        assert [r[6] for r in s] == list(np.cumsum([0] + [r[2] for r in s])[:-1]) and sum(r[2] for r in s) == 2048
    if sizes == (130, 250):  # gaps are under an eighth, so few documents are cut to fill them
        assert sum(len(p) > 1 for p in own.values()) < len(own) / 5


def test_special_tokens_as_the_tokenizer_has_them():
    path = packing.default_tokenizer()
    encoder = packing.Encoder(path)
    for text in ("a <|endoftext|> b", "x\n\n y  z　 é è", "it's\r\n 12 34 k", "<|endoftext|>"):
        data = np.frombuffer(text.encode(), np.uint8)
        got, first = encoder.encode(data, np.array([0]), np.array([len(data)]))
        assert got.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and first.tolist() == [0, len(got)]


def test_vectors(spark, scratch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    rows = []
    for i in range(300):
        v = centres[i % 40] + 0.12 * rng.normal(size=24) * (i % 3 > 0)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, [0.0] * 24, 0), (403, [float("nan")] * 24, 0), (404, None, 0),
             (405, rows[0][1], None), (406, [1.0, None], 0), (407, [], 0), (None, rows[0][1], 0)]
    got = embedding_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()
    assert len(got) == len(rows)
    good = {i: (np.array(v) / np.linalg.norm(v), l) for i, v, l in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    near = lambda a, b: good[a][1] == good[b][1] and float(good[a][0] @ good[b][0]) >= 0.93
    links = {i: sum(near(i, j) for j in good if j != i) for i in good}
    mine = {r.vec_id: r for r in got}
    assert all(mine[i].n_links <= n for i, n in links.items())
    assert sum(mine[i].n_links for i in links) >= 0.9 * sum(links.values())
    assert all(mine[i].n_links == 0 and mine[i].component_id == i and mine[i].kept for i in (402, 403, 404, 405, 406, 407))
    assert not mine[None].kept and mine[400].component_id == 0


def test_licenses(spark, docs, scratch):
    lines = spark.createDataFrame([(1, "a b c\nReleased under the MIT License.\nd e"), (2, "Licensed under the Apache License, Version 2.0."), (3, None),
                                   (4, "released under the mit"), (5, "x " * 400 + "This work is licensed under the GNU General Public Licence, version 3. y")], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.first_word) for r in license_scan.license_matches(lines).collect()}
    assert got == {(1, "mit-line", 3), (2, "apache-2.0-line", 0)}
    assert license_scan.license_matches(docs).count() == 0


def test_long_licenses_as_by_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    long, short = rnd.choices(words, k=150), rnd.choices(words, k=12)

    def edited(template, edits):
        own = list(template)
        for k in rnd.sample(range(len(own)), edits):
            own[k] = "edit"
        return [*rnd.choices(words, k=rnd.randint(0, 60)), *own, *rnd.choices(words, k=rnd.randint(0, 60))]
    texts = [edited(long, n) for n in (0, 4, 6, 7, 7, 8, 8, 9, 9, 10, 12)] + [edited(short, n) for n in (0, 0, 1, 1, 2)]
    texts += [long[:110], long[20:140], long[:60] + ["gap"] * 5 + long[60:], rnd.choices(words, k=400), texts[3], edited(long, 5) + edited(short, 0)]
    shingles = lambda w: [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    want = set()
    for i, t in enumerate(texts):
        for name, template in (("long", set(shingles(long))), ("short", set(shingles(short)))):
            own = shingles(t)
            s = len(template)
            held = [len(template & set(own[k:k + s])) for k in range(max(1, len(own) - s + 1))]
            if 100 * max(held) >= 75 * s:
                want.add((i, name, held.index(max(held)), max(held) / s))
    docs = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = license_scan.license_matches(docs, {"long": " ".join(long), "short": ", ".join(short)})
    assert {(r.doc_id, r.license, r.first_word, r.containment) for r in got.collect()} == want
    assert 8 < len(want) < 2 * len(texts)


def test_vectors_of_large_numbers(spark, scratch):
    rows = [(1, [1.5e308, 1e307, 1.5e308], 1), (2, [1.5e308, 1.1e307, 1.5e308], 1), (3, [1.5e308, float("inf"), 0.0], 1),
            (4, [1.5e308, None, 1.0], 1), (5, [0.0, 0.0, 0.0], 1), (6, [3e-320, 0.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.vector_components(df, scratch).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_toxicity(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = [f"v{rnd.randint(0, 300)}" for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            w[::25 - 4 * (i % 5)] = [rnd.choice(["idiot", "scum", "trash"]) for _ in w[::25 - 4 * (i % 5)]]
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows + [(700, None), (701, "")], "doc_id long, text string")
    fitted = labels[:400] + [(None, 0, 1), (5, None, None)]
    model = toxicity.fit(docs, spark.createDataFrame(fitted, "doc_id long, quality int, toxic int"))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = labels[400:]
    assert sum(got[i].toxic == bool(t) for i, _, t in held) >= 0.98 * len(held)
    assert not got[700].toxic and not got[701].toxic
    # Columns called as the labels and the results, repeated rows, and no documents.
    clash = docs.selectExpr("text", "doc_id", "'x' AS toxic", "'y' AS severity", "1 AS quality", "2 AS n", "3 AS grade")
    again = toxicity.fit(clash, spark.createDataFrame(fitted, "doc_id long, quality int, toxic int"))
    assert (again.words == model.words).all() and np.allclose(again.weights, model.weights)
    scored = toxicity.score(clash.union(clash), model)
    assert scored.columns == ["text", "doc_id", "quality", "n", "severity", "grade", "toxic"] and scored.count() == 2 * len(got)
    assert {(r.doc_id, r.toxic) for r in scored.collect()} == {(i, r.toxic) for i, r in got.items()}
    kept = toxicity.drop_toxic(clash, model)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    assert toxicity.drop_toxic(clash.limit(0), model).count() == toxicity.score(clash.limit(0), model).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none is None and {r.severity for r in toxicity.score(docs, none).collect()} == {0.0}


def test_lm_scores(spark, docs):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices([f"{'t' if i % 2 else 'b'}{k}" for k in range(40)], k=80))) for i in range(200)] + [(900, None), (None, "t1 t2")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 100, 2)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(table, lm_scoring.fit(table, target)).collect()}
    assert got[900].score is None and got[900].n_tokens == 0
    others = range(100, 200)  # not in the target
    assert max(got[i].score for i in others if i % 2) < min(got[i].score for i in others if not i % 2)


def lm_losses(rows, target):
    """(n_tokens, target loss, background loss) of each row by plain Python."""
    texts = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    models = []
    for own in ([w for (i, _), w in zip(rows, texts) if i in target], texts):
        word, pair, context = defaultdict(int), defaultdict(int), defaultdict(int)
        for ws in own:
            for a, b in zip([None, *ws], ws):
                word[b] += 1
                pair[a, b] += 1
                context[a] += 1
        models.append((word, pair, context))
    size = len({w for ws in texts for w in ws}) + 1
    share = lambda m, b: (m[0][b] + 1) / (sum(m[0].values()) + size)
    loss = lambda m, a, b: -np.log((m[1][a, b] + 50 * share(m, b)) / (m[2][a] + 50))
    return [(len(ws), *[np.mean([loss(m, a, b) for a, b in zip([None, *ws], ws)]) if ws else None for m in models]) for ws in texts]


def lm_table(rows):
    odd = random.Random(8)
    rare = [(1000 + i, " ".join(f"r{odd.randrange(10**6)}" for _ in range(12))) for i in range(40)]
    return [(r[0], r[1]) for r in rows] + rare


def test_lm_counts_are_exact(spark, rows, monkeypatch):
    """Every word and bigram counts, also rare ones, with many slices and buckets."""
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 2000)
    table = lm_table(rows)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    target = {i for i, _ in table if i is not None and i % 3 == 0}
    got = lm_scoring.score(docs, lm_scoring.fit(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, *x) for (i, _), x in zip(table, lm_losses(table, target)) if x[0] > -1), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got if r.n_tokens > -1), key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for x, y in zip(got, want):
        assert x[2:] == pytest.approx(y[2:], rel=1e-9) if y[1] else x[2:] == (None, None)


def test_first_words_have_the_texts_as_context(spark):
    """A text of one word costs what its share of the beginnings is."""
    table = [(i, "often more") for i in range(300)] + [(1000 + i, "seldom") for i in range(100)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs, docs.where("doc_id < 10").select("doc_id"))).collect()}
    want = lm_losses(table, set(range(10)))[-1]
    assert (got[1000].target_loss, got[1000].background_loss) == pytest.approx(want[1:], rel=1e-9)
    assert got[1000].background_loss > 1


def test_lm_scores_of_other_documents(spark):
    fitted = spark.createDataFrame([(1, "a b c"), (2, "a b d e")], "doc_id long, text string")
    models = lm_scoring.fit(fitted, spark.createDataFrame([(1,)], "doc_id long"))
    other = spark.createDataFrame([(7, "a b zz"), (1, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(other, models).collect()}
    own = {r.doc_id: r for r in lm_scoring.score(fitted, models).collect()}
    assert got[1] == own[1] and got[7].n_tokens == 3 and got[7].background_loss > own[1].background_loss


def test_empty(spark, empty, scratch):
    assert jaccard_join.jaccard_components(empty, scratch).count() == 0
    assert exact_dedup.exact_groups(empty, scratch).count() == 0
    assert exact_dedup.drop_exact_copies(empty, scratch).count() == 0
    assert substring_dedup.repeated_words(empty, scratch).count() == 0
    assert sharding.shard_groups(empty, scratch).count() == 0
    assert mixing.taken_words(empty, scratch).count() == 0
    assert mixing.mixed_documents(empty, scratch).count() == 0
    assert jaccard_join.one_of_each(empty, scratch).count() == 0
    assert packing.pack(empty, scratch, packing.default_tokenizer()).count() == 0
    assert license_scan.license_matches(empty).count() == 0
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.score(empty, lm_scoring.fit(empty, none)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.vector_components(vectors, scratch).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5
