"""Every stage of the corpus pipeline against plain Python, on a small table of its own."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from meander.llm import packing
from tests.llm.test_operators import WORD, roots, shingles


def make_tables():
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(420):
        w = [f"v{rnd.randint(0, 300)}" for _ in range(rnd.randint(30, 80))]
        toxic = i % 3 == 0
        if toxic:
            w[::9] = [rnd.choice(["idiot", "scum", "trash"]) for _ in w[::9]]
        docs.append((i, " ".join(w), rnd.choice("aab"), "x"))
        labels.append((i, 0, int(toxic)))
    clean = [d for d in docs if d[0] % 3]
    for k, (_, text, source, _) in enumerate(clean[:30]):
        docs.append((1000 + k, text, source, "copy"))
        near = text.split()
        near[0] = "changed"
        docs.append((2000 + k, " ".join(near), "c", "near"))
    docs += [(3000, None, "b", "null"), (3001, "", None, "empty"), (3002, "a few words", None, "short")]
    return docs, labels


def by_level(sizes, most=3.0):
    """Weights 1, 2, 3 by order of the sources, none over ``most`` times its size."""
    weight = {s: n % 3 + 1 for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    got, left, free = {}, float(sum(sizes.values())), set(sizes)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return got | {s: weight[s] * level for s in free}
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= over


def test_stages(spark, scratch, tmp_path):
    docs, labels = make_tables()
    schema = "doc_id long, text string, source string, toxic string"
    folder = str(tmp_path / "tables")
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    held, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        held = scratch.cut(stage(spark, held, folder), name)
        left[name] = held.collect()
    assert list(left) == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    assert all(left[name][0].__fields__ == ["doc_id", "text", "source", "toxic"] for name in list(left)[:4])

    bad = {"idiot", "scum", "trash"}
    want = {d[0] for d in docs if not bad & set((d[1] or "").split())}
    assert {r.doc_id for r in left["toxicity"]} == want

    same = defaultdict(list)
    for r in left["toxicity"]:
        same[r.text or ""].append(r.doc_id)
    assert sorted(r.doc_id for r in left["exact_dedup"]) == sorted(max(g) for g in same.values())

    sets = {r.doc_id: shingles(r.text) for r in left["exact_dedup"]}
    root = roots(list(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    assert sorted(r.doc_id for r in left["jaccard_join"]) == sorted(set(root.values())) and len(set(root.values())) < len(sets)

    words = lambda r: len(WORD.findall(r.text or ""))
    sizes, taken = Counter(), Counter()
    for r in left["jaccard_join"]:
        sizes[r.source] += words(r)
    for r in left["mixing"]:
        taken[r.source] += words(r)
    assert all(abs(taken[s] - t) <= 1 for s, t in by_level(sizes).items())
    texts = {r.doc_id: r.text for r in left["jaccard_join"]}
    assert all((r.text or "") == (texts[r.doc_id] or "")[:len(r.text or "")] for r in left["mixing"])
    assert max(Counter(r.doc_id for r in left["mixing"]).values()) <= 3

    encoder = packing.Encoder(packing.default_tokenizer()).tokenizer
    tokens = Counter()
    for r in left["mixing"]:
        tokens[r.doc_id] += len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in left["packing"]:
        packed[r.doc_id] += r.length
    assert packed == tokens
