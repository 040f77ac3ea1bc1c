"""The manifest against plain hashing, in one and in several layers of blocks."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meander.llm import merkle_manifest as M
from tests.oracle_check import compare, connect

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, member int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The root of the nodes, and each one's (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 3 * 3
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1:run + 3])))
        nodes, at = [digest(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)], [k // 3 for k in at]
    return nodes[0], paths


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, over = climb([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, over):
        for x, path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            out.append((x[3][0], x[2], trees[s][0], root, path + top))
    return out


def rows():
    made = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 5}", "en", i, f"text\n{i}" * (i % 4)) for i in range(90)]
    made += [(200, "lone", None, None, None), (201, "é", "de", 3, ""), (201, "é", "de", 3, ""), (201, "é", "de", 4, "x\n"),
             (None, "hot", "en", 1, "no number"), (202, "", "en", 1, "-"), (203, "hot", "-", 1, "\n" * 5), (204, "Z", "en", 1, "word " * 5000)]
    return made


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, scratch, levels):
    docs = spark.createDataFrame([(*r, "r", 1) for r in rows()], SCHEMA).repartition(5)
    hashed = docs.select("doc_id", "source", M.leaf([F.col(c) for c in M.FIELDS]).alias("leaf"), F.struct("doc_id", F.lit(1).alias("leaf")).alias("member"))
    got = M.manifest(hashed, scratch, levels=levels).collect()
    tell = lambda x: sorted(x, key=repr)
    assert tell((r.member.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got) == tell(plain(rows()))


def test_manifest_query(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "r", 1) for r in rows()], SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    proofs = {(d, leaf): (sub, root, path) for d, leaf, sub, root, path in plain(rows())}
    originals = {(r[0], leaf(r)): r for r in rows()}
    got = M.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    assert any(r.verified for r in got) and any(not r.verified for r in got)
    for r in got:
        sub, root, path = proofs[r.doc_id, r.leaf]
        row = originals[r.doc_id, r.leaf]
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and row[4] is not None:
            row = (*row[:4], row[4].replace("\n", ""))
        node = leaf(row)
        for left, right in path:
            node = digest(left, node, right)
        assert (r.subroot, r.root, r.proof_sha256) == (sub, root, digest(*[a + b for a, b in path]))
        assert (r.folded_root, r.verified) == (node, node == root)


def test_manifest_sql_on_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "r", 1) for r in rows() if r[0] is not None], SCHEMA)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(spark, connect(str(tmp_path)), "op11", M.op11_merkle_manifest, M.OP11_SQL, str(tmp_path)) is None


def test_empty_manifest(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert M.op11_merkle_manifest(spark, str(tmp_path)).collect() == []
