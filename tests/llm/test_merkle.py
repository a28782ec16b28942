import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm.merkle import document_leaves, folded, manifest, op11_merkle_manifest
from tests.llm.helpers import EDGES, NAMES, edges, empty


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(top, siblings of each leaf, as lists of (before, after)) of one tree."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for k, place in enumerate(at):
            run, own = runs[place // 3], place % 3
            proofs[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[k] = place // 3
        nodes = [sha(*run) for run in runs]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        changed = leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if hit else text)
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), doc_id, changed))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([r[2] for r in sorted(groups[s])]) for s in names]
    root, above = climb([t[0] for t in trees])
    out = []
    for name, (subroot, proofs), upper in zip(names, trees, above):
        for row, proof in zip(sorted(groups[name]), proofs):
            whole, acc = proof + upper, row[4]
            for before, after in whole:
                acc = sha(before, acc, after)
            out.append((row[3], row[2], subroot, root, sha(*(b + a for b, a in whole)), acc, acc == root))
    return out


def found(spark, rows, monkeypatch, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string").write.parquet(f"{path}/documents.parquet")
    return [tuple(r) for r in op11_merkle_manifest(spark, path).collect()]


def test_edges_match_brute_force(spark, monkeypatch, tmp_path):
    rows = [(*r[:5], "clash") for r in EDGES]
    assert sorted(found(spark, rows, monkeypatch, tmp_path), key=str) == sorted(brute([r[:5] for r in EDGES]), key=str)


@pytest.mark.parametrize("small", [10_000, 0])
def test_sizes_around_powers_of_the_fanout(spark, monkeypatch, tmp_path, small):
    """Groups of 1 to 28 leaves, one of 100, and more groups than one run; on a single task and dealt out."""
    monkeypatch.setattr("millrace.llm.merkle.SMALL", small)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "é": 27, None: 28, "hot": 100, "Z": 1, "": 2}
    rows = [(k * 1000 + j, f"line {j}\nof {s}", "en", s, j, "x") for k, (s, n) in enumerate(sizes.items()) for j in range(n)]
    got = found(spark, rows, monkeypatch, tmp_path)
    assert sorted(got, key=str) == sorted(brute([r[:5] for r in rows]), key=str)
    assert {r[6] for r in got} == {True, False}


def test_any_change_of_a_row_is_seen(spark):
    """A proof verifies its own leaf alone: not a neighbour's, not one whose fields were moved."""
    proven = manifest(document_leaves(edges(spark, "proof")), "source", ["doc_id"])
    rows = proven.withColumn("own", folded(F.col("leaf"), F.col("proof"))).withColumn("other", folded(F.unhex(F.sha2(F.lit("other"), 256)), F.col("proof"))).collect()
    assert len(rows) == len(EDGES)
    assert all(r.own == bytes(r.root).hex() and r.other != r.own for r in rows)
    moved = spark.createDataFrame([(1, "b", "en", "a", 1, "k"), (1, "en", "b", "a", 1, "k"), (1, None, "-", "a", 1, "k"), (1, "-", None, "a", 1, "k")], NAMES.format("k"))
    assert document_leaves(moved).select("leaf").distinct().count() == 4


def test_one_row_and_none(spark):
    one = manifest(document_leaves(edges(spark).limit(1)), "source", ["doc_id"]).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
    assert manifest(document_leaves(empty(spark)), "source", ["doc_id"]).count() == 0
