"""Proofs and content graphs."""

import dataclasses
import hashlib

import pytest

from loomstone.operators import content, proofs


@pytest.fixture(scope="module")
def tree(spark):
    rows = spark.createDataFrame([(f"k{i:05d}", str(i)) for i in range(0, 10000, 2)], "k string, v string").repartition(3)
    return proofs.ProofTree(rows, "k", "v")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_keys_are_proven_present_or_absent(tree):
    assert tree.n_chunks == 79 and len(tree.levels) == 3
    for i in (0, 2, 126, 128, 5000, 9998):
        assert proofs.verify_key(tree.prove_key(f"k{i:05d}"), tree.root, f"k{i:05d}") == sha(str(i))
    for key in ("a", "k00001", "k00127", "k05001", "z"):
        assert proofs.verify_key(tree.prove_key(key), tree.root, key) is None
    proof = tree.prove_key("k05000")
    assert proofs.verify_key(proof, sha("other"), "k05000") is False and proofs.verify_key(proof, tree.root, "k05002") is False
    far = dataclasses.replace(tree.prove_key("k00000"), start="k05000", end="k05000")
    assert proofs.verify_key(far, tree.root, "k05000") is False, "a chunk far away shows nothing"
    assert [proofs.verify_key(p, tree.root, k) for p, k in zip(tree.prove_keys(["z", "k00002"]), ["z", "k00002"], strict=True)] == [None, sha("2")]


def test_ranges_are_proven_complete(tree):
    for start, end in (("k00100", "k00700"), (None, "k00200"), ("k09900", None), ("k00001", "k00002"), ("x", "y"), (None, None)):
        found = proofs.verify_range(tree.prove_range(start, end), tree.root)
        wanted = [k for k in (f"k{i:05d}" for i in range(0, 10000, 2)) if (start is None or k >= start) and (end is None or k < end)]
        assert [k for k, _ in found] == wanted
    proof = tree.prove_range("k00100", "k00700")
    assert len(proof.chunks) > 2
    for broken in (proof.chunks[1:], proof.chunks[:-1], proof.chunks[:1] + proof.chunks[2:]):
        assert proofs.verify_range(dataclasses.replace(proof, chunks=broken), tree.root) is None
    chunk = dataclasses.replace(proof.chunks[0], rows=proof.chunks[0].rows[1:])
    assert proofs.verify_range(dataclasses.replace(proof, chunks=(chunk, *proof.chunks[1:])), tree.root) is None
    assert len(proofs.verify_range(tree.prove_prefix("k000"), tree.root)) == 50


def test_differences_are_proven(spark, tree):
    rows = [(f"k{i:05d}", str(i)) for i in range(0, 10000, 2) if i != 300] + [("k00301", "x")]
    rows = [(k, "new" if k == "k00302" else v) for k, v in rows]
    other = proofs.ProofTree(spark.createDataFrame(rows, "k string, v string"), "k", "v")
    old, new = tree.prove_range("k00290", "k00310"), other.prove_range("k00290", "k00310")
    assert proofs.verify_diff(old, new, tree.root, other.root) == [("k00300", "removed"), ("k00301", "added"), ("k00302", "changed")]
    assert proofs.verify_diff(old, new, tree.root, tree.root) is None
    empty = proofs.ProofTree(spark.createDataFrame([], "k string, v string"), "k", "v")
    assert proofs.verify_range(empty.prove_range("a", "b"), empty.root) == [] and proofs.verify_key(empty.prove_key("a"), empty.root, "a") is None


def test_content_graphs(spark):
    nodes = spark.createDataFrame([("r", "tree", ["a", "b"]), ("a", "leaf", ["x"]), ("b", "leaf", ["x"]), ("x", "blob", []), ("old", "tree", ["x", "y"]), ("y", "blob", [])], "cid string, kind string, children array<string>")
    roots = spark.createDataFrame([("r",)], "cid string")
    assert sorted(map(tuple, content.walk(nodes, roots).collect())) == [("a", "leaf", 1), ("b", "leaf", 1), ("r", "tree", 0), ("x", "blob", 2)]
    plan = content.plan_collection(nodes, roots)
    assert {r["cid"] for r in plan.collect()} == {"old", "y"} and {r["cid"] for r in content.collect(nodes, plan).collect()} == {"r", "a", "b", "x"}
    copied = content.copy_graph(nodes, nodes.where("cid = 'x'"), roots)
    assert sorted(r["cid"] for r in copied.collect()) == ["a", "b", "r", "x"]
    with pytest.raises(content.LimitExceeded):
        content.walk(nodes, roots, most_nodes=2)
    with pytest.raises(content.LimitExceeded):
        content.walk(nodes, roots, most_levels=1)
    with pytest.raises(Exception, match="no node x"):
        content.walk(nodes.where("cid <> 'x'"), roots)
