"""The distributed suffix sort against sorting, and against the operator."""

import numpy as np
import pytest

from loomstone.llm import suffix_dedup, suffix_sort


@pytest.mark.parametrize(("n", "letters"), [(7, 2), (301, 1), (500, 3)])
def test_ranks_against_sorting(spark, n, letters):
    text = np.random.default_rng(n).integers(1, letters + 1, n).tolist()
    rows = spark.createDataFrame(list(enumerate(text)), "i long, c long")
    found = dict(map(tuple, suffix_sort.suffix_ranks(rows, n, one_task=40).df.collect()))
    assert sorted(range(n), key=found.get) == sorted(range(n), key=lambda i: text[i:])
    assert sorted(found.values()) == list(range(n))


def test_repeats_are_those_of_the_operator(spark):
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words, k))
    passage = prose(30)
    texts = [prose(20) + passage + prose(9), passage[11:] + prose(30), "ab" * 130, prose(40), passage[:99], "ab" * 70, "é" * 120]
    starts = np.cumsum([0] + [len(t.encode()) + 1 for t in texts]).tolist()
    docs = spark.createDataFrame(list(zip(starts, texts, strict=False)), "start long, text string")
    places = sorted(r["i"] for r in suffix_sort.repeated_windows(docs, one_task=300).collect())
    covered = {p + k for p in places for k in range(100)}
    removed = suffix_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    expected = {r["doc_id"]: r["n_removed"] for r in removed}
    found = {i: sum(a <= p < a + len(t.encode()) for p in covered) for i, (a, t) in enumerate(zip(starts, texts, strict=False))}
    assert found == expected and sum(found.values()) > 500
