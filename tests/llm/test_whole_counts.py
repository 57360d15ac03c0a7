"""Words whose start no piece with a space mark covers."""

import pytest

from loomstone.llm import token_counts


def tokens_by_hand(word, pieces):
    """Greedy longest match of the marked word among all pieces, the mark as a byte of its own."""
    n, at, left = 0, 0, b" " + word
    while at < len(left):
        at = next(e for e in range(len(left), at, -1) if left[at:e] in pieces)
        n += 1
    return n


@pytest.mark.parametrize("word", ["разные", "русский", "текст", "привет", "ưu", "中文", "한국어", "ไทย", "hello", "中" * 500])
def test_every_word_gets_a_whole_count(word):
    first, later = token_counts.read_vocabulary(token_counts.VOCABULARY)
    raw = word.encode()
    pieces = {b" " + p for p in first} | later
    assert token_counts.LongestMatch(first, later).count(raw) == tokens_by_hand(raw, pieces) > 0


def test_no_word_is_unknown(spark):
    rows = [(1, "русский текст 中文 한국어"), (2, "привет")]
    found = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_unknown"]) for r in found} == {1: (4, 0), 2: (1, 0)}
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {1: 9 + 6 + 4 + 9, 2: 7}
