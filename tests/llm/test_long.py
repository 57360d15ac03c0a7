"""One text of 20 MB beside short ones, through every operator."""

import hashlib

import numpy as np
import pytest

from loomstone.llm import compression_quality, decontam, langid, license_scan, minhash, mixing, quality_rules, sstable, suffix_dedup, token_counts

PASSAGE = "every one of these sixteen planted words stands in a row twice in this very long text"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(12)
    words = np.array(["".join(map(chr, rng.integers(97, 123, rng.integers(3, 11)))) for _ in range(3000)])
    body = " ".join(rng.choice(words, 2_600_000).tolist())
    seam = (1 << suffix_dedup.PLACE_BITS) - 300  # where the text is cut into parts
    long = body[:seam] + " " + PASSAGE + " " + body[seam:]
    assert len(long) > 19_000_000
    short = "Before it " + PASSAGE + " and the mit license behind it"
    return [(1, long), (2, short), (3, None), (4, "")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "web") for i, t in texts], "doc_id long, text string, lang string, source string").repartition(2)


def by_id(found):
    return {r["doc_id"]: r for r in found.collect()}


def test_counts_and_scans(spark, docs, texts):
    n = len(texts[0][1].split())
    assert by_id(quality_rules.verdicts(docs))[1]["n_words"] == n
    assert by_id(token_counts.token_counts(docs))[1]["n_words"] == n
    scanned = by_id(license_scan.scan(docs))
    assert scanned[1]["n_words"] == n and scanned[2]["labels"] == "mit"
    assert by_id(mixing.taken_rows(docs))[1]["size"] == n
    found = by_id(langid.predictions(docs))
    assert found[1]["lang_pred"] == "en" and found[3]["lang_pred"] == "und"
    assert 0 <= by_id(compression_quality.quality_scores(docs, docs.selectExpr("doc_id", "1 as quality")))[1]["score"] <= 1


def test_shards(spark, docs, texts):
    directory = sstable.fresh_path(spark, "long")
    shards = sstable.write_shards(docs, directory)
    found = by_id(sstable.read_shards(spark, shards))
    whole = [v for path, _, _ in shards for v in sstable.ShardReader(path).lookup(1)]
    assert len(whole) == 1 and found[1]["n_tokens"] == len(whole[0]) > 2_600_000 and found[3]["n_tokens"] == 1


def test_near_duplicates_and_passages(spark, docs, texts):
    words = texts[0][1].split()
    found = by_id(minhash.components(docs))
    assert found[1]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert found[1]["kept"] and found[2]["kept"]
    benchmark = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    hit = by_id(decontam.verdicts(docs, benchmark))
    assert (hit[1]["n_hit"], hit[2]["n_hit"], hit[1]["contaminated"], hit[2]["contaminated"]) == (17, 17, False, True)


def test_parts_of_a_long_text_name_the_same_windows(spark, texts):
    """A passage of 400 bytes that lies on the seam is removed from a second text, whole."""
    long = texts[0][1]
    seam = (1 << suffix_dedup.PLACE_BITS) - 1 - 2 * suffix_dedup.LENGTH
    rows = [(1, long), (2, "x" * 50 + " " + long[seam - 200 : seam + 200] + " " + "y" * 50)]
    found = by_id(suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))
    kept = rows[1][1].replace(long[seam - 200 : seam + 200], "")
    assert found[1]["n_removed"] == 0 and 400 <= found[2]["n_removed"] <= 402
    if found[2]["n_removed"] == 400:
        assert found[2]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
