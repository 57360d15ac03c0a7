"""Operators that read each text on its own, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import compression_quality, langid, license_scan, quality_rules, token_counts


def keyed(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def quality_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= set(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules(docs, no_docs, rows):
    found = quality_rules.verdicts(docs)
    assert found.columns == quality_rules.OUTPUT
    got = sorted((tuple(r)[:7] for r in found.collect()), key=repr)
    assert got == sorted(((r[0], *quality_by_hand(r[1])) for r in rows), key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in found.collect())
    assert quality_rules.verdicts(no_docs).collect() == []


def licenses_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        want = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(docs, no_docs, rows):
    found = license_scan.scan(docs).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(((r[0], *licenses_by_hand(r[1])) for r in rows), key=repr)
    for r in found:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.scan(no_docs).collect() == []


def test_license_rules_are_many_and_suppress_contained_hits():
    rules = license_scan.signature_rules()
    assert len(rules) >= 200
    text = b"licensed under the gnu lesser general public license, version 2.1"
    assert {rules[k].label for _, _, k in license_scan.detect(text)} == {"lgpl"}
    assert license_scan.suppress([(0, 10, 0), (2, 8, 1), (5, 12, 1), (0, 10, 1)], [1, 2]) == [(0, 10, 1), (5, 12, 1)]


def pieces_by_hand(word, first, later):
    """Longest piece first; a word that no first piece begins starts with the empty one, if there is one."""
    n, at, pool = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None and pool is first and b"" in first:
            n, pool = 1, later
            continue
        if end is None:
            return -1
        at, n, pool = end, n + 1, later
    return n


def test_longest_match_against_greedy_search():
    rng = np.random.default_rng(3)
    for _ in range(40):
        make = lambda k: {bytes(rng.integers(97, 100, rng.integers(1, 5)).tolist()) for _ in range(k)}
        first, later = make(8), make(8)
        match = token_counts.LongestMatch(first, later)
        for _ in range(60):
            word = bytes(rng.integers(97, 101, rng.integers(1, 12)).tolist())
            assert match.count(word) == pieces_by_hand(word, first, later), (word, first, later)


def test_token_counts(docs, no_docs, rows):
    first, later = token_counts.read_vocabulary(token_counts.VOCABULARY)
    expected = []
    for r in rows:
        counts = [pieces_by_hand(w, first, later) for w in re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode())]
        expected.append((r[0], len(counts), sum(c if c > 0 else 1 for c in counts), counts.count(-1)))
    assert keyed(token_counts.token_counts(docs)) == sorted(expected, key=repr)
    assert token_counts.token_counts(no_docs).collect() == []


@pytest.mark.parametrize("alone", [0, 1, 16])
def test_viterbi_against_every_path(monkeypatch, alone):
    from itertools import product

    monkeypatch.setattr(langid, "LONE_TEXTS", alone)
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(11, 3))
    first = np.array([0, 4, 4, 5, 11])
    got = langid.viterbi(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:], strict=True):
        value = lambda path: sum(scores[a + i, x] for i, x in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max((value(p) for p in product(range(3), repeat=b - a)), default=0)
        assert value(got[a:b].tolist()) == pytest.approx(best)


def test_viterbi_side_by_side_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(6)
    first = np.concatenate(([0], np.cumsum(rng.integers(0, 60, 50))))
    scores = np.round(rng.normal(size=(int(first[-1]), 4)) * 3).astype(np.float32)
    together = langid.viterbi(scores, first)
    monkeypatch.setattr(langid, "LONE_TEXTS", 0)
    assert langid.viterbi(scores, first).tolist() == together.tolist(), "ties included"


def test_language_id(docs, no_docs, rows):
    found = {r["doc_id"]: r for r in langid.predictions(docs).collect()}
    for r in rows:
        letters = any(c.isalpha() for c in r[1] or "")
        assert (found[r[0]]["lang_pred"] == "und") == (not letters)
        assert found[r[0]]["held_out"] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)
        assert 0 <= found[r[0]]["score"] <= 1
    assert langid.predictions(no_docs).collect() == []
    assert {r["lang_pred"] for r in langid.predictions(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_language_id_labels_spans_and_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held) > 0
    model = langid.learn(docs)
    german, english = "der und nicht mit einer die das ist sich auch", "the and of that is for with this by from"
    text = " ".join([german] * 3 + [english] * 3)
    spans = langid.predict_batch(pa.array([text]), model)[2][0]
    assert [s[2] for s in spans] == ["de", "en"]
    assert abs(spans[0][1] - 3 * len(german)) <= 8


def test_quality_classifier(spark, docs, no_docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    all_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = compression_quality.quality_scores(all_docs, labels)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.collect())
    again = {r["doc_id"]: r["score"] for r in compression_quality.quality_scores(all_docs, labels).collect()}
    assert again == {r["doc_id"]: r["score"] for r in found.collect()}
    odd = compression_quality.quality_scores(docs, labels).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in compression_quality.quality_scores(docs, none).collect()} == {0.5}
    assert compression_quality.quality_scores(no_docs, labels).collect() == []


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = compression_quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in found if r["quality"] == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.85 * len(good) * len(bad) > 0


def test_labels_and_score_by_hand(spark):
    texts = [(1, "released under the mozilla public license, version 2.0 and all rights reserved"), (2, "see the mit license"), (3, "nothing of the kind")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1]["labels"], round(got[1]["score"], 9)) == ("mpl,proprietary", round(1 - (1 - 0.9) * (1 - 0.4), 9))
    assert (got[2]["labels"], got[2]["n_base"], got[2]["first_word"]) == ("mit", 1, 2) and got[3]["labels"] == "" and got[3]["score"] == 0


def verdict_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 10:
        return False
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    if 100 * len(covered) > 20 * len(words):
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, n = sum(map(len, words)), len(words)
    stops = sum(w.lower() in quality_rules.STOP_WORDS for w in words)
    return 2 <= chars / n <= 20 and sum(text.count(c) for c in "#*$%&|<>") / n <= 0.1 and text.count("!") / n <= 0.1 and stops / n >= 0.05 and (len(lines) - len(set(lines))) / len(lines) <= 0.3


def test_quality_verdicts_by_hand(spark, docs, rows):
    more = ["the cat and the dog of it " * 1 + "one two three four!!", "a " * 30, "the of and to in is that it was for on are", "x" * 25 + " the of and" + " yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy" * 9, "the #1 #2 #3 of and to in is that"]
    texts = [(1000 + i, t) for i, t in enumerate(more)] + [(r[0], r[1]) for r in rows if r[0] is not None and len(r[1] or "") < 5000]
    found = quality_rules.verdicts(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in found) == sorted((i, verdict_by_hand(t)) for i, t in texts)
    assert {r["kept"] for r in found} == {True, False}


def language_by_hand(texts, learned):
    """Counts, word scores and best labels from dictionaries, one word after another."""
    def words(text):
        data = (text or "").encode()
        return [m.group() for m in re.finditer(rb"[A-Za-z\x80-\xff]+", data)]

    def grams(word):
        low = [32, *(b + 32 if 65 <= b <= 90 else b for b in word), 32]
        mask = 0xFFFFFFFF
        for a, b, c in zip(low, low[1:], low[2:], strict=False):
            mixed = ((a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA77 & mask) ^ (c * 0xC2B2AE3D & mask)) * 0x27D4EB2F & mask
            yield mixed >> 17

    script = lambda word: max(int(langid.SCRIPT[b]) for b in word)
    langs = sorted({lang for _, lang in learned})
    counts, scripts = {x: {} for x in langs}, {x: {} for x in langs}
    for text, lang in learned:
        for w in words(text):
            scripts[lang][script(w)] = scripts[lang].get(script(w), 0) + 1
            for g in grams(w):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {x: sum(counts[x].values()) for x in langs}
    logs = lambda g, x: math.log((counts[x].get(g, 0) + 0.5) / (total[x] + 0.5 * langid.BUCKETS))
    allowed = lambda s: [x for x in langs if scripts[x].get(s, 0) >= 0.01 * max(sum(scripts[x].values()), 1)] or langs
    out = []
    for text in texts:
        found, best, paths = words(text), None, None
        if not any(ch.isalpha() for ch in text or ""):
            out.append(("und", 0.0))
            continue
        for w in found:
            own = {x: sum(logs(g, x) for g in grams(w)) / math.sqrt(len(w)) if x in allowed(script(w)) else -1e4 for x in langs}
            if best is None:
                best, paths = own, {x: [x] for x in langs}
                continue
            top = max(langs, key=lambda x: best[x])
            step, after = {}, {}
            for x in langs:
                came = x if best[x] >= best[top] - langid.SWITCH_PENALTY else top
                step[x], after[x] = max(best[x], best[top] - langid.SWITCH_PENALTY) + own[x], paths[came] + [x]
            best, paths = step, after
        labels = paths[max(langs, key=lambda x: best[x])]
        letters = {x: sum(len(w) for w, y in zip(found, labels, strict=True) if y == x) for x in langs}
        pick = max(langs, key=lambda x: letters[x])
        out.append((pick, letters[pick] / sum(letters.values())))
    return out


def test_language_predictions_by_hand(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(120).collect()
    rows = [(r["doc_id"], (r["text"] or "")[:600], r["lang"]) for r in rows]
    rows += [(10**6, "Привет мир, это русский текст", "ru"), (10**6 + 1, "the river " * 20 + "der Fluss und das Wasser " * 20, None), (10**6 + 2, "12 %", None), (10**6 + 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(t, x) for i, t, x in rows if t is not None and x is not None and not held(i)]
    expected = language_by_hand([t for _, t, _ in rows], learned)
    got = {r["doc_id"]: r for r in langid.predictions(docs).collect()}
    for (i, _, _), (lang, score) in zip(rows, expected, strict=True):
        assert (got[i]["lang_pred"], round(got[i]["score"], 6), got[i]["held_out"]) == (lang, round(score, 6), held(i)), i


def test_language_of_long_texts_in_parts(monkeypatch, spark, docs, no_docs):
    model = langid.learn(docs)
    texts = pa.array(["the river and the stone " * 60 + "ünd nicht für alle " * 60, "x" * 500, None, "word"])
    whole = langid.predict_batch(texts, model)
    monkeypatch.setattr(langid, "PART_BYTES", 64)
    cut = langid.predict_batch(texts, model)
    assert whole[0] == cut[0] and whole[1].tolist() == cut[1].tolist() and whole[2] == cut[2]
    clash = docs.withColumn("lang_pred", F.lit(7)).withColumn("lang_score", F.lit("x"))
    assert langid.identify(clash, model).columns == [*docs.columns, "lang_pred", "lang_score", "lang_spans"]
    assert langid.learn(no_docs).langs == []


def test_quality_scores_by_hand(spark, sf_dir):
    """Sizes by fresh compressors, piece by piece, and the curve where its slope of likelihood is nought."""
    import zstandard

    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = compression_quality.learn(documents, labels)
    sample = compression_quality.labelled_sample(documents, labels)
    assert len(sample) > 20 and all(text for _, text in sample)

    def size(text, content):
        held = zstandard.ZstdCompressionDict(content)
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[i : i + 256])) for i in range(0, len(text), 256))

    def by_hand(text):
        gain = (size(text, model.bad) - size(text, model.good)) / len(text) if text else 0.0
        return 1 / (1 + math.exp(-max(-30, min(30, model.slope * gain + model.offset))))

    found = {r["doc_id"]: r for r in compression_quality.quality_scores(documents, labels).collect()}
    for r in documents.limit(60).collect():
        assert abs(found[r["doc_id"]]["score"] - by_hand((r["text"] or "").encode())) < 1e-9
        assert found[r["doc_id"]]["predicted"] == int(found[r["doc_id"]]["score"] >= 0.3) and found[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    fitted = [(y, by_hand(t)) for label in (0, 1) for y, t in [s for s in sample if s[0] == label][1::2]]
    assert abs(sum(y - p for y, p in fitted)) < 0.01 * len(fitted)
    small = compression_quality.labelled_sample(documents, labels, most=20_000)
    assert all(sum(len(t) for y, t in small if y == label) <= 20_000 for label in (0, 1))
