"""Language identification with spans of mixed-language text.

Each word (a run of ASCII letters and non-ASCII bytes) gets a score per
language: the mean log-probability of its hashed byte trigrams. The script of
its characters narrows the candidates to languages that use the script. Viterbi
over the words, with a penalty for each switch, labels spans; a text's language
is the one that labels most letters.

The model is learned from all texts with a language label whose
crc32(doc_id as text) mod 4 is not 2: counts of trigrams and of scripts per
language, summed within tasks and then by Spark per language and count.

Defined results: a null text or one without a letter is ``und`` with score 0;
if no row can be learned from, every text is ``und``; whole texts are read, in
parts where they are long; ties go to the first language in code-point order;
equal texts get equal rows; an empty table gives an empty result; extra columns
are kept, but for those named like a result, which it replaces.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.text_bytes import as_bytes, bounded, parts_of_words, split_at

BUCKETS = 1 << 15
SWITCH_PENALTY = 6.0
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
PART_BYTES = 1 << 20
LONE_TEXTS, MOST_ALONE_LANGS = 16, 64
RESULTS = ("lang_pred", "lang_score", "lang_spans")

LETTER = np.zeros(256, bool)
LETTER[np.r_[0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# Script by the first byte of a UTF-8 character. 0: none of its own (ASCII or a later byte),
# 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian and Hebrew, 5 Arabic, 6 Indic and Thai, 7 Georgian, Hangul jamo and
# others, 8 punctuation and symbols, 9 kana, 10 Han, 11 Hangul, 12 the rest.
SCRIPT = np.zeros(256, np.uint8)
SCRIPT[0xC2:0xCD] = 1
SCRIPT[0xCD:0xD0] = 2
SCRIPT[0xD0:0xD4] = 3
SCRIPT[0xD4:0xD8] = 4
SCRIPT[0xD8:0xDE] = 5
SCRIPT[0xE0] = 6
SCRIPT[0xE1] = 7
SCRIPT[0xE2] = 8
SCRIPT[0xE3] = 9
SCRIPT[0xE4:0xEA] = 10
SCRIPT[0xEA:0xEE] = 11
SCRIPT[0xEE:] = 12
SCRIPTS = 13


def held_out(modulus: int, rest: int, doc_id: str = "doc_id") -> Column:
    """Whether a row is kept out of learning, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


@dataclass
class Words:
    """The words of a batch: places, owners, trigram buckets and scripts."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    buckets: np.ndarray
    script: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Split a batch into words; trigrams wrap over the bytes around a word."""
    letter = LETTER[data]
    starts, ends, owner = split_at(letter, offsets)
    low = np.where(letter, LOWER[data], 32).astype(np.uint32)
    before = np.concatenate(([32], low[:-1])).astype(np.uint32)
    after = np.concatenate((low[1:], [32])).astype(np.uint32)
    before[starts] = 32
    after[ends - 1] = 32
    mixed = (before * np.uint32(0x9E3779B1) ^ low * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    script = np.maximum.reduceat(SCRIPT[data], starts) if len(starts) else np.zeros(0, np.uint8)
    return Words(starts, ends, owner, (mixed >> np.uint32(17)).astype(np.int32), script)


def _letters(words: Words, size: int) -> np.ndarray:
    mask = np.zeros(size + 1, np.int32)
    mask[words.starts] += 1
    mask[words.ends] -= 1
    return np.flatnonzero(np.cumsum(mask[:-1]))


def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, Words]]:
    """The words of a batch in parts of bounded size: (first byte, bytes, words); places count from the part's first byte."""
    for a, b in parts_of_words(data, LETTER, PART_BYTES):
        yield a, data[a:b], words_of(data[a:b], np.clip(offsets, a, b) - a)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of one task's texts: trigrams in the first ``BUCKETS`` slots, scripts behind them."""
    totals: dict[str, np.ndarray] = {}
    for batch in bounded(batches):
        langs = batch.column("lang").to_pylist()
        data, offsets = as_bytes(batch.column("text"))
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        for _, part, words in parts(data, offsets):
            if not len(words.starts):
                continue
            at, of_word = _letters(words, len(part)), number[words.owner]
            of = np.repeat(of_word, words.ends - words.starts)
            grams = np.bincount(of * BUCKETS + words.buckets[at], minlength=len(names) * BUCKETS).reshape(len(names), -1)
            scripts = np.bincount(of_word * SCRIPTS + words.script, minlength=len(names) * SCRIPTS).reshape(len(names), -1)
            for k, name in enumerate(names):
                both = np.concatenate((grams[k], scripts[k]))
                totals[name] = totals[name] + both if name in totals else both
    for name in sorted(totals):
        slots = np.flatnonzero(totals[name])
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(slots)), pa.array(slots, pa.int32()), pa.array(totals[name][slots], pa.int64())], names=["lang", "slot", "n"]
        )


@dataclass
class LanguageModel:
    """Log-probabilities of trigrams by language, and the scripts that each language uses."""

    langs: list[str]
    scores: np.ndarray
    allowed: np.ndarray

    @classmethod
    def from_counts(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        langs = sorted(counts)
        if not langs:
            return cls([], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
        grams = np.stack([counts[x][:BUCKETS] for x in langs], axis=1).astype(np.float64)
        probability = (grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)
        scripts = np.stack([counts[x][BUCKETS:] for x in langs], axis=1)
        allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
        allowed[~allowed.any(axis=1)] = True
        return cls(langs, np.log(probability).astype(np.float32), allowed)


def learn(docs: DataFrame) -> LanguageModel:
    """The model of all rows with text, language and an id that isn't held out.

    What reaches the driver is at most one count per language and slot.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(4, 2)).select("lang", "text")
    counts: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(_count_batches, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["lang"], np.zeros(BUCKETS + SCRIPTS, np.int64))[r["slot"]] = r["n"]
    return LanguageModel.from_counts({lang: c for lang, c in counts.items() if c[:BUCKETS].any()})


def word_scores(words: Words, model: LanguageModel) -> np.ndarray:
    """One row of scores per word: the mean over its trigrams, -inf where the script rules a language out.

    The mean is scaled by the root of the length, so that long words count more, though not in proportion.
    """
    if not len(words.starts):
        return np.zeros((0, len(model.langs)), np.float32)
    at = _letters(words, int(words.ends[-1]))
    first = np.searchsorted(at, words.starts)
    summed = np.add.reduceat(model.scores[words.buckets[at]], first, axis=0)
    scaled = summed / np.sqrt(words.ends - words.starts)[:, None]
    return np.where(model.allowed[words.script], scaled, np.float32(-1e4)).astype(np.float32)


def scored_words(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, owners and scores of all words of a batch."""
    found = [(words.starts + a, words.ends + a, words.owner, word_scores(words, model)) for a, _, words in parts(data, offsets)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(model.langs)), np.float32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def viterbi_alone(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The same for the words of one text; what is kept of each word is the best label before it and which labels stay."""
    best, tops, stays = None, bytearray(), array("Q")
    langs = range(scores.shape[1])
    for at in range(0, len(scores), 1 << 16):
        for own in scores[at : at + (1 << 16)].astype(np.float64).tolist():
            if best is None:
                best = own
                continue
            most = max(best)
            top, switched, kept = best.index(most), most - penalty, 0
            for x in langs:
                if best[x] >= switched:
                    kept |= 1 << x
                    own[x] += best[x]
                else:
                    own[x] += switched
            tops.append(top)
            stays.append(kept)
            best = own
    label = best.index(max(best))
    labels = bytearray([label])
    for top, kept in zip(reversed(tops), reversed(stays), strict=True):
        label = label if kept >> label & 1 else top
        labels.append(label)
    return np.frombuffer(bytes(labels), np.uint8)[::-1].astype(np.int16)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word, for many texts at once.

    Text t has the words first[t] .. first[t + 1]. The few longest texts go one by
    one; the others advance side by side, so step k handles the k-th word of all
    of them that have one.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    labels, back = np.zeros(len(scores), np.int16), np.zeros(scores.shape, np.int16)
    if 0 < scores.shape[1] <= MOST_ALONE_LANGS:
        for t in order[:LONE_TEXTS][lengths[order[:LONE_TEXTS]] > 0]:
            labels[first[t] : first[t + 1]] = viterbi_alone(scores[first[t] : first[t + 1]], penalty)
        order = order[LONE_TEXTS:]
    begin, lengths = first[:-1][order], lengths[order]
    if not lengths.sum():
        return labels
    width = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    best = scores[begin[: width[0]]].astype(np.float64)
    identity = np.arange(scores.shape[1], dtype=np.int16)
    for step in range(1, lengths[0]):
        n = width[step]
        best = best[:n] if step == 1 or n < len(best) else best
        top = best.argmax(axis=1)
        switched = best[np.arange(n), top] - penalty
        stay = best >= switched[:, None]
        at = begin[:n] + step
        back[at] = np.where(stay, identity, top[:, None].astype(np.int16))
        best = np.where(stay, best, switched[:, None]) + scores[at]
        if step + 1 == lengths[0] or width[step + 1] < n:
            ending = np.arange(width[step + 1] if step + 1 < lengths[0] else 0, n)
            labels[at[ending]] = best[ending].argmax(axis=1)
    single = np.flatnonzero(lengths == 1)
    labels[begin[single]] = scores[begin[single]].argmax(axis=1)
    for step in range(lengths[0] - 1, 0, -1):
        at = begin[: width[step]] + step
        labels[at - 1] = back[at, labels[at]]
    return labels


def predict_batch(text: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Language, score and spans (first byte, end byte, language) of each text."""
    data, offsets = as_bytes(text)
    n = len(text)
    starts, ends, owner, scores = scored_words(data, offsets, model)
    if not model.langs or not len(starts):
        return [UNDETERMINED] * n, np.zeros(n), [[] for _ in range(n)]
    first = np.searchsorted(owner, np.arange(n + 1))
    labels = viterbi(scores, first)
    letters = np.zeros((n, len(model.langs)))
    np.add.at(letters, (owner, labels), ends - starts)
    total, pick = letters.sum(axis=1), letters.argmax(axis=1)
    ascii_letter = np.zeros(n, bool)
    ascii_letter[np.searchsorted(offsets, np.flatnonzero(LETTER[data] & (data < 0x80)), side="right") - 1] = True
    known = [bool(ascii_letter[i]) or (total[i] > 0 and any(map(str.isalpha, text[i].as_py()))) for i in range(n)]
    turn = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1]))))
    spans = [[] for _ in range(n)]
    for a, b in zip(turn, [*turn[1:], len(labels)], strict=True):
        t = owner[a]
        spans[t].append((int(starts[a] - offsets[t]), int(ends[b - 1] - offsets[t]), model.langs[labels[a]]))
    share = np.divide(letters[np.arange(n), pick], total, out=np.zeros(n), where=total > 0)
    langs = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(pick, known, strict=True)]
    return langs, np.where(known, share, 0.0), spans


SPAN_TYPE = "array<struct<start:long,end:long,lang:string>>"


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` columns with lang_pred, lang_score and lang_spans; rows aren't moved."""
    docs, shared = docs.drop(*RESULTS), docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            langs, score, spans = predict_batch(batch.column("text"), shared.value)
            named = [[{"start": a, "end": b, "lang": x} for a, b, x in s] for s in spans]
            extra = [pa.array(langs), pa.array(score, pa.float64()), pa.array(named, spans_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "lang_score", "lang_spans"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{columns}, lang_pred string, lang_score double, lang_spans {SPAN_TYPE}")


def predictions(docs: DataFrame) -> DataFrame:
    """Digest of the prediction for each document; only text reaches the model."""
    model = learn(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))
