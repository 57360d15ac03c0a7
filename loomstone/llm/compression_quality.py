"""Quality classifier by compression.

Two zstandard dictionaries are trained on good and on bad labelled text. Each
text is compressed piece by piece against both, whole; the difference of the
sizes per byte of text, calibrated by a logistic curve, is its score. Short
pieces keep repetitions inside a text from hiding the dictionaries' effect.

Learning uses at most ``SAMPLE_ROWS`` labelled rows of each class, those with the
lowest hash of their id among rows whose crc32(doc_id as text) mod 5 is not 0:
half build the dictionaries, half fit the curve. Of these rows, those go whose
text would take the class over ``SAMPLE_BYTES``. Both bounds are parameters. Where
zstandard can't train a dictionary, as from a handful of short texts, the last
bytes of the class's texts serve as one.

Defined results: a null or empty text has difference 0 and the score of the
curve there; without rows of both classes every score is the share of label 1
(0.5 without any); a document with several labels counts with each; equal texts
get equal scores; an empty table gives an empty result; extra columns of either
table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.langid import held_out
from loomstone.llm.text_bytes import bounded

SAMPLE_ROWS = 1500
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
PIECE = 256
LEVEL = 3
THRESHOLD = 0.3
SCHEMA = "doc_id long, score double"


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the last bytes of the texts where there are too few to train on."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


@dataclass
class CompressionModel:
    """Dictionaries and the curve; compressors are made in each worker."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def compressors(self):
        """One compressor for each dictionary."""
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        made = []
        for content in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(content) if len(content) >= 8 else None
            if held is not None:
                held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=held, **options))
        return made

    def score(self, difference: float) -> float:
        z = min(max(self.slope * difference + self.offset, -30.0), 30.0)
        return 1.0 / (1.0 + math.exp(-z))


def difference(text: bytes, compressors) -> float:
    """Compressed bytes that the good dictionary saves over the bad one, summed over all pieces, per byte of text."""
    good = bad = 0
    for start in range(0, len(text), PIECE):
        piece = text[start : start + PIECE]
        good += len(compressors[0].compress(piece))
        bad += len(compressors[1].compress(piece))
    return (bad - good) / len(text) if text else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression by Newton steps with a small ridge on the slope."""
    scale = float(np.std(x)) or 1.0
    design, weights = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ weights, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        move = np.linalg.solve(hessian, design.T @ (y - p) - ridge @ weights)
        weights += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[tuple[int, bytes]]:
    """At most ``rows`` (label, text) and ``most`` bytes of each class, by lowest hash of the id; ids and sizes first, so only texts that are taken move."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    texts = docs.select("doc_id", "text", F.octet_length("text").alias("n"), F.xxhash64("text").alias("tie")).where(F.col("text").isNotNull())
    order, taken = [F.xxhash64("doc_id"), "doc_id", "tie"], []
    for label in (0, 1):
        ids = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        left = most
        for r in texts.select("doc_id", "n", "tie").join(F.broadcast(ids), "doc_id").orderBy(*order).limit(rows).collect():
            if r["n"] <= left:
                left -= r["n"]
                taken.append((label, len(taken), r["doc_id"], r["tie"]))
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame(taken, "label int, place int, doc_id long, tie long")
    # Rows that repeat id and text are alike, so one of them stands for each place.
    picked = texts.join(F.broadcast(wanted), ["doc_id", "tie"]).groupBy("place", "label").agg(F.min("text").alias("text"))
    return [(r["label"], r["text"].encode()) for r in picked.orderBy("place").collect()]


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> CompressionModel:
    """Build the dictionaries from every other row of the sample and fit the curve to the rest."""
    sample = labelled_sample(docs, labels, rows, most)
    by_label = [[t for y, t in sample if y == label] for label in (0, 1)]
    if min(map(len, by_label)) < 2:
        share = len(by_label[1]) / len(sample) if sample else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return CompressionModel(b"", b"", 0.0, math.log(share / (1 - share)))
    model = CompressionModel(_dictionary(by_label[1][::2]), _dictionary(by_label[0][::2]))
    made = model.compressors()
    x = np.array([difference(t, made) for label in (0, 1) for t in by_label[label][1::2]])
    y = np.array([label for label in (0, 1) for _ in by_label[label][1::2]], dtype=float)
    model.slope, model.offset = fit_curve(x, y)
    return model


def score_texts(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """Score of every document, without moving rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value.compressors()
        for batch in bounded(batches):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            scores = [shared.value.score(difference(t or b"", made)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of the classifier for each document."""
    scored = score_texts(docs, learn(docs, labels))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", predicted.alias("predicted"))
