"""Toxicity by compression distance under two zstandard dictionaries.

The zstandard trainer makes one dictionary from windows of ordinary text and one
from the words of toxic text that are over-represented there, each form as it stands
between spaces; whole toxic windows hold mostly ordinary language. The
toxic side gets its dictionary after the ordinary one, so the shared language cancels
out: a window's distance is its compressed length under the ordinary dictionary less
that under both.
A document is described by how many of its windows reach each distance step, and
a logistic calibration, fitted on labelled documents that the dictionaries have
not seen, turns that into a score from 0 to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpanel.llm.memory import handing_back

STEPS = np.array([2, 3, 4, 5, 6, 8, 10])  # bytes saved by the toxic dictionary
WINDOW_WORDS = 6
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
TRAIN_WINDOWS = 60000  # ordinary windows that the trainer sees, evenly spread
SAMPLE_TOXIC, SAMPLE_ORDINARY = 4000, 8000  # labelled documents learnt from, at most
SAMPLE_CHARS = 16384  # of each such document, spread over its windows
TRIM = ".,;:!?*$%&#|\"'()[]"


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries and calibration; small enough to travel with each task."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [" ".join(["", *words[i : i + WINDOW_WORDS], ""]).encode("utf-8", "replace") for i in range(0, len(words), WINDOW_WORDS)]


def compressor(content: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False)


def features(text: str, ordinary, toxic) -> np.ndarray:
    """Windows at or above each step (log count and share), and log length."""
    found = windows(text)
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in found] or [0])
    reached = (saved[:, None] >= STEPS[None, :]).sum(axis=0)
    return np.concatenate((np.log1p(reached), reached / len(saved), [math.log(len(saved))]))


def _contrast(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words over-represented in toxic documents (G statistic)."""
    a, b = Counter(), Counter()
    for counts, texts in ((a, toxic), (b, ordinary)):
        for text in texts:
            counts.update({w.strip(TRIM) for w in text.lower().split()})
    n, m = len(toxic), len(ordinary)

    def loglik(k: int, of: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((of - k) * math.log(1 - p) if of > k else 0.0)

    scored = []
    for word, k in a.items():
        if k < 3 or len(word) < 4 or k / n < 8 * (b[word] + 0.5) / max(m, 1):
            continue
        both = (k + b[word]) / (n + m)
        g = loglik(k, n, k / n) + loglik(b[word], m, b[word] / max(m, 1)) - loglik(k, n, both) - loglik(b[word], m, both)
        scored.append((g, word))
    least = max(6.0, 0.06 * max(g for g, _ in scored)) if scored else 0.0
    return {w for g, w in scored if g >= least}


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary, or the samples if they are too few for the trainer."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _train(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Content of the ordinary side's dictionary and of the toxic side's two."""
    found = [w for text in ordinary for w in windows(text)]
    base = _dictionary(ORDINARY_BYTES, found[:: max(1, -(-len(found) // TRAIN_WINDOWS))]) or b" " * 8
    marks = _contrast(toxic, ordinary)
    forms = sorted({w for text in toxic for w in text.lower().split() if w.strip(TRIM) in marks})
    # the trainer keeps what repeats, so every form is shown to it alike
    return base, base + _dictionary(TOXIC_BYTES, [f" {w} ".encode("utf-8", "replace") for w in forms] * 4)


def _calibrate(x: np.ndarray, y: np.ndarray, odds: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression; ``odds`` restores the classes' shares."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.eye(z.shape[1])
    ridge[0, 0] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[0] += math.log(odds)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from ``labels(doc_id, toxic)`` outside the held-out remainder.

    Rows whose crc32(doc_id as text) mod 4 is 2 are never learnt from. Of the
    others a bounded sample is taken in md5 order of the ids: SAMPLE_TOXIC and
    SAMPLE_ORDINARY documents, SAMPLE_CHARS of each in evenly spread slices. Half
    of them train the dictionaries, the other half calibrates. Repeated labels
    count once, as toxic if any says so; null labels are not used. Without
    labels of both classes every score is the share of toxic labels (0 if none).
    """
    text_id = F.col("doc_id").cast("string")
    known = (
        labels.select("doc_id", "toxic")
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(F.crc32(text_id.cast("binary")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("pick", F.md5(text_id.cast("binary")))
    )
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = known.filter("toxic = 1").orderBy("pick").limit(SAMPLE_TOXIC).unionByName(
        known.filter("toxic = 0").orderBy("pick").limit(SAMPLE_ORDINARY)
    )
    length = F.length("text")
    slices = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.col("text"), (i * length / 8 + 1).cast("int"), F.lit(SAMPLE_CHARS // 8))), " "
    )
    # at most SAMPLE_TOXIC + SAMPLE_ORDINARY ids, so they are sent to the documents
    sample = (
        docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
        .select("pick", "toxic", F.when(length > SAMPLE_CHARS, slices).otherwise(F.col("text")).alias("text"))
        .groupBy("pick").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    )
    rows = sorted(((r["pick"], r["toxic"], r["text"]) for r in sample.toLocalIterator()), key=lambda r: r[0])
    by_class = [[text for _, toxic, text in rows if toxic == k] for k in (0, 1)]
    if min(map(len, by_class)) < 2:
        share = (totals.get(1, 0) + 1e-6) / (sum(totals.values()) + 1)
        n = 2 * len(STEPS) + 1
        return ToxicityModel(b" " * 8, b" " * 8, np.zeros(n), np.ones(n), np.array([math.log(share / (1 - share))] + [0.0] * n))
    ordinary, toxic = _train(by_class[1][::2], by_class[0][::2])
    held = compressor(ordinary), compressor(toxic)
    x = np.array([features(t, *held) for k in (0, 1) for t in by_class[k][1::2]])
    y = np.concatenate([np.full(len(by_class[k][1::2]), float(k)) for k in (0, 1)])
    odds = (totals[1] / totals[0]) / (len(by_class[1]) / len(by_class[0]))
    return ToxicityModel(ordinary, toxic, *_calibrate(x, y, odds))


def score(
    docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """``docs`` with a score (0 to 1) and whether it reaches the threshold (1 or 0).

    Every window of every whole text is compressed; a null text scores as an
    empty one. Rows are neither shuffled nor grouped. The two columns are called
    ``names``; columns of ``docs`` that have these names are an error.
    """
    if set(names) & set(docs.columns):
        raise ValueError(f"columns {names} are taken; pass other names")
    width = len(docs.columns)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__body")
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns], body)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic = compressor(model.ordinary), compressor(model.toxic)
        for batch in batches:
            x = [features(t.as_py(), ordinary, toxic) for t in batch.column(width)]
            if not x:
                continue
            z = model.weights[0] + ((np.array(x) - model.mean) / model.scale) @ model.weights[1:]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            flags = pa.array((p >= threshold).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(p, pa.float64()), flags], names=[*batch.schema.names[:width], *names]
            )

    return given.mapInArrow(handing_back(run), schema)


def ordinary_documents(docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, in the columns of ``docs``."""
    scored = score(docs, model, text=text, threshold=threshold, names=("__score", "__predicted"))
    return scored.filter("__predicted = 0").drop("__score", "__predicted")


def held_out(doc_id: str = "doc_id"):
    """Whether a document's labels are kept for testing."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2
