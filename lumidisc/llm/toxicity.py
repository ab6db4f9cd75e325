"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters, digits and non-ASCII bytes. A document's
features are the set of its words, word pairs and pairs with one word between
them, hashed into 2**bits slots. FTRL-proximal gives each slot its own learning
rate and an L1 penalty, so that most weights are exactly 0 and the model that goes
to the workers is a list of a few thousand (slot, weight) pairs.

Defined cases: a null or empty text has no features and scores the model's base
rate; a null id stays null and belongs to no learning fold; repeated rows get equal
scores; if the labelled documents that the table holds aren't of both classes, every score is
their share of label 1 (0 if there is none); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidisc.llm import kernels as k
from lumidisc.llm.common import SAMPLE_BYTES, first_by_hash, ids_and_texts, in_batches, learned, session

SCHEMA = "doc_id bigint, score double, predicted int"


@dataclass(frozen=True)
class Settings:
    """l1: times the square root of the number of rows, as chance gradients grow; max_per_class: labelled rows of each class that the model learns from, at most."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.145
    l2: float = 0.1
    epochs: int = 4
    max_per_class: int = 4000
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """Weights that aren't 0, and the bias."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int
    threshold: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.slots] = self.weights
        return out


def slots(t: k.Texts, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, offsets) for words, pairs and skip-grams."""
    w = k.words(t, separators=k.PUNCTUATION)
    shift = np.uint64(64 - bits)
    out = [(w.hash >> shift, w.off)]
    for h, off in (k.windows(w.hash, w.off, 2), k.pairs_apart(w.hash, w.off, 1)):
        out.append((h >> shift, off))
    return out


def _feature_sets(batch: pa.RecordBatch, bits: int) -> list[bytes]:
    out = []
    for _, _, t in k.blocks(k.texts(batch.column("text"))):
        parts = slots(t, bits)
        for i in range(len(t)):
            out.append(np.unique(np.concatenate([s[o[i] : o[i + 1]] for s, o in parts]).astype(np.uint32)).tobytes())
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Learns from labelled documents for which ``learn`` (a condition on doc_id) holds: a hash sample bounded for each class."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = first_by_hash(usable, "toxic", settings.max_per_class)
    rows = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded: 2 * max_per_class ids
    bits = settings.bits
    found = in_batches(
        rows.select("doc_id", "text", "toxic", "rank"),
        lambda b: {"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "rank": b.column("rank"), "features": pa.array(_feature_sets(b, bits), pa.binary())},
        "doc_id bigint, toxic int, rank int, features binary",
    )
    found = learned(found, SAMPLE_BYTES)
    y = np.array([r["toxic"] for r in found], float)
    if len(set(y)) < 2:
        bias = 30.0 if len(y) and y[0] == 1 else -30.0
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), bias, settings.bits, settings.threshold)
    return ftrl([np.frombuffer(r["features"], np.uint32) for r in found], y, shares[1] / (shares[0] + shares[1]), settings)


def ftrl(rows: list[np.ndarray], y: np.ndarray, base: float, s: Settings) -> Model:
    """FTRL-proximal (McMahan et al. 2013), one row at a time over its slots. The bias is a slot without L1; it is moved from the sample's share of label 1 to ``base``."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, s.l1 * np.sqrt(len(rows)))
    l1[size] = 0

    def weight(at: np.ndarray) -> np.ndarray:
        push = np.sign(z[at]) * l1[at] - z[at]
        return np.where(np.abs(z[at]) <= l1[at], 0.0, push / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for x, label in zip(rows, y, strict=True):
            at = np.append(x, size)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
    w = weight(np.arange(size + 1))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = np.clip(base, 1e-6, 1 - 1e-6)
    bias = w[size] + np.log(base / (1 - base)) - np.log(share / (1 - share))
    kept = np.flatnonzero(w[:size])
    return Model(kept, w[kept].astype(np.float32), float(bias), s.bits, s.threshold)


def scores(t: k.Texts, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Each slot counts once in a text."""
    out = np.full(len(t), bias)
    for i, j, part in k.blocks(t):
        hits = []
        for s, off in slots(part, bits):
            at = np.flatnonzero(weights[s])
            hits.append((np.searchsorted(off, at, "right") - 1).astype(np.int64) << bits | s[at].astype(np.int64))
        unique = np.unique(np.concatenate(hits))
        out[i:j] += np.bincount(unique >> bits, weights[unique & ((1 << bits) - 1)], j - i)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _scorer(docs: DataFrame, model: Model) -> Callable[[pa.RecordBatch], np.ndarray]:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    def of(batch: pa.RecordBatch) -> np.ndarray:
        if not dense:
            dense.append(sent.value.dense())
        return scores(k.texts(batch.column("text")), dense[0], sent.value.bias, sent.value.bits)

    return of


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted for every document."""
    of, threshold = _scorer(docs, model), model.threshold

    def work(batch: pa.RecordBatch) -> dict:
        p = of(batch)
        return {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return in_batches(ids_and_texts(docs), work, SCHEMA)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all columns, whose score is below the threshold."""
    of, threshold = _scorer(docs, model), model.threshold

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(of(batch) < threshold))

    session(docs)
    return docs.mapInArrow(each, docs.schema)
