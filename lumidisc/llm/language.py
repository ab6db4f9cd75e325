"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's features are all 3- and 4-byte windows of its lower-cased bytes, hashed
into 2**bits rows of an embedding table; the average of the rows goes through a
linear softmax. Table and softmax are trained together by stochastic gradient
descent in numpy. For scoring, table times softmax is one small matrix, so a text's
logits are the average of that matrix's rows.

Rejection is calibrated: a temperature, fitted on learning rows kept apart from
training, turns logits into probabilities, and ``accepted`` is false below the
confidence at which those rows reach ``precision``.

Defined cases: ``und`` with score 0 for a null text or one without a letter, or if
there was nothing to learn from; rows without a language aren't learned from; ties
take the first language in order; repeated rows get equal results; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidisc.llm import kernels as k
from lumidisc.llm.common import SAMPLE_BYTES, first_by_hash, in_batches, learned, sent_if_small

UNDETERMINED = "und"
SCHEMA = "doc_id bigint, lang_pred string, score double, accepted boolean"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


@dataclass(frozen=True)
class Settings:
    """max_per_language: learning rows of each language, at most."""

    bits: int = 16
    dim: int = 16
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 6
    rate: float = 0.5
    max_per_language: int = 1200
    precision: float = 0.99


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float
    settings: Settings


def features(t: k.Texts, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for n in s.grams:
        h, off = k.byte_grams(t, n, lower=True)
        out.append((h >> np.uint32(32 - s.bits), off))
    return out


def _counts(batch: pa.RecordBatch, s: Settings) -> list[bytes]:
    out = []
    for _, _, t in k.blocks(k.texts(batch.column("text"))):
        parts = features(t, s)
        for i in range(len(t)):
            at, n = np.unique(np.concatenate([f[o[i] : o[i + 1]] for f, o in parts]), return_counts=True)
            out.append(np.concatenate((at.astype(np.uint32), n.astype(np.uint32))).tobytes())
    return out


def train(docs: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Learns from documents with a language for which ``learn`` (a condition on doc_id) holds: a hash sample bounded for each language."""
    usable = docs.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # ids are what is ranked, so they are what is counted: of an id, the text with the smallest hash, once
    usable = usable.where("doc_id IS NOT NULL").withColumn("of_text", F.xxhash64("text"))
    ids = first_by_hash(usable.groupBy("doc_id", "lang").agg(F.min("of_text").alias("of_text")), "lang", settings.max_per_language)
    ids = sent_if_small(ids)  # how many languages there are isn't bounded
    rows = usable.join(ids, ["doc_id", "lang", "of_text"]).dropDuplicates(["doc_id", "lang"])
    found = in_batches(
        rows.select("doc_id", "text", "lang", "rank"),
        lambda b: {"doc_id": b.column("doc_id"), "lang": b.column("lang"), "rank": b.column("rank"), "features": pa.array(_counts(b, settings), pa.binary())},
        "doc_id bigint, lang string, rank int, features binary",
    )
    found = learned(found, SAMPLE_BYTES)
    languages = tuple(sorted({r["lang"] for r in found}))
    if not languages:
        return Model((), np.zeros((1 << settings.bits, 0), np.float32), np.zeros(0), 1.0, 0.0, settings)
    data, y = [], []
    for r in found:
        a = np.frombuffer(r["features"], np.uint32)
        if len(a):
            at, n = a[: len(a) // 2], a[len(a) // 2 :].astype(np.float32)
            data.append((at, n / n.sum()))
            y.append(languages.index(r["lang"]))
    return descend(data, np.array(y), languages, settings)


def descend(data: list, y: np.ndarray, languages: tuple[str, ...], s: Settings) -> Model:
    """SGD one text at a time; every fifth text is kept for calibration."""
    rng = np.random.default_rng(0)
    table = (rng.random((1 << s.bits, s.dim), np.float32) - 0.5) / s.dim
    top = np.zeros((s.dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    kept = np.arange(len(data)) % 5 == 4
    order = np.flatnonzero(~kept)
    steps, done = max(1, s.epochs * len(order)), 0
    for _ in range(s.epochs):
        rng.shuffle(order)
        for i in order:
            at, share = data[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            hidden = share @ table[at]
            p = _softmax((hidden @ top + bias)[None])[0]
            p[y[i]] -= 1
            back = top @ p
            top -= rate * 4 * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            table[at] -= (rate * 40 * share)[:, None] * back
    model = (table @ top).astype(np.float32)
    logits = np.array([data[i][1] @ model[data[i][0]] + bias for i in np.flatnonzero(kept)]).reshape(-1, len(languages))
    temperature, accept = calibrate(logits, y[kept], s.precision)
    return Model(languages, model, bias, temperature, accept, s)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(logits: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """The temperature of least log loss, and the least confidence from which on ``precision`` is reached."""
    if not len(y):
        return 1.0, 0.0
    best = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean())
    p = _softmax(logits / best)
    order = np.argsort(-p.max(1), kind="stable")
    right = (p.argmax(1) == y)[order].cumsum() / np.arange(1, len(y) + 1)
    reached = np.flatnonzero(right >= precision)
    return float(best), float(p.max(1)[order][reached[-1]]) if len(reached) else 1.0


def _has_letter(t: k.Texts) -> np.ndarray:
    out = k.sums(_ASCII_LETTER[t.buf].astype(np.int8), t.off) > 0
    for i in np.flatnonzero(~out):
        out[i] = bool(_LETTER.search(t.buf[t.off[i] : t.off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        m = sent.value
        all_texts = k.texts(batch.column("text"))
        letter = _has_letter(all_texts) & (len(m.languages) > 0)
        best, top = np.zeros(len(all_texts), np.int64), np.zeros(len(all_texts))
        if m.languages:
            for i, j, t in k.blocks(all_texts, 1 << 20):
                total, n = np.zeros((j - i, len(m.languages))), np.zeros(j - i)
                for f, off in features(t, m.settings):
                    for language in range(len(m.languages)):
                        total[:, language] += k.sums(m.table[:, language][f], off)
                    n += np.diff(off)
                p = _softmax((total / np.maximum(n, 1)[:, None] + m.bias) / m.temperature)
                best[i:j], top[i:j] = p.argmax(1), p.max(1)
        names = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letter, strict=True)]
        top = np.where(letter, top, 0.0)
        return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": top, "accepted": letter & (top >= m.accept)}

    return in_batches(docs.select("doc_id", "text"), work, SCHEMA)
