"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

Features are all words, word pairs and 3- and 4-byte windows with case kept, hashed
into 2**bits slots; a text's input is the share of each slot among its features. The
model is trained by AdaGrad in numpy on a bounded hash sample of labelled rows, a
fifth of which is kept for Platt calibration. Counting rules run in the same pass.

Defined cases: a null or empty text has no words and fails the base rule; labels
other than 0 and 1 are ignored; without labels of both classes only the base rule
decides; repeated rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidisc.llm import kernels as k
from lumidisc.llm.common import SAMPLE_BYTES, first_by_hash, ids_and_texts, in_batches, learned

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_good double"
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_HEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])


@dataclass(frozen=True)
class Settings:
    """max_per_class: labelled rows of each class that the model learns from, at most."""

    bits: int = 18
    epochs: int = 8
    rate: float = 0.5
    scale: float = 30.0
    max_per_class: int = 2000
    threshold: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


@dataclass(frozen=True)
class Model:
    """P(good) = sigmoid(slope * (mean weight * scale + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    settings: Settings


def features(t: k.Texts, w: k.Words, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    up, low = np.uint64(64 - bits), np.uint32(32 - bits)
    pairs, pair_off = k.windows(w.hash, w.off, 2)
    out = [(w.hash >> up, w.off), (pairs >> up, pair_off)]
    for n in (3, 4):
        h, off = k.byte_grams(t, n, lower=False)
        out.append((h >> low, off))
    return out


def _counts(batch: pa.RecordBatch, bits: int) -> list[bytes]:
    out = []
    for _, _, t in k.blocks(k.texts(batch.column("text"))):
        parts = features(t, k.words(t, lower=False), bits)
        for i in range(len(t)):
            at, n = np.unique(np.concatenate([f[o[i] : o[i + 1]].astype(np.uint32) for f, o in parts]), return_counts=True)
            out.append(np.concatenate((at, n.astype(np.uint32))).tobytes())
    return out


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """None without labels of both classes."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return None
    chosen = first_by_hash(usable, "quality", settings.max_per_class)
    rows = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded: 2 * max_per_class ids
    bits = settings.bits
    found = in_batches(
        rows.select("doc_id", "text", "quality", "rank"),
        lambda b: {"doc_id": b.column("doc_id"), "quality": b.column("quality"), "rank": b.column("rank"), "features": pa.array(_counts(b, bits), pa.binary())},
        "doc_id bigint, quality int, rank int, features binary",
    )
    found, data = learned(found, SAMPLE_BYTES), []
    for r in found:
        a = np.frombuffer(r["features"], np.uint32)
        n = a[len(a) // 2 :].astype(np.float64)
        data.append((a[: len(a) // 2], n / max(1.0, n.sum())))
    y = np.array([r["quality"] for r in found], float)
    if len(set(y)) < 2:
        return None
    return fit(data, y, shares[1] / (shares[0] + shares[1]), settings)


def fit(data: list, y: np.ndarray, base: float, s: Settings) -> Model:
    w, g2, bias = np.zeros(1 << s.bits), np.full(1 << s.bits, 1e-8), 0.0
    kept = np.arange(len(y)) % 5 == 4
    order, rng = np.flatnonzero(~kept), np.random.default_rng(0)
    for _ in range(s.epochs):
        rng.shuffle(order)
        for i in order:
            at, share = data[i]
            g = _sigmoid(s.scale * (share @ w[at]) + bias) - y[i]
            step = g * s.scale * share
            g2[at] += step * step
            w[at] -= s.rate * step / np.sqrt(g2[at])
            bias -= 0.01 * g
    z = np.array([s.scale * (share @ w[at]) + bias for at, share in (data[i] for i in np.flatnonzero(kept))])
    slope, shift = platt(z, y[kept])
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    shift += np.log(base / (1 - base)) - np.log(share / (1 - share))
    return Model(w.astype(np.float32), bias, slope, float(shift), s)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets: damped Newton steps on standardised inputs, with a weak ridge against separable rows."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    center, spread = z.mean(), max(z.std(), 1e-9)
    x = (z - center) / spread
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(v: np.ndarray) -> float:
        t = v[0] * x + v[1]
        return float((np.logaddexp(0, t) - target * t).sum() + 0.005 * v @ v)

    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = _sigmoid(v[0] * x + v[1])
        d, r = p - target, p * (1 - p)
        grad = np.array([(d * x).sum(), d.sum()]) + 0.01 * v
        hess = np.array([[(r * x * x).sum(), (r * x).sum()], [(r * x).sum(), r.sum()]]) + 0.01 * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(v)
        while np.abs(step).max() > 1e-9 and loss(v - step) > now:
            step = step / 2
        v = v - step
        if np.abs(step).max() < 1e-7:
            break
    return float(v[0] / spread), float(v[1] - v[0] * center / spread)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(b" \t\n\r\x0b\x0c"))
        else:
            seen.add(line)
    return n


def counts(t: k.Texts, w: k.Words) -> dict[str, np.ndarray]:
    """The counting rules, for each text."""
    heads = np.concatenate(([0], np.cumsum(_HEADS[t.buf])))
    chars = heads[w.end] - heads[w.start]
    hashes, off = k.windows(w.hash, w.off, 3)
    again = np.flatnonzero(k.repeated(hashes, off))
    first, _ = k.runs(w.off, 3)
    covered = np.zeros(len(w.hash), bool)
    for j in range(3):
        covered[first[again] + j] = True
    raw = t.buf.tobytes()
    return {
        "n_words": np.diff(w.off),
        "word_chars": k.sums(chars, w.off).astype(np.int64),
        "n_symbols": k.sums(_SYMBOLS[t.buf].astype(np.int64), t.off).astype(np.int64),
        "n_dup_lines": np.array([duplicate_lines(raw[a:b]) for a, b in zip(t.off[:-1], t.off[1:], strict=True)], np.int64),
        "n_repeat_words": k.sums(covered.astype(np.int64), w.off).astype(np.int64),
    }


def judge(docs: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    """The counts, base_failed, p_good (null without a model) and kept for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        m, parts = sent.value, []
        for _, _, t in k.blocks(k.texts(batch.column("text")), 2 << 20):
            w = k.words(t, lower=False)
            c = counts(t, w)
            if m is not None:
                total, n = np.zeros(len(t)), np.zeros(len(t))
                for f, off in features(t, w, m.settings.bits):
                    total += k.sums(m.weights[f], off)
                    n += np.diff(off)
                c["p_good"] = _sigmoid(m.slope * (m.settings.scale * total / np.maximum(n, 1) + m.bias) + m.shift)
            parts.append(c)
        out = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
        failed = (out["n_words"] < settings.min_words) | (100 * out["n_repeat_words"] > settings.max_repeat_percent * out["n_words"])
        good = out["p_good"] >= settings.threshold if m is not None else np.ones(len(failed), bool)
        p = pa.array(out["p_good"]) if m is not None else pa.nulls(len(failed), pa.float64())
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {"doc_id": batch.column("doc_id"), **{n: out[n].astype(np.int64) for n in names}, "base_failed": failed, "kept": ~failed & good, "p_good": p}

    return in_batches(ids_and_texts(docs), work, SCHEMA)
