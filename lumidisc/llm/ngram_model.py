"""Language-model scoring with a log-frequency Bloom filter.

An n-gram that occurs c times is stored with quantised count q = 1 + floor(log_b c):
the filter holds (n-gram, 1) ... (n-gram, q). A lookup probes (n-gram, 1),
(n-gram, 2) ... until one is missing (Talbot & Osborne 2007); q stands for the middle
of its interval of counts. Word pairs are smoothed with a Dirichlet prior on single
words, and those by adding one:

    P1(w) = (c(w) + 1) / (N + V + 1),  P(w | h) = (c(h w) + kappa P1(w)) / (c(h) + kappa)

Counting: a task reduces its texts to sorted (hash, count) lists, cut by hash into
parts, and the lists of a part meet in one group. The filter is blocked by part: each
group builds its own segment of ``bits_per_entry`` bits for every entry, so the filter
grows with what was counted and no n-gram is left out. How many parts there are follows from the bytes of text alone, so
results don't depend on the partitioning. Up to ``max_filter_bytes`` of segments
go to all workers side by side. A larger filter stays where it is: documents are dealt
into buckets of about ``bucket_bytes`` by hash, each bucket sends its distinct tokens and pairs, cut by
part, to the segments, and the quantised counts come back to the bucket. Both ways give the same. The query asks for
the second at every size, as a filter that grows with the corpus has no bound that a broadcast could rely on.

The base score needs exact counts of single tokens. Tokens are 64-bit hashes. Buckets get them from the
parts together with the quantised counts. Where the filter is sent, the
``heavy`` most frequent ones (an equal number from each part) are sent too; what
is left of each document is joined with the counts by hash, after summing up within the
document. Any number of distinct tokens is handled in either way.

Defined cases: a null or empty text is one end token; a null id is scored, has no
fold (null) and isn't learned from; with nothing to learn from N = V = 0; repeated rows
get equal results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidisc.llm import kernels as k
from lumidisc.llm.common import cut, session

#: The filter and the counts of pairs go by the upper 48 bits of hashes, which takes half the bytes on the way.
UPPER = np.uint64(2**64 - 2**16)
END = k.mix(np.array([0xE0D], np.uint64))[0]
_PARTS = "part int, parts int, tokens bigint, distinct bigint, segment binary, least int, heavy binary, heavy_n binary, tail binary, tail_n binary"


@dataclass(frozen=True)
class Settings:
    """base: of the quantisation; probes: hash functions of the filter; max_filter_bytes: of a filter that is sent to all workers; kappa: weight of the prior; part_bytes: text for each part; bucket_bytes: text for each bucket."""

    base: float = 1.5
    probes: int = 8
    bits_per_entry: float = 14.4
    max_filter_bytes: int = 32 << 20
    heavy: int = 1 << 20
    kappa: float = 200.0
    flush: int = 1 << 21
    part_bytes: int = 8 << 20
    bucket_bytes: int = 8 << 20


@dataclass(frozen=True)
class Model:
    """bits: all segments; first, size: of each part's segment, in bits; least: each part's least stored quantised count."""

    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray
    least: np.ndarray
    heavy: np.ndarray
    heavy_n: np.ndarray
    tokens: int
    distinct: int
    settings: Settings


def tokens(t: k.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and one end token for each text, and the texts' offsets."""
    w = k.words(t)
    off = w.off + np.arange(len(w.off))
    out = np.full(off[-1], END, np.uint64)
    out[np.arange(len(w.hash)) + w.text_of()] = w.hash
    return out, off


def histories(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The token before each; an end token for the first of a text."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[off[:-1]] = END
    return out


def pairs(history: np.ndarray, h: np.ndarray) -> np.ndarray:
    return k.mix(history * np.uint64(0xC2B2AE3D27D4EB4F) ^ k.mix(h)) & UPPER


def gaps(keys: np.ndarray, plain: int) -> bytes:
    """Sorted keys as gaps of 8 bytes: the lowest ``plain`` bytes of each as they are, the others, which are mostly zeros or far from even, packed."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return planes[:, :plain].tobytes() + pa.compress(planes[:, plain:].T.tobytes(), "zstd", asbytes=True)


def from_gaps(data: bytes, n: int, plain: int) -> np.ndarray:
    planes = np.empty((n, 8), np.uint8)
    planes[:, :plain] = np.frombuffer(data, np.uint8, plain * n).reshape(n, plain)
    planes[:, plain:] = np.frombuffer(pa.decompress(data[plain * n :], (8 - plain) * n, "zstd", asbytes=True), np.uint8).reshape(8 - plain, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


def pair_list(keys: np.ndarray) -> bytes:
    """Of pairs only the upper 48 bits count."""
    return gaps(keys >> np.uint64(16), 3)


def token_list(keys: np.ndarray) -> bytes:
    return gaps(keys, 5)


def pairs_of(data: bytes, n: int) -> np.ndarray:
    return from_gaps(data, n, 3) << np.uint64(16)


def tokens_of(data: bytes, n: int) -> np.ndarray:
    return from_gaps(data, n, 5)


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each of sorted keys begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))


def distinct_of(keys: np.ndarray) -> np.ndarray:
    """Sorted. np.unique goes through a hash table from NumPy 2.3 on, which took 20 times as long as the sort."""
    keys = np.sort(keys)
    return keys[firsts(keys)]


def occurrences(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    first = firsts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # most keys come as a few sorted runs
    keys, counts = keys[order], counts[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def ranks(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """np.searchsorted, with the keys in order, which keeps to the caches."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(known, keys[order])
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """In the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on as 64-bit numbers at the end."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], "<i8")
    return out


def quantised(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def middle(q: np.ndarray, base: float) -> np.ndarray:
    """The count that a quantised count stands for; 0 for 0."""
    low, high = np.ceil(base ** (q - 1.0) - 1e-9), np.ceil(base ** q.astype(float) - 1e-9) - 1
    return np.where(q > 0, (low + np.maximum(low, high)) / 2, 0.0)


def places(keys: np.ndarray, level: int, probes: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    a = k.mix((keys & UPPER) ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    step, low = (a >> np.uint64(32)) | np.uint64(1), a & np.uint64(0xFFFFFFFF)
    for i in range(probes):
        yield ((low + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * np.asarray(size, np.uint64) >> np.uint64(32)


def segment(keys: np.ndarray, counts: np.ndarray, most_bits: int, s: Settings) -> tuple[np.ndarray, int]:
    """One part of the filter, and the least quantised count that it holds."""
    q = quantised(counts, s.base)
    levels = np.bincount(q) * np.arange(int(q.max(initial=0)) + 1)  # entries by quantised count
    entries = np.cumsum(levels[::-1])[::-1]
    least = max(1, int(np.argmax(entries * s.bits_per_entry <= most_bits))) if len(q) and entries[-1] * s.bits_per_entry <= most_bits else len(entries)
    load = int(entries[least]) if least < len(entries) else 0
    size = max(64, min(most_bits, math.ceil(load * s.bits_per_entry / 64) * 64))
    out = np.zeros(size, bool)
    keys, q = keys[q >= least], q[q >= least]
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in places(keys[q >= level], level, s.probes, size):
            out[at] = True
    return np.packbits(out, bitorder="little"), least


def lookup(m: Model, keys: np.ndarray) -> np.ndarray:
    """Quantised counts by repeated probes: the number of levels in a row that the filter holds."""
    q = np.zeros(len(keys), np.int64)
    part = part_of(keys, len(m.size))
    live, level = np.arange(len(keys)), 1
    while len(live) and level < 256:
        of = part[live]
        for i, at in enumerate(places(keys[live], level, m.settings.probes, m.size[of])):
            if not i:
                held = np.ones(len(live), bool)
                which = np.arange(len(live))
            at = at[which] + m.first[of[which]]
            ok = (m.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            held[which[~ok]] = False
            which = which[ok]
        live = live[held]
        q[live] = level
        level += 1
    q[q < m.least[part]] = 0
    return q


def _counted(docs: DataFrame, parts: int, flush: int) -> DataFrame:
    """Sums of tasks: (part, kind, n, keys, counts); kind 0 for tokens, 1 for pairs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, lists in held.items():
                if not lists:
                    continue
                keys, counts = summed(np.concatenate([x for x, _ in lists]), np.concatenate([n for _, n in lists]))
                lists.clear()
                at = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
                rows = np.flatnonzero(np.diff(at))
                columns = {
                    "part": pa.array(rows, pa.int32()),
                    "kind": pa.array(np.full(len(rows), kind), pa.int32()),
                    "n": pa.array(np.diff(at)[rows], pa.int64()),
                    "keys": pa.array([(pair_list if kind else token_list)(keys[at[p] : at[p + 1]]) for p in rows], pa.binary()),
                    "counts": pa.array([narrow(counts[at[p] : at[p + 1]]) for p in rows], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for _, _, t in k.blocks(k.texts(batch.column("text"))):
                h, off = tokens(t)
                for kind, keys in ((0, h), (1, pairs(histories(h, off), h))):
                    own = occurrences(keys)
                    held[kind].append(own)
                    size += len(own[0])
                if size > flush:
                    yield from out()
                    size = 0
        yield from out()

    return docs.select("text").mapInArrow(each, "part int, kind int, n bigint, keys binary, counts binary")


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def count(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each part: its sums, its segment, its heavy tokens and the others. Written to the checkpoint folder."""
    session(docs)
    s = settings
    parts = max(16, -(-_bytes(docs) // s.part_bytes))

    def gather(t: pa.Table) -> pa.Table:
        rows = t.to_pydict()
        found = {}
        for kind in (0, 1):
            own = [i for i, x in enumerate(rows["kind"]) if x == kind]
            keys = np.concatenate([(pairs_of if kind else tokens_of)(rows["keys"][i], rows["n"][i]) for i in own] or [np.zeros(0, np.uint64)])
            found[kind] = summed(keys, np.concatenate([widen(rows["counts"][i], rows["n"][i]) for i in own] or [np.zeros(0, np.int64)]))
        keys, n = found[0]
        bits, least = segment(np.concatenate((keys, found[1][0])), np.concatenate((n, found[1][1])), 1 << 62, s)
        heavy = np.zeros(len(n), bool)
        heavy[np.argsort(-n, kind="stable")[: max(1, s.heavy // parts)]] = True
        out = {
            "part": [rows["part"][0]], "parts": [parts], "tokens": [int(n.sum())], "distinct": [len(n)], "segment": [bits.tobytes()], "least": [least],
            "heavy": [keys[heavy].tobytes()], "heavy_n": [narrow(n[heavy])], "tail": [keys[~heavy].tobytes()], "tail_n": [narrow(n[~heavy])],
        }
        return pa.table(out, pa.schema([("part", pa.int32()), ("parts", pa.int32()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("segment", pa.binary()), ("least", pa.int32()), *((c, pa.binary()) for c in ("heavy", "heavy_n", "tail", "tail_n"))]))

    return cut(_counted(docs, parts, s.flush).groupBy("part").applyInArrow(gather, _PARTS))


def is_sent(counted: DataFrame, settings: Settings) -> bool:
    """Whether all segments together are small enough to go to the workers."""
    return (counted.agg(F.sum(F.octet_length("segment"))).first()[0] or 0) <= settings.max_filter_bytes


def model(counted: DataFrame, settings: Settings = Settings()) -> Model:
    """What goes to the workers: the whole filter and the heavy tokens."""
    rows = counted.drop("tail", "tail_n").collect()
    parts = rows[0]["parts"] if rows else 1
    by = {r["part"]: r for r in rows}
    bits, first, size, least, at = [], np.zeros(parts, np.uint64), np.full(parts, 64, np.uint64), np.ones(parts, np.int64), 0
    for p in range(parts):
        own = np.frombuffer(by[p]["segment"], np.uint8) if p in by else np.zeros(8, np.uint8)
        first[p], size[p], least[p] = at, len(own) * 8, by[p]["least"] if p in by else 1
        at += len(own) * 8
        bits.append(own)
    heavy = [np.frombuffer(by[p]["heavy"], np.uint64) for p in sorted(by)]
    heavy_n = [widen(by[p]["heavy_n"], len(by[p]["heavy"]) // 8) for p in sorted(by)]
    none = [np.zeros(0, np.uint64)]
    return Model(np.concatenate(bits or [np.zeros(0, np.uint8)]), first, size, least, np.concatenate(heavy or none), np.concatenate(heavy_n or none).astype(np.int64), sum(r["tokens"] for r in rows), sum(r["distinct"] for r in rows), settings)


def tail_counts(counted: DataFrame) -> DataFrame:
    """(key, c) of all tokens that aren't heavy."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("tail"), batch.column("tail_n"), strict=True):
                own = np.frombuffer(keys.as_py(), np.int64)
                c = widen(n.as_py(), len(own))
                for i in range(0, len(own), 100_000):
                    yield pa.RecordBatch.from_pydict({"key": own[i : i + 100_000], "c": c[i : i + 100_000]})

    return counted.select("tail", "tail_n").mapInArrow(each, "key bigint, c bigint")


def log_probabilities(m: Model, off: np.ndarray, single: np.ndarray, pair: np.ndarray, end: int) -> np.ndarray:
    """log10 P(token | the one before) of each token, from quantised counts of tokens, of pairs with the token before, and of the end token."""
    s = m.settings
    c, pair = middle(single, s.base), middle(pair, s.base)
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[off[:-1]] = middle(np.array([end]), s.base)[0]
    pair = np.minimum(pair, np.minimum(c, before))
    p1 = (c + 1) / (m.tokens + m.distinct + 1)
    return np.log10((pair + s.kappa * p1) / (before + s.kappa))


_TYPES = {"key": pa.int64(), "tf": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
_SCORED = "row bigint, key bigint, tf bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def _rows(ids: np.ndarray, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"row": ids, **{c: (given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], kind)) if c in given else pa.nulls(len(ids), kind) for c, kind in _TYPES.items()}})


def _scored(m: Model, t: k.Texts, ids: np.ndarray, doc_id: pa.Array, held_out: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each of its tokens that isn't heavy."""
    h, off = tokens(t)
    distinct, inverse = np.unique(h, return_inverse=True)
    found = np.minimum(np.searchsorted(m.heavy, distinct), max(0, len(m.heavy) - 1))
    known = m.heavy[found] == distinct if len(m.heavy) else np.zeros(len(distinct), bool)
    worth = np.where(known, np.log10(m.heavy_n[found] + 1.0), 0.0) if len(m.heavy) else np.zeros(len(distinct))
    yield _rows(
        ids,
        key=k.mix(ids.astype(np.uint64)).view(np.int64),
        doc_id=doc_id,
        held_out=held_out,
        n_tokens=np.diff(off),
        n_known=k.sums(known[inverse].astype(np.int64), off).astype(np.int64),
        base=k.sums(worth[inverse], off),
        score=k.sums(log_probabilities(m, off, lookup(m, distinct)[inverse], lookup(m, pairs(histories(h, off), h)), lookup(m, np.array([END], np.uint64))[0]), off),
    )
    rest = np.flatnonzero(~known[inverse])
    if len(rest):  # summed up within each document
        of = np.searchsorted(off, rest, "right") - 1
        packed, tf = np.unique(of.astype(np.int64) * len(distinct) + inverse[rest], return_counts=True)
        keys = distinct[packed % len(distinct)].view(np.int64)
        for a in range(0, len(packed), 100_000):
            yield _rows(ids[packed[a : a + 100_000] // len(distinct)], key=keys[a : a + 100_000], tf=tf[a : a + 100_000])


def asked(t: k.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens, and the distinct pairs, of texts; sorted, so in the order of their parts. The order of the texts doesn't matter."""
    single, pair = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, _, part in k.blocks(t, 1 << 20):
        h, off = tokens(part)
        single.append(distinct_of(h))
        pair.append(distinct_of(pairs(histories(h, off), h)))
    return distinct_of(np.concatenate(single)), distinct_of(np.concatenate(pair))


def counts_of(keys: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of keys by sorted known keys; 0 for others."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, n[at], 0)


_ASK = "bucket bigint, part int, n bigint, n_tokens bigint, pairs binary, tokens binary"
_ANSWER = "bucket bigint, part int, n bigint, pairs binary, tokens binary, exact binary"
_ROWS = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def _by_parts(docs: DataFrame, counted: DataFrame, m: Model, parts: int) -> DataFrame:
    """Texts scored with segments that stay where they are."""
    s = m.settings
    buckets = max(1, -(-_bytes(docs) // s.bucket_bytes))
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))

    def ask(t: pa.Table) -> pa.Table:
        single, pair = asked(k.texts(t.column("text")))
        at, at2 = (np.searchsorted(part_of(x, parts), np.arange(parts + 1)) for x in (single, pair))
        own = np.flatnonzero(np.diff(at) + np.diff(at2))
        bucket = np.full(len(own), t.column("bucket")[0].as_py())
        cut_ = lambda x, at, p: x[at[p] : at[p + 1]]
        return pa.table({"bucket": bucket, "part": pa.array(own, pa.int32()), "n": np.diff(at2)[own], "n_tokens": np.diff(at)[own], "pairs": pa.array([pair_list(cut_(pair, at2, p)) for p in own], pa.binary()), "tokens": pa.array([token_list(cut_(single, at, p)) for p in own], pa.binary())})

    def answer(asks: pa.Table, segments: pa.Table) -> pa.Table:
        n = asks.column("n").to_pylist()
        pair = [pairs_of(x.as_py(), c) for x, c in zip(asks.column("pairs"), n, strict=True)]
        single = [tokens_of(x.as_py(), c) for x, c in zip(asks.column("tokens"), asks.column("n_tokens").to_pylist(), strict=True)]
        keys, ends = np.concatenate([*pair, *single] or [np.zeros(0, np.uint64)]), np.cumsum([len(x) for x in [*pair, *single]])
        if segments.num_rows:
            r = segments.to_pylist()[0]
            bits = np.frombuffer(r["segment"], np.uint8)
            held = lookup(Model(bits, np.zeros(1, np.uint64), np.array([len(bits) * 8], np.uint64), np.ones(1, np.int64), bits[:0], bits[:0], 0, 0, s), keys).astype(np.uint8)
            known = np.concatenate([np.frombuffer(r[c], np.uint64) for c in ("heavy", "tail")])
            exact = np.concatenate([widen(r[f"{c}_n"], len(r[c]) // 8) for c in ("heavy", "tail")])
            order = np.argsort(known)
            known, exact = known[order], exact[order]
        else:
            held, known, exact = np.zeros(len(keys), np.uint8), keys[:0], np.zeros(0, np.int64)
        held = np.split(held, ends[:-1])
        exact = [narrow(counts_of(x, known, exact)) for x in single]
        binary = lambda x: pa.array([y.tobytes() for y in x], pa.binary())
        return pa.table({"bucket": asks.column("bucket"), "part": asks.column("part"), "n": pa.array([len(x) for x in single], pa.int64()), "pairs": binary(held[: len(n)]), "tokens": binary(held[len(n) :]), "exact": pa.array(exact, pa.binary())})

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        texts = k.texts(t.column("text"))
        single, pair = asked(texts)
        rows = answers.sort_by("part").to_pylist()
        join = lambda name: np.frombuffer(b"".join(r[name] for r in rows), np.uint8).astype(np.int64)
        held, pair_held = join("tokens"), join("pairs")
        exact = np.concatenate([widen(r["exact"], r["n"]) for r in rows])
        out = {"n_tokens": [], "n_known": [], "base": [], "score": []}
        for _, _, part in k.blocks(texts, 1 << 20):
            h, off = tokens(part)
            at = ranks(single, h)
            c = exact[at]
            out["n_tokens"].append(np.diff(off))
            out["n_known"].append(k.sums((c > 0).astype(np.int64), off).astype(np.int64))
            out["base"].append(k.sums(np.log10(c + 1.0), off))
            pair_at = ranks(pair, pairs(histories(h, off), h))
            end = held[np.searchsorted(single, END)]
            out["score"].append(k.sums(log_probabilities(m, off, held[at], pair_held[pair_at], end), off))
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), **{c: np.concatenate(x) for c, x in out.items()}})

    # all columns, so that the texts are dealt once for both uses
    asks = dealt.groupBy("bucket").applyInArrow(ask, _ASK)
    answers = asks.groupBy("part").cogroup(counted.select("part", "segment", "heavy", "heavy_n", "tail", "tail_n").groupBy("part")).applyInArrow(answer, _ANSWER)
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(finish, _ROWS)


def score(docs: DataFrame, counted: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    session(docs)
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    sums = counted.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"), F.max("parts").alias("parts")).first()
    total, norm = sums["tokens"] or 0, math.log10((sums["tokens"] or 0) + (sums["distinct"] or 0) + 1)
    base = (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score")
    columns = ("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base, "score")
    if not is_sent(counted, settings):
        nothing = np.zeros(0, np.uint64)
        m = Model(nothing, nothing, nothing, nothing, nothing, nothing, total, sums["distinct"] or 0, settings)
        return _by_parts(docs, counted, m, sums["parts"] or 1).select(*columns)
    sent = docs.sparkSession.sparkContext.broadcast(model(counted, settings))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for i, j, t in k.blocks(k.texts(batch.column("text")), 2 << 20):
                yield from _scored(m, t, row + np.arange(j - i), batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i))
                row += j - i

    parts = cut(docs.mapInArrow(each, _SCORED))  # rows are numbered by their places: written, so that no later task numbers them anew
    c = F.when(F.col("tf").isNotNull(), F.col("c"))
    joined = parts.join(tail_counts(counted), "key", "left").select("row", "doc_id", "held_out", "n_tokens", "score", F.coalesce("n_known", F.when(c > 0, F.col("tf"))).alias("n_known"), F.coalesce("base", F.col("tf") * F.log10(c + 1)).alias("base"))
    found = joined.groupBy("row").agg(*(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "score")), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"))
    return found.select(*columns)
