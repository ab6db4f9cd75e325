"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

The CGK walk (Chakraborty, Goldenberg, Koucky 2016) reads a text from some start: step
j emits the current character and moves on if a random bit for (j, character) says so.
Texts of small edit distance get embeddings of small Hamming distance. Sampling some
embedded positions gives an LSH key; walks with bits and positions of their own are tried.
Windows of items and documents begin at the same kinds of places: at words, at each character of
scripts that are written without spaces, and everywhere in long unbroken runs; so an item that was pasted with
edits still has windows that the edits leave alone. A match of keys says at which offset
the item would lie. An item-sized stretch there, with room for the allowed edits, is verified by exact
(infix) edit distance, for many stretches at once.

How many walks an item gets follows from the target recall: for each class of window counts a task edits copies
of items by ``max_edits`` of their characters at random (``trials`` copies of up to ``sample`` items)
and adds walks until ``recall`` of them is met. A class that ``most_walks`` don't bring there is searched exactly.

Positions are sampled in walk order, so a document window is dropped at the first
prefix of its key that no item window has: most windows end after a few steps, and what
remains is the same as if all keys had been compared.

Texts are compared in lower case (A-Z) with white space runs as one space. An item is
found if at most ``max_edits`` times its length of edits lead to a stretch of the
document. Items with too few windows for walks are searched as whole words. Exact search: of room + 1 pieces one is in
any such stretch as it is, and every place that has one is verified.

The items go to the workers in blocks of ``block_bytes``. One operator holds documents of ``run_bytes`` against
all blocks by turns, so a worker has the lookups of two blocks at most; beyond ``pass_bytes`` of items the
documents are read again for the rest, so what is broadcast for one pass is bounded.

Defined cases: null or empty texts and items match nothing; repeated documents and
items are reported each; a null id stays null; of equally good stretches the first counts;
further columns are ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

import random
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidisc.llm import kernels as k
from lumidisc.llm.common import ids_and_texts, session

SCHEMA = "doc_id bigint, item_id bigint, edits bigint, item_chars bigint, first_word bigint, last_word bigint"
#: In place of a number of walks.
WHOLE_WORDS, EXACT = 0, -1


@dataclass(frozen=True)
class Settings:
    """steps: of a walk; samples: embedded positions in a key; stages: samples after which windows are dropped; recall: wanted at max_edits; few: items with up to so many windows are searched as whole words; run: bytes of an unbroken run after which windows begin everywhere; block_bytes, pass_bytes: of items looked up at once, and broadcast at once; run_bytes: of texts between two blocks."""

    steps: int = 60
    samples: int = 10
    stages: tuple[int, ...] = (3, 4, 5, 6, 8)
    max_edits: float = 0.2
    recall: float = 0.99
    trials: int = 6
    sample: int = 300
    most_walks: int = 64
    few: int = 3
    run: int = 16
    block_bytes: int = 4 << 20
    pass_bytes: int = 64 << 20
    run_bytes: int = 16 << 20
    seed: int = 7


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def infix_distance(item: bytes, stretch: bytes) -> tuple[int, int]:
    """The least edit distance of the item to any part of the stretch, and where the first such part ends (Myers' bit vectors)."""
    if (at := stretch.find(item)) >= 0:
        return 0, at + len(item)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        equal[c] |= 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(stretch):
        eq = equal.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def infix_distances(patterns: list[bytes], which: np.ndarray, buf: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """For each of many stretches buf[low:high] what infix_distance gives for patterns[which]; blocks of 64 characters (Hyyro 2003), all stretches of a batch in step."""
    size = np.array([len(p) for p in patterns], np.int64)[which]
    blocks = -(-size // 64)
    best, end = size.copy(), np.zeros(len(which), np.int64)
    order = np.lexsort((high - low, blocks))
    i = 0
    while i < len(order):
        n = int(blocks[order[i]])
        own = order[i : i + max(1, cells // n)]
        own = own[blocks[own] == n]
        i += len(own)
        if len(own) < 16 * n:  # too few to make up for the steps of a batch
            for x in own:
                best[x], end[x] = infix_distance(patterns[which[x]], buf[low[x] : high[x]].tobytes())
            continue
        distinct, of = np.unique(which[own], return_inverse=True)
        equal = np.zeros((len(distinct), 256, n), np.uint64)
        for x, p in enumerate(distinct):
            at = np.arange(len(patterns[p]))
            np.bitwise_or.at(equal[x], (np.frombuffer(patterns[p], np.uint8), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        top = np.uint64(1) << ((size[own] - 1) & 63).astype(np.uint64)
        plus, minus = np.full((n, len(own)), 2**64 - 1, np.uint64), np.zeros((n, len(own)), np.uint64)
        score, least, where = size[own].copy(), size[own].copy(), np.zeros(len(own), np.int64)
        first, last = low[own], high[own] - 1
        for j in range(int((last - first).max()) + 1 if len(own) else 0):
            at = first + j
            eqs = np.ascontiguousarray(equal[of, buf[np.minimum(at, last)]].T)
            up_in = down_in = None
            for b in range(n):
                eq, up, down = eqs[b], plus[b], minus[b]
                vertical = eq | down
                if b:
                    eq = eq | down_in
                horizontal = (((eq & up) + up) ^ up) | eq
                rise, fall = down | ~(horizontal | up), up & horizontal
                if b == n - 1:
                    score += (rise & top > 0).astype(np.int64) - (fall & top > 0)
                rise_out, fall_out = rise >> np.uint64(63), fall >> np.uint64(63)
                rise, fall = rise << np.uint64(1), fall << np.uint64(1)
                if b:
                    rise |= up_in
                    fall |= down_in
                plus[b], minus[b] = fall | ~(vertical | rise), rise & vertical
                up_in, down_in = rise_out, fall_out
            better = (score < least) & (at <= last)
            least[better], where[better] = score[better], j + 1
        best[own], end[own] = least, where
    return best, end


def within(patterns: list[bytes], which: np.ndarray, buf: np.ndarray, low: np.ndarray, high: np.ndarray, room: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """False where patterns that would begin at about low to high certainly take more than ``room`` edits: their pieces of up to 64 characters, each searched within room of its place, take no more than the whole. begin, end: of the texts."""
    size = np.array([len(p) for p in patterns], np.int64)
    pieces: list[bytes] = []
    first = np.zeros(len(patterns), np.int64)
    for i in np.unique(which):
        first[i] = len(pieces)
        pieces += [patterns[i][a : a + 64] for a in range(0, len(patterns[i]), 64)]
    left, ok = room.copy(), np.ones(len(which), bool)
    for n in range(int(-(-size[which].max(initial=0) // 64))):
        own = np.flatnonzero(ok & (64 * n < size[which]))
        a = np.clip(low[own] + 64 * n - room[own], begin[own], end[own] - 1)
        z = np.clip(high[own] + 64 * n + 64 + room[own], a + 1, end[own])
        edits, _ = infix_distances(pieces, first[which[own]] + n, buf, a, z)
        left[own] -= edits
        ok[own] = left[own] >= 0
    return ok


def places(buf: np.ndarray, run: int) -> np.ndarray:
    """Where windows begin: after a space or line end, at characters of three bytes and more, and at all characters more than ``run`` bytes into an unbroken run."""
    gap = (buf == 32) | (buf == 10)
    out = buf >= 0xE0
    out[:1] = True
    out[1:] |= gap[:-1]
    at = np.concatenate(([-1], np.flatnonzero(gap), [len(buf)]))
    for x in np.flatnonzero(np.diff(at) > run + 1):
        part = slice(at[x] + 1 + run, at[x + 1])
        out[part] |= buf[part] & 0xC0 != 0x80
    return np.flatnonzero(out & ~gap)


class Walk:
    """One repetition: its random bits, its sampled positions and the keys of all item windows."""

    def __init__(self, s: Settings, number: int):
        rng = np.random.default_rng((s.seed, number))
        self.s = s
        self.bits = rng.integers(0, 2, (s.steps, 256), np.uint8).astype(np.int64)
        gaps = rng.integers(2, 6, s.samples)
        at = np.minimum(np.cumsum(gaps) - gaps[0], s.steps - 1)
        self.sampled = np.unique(at)
        self.stages = [n for n in s.stages if n < len(self.sampled)]

    def run(self, buf: np.ndarray, start: np.ndarray, filters: dict[int, np.ndarray] | None = None, keep: dict[int, list] | None = None, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which starts are left, their keys, where their walks end). buf needs as many bytes after the last start as a walk has steps. In chunks that stay in a CPU's cache."""
        sampled, stages, out = self.sampled.tolist(), set(self.stages), []
        for first in range(0, len(start), chunk):
            at = start[first : first + chunk].copy()
            which = np.arange(first, first + len(at))
            key = np.zeros(len(at), np.uint64)
            n = 0
            for j in range(sampled[-1] + 1):
                c = buf.take(at)
                if j == sampled[n]:
                    key *= np.uint64(0x100000001B3)
                    key += c
                    key += np.uint64(1)
                    n += 1
                    if n in stages:
                        slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)
                        if keep is not None:
                            keep[n].append(slot)
                        if filters is not None:
                            on = np.flatnonzero(filters[n].take(slot))
                            which, at, key, c = which.take(on), at.take(on), key.take(on), c.take(on)
                            if not len(which):
                                break
                at += self.bits[j].take(c)
            out.append((which, key, at))
        if not out:
            return start, np.zeros(0, np.uint64), start
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def index(self, items: list[bytes]) -> None:
        """keys (sorted), and the item and offset of each."""
        base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in items]))).astype(np.int64)
        buf = np.frombuffer(b"".join(t + b"\n" for t in items) + bytes(len(self.bits) + 1), np.uint8)
        start = places(buf[: base[-1]], self.s.run)
        of = np.searchsorted(base, start, "right") - 1
        slots: dict[int, list] = defaultdict(list)
        _, key, end = self.run(buf, start, keep=slots)
        inside = end < base[of + 1] - 1
        self.filters = {}
        for n in self.stages:
            self.filters[n] = np.zeros(1 << 20, bool)
            if len(start):
                self.filters[n][np.concatenate(slots[n])[inside]] = True
        order = np.argsort(key[inside], kind="stable")
        self.keys, self.of, self.offset = key[inside][order], of[inside][order].astype(np.int32), (start - base[of])[inside][order].astype(np.int32)

    def hits(self, buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, where in buf they would begin, where the windows begin) of windows with equal keys."""
        if not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        which, key, _ = self.run(buf, start, self.filters)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        hit = np.repeat(np.arange(len(which)), high - low)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        return self.of[entry].astype(np.int64), start[which[hit]] - self.offset[entry], start[which[hit]]


def edited(text: bytes, share: float, r: random.Random) -> bytes:
    """With int(share * bytes) random edits of characters, or fewer bytes of them."""
    out, left = list(text.decode("utf-8", "replace")), int(share * len(text))
    letters = [c for c in out if c != " "] or ["x"]
    while left > 0 and out:
        at, new = r.randrange(len(out)), r.choice(letters)
        cost = max(len(out[at].encode()), len(new.encode()))
        if cost > left:
            break
        left -= cost
        kind = r.randrange(3)
        out[at : at + 1] = [new] if kind == 0 else [] if kind == 1 else [new, out[at]]
    return "".join(out).encode()


def window_counts(items: list[bytes], s: Settings) -> np.ndarray:
    probe = Walk(s, 0)
    probe.index(items)
    return np.bincount(probe.of, minlength=len(items)) if len(items) else np.zeros(0, np.int64)


def grades(items: list[bytes], s: Settings) -> np.ndarray:
    """The class of each item: 0 for too few windows, otherwise two for each doubling."""
    windows = window_counts(items, s)
    return np.where(windows > s.few, np.ceil(2 * np.log2(np.maximum(windows, 1))), 0).astype(np.int64)


def walks_of(some: list[bytes], s: Settings, seed: int) -> int:
    """How many walks items like these need, or EXACT."""
    r = random.Random(seed)
    copies = [edited(t, s.max_edits, r) for t in some for _ in range(s.trials)]
    of = np.repeat(np.arange(len(some)), s.trials)
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in copies])))
    buf = np.frombuffer(b"".join(t + b"\n" for t in copies) + bytes(s.steps + 1), np.uint8)
    start = places(buf[: base[-1]], s.run)
    room = np.array([int(s.max_edits * len(t)) + 1 for t in some])
    caught = np.zeros(len(copies), bool)
    for n in range(s.most_walks):
        walk = Walk(s, n)
        walk.index(some)
        item, begin, at = walk.hits(buf, start)
        copy = np.searchsorted(base, at, "right") - 1
        good = (of[copy] == item) & (np.abs(begin - base[copy]) <= room[item])
        caught[copy[good]] = True
        if n and caught.mean() >= s.recall:
            return n + 1
    return EXACT


def walks_for(items: list[bytes], s: Settings) -> np.ndarray:
    """For each item of a few its number of walks, WHOLE_WORDS or EXACT."""
    grade = grades(items, s)
    out = np.full(len(items), WHOLE_WORDS, np.int64)
    for g in np.unique(grade[grade > 0]).tolist():
        own = np.flatnonzero(grade == g)
        some = own[np.argsort(k.mix(own.astype(np.uint64)), kind="stable")[: s.sample]]
        out[own] = walks_of([items[i] for i in some], s, s.seed + g)
    return out


class Finder:
    """All items of a block, ready for lookups. walks: how many each item gets."""

    def __init__(self, items: list[tuple[int, bytes]], s: Settings, walks: np.ndarray | None = None):
        self.ids, self.items, self.s = [i for i, _ in items], [t for _, t in items], s
        tries = walks_for(self.items, s) if walks is None else walks
        self.short = np.array([t == WHOLE_WORDS for t in tries], bool)
        self.room = np.array([int(s.max_edits * len(t)) for t in self.items], np.int64)
        self.patterns = [b" " + t + b" " if short else t for t, short in zip(self.items, self.short, strict=True)]
        self.size = np.array([len(p) for p in self.patterns], np.int64)
        self.walks = [Walk(s, r) for r in range(int(tries.max(initial=0)))]
        for r, w in enumerate(self.walks):
            w.index([t if tries[i] > r else b"" for i, t in enumerate(self.items)])
        self.pieces = None
        held: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i in np.flatnonzero(np.array(tries) <= WHOLE_WORDS):
            p, n = self.patterns[i], self.room[i] + 1
            cuts = [len(p) * x // n for x in range(n + 1)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if self.items[i]:
                    held[p[a:z].decode("latin-1")].append((int(i), z))
        if held:
            self.pieces = ahocorasick.Automaton()
            for piece, where in held.items():
                self.pieces.add_word(piece, where)
            self.pieces.make_automaton()

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, last word): the best stretch for each pair that matches."""
        raw = b"".join(b" " + t + b" \n" for t in texts)
        buf = np.frombuffer(raw + bytes(self.s.steps + 1), np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts]))).astype(np.int64)
        start = places(buf[: len(raw)], self.s.run)
        found = []
        for w in self.walks:
            item, place, at = w.hits(buf, start)
            found.append(np.stack((np.searchsorted(begin, at, "right") - 1, item, place), 1))
        if self.pieces is not None:
            one = np.fromiter((x for e, where in self.pieces.iter(raw.decode("latin-1")) for i, z in where for x in (e + 1, i, e + 1 - z)), np.int64)
            e, item, place = one.reshape(-1, 3).T
            found.append(np.stack((np.searchsorted(begin, e, "left") - 1, item, place), 1))
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if not len(found):
            return []
        doc, item, place = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))].T
        # places of a document and item that lie within the allowed edits of each other are one stretch
        new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(place) > self.room[item[1:]] + 1))))
        low, high = place[new], np.append(place[new[1:] - 1], place[-1])
        near = within(self.patterns, item[new], buf, low, high, self.room[item[new]], begin[doc[new]], begin[doc[new] + 1])
        new, low, high = new[near], low[near], high[near]
        doc, item = doc[new], item[new]
        room, pad = self.room[item], np.where(self.short[item], 0, 1)
        low = np.maximum(begin[doc] + pad, low - room)
        high = np.minimum(begin[doc + 1] - 1 - pad, high + self.size[item] + room)
        fits = high - low >= self.size[item] - room
        doc, item, low, high, room = (x[fits] for x in (doc, item, low, high, room))
        edits, end = infix_distances(self.patterns, item, buf, low, high)
        good = np.flatnonzero(edits <= room)
        good = good[np.lexsort((low[good], edits[good], item[good], doc[good]))]
        first = np.concatenate((np.ones(min(1, len(good)), bool), (np.diff(doc[good]) != 0) | (np.diff(item[good]) != 0)))
        out = []
        for x in good[first].tolist():
            d, i, stop = int(doc[x]), int(item[x]), int(low[x] + end[x])
            left = max(int(begin[d]) + (not self.short[i]), stop - int(self.size[i] + self.room[i]))
            _, length = infix_distance(self.patterns[i][::-1], raw[left:stop][::-1])
            text = int(begin[d]) + 1
            a, z = stop - length, stop - 1
            if self.short[i]:
                a, z = a + 1, z - 1
            out.append((d, i, int(edits[x]), raw.count(b" ", text, max(text, a)), raw.count(b" ", text, max(text, z))))
        return out


def planned(benchmark: DataFrame, s: Settings) -> tuple[DataFrame, dict[int, int]]:
    """The items (item_id, item, grade), and the walks of each grade, of which there are a few dozens."""

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [normal(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"item_id": batch.column("item_id"), "item": pa.array(items, pa.binary()), "grade": grades(items, s)})

    def simulated(t: pa.Table) -> pa.Table:
        grade = t.column("grade")[0].as_py()
        return pa.table({"grade": [grade], "walks": pa.array([walks_of(sorted(t.column("item").to_pylist()), s, s.seed + grade)], pa.int64())})

    items = benchmark.select(F.col("item_id").cast("bigint"), "text").mapInArrow(graded, "item_id bigint, item binary, grade bigint").where("item <> x''")
    order = Window.partitionBy("grade").orderBy(F.xxhash64("item"), "item")
    some = items.where("grade > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.sample)
    walks = some.select("grade", "item").groupBy("grade").applyInArrow(simulated, "grade bigint, walks bigint").collect()
    return items, {0: WHOLE_WORDS} | {r["grade"]: r["walks"] for r in walks}


@dataclass(frozen=True)
class Block:
    """Items on their way to the workers, each with its number of walks."""

    name: str
    sent: Broadcast
    settings: Settings

    def finder(self) -> Finder:
        """In a worker, where the last two are kept."""
        if self.name not in _LOADED:
            if len(_LOADED) > 1:
                _LOADED.pop(next(iter(_LOADED)))
            items, walks = self.sent.value
            _LOADED[self.name] = Finder(items, self.settings, np.array(walks, np.int64))
        return _LOADED[self.name]


_LOADED: dict[str, Finder] = {}


def passes(benchmark: DataFrame, s: Settings) -> Iterator[list[Block]]:
    """The items in blocks, and these in lists of up to ``pass_bytes``. The driver has one block at a time, by one scan."""
    context = benchmark.sparkSession.sparkContext
    items, walks = planned(benchmark, s)
    block, blocks, size, whole = [], [], 0, 0

    def close() -> Block:
        return Block(uuid.uuid4().hex, context.broadcast(([x[:2] for x in block], [x[2] for x in block])), s)

    for r in items.orderBy("item_id", "item").toLocalIterator():
        block.append((r["item_id"], bytes(r["item"]), walks[r["grade"]]))
        size += len(r["item"])
        if size >= s.block_bytes:
            blocks.append(close())
            block, size, whole = [], 0, whole + size
            if whole >= s.pass_bytes:
                yield blocks
                blocks, whole = [], 0
    if block:
        blocks.append(close())
    if blocks:
        yield blocks


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[pa.RecordBatch, list[bytes]]]]:
    """Batches and their texts, so many that about ``most`` bytes wait for all blocks."""
    run, size = [], 0
    for batch in batches:
        run.append((batch, [normal(t) for t in batch.column("text").to_pylist()]))
        size += sum(map(len, run[-1][1]))
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _found(finder: Finder, texts: list[bytes]) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Matches, by blocks of texts; the first number is the text's."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= 2 << 20):
            size += len(texts[j]) + 1
            j += 1
        yield [(i + d, *rest) for d, *rest in finder.find(texts[i:j])]
        i = j


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each document and item that it holds, with the fewest edits and the words where it lies."""
    spark, s = session(docs), settings
    one = []
    for blocks in passes(benchmark, s):

        def each(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for run in _runs(batches, s.run_bytes):
                for f in (b.finder() for b in blocks):
                    for batch, texts in run:
                        for found in _found(f, texts):
                            if found:
                                d, i, edits, first, last = (np.array(x) for x in zip(*found, strict=True))
                                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(d)), "item_id": pa.array([f.ids[x] for x in i], pa.int64()), "edits": edits, "item_chars": [len(f.items[x]) for x in i], "first_word": first, "last_word": last})

        one.append(ids_and_texts(docs).mapInArrow(each, SCHEMA))
    return reduce(DataFrame.unionByName, one) if one else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents, with all columns, that hold no item."""
    session(docs)
    s, out = settings, docs
    for blocks in passes(benchmark, s):

        def each(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for run in _runs(batches, s.run_bytes):
                left = [np.arange(batch.num_rows) for batch, _ in run]
                for f in (b.finder() for b in blocks):
                    for x, (_, texts) in enumerate(run):
                        gone = [d for found in _found(f, [texts[i] for i in left[x]]) for d, *_ in found]
                        left[x] = np.delete(left[x], gone)
                yield from (batch.take(pa.array(rows)) for (batch, _), rows in zip(run, left, strict=True))

        out = out.mapInArrow(each, docs.schema)
    return out
