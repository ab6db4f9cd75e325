"""Best-fit packing of tokenised documents into sequences.

A document's tokens are its ids, then an end id; longer ones are cut into pieces of
at most ``tokens`` ids. Packing is vector best-fit decreasing: a sequence has residual
capacities for tokens, documents and attention cost (the sum of squared lengths). A
piece goes to a sequence where every capacity suffices, by the highest weighted dot
product of demand and residual, or by the least weighted norm of what would be left;
if there is none, to a new one. Candidates are looked at from the tightest token residual upwards.

Tasks tokenise what they read; of each piece only a narrow row with its length and hash goes on. Those rows are dealt by
hash, of their number too so that repeated rows spread, into as few groups of about ``group`` pieces as hold them, and each is packed by one task. So every
group is a fair sample of all lengths, where short pieces fill what long ones leave; it fills all
but its last sequences, and the loss is under one sequence for a group on any partitioning. Rows are numbered in the checkpoint, so a task that is run again gets the same.

At the query's 4096 tokens the other two capacities don't bind: no sequence holds more than 4096 pieces, and squares of lengths
that add up to 4096 never exceed 4096 squared. They do bind at smaller settings.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each;
null ids stay null; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidisc.llm.common import cut, ids_and_texts, session

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
SCHEMA = f"{PIECES}, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class Settings:
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"
    look: int = 4
    group: int = 50_000
    end_id: int = 1


#: Characters of a word that is worth keeping; with their number this bounds the cache's bytes.
LONGEST = 64


class WordEncoder:
    """Ids of whole texts by a word-level cache.

    The vocabulary's pre-tokenizer cuts a text into words that are encoded
    independently, so each distinct word is encoded once by the library. Texts
    with characters outside plain Latin, control characters, or what may be a special
    token go through the library whole. ``words``: the most words held; those of more than LONGEST characters never are.
    """

    # The contractions that the vocabulary's pre-tokenizer cuts off.
    CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.limit = words
        letters = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "L")
        numbers = "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == "N")
        self.word = re.compile(f"{'|'.join(self.CONTRACTIONS)}|[{letters}]+|[{numbers}]|[^ \\t\\n\\r{letters}{numbers}]+")
        self.other = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]|<\\|")
        self.cache: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.other.search(text):
            return self._library(text)
        words = self.word.findall(text.lower())
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        if len(cache) > self.limit:  # the first third holds the frequent words
            kept = list(islice(cache.items(), self.limit // 3))
            cache.clear()
            cache.update(kept)
        new = [w for w in set(words) if w not in cache]
        long: dict[str, bytes] = {}
        for i in range(0, len(new), 5000):
            some = new[i : i + 5000]
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            ids, at = np.array(found.ids, "<u4"), np.searchsorted(np.array(found.word_ids), np.arange(len(some) + 1))
            for w, a, b in zip(some, at[:-1], at[1:], strict=True):
                (cache if len(w) <= LONGEST else long)[w] = ids[a:b].tobytes()
        return b"".join([cache[w] if w in cache else long[w] for w in words])


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


class Bins:
    """Open sequences by token residual. A bit of ``levels`` says whether any sequence has that residual."""

    def __init__(self, s: Settings):
        self.s, self.levels, self.n = s, 0, 0
        self.at: list[list[tuple[int, int, int]]] = [[] for _ in range(s.tokens + 1)]

    def _better(self, length: int, free: int, documents: int, attention: int) -> float:
        s = self.s
        demand = (length / s.tokens, 1 / s.documents, length * length / s.attention)
        left = (free / s.tokens, documents / s.documents, attention / s.attention)
        if s.rule == "dot":
            return -sum(w * d * r for w, d, r in zip(s.weights, demand, left, strict=True))
        return sum(w * (r - d) ** 2 for w, d, r in zip(s.weights, demand, left, strict=True))

    def put(self, length: int) -> tuple[int, int]:
        """The sequence for a piece, and the tokens before it there."""
        s, best, seen, level = self.s, None, 0, length
        while seen < s.look and (above := self.levels >> level):
            level += (above & -above).bit_length() - 1
            for i in range(len(self.at[level]) - 1, -1, -1):
                _, documents, attention = self.at[level][i]
                if documents >= 1 and attention >= length * length:
                    score = self._better(length, level, documents, attention)
                    if best is None or score < best[0]:
                        best = (score, level, i)
                    seen += 1
                    break
            level += 1
        if best is None:
            number, free, documents, attention = self.n, s.tokens, s.documents, s.attention
            self.n += 1
        else:
            _, free, i = best
            number, documents, attention = self.at[free].pop(i)
            if not self.at[free]:
                self.levels &= ~(1 << free)
        left = free - length
        if left and documents > 1:
            self.at[left].append((number, documents - 1, attention - length * length))
            self.levels |= 1 << left
        return number, s.tokens - free


def pack_lengths(lengths: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece its sequence and offset; the number of sequences."""
    if len(lengths) and (lengths.max() > s.tokens or int(lengths.max()) ** 2 > s.attention or s.documents < 1):
        raise ValueError("a piece fits no sequence")
    bins = Bins(s)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        sequence[i], offset[i] = bins.put(int(lengths[i]))
    return sequence, offset, bins.n


def pack(docs: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """A row for each piece. ``path``: the vocabulary file, on every worker."""
    s = settings
    end = np.array([s.end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, rows = encoder(path), []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                ids = (e.ids(text) if text else b"") + end
                step = 4 * s.tokens
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                row, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc})

    def packed(t: pa.Table) -> pa.Table:
        group = t.column("bucket")[0].as_py()
        t = t.drop_columns("bucket").sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece")])
        sequence, offset, n = pack_lengths(t.column("length").to_numpy(), s)
        return t.append_column("sequence_id", pa.array((group << 32) + sequence)).append_column("offset", pa.array(offset))

    session(docs)
    once = cut(ids_and_texts(docs).mapInArrow(pieces, PIECES))  # so that texts are tokenised once, and counted for the number of groups
    groups = max(1, -(-once.count() // s.group))
    return once.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))).groupBy("bucket").applyInArrow(packed, SCHEMA)
