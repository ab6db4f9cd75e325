"""Alignment of two tokenizers: which ids of one stand for the same bytes as which ids of the other.

A text is encoded by a byte-level vocabulary (A, with a space in front) and a piece vocabulary (B, which puts one
there itself). Byte offsets where tokens of both end cut it into groups; within a group every A token is linked with
every B token. The count of an id pair is the number of documents that hold it linked.

Postings cogroup. Texts are encoded once, in blocks of some MB; a block becomes one posting list for each of its A ids
(B id, document, multiplicity, sorted) and is written to the shared folder. Counts are summed from the lists, map-side
first, and gathered by A id. Lists then meet the counts of their A ids (a cogroup by parts of A ids); there each
document's share is computed, summed over the part, and sent to the document's block, where shares are summed.

The exchanges carry lists, so their rows and bytes are in proportion to the text. A frequent A id is dealt over several
parts by block, each with the id's counts, so no part outgrows ``part_bytes`` by more than a quarter of it and one
id's counts (as many as vocabulary B has entries at most). The only broadcast holds one number for each id of A.

Defined cases: texts that are null, empty or not restored exactly by either vocabulary have no tokens: zeros and an empty
``groups_sha256``; repeated rows are documents of their own, null ids too; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidisc.llm.common import cut, ids_and_texts, session

#: How byte-level vocabularies of this kind cut a text before they merge: a fixed value of the format.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded by the slower library, whose time and stack don't depend on long runs of one kind.
LONG = 1 << 20
#: Bytes of a posting: B id, document, multiplicity.
POSTING = 5


class Settings(NamedTuple):
    block_bytes: int = 3 << 20
    part_bytes: int = 8 << 20
    #: Links that one numpy step expands; larger groups are multiplied by distinct ids.
    links: int = 1 << 19
    #: (A id, B id) counts that a task gathers before it passes them on.
    counts: int = 1 << 20


class ByteEncoder:
    """A byte-level vocabulary in a tokenizers file. Where ids are in the order of the merges, merging by smallest id is the same and several times faster."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the format
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        specials = {t for t in model["vocab"] if any(c not in letters for c in t)} | {t for t in model["vocab"] if t.startswith("<|") and t.endswith("|>")}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        at = [model["vocab"][m] for m in merges]
        self.path, self.slow, self.fast = path, None, None
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        for t, i in ranks.items():
            self.bytes[i] = t
        if at == sorted(at) and len(ranks) == len(merges) + 256:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and len(text) <= LONG:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # lone surrogates, or a pattern that gives up
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class PieceEncoder:
    """A sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = lambda i: bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = [piece(i) for i in range(m.vocab_size())]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


class Pair:
    """Both vocabularies, with the lengths of their tokens and their ids as text with each separator."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteEncoder(path_a), PieceEncoder(path_b)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 entries")
        self.size_a, self.size_b = (np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b))
        self.text = [f"{i}{sep}" for v, sep in ((self.a, ","), (self.a, "|"), (self.b, ","), (self.b, ";")) for i in range(len(v.bytes))]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a, b = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        for i, text in ((i, t) for i, t in enumerate(texts) if t):
            x, y, raw = self.a.ids(" " + text), self.b.ids(text), (" " + text).encode("utf-8", "replace")
            if b"".join(map(self.a.bytes.__getitem__, x.tolist())) == raw == b"".join(map(self.b.bytes.__getitem__, y.tolist())):
                a[i], b[i] = x, y
        return a, b


_LOADED: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    key = (path_a, path_b)
    if key not in _LOADED:
        _LOADED[key] = Pair(*key)
    return _LOADED[key]


class Block(NamedTuple):
    """key: A id, B id, document (16 bits each), sorted, with multiplicities; own: a dict for each document."""

    key: np.ndarray
    mult: np.ndarray
    own: list[dict]


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from first[i] on, n[i] of them, for every i."""
    at = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(first - at, n)


def align_block(p: Pair, doc_ids: list, texts: list[str | None], s: Settings) -> Block:
    a_of, b_of = p.encode(texts)
    docs = len(texts)
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a_of, b_of))
    doc_a = np.repeat(np.arange(docs), [len(x) for x in a_of])
    # the bytes of both are the same, document by document, so ends count on through the block
    end_a, end_b = np.cumsum(p.size_a[a]), np.cumsum(p.size_b[b])
    at = np.searchsorted(end_b, end_a)
    both = end_b[np.minimum(at, len(b) - 1)] == end_a if len(b) else np.zeros(len(a), bool)
    last_a, last_b = np.flatnonzero(both), at[both]
    first_a, first_b = (np.concatenate(([0], x + 1))[:-1] if len(x) else x for x in (last_a, last_b))
    n_a, n_b = last_a + 1 - first_a, last_b + 1 - first_b
    doc = doc_a[last_a]
    links = n_a * n_b
    keys, weights, large = [], [], np.flatnonzero(links > s.links)
    links_left = np.where(links > s.links, 0, links)
    for span in np.split(np.arange(len(links)), np.flatnonzero(np.diff(np.cumsum(links_left) // s.links)) + 1):
        g = span[links_left[span] > 0]
        ia = _expand(first_a[g], n_a[g])
        width = np.repeat(n_b[g], n_a[g])
        ib = _expand(np.repeat(first_b[g], n_a[g]), width)
        keys.append((np.repeat(a[ia] << 32 | np.repeat(doc[g], n_a[g]), width)) | b[ib] << 16)
        weights.append(np.ones(len(ib), np.int64))
    for g in large:
        (x, nx), (y, ny) = (np.unique(v[f : f + n], return_counts=True) for v, f, n in ((a, first_a[g], n_a[g]), (b, first_b[g], n_b[g])))
        keys.append((x[:, None] << 32 | y[None, :] << 16 | doc[g]).ravel())
        weights.append((nx[:, None] * ny[None, :]).ravel())
    key, weight = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*weights, np.zeros(0, np.int64)])
    if len(large):
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
    else:
        key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    mult = np.add.reduceat(weight, first) if len(key) else weight
    # groups in order: A ids, then B ids; each id carries the separator behind it
    sep_a, sep_b = both.astype(np.int64), np.zeros(len(b), np.int64)
    sep_b[last_b] = 1
    group_a, group_b = np.cumsum(both) - both, np.cumsum(sep_b) - sep_b
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = a + sep_a * len(p.a.bytes)
    code[np.arange(len(b)) + (last_a + 1)[group_b]] = b + sep_b * len(p.b.bytes) + 2 * len(p.a.bytes)
    size = np.array([len(x) + len(y) for x, y in zip(a_of, b_of, strict=True)], np.int64)
    ends = np.cumsum(size)
    own, groups, link_sums = [], np.bincount(doc, minlength=docs), np.zeros(docs, np.int64)
    np.add.at(link_sums, doc, links)
    for i in range(docs):
        text = "".join(map(p.text.__getitem__, code[ends[i] - size[i] : ends[i]].tolist()))[:-1]
        own.append({"doc_id": doc_ids[i], "n_a": len(a_of[i]), "n_b": len(b_of[i]), "n_groups": int(groups[i]), "n_links": int(link_sums[i]), "groups_sha256": hashlib.sha256(text.encode()).hexdigest() if text else ""})
    return Block(key[first], mult, own)


OWN = "array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
_OWN = pa.list_(pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())]))
#: A posting list has the A id and its three columns; a row with a = -1 has a block's documents.
LISTS = f"block bigint, a int, b binary, doc binary, mult binary, more binary, own {OWN}"


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values between neighbouring places as one binary each."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def lists_of(block: Block, number: int) -> Iterator[pa.RecordBatch]:
    a = block.key >> 32
    at = np.concatenate((np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), [len(a)])) if len(a) else np.zeros(1, np.int64)
    n = len(at) - 1
    short = np.minimum(block.mult, 255).astype(np.uint8)
    high = np.concatenate(([0], np.cumsum(short == 255)))[at]
    own = lambda rows, docs: [pa.nulls(rows, _OWN), pa.array([docs], _OWN)]
    empty = pa.nulls(1, pa.binary())
    columns = [
        pa.array(np.full(n + 1, number)),
        pa.array(np.concatenate((a[at[:-1]], [-1])), pa.int32()),
        *(pa.concat_arrays([_binary(v, w), empty]) for v, w in (((block.key >> 16 & 0xFFFF).astype(np.uint16), at), ((block.key & 0xFFFF).astype(np.uint16), at), (short, at), (block.mult[short == 255].astype(np.int64), high))),
        pa.concat_arrays(own(n, block.own)),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["block", "a", "b", "doc", "mult", "more", "own"])


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts in blocks of up to so many bytes and 65,536 documents; a longer text stands alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        raw = batch.column("text").cast(pa.large_binary()).to_pylist()
        for i, t in zip(batch.column("doc_id").to_pylist(), raw, strict=True):
            n = len(t or b"")
            if ids and (size + n > most or len(ids) == 1 << 16):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t and t.decode("utf-8", "replace"))
            size += n
    if ids:
        yield ids, texts


def posting_lists(docs: DataFrame, path_a: str, path_b: str, s: Settings = Settings()) -> DataFrame:
    """Every text encoded and linked, as posting lists of blocks; written to the shared folder."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for ids, texts in _texts(batches, s.block_bytes):
            yield from lists_of(align_block(pair(path_a, path_b), ids, texts, s), number)
            number += 1

    session(docs)
    return cut(ids_and_texts(docs).mapInArrow(each, LISTS))


def flat(batch: pa.RecordBatch | pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in batch.column(name).to_pylist()), kind)


def postings(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The row and the pair (A id, B id in one number) of every posting."""
    b = flat(batch, "b", np.uint16).astype(np.int64)
    n = np.array([len(x or b"") // 2 for x in batch.column("b").to_pylist()], np.int64)
    return np.repeat(np.arange(batch.num_rows), n), np.repeat(batch.column("a").to_numpy().astype(np.int64), n) << 16 | b


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def counts_of_lists(lists: DataFrame, s: Settings = Settings()) -> DataFrame:
    """a, b, n_docs: how many documents hold the pair linked, for every pair that occurs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            key, n = summed(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_pydict({"a": pa.array(key >> 16, pa.int32()), "b": pa.array(key & 0xFFFF, pa.int32()), "n": n})

        for batch in batches:
            key, n = np.unique(postings(batch)[1], return_counts=True)
            keys.append(key)
            counts.append(n.astype(np.int64))
            held += len(key)
            if held > 2 * s.counts:
                key, n = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [key], [n], len(key)
                if held > s.counts:
                    yield out()
                    keys, counts, held = [], [], 0
        if held:
            yield out()

    session(lists)
    return lists.where("a >= 0").select("a", "b").mapInArrow(each, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n_docs"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, s: Settings = Settings()) -> DataFrame:
    """The alignment table itself: a, b, n_docs."""
    return counts_of_lists(posting_lists(docs, path_a, path_b, s), s)


_SHARES = "block bigint, doc binary, best binary, sum binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _share(lists: pa.Table, known: pa.Table) -> pa.Table:
    """What the posting lists of one part give their documents."""
    row, key = postings(lists)
    size = [len(x) for x in known.column("counts").to_pylist()]
    counts = known.column("counts").combine_chunks().flatten() if known.num_rows else pa.array([], pa.struct([("b", pa.int32()), ("n_docs", pa.int64())]))
    have = np.repeat(known.column("a").to_numpy().astype(np.int64), size) << 16 | counts.field("b").to_numpy()
    n_docs, order = counts.field("n_docs").to_numpy(), np.argsort(have)
    at = order[np.searchsorted(have, key, sorter=order)]
    n, best = n_docs[at], np.repeat(known.column("best").to_numpy(), size)[at]
    mult = flat(lists, "mult", np.uint8).astype(np.int64)
    mult[mult == 255] = flat(lists, "more", np.int64)
    blocks, block = np.unique(lists.column("block").to_numpy(), return_inverse=True)
    place = block[row] << 16 | flat(lists, "doc", np.uint16)
    doc, sums = summed(place, np.stack((np.where(n == best, mult, 0), mult * n), 1))
    at = np.searchsorted(doc >> 16, np.arange(len(blocks) + 1))
    return pa.table({"block": blocks, "doc": _binary((doc & 0xFFFF).astype(np.uint16), at), "best": _binary(sums[:, 0].copy(), at), "sum": _binary(sums[:, 1].copy(), at)})


def _finish(own: pa.Table, shares: pa.Table) -> pa.Table:
    """The documents of one block with the sums of their shares."""
    docs = own.column("own").combine_chunks().flatten()
    sums = np.zeros((len(docs), 2), np.int64)
    np.add.at(sums, flat(shares, "doc", np.uint16).astype(np.int64), np.stack((flat(shares, "best", np.int64), flat(shares, "sum", np.int64)), 1))
    more = {"n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1])}
    return pa.table({c: more[c] if c in more else docs.field(c) for c in (x.split()[0] for x in RESULT.split(", "))})


def align(docs: DataFrame, path_a: str, path_b: str, s: Settings = Settings()) -> DataFrame:
    """Tokens, groups and links of every document, with how its links count in the whole corpus. Paths: vocabulary files, on every worker."""
    lists = posting_lists(docs, path_a, path_b, s)
    known = counts_of_lists(lists, s).groupBy("a").agg(F.collect_list(F.struct("b", "n_docs")).alias("counts"), F.max("n_docs").alias("best"), F.sum("n_docs").alias("postings"))
    known = cut(known)
    size = POSTING * (known.agg(F.sum("postings")).first()[0] or 0)
    parts = max(1, -(-size // s.part_bytes), min(64, -(-size // (s.part_bytes >> 4))))
    salts = F.greatest(F.lit(1), F.ceil(F.col("postings") * (4 * POSTING) / F.lit(float(s.part_bytes)))).cast("int").alias("salts")
    part = F.pmod(F.xxhash64("a", "salt"), F.lit(parts)).alias("part")
    # as many rows as vocabulary A has ids
    dealt = lists.where("a >= 0").join(F.broadcast(known.select("a", salts)), "a")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts"))).select(part, "block", "a", "b", "doc", "mult", "more")
    sent = known.select("a", "counts", "best", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)).alias("salt")).select(part, "a", "counts", "best").dropDuplicates(["part", "a"])
    shares = dealt.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_share, _SHARES)
    return lists.where("a < 0").select("block", "own").groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(_finish, RESULT)
