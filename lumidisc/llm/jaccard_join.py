"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its distinct word shingles (64-bit hashes). Two sets of a
and b shingles link when their symmetric difference is at most (a + b) / 9 (Jaccard 0.8).

Signatures (after Deng, Li, Wen, Feng 2015). Set sizes fall into bands, each 1.25 times
as wide as the last, so a pair lies in one band or in two neighbours; scheme k serves the pairs whose
smaller set is in band k. It splits the universe of hashes into segments such that
sets with at most H differences must agree in enough of them:

* exact allocation: with more than H segments, one is equal in both sets. A set indexes all
  its segments that aren't empty and looks up its H + 1 largest; if it has fewer,
  it indexes and looks up the empty ones too;
* one-deletion allocation: with (H + 1) / 2 segments, one differs by at most one
  shingle. A set indexes each segment and each segment less one shingle.

A cost model of entries and of entries too small to select chooses per scheme.
Entries go to parts by (scheme, hash); a group finds equal entries, and drops pairs
whose parity sketches prove too many differences. What is left are candidates.

Exact copies are one class from the start. Each part keeps a spanning forest of its candidates, never
their list, so memory is linear in its entries. Forests make components; each member is verified
exactly against one pivot of its component (the one with most
candidates), which settles groups of near copies with one comparison a member. Members of components
that this doesn't span go on, dealt by component into buckets of ``part_bytes`` of text: a task finds their candidates by the same
signatures, verifies those whose ends aren't connected by links yet exactly, and keeps a forest of links.
A component of more than ``part_bytes`` is dealt by signature instead, or by pairs of blocks of sets where those are fewer copies, with all shingles in place of sketches. All ways are exact.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; a null
text or one without words has an empty set and is linked with nothing; rows with a null id are
left out; repeated rows change nothing; rows that share an id but not a text give one row, with the
largest size and the smallest component; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidisc.llm import kernels as k
from lumidisc.llm.common import cut, ids_and_texts, sent_if_small, session
from lumidisc.llm.components import components

#: A share of differences of 1 / DIFFERENCE of both sizes is Jaccard 0.8: (1 - 0.8) / (1 + 0.8) = 1 / 9.
DIFFERENCE = 9
#: Narrow rows that a task should read at least.
_ROWS = 200_000
#: Entries of a part at most, 5 bytes each, and of one pass over a part.
MOST_ENTRIES = 8_000_000
PASS_ENTRIES = 1_000_000
#: Sketches of one side of the pairs that are compared at once.
PAIR_BYTES = 6_400_000
#: Parts that keep a cluster's cores busy; with as many, parts grow up to MOST_ENTRIES.
PARTS = 64
_KEY_BITS = np.uint64(39)
_KEY_MASK = np.uint64((1 << 39) - 1)


@dataclass(frozen=True)
class Scheme:
    """differences: H; segments; deletion: one-deletion allocation; sketch: bits of the parity sketch."""

    number: int
    top: int
    differences: int
    segments: int
    deletion: bool
    sketch: int


def _poisson_at_most(n: int, mean: float) -> float:
    return sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(n + 1))


def schemes(largest: int, ambiguous: float = 8.0) -> list[Scheme]:
    """All schemes for sets of up to ``largest`` shingles. ``ambiguous``: the cost of an entry of at most one shingle, in entries."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * 5 // 4))
    out = []
    for number, top in enumerate(tops):
        h = (top + top * 5 // 4) // DIFFERENCE
        exact = math.ceil(1.25 * (h + 1)) + 2
        deletion = (h + 2) // 2
        by_exact = exact * (1 + ambiguous * _poisson_at_most(1, top / exact))
        by_deletion = top + deletion * (1 + ambiguous * _poisson_at_most(2, top / deletion))
        sketch = max(128, -(-3 * h // 64) * 64)  # unrelated sets differ in about half of the bits, more than h at any size
        out.append(Scheme(number, top, h, deletion if by_deletion < by_exact else exact, by_deletion < by_exact, sketch))
    return out


def count_type(s: Scheme) -> type:
    """Of sizes and numbers of entries, which are below 2 n."""
    return np.uint16 if s.top < 20_000 else np.int32


def entries_of(s: Scheme, n: int) -> int:
    """About how many entries a set of n shingles has."""
    return n + s.segments if s.deletion else s.segments


def shingles(t: k.Texts, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    w = k.words(t)
    h, off = k.windows(w.hash, w.off, size)
    out = []
    for i in range(len(t)):
        own = h[off[i] : off[i + 1]]
        if not len(own) and w.off[i] < w.off[i + 1]:
            words = w.hash[w.off[i] : w.off[i + 1]]
            own = k.windows(words, np.array([0, len(words)]), len(words), salt=1)[0]
        own = np.sort(own)
        out.append(own[np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))])
    return out


def node_of(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    n = np.uint64(len(own))
    return tuple(int(x) for x in k.mix(np.array([own.sum(dtype=np.uint64) + n, k.mix(own.copy()).sum(dtype=np.uint64) ^ n], np.uint64)).view(np.int64))


def signatures(own: np.ndarray, s: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Entry hashes of a sorted set under a scheme, and whether each is looked up."""
    m = s.segments
    segment = ((own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    size = np.bincount(segment, minlength=m)
    total = np.zeros(m, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        total[full] = np.add.reduceat(own, (np.cumsum(size) - size)[full])
    salt = np.uint64(s.number * 0x9E3779B97F4A7C15 & (2**64 - 1))
    names = np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt
    if s.deletion:
        less = total[segment] - own
        return k.mix(np.concatenate((total + names, less + names[segment]))), np.ones(m + len(own), bool)
    if len(full) <= s.differences:
        return k.mix(total + names), np.ones(m, bool)
    probes = np.zeros(len(full), bool)
    probes[np.argsort(-size[full], kind="stable")[: s.differences + 1]] = True
    return k.mix(total[full] + names[full]), probes


def sketch(own: np.ndarray, bits: int) -> bytes:
    """Parities: the Hamming distance of two sketches is at most the symmetric difference of the sets."""
    return np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


@dataclass(frozen=True)
class Plan:
    """The schemes, and where each one's parts begin. blocks: of schemes whose parts are pairs of blocks of sets, not ranges of entries, how many blocks."""

    schemes: list[Scheme]
    first: list[int]
    size: int
    blocks: dict[int, int] = field(default_factory=dict)

    def copies(self, number: int, entries: int) -> int:
        """In how many parts a set lies at most."""
        return self.blocks[number] - 1 if number in self.blocks else min(entries, self.first[number + 1] - self.first[number])

    def of(self, n: int) -> list[Scheme]:
        """Its own band's scheme and that of the band below; those without differences find only exact copies."""
        band = next(s.number for s in self.schemes[self.guess(n) :] if s.top >= n)
        return [s for s in self.schemes[max(0, band - 1) : band + 1] if s.differences]

    def guess(self, n: int) -> int:
        low, high = 0, len(self.schemes) - 1
        while low < high:
            mid = (low + high) // 2
            if self.schemes[mid].top >= n:
                high = mid
            else:
                low = mid + 1
        return low


def make_plan(profile: DataFrame, size: int, part_entries: int, part_bytes: int = 0, parts_wanted: int = 0) -> Plan:
    """Parts of about ``part_entries`` entries, from the number of sets in each band; with part_bytes, of about so many bytes of whole sets too.

    A set is named anew in each part that has one of its entries. With parts_wanted, parts therefore hold more, up to ``MOST_ENTRIES``,
    as long as there are that many of them, so that sets meet no more parts in a larger table. With part_bytes, a scheme whose sets have more
    is dealt into blocks of half as much, and each two blocks are a part, where that copies sets less often than their entries would.
    """
    largest = profile.agg(F.max("n_shingles")).first()[0] or 1
    found = schemes(largest)
    tops = F.array(*(F.lit(s.top) for s in found))
    band = F.size(F.filter(tops, lambda top: top < F.col("n_shingles")))
    counts = {r["band"]: (r["n"], r["total"]) for r in profile.where("n_shingles > 0").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).collect()}
    own_of = [[counts[b] for b in (s.number, s.number + 1) if b in counts] for s in found]
    entries_in = [sum(entries_of(s, total / n) * n for n, total in own) for s, own in zip(found, own_of, strict=True)]
    if parts_wanted:
        part_entries = min(max(part_entries, MOST_ENTRIES), max(part_entries, math.ceil(sum(entries_in) / parts_wanted)))
    first, at, blocks = [], 0, {}
    for s, own, entries in zip(found, own_of, entries_in, strict=True):
        first.append(at)
        parts = max(1, math.ceil(entries / part_entries))
        if part_bytes and (whole := sum(8 * total for _, total in own)) > part_bytes:
            # a set lies once in each part that has one of its entries
            while (copied := sum(8 * total * (1 - (1 - 1 / parts) ** entries_of(s, total / n)) for n, total in own)) > part_bytes:
                parts *= 2
            if (n := math.ceil(2 * whole / part_bytes)) - 1 < copied * parts / whole:
                blocks[s.number], parts = n, n * (n - 1) // 2
        at += parts
    return Plan(found, [*first, at], size, blocks)


_BLOBS = "part int, scheme int, nodes binary, sizes binary, labels binary, counts binary, contents binary, entries binary"


def indexed(docs: DataFrame, plan: Plan, whole: bool, flush: int = 1_500_000, flush_bytes: int = 48 << 20) -> DataFrame:
    """Blobs of entries by part. docs: doc_id, text, label; exact copies within a task are indexed once. whole: contents are all shingles, not sketches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: dict[int, list] = {}
        size = weight = 0

        def out() -> Iterator[pa.RecordBatch]:
            for number, rows in held.items():
                s = plan.schemes[number]
                parts = plan.first[number + 1] - plan.first[number]
                keys = np.concatenate([x[3] for x in rows])
                probes = np.concatenate([x[4] for x in rows])
                of = np.repeat(np.arange(len(rows)), [len(x[3]) for x in rows])
                packed = (keys & _KEY_MASK) | probes.astype(np.uint64) << _KEY_BITS
                blocks = plan.blocks.get(number)
                part = np.array([x[0] % blocks for x in rows])[of] if blocks else ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange((blocks or parts) + 1))
                dealt = [order[at[p] : at[p + 1]] for p in range(blocks or parts)]
                dealt = (np.sort(np.concatenate(two)) for two in combinations(dealt, 2)) if blocks else dealt
                table = {name: [] for name in ("part", "scheme", "nodes", "sizes", "labels", "counts", "contents", "entries")}
                for p, own in enumerate(dealt):
                    if len(own):
                        docs_in, counts = np.unique(of[own], return_counts=True)
                        members = [rows[d] for d in docs_in]
                        table["part"].append(plan.first[number] + p)
                        table["scheme"].append(s.number)
                        table["nodes"].append(np.array([x[0] for x in members], np.int64).tobytes())
                        table["sizes"].append(np.array([x[1] for x in members], count_type(s)).tobytes())
                        table["labels"].append(np.array([x[2] for x in members], np.int64).tobytes() if whole else b"")
                        table["counts"].append(counts.astype(count_type(s)).tobytes())
                        table["contents"].append(b"".join(x[5] for x in members))
                        table["entries"].append(packed[own].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c in ("part", "scheme") else pa.binary()) for c, v in table.items()})
            held.clear()

        for batch in batches:
            labels = batch.column("label").to_pylist()
            for i, _, t in k.blocks(k.texts(batch.column("text"))):
                for d, own in enumerate(shingles(t, plan.size)):
                    if not len(own) or (node := node_of(own)[0]) in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(node)
                    for s in plan.of(len(own)):
                        keys, probes = signatures(own, s)
                        contents = own.tobytes() if whole else sketch(own, s.sketch)
                        held.setdefault(s.number, []).append((node, len(own), labels[i + d], keys, probes, contents))
                        size += len(keys)
                        weight += len(contents) * plan.copies(s.number, len(keys))
                    if size > flush or weight > flush_bytes:
                        yield from out()
                        size = weight = 0
        yield from out()

    session(docs)
    return docs.select("text", "label").mapInArrow(each, _BLOBS)


class Sets:
    """The distinct sets of a part, for bounds on their differences."""

    def __init__(self, sizes: np.ndarray, sketches: np.ndarray):
        self.sizes, self.sketches = sizes.astype(np.int64), sketches

    def __len__(self) -> int:
        return len(self.sizes)

    def accept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs may link: neither sizes nor sketches prove too many differences."""
        most = (self.sizes[a] + self.sizes[b]) // DIFFERENCE
        out = np.abs(self.sizes[a] - self.sizes[b]) <= most
        step = min(50_000, max(1, PAIR_BYTES // max(1, self.sketches.shape[1])))
        for i in range(0, len(a), step):
            at = np.flatnonzero(out[i : i + step]) + i
            out[at] = np.bitwise_count(self.sketches[a[at]] ^ self.sketches[b[at]]).sum(1, dtype=np.int64) <= most[at]
        return out


class WholeSets:
    """The distinct sets of a part with all shingles, for exact verification."""

    def __init__(self, sizes: np.ndarray, shingles_of: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.off = np.concatenate(([0], np.cumsum(self.sizes)))
        distinct, self.codes = np.unique(shingles_of, return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def __len__(self) -> int:
        return len(self.sizes)

    def accept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs link. Pairs of one a are best given together."""
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        out = 100 * small >= 80 * large
        at = np.flatnonzero(out)
        at = at[np.argsort(a[at], kind="stable")]
        for own in np.split(at, np.flatnonzero(np.diff(a[at])) + 1) if len(at) else ():
            x = a[own[0]]
            own_codes = self.codes[self.off[x] : self.off[x + 1]]
            self.mark[own_codes] = True
            for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(self.sizes[b[own]]) // 1_000_000)) + 1):
                n = self.sizes[b[part]]
                first = np.cumsum(n) - n
                codes = self.codes[np.arange(n.sum()) + np.repeat(self.off[b[part]] - first, n)]
                shared = np.add.reduceat(self.mark[codes].astype(np.int64), first)
                out[part] = 100 * shared >= 80 * (len(own_codes) + n - shared)
            self.mark[own_codes] = False
        return out


class Forest:
    """Union-find on arrays; a root is the least member of its tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        out = self.parent[x]
        while not np.array_equal(up := self.parent[out], out):
            out = up
        self.parent[x] = out
        return out

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs joined two trees."""
        took, left = [], np.arange(len(a))
        while len(left):
            x, y = self.roots(a[left]), self.roots(b[left])
            left, x, y = left[x != y], x[x != y], y[x != y]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            self.parent[high] = np.minimum(x, y)[first]
            took.append(left[first])
        return np.concatenate(took) if took else left


class Tried:
    """Pairs that weren't accepted, as far as they fit in ``most`` bytes; what is forgotten is tried again."""

    def __init__(self, n: int, most: int = 32 << 20):
        self.n, self.most, self.rows = n, most, {}

    def left(self, x: int, others: np.ndarray) -> np.ndarray:
        row = self.rows.get(x)
        return others if row is None else others[~row[others]]

    def add(self, x: int, others: np.ndarray) -> None:
        if x not in self.rows:
            if len(self.rows) * self.n > self.most:
                self.rows.clear()
            self.rows[x] = np.zeros(self.n, bool)
        self.rows[x][others] = True


def spanning_links(keys: np.ndarray, probes: np.ndarray, of: np.ndarray, sets: Sets | WholeSets, labels: np.ndarray) -> np.ndarray:
    """A spanning forest of the accepted pairs of sets that share an entry which one of them looks up.

    Sets of equal labels count as connected. In each run of equal entries all are first held against a centre, the one
    that looks up and shares most entries in the part. Where that connects a run it is done; else each
    member outside the run's largest tree meets those of other trees. Pairs are never listed: memory is linear in
    entries and sets.
    """
    n = len(sets)
    forest, out = Forest(n), []
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    forest.join(np.arange(n), first[back])

    def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = sets.accept(a, b)
        a, b = a[ok], b[ok]
        took = forest.join(a, b)
        out.append(np.stack((a[took], b[took]), 1))
        return ok

    order = np.lexsort((of, keys))
    keys, probes, of = keys[order], probes[order], of[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))))
    probes = np.logical_or.reduceat(probes, at) if len(at) else probes
    keys, of = keys[at], of[at]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    length = np.diff(np.append(start, len(keys)))
    looked = np.add.reduceat(probes.astype(np.int64), start) if len(start) else length
    runs = np.flatnonzero((length > 1) & (looked > 0))
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    start, length = start[runs], length[runs]
    begin = np.cumsum(length) - length
    entry = np.arange(length.sum()) - np.repeat(begin, length) + np.repeat(start, length)
    run, member = np.repeat(np.arange(len(runs)), length), of[entry]
    shared = np.bincount(member, length[run], n)
    by_shared = np.argsort(shared, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_shared] = np.arange(1, n + 1)
    center = by_shared[np.maximum.reduceat(np.where(probes[entry], rank[member], 0), begin) - 1]
    pairs = np.unique(center[run] * np.int64(n) + member)
    a, b = pairs // n, pairs % n
    apart = forest.roots(a) != forest.roots(b)
    meet(a[apart], b[apart])

    root = forest.roots(member)
    mixed = np.flatnonzero(np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin))
    tried, done = Tried(n), set()
    for r in mixed:
        part = slice(start[r], start[r] + length[r])
        members, asks = of[part], probes[part]
        trees, sizes = np.unique(forest.roots(members), return_counts=True)
        if len(trees) == 1 or (mark := hash((members.tobytes(), asks.tobytes()))) in done:
            continue
        done.add(mark)
        main = trees[np.argmax(sizes)]
        fresh = np.ones(len(members), bool)
        for i in np.flatnonzero(forest.roots(members) != main):
            x = members[i]
            now = forest.roots(members)
            fresh[i] = False
            others = tried.left(x, members[fresh & (now != now[i]) & (asks | asks[i])])
            if len(others):
                ok = meet(np.full(len(others), x), others)
                tried.add(x, others[~ok])
    return np.concatenate(out)


def links_by_passes(packed: np.ndarray, of: np.ndarray, sets: Sets | WholeSets, labels: np.ndarray, most: int = PASS_ENTRIES) -> np.ndarray:
    """spanning_links of a part's packed entries, by ranges of keys of about ``most`` entries; each pass takes what the ones before connected as connected."""
    passes = min(128, max(1, -(-len(packed) // most)))
    pass_of = ((packed[:, 4] & 127).astype(np.int32) * passes >> 7).astype(np.uint8)  # by the upper 7 bits of keys
    forest, out = Forest(len(sets)), []
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    forest.join(np.arange(len(sets)), first[back])
    for i in range(passes):
        at = np.flatnonzero(pass_of == i)
        entries = np.zeros((len(at), 8), np.uint8)
        entries[:, :5] = packed[at]
        entries = entries.view(np.uint64).ravel()
        out.append(spanning_links(entries & _KEY_MASK, (entries >> _KEY_BITS).astype(bool), of[at].astype(np.int64), sets, forest.roots(np.arange(len(sets)))))
        forest.join(out[-1][:, 0], out[-1][:, 1])
    return np.concatenate(out)


def forests(docs: DataFrame, plan: Plan, whole: bool) -> DataFrame:
    """(a, b): nodes of classes that may link or, with whole, that do; a forest for each part. docs: doc_id, text and, with whole, label (what is connected already)."""
    found = plan.schemes

    def gather(t: pa.Table) -> pa.Table:
        s = found[t.column("scheme")[0].as_py()]
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(name)])
        nodes, counts, sizes, labels = join("nodes", np.int64), join("counts", count_type(s)), join("sizes", count_type(s)).astype(np.int64), join("labels", np.int64)
        distinct, first, back = np.unique(nodes, return_index=True, return_inverse=True)
        if whole:
            contents, off = join("contents", np.uint64), np.cumsum(sizes, dtype=np.int64) - sizes
            n = sizes[first].astype(np.int64)
            sets = WholeSets(n, contents[np.arange(n.sum()) + np.repeat(off[first] - (np.cumsum(n) - n), n)])
        else:
            sets = Sets(sizes[first], join("contents", np.uint8).reshape(len(nodes), s.sketch // 8)[first])
        pairs = links_by_passes(join("entries", np.uint8).reshape(-1, 5), np.repeat(back.astype(np.int32), counts), sets, labels[first] if whole else np.arange(len(distinct)))
        return pa.table({"a": distinct[pairs[:, 0]], "b": distinct[pairs[:, 1]]})

    if not whole:
        docs = docs.withColumn("label", F.lit(0).cast("bigint"))
    return indexed(docs, plan, whole).groupBy("part").applyInArrow(gather, "a bigint, b bigint")


def links_of_buckets(docs: DataFrame, size: int) -> DataFrame:
    """(a, b): a forest of links between the documents of each bucket that labels don't connect already. docs: doc_id, text, label, bucket."""

    def gather(t: pa.Table) -> pa.Table:
        own = [x for _, _, part in k.blocks(k.texts(t.column("text"))) for x in shingles(part, size)]
        ids, labels = t.column("doc_id").to_numpy(), t.column("label").to_numpy()
        sizes = np.array([len(x) for x in own], np.int64)
        plan = Plan(found := schemes(int(sizes.max())), [0] * (len(found) + 1), size)
        of: dict[int, list[int]] = {}
        for i, x in enumerate(own):
            for s in plan.of(len(x)) if len(x) else ():
                of.setdefault(s.number, []).append(i)
        links = np.zeros((0, 2), np.int64)
        for number, members in of.items():
            keys, probes = zip(*(signatures(own[i], found[number]) for i in members), strict=True)
            whole = WholeSets(sizes[members], np.concatenate([own[i] for i in members]))
            new = spanning_links(np.concatenate(keys), np.concatenate(probes), np.repeat(np.arange(len(members)), [len(x) for x in keys]), whole, labels[members])
            links = np.concatenate((links, np.array(members)[new]))
        return pa.table({"a": ids[links[:, 0]], "b": ids[links[:, 1]]})

    return docs.select("doc_id", "text", "label", "bucket").groupBy("bucket").applyInArrow(gather, "a bigint, b bigint")


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles and the hashes of the set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in k.blocks(k.texts(batch.column("text"))):
                sets = shingles(t, size)
                nodes = np.array([node_of(x) for x in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "n_shingles": np.array([len(x) for x in sets], np.int64), "node": nodes[:, 0], "node2": nodes[:, 1]})

    session(docs)
    return ids_and_texts(docs).where("doc_id IS NOT NULL").mapInArrow(each, "doc_id bigint, n_shingles bigint, node bigint, node2 bigint")


def linked(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sets link, by exact intersection. texts: doc_id, text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last = [], (None, None)
            a = [shingles(k.Texts(t.buf, t.off), size) for _, _, t in k.blocks(k.texts(batch.column("text_b")))]
            own = [x for part in a for x in part]
            for i, text in enumerate(batch.column("text_a")):
                text = text.as_py()
                if text != last[0]:
                    last = (text, shingles(k.texts(pa.array([text], pa.string())), size)[0])
                shared = len(np.intersect1d(last[1], own[i], assume_unique=True))
                keep.append(100 * shared >= 80 * (len(last[1]) + len(own[i]) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    session(texts)
    # the pairs go to the texts; only those of a are shuffled, with what is compared with them
    with_b = sent_if_small(pairs).join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    of_a = texts.join(sent_if_small(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id")
    both = with_b.join(of_a.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(each, "a bigint, b bigint").distinct()


def join_components(docs: DataFrame, size: int = 5, part_entries: int = 1_000_000, part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) for each document."""
    session(docs)
    docs = ids_and_texts(docs).where("doc_id IS NOT NULL")
    profile = cut(profiles(docs, size))
    same = ["n_shingles", "node", "node2"]
    classes = cut(profile.where("n_shingles > 0").groupBy(same).agg(F.min("doc_id").alias("rep")), _ROWS)
    reps = classes.select("rep", "node")

    def by_rep(pairs: DataFrame) -> DataFrame:
        out = pairs
        for c in ("a", "b"):
            out = out.join(reps.select(F.col("node").alias(c), F.col("rep").alias(f"rep_{c}")), c)
        return out.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    edges = cut(by_rep(forests(docs, make_plan(profile, size, part_entries, parts_wanted=PARTS), whole=False)).distinct(), _ROWS)
    degree = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    maybe = components(edges)
    # written before the join by component, so that AQE can split a component that holds many of the rows
    pivots = cut(maybe.join(degree, "id").groupBy("component").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot")), _ROWS)
    maybe = cut(maybe.join(pivots, "component").select("id", "pivot"), _ROWS)
    texts = cut(docs.join(sent_if_small(maybe.select(F.col("id").alias("doc_id"))), "doc_id"))  # no text that isn't a candidate's is shuffled
    links = cut(linked(maybe.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")), texts, size), _ROWS)

    labels = maybe.join(components(links).withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = cut(labels.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("pivot"), _ROWS)
    left = cut(labels.join(mixed, "pivot", "left_semi").select(F.col("id").alias("doc_id"), "label", "pivot"), _ROWS)
    if not left.isEmpty():
        weighed = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(left, "doc_id").groupBy("pivot").agg(F.sum("bytes").alias("bytes"))
        weighed = cut(weighed.withColumn("large", F.col("bytes") > part_bytes), _ROWS)
        total = {r["large"]: r["bytes"] for r in weighed.groupBy("large").agg(F.sum("bytes").alias("bytes")).collect()}
        open_ = texts.join(sent_if_small(left.join(weighed.select("pivot", "large"), "pivot")), "doc_id")
        new = []
        if False in total:
            bucket = F.pmod(F.xxhash64("pivot"), F.lit(-(-total[False] // part_bytes)))
            new.append(links_of_buckets(open_.where("NOT large").withColumn("bucket", bucket), size))
        if True in total:
            of = profile.join(open_.where("large").select("doc_id"), "doc_id", "left_semi")
            new.append(by_rep(forests(open_.where("large"), make_plan(of, size, part_entries, 4 * part_bytes), whole=True)))
        links = cut(reduce(DataFrame.unionByName, new, links).distinct(), _ROWS)
    found = components(links).select(F.col("id").alias("rep"), F.col("component").alias("component_id"))
    settled = cut(classes.join(found, "rep", "left").select(*same, F.coalesce("component_id", "rep").alias("component_id")), _ROWS)
    named = profile.join(settled, same, "left")  # a large class is one key; its rows are split by AQE
    return named.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("component_id", "doc_id")).alias("component_id"))
