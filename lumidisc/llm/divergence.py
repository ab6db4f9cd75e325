"""Divergence of the sources of a language: how far apart their words are, and which words set a source apart.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those found in at
least ``least_docs`` of its documents. A group (language and source) gives each kept term the probability
p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)); two of them differ at a term by floor((p - q)^2 / (p + q)).

Group-block tiling. Terms are counted in tasks and summed by (language, source, term); kept terms are dealt into
chunks by hash and numbered there, and a group's counts of a chunk become one packed vector. A language's groups are
dealt into blocks; a tile is a pair of blocks and a span of chunks. Vectors are replicated to the tiles of their
blocks and sorted by chunk, and a tile's task adds up the submatrix of its pairs over one chunk after another, so
it holds two blocks of one chunk. Terms that occur in neither block add one common value each, added at the end.

Blocks grow with the number of groups (4 to 256), so a vector is replicated at most 16 times up to 4,096 groups of a
language; the result has a row for each pair of groups whatever the method. Words of one group, source or document
spread over all tasks. Arithmetic is exact: integers of 64 bits, quotients by long division.

Defined cases: null text, language and source count as empty strings; groups without kept terms have N = 0 and give each
term the same; V = 0 gives pairs of value 0; repeated rows are documents of their own; doc_id is not read;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidisc.llm.common import cut, sent_if_small, session

SCALE = 1_000_000_000
#: Bytes of terms stay, A-Z in lower case; all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Settings(NamedTuple):
    least_docs: int = 10
    top_terms: int = 10
    #: (group, term) entries that a task gathers before it passes them on.
    entries: int = 400_000
    #: Bytes of one text that are split into words at once.
    piece_bytes: int = 1 << 20
    #: Kept (group, term) rows of a chunk, and chunks of a span.
    chunk_rows: int = 20_000
    span: int = 4
    least_block: int = 4
    most_block: int = 256


def words(text: bytes, piece: int) -> Iterator[list[bytes]]:
    """The terms of a text, some MB at a time; no term is cut."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) for every term of every group."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, found = defaultdict(Counter), defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in counts.items():
                n = len(terms)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * n, "source": [source] * n, "term": list(terms), "n": list(terms.values()), "docs": [found[lang, source][t] for t in terms]}, _COUNTS)
            counts.clear()
            found.clear()

        since = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                own: set[bytes] = set()
                for part in words(text, s.piece_bytes):
                    counts[lang, source].update(part)
                    own.update(part)
                found[lang, source].update(own)
                since += len(own)
                if since > s.entries and sum(map(len, counts.values())) > s.entries:
                    yield from out()
                    since = 0
        yield from out()

    session(docs)
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = read.mapInArrow(each, "lang string, source string, term binary, n bigint, docs bigint")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)) without an overflow: three digits of the quotient at a time."""
    below = total + kept * 2
    whole = lambda a, b: F.call_function("div", a, b)
    out, rest = whole(count + 2, below), (count + 2) % below
    for _ in range(3):
        out, rest = out * 1000 + whole(rest * 1000, below), (rest * 1000) % below
    return out + 1


def probabilities(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """The same for arrays."""
    below = np.maximum(total + 2 * kept, 1)
    out, rest = np.divmod(count + 2, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def kept_terms(counts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, term, n, lang_n (the language's occurrences) of terms in enough documents of their language; written."""
    of_term = Window.partitionBy("lang", "term")
    sums = counts.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    return cut(sums.where(F.col("lang_docs") >= s.least_docs).select("lang", "source", "term", "n", "lang_n"))


def groups_of(docs: DataFrame, kept: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, total (N), kept (V), lang_total, own (groups), block, blocks, spans, chunks of every group that occurs; written."""
    all_groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n"), F.count("*").alias("rows")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"), F.sum("rows").alias("rows"))
    sizes = all_groups.groupBy("lang").agg(F.count("*").alias("own")).join(langs, "lang", "left").fillna(0)
    size = F.greatest(F.lit(s.least_block), F.least(F.ceil(F.col("own") / 16), F.lit(s.most_block)))
    sizes = sizes.withColumns({"blocks": F.ceil(F.col("own") / size).cast("int"), "chunks": F.greatest(F.lit(1), F.ceil(F.col("rows") / s.chunk_rows)).cast("int")})
    sizes = sizes.withColumn("spans", F.ceil(F.col("chunks") / s.span).cast("int"))
    found = all_groups.join(totals, ["lang", "source"], "left").fillna(0).join(sizes, "lang")
    return cut(found.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).drop("rows"))


def top_terms(kept: DataFrame, groups: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The terms that a group uses more than its language does, those that set it apart most first."""
    rows = kept.join(sent_if_small(groups.select("lang", "source", "total", "kept", "lang_total")), ["lang", "source"])
    p, q = (probability(F.col(n), F.col(of), F.col("kept")) for n, of in (("n", "total"), ("lang_n", "lang_total")))
    rows = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pack(t: pa.Table) -> pa.Table:
    """The terms of one chunk numbered, and each group's counts as one vector."""
    term = t.column("term").combine_chunks().dictionary_encode()
    at, n = term.indices.to_numpy().astype(np.uint32), t.column("n").to_numpy()
    source = t.column("source").combine_chunks().dictionary_encode()
    of = source.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(source.dictionary)))[:-1]
    pick = lambda v: pa.array([x.tobytes() for x in np.split(v[order], ends)], pa.binary())
    k = len(source.dictionary)
    return pa.table({"lang": [t.column("lang")[0]] * k, "source": source.dictionary, "chunk": [t.column("chunk")[0]] * k, "terms": pa.array([len(term.dictionary)] * k, pa.int32()), "at": pick(at), "n": pick(n)})


_TILE = "lang string, source string, item string, value bigint, seen bigint, common bigint, kept bigint"
_TILE_ROWS = pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c, kind in map(str.split, _TILE.split(", "))])


class Tile:
    """The sums of one tile. Groups are told first, then come vectors, chunk by chunk."""

    def __init__(self, lang: str):
        self.lang, self.side, self.total, self.kept, self.seen, self.chunk = lang, ({}, {}), ([], []), 0, 0, []

    def group(self, source: str, low: bool, high: bool, total: int, kept: int) -> None:
        self.kept = kept
        for mine, side, totals in ((low, self.side[0], self.total[0]), (high, self.side[1], self.total[1])):
            if mine:
                side[source] = len(side)
                totals.append(total)

    def close(self) -> None:
        """Adds the chunk whose vectors have come."""
        if not hasattr(self, "sums"):
            self.sums = np.zeros((len(self.side[0]), len(self.side[1])), np.int64)
            self.totals = [np.array(x, np.int64) for x in self.total]
        if not self.chunk:
            return
        width = self.chunk[0][1]
        used = np.zeros(width, bool)
        for _, _, at, _ in self.chunk:
            used[at] = True
        place = np.cumsum(used) - 1
        p = []
        for side, totals in zip(self.side, self.totals, strict=True):
            dense = np.zeros((len(side), int(used.sum())), np.int64)
            for source, _, at, n in self.chunk:
                if source in side:
                    dense[side[source], place[at]] = n
            p.append(probabilities(dense, totals[:, None], self.kept))
        for i, row in enumerate(p[0]):
            self.sums[i] += apart(row, p[1]).sum(1)
        self.seen += int(used.sum())
        self.chunk = []

    def rows(self) -> pa.RecordBatch:
        self.close()
        p = [probabilities(np.zeros(len(x), np.int64), x, self.kept) for x in self.totals]
        common = apart(p[0][:, None], p[1][None, :]) if self.kept else np.zeros_like(self.sums)
        both = [(a, b, i, j) for a, i in self.side[0].items() for b, j in self.side[1].items() if a != b]
        # the two sides of a tile of one block are the same, else each pair is told both ways
        both += [] if self.side[0].keys() == self.side[1].keys() else [(b, a, i, j) for a, b, i, j in both]
        i, j = (np.array([x[k] for x in both], np.int64) for k in (2, 3))
        n = len(both)
        return pa.RecordBatch.from_pydict({"lang": [self.lang] * n, "source": [x[0] for x in both], "item": [x[1] for x in both], "value": self.sums[i, j], "seen": [self.seen] * n, "common": common[i, j], "kept": [self.kept] * n}, _TILE_ROWS)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, chunk, tile = None, None, None
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["lang"], r["low"], r["high"], r["span"])
            if now != key:
                if tile:
                    yield tile.rows()
                key, tile, chunk = now, Tile(r["lang"]), None
            if r["chunk"] < 0:
                tile.group(r["source"], r["block"] == r["low"], r["block"] == r["high"], r["total"], r["kept"])
                continue
            if r["chunk"] != chunk:
                tile.close()
                chunk = r["chunk"]
            tile.chunk.append((r["source"], r["terms"], np.frombuffer(r["at"], np.uint32), np.frombuffer(r["n"], np.int64)))
    if tile:
        yield tile.rows()


def pairs(kept: DataFrame, groups: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, item (another source of the language), value, for every two groups of a language."""
    small = sent_if_small(groups)
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk")
    rows = kept.join(small.select("lang", "source", "chunks"), ["lang", "source"]).select("lang", "source", "term", "n", chunk)
    packed = rows.groupBy("lang", "chunk").applyInArrow(_pack, "lang string, source string, chunk int, terms int, at binary, n binary")
    vectors = packed.join(small.select("lang", "source", "block", "blocks"), ["lang", "source"]).withColumn("span", (F.col("chunk") / s.span).cast("int"))
    heads = groups.select("*", F.lit(-1).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("spans") - 1)).alias("span"))
    both = vectors.unionByName(heads.select("lang", "source", "chunk", "block", "blocks", "span", "total", "kept"), allowMissingColumns=True)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = both.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    tile = ("lang", "low", "high", "span")
    ordered = dealt.repartition(*tile).sortWithinPartitions(*tile, "chunk", "source")
    sums = ordered.select(*tile, "chunk", "source", "block", "terms", "at", "n", "total", "kept").mapInArrow(_tiles, _TILE)
    value = F.sum("value") + (F.max("kept") - F.sum("seen")) * F.max("common")
    return sums.groupBy("lang", "source", "item").agg(value.alias("value"))


def audit(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    session(docs)
    kept = kept_terms(term_counts(docs, s), s)
    groups = groups_of(docs, kept, s)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs(kept, groups, s).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pair.unionByName(top_terms(kept, groups, s))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM words GROUP BY ALL),
terms AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM terms GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, sum(c.n) AS total FROM counts c JOIN terms USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(m.total, 0) + 2 * l.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (t.n + 2)) // (l.total + 2 * l.v)::HUGEINT AS q
    FROM groups g JOIN langs l USING (lang) JOIN terms t USING (lang) LEFT JOIN totals m USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
