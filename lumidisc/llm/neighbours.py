"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The upper tree is fitted on the driver on a bounded sample and broadcast (its size is bounded by the sample's): nodes
are split by spherical k-means until a leaf, called a cell, holds few sample rows, so cells have about equal
numbers of rows, dense regions included. Every row is put into its cell; cells that would outgrow ``block_rows`` are
dealt over blocks by hash. A block's task fits the lower tree on the block's own rows. Both trees are traversed best bin first:
a priority queue holds the branches not taken yet, by the cosine of their centres, and a query takes the best
again and again until it has visited its share of leaves.

How many leaves that is, is calibrated: for up to ``calibration`` queries the nearest rows of the whole table are
found by brute force (one pass with a bounded number of queries), and visits to cells are widened until the cells
hold ``cell_recall`` of them. In a block, visits are widened until its own queries (a sample of them) find
``leaf_recall`` of the block's nearest rows. What leaves hold is scored by exact cosines in double precision.

Equal vectors are one point: it enters the tree once, a query of it is searched once, and its rows come back at the
end. Of a point the smallest k + 1 ids are enough, as ties go to smaller ids and one of them may be the query's own.
So neither a frequent vector nor its queries gather in one task, and the result is what all rows give.

Defined cases: null ids, vectors that are null, empty, zero or hold nulls or non-finite components take no part; shorter vectors count as if
followed by zeros; rows that share an id are one row, the one whose vector has the smaller hash; with fewer
candidates than k all are returned; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidisc.llm.common import cut, sent_if_small, session


class Settings(NamedTuple):
    k: int = 5
    #: The sample that the upper tree is fitted on: rows, and bytes in double precision.
    sample_rows: int = 32_768
    sample_bytes: int = 64 << 20
    #: Rows of a cell as far as the sample allows that many cells; a leaf of the upper tree holds at least so many sample rows.
    cell_rows: int = 512
    least_sample: int = 16
    #: Rows of one task.
    block_rows: int = 8_192
    branches: int = 8
    #: Rows of a leaf of the lower tree.
    leaf_rows: int = 32
    rounds: int = 6
    calibration: int = 256
    cell_recall: float = 0.98
    leaf_recall: float = 0.98


# -- trees ------------------------------------------------------------------------------------------------------------


class Tree(NamedTuple):
    """centres: unit vectors of all nodes; children: of each node, none for leaves; leaf: a leaf's number or -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, by the largest component first, so that nothing overflows."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def grow(x: np.ndarray, most: int, s: Settings) -> tuple[Tree, np.ndarray]:
    """A tree over unit vectors whose leaves hold up to ``most`` of them, and the leaf of each. The same rows in the same order give the same tree."""
    centres, children, leaf, place = [unit(x.mean(0, keepdims=True))[0] if len(x) else np.zeros(x.shape[1])], [[]], [-1], np.zeros(len(x), np.int64)
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        label = split(x[rows], min(s.branches, -(-len(rows) // most)), s.rounds) if len(rows) > most else np.zeros(0, np.int64)
        if not len(label) or label.max() == 0:
            leaf[node], place[rows], leaves = leaves, leaves, leaves + 1
            continue
        for c in range(label.max() + 1):
            own = rows[label == c]
            children[node].append(len(centres))
            todo.append((len(centres), own))
            centres.append(unit(x[own].mean(0, keepdims=True))[0])
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), [np.array(c, np.int64) for c in children], np.array(leaf), leaves), place


def split(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from rows far apart; labels from 0, without gaps. All 0 if the rows are alike."""
    far = x @ x[0]
    first = [int(far.argmin())]
    near = x @ x[first[0]]
    for _ in range(k - 1):
        first.append(int(near.argmin()))
        near = np.maximum(near, x @ x[first[-1]])
    centres, label = x[first], np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres = np.where(np.bincount(label, minlength=k)[:, None] > 0, unit(sums), centres)
    return np.unique((x @ centres.T).argmax(1), return_inverse=True)[1]


def descend(t: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into: the best child at every node."""
    at = np.zeros(len(x), np.int64)
    while len(inner := np.flatnonzero(t.leaf[at] < 0)):
        for node in np.unique(at[inner]):
            own = inner[at[inner] == node]
            c = t.children[node]
            at[own] = c[(x[own] @ t.centres[c].T).argmax(1)]
    return t.leaf[at]


def best_bins(t: Tree, near: np.ndarray) -> Iterator[int]:
    """Leaves, best bin first. near: the query's cosines with all nodes' centres."""
    queue = [(0.0, 0)]
    while queue:
        _, node = heapq.heappop(queue)
        while t.leaf[node] < 0:
            c = t.children[node]
            order = c[np.argsort(-near[c], kind="stable")]
            for other in order[1:]:
                heapq.heappush(queue, (-near[other], int(other)))
            node = int(order[0])
        yield int(t.leaf[node])


def visits(t: Tree, queries: np.ndarray, most: int) -> np.ndarray:
    """The first leaves of each query, a row each; -1 where there are fewer."""
    out = np.full((len(queries), min(most, t.leaves)), -1, np.int64)
    for i, near in enumerate(queries @ t.centres.T):
        for j, leaf in zip(range(out.shape[1]), best_bins(t, near), strict=False):
            out[i, j] = leaf
    return out


def ranks(order: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """When each query (a row of order) visits each of its leaves (a row of leaves), from 0."""
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    return np.take_along_axis(place, leaves, 1)


def widen(rank: np.ndarray, leaves: int, recall: float) -> int:
    """Visits that find such a share of the neighbours with these ranks: widened by a quarter at a time."""
    n = 1
    while n < leaves and len(rank) and (rank < n).mean() < recall:
        n = min(leaves, n + max(1, n // 4))
    return n


# -- vectors ----------------------------------------------------------------------------------------------------------


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of numbers as rows, shorter ones followed by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same rows give the same number wherever they stand. Rows are scaled by powers of two, which changes no digit."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True, initial=0))[1]) for v in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def nearest(x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of each query's k nearest rows, ties to smaller ids: a shortlist by one product, then exact cosines. All rows are given."""
    found = ([], [], [])
    ux, uq = unit(x), unit(q)
    for i in range(0, len(q), 256):
        near = uq[i : i + 256] @ ux.T
        least = np.partition(near, near.shape[1] - k, 1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(near), -2.0)
        at, row = np.nonzero(near >= least[:, None] - 1e-9)
        best = _best(at, row, cosines(q[i + at], x[row]), ids, k)
        for out, v in zip(found, (best[0] + i, *best[1:]), strict=True):
            out.append(v)
    return tuple(np.concatenate([*v, np.zeros(0, kind)]) for v, kind in zip(found, (np.int64, np.int64, float), strict=True))


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], row[place < k], score[place < k]


def usable(vector: Column) -> Column:
    """Not null, with finite components, one of which isn't zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(wide, lambda x: x != 0)


_KEY = ["k1", "k2"]


def rows_of(table: DataFrame) -> DataFrame:
    """vec_id, vector, k1, k2 (a hash of 128 bits) of rows that take part; one row for each id."""
    read = table.select("vec_id", F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # zeros at the end don't count, so vectors are equal whatever their lengths
    last = F.array_max(F.transform("vector", lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    read = read.withColumn("vector", F.slice("vector", F.lit(1), last))
    read = read.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})
    of_id = read.groupBy("vec_id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).where("low <> high")
    clashes = sent_if_small(of_id.select("vec_id", "low"))  # ids that come with several vectors
    return read.join(clashes, "vec_id", "left").where(F.col("low").isNull() | (F.struct("k1", "k2") == F.col("low"))).drop("low")


def members_of(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each point, found in salted groups first."""

    def few(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")

    ids = rows.select("vec_id", *_KEY).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    # repeated rows are one; of the salted groups their ids have one each
    return few(few(ids.distinct(), *_KEY, "salt"), *_KEY).drop("salt")


# -- search -----------------------------------------------------------------------------------------------------------

_FOUND = "q1 bigint, q2 bigint, k1 bigint, k2 bigint, vec_id bigint, score double"
_FOUND_ROWS = pa.schema([(c, pa.float64() if kind == "double" else pa.int64()) for c, kind in map(str.split, _FOUND.split(", "))])


def _found(queries: pa.Table, rows: pa.Table, best: tuple) -> pa.Table:
    at, row, score = (pa.array(x) for x in best)
    q, r = queries.select(_KEY).take(at), rows.select([*_KEY, "vec_id"]).take(row)
    return pa.table({"q1": q.column("k1"), "q2": q.column("k2"), "k1": r.column("k1"), "k2": r.column("k2"), "vec_id": r.column("vec_id"), "score": score}, schema=_FOUND_ROWS)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query."""
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search_block(rows: pa.Table, queries: pa.Table, dim: int, k: int, s: Settings) -> pa.Table:
    """The nearest rows of a block as far as calibrated visits to its leaves find them."""
    if not rows.num_rows or not queries.num_rows:
        return _FOUND_ROWS.empty_table()
    rows, queries = rows.sort_by([("k1", "ascending"), ("k2", "ascending")]), queries.sort_by([("k1", "ascending"), ("k2", "ascending")])
    x, q, ids = matrix(rows.column("vector"), dim), matrix(queries.column("vector"), dim), rows.column("vec_id").to_numpy()
    ux, uq = unit(x), unit(q)
    tree, place = grow(ux, s.leaf_rows, s)
    some = np.arange(0, len(q), -(-len(q) // 64))  # keys are hashes: evenly spaced ones are a sample
    order = visits(tree, uq[some], tree.leaves)
    at, row, _ = nearest(x, q[some], ids, k)
    n = widen(ranks(order, place[row].reshape(len(some), -1)).ravel(), tree.leaves, s.leaf_recall)
    order = visits(tree, uq, n)
    by_leaf, leaf_rows = order.ravel().argsort(kind="stable"), place.argsort(kind="stable")
    ends, row_ends = (np.searchsorted(np.sort(v.ravel()), np.arange(tree.leaves + 1)) for v in (order, place))
    found = ([], [], [])
    for leaf in np.flatnonzero(np.diff(ends)):
        own, asked = leaf_rows[row_ends[leaf] : row_ends[leaf + 1]], by_leaf[ends[leaf] : ends[leaf + 1]] // order.shape[1]
        near = uq[asked] @ ux[own].T
        least = np.partition(near, len(own) - k, 1)[:, len(own) - k] if len(own) > k else np.full(len(asked), -2.0)
        a, b = np.nonzero(near >= least[:, None] - 1e-9)
        for out, v in zip(found, (asked[a], own[b], near[a, b]), strict=True):
            out.append(v)
    at, row, near = (np.concatenate(v) for v in found)
    order = np.lexsort((-near, at))
    at, row, near = at[order], row[order], near[order]
    kth = near[np.minimum(np.searchsorted(at, at) + k, np.searchsorted(at, at, "right")) - 1]
    close = near >= kth - 1e-9
    at, row = at[close], row[close]
    return _found(queries, rows, _best(at, row, cosines(q[at], x[row]), ids, k))


class Plan(NamedTuple):
    tree: Tree
    blocks: np.ndarray
    visits: int
    dim: int


def plan(points: DataFrame, asked: DataFrame, s: Settings) -> Plan:
    """The upper tree, the blocks of its cells, and how many cells a query visits."""
    spark = points.sparkSession
    n, dim = points.agg(F.count("*"), F.max(F.size("vector"))).first()
    dim = dim or 1
    most = max(1_000, min(s.sample_rows, s.sample_bytes // (8 * dim)))
    share = 1.1 * most / max(n, 1)
    chosen = points.where((F.col("k1").cast("double") / 2.0**64 + 0.5) <= share).select(*_KEY, "vector").toArrow()  # keys differ, and are hashes
    sample = unit(matrix(chosen.sort_by([("k1", "ascending"), ("k2", "ascending")]).column("vector"), dim))
    tree, place = grow(sample, max(s.least_sample, -(-len(sample) * s.cell_rows // max(n, 1))), s)
    size = np.bincount(place, minlength=tree.leaves) * (n / max(len(sample), 1))
    blocks = np.maximum(1, np.ceil(size / s.block_rows)).astype(np.int64)
    trial = asked.orderBy(*_KEY).limit(s.calibration).toArrow()
    if not trial.num_rows or tree.leaves == 1:
        return Plan(tree, blocks, 1, dim)
    sent = spark.sparkContext.broadcast(trial)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = matrix(sent.value.column("vector"), dim)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"), dim)
                yield _found(sent.value, pa.Table.from_batches([batch]), nearest(x, q, batch.column("vec_id").to_numpy(), s.k + 1)).combine_chunks().to_batches()[0]

    best = top(points.mapInArrow(each, _FOUND), s.k + 1).select("q1", "q2", "k1", "k2").join(points.select(*_KEY, "vector"), _KEY).toArrow()
    q = unit(matrix(trial.column("vector"), dim))
    number = {key: i for i, key in enumerate(zip(*(trial.column(c).to_pylist() for c in _KEY), strict=True))}
    order = visits(tree, q, tree.leaves)
    of = np.array([number[key] for key in zip(best.column("q1").to_pylist(), best.column("q2").to_pylist(), strict=True)])
    rank = ranks(order[of], descend(tree, unit(matrix(best.column("vector"), dim)))[:, None]).ravel()
    return Plan(tree, blocks, widen(rank, tree.leaves, s.cell_recall), dim)


def search(table: DataFrame, query: Column, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows of every row for which ``query`` (a condition on vec_id) holds. table: vec_id, embedding."""
    spark = session(table)
    rows = rows_of(table)
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    point = rows.groupBy(*_KEY).agg(F.min("vec_id").alias("vec_id"), F.max(query.cast("int")).alias("asked"), F.first("vector").cast(kind).alias("vector"))
    points = cut(point)
    asked = points.where("asked = 1").select(*_KEY, "vector")
    p = plan(points, asked, s)
    sent = spark.sparkContext.broadcast(p)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = descend(sent.value.tree, unit(matrix(batch.column("vector"), p_dim)))
                block = batch.column("k2").to_numpy() % sent.value.blocks[cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(block)], [*batch.schema.names, "cell", "block"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = visits(sent.value.tree, unit(matrix(batch.column("vector"), p_dim)), sent.value.visits)
                own = np.repeat(np.arange(len(cells)), cells.shape[1])[cells.ravel() >= 0]
                cell = cells[cells >= 0]
                n = sent.value.blocks[cell]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for i in range(0, len(block), 4_000):
                    part = slice(i, i + 4_000)
                    taken = batch.take(pa.array(np.repeat(own, n)[part]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.repeat(cell, n)[part]), pa.array(block[part])], [*batch.schema.names, "cell", "block"])

    p_dim, k = p.dim, s.k + 1
    placed = points.select(*_KEY, "vec_id", "vector").mapInArrow(put, f"k1 bigint, k2 bigint, vec_id bigint, vector {kind}, cell bigint, block bigint")
    routed = asked.mapInArrow(ask, f"k1 bigint, k2 bigint, vector {kind}, cell bigint, block bigint")
    by = ("cell", "block")
    found = placed.groupBy(*by).cogroup(routed.groupBy(*by)).applyInArrow(lambda x, q: search_block(x, q, p_dim, k, s), _FOUND)
    # points to rows: the k + 1 smallest ids of each, and for each query those that aren't its own
    near = top(found, k).drop("place", "vec_id").join(members_of(rows, s.k), _KEY)
    best = near.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))), 1, k).alias("best"))
    queries = rows.where(query).select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).distinct()
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, s.k)
    out = queries.join(best, ["q1", "q2"]).select("query_id", F.posexplode(own).alias("rank", "x"))
    return out.select(F.col("query_id").cast("long").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").cast("long").alias("vec_id"), F.col("x.score").alias("score"))
