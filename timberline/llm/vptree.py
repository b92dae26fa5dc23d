"""Nearest neighbours by vantage-point trees, one per shard, with triangle-inequality pruning.

The top of one tree is built over a sample of SAMPLE vectors at most, taken by a hash of their ids; its leaves are regions, and every row
goes to the one that its distances to the vantage points lead to. A region with more than SHARD rows, by its share of the sample, is dealt to
several shards by a hash of the id. A query first learns the distance of its k-th neighbour in the sample, which bounds the true one;
it goes to those regions only that the triangle inequality doesn't exclude by that bound. Each shard builds its tree
once, over its different vectors, and the queries stream past it in batches: at a node the distances to the vantage point tell for every
query which child to visit first, and whether the other child can still hold a nearer vector. ``factor`` relaxes these tests: a
region or child is left out if ``factor`` times its lower bound exceeds the bound on the query's k-th distance, so 1 is exact and more
prunes more. The shards' lists of k are merged for each query. Equal vectors of a shard are one point with all their ids, of which the smallest
count; so one vector in a third of all rows costs one point for each shard.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components, and rows with null ids, take no part. A
vector is compared with vectors of its own length only. Of repeated rows with one id the shortest, then smallest vector counts. Ties go to the
smaller id. Extra columns are ignored; no query or no candidate gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix

#: Vectors of a shard on average, points of a leaf, vectors of the sample that the top of the tree is built over, regions at most.
SHARD, LEAF, SAMPLE, REGIONS = 8192, 64, 8192, 512
_SLACK = 1e-9


@dataclass
class _Node:
    points: np.ndarray | None = None
    vantage: int = -1
    radius: float = 0.0
    near: _Node | None = None
    far: _Node | None = None


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows, summed in one order whatever the block is."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        t = a[:, k, None] - b[None, :, k]
        out += t * t
    return np.sqrt(out)


def build(points: np.ndarray, members: np.ndarray, leaf: int = LEAF) -> _Node:
    """A tree over the rows ``members`` of ``points``; the vantage point is the one farthest from the first."""
    if len(members) <= leaf:
        return _Node(points=members)
    head = _distances(points[members[:1]], points[members])[0]
    v = members[int(np.argmax(head))]
    rest = members[members != v]
    d = _distances(points[v : v + 1], points[rest])[0]
    radius = float(np.median(d))
    inside = d <= radius
    if inside.all():
        inside = d < radius
        if not inside.any():
            return _Node(points=members)
    return _Node(None, int(v), radius, build(points, rest[inside], leaf), build(points, rest[~inside], leaf))


class _Search:
    def __init__(self, points: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, most: np.ndarray):
        self.most = most
        self.points, self.ids, self.queries, self.query_ids, self.k, self.factor = points, ids, queries, query_ids, k, factor
        self.far = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.measured = 0

    def offer(self, q: np.ndarray, d: np.ndarray, members: np.ndarray) -> None:
        """Distances ``d`` (queries x members) come into the lists."""
        live = (d <= np.minimum(self.far[q, -1], self.most[q])[:, None]).any(axis=1)
        q, d = q[live], d[live]
        if not len(q):
            return
        column = np.repeat(np.arange(len(members)), [min(len(self.ids[m]), self.k + 1) for m in members])
        who = np.concatenate([self.ids[m][: self.k + 1] for m in members])
        d = d[:, column]
        d = np.where(who[None, :] == self.query_ids[q, None], np.inf, d)
        all_d, all_w = np.hstack([self.far[q], d]), np.hstack([self.who[q], np.where(np.isinf(d), np.iinfo(np.int64).max, who[None, :])])
        order = np.lexsort((all_w, all_d), axis=1)[:, : self.k]
        self.far[q], self.who[q] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_w, order, 1)

    def visit(self, node: _Node | None, q: np.ndarray) -> None:
        if node is None or not len(q):
            return
        if node.points is not None:
            if len(node.points):
                self.measured += len(q) * len(node.points)
                self.offer(q, _distances(self.queries[q], self.points[node.points]), node.points)
            return
        d = _distances(self.queries[q], self.points[node.vantage : node.vantage + 1])
        self.measured += len(q)
        self.offer(q, d, np.array([node.vantage]))
        d = d[:, 0]
        first = d <= node.radius
        self.visit(node.near, q[first])
        self.visit(node.far, q[~first])
        bound = np.abs(d - node.radius)
        again = self.factor * bound * (1 - _SLACK) <= np.minimum(self.far[q, -1], self.most[q])
        self.visit(node.far, q[first & again])
        self.visit(node.near, q[~first & again])


class Shard:
    """The tree over a shard's vectors."""

    def __init__(self, vectors: np.ndarray, vec_ids: np.ndarray):
        order = np.lexsort((*vectors.T[::-1], vec_ids))
        vec_ids, vectors = vec_ids[order], vectors[order]
        lead = np.ones(len(vec_ids), bool)
        lead[1:] = vec_ids[1:] != vec_ids[:-1]
        vec_ids, vectors = vec_ids[lead], vectors[lead]
        self.points, inverse = np.unique(vectors, axis=0, return_inverse=True)
        by = np.argsort(inverse.ravel(), kind="stable")
        self.ids = np.split(vec_ids[by], np.cumsum(np.bincount(inverse.ravel(), minlength=len(self.points)))[:-1])
        self.root = build(self.points, np.arange(len(self.points)))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Distances and ids (queries x k; inf where there are fewer) and how many distances were measured. Vectors farther
        than ``most`` may be left out."""
        found = _Search(self.points, self.ids, queries, query_ids, k, factor, np.full(len(queries), np.inf) if most is None else most)
        found.visit(self.root, np.arange(len(queries)))
        return found.far, found.who, found.measured


def search(vectors: np.ndarray, vec_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
    return Shard(vectors, vec_ids).search(queries, query_ids, k, factor)


@dataclass
class Regions:
    """The top of the tree over the sampled ``points`` (with ``ids``); shards: of each region, ``least`` at least."""

    points: np.ndarray
    ids: np.ndarray
    rows: int
    shard: int = SHARD
    root: _Node = field(default_factory=_Node)
    shards: list[int] = field(default_factory=list)

    def __post_init__(self):
        n = len(self.points)
        wanted = min(REGIONS, max(1, -(-self.rows // self.shard)))
        self.root = build(self.points, np.arange(n), max(1, -(-n // wanted)))
        self._number(self.root, n)

    def _number(self, node: _Node, n: int) -> None:
        if node.points is not None:
            share = max(1, len(node.points)) / max(1, n) * self.rows
            node.vantage, node.points = len(self.shards), node.points[:0]
            self.shards.append(max(1, int(-(-share // self.shard))))
            return
        self._number(node.near, n)
        self._number(node.far, n)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        out = np.zeros(len(vectors), np.int32)
        stack = [(self.root, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if node.points is not None:
                out[rows] = node.vantage
            elif len(rows):
                near = _distances(vectors[rows], self.points[node.vantage : node.vantage + 1])[:, 0] <= node.radius
                stack += [(node.near, rows[near]), (node.far, rows[~near])]
        return out

    def kth(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> np.ndarray:
        """The distance of each query's k-th neighbour in the sample, which no k-th neighbour is farther than."""
        out = np.full(len(queries), np.inf)
        if len(np.unique(self.ids)) > k:
            for i in range(0, len(queries), 64):
                d = _distances(queries[i : i + 64], self.points)
                d[query_ids[i : i + 64, None] == self.ids[None, :]] = np.inf
                out[i : i + 64] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return out

    def visits(self, queries: np.ndarray, most: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, region) of the regions that may hold one of a query's neighbours."""
        which, where = [], []
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, rows, low = stack.pop()
            live = factor * low * (1 - _SLACK) <= most[rows]
            rows, low = rows[live], low[live]
            if node.points is not None:
                which.append(rows)
                where.append(np.full(len(rows), node.vantage))
            elif len(rows):
                d = _distances(queries[rows], self.points[node.vantage : node.vantage + 1])[:, 0]
                stack += [(node.near, rows, np.maximum(low, d - node.radius)), (node.far, rows, np.maximum(low, node.radius - d))]
        return np.concatenate(which), np.concatenate(where)


def _usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _matrix(b: pa.RecordBatch, name: str = "v") -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = b.column("dims").to_numpy()
    for d in np.unique(dims):
        yield int(d), b.take(pa.array(np.flatnonzero(dims == d)))


_ROUTED = "dims int, region int, shard int, asks boolean, id long, most double, v array<double>"


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))


def route(own: DataFrame, regions: dict[int, Regions], k: int, factor: float) -> DataFrame:
    """Rows of _ROUTED: each vector of ``own`` (dims, vec_id, v, q) in its shard, each query in all shards it has to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_length(b):
                top, m, ids = regions[d], _matrix(part), part.column("vec_id").to_numpy()
                shards = np.array(top.shards)
                place = top.place(m)
                yield _routed(d, place, mix(ids.view(np.uint64)) % shards[place].astype(np.uint64), False, ids, np.zeros(len(ids)), m)
                asks = np.flatnonzero(part.column("q").to_numpy(zero_copy_only=False))
                if len(asks):
                    most = top.kth(m[asks], ids[asks], k)
                    which, where = top.visits(m[asks], most, factor)
                    many = shards[where]
                    which, where = np.repeat(which, many), np.repeat(where, many)
                    shard = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
                    for i in range(0, len(which), 4096):
                        w = which[i : i + 4096]
                        yield _routed(d, where[i : i + 4096], shard[i : i + 4096], True, ids[asks][w], most[w], m[asks][w])

    return own.select("dims", "vec_id", "v", "q").mapInArrow(run, _ROUTED)


def _routed(d: int, region, shard, asks: bool, ids, most, m: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    columns = [np.full(n, d, np.int32), np.asarray(region).astype(np.int32), np.asarray(shard).astype(np.int32), np.full(n, asks), ids, most]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), _lists(m)], names=["dims", "region", "shard", "asks", "id", "most", "v"])


def _answers(k: int, factor: float):
    """Of rows in order of shard, vectors before queries: each query's list of k from the shard. A shard's vectors and one
    batch of queries are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, tree = None, [], [], None
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dims", "region", "shard", "asks")])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part, shard = b.slice(lo, hi - lo), tuple(keys[lo, :3])
                if shard != now:
                    now, held, ids, tree = shard, [], [], None
                if not keys[lo, 3]:
                    held.append(_matrix(part))
                    ids.append(part.column("id").to_numpy())
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree, held = Shard(np.concatenate(held), np.concatenate(ids)), []
                who = part.column("id").to_numpy()
                far, found, _ = tree.search(_matrix(part), who, k, factor, part.column("most").to_numpy() * (1 + _SLACK))
                real = np.isfinite(far)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who, k)[real.ravel()]), pa.array(far[real]), pa.array(found[real])], names=["query_id", "score", "vec_id"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of ``vectors`` (vec_id, embedding) to each row where ``is_query``."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    own = own.filter(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumn("dims", F.size("v"))
    rows, different = own.agg(F.count("*"), F.count_distinct("vec_id")).first()
    if rows != different:
        own = own.groupBy("vec_id").agg(F.min(F.struct("dims", "v", "q")).alias("r")).select("vec_id", "r.*")
    counts = {r["dims"]: r["count"] for r in own.groupBy("dims").count().collect()}  # one row for each length of vectors
    sample: dict[int, list] = {d: [] for d in counts}
    for r in own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dims", "vec_id", "v").collect():
        sample[r["dims"]].append((r["vec_id"], r["v"]))
    regions = {d: Regions(np.array([v for _, v in sample[d]], float).reshape(-1, d), np.array([i for i, _ in sample[d]], np.int64), counts[d], shard) for d in counts}
    keys = ["dims", "region", "shard"]
    routed = route(own, regions, k, factor).repartition(*keys).sortWithinPartitions(*keys, "asks")
    found = routed.mapInArrow(_answers(k, factor), "query_id long, score double, vec_id long")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    """The columns of ``op2``: query_id, rank, vec_id, score."""
    return nearest(vectors, F.col("vec_id") % 100 == 0)
