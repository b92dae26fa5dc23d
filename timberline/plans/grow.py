"""Growth of all trees of a forest over wide rows that stay where they are.

A row is written once, with its features, what it adds to the target's statistics, and the trees that drew it. On a level each task
sends its rows down the trees' tops (the nodes split so far, a broadcast of their few columns) and adds them to histograms of the drawn
features, one row for each node, feature and value; these are merged by key, and the best cut of each node is found on them. Nothing of
a case is shuffled for that. A node whose cases fit ``local_bytes`` is finished instead: its cases come together in one task, packed by
column. Both ways use the same rules, so where a node is finished changes no tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.engine import NumpyOps
from ..functions.ranks import ranked
from ..functions.rng import hash_numbers, hashed
from ..operators import splits
from ..operators.sample import Bag, per_case
from ..operators.targets import OfCases, Target
from ..session import by_case, cut, plain_planning
from . import cases, local
from .scoring import WIDE

KEYS = ["tree", "path", "feature"]
#: Partitions over which the nodes to finish are spread, where the session doesn't ask for more.
MOST_PARTITIONS = 4096


@dataclass(frozen=True)
class Growth:
    """How trees grow.

    ``random_cuts``: one hashed cut of a numeric feature instead of its best one. ``unseen``: a feature's cut is found on
    the bag and measured on all cases that the tree's bag lacks. ``vet``: the best decrease that a feature reaches on
    targets permuted inside the node is taken off its own (found on the bag, with ``unseen`` too). ``force``: features without
    any cut don't count among the ``m_try`` that a node draws. ``bins``: different values of a numeric feature at most. ``local_bytes``: what the
    cases of a node take that one task finishes.
    """

    leaf: int = 1
    max_depth: int = 0
    m_try: int | None = None
    seed: int = 1
    split_missing: bool = False
    strict_right: bool = True
    bins: int | None = None
    random_cuts: bool = False
    unseen: bool = False
    vet: bool = False
    force: bool = False
    local_bytes: int = 512_000_000


RESULT = "tree int, path string, feature string, threshold double, left array<string>, pred string, weight double, n long, impurity double, decrease double"
_GROWN = "tree int, path string, feature string, threshold double, left array<string>, pred double, n double, impurity double, decrease double"


def row_stats(target: Target) -> dict[str, str]:
    """SQL of what one row (w: its multiplicity) adds to each statistic."""
    return {k: e.removeprefix("sum(").removesuffix(")") for k, e in target.stats().items()}


def row_bytes(features: int, stats: int) -> int:
    """What a case takes at most in the task that finishes its node: values and places of features, and one feature's histogram, whose cells
    may be as many as the cases."""
    return 12 * features + 16 * stats + 160


def _records(nodes: list[tuple]) -> pa.RecordBatch:
    """Rows of _GROWN from (tree, path, feature, threshold, left, pred, n, impurity, decrease)."""
    columns = list(zip(*nodes, strict=True)) if nodes else [()] * 9
    kinds = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.float64(), pa.float64(), pa.float64(), pa.float64())
    names = ["tree", "path", "feature", "threshold", "left", "pred", "n", "impurity", "decrease"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _result(grown: DataFrame, target: Target) -> DataFrame:
    pred = F.col("pred").cast("int") if hasattr(target, "classes") else F.col("pred")
    return grown.select("tree", "path", "feature", "threshold", "left", pred.cast("string").alias("pred"), F.lit(1.0).alias("weight"), F.col("n").cast("long").alias("n"), "impurity", "decrease")


def _edges(wide: DataFrame, numeric: Sequence[str], bins: int) -> dict[str, list[float]]:
    """The upper edges of each feature's quantile bins, ``bins`` numbers at most."""
    shares = [i / bins for i in range(1, bins + 1)]
    row = wide.agg(*[F.percentile_approx(F.expr(f"nullif(cast(`{c}` as double), double('NaN'))"), shares, 10 * bins).alias(f"e{i}") for i, c in enumerate(numeric)]).first()
    return {c: sorted(set(row[f"e{i}"] or ())) for i, c in enumerate(numeric)}


class _Growing:
    """A forest on its way: the base rows, the tops of the trees, and the passes over them."""

    def __init__(self, wide: DataFrame, known: DataFrame, bag: Bag, n_trees: int, target: Target, whole: Target, numeric: Sequence[str], categorical: Sequence[str], how: Growth, first: int):
        """``target`` splits the tops, ``whole`` the nodes that one task finishes."""
        self.spark, self.target, self.whole, self.how, self.first = wide.sparkSession, target, whole, how, first
        self.numeric, self.categorical, self.names = list(numeric), list(categorical), [*numeric, *categorical]
        self.known, self.gain = known, local.Gain(target)
        added = [*row_stats(target).values(), *(row_stats(whole).values() if whole is not target else ())]
        self.n_stats, self.n_all, self.n_trees = len(target.stats()), len(added), n_trees
        self.n_cases = known.count()
        self.edges = _edges(wide, numeric, how.bins) if how.bins and numeric else {}
        self.features = wide.select("case_id", *self._features())
        self.few: list[str] = []
        if categorical:  # one number for each feature
            counts = wide.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(categorical)]).first()
            self.few = [c for i, c in enumerate(categorical) if counts[f"n{i}"] <= splits.EXHAUSTIVE]
        stats = [F.expr(e).cast("double").alias(f"_s{i}") for i, e in enumerate(added)]
        own = bag.of_case(n_trees, first) if hasattr(bag, "of_case") else None
        bags = [own.alias("bag")] if own is not None else []
        rows = known.withColumn("w", F.lit(1))
        if WIDE in known.columns:
            rows = rows.select("case_id", *stats, *self._features(lambda c: F.col(WIDE).getField(c)), *bags)
        else:
            rows = rows.select("case_id", *stats, *bags).join(by_case(self.features), "case_id")
        # with ``unseen`` the rows that no tree drew count too
        if not bags:
            rows = rows.join(by_case(per_case(bag, known, n_trees, first)), "case_id", "left" if how.unseen else "inner")
        elif not how.unseen:
            rows = rows.filter(F.size("bag") > 0)
        self.base = cut(rows.withColumn("bag", F.coalesce("bag", F.array().cast("array<struct<tree:int,mult:long>>"))))
        self.top = cases.Top()
        self.open = [self.top.add(first + t, "*") for t in range(n_trees)]
        self.done: list[tuple] = []
        self.ends: list[int] = []
        self.row_bytes = row_bytes(len(self.names), self.n_all)

    def _features(self, of=lambda c: F.col(f"`{c}`")) -> list:
        out = []
        for i, c in enumerate(self.numeric):
            x = of(c).cast("double")  # a batch takes NaN for missing; more work here makes a method too long to be compiled
            if edges := self.edges.get(c):
                x = F.nanvl(x, F.lit(None).cast("double"))
                near = F.try_element_at(F.filter(F.array(*map(F.lit, edges)), lambda e, x=x: e >= x), F.lit(1))
                x = F.when(x.isNotNull(), F.coalesce(near, x))
            out.append(x.alias(f"_x{i}"))
        return out + [of(c).cast("string").alias(f"_c{i}") for i, c in enumerate(self.categorical)]

    def _over(self, rows: DataFrame, body, schema: str, own: slice | None = None) -> DataFrame:
        """``body`` (of a Batch, which has the statistics ``own``) over all batches of ``rows``."""
        numeric, categorical, own = len(self.numeric), len(self.categorical), own or slice(0, self.n_stats)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from body(cases.batch(b, numeric, categorical, own))

        return rows.mapInArrow(run, schema)

    def _share(self, *x):
        return self.spark.sparkContext.broadcast(x)

    def totals(self) -> dict[int, tuple[int, np.ndarray]]:
        """Rows and statistics of the open nodes that have cases; one row for each node of a top comes to the driver."""
        shared, names, first = self._share(self.top), [f"_s{i}" for i in range(self.n_stats)], self.first

        def body(b):
            top, = shared.value
            node, rows, sums = cases.totals(b, top.place(b, first), len(top.tree))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(rows), *[pa.array(sums[:, i]) for i in range(sums.shape[1])]], names=["node", "rows", *names])

        parts = self._over(self.base, body, "node long, rows long, " + ", ".join(f"{n} double" for n in names))
        found = parts.groupBy("node").agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in names]).collect()
        return {r["node"]: (r["rows"], np.array([r[n] for n in names])) for r in found}

    def histogram(self, rows: DataFrame, drawn: dict[int, list[int]], placed: bool) -> DataFrame:
        """node, fi, v, cat and the target's statistics of each value. ``placed``: rows are (node, w) already, else they go down the tops."""
        table = np.zeros((len(self.top.tree), len(self.names)), bool)
        for n, fs in drawn.items():
            table[n, fs] = True
        shared, first, names = self._share(self.top, table), self.first, list(self.target.stats())

        def body(b):
            top, want = shared.value
            at = b.tree if placed else top.place(b, first)
            for f, node, value, sums in cases.histograms(b, at, want):
                text = f in b.texts
                v = pa.nulls(len(node), pa.float64()) if text else pa.array(value, from_pandas=True)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), f, np.int32)), v, pa.array(value, pa.string()) if text else pa.nulls(len(node), pa.string()), *[pa.array(sums[:, i]) for i in range(sums.shape[1])]], names=["node", "fi", "v", "cat", *names])

        parts = self._over(rows, body, "node long, fi int, v double, cat string, " + ", ".join(f"{n} double" for n in names))
        return parts.groupBy("node", "fi", "v", "cat").agg(*[F.sum(n).alias(n) for n in names])

    def cuts(self, hist: DataFrame, drawn: dict[int, list[int]], depth: int) -> DataFrame:
        """node, fi, KEYS, threshold, left, n_left, n_right, decrease of the cuts of a histogram."""
        target, how, kinds, found = self.target, self.how, len(self.numeric), []
        rows = [(n, f, self.top.tree[n], self.top.path[n], self.names[f]) for n, fs in drawn.items() for f in fs]
        named = self.spark.createDataFrame(rows, "node long, fi int, tree int, path string, feature string")
        hist = cut(hist)
        keys = ["node", "fi"]
        if self.numeric:
            own = splits.num_cuts(hist.filter(F.col("fi") < kinds).drop("cat"), keys, target, how.leaf, how.strict_right, scan=how.bins is None)
            own = own.join(F.broadcast(named), keys)
            if how.random_cuts:
                own = splits.random_cut(own, KEYS, how.seed + depth)
            found.append(own.withColumn("left", F.lit(None).cast("array<string>")))
        texts = hist.filter(F.col("fi") >= kinds).drop("v").withColumnRenamed("cat", "v")
        for names, search in ((self.few, lambda h: splits.best(splits.cat_cuts(h, keys, target, how.leaf), keys, ["left"])), ([c for c in self.categorical if c not in self.few], lambda h: splits.greedy_cat_cuts(h, keys, target, how.leaf))):
            if names:
                own = search(texts.filter(F.col("fi").isin([self.names.index(c) for c in names])))
                found.append(own.join(F.broadcast(named), keys).withColumn("threshold", F.lit(None).cast("double")))
        columns = ["node", "fi", *KEYS, "threshold", "left", "n_left", "n_right", "decrease"]
        return reduce(DataFrame.unionByName, [c.select(*columns) for c in found])

    def drawn(self, nodes: list[int]) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """The features that each node looks at, and all of them in the order of the draw."""
        n = len(self.names)
        m_try = min(n, self.how.m_try or n)
        keys = np.concatenate([local.node_keys(self.top.tree[x], [self.top.path[x]]) for x in nodes]) if nodes else np.zeros(0, np.int64)
        order = np.argsort(hash_numbers(np.arange(1, n + 1)[None, :], keys[:, None], self.how.seed), axis=1, kind="stable")
        whole = {x: o.tolist() for x, o in zip(nodes, order, strict=True)}
        if m_try == n or self.how.force:
            return {x: list(range(n)) for x in nodes}, whole
        return {x: o[:m_try] for x, o in whole.items()}, whole

    def level(self, depth: int) -> None:
        """Finishes or splits the open nodes."""
        how, gain = self.how, self.gain
        fits = not (how.unseen or how.vet)
        if fits and self.n_cases * self.row_bytes <= how.local_bytes and depth == 0:
            self.ends, self.open = self.open, []
            return
        found = self.totals()
        self.open = [n for n in self.open if n in found]
        if fits:
            small = [n for n in self.open if found[n][0] * self.row_bytes <= how.local_bytes]
            self.ends += small
            self.open = [n for n in self.open if n not in set(small)]
        if not self.open:
            return
        s = np.array([found[n][1] for n in self.open])
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = np.broadcast_to(gain.impurity(s), (len(s),))
            pred = np.broadcast_to(self.target.prediction(gain.split(s), NumpyOps), (len(s),))
        live = (s[:, 0] >= 2 * how.leaf) & (True if self.target.score else impurity > splits.MIN_GAIN)
        if how.max_depth > 0 and depth >= how.max_depth:
            live[:] = False
        won = self.search([n for n, on in zip(self.open, live, strict=True) if on], depth) if live.any() else {}
        following = []
        for n, total, im, p in zip(self.open, s, impurity, pred, strict=True):
            fi, threshold, left, decrease = won.get(n, (None, None, None, None))
            self.done.append((self.top.tree[n], self.top.path[n], None if fi is None else self.names[fi], threshold, left, float(p), float(total[0]), float(im), decrease))
            if fi is not None:
                following += self.top.split(n, fi, threshold, left, how.split_missing)
        self.open = following

    def search(self, nodes: list[int], depth: int) -> dict[int, tuple]:
        """(feature, threshold, left, decrease) of each node that splits; one row for each node comes to the driver."""
        how = self.how
        drawn, order = self.drawn(nodes)
        found = self.cuts(self.histogram(self.base, drawn, False), drawn, depth)
        keys = ["node", "fi"]
        if how.force and how.m_try and how.m_try < len(self.names):
            found = cut(found)
            seats = self.spark.createDataFrame([(n, f, i) for n, fs in order.items() for i, f in enumerate(fs)], "node long, fi int, seat int")
            by = Window.partitionBy("node").orderBy("seat")
            open_ = found.select(*keys).distinct().join(F.broadcast(seats), keys).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= how.m_try)
            found = found.join(open_.select(*keys), keys, "left_semi")
        if how.unseen or how.vet:
            found = cut(splits.best(found, keys, ["threshold", "left"]))
        if how.unseen:
            found = self.measured(found)
        if how.vet:
            chance = self.cuts(self.histogram(self.dealt_anew(nodes, depth), drawn, True), drawn, depth)
            chance = chance.groupBy(*keys).agg(F.max("decrease").alias("_chance"))
            found = found.join(chance, keys, "left").withColumn("decrease", F.col("decrease") - F.greatest(F.coalesce("_chance", F.lit(0.0)), F.lit(0.0))).drop("_chance")
        won = splits.best(found, ["node"], ["feature", "threshold", "left"]).select("node", "fi", "threshold", "left", "decrease").collect()
        return {r["node"]: (r["fi"], r["threshold"], r["left"], r["decrease"]) for r in won}

    def measured(self, found: DataFrame) -> DataFrame:
        """``found``, one cut for each node and feature, with the decrease that they bring on the cases that their tree lacks; a cut
        that leaves one side without such cases is gone. What is shuffled is three rows for each cut and task."""
        rows = found.select("node", "fi", "tree", "threshold", "left").collect()  # one row for each node and drawn feature
        own = [(r["tree"], r["fi"], r["threshold"], None if r["left"] is None else frozenset(r["left"])) for r in rows]
        trees = np.arange(self.first, self.first + self.n_trees)
        shared, first, names = self._share(own), self.first, list(self.target.stats())

        def body(b):
            all_cuts, = shared.value
            sums = cases.measured(b, trees, first, all_cuts)
            at = np.arange(len(all_cuts))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(sums[:, p, i]) for p in range(3) for i in range(len(names))]], names=["cut", *[f"_{p}_{k}" for p in "LRM" for k in names]])

        parts = self._over(self.base, body, "cut long, " + ", ".join(f"`_{p}_{k}` double" for p in "LRM" for k in names))
        wide = parts.groupBy("cut").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]])
        left, right, lost = ({k: F.col(f"_{p}_{k}") for k in names} for p in "LRM")
        whole = {k: left[k] + right[k] + lost[k] for k in names}
        both = wide.filter((left["n"] > 0) & (right["n"] > 0)).select("cut", splits.gain(self.target, left, right, lost, whole).alias("decrease"))
        at = self.spark.createDataFrame([(i, r["node"], r["fi"]) for i, r in enumerate(rows)], "cut long, node long, fi int")
        return found.drop("decrease").join(F.broadcast(at).join(both, "cut").drop("cut"), ["node", "fi"])

    def dealt_anew(self, nodes: list[int], depth: int) -> DataFrame:
        """The cases of the nodes with the statistics of their targets permuted inside each node, exactly, whatever its size: the k-th case
        in the order of ids gets the target of the k-th in a hashed order."""
        shared, first, wanted, names = self._share(self.top), self.first, set(nodes), [f"_s{i}" for i in range(self.n_stats)]
        shape = (len(self.numeric), len(self.categorical), slice(0, self.n_stats))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, = shared.value
            for raw in batches:
                b = cases.batch(raw, *shape)
                at = top.place(b, first)
                on = np.flatnonzero(np.isin(at, list(wanted)))
                yield pa.RecordBatch.from_arrays([pa.array(at[on]), raw.column("case_id").take(pa.array(b.row[on])), pa.array(b.w[on].astype(np.int64)), *[pa.array(b.stats[b.row[on], i]) for i in range(b.stats.shape[1])]], names=["node", "case_id", "w", *names])

        placed = cut(self.base.mapInArrow(run, "node long, case_id long, w long, " + ", ".join(f"{n} double" for n in names)))
        at = ranked(placed.select("node", "case_id", "w"), ["case_id"], ["node"], "at")
        moved = ranked(placed.select("node", "case_id", *names), [hashed("case_id", "node", self.how.seed + depth), "case_id"], ["node"], "at").drop("case_id")
        dealt = at.join(by_case(moved), ["node", "at"]).drop("at").join(by_case(self.features), "case_id")
        return dealt.withColumn("bag", F.array(F.struct(F.col("node").cast("int").alias("tree"), F.col("w").alias("mult")))).drop("node", "w")

    def finished(self) -> DataFrame:
        """The nodes from ``ends`` on, each in the task where its cases come together."""
        shared, first = self._share(self.top), self.first
        ends = np.zeros(len(self.top.tree), bool)
        ends[self.ends] = True

        def body(b):
            top, = shared.value
            at = top.place(b, first)
            on = np.flatnonzero(at >= 0)
            on = on[ends[at[on]]]
            if not len(on):  # a small node has no case in most batches
                return
            on = on[np.argsort(at[on], kind="stable")]
            heads = np.flatnonzero(np.append(True, at[on][1:] != at[on][:-1]))
            columns = cases.packed(b)
            for lo, hi in zip(heads, np.append(heads[1:], len(on)), strict=True):
                own = on[lo:hi]
                blocks = cases.pack(columns, b.row[own], b.w[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), at[own[0]])), pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(blocks, pa.binary())], names=["node", "block", "part"])

        names, numeric, few, how, target, total = self.names, len(self.numeric), set(self.few), self.how, self.whole, float(self.n_cases)

        def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, = shared.value
            head = next(batches)
            node = head.column("node")[0].as_py()
            parts = ((block, part.as_buffer()) for b in chain([head], batches) for block, part in zip(b.column("block").to_pylist(), b.column("part"), strict=True))
            del head
            grower, rows = local.grower(*cases.unpack(parts, names, numeric), target, how, few, total)
            yield _records([(top.tree[node], *x) for x in grower.grow(top.tree[node], top.path[node], rows)])

        own = slice(0 if self.whole is self.target else self.n_stats, self.n_all)
        # a block's parts come in the same order of cases as any other's
        parts = self._over(self.base, body, "node long, block int, part binary", own).withColumn("piece", F.monotonically_increasing_id())
        # nodes differ much in work: several partitions for each keep one task from getting many of them
        spread = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(4 * len(self.ends), MOST_PARTITIONS))
        return parts.repartition(spread, "node").sortWithinPartitions("node", "block", "piece").groupBy("node").applyInArrow(subtree, _GROWN)


def grow(wide: DataFrame, targets: DataFrame, bag: Bag, n_trees: int, target: Target, numeric: Sequence[str], categorical: Sequence[str], how: Growth, first: int = 0) -> DataFrame:
    """The columns of RESULT of all nodes of trees number ``first`` on.

    ``wide`` is (case_id, features), ``targets`` (case_id, y, ... and what the bag draws by). Where ``targets`` has the features too, as the
    struct WIDE, nothing is joined for them.
    """
    known, above = targets.filter(F.expr(target.y).isNotNull()), target
    if isinstance(target, OfCases) and known.count() * row_bytes(len(numeric) + len(categorical), len(target.stats())) > how.local_bytes:
        if (above := target.surrogate()) is None:
            raise ValueError(f"{type(target).__name__} needs the cases of a whole tree: raise local_bytes")
    with plain_planning(wide.sparkSession):
        growing = _Growing(wide, known, bag, n_trees, above, target, numeric, categorical, how, first)
        depth = 0
        while growing.open:
            growing.level(depth)
            depth += 1
        out = wide.sparkSession.createDataFrame(growing.done, _GROWN)
        if growing.ends:
            out = out.unionByName(growing.finished())
        return cut(_result(out, target))
