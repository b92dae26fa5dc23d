"""Cases on their way through growing trees: wide rows with the trees that drew them, their places in the trees' tops, and
what a batch of them adds to histograms, to measured cuts and to the nodes that one task finishes."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa

from .local import Column, Rows, _histogram

#: Features of a part of a node's cases.
BLOCK = 8


@dataclass
class Batch:
    """Rows of a batch: ``x`` of each feature (numbers with NaN, or codes with -1), ``texts`` of the categorical ones, their
    statistics, and (row, tree, w) for each tree that drew a row."""

    x: list[np.ndarray]
    texts: dict[int, list[str]]
    stats: np.ndarray
    row: np.ndarray
    tree: np.ndarray
    w: np.ndarray


def batch(b: pa.RecordBatch, numeric: int, categorical: int, stats: slice) -> Batch:
    """From the columns _x*, _c*, _s* and ``bag`` (lists of tree and mult)."""
    x = [b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(numeric)]
    texts = {}
    for i in range(categorical):
        coded = b.column(f"_c{i}").dictionary_encode()
        x.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
        texts[numeric + i] = coded.dictionary.to_pylist()
    s = np.column_stack([b.column(f"_s{i}").to_numpy(zero_copy_only=False) for i in range(stats.start, stats.stop)])
    bag = b.column("bag")
    drawn = bag.flatten()
    row = np.repeat(np.arange(b.num_rows), np.diff(bag.offsets.to_numpy()))
    return Batch(x, texts, s, row, drawn.field("tree").to_numpy(zero_copy_only=False).astype(np.int64), drawn.field("mult").to_numpy(zero_copy_only=False).astype(float))


@dataclass
class Top:
    """The upper nodes of all trees, as lists: feature (-1: none yet), threshold or left set, children by L, R and M (-1: none)."""

    tree: list[int] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[frozenset | None] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)

    def add(self, tree: int, path: str) -> int:
        self.tree.append(tree)
        self.path.append(path)
        self.feature.append(-1)
        self.threshold.append(np.nan)
        self.left.append(None)
        self.child.append([-1, -1, -1])
        return len(self.tree) - 1

    def split(self, node: int, feature: int, threshold: float | None, left: Sequence[str] | None, missing: bool) -> list[int]:
        self.feature[node], self.threshold[node] = feature, np.nan if threshold is None else threshold
        self.left[node] = None if left is None else frozenset(left)
        self.child[node] = [self.add(self.tree[node], self.path[node] + s) if s != "M" or missing else -1 for s in "LRM"]
        return [c for c in self.child[node] if c >= 0]

    def place(self, b: Batch, first: int) -> np.ndarray:
        """The node of each (row, tree) of a batch, -1 where a missing value has no way on; roots are in the order of trees from ``first`` on."""
        feature, threshold, child = np.array(self.feature), np.array(self.threshold), np.array(self.child)
        at = b.tree - first
        live = np.arange(len(at))
        while len(live):
            f = feature[at[live]]
            live, f = live[f >= 0], f[f >= 0]
            side = np.full(len(live), 2, np.int64)
            for k in np.unique(f):
                sel = np.flatnonzero(f == k)
                node, x = at[live[sel]], b.x[k][b.row[live[sel]]]
                if k in b.texts:
                    sets = {n: np.array([t in self.left[n] for t in b.texts[k]] + [False]) for n in np.unique(node)}
                    for n, inside in sets.items():
                        own = sel[node == n]
                        c = x[node == n]
                        side[own] = np.where(c < 0, 2, np.where(inside[c], 0, 1))
                else:
                    side[sel] = np.where(np.isnan(x), 2, np.where(x <= threshold[node], 0, 1))
            at[live] = child[at[live], side]
            live = live[at[live] >= 0]
        return at


def totals(b: Batch, at: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, rows, sums) of the nodes that have cases."""
    on = np.flatnonzero(at >= 0)
    count = np.bincount(at[on], minlength=n_nodes)
    node = np.flatnonzero(count)
    s = b.stats[b.row[on]] * b.w[on, None]
    return node, count[node], np.column_stack([np.bincount(at[on], weights=s[:, i], minlength=n_nodes) for i in range(s.shape[1])])[node]


def histograms(b: Batch, at: np.ndarray, drawn: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | list, np.ndarray]]:
    """(feature, node, value, sums) for each feature: the sums of the cases of each node that drew it (``drawn``: nodes x features) and value
    (NaN or None: missing)."""
    on = np.flatnonzero(at >= 0)
    for f in np.flatnonzero(drawn.any(axis=0)):
        sel = on[drawn[at[on], f]]
        if not len(sel):
            continue
        node, x = at[sel], b.x[f][b.row[sel]]
        if f in b.texts:
            code, values = x, b.texts[f]
        else:
            values, code = np.unique(x[~np.isnan(x)], return_inverse=True)
            full = np.full(len(x), -1, np.int64)
            full[~np.isnan(x)] = code
            code = full
        # the missing ones are the value behind all others
        code = np.where(code < 0, len(values), code)
        stats = Rows(b.stats[b.row[sel]] * b.w[sel, None])
        node, cell, sums = _histogram(node, code, stats, len(drawn), len(values) + 1)
        if f in b.texts:
            value = [*values, None]
            yield int(f), node, [value[c] for c in cell.tolist()], sums
        else:
            yield int(f), node, np.append(values, np.nan)[cell], sums


def _narrow(x: np.ndarray) -> np.ndarray:
    """In single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if np.array_equal(small, x, equal_nan=True) else x


def packed(b: Batch, few: int = 250) -> list[tuple]:
    """(values or None, column) of each feature of a batch and of its statistics, for ``pack``: what has few different values as one byte each."""
    out = []
    for f, x in enumerate(b.x):
        if f in b.texts:
            out.append(([*b.texts[f], None], x.astype(np.int32)))
            continue
        values = np.unique(x)
        out.append((_narrow(values), np.searchsorted(values, x).astype(np.uint8)) if len(values) <= few else (None, _narrow(x)))
    values, code = np.unique(b.stats, axis=0, return_inverse=True)
    return [*out, (values, code.reshape(-1).astype(np.uint8)) if len(values) <= few else (None, b.stats)]


def pack(columns: list[tuple], rows: np.ndarray, w: np.ndarray) -> list[bytes]:
    """Cases of a node, column by column, in parts of BLOCK features each; statistics and multiplicities are in the last."""
    small = w.astype(np.uint8)
    *features, stats = [(values, x[rows]) for values, x in columns]
    blocks = [(features[i : i + BLOCK], None) for i in range(0, len(features), BLOCK)] or [([], None)]
    blocks[-1] = (blocks[-1][0], (stats, small if (small == w).all() else w))
    return [pickle.dumps(block, protocol=5) for block in blocks]


def unpack(parts: Iterable[tuple[int, bytes]], names: Sequence[str], numeric: int) -> tuple[list[Column], np.ndarray, np.ndarray]:
    """The columns, statistics and multiplicities of a node's cases from all its parts, (number of the block, what ``pack`` made of it) in the
    order of blocks: so what isn't coded yet is one block at most."""
    out: list[Column] = []
    for _, own in groupby(parts, itemgetter(0)):
        loaded = [pickle.loads(p) for _, p in own]
        for f in range(len(loaded[0][0])):
            name, pieces = names[len(out)], [features[f] for features, _ in loaded]
            out.append(_number(name, pieces) if len(out) < numeric else _category(name, pieces))
    rest = [last for _, last in loaded]
    stats = np.concatenate([x if values is None else values[x] for (values, x), _ in rest])
    return out, stats, np.concatenate([w for _, w in rest]).astype(float)


def _category(name: str, pieces: list[tuple]) -> Column:
    values = sorted({v for own, _ in pieces for v in own if v is not None})
    place = {v: i for i, v in enumerate(values)} | {None: -1}
    return Column(name, np.concatenate([np.array([place[v] for v in own], np.int32)[code] for own, code in pieces]), values, False)


def _number(name: str, pieces: list[tuple]) -> Column:
    if all(own is not None for own, _ in pieces):
        values = np.unique(np.concatenate([own for own, _ in pieces]))
        codes = np.concatenate([np.searchsorted(values, own).astype(np.int32)[code] for own, code in pieces])
    else:
        values, codes = np.unique(np.concatenate([code if own is None else own[code] for own, code in pieces]), return_inverse=True)
        codes = codes.astype(np.int32)
    # NaN is the last of the values and stands for missing
    if len(values) and np.isnan(values[-1]):
        codes[codes == len(values) - 1] = -1
        values = values[:-1]
    return Column(name, codes, values, True)


def measured(b: Batch, trees: np.ndarray, first: int, cuts: list[tuple]) -> np.ndarray:
    """cuts x (L, R, M) x statistics of the rows that a cut's tree hasn't drawn. A cut is (tree, feature, threshold or None, left or None)."""
    n = len(b.stats)
    has = np.zeros((n, len(trees)), bool)
    has[b.row, b.tree - first] = True
    out = np.zeros((len(cuts), 3, b.stats.shape[1]))
    by: dict[tuple[int, int], list[int]] = {}
    for i, (tree, f, _, _) in enumerate(cuts):
        by.setdefault((tree, f), []).append(i)
    sums = lambda key, rows, size: np.column_stack([np.bincount(key, weights=b.stats[rows, k], minlength=size) for k in range(b.stats.shape[1])])
    for (tree, f), own in by.items():
        rows = np.flatnonzero(~has[:, tree - first])
        x = b.x[f][rows]
        lost = rows[x < 0] if f in b.texts else rows[np.isnan(x)]
        out[own, 2] = b.stats[lost].sum(axis=0)
        if f in b.texts:
            rows, x = rows[x >= 0], x[x >= 0]
            cells = sums(x, rows, len(b.texts[f]))
            for i in own:
                inside = np.array([t in cuts[i][3] for t in b.texts[f]], bool)
                out[i, 0], out[i, 1] = cells[inside].sum(axis=0), cells[~inside].sum(axis=0)
            continue
        # all cuts of a tree and feature by one search: sums between neighbouring thresholds, added up
        rows, x = rows[~np.isnan(x)], x[~np.isnan(x)]
        own = sorted(own, key=lambda i: cuts[i][2])
        upto = np.cumsum(sums(np.searchsorted([cuts[i][2] for i in own], x, side="left"), rows, len(own) + 1), axis=0)
        out[own, 0], out[own, 1] = upto[:-1], upto[-1] - upto[:-1]
    return out
