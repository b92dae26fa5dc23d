"""Growth of the subtree below a node in the task that has its cases, by the rules of the distributed levels.

Columns are held as places among their sorted different values (missing: -1). On a level each feature's drawn nodes get a
histogram over (node, value) by counting or, where values are many, by sorting; prefix sums of the target's statistics give every cut's gain at
once. So the work of a level is a few passes over the cases whatever the number of nodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.engine import NumpyOps
from ..functions.rng import hash_numbers
from ..operators.splits import EXHAUSTIVE, MIN_GAIN, MIN_GAP
from ..operators.targets import OfCases, Target


#: Cells of a histogram whose cuts are weighed at a time.
CELLS = 1 << 16


@dataclass
class Column:
    """A feature: ``codes`` are places in ``values`` (sorted numbers, in single precision where that loses nothing, or categories), -1 where
    missing."""

    name: str
    codes: np.ndarray
    values: list | np.ndarray
    numeric: bool

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        return self.values[codes].astype(float)


def node_keys(tree: int, paths: list[str]) -> np.ndarray:
    """The number by which a node's draws are hashed."""
    return np.array([zlib.crc32(f"{tree}:{p}".encode()) for p in paths], np.int64)


class Gain:
    """Decreases of cuts from arrays of statistics, whose last axis has the target's names."""

    def __init__(self, target: Target):
        self.target, self.names = target, list(target.stats())

    def split(self, a: np.ndarray) -> dict[str, np.ndarray]:
        return {k: a[..., i] for i, k in enumerate(self.names)}

    def impurity(self, a: np.ndarray) -> np.ndarray:
        return self.target.impurity(self.split(a), NumpyOps)

    def __call__(self, left: np.ndarray, right: np.ndarray, lost: np.ndarray) -> np.ndarray:
        whole = left + right + lost
        n = whole[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.target.score:
                return self.target.split_score(self.split(left), self.split(right), NumpyOps) * (left[..., 0] + right[..., 0]) / n
            gone = np.where(lost[..., 0] > 0, lost[..., 0] * self.impurity(np.where(lost[..., :1] > 0, lost, 1.0)), 0.0)
            return self.impurity(whole) - (left[..., 0] * self.impurity(left) + right[..., 0] * self.impurity(right) + gone) / n


@dataclass
class Rows:
    """Statistics of cases: ``stats`` as they are, or for counts of classes each case's class and weight."""

    stats: np.ndarray | None
    klass: np.ndarray | None = None
    weight: np.ndarray | None = None
    classes: int = 0

    def take(self, at: np.ndarray) -> Rows:
        if self.stats is not None:
            return Rows(self.stats[at])
        return Rows(None, self.klass[at], self.weight[at], self.classes)

    def sums(self, key: np.ndarray, n: int) -> np.ndarray:
        """The statistics of the cases of each key below ``n``."""
        if self.stats is not None:
            out = np.empty((n, self.stats.shape[1]))
            for i in range(self.stats.shape[1]):
                out[:, i] = np.bincount(key, weights=self.stats[:, i], minlength=n)
            return out
        counts = np.bincount(key * self.classes + self.klass, weights=self.weight, minlength=n * self.classes).reshape(n, self.classes)
        return np.column_stack([counts.sum(axis=1), counts])


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``n`` numbers from ``begin`` on."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def _histogram(node: np.ndarray, code: np.ndarray, cases: Rows, n_nodes: int, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, code, sums) of the cells that occur, in order; without the missing ones."""
    if len(code) and code.min() < 0:
        known = np.flatnonzero(code >= 0)
        node, code, cases = node[known], code[known], cases.take(known)
    key = node * n_codes + code
    if n_nodes * n_codes <= 4 * len(key) + 1024:
        cells = None
        if n_nodes * n_codes > CELLS:
            # statistics only of the cells that occur
            here = np.bincount(key, minlength=n_nodes * n_codes) > 0
            cells = np.flatnonzero(here)
            key = (np.cumsum(here, dtype=np.int32) - 1)[key]
        sums = cases.sums(key, n_nodes * n_codes if cells is None else len(cells))
        at = np.flatnonzero(sums[:, 0])
        if len(at) < len(sums):
            sums = sums[at]
        if cells is not None:
            at = cells[at]
        return at // n_codes, at % n_codes, sums
    order = np.argsort(key, kind="stable")
    key = key[order]
    lead = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = key[lead]
    sums = cases.take(order).sums(np.cumsum(lead) - 1, len(at))
    return at // n_codes, at % n_codes, sums


def _missing(node: np.ndarray, code: np.ndarray, cases: Rows, n_nodes: int) -> np.ndarray | float:
    gone = np.flatnonzero(code < 0)
    return cases.take(gone).sums(node[gone], n_nodes)


def _best_of(node: np.ndarray, gain: np.ndarray, n_nodes: int) -> np.ndarray:
    """The place of each node's largest gain (to nine places), the first of equals; -1 without a gain."""
    out = np.full(n_nodes, -1, np.int64)
    if len(node):
        rounded = np.round(gain, 9)
        lead = np.concatenate([[True], node[1:] != node[:-1]])
        top = np.maximum.reduceat(rounded, np.flatnonzero(lead))[np.cumsum(lead) - 1]
        best = np.flatnonzero(rounded == top)
        # the first of each node is written last
        out[node[best[::-1]]] = best[::-1]
    return out


class Grower:
    """One tree's search over ``columns``; ``stats`` are each case's statistics, weights included."""

    def __init__(self, columns: list[Column], stats: np.ndarray, target: Target, how, few: set[str]):
        self.columns, self.target, self.how, self.few = columns, target, how, few
        self.gain = Gain(target)
        counted = self.gain.names == ["n", *(f"c{k}" for k in range(stats.shape[1] - 1))] and stats.shape[1] > 1 and bool((stats[:, 0] == stats[:, 1:].sum(axis=1)).all())
        self.cases = Rows(None, np.argmax(stats[:, 1:], axis=1), stats[:, 0].copy(), stats.shape[1] - 1) if counted else Rows(stats)
        self.by_name = sorted(range(len(columns)), key=lambda f: columns[f].name)
        self.total = stats.shape[1]

    def numeric(self, f: int, node: np.ndarray, code: np.ndarray, stats: Rows, n_nodes: int, keys: np.ndarray, names: list[str], depth: int):
        """gain, threshold, largest code on the left of each node's cut; whether the node has any cut at all."""
        how, column = self.how, self.columns[f]
        at, cell, sums = _histogram(node, code, stats, n_nodes, max(1, len(column.values)))
        lost = _missing(node, code, stats, n_nodes)
        if not len(at):
            return None
        first = np.concatenate([[True], at[1:] != at[:-1]])
        starts = np.flatnonzero(first)
        own = np.cumsum(first) - 1
        heads = sums[starts]
        running = np.cumsum(sums, axis=0, out=sums)
        before = running[starts] - heads
        whole = running[np.append(starts[1:], len(at)) - 1] - before
        following = np.append(cell[1:], cell[-1])
        inner = np.append(~first[1:], False)
        found = []
        for lo in range(0, len(at), CELLS):
            part = slice(lo, lo + CELLS)
            left = running[part] - before[own[part]]
            right = whole[own[part]] - left
            gap = column.numbers(following[part]) - column.numbers(cell[part])
            ok = np.flatnonzero(inner[part] & (gap > MIN_GAP) & (left[:, 0] >= how.leaf) & (right[:, 0] >= how.leaf + int(how.strict_right)))
            if len(ok):
                found.append((lo + ok, self.gain(left[ok], right[ok], lost[at[lo + ok]])))
        if not found:
            return None
        cuts, gain = (np.concatenate(x) for x in zip(*found, strict=True))
        at, cell, following = at[cuts], cell[cuts], following[cuts]
        if how.random_cuts:
            pick = np.full(n_nodes, -1, np.int64)
            counts = np.bincount(at, minlength=n_nodes)
            begin = np.cumsum(counts) - counts
            live = np.flatnonzero(counts)
            draws = np.array([zlib.crc32(f"{names[k]}:{self.columns[f].name}".encode()) for k in live], np.int64)
            pick[live] = begin[live] + hash_numbers(draws, 0, how.seed + depth) % counts[live]
        else:
            pick = _best_of(at, gain, n_nodes)
        has = pick >= 0
        p = pick[has]
        out = np.full(n_nodes, -np.inf)
        out[has] = gain[p]
        threshold, upto = np.zeros(n_nodes), np.zeros(n_nodes, np.int64)
        threshold[has], upto[has] = (column.numbers(cell[p]) + column.numbers(following[p])) / 2, cell[p]
        return out, threshold, upto

    def categorical(self, f: int, node: np.ndarray, code: np.ndarray, stats: Rows, n_nodes: int):
        """gain of each node's best set, and the sets (codes on the left)."""
        how, values = self.how, self.columns[f].values
        at, cell, sums = _histogram(node, code, stats, n_nodes, max(1, len(values)))
        lost = _missing(node, code, stats, n_nodes)
        out, sets = np.full(n_nodes, -np.inf), [None] * n_nodes
        if not len(at):
            return out, sets
        if self.columns[f].name in self.few:
            dense = np.zeros((n_nodes, len(values), self.total))
            dense[at, cell] = sums
            here = np.zeros(n_nodes, np.int64)
            np.bitwise_or.at(here, at, np.int64(1) << cell)
            top = np.zeros(n_nodes, np.int64)
            np.maximum.at(top, at, np.int64(1) << cell)
            bits = lambda mask: [c for c in range(len(values)) if mask >> c & 1]
            best = np.full(n_nodes, -np.inf)
            for mask in sorted(range(1, 1 << max(0, len(values) - 1)), key=bits):
                valid = ((mask & ~here) == 0) & (mask < top)
                left = dense[:, bits(mask)].sum(axis=1)
                right = dense.sum(axis=1) - left
                ok = valid & (left[:, 0] >= how.leaf) & (right[:, 0] >= how.leaf)
                if ok.any():
                    gain = np.where(ok, self.gain(left, right, lost), -np.inf)
                    better = np.round(gain, 9) > np.round(best, 9)
                    best = np.where(better, gain, best)
                    for k in np.flatnonzero(better):
                        sets[k] = bits(mask)
            return best, sets
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        for lo, hi in zip(starts, np.append(starts[1:], len(at)), strict=True):
            k = at[lo]
            gain, chosen = forward_selection(sums[lo:hi], lost[k], self.gain, how.leaf)
            if chosen:
                out[k], sets[k] = gain, sorted(int(c) for c in cell[lo:hi][chosen])
        return out, sets

    def grow(self, tree: int, path: str, rows: np.ndarray) -> list[tuple]:
        """(path, feature, threshold, left, code of the prediction or number, n, impurity, decrease) of the nodes from ``path`` on."""
        how, n_features = self.how, len(self.columns)
        m_try = min(n_features, how.m_try or n_features)
        out, paths, nd, depth = [], [path], np.zeros(len(rows), np.int64), len(path) - 1
        while len(paths):
            k = len(paths)
            cases = self.cases.take(rows)
            totals = cases.sums(nd, k)
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = np.broadcast_to(self.gain.impurity(totals), (k,))
                predicted = np.broadcast_to(self.target.prediction(self.gain.split(totals), NumpyOps), (k,))
            open_ = totals[:, 0] >= 2 * how.leaf
            if not self.target.score:
                open_ &= impurity > MIN_GAIN
            if how.max_depth > 0 and depth >= how.max_depth:
                open_[:] = False
            best, which = np.full(k, -np.inf), np.full(k, -1)
            threshold, upto, sets = np.zeros(k), np.zeros(k, np.int64), {}
            if open_.any():
                names = [f"{tree}:{p}" for p in paths]
                keys = node_keys(tree, paths)
                order = np.argsort(hash_numbers(np.arange(1, n_features + 1)[None, :], keys[:, None], how.seed), axis=1) if m_try < n_features else None
                drawn = np.zeros((k, n_features), bool)
                if order is None or how.force:
                    drawn[:] = open_[:, None]
                else:
                    np.put_along_axis(drawn, order[:, :m_try], True, axis=1)
                    drawn &= open_[:, None]
                found: dict[int, tuple] = {}
                size = np.bincount(nd, minlength=k)
                start = np.cumsum(size) - size
                for f in self.by_name:
                    nodes = np.flatnonzero(drawn[:, f])
                    if not len(nodes):
                        continue
                    # the rows of a node are neighbours
                    sel = slice(None) if len(nodes) == k else _ranges(start[nodes], size[nodes])
                    code = self.columns[f].codes[rows[sel]]
                    own, at = (cases, nd) if len(nodes) == k else (cases.take(sel), np.repeat(nodes, size[nodes]))
                    if self.columns[f].numeric:
                        got = self.numeric(f, at, code, own, k, keys, names, depth)
                    else:
                        got = self.categorical(f, at, code, own, k)
                    if got is not None:
                        found[f] = got
                if how.force and order is not None:
                    # constants don't cost a draw: the first m_try of the features that have a cut
                    has = np.zeros((k, n_features), bool)
                    for f, got in found.items():
                        has[:, f] = np.isfinite(got[0])
                    place = np.take_along_axis(has, order, axis=1)
                    allowed = np.zeros((k, n_features), bool)
                    np.put_along_axis(allowed, order, place & (np.cumsum(place, axis=1) <= m_try), axis=1)
                    for f, got in found.items():
                        found[f] = (np.where(allowed[:, f], got[0], -np.inf), *got[1:])
                for f in self.by_name:
                    if f not in found:
                        continue
                    gain = found[f][0]
                    better = (gain > MIN_GAIN) & (np.round(gain, 9) > np.round(best, 9))
                    best, which = np.where(better, gain, best), np.where(better, f, which)
                    if self.columns[f].numeric:
                        threshold, upto = np.where(better, found[f][1], threshold), np.where(better, found[f][2], upto)
                    else:
                        for j in np.flatnonzero(better):
                            sets[j] = found[f][1][j]
            for j in range(k):
                f = which[j]
                if f < 0:
                    out.append((paths[j], None, None, None, predicted[j], totals[j, 0], impurity[j], None))
                elif self.columns[f].numeric:
                    out.append((paths[j], self.columns[f].name, float(threshold[j]), None, predicted[j], totals[j, 0], impurity[j], float(best[j])))
                else:
                    out.append((paths[j], self.columns[f].name, None, [self.columns[f].values[c] for c in sets[j]], predicted[j], totals[j, 0], impurity[j], float(best[j])))
            rows, nd, paths = self.route(rows, nd, paths, which, upto, sets)
            depth += 1
        return out

    def route(self, rows, nd, paths, which, upto, sets):
        """The cases of the next level, node by node, and its nodes."""
        side = np.full(len(rows), -1, np.int8)
        for f in np.unique(which[which >= 0]):
            sel = np.flatnonzero(which[nd] == f)
            code = self.columns[f].codes[rows[sel]]
            if self.columns[f].numeric:
                goes = np.where(code <= upto[nd[sel]], 0, 1)
            else:
                left = np.zeros((len(paths), len(self.columns[f].values) + 1), bool)
                for j in np.flatnonzero(which == f):
                    left[j, sets[j]] = True
                goes = np.where(left[nd[sel], code], 0, 1)
            side[sel] = np.where(code < 0, 2 if self.how.split_missing else -1, goes)
        keep = side >= 0
        rows, nd, side = rows[keep], nd[keep], side[keep]
        size = np.bincount(nd * 3 + side, minlength=3 * len(paths))
        start = np.cumsum(size) - size
        place = np.empty(len(rows), np.int64)
        for s in range(3):
            # the k-th row of a node and side goes to the k-th place of that child
            own = np.flatnonzero(side == s)
            many = size[s::3]
            place[own] = np.arange(len(own)) + np.repeat(start[s::3] - (np.cumsum(many) - many), many)
        out = np.empty_like(rows)
        out[place] = rows
        there = np.flatnonzero(size)
        return out, np.repeat(np.arange(len(there)), size[there]), [paths[x // 3] + "LRM"[x % 3] for x in there.tolist()]


class CaseGrower(Grower):
    """The same for targets that look at the cases themselves: node by node, each feature's cuts from prefix impurities
    in both directions."""

    def __init__(self, columns: list[Column], base: np.ndarray, mult: np.ndarray, target: OfCases, how, few: set[str], total: float):
        self.total = total
        self.columns, self.base, self.mult, self.target, self.how, self.few = columns, base, mult, target, how, few
        self.by_name = sorted(range(len(columns)), key=lambda f: columns[f].name)
        self.raw = [np.where(c.codes >= 0, np.asarray(c.values, float)[c.codes] if len(c.values) else np.nan, np.nan) if c.numeric else c.codes for c in columns]

    def _of(self, rows: np.ndarray) -> tuple:
        return self.base[rows], self.mult[rows], [v[rows] for v in self.raw], self.total

    def impurity(self, rows: np.ndarray) -> float:
        return float(self.target.prefix(*self._of(rows))[-1]) if len(rows) else 0.0

    def cuts(self, f: int, rows: np.ndarray, whole: float):
        """Decrease and (threshold, largest code on the left) or (None, codes on the left) of the best cut of a node."""
        c, how = self.columns[f], self.how
        code = c.codes[rows]
        lost, rows, code = rows[code < 0], rows[code >= 0], code[code >= 0]
        n_lost, n = self.mult[lost].sum(), self.mult[rows].sum() + self.mult[lost].sum()
        gone = n_lost * self.impurity(lost) if len(lost) else 0.0
        best = (-np.inf, None)
        if c.numeric:
            order = np.argsort(code, kind="stable")
            rows, code = rows[order], code[order]
            if len(rows) < 2:
                return best
            left = np.cumsum(self.mult[rows])
            right = left[-1] - left
            at = np.flatnonzero(code[1:] != code[:-1])
            at = at[(c.numbers(code[at + 1]) - c.numbers(code[at]) > MIN_GAP) & (left[at] >= how.leaf) & (right[at] >= how.leaf + int(how.strict_right))]
            if not len(at):
                return best
            low, high = self.target.prefix(*self._of(rows)), self.target.prefix(*self._of(rows[::-1]))[::-1]
            gain = whole - (left[at] * low[at] + right[at] * high[at + 1] + gone) / n
            k = int(np.argmax(np.round(gain, 9)))
            a, b = code[at[k]], code[at[k] + 1]
            return float(gain[k]), (float(c.numbers(np.array([a, b])).sum() / 2), int(a))

        def of(left: list[int]) -> float:
            inside = np.isin(code, left)
            l, r = rows[inside], rows[~inside]
            if self.mult[l].sum() < how.leaf or self.mult[r].sum() < how.leaf or not len(r):
                return -np.inf
            return whole - (self.mult[l].sum() * self.impurity(l) + self.mult[r].sum() * self.impurity(r) + gone) / n

        here = sorted(set(code.tolist()))
        if c.name in self.few:
            for left in sorted([x for i, x in enumerate(here) if mask >> i & 1] for mask in range(1, 1 << max(0, len(here) - 1))):
                if (gain := of(left)) > best[0] and round(gain, 9) > round(max(best[0], -1e300), 9):
                    best = (gain, (None, left))
            return best
        chosen: list[int] = []
        while rest := [x for x in here if x not in chosen]:
            gain, x = max((of([*chosen, x]), -x) for x in rest)
            if not gain > max(best[0], MIN_GAIN) + 1e-12:
                break
            chosen.append(-x)
            best = (gain, (None, sorted(chosen)))
        return best

    def grow(self, tree: int, path: str, rows: np.ndarray) -> list[tuple]:
        how, n_features, out, stack = self.how, len(self.columns), [], [(path, rows)]
        m_try = min(n_features, how.m_try or n_features)
        while stack:
            path, rows = stack.pop()
            n, whole = self.mult[rows].sum(), self.impurity(rows)
            best, feature = (MIN_GAIN, None), -1
            if n >= 2 * how.leaf and whole > 0 and not (how.max_depth > 0 and len(path) - 1 >= how.max_depth):
                order = np.argsort(hash_numbers(np.arange(1, n_features + 1), node_keys(tree, [path]), how.seed))
                found = {}
                for f in order.tolist():
                    if len(found) == m_try:
                        break
                    got = self.cuts(f, rows, whole)
                    if got[1] is not None or not how.force:
                        found[f] = got
                for f in (f for f in self.by_name if f in found):
                    if found[f][1] is not None and found[f][0] > MIN_GAIN and round(found[f][0], 9) > round(best[0], 9):
                        best, feature = found[f], f
            pred = self.target.value(*self._of(rows))
            if feature < 0:
                out.append((path, None, None, None, pred, n, whole, None))
                continue
            c, (threshold, left) = self.columns[feature], best[1]
            names = None if c.numeric else [c.values[k] for k in left]
            out.append((path, c.name, threshold, names, pred, n, whole, best[0]))
            code = c.codes[rows]
            goes = code <= left if c.numeric else np.isin(code, left)
            for side, test in (("L", (code >= 0) & goes), ("R", (code >= 0) & ~goes), ("M", code < 0)):
                if test.any() and (side != "M" or how.split_missing):
                    stack.append((path + side, rows[test]))
        return out


def grower(columns: list[Column], base: np.ndarray, mult: np.ndarray, target: Target, how, few: set[str], total: float) -> tuple[Grower, np.ndarray]:
    """A grower and the cases that ``mult`` draws, whose statistics ``base`` may be overwritten; ``total``: cases of the whole table."""
    rows = np.flatnonzero(mult)
    if isinstance(target, OfCases):
        return CaseGrower(columns, base, mult, target, how, few, total), rows
    return Grower(columns, np.multiply(base, mult[:, None], out=base), target, how, few), rows


def forward_selection(x: np.ndarray, lost: np.ndarray, gain: Callable, leaf: int) -> tuple[float, list[int]]:
    """The gain and the rows of ``x`` (a category's statistics each) that go left, the one that helps most after the other."""
    total, now = x.sum(axis=0), np.zeros(x.shape[1])
    best, chosen, rest = MIN_GAIN, [], list(range(len(x)))
    while rest:
        left = now + x[rest]
        right = total - left
        ok = (left[:, 0] >= leaf) & (right[:, 0] >= leaf)
        if not ok.any():
            break
        gains = np.where(ok, gain(left, right, np.broadcast_to(lost, left.shape)), -np.inf)
        k = int(np.argmax(np.round(gains, 12)))
        if not gains[k] > best + 1e-12:
            break
        best, now = gains[k], left[k]
        chosen.append(rest.pop(k))
    return float(best), chosen

