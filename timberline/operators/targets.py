"""Impurities of a set of cases from additive statistics, and what a leaf predicts.

A target names its statistics as SQL sums over rows (w: a row's multiplicity). Statistics add up, so the sides of a cut are
prefix sums and their complement. ``impurity`` gets them as a dict of columns or arrays and the engine's arithmetic.
Targets with ``score`` have no impurity: the cut with the highest score wins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from ..functions.dominance import dominance
from ..functions.engine import NumpyOps


@dataclass(frozen=True)
class Target:
    """``y`` is the SQL of the target value; rows where it is null take no part."""

    y: str = "y"
    score: bool = False

    def stats(self) -> dict[str, str]:
        raise NotImplementedError

    def impurity(self, s: dict, m):
        raise NotImplementedError

    def split_score(self, left: dict, right: dict, m):
        raise NotImplementedError


@dataclass(frozen=True)
class Classes(Target):
    """Statistics of a categorical target: n and the count of each class."""

    classes: tuple[str, ...] = ()

    def stats(self) -> dict[str, str]:
        return {"n": "sum(w)"} | {f"c{k}": f"sum(case when {self.y} = '{c}' then w else 0 end)" for k, c in enumerate(self.classes)}

    def counts(self, s: dict) -> list:
        return [s[f"c{k}"] for k in range(len(self.classes))]

    def weighted(self, s: dict) -> list:
        return self.counts(s)

    def prediction(self, s: dict, m):
        """The code of the class with the largest (weighted) count, the first of equals."""
        counts = self.weighted(s)
        top, out = m.most(*counts), -1
        for k in reversed(range(len(counts))):
            out = m.where(counts[k] == top, k, out)
        return out


@dataclass(frozen=True)
class Gini(Classes):
    def impurity(self, s, m):
        return 1.0 - sum((c * c for c in self.counts(s)[1:]), self.counts(s)[0] * self.counts(s)[0]) / (s["n"] * 1.0 * s["n"])


@dataclass(frozen=True)
class Entropy(Classes):
    def impurity(self, s, m):
        part = lambda c: m.where(c > 0, -(1.0) * (c * 1.0 / s["n"]) * m.log(m.where(c > 0, c * 1.0 / s["n"], 1.0)), 0.0)
        cs = self.counts(s)
        return sum(map(part, cs[1:]), part(cs[0]))


def class_costs(text: str, classes: tuple[str, ...]) -> tuple[float, ...]:
    """Costs in order of ``classes`` from a JSON object of class and cost; a class that it lacks costs 0."""
    costs = json.loads(text)
    return tuple(float(costs.get(c, 0.0)) for c in classes)


@dataclass(frozen=True)
class Costed(Classes):
    costs: tuple[float, ...] = ()

    def weighted(self, s: dict) -> list:
        return [c * w for c, w in zip(self.counts(s), self.costs, strict=True)]


@dataclass(frozen=True)
class Regret(Costed):
    """Costs of all classes but the costliest, over twice the cases."""

    def impurity(self, s, m):
        ws = self.weighted(s)
        return (sum(ws[1:], ws[0]) - m.most(*ws)) / (s["n"] * 2.0)


@dataclass(frozen=True)
class WeightedGini(Costed):
    def impurity(self, s, m):
        ws = self.weighted(s)
        total = sum(ws[1:], ws[0])
        return 1.0 - sum((w * w for w in ws[1:]), ws[0] * ws[0]) / (total * total)


@dataclass(frozen=True)
class DisutilityEntropy(Costed):
    def impurity(self, s, m):
        part = lambda c, w: m.where(c > 0, -w * (c * 1.0 / s["n"]) * m.log(m.where(c > 0, c * 1.0 / s["n"], 1.0)), 0.0)
        parts = [part(c, w) for c, w in zip(self.counts(s), self.costs, strict=True)]
        return sum(parts[1:], parts[0])


@dataclass(frozen=True)
class NeymanPearson(Classes):
    """False positives up to ``alpha`` are free, above they cost ``kappa`` each."""

    positive: int = 0
    alpha: float = 0.1
    kappa: float = 10.0

    def weighted(self, s: dict) -> list:
        return [c / self.alpha if k == self.positive else c * 1.0 for k, c in enumerate(self.counts(s))]

    def impurity(self, s, m):
        ws = self.weighted(s)
        pos = self.counts(s)[self.positive]
        over = (s["n"] - pos) * 1.0 / s["n"] - self.alpha
        return m.where(ws[self.positive] >= m.most(*ws), self.kappa * m.where(over > 0, over, 0.0), pos * 1.0 / s["n"])


@dataclass(frozen=True)
class RateDistance(Classes):
    """Squared distance of the first two classes' rates, left and right; with ``roots`` the Hellinger distance's terms."""

    score: bool = True

    def impurity(self, s, m):
        return -1.0 + 0.0 * s["n"]

    def split_score(self, left, right, m):
        t0, t1 = left["c0"] + right["c0"], left["c1"] + right["c1"]
        gap = lambda x: x["c0"] * 1.0 / t0 - x["c1"] * 1.0 / t1
        return gap(left) * gap(left) + gap(right) * gap(right)


@dataclass(frozen=True)
class Sse(Target):
    """Sum of squared errors; ``shift`` is taken off the values first, against cancellation."""

    shift: float = 0.0

    def _y(self) -> str:
        return f"(({self.y}) - ({self.shift!r}))" if self.shift else f"({self.y})"

    def stats(self) -> dict[str, str]:
        return {"n": "sum(w)", "s": f"sum(w * {self._y()})", "q": f"sum(w * {self._y()} * {self._y()})"}

    def impurity(self, s, m):
        return s["q"] - s["s"] * s["s"] / s["n"]

    def prediction(self, s: dict, m):
        return s["s"] / s["n"] + self.shift


@dataclass(frozen=True)
class Variance(Sse):
    def impurity(self, s, m):
        return s["q"] / s["n"] - s["s"] * s["s"] / (s["n"] * 1.0 * s["n"])


@dataclass(frozen=True)
class Friedman(Sse):
    """Gradient boosting's score on residuals: squared difference of means times n_l n_r / n."""

    score: bool = True

    def impurity(self, s, m):
        return -1.0 + 0.0 * s["n"]

    def split_score(self, left, right, m):
        gap = left["s"] / left["n"] - right["s"] / right["n"]
        return gap * gap * (left["n"] * 1.0 * right["n"]) / (left["n"] + right["n"])


@dataclass(frozen=True)
class Ordinal(Classes):
    """Mean squared distance from the mode of classes that are numbers 0, 1, ..."""

    def impurity(self, s, m):
        cs = self.counts(s)
        mode = self.prediction(s, m)
        parts = [c * (k - mode) * (k - mode) for k, c in enumerate(cs)]
        return sum(parts[1:], parts[0]) * 1.0 / s["n"]


@dataclass(frozen=True)
class Boosted(Classes):
    """AdaBoost: the weight ``bw`` of cases outside the majority class; with costs AdaCost."""

    costs: tuple[float, ...] = field(default=())

    def stats(self) -> dict[str, str]:
        cost = self.costs or (1.0,) * len(self.classes)
        return super().stats() | {f"b{k}": f"sum(case when {self.y} = '{c}' then w * bw * {cost[k]!r} else 0 end)" for k, c in enumerate(self.classes)}

    def impurity(self, s, m):
        counts, weights = self.counts(s), [s[f"b{k}"] for k in range(len(self.classes))]
        top, own = m.most(*counts), weights[-1]
        for k in reversed(range(len(counts) - 1)):
            own = m.where(counts[k] == top, weights[k], own)
        return sum(weights[1:], weights[0]) - own


@dataclass(frozen=True)
class OfCases(Target):
    """Targets whose impurity needs the cases themselves and not only sums; they are grown in memory.

    ``x`` are the statistics of single cases (weight 1), ``m`` their multiplicities, ``values`` the columns: numbers (NaN: missing)
    or integer codes (negative: missing), all in the same order.
    """

    def stats(self) -> dict[str, str]:
        return {"n": "sum(w)"}

    def prefix(self, x: np.ndarray, m: np.ndarray, values: list[np.ndarray], total: float) -> np.ndarray:
        """The impurity of the first case, the first two, and so on; ``total``: number of all cases."""
        raise NotImplementedError

    def value(self, x: np.ndarray, m: np.ndarray, values: list[np.ndarray], total: float) -> float:
        """What a leaf with these cases predicts."""
        raise NotImplementedError

    def surrogate(self) -> Target | None:
        """An additive target for nodes above what one task holds."""
        return None


def deviations(y: np.ndarray, m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each prefix the sum of v * |y - mean|, the mean weighted by ``m``."""
    mean, at = np.cumsum(m * y) / np.cumsum(m), np.arange(len(y))
    count, total = dominance(at, y, np.column_stack([v, v * y]), at, mean).T
    return mean * count - total + (np.cumsum(v * y) - total) - mean * (np.cumsum(v) - count)


@dataclass(frozen=True)
class Absolute(OfCases):
    """Mean absolute distance from the mean."""

    def stats(self):
        return {"n": "sum(w)", "y": f"sum(w * ({self.y}))"}

    def prefix(self, x, m, values, total):
        return deviations(x[:, 1], m, m) / np.cumsum(m)

    def value(self, x, m, values, total):
        return float((m * x[:, 1]).sum() / m.sum())

    def surrogate(self):
        return Sse(self.y)


@dataclass(frozen=True)
class BoostedNumbers(Absolute):
    """AdaBoost of numbers: distances from the mean, weighted by ``bw``."""

    def stats(self):
        return super().stats() | {"b": "sum(w * bw)"}

    def prefix(self, x, m, values, total):
        return deviations(x[:, 1], m, m * x[:, 2])


def log_spans(values: list[np.ndarray]) -> np.ndarray:
    """Of each prefix the sum of the logarithms of the columns' spans: largest less smallest number, different
    categories. A span of zero is left out."""
    out = np.zeros(len(values[0]) if values else 0)
    for v in values:
        if v.dtype.kind == "f":
            with np.errstate(invalid="ignore"):
                span = np.fmax.accumulate(v) - np.fmin.accumulate(v)
        else:
            first = np.zeros(len(v))
            first[np.unique(v, return_index=True)[1]] = 1
            first[v < 0] = 0
            span = np.cumsum(first)
        out += np.log(np.where(np.nan_to_num(span) > 0, np.nan_to_num(span), 1.0))
    return out


class OfRegion(OfCases):
    """Targets of the region that cases span: their statistics and the logarithm of its volume, in any engine's arithmetic."""

    def of_region(self, s: dict, volume, total: float, m):
        """The impurity."""
        raise NotImplementedError

    def in_region(self, s: dict, volume, total: float, m):
        """What a leaf there predicts."""
        raise NotImplementedError

    def prefix(self, x, m, values, total):
        sums = np.cumsum(x * m[:, None], axis=0)
        return self.of_region({k: sums[:, i] for i, k in enumerate(self.stats())}, log_spans(values), total, NumpyOps)

    def value(self, x, m, values, total):
        sums = (x * m[:, None]).sum(axis=0)
        return float(self.in_region({k: sums[i] for i, k in enumerate(self.stats())}, log_spans(values)[-1], total, NumpyOps))


@dataclass(frozen=True)
class Density(OfRegion):
    """Squared share of the cases over the volume that they span."""

    def of_region(self, s, volume, total, m):
        return m.exp(2 * m.log(s["n"] / total) - volume)

    def in_region(self, s, volume, total, m):
        return m.exp(m.log(s["n"] / total) - volume)


@dataclass(frozen=True)
class Transduction(OfRegion):
    """Gini impurity and ``alpha`` times the volume over the squared number of cases. Leaves never predict the
    ``unlabelled`` class unless ``beta`` times its cases outnumber every other."""

    classes: tuple[str, ...] = ()
    unlabelled: int = 0
    alpha: float = 1.0
    beta: float = 0.0

    def stats(self):
        return {"n": "sum(w)"} | {f"c{k}": f"sum(case when {self.y} = '{c}' then w else 0 end)" for k, c in enumerate(self.classes)}

    def of_region(self, s, volume, total, m):
        counts = [s[f"c{k}"] for k in range(len(self.classes))]
        return 1.0 - sum((c * c for c in counts[1:]), counts[0] * counts[0]) / (s["n"] * s["n"]) + self.alpha * m.exp(volume - 2 * m.log(s["n"]))

    def in_region(self, s, volume, total, m):
        counts = [s[f"c{k}"] * (self.beta if k == self.unlabelled else 1.0) for k in range(len(self.classes))]
        top, out = m.most(*counts), self.unlabelled
        for k in reversed(range(len(counts))):
            out = m.where((counts[k] == top) & (top > 0), k, out)
        return out

    def surrogate(self):
        return Gini(self.y, classes=self.classes)
