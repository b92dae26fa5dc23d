"""Forests, boosting, contrast tests and an estimator over wide tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sample, score, targets, transform
from ..session import by_case, by_leaf, cut
from .grow import Growth, grow
from .scoring import WIDE, score_leaves, with_leaf


@dataclass
class Forest:
    """Random forest (``boost=None``), gradient boosting ("gbt") or AdaBoost/AdaCost ("ada") over a wide DataFrame.

    ``target`` may be numeric (regression) or text (classes); ``impurity`` replaces the default by another target. ``bag`` is a
    kind of sample.Bag or an object like one. Where ``how`` doesn't say otherwise, a node draws the square root of the
    number of features, and leaves have one case (classes), four (regression) or a third of all (boosting).
    """

    target: str
    case_id: str
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    n_trees: int = 10
    how: Growth | None = None
    impurity: targets.Target | None = None
    bag: str | sample.Bag = "bootstrap"
    boost: str | None = None
    rate: float = 0.1
    seed: int = 1
    classes: tuple[str, ...] = ()
    nodes: DataFrame | None = None
    intercept: float = 0.0

    def _wide(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.case_id).cast("long").alias("case_id"), *[F.col(f"`{c}`") for c in (*self.numeric, *self.categorical)])

    def _cells(self, df: DataFrame) -> DataFrame:
        return transform.to_cells(df, self.case_id, self.numeric, self.categorical)

    def _targets(self, df: DataFrame, carry: bool = False) -> DataFrame:
        by = [F.col(f"`{c}`") for c in getattr(self.bag, "by", ()) if c != self.target]
        return df.select(F.col(self.case_id).cast("long").alias("case_id"), F.col(f"`{self.target}`").alias("y"), *by, *([F.struct(*[F.col(f"`{c}`") for c in (*self.numeric, *self.categorical)]).alias(WIDE)] if carry else []))

    def _spread(self, df: DataFrame) -> int:
        spark = df.sparkSession
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def _bags(self) -> sample.Bag:
        bag = sample.Bag(self.bag, self.seed) if isinstance(self.bag, str) else self.bag
        own = tuple("y" if c == self.target else c for c in getattr(bag, "by", ()))
        if isinstance(bag, sample.Bag):
            own = own or (("y",) if bag.kind == "balanced" else ())
            return replace(bag, by=own)
        return bag

    def _growth(self, number: bool, n: int) -> Growth:
        if self.how is not None:
            return self.how
        leaf = max(1, n // 3) if self.boost else 4 if number else 1
        return Growth(m_try=math.ceil(math.sqrt(len(self.numeric) + len(self.categorical))), leaf=leaf, seed=self.seed)

    def fit(self, df: DataFrame) -> Forest:
        # the cases of boosting carry their features, so its rounds join nothing
        carry = self.boost in ("ada", "gbt")
        ys = self._targets(df, carry).filter("y is not null")
        # they stay where they are from here on: spread over all cores, however few files they come from
        spread = {"ada": lambda: ys.repartition(self._spread(df), "case_id"), "gbt": lambda: ys.repartition("case_id")}
        self._cases = ys = cut(spread[self.boost]() if carry else ys)
        wide = self._wide(df)
        number = dict(ys.dtypes)["y"] != "string"
        if not number and not self.classes:  # one row for each class
            self.classes = tuple(r["y"] for r in ys.select("y").distinct().orderBy("y").collect())
        how = self._growth(number, ys.count() if self.how is None and self.boost else 0)
        if self.boost == "gbt":
            return self._fit_gradient(wide, ys, number, how)
        if self.boost == "ada":
            return self._fit_ada_numbers(wide, ys, how) if number else self._fit_ada(wide, ys, how)
        goal = self.impurity or (targets.Sse(shift=ys.agg(F.avg("y")).first()[0] or 0.0) if number else targets.Gini(classes=self.classes))
        grown = grow(wide, ys, self._bags(), self.n_trees, goal, self.numeric, self.categorical, how)
        self.nodes = self._named(grown, goal)
        return self

    @property
    def bags(self) -> DataFrame:
        """tree, case_id, mult of what the trees were grown on."""
        if getattr(self, "_drawn", None) is None:
            self._drawn = cut(self._bags().frame(self._cases, self.n_trees))
        return self._drawn

    def _named(self, grown: DataFrame, goal: targets.Target) -> DataFrame:
        if not hasattr(goal, "classes"):
            return grown
        labels = F.array(*map(F.lit, self.classes))
        return grown.withColumn("pred", F.element_at(labels, F.col("pred").cast("int") + 1))

    def _fit_gradient(self, wide: DataFrame, ys: DataFrame, number: bool, how: Growth) -> Forest:
        """Residual trees one after the other; two classes through the log-odds, leaves by a Newton step."""
        if not number:
            ys = ys.withColumn("y", (F.col("y") == self.classes[-1]).cast("double"))
            p = min(max(ys.agg(F.avg("y")).first()[0], 1e-9), 1 - 1e-9)
            self.intercept = math.log(p / (1 - p))
        else:
            self.intercept = float(ys.agg(F.avg("y")).first()[0])
        state, out = ys.withColumn("f", F.lit(self.intercept)), None
        fit = (F.tanh(F.col("f") / 2) + 1) / 2 if not number else F.col("f")
        resid = lambda cases: cases.withColumn("p", fit).withColumn("y", F.col("y") - F.col("p")).drop("f")
        mean = F.avg("y") if number else F.sum("y") / F.greatest(F.sum(F.col("p") * (1 - F.col("p"))), F.lit(1e-9))
        for t in range(self.n_trees):
            grown = grow(wide, resid(state), self._bags(), 1, targets.Friedman(), self.numeric, self.categorical, how, t)
            last = t + 1 == self.n_trees
            at = with_leaf(state, grown, self.numeric, self.categorical, "path")
            at = at if last else cut(at)
            value = cut(resid(at.filter("path is not null")).groupBy("path").agg(mean.alias("value")))
            grown = grown.join(value, "path", "left").withColumn("pred", F.when(F.col("feature").isNull(), F.coalesce("value", F.lit(0.0)).cast("string")).otherwise(F.col("pred"))).withColumn("weight", F.lit(self.rate)).drop("value")
            out = grown if out is None else out.unionByName(grown)
            if not last:
                state = at.join(by_leaf(value), "path", "left").withColumn("f", F.col("f") + self.rate * F.coalesce("value", F.lit(0.0))).drop("path", "value")
        self.nodes = cut(out)
        return self

    def _fit_ada_numbers(self, wide: DataFrame, ys: DataFrame, how: Growth) -> Forest:
        """Case weights grow with the distance from a leaf's mean; a tree no better than one leaf gets no say."""
        n = ys.count()
        state, out, goal = cut(ys.withColumn("bw", F.lit(1.0 / max(n, 1)))), None, targets.BoostedNumbers()
        mean = ys.agg(F.avg("y")).first()[0] or 0.0
        norm = (ys.agg(F.avg(F.abs(F.col("y") - mean))).first()[0] or 0.0) * n
        for t in range(self.n_trees):
            grown = grow(wide, state, self._bags(), 1, goal, self.numeric, self.categorical, how, t)
            at = score_leaves(wide, grown, self.numeric, self.categorical).select("case_id", "path")
            judged = cut(state.join(by_case(at), "case_id", "left"))
            means = by_leaf(cut(judged.groupBy("path").agg(F.avg("y").alias("_mean"))))
            judged = cut(judged.join(means, judged["path"].eqNullSafe(means["path"])).drop("path").withColumn("far", F.abs(F.col("y") - F.col("_mean"))))
            off = judged.agg(F.sum(F.col("bw") * F.col("far"))).first()[0] or 1e-10
            say = 0.0 if off > norm else math.log(norm / max(off, 1e-10))
            grown = grown.withColumn("weight", F.lit(say))
            out = grown if out is None else out.unionByName(grown)
            if say > 0:
                # exponents are taken off their largest, which the sum divides out again
                power = say * (F.col("far") - off)
                most = judged.agg(F.max(power)).first()[0] or 0.0
                raw = F.col("bw") * F.exp(power - most)
                total = judged.agg(F.sum(raw)).first()[0]
                state = cut(judged.withColumn("bw", raw / total).drop("_mean", "far"))
        self.nodes = cut(out)
        return self

    def _fit_ada(self, wide: DataFrame, ys: DataFrame, how: Growth) -> Forest:
        """Case weights grow where a tree is wrong; a tree no better than chance gets no say."""
        costs = getattr(self.impurity, "costs", ()) or (1.0,) * len(self.classes)
        goal, n = targets.Boosted(classes=self.classes, costs=costs), ys.count()
        state, out = cut(ys.withColumn("bw", F.lit(1.0 / max(n, 1)))), None
        cost = F.element_at(F.map_from_arrays(F.array(*map(F.lit, self.classes)), F.array(*map(F.lit, costs))), F.col("y"))
        for t in range(self.n_trees):
            grown = self._named(grow(wide, state, self._bags(), 1, goal, self.numeric, self.categorical, how, t), goal)
            judged = cut(with_leaf(state, grown, self.numeric, self.categorical).withColumn("wrong", F.coalesce(F.col("pred") != F.col("y"), F.lit(True))))
            err = judged.agg(F.sum(F.when(F.col("wrong"), F.col("bw")).otherwise(0.0)) / F.sum("bw")).first()[0] or 1e-10
            say = 0.0 if err >= 0.5 else 0.5 * math.log((1 - err) / max(err, 1e-10))
            grown = grown.withColumn("weight", F.lit(say))
            out = grown if out is None else out.unionByName(grown)
            if say > 0 and t + 1 < self.n_trees:
                raw = F.col("bw") * F.exp(F.when(F.col("wrong"), say).otherwise(-say)) * cost
                total = judged.agg(F.sum(raw)).first()[0]
                state = judged.withColumn("bw", raw / total).drop("wrong", "pred")
        self.nodes = cut(out)
        return self

    def votes(self, df: DataFrame) -> DataFrame:
        """tree, case_id, path, pred, weight of each case's leaf in each tree."""
        return score_leaves(self._wide(df), self.nodes, self.numeric, self.categorical)

    def predict(self, df: DataFrame) -> DataFrame:
        """case_id, pred."""
        votes = self.votes(df)
        if self.boost == "gbt":
            return score.tally_sum(votes, self.intercept, expit=bool(self.classes))
        return score.tally_mode(votes) if self.classes else score.tally_mean(votes)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """case_id and a column of vote shares for each class."""
        totals = score.vote_totals(self.votes(df), list(self.classes))
        whole = sum((F.col(f"`{c}`") for c in self.classes[1:]), F.col(f"`{self.classes[0]}`"))
        return totals.select("case_id", *[(F.col(f"`{c}`") / whole).alias(c) for c in self.classes])

    def oob(self, df: DataFrame) -> DataFrame:
        """case_id, pred from the trees whose bag lacks the case."""
        votes = self.votes(df).join(by_case(self.bags.select("tree", "case_id")), ["tree", "case_id"], "left_anti")
        return score.tally_mode(votes) if self.classes else score.tally_mean(votes)

    def importance(self) -> DataFrame:
        return score.importance(self.nodes.filter("feature is not null"), self.n_trees)


def contrast_test(df: DataFrame, forest: Forest, n_forests: int, cutoff: float | None = None) -> tuple[DataFrame, Forest | None]:
    """(feature, mean, t, df, p) of importance against a permuted copy over several forests; with ``cutoff`` a last forest
    of the features with a smaller p and some importance."""
    rounds = None
    names = [*forest.numeric, *forest.categorical]
    double = lambda xs: [*xs, *(f"{n}:SHUFFLED" for n in xs)]
    for k in range(n_forests):
        wide = transform.wide_contrasts(forest._wide(df), "case_id", names, forest.seed + k)
        ys = forest._targets(df).filter("y is not null")
        number = dict(ys.dtypes)["y"] != "string"
        goal = forest.impurity or (targets.Sse() if number else targets.Gini(classes=forest.classes))
        how = forest.how or Growth(m_try=math.ceil(math.sqrt(2 * len(names))), leaf=4 if number else 1, seed=forest.seed)
        nodes = grow(wide, cut(ys), replace(forest._bags(), seed=forest.seed + 100 * k), forest.n_trees, goal, double(forest.numeric), double(forest.categorical), how)
        own = score.importance(nodes.filter("feature is not null"), forest.n_trees).select("feature", "per_tree", F.lit(k).alias("forest"))
        rounds = own if rounds is None else rounds.unionByName(own)
    grid = df.sparkSession.range(n_forests).select(F.col("id").cast("int").alias("forest"), F.explode(F.array(*map(F.lit, names))).alias("feature"))
    rounds = cut(rounds)
    real = grid.join(rounds, ["feature", "forest"], "left").withColumn("real", F.coalesce("per_tree", F.lit(0.0))).drop("per_tree")
    fake = rounds.filter("endswith(feature, ':SHUFFLED')").select(F.regexp_replace("feature", ":SHUFFLED$", "").alias("feature"), "forest", F.col("per_tree").alias("fake"))
    tested = score.welch(real.join(fake, ["feature", "forest"], "left").withColumn("fake", F.coalesce("fake", F.lit(0.0))), "feature", "real", "fake")
    if cutoff is None:
        return tested, None
    kept = {r["feature"] for r in tested.filter((F.col("p") < cutoff) & (F.col("mean") > 0)).collect()}
    last = replace(forest, numeric=[f for f in forest.numeric if f in kept], categorical=[f for f in forest.categorical if f in kept], nodes=None)
    return tested, last.fit(df) if kept else None
