"""Routing of cases to leaves, votes, tallies and error metrics.

A model is a DataFrame of nodes (tree, path, feature, threshold, left, pred, weight): path is ``*`` for the root and an L, R or M
more for each child; ``feature`` is null for leaves. A case that misses a node's feature votes only where an M child exists.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_case, by_leaf, cut
from .votes import Mean, Mode, Sum, tally

NODE = "tree int, path string, feature string, threshold double, left array<string>, pred string, weight double"


def side() -> Column:
    """L, R or M by a node's threshold or left set; unknown categories go right, NaN counts as missing."""
    by_num = F.when(F.col("num").isNull() | F.isnan("num"), "M").when(F.col("num") <= F.col("threshold"), "L").otherwise("R")
    by_cat = F.when(F.col("cat").isNull(), "M").when(F.array_contains("left", F.col("cat")), "L").otherwise("R")
    return F.when(F.col("threshold").isNotNull(), by_num).otherwise(by_cat)


def leaves(cells: DataFrame, cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, case_id, path, pred, weight of the leaf of each case (no row where it meets a missing value without an M child).

    One pair of joins for each level, which cases that have arrived pass unchanged; the nodes are model-sized and Spark
    decides by their size how to join them.
    """
    model = nodes.select("tree", "path", "feature", "threshold", "left", "pred", "weight")
    depth = nodes.agg(F.max(F.length("path"))).first()[0] or 0
    at = cases.select("case_id").join(model.filter("path = '*'"))
    for _ in range(depth - 1):
        onward = F.when(F.col("feature").isNull(), F.col("path")).otherwise(F.concat("path", side()))
        at = at.join(cells, ["case_id", "feature"], "left").select("tree", "case_id", onward.alias("path")).join(model, ["tree", "path"])
    return at.filter("feature is null").select("tree", "case_id", "path", "pred", "weight")


def score_sql(nodes: list[dict], tree: int) -> str:
    """A tree over wide columns as one nested CASE, for trees small enough to stay inside generated code."""
    by_path = {n["path"]: n for n in nodes if n["tree"] == tree}

    def walk(path: str) -> str:
        n = by_path.get(path)
        if n is None:
            return "null"
        if n["feature"] is None:
            return "'" + str(n["pred"]).replace("'", "''") + "'"
        f = f"`{n['feature']}`"
        test = f"{f} <= {n['threshold']!r}D" if n["threshold"] is not None else f"{f} in ({', '.join(repr(c) for c in n['left'])})"
        missing = f"{f} is null or isnan({f})" if n["threshold"] is not None else f"{f} is null"
        return f"case when {missing} then {walk(path + 'M')} when {test} then {walk(path + 'L')} else {walk(path + 'R')} end"

    return walk("*")


def tally_mode(votes: DataFrame) -> DataFrame:
    """case_id, pred: the class with the largest sum of weights, of equals the smallest label."""
    return tally(votes, Mode())


def tally_mean(votes: DataFrame) -> DataFrame:
    """case_id, pred: the weighted mean; what isn't a number doesn't vote."""
    return tally(votes, Mean())


def tally_sum(votes: DataFrame, intercept: float = 0.0, expit: bool = False) -> DataFrame:
    """case_id, pred: the weighted sum and the intercept, as a probability if asked."""
    return tally(votes, Sum(intercept, expit))


def vote_totals(votes: DataFrame, classes: list[str]) -> DataFrame:
    return votes.groupBy("case_id").pivot("pred", classes).agg(F.sum("weight")).na.fill(0.0)


def balanced_error(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: one minus the mean share of right predictions over the classes that occur; no vote is wrong."""
    both = actual.filter("actual is not null").join(by_case(predictions), "case_id", "left")
    rates = both.groupBy("actual").agg(F.avg((F.coalesce(F.col("pred") == F.col("actual"), F.lit(False))).cast("double")).alias("r"))
    return rates.agg((1 - F.avg("r")).alias("balanced_error"))


def regression_errors(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: mse, scaled_error (mse over variance), r2. A case without a vote is predicted 0."""
    both = actual.filter("actual is not null").join(by_case(predictions), "case_id", "left").withColumn("e", F.pow(F.coalesce(F.col("pred"), F.lit(0.0)) - F.col("actual"), 2))
    one = both.agg(F.avg("e").alias("mse"), F.var_pop("actual").alias("v"))
    return one.select("mse", (F.col("mse") / F.col("v")).alias("scaled_error"), (1 - F.col("mse") / F.col("v")).alias("r2"))


def confusion(predictions: DataFrame, actual: DataFrame) -> DataFrame:
    """label, n_actual, n_predicted, n_right, false_discovery_rate, miss_rate."""
    both = actual.filter("actual is not null").join(by_case(predictions), "case_id", "left")
    sides = both.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.coalesce("pred", F.lit("NA")).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")))).alias("x"), (F.col("actual") == F.col("pred")).alias("hit"))
    sums = sides.groupBy("x.label").agg(F.sum("x.a").alias("n_actual"), F.sum("x.p").alias("n_predicted"), F.sum(F.when(F.col("hit"), F.col("x.a")).otherwise(0)).alias("n_right"))
    return sums.select("*", ((F.col("n_predicted") - F.col("n_right")) / F.col("n_predicted")).alias("false_discovery_rate"), ((F.col("n_actual") - F.col("n_right")) / F.col("n_actual")).alias("miss_rate"))


def predictions(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id, pred, actual of every case of either; a case without a vote has no pred."""
    return actual.join(by_case(pred), "case_id", "full").select("case_id", "pred", "actual")


def accuracy(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: n, n_right, n_unvoted, accuracy of the cases whose actual class is known."""
    both = actual.filter("actual is not null").join(by_case(pred), "case_id", "left")
    right = F.count_if(F.col("pred") == F.col("actual"))
    return both.agg(F.count("*").alias("n"), right.alias("n_right"), F.count_if(F.col("pred").isNull()).alias("n_unvoted"), (right / F.count("*")).alias("accuracy"))


def running_error(votes: DataFrame, actual: DataFrame) -> DataFrame:
    """tree, squared_error of the mean vote of all trees up to each one."""
    order = Window.partitionBy("case_id").orderBy("tree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = F.expr("try_cast(pred as double)")
    upto = votes.withColumn("mean", F.sum(p * F.col("weight")).over(order) / F.sum("weight").over(order)).join(by_case(actual), "case_id")
    return upto.groupBy("tree").agg(F.avg(F.pow(F.col("mean") - F.col("actual"), 2)).alias("squared_error"))


def importance(splits: DataFrame, n_trees: int) -> DataFrame:
    """feature, mean_decrease (per use), uses, per_tree, per_used_tree, trees_used, min_depth (mean over trees that use it)."""
    per_tree = splits.groupBy("feature", "tree").agg(F.sum("decrease").alias("d"), F.count("*").alias("u"), F.min(F.length("path") - 1).alias("depth"))
    return per_tree.groupBy("feature").agg((F.sum("d") / F.sum("u")).alias("mean_decrease"), F.sum("u").alias("uses"), (F.sum("d") / n_trees).alias("per_tree"), (F.sum("d") / F.count("*")).alias("per_used_tree"), F.count("*").alias("trees_used"), F.avg("depth").alias("min_depth"))


def welch(df: DataFrame, group: str, real: str, contrast: str) -> DataFrame:
    """group, mean, t, df, p that the mean of ``real`` is above that of ``contrast`` (one-sided Welch test); without any variance t, df
    and p are null."""
    s = df.groupBy(group).agg(F.avg(real).alias("ma"), F.var_samp(real).alias("va"), F.count(real).alias("na"), F.avg(contrast).alias("mb"), F.var_samp(contrast).alias("vb"), F.count(contrast).alias("nb"))
    ea, eb = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    part = lambda e, n: F.try_divide(F.pow(e, 2), F.col(n) - 1)
    s = s.withColumn("t", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb))).withColumn("df", F.try_divide(F.pow(ea + eb, 2), part(ea, "na") + part(eb, "nb")))

    def tail(t: float, n: float) -> float:
        """P(T > t) by the continued fraction of the incomplete beta function (Lentz)."""
        if not (math.isfinite(t) and n > 0):
            return math.nan if t != t else (0.0 if t > 0 else 1.0)
        x, a, b = n / (n + t * t), n / 2, 0.5
        swap = x > (a + 1) / (a + b + 2)
        a, b, x = (b, a, 1 - x) if swap else (a, b, x)
        if x <= 0:
            half = 0.0
        else:
            front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
            c, d, f = 1.0, 0.0, 1.0
            for i in range(300):
                k = i // 2
                step = 1.0 if i == 0 else (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if i % 2 == 0 else -((a + k) * (a + b + k) * x) / ((a + 2 * k) * (a + 2 * k + 1)))
                d = 1 / (1 + step * d or 1e-300)
                c = 1 + step / c or 1e-300
                f *= c * d
                if abs(1 - c * d) < 1e-14:
                    break
            half = front * (f - 1)
        full = 1 - half if swap else half
        return full / 2 if t > 0 else 1 - full / 2

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([tail(a, b) for a, b in zip(t, n, strict=True)])

    return s.select(group, F.col("ma").alias("mean"), "t", "df", F.when(F.col("t").isNotNull(), p_value("t", "df")).alias("p"))


def proximity(assigned: DataFrame) -> DataFrame:
    """a, b, n: in how many leaves two cases meet, each with itself too.

    Pairs are made by leaf: their number is the sum of squared leaf sizes, so this is for sets of cases that are looked at.
    """
    a, b = (assigned.select("tree", "path", F.col("case_id").alias(x)) for x in "ab")
    return a.join(b, ["tree", "path"]).groupBy("a", "b").agg(F.count("*").alias("n"))


def leaf_vectors(assigned: DataFrame) -> DataFrame:
    """case_id, leaves: the leaf of a case in each tree, as sorted text. Cases with the same leaves have the same proximities."""
    leaf = F.concat_ws(":", F.col("tree").cast("string"), F.col("path"))
    return assigned.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(leaf)), " ").alias("leaves"))


def proximity_groups(assigned: DataFrame) -> DataFrame:
    """leaves_a, leaves_b, n, cases_a, cases_b: in how many leaves the cases of two leaf vectors meet, where they meet at all,
    and how many cases each vector has. With leaf_vectors that is the proximity of all cases; pairs are made between
    different vectors only, however many cases share one."""
    sized = leaf_vectors(assigned).groupBy("leaves").agg(F.count("*").alias("cases"))
    leaf = sized.select("leaves", "cases", F.explode(F.split("leaves", " ")).alias("leaf"))
    met = leaf.toDF("leaves_a", "cases_a", "leaf").join(leaf.toDF("leaves_b", "cases_b", "leaf"), "leaf")
    return met.groupBy("leaves_a", "leaves_b", "cases_a", "cases_b").agg(F.count("*").alias("n")).select("leaves_a", "leaves_b", "n", "cases_a", "cases_b")


def branch_counts(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """case_id, feature, n: how many splits on a feature a case meets on its ways."""
    inner = nodes.filter("feature is not null").select("tree", "path", "feature")
    # once for each leaf that occurs, not for each case
    ends = assigned.select("tree", F.col("path").alias("leaf")).distinct()
    met = ends.select("tree", "leaf", F.explode(F.expr("transform(sequence(1, length(leaf)), i -> left(leaf, i))")).alias("path")).join(inner, ["tree", "path"])
    counts = by_leaf(cut(met.groupBy("tree", F.col("leaf").alias("path"), "feature").agg(F.count("*").alias("k"))))
    return assigned.select("tree", "case_id", "path").join(counts, ["tree", "path"]).groupBy("case_id", "feature").agg(F.sum("k").alias("n"))


def split_dump(nodes: DataFrame) -> DataFrame:
    """feature, splits: every threshold or left set of a feature, sorted."""
    text = F.coalesce(F.col("threshold").cast("string"), F.array_join("left", ":"))
    return nodes.filter("feature is not null").groupBy("feature").agg(F.to_json(F.array_sort(F.collect_list(text))).alias("splits"))


